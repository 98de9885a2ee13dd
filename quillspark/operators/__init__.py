"""The reusable operators under one name: functions of DataFrames, apart from the registered queries that apply them to the corpus
tables. Those that stand beside their queries are imported when they are asked for."""

import importlib

_HOME = {
    "quillspark.operators.dictionary": ("find_terms",),
    "quillspark.operators.hierarchy": ("depths", "on_cycles"),
    "quillspark.plans.chunking": ("boundaries", "cascade", "recursive_split", "sized"),
    "quillspark.plans.extraction": ("modality", "numbered", "suppress_overlaps"),
    "quillspark.operators.periods": ("between", "daily", "retention", "rolling"),
    "quillspark.operators.search_index": ("build", "kept", "open_index"),
    "quillspark.operators.traversal": ("inner_edges", "traverse", "within"),
    "quillspark.plans.graph": ("find_nodes",),
    "quillspark.plans.joins": ("bulk_duplicates", "entities", "overlap"),
    "quillspark.plans.relational": ("filter_or_all", "page"),
    "quillspark.plans.retrieval": ("bm25", "nearest", "normalized", "rerank", "rrf", "top"),
    "quillspark.plans.sinks": ("append", "merge", "upsert", "write_csv", "write_json"),
    "quillspark.plans.windows": ("merge_intervals", "rate_limit"),
}
_AT = {name: module for module, names in _HOME.items() for name in names}
__all__ = sorted(_AT)


def __getattr__(name: str):
    if name not in _AT:
        raise AttributeError(name)
    return getattr(importlib.import_module(_AT[name]), name)
