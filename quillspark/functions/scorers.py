"""Scorers behind a loaded model: an iterator pandas UDF that loads the model once a worker and scores Arrow batches of pairs."""

import uuid
from collections.abc import Callable
from typing import Iterator, Tuple  # noqa: UP035 - the forms that Spark reads from the signature

import pandas as pd
from pyspark.sql.functions import pandas_udf

_loaded: dict = {}


def _model(key: str, load: Callable):
    """The model of this worker, which keeps one at a time."""
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = load()
    return _loaded[key]


def model_scorer(load: Callable[[], Callable[[list[str], list[str]], list[float]]]):
    """load() gives score(queries, texts) -> logits. What comes back takes a query and a text column, as ``rerank`` and the search
    of the API want their scorer; a null on either side is an empty text."""
    key = uuid.uuid4().hex

    def score(batches: Iterator[Tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = _model(key, load)
        for queries, texts in batches:
            yield pd.Series(model(queries.fillna("").tolist(), texts.fillna("").tolist()), dtype="float64")

    return pandas_udf(score, "double")
