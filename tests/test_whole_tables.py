"""Registered queries and their SQL cover whole tables and texts."""

from pyspark.sql import functions as F

from quillspark import registry
from quillspark.plans import joins


def test_sql_states_whole_tables_and_texts():
    sql = registry.oracle_sql()
    for name in ("jn_20_spatial_pairs", "snk_06_export", "jn_05_bulk_duplicates"):
        assert "WHERE" not in sql[name].upper().split("FROM EMBEDDINGS")[-1].split("JOIN")[0] and "%" not in sql[name]
    for name in ("str_09_synonyms", "src_04_rtf"):
        assert "substr(text" not in sql[name]


def test_spatial_pairs_of_all_elements(spark, sf):
    assert joins.spatial_pairs(spark, sf).filter("b >= 200").count() > 0


def test_bulk_duplicates_among_all_documents(spark, sf):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.sha2("text", 256), "source", "lang").collect())
    by_hash, by_name, want = {}, {}, {}
    for i, h, *name in rows:
        known = by_hash.get(h, by_name.get(tuple(name)))
        want[i] = ("hash" if h in by_hash else "new" if known is None else "name", known)
        by_hash.setdefault(h, i)
        by_name.setdefault(tuple(name), i)
    got = {r["id"]: (r["kind"], r["existing_id"]) for r in registry.queries()["jn_05_bulk_duplicates"](spark, sf).collect()}
    assert got == want and len(got) == len(rows)
