import hashlib

import pytest
from pyspark.sql import functions as F

from quillspark import api
from quillspark.functions.register import register
from quillspark.functions.scorers import model_scorer
from quillspark.operators import search_index
from quillspark.sources.tables import table


def test_registered_functions(spark):
    assert len(register(spark)) == 7
    one = spark.sql("SELECT ql_tokens('The Cat a') AS t, ql_jaccard(array('a'), array('a', 'b')) AS j, ql_cosine(array(1f, 0f), array(1f, 1f)) AS c, ql_semantic_hash(' A b! ') AS h").first()
    assert one["t"] == ["the", "cat"] and one["j"] == 0.5 and one["c"] == pytest.approx(0.5**0.5) and one["h"] == hashlib.md5(b"a b").hexdigest()[:16]
    assert spark.sql("SELECT count(*) FROM ql_recursive_chunks('aa bb cc dd', 5, 0)").first()[0] == 2
    assert spark.sql("SELECT level FROM ql_structure('# A')").first()[0] == "section"


@pytest.mark.parametrize("mode", api.MODES)
def test_search(spark, sf, mode):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = docs.filter("doc_id in (3, 5)").select(F.col("doc_id").alias("item_id"), "text").join(e.select(F.col("doc_id").alias("item_id"), F.col("embedding").alias("vector")), "item_id")
    got = api.search(q, docs, e, mode, 4).collect()
    assert {r["item_id"] for r in got} == {3, 5} and max(r["rank"] for r in got) == 4
    if mode in ("lexical", "hybrid"):
        again = api.search(q, docs, e, mode, 4, index=search_index.kept(spark, sf, docs)).collect()
        assert sorted((r["item_id"], r["rank"], r["doc_id"]) for r in again) == sorted((r["item_id"], r["rank"], r["doc_id"]) for r in got)
    assert all(r["doc_id"] == r["item_id"] or mode in ("lexical", "rerank", "fusion", "hybrid") for r in got if r["rank"] == 1)


def test_ingest_list_delete(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.bin").write_bytes(b"\x00")
    got = {r["path"].rpartition("/")[2]: (r["text"], r["error"]) for r in api.ingest(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.txt": ("one", None), "b.bin": (None, "no reader for .bin")}
    d = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    assert [(r["doc_id"], r["total"], r["has_more"]) for r in api.list_documents(d, None, 0, 2).collect()] == [(3, 3, True), (2, 3, True)]
    assert api.delete_documents(d, d.filter("doc_id = 2")).count() == 2


def test_entities_as_a_table_function(spark):
    register(spark)
    spark.createDataFrame([(1, "Pay 5 million euros in 30 days", "x"), (2, None, "y"), (3, "статья 7.1, 44-ФЗ: 25 процентов", "z")], "id int, body string, kind string").createOrReplaceTempView("texts_of_entities")
    got = spark.sql("SELECT * FROM ql_entities(TABLE(texts_of_entities) PARTITION BY (id), 'body')")
    assert got.columns == ["id", "kind", "value", "start", "end"]
    assert sorted(map(tuple, got.collect())) == [(1, "money", "5 million euros", 4, 19), (1, "temporal", "30 days", 23, 30), (3, "article", "статья 7.1", 0, 10), (3, "law", "44-фз", 12, 17), (3, "percent", "25 процентов", 19, 31)]
    assert [r["kind"] for r in spark.sql("SELECT * FROM ql_entities(TABLE(SELECT body FROM texts_of_entities), 'body', 'law, percent')").collect()] == ["law", "percent"]
    for call in ("ql_entities('x', 'body')", "ql_entities(TABLE(texts_of_entities), 'none')", "ql_entities(TABLE(texts_of_entities), 'body', 'odd')"):
        with pytest.raises(Exception, match="first argument|no column|kinds are"):
            spark.sql(f"SELECT * FROM {call}").collect()


def test_rerank_by_a_loaded_model(spark, tmp_path):
    log = str(tmp_path / "loads")

    def load():
        with open(log, "a") as f:
            f.write("x")
        return lambda queries, texts: [float(len(set(q.split()) & set(t.split()))) for q, t in zip(queries, texts, strict=True)]

    rows = [(i, d, "a b c", "a b c"[: 2 * d - 1] if d else None, 0.5) for i in range(50) for d in range(4)]
    c = spark.createDataFrame(rows, "item_id long, doc_id long, query string, text string, s double").repartition(8)
    got = api.rerank(c, model_scorer(load), 2).collect()
    assert {(r["item_id"], r["rank"]): r["doc_id"] for r in got} == {(i, k): 4 - k for i in range(50) for k in (1, 2)}
    assert len(open(log).read()) <= 4  # the workers of four cores, not the eight tasks
