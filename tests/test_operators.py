"""Operators against values worked out by hand."""

import datetime
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import dictionary, periods, products, search_index, traversal
from quillspark.plans import chunking, extraction, graph, joins, relational, retrieval, scalars, sinks, windows
from quillspark.sources import formats
from quillspark.sources.tables import new_folder
from quillspark.streaming import tasks


def test_bm25_hand_example(spark):
    import math

    docs = spark.createDataFrame([(1, "apple apple pear"), (2, "apple plum"), (3, "apple"), (4, "quince fig")], "doc_id long, text string")
    q = spark.createDataFrame([(0, "pear pear apple")], "item_id long, text string")
    got = {r["doc_id"]: r["score"] for r in retrieval.bm25(docs, q).collect()}
    idf = {t: math.log(4 - d + 0.5) - math.log(d + 0.5) for t, d in {"apple": 3, "pear": 1, "plum": 1, "quince": 1, "fig": 1}.items()}
    mean = sum(idf.values()) / 5
    part = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.2 + 0.8 * dl / 2))
    assert got[1] == pytest.approx(2 * idf["pear"] * part(1, 3) + 0.25 * mean * part(2, 3))
    assert set(got) == {1, 2, 3}


def test_minmax_of_equal_scores_is_zero(spark):
    s = spark.createDataFrame([(0, 1, 2.0), (0, 2, 2.0)], "item_id long, doc_id long, score double")
    assert {r["s"] for r in retrieval.normalized(s).collect()} == {0.0}


def test_rrf(spark):
    rows = [(0, 1, 1), (0, 2, 2), (0, 1, 3)]
    got = {r["doc_id"]: (r["rrf"], r["appearances"]) for r in retrieval.rrf(spark.createDataFrame(rows, "item_id long, doc_id long, rank int")).collect()}
    assert got == {1: (round(1 / 61 + 1 / 63, 6), 2), 2: (round(1 / 62, 6), 1)}


def test_merge_intervals_gap_of_50_and_51(spark):
    rows = [(1, 0, 10, 1, "a"), (1, 60, 70, 2, "b"), (1, 121, 130, 1, "a"), (1, 122, 125, 5, "c")]
    got = windows.merge_intervals(spark.createDataFrame(rows, "doc_id long, lo int, hi int, weight int, kind string")).collect()
    assert sorted((r["lo"], r["hi"], r["weight"], r["kinds"]) for r in got) == [(0, 70, 2, "a,b"), (121, 130, 5, "a,c")]


def test_rate_limit_ignores_rejected(spark):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    e = spark.createDataFrame([(1, 1, at(0)), (1, 2, at(5)), (1, 3, at(9)), (1, 4, at(11)), (2, 5, at(1))], "user_id long, event_id long, ts timestamp")
    got = {r["event_id"]: r["allowed"] for r in windows.rate_limit(e, 1, 10).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: True}


def test_traversal_of_path_cycle_and_isolated_node(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("c", "d")], "from_id string, to_id string")
    got = {r["id"]: r["distance"] for r in graph.within(e, spark.createDataFrame([("a",)], "id string"), 3).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2}


def test_typed_traversal_from_many_starts(spark, monkeypatch):
    rows = [("a", "b", "X"), ("b", "c", "Y"), ("c", "d", "X"), ("d", "a", "Y"), ("c", "e", "Z"), ("h", "a", "X"), *[("h", f"n{i}", "X") for i in range(50)], ("q", "q", "X")]
    e = spark.createDataFrame(rows, "from_id string, to_id string, type string")
    starts = spark.createDataFrame([("a",), ("c",), ("a",), ("alone",), (None,)], "id string")

    def brute(types, depth, directed):
        out = {}
        for s in ("a", "c", "alone"):
            level = {s: (None, [s])}
            seen = dict(level)
            for _ in range(depth):
                new = {}
                for x, (t, p) in level.items():
                    for a, b, k in rows:
                        for m, n in ((a, b),) if directed else ((a, b), (b, a)):
                            if m == x and n not in seen and (not types or k in types):
                                way = ([*p, n], t or k)
                                new[n] = min(new.get(n, way), way)
                level = {n: (t, p) for n, (p, t) in new.items()}
                seen |= level
            out |= {(s, n): (len(p) - 1, t, p) for n, (t, p) in seen.items()}
        return out

    for most in (traversal.BROADCAST_FRONTIER, 0):  # 0: by shuffle, salted
        monkeypatch.setattr(traversal, "BROADCAST_FRONTIER", most)
        for types, depth, directed in (((), 3, False), (("X",), 4, False), (("X", "Y"), 5, True), ((), 0, False)):
            got = traversal.traverse(e, starts, depth, types, directed).collect()
            assert {(r["start"], r["id"]): (r["distance"], r["first_type"], r["path"]) for r in got} == brute(types, depth, directed)


def test_index_is_kept_amended_and_read_by_terms(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")

    def same(index, now):
        want = {}
        for r in retrieval.bm25(now, items).collect():
            want.setdefault(r["item_id"], []).append((-round(r["score"], 9), r["doc_id"], r["score"]))
        got = {}
        for r in index.scores(items).collect():
            got.setdefault(r["item_id"], {})[r["doc_id"]] = r["score"]
        assert {i: {d for _, d, _ in v} for i, v in want.items()} == {i: set(v) for i, v in got.items()}
        assert all(abs(got[i][d] - s) < 1e-9 for i, v in want.items() for _, d, s in v)
        best = {}
        for r in index.top(items, 5).collect():
            best.setdefault(r["item_id"], {})[r["rank"]] = r["doc_id"]
        assert best == {i: {n: d for n, (_, d, _) in enumerate(sorted(v)[:5], 1)} for i, v in want.items()}

    odd = spark.createDataFrame([(10_004, None), (10_005, ""), (None, "license"), (10_008, "license " * 30_000)], "doc_id long, text string")
    index = search_index.build(docs.filter("doc_id % 3 <> 0"))
    index = index.insert(docs.filter("doc_id % 3 = 0").unionByName(odd))
    now = docs.unionByName(odd.filter("doc_id is not null"))
    same(index, now)
    changed = docs.filter("doc_id % 40 = 1").withColumn("text", F.concat("text", F.lit(" extra license")))
    index = index.delete(docs.filter("doc_id % 5 = 2").select("doc_id")).insert(changed)
    now = now.filter("doc_id % 5 <> 2 and doc_id % 40 <> 1").unionByName(changed)
    same(search_index.open_index(spark, index.path), now)
    same(index.compact(), now)
    plan = index.scores(items)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan
    assert re.search(r"PartitionFilters: \[[^]]*bucket#\d+ IN", plan) and "PushedFilters: [In(term" in plan
    assert search_index.build(docs.limit(0)).top(items).count() == 0 and index.scores(items.limit(0)).count() == 0


def test_entities_of_texts_with_very_many(spark):
    rng = random.Random(3)
    texts = ["", "none", "1", "a1b22c", "12 é34", *("".join(rng.choice(["7", "12", "é", " ", "ab"]) for _ in range(n)) for n in (700, 300_000))]
    got = joins.entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = {(i, n, m.start(), m[0]) for i, t in enumerate(texts) for n, m in enumerate(re.finditer("[0-9]+", t))}
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 70_000


def test_dictionary_of_ten_thousand_terms(spark, sf, monkeypatch):
    rng = random.Random(6)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.lower("text").alias("text"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    own = {t[i : i + rng.choice((1, 3, 7, 15))] for t in texts.values() for i in (rng.randrange(max(1, len(t))) for _ in range(8))}
    terms = sorted((own | {f"none{i}" for i in range(10_000)}) - {""})
    d = spark.createDataFrame([(t,) for t in [*terms, terms[0], None, ""]], "term string")
    want = {(i, t, x.find(t)) for i, x in texts.items() for t in terms if t in x}
    for chars in (dictionary.PART_CHARS, 30_000):  # in one automaton, in several
        monkeypatch.setattr(dictionary, "PART_CHARS", chars)
        got = dictionary.find_terms(docs, ["doc_id"], F.col("text"), d).collect()
        assert {(r["doc_id"], r["term"], r["first"]) for r in got} == want and len(got) == len(want)
    [r] = dictionary.find_terms(spark.createDataFrame([("k", "aaaa"), ("l", None)], "id string, text string"), ["id"], F.col("text"), spark.createDataFrame([("aa",)], "term string")).collect()
    assert tuple(r) == ("k", "aa", 0, 3) and dictionary.find_terms(docs, ["doc_id"], F.col("text"), d.limit(0)).count() == 0


def test_distinct_counts_from_daily_sketches(spark):
    """Thirty days of overlapping users, far more than a sketch holds: any range within the stated error of exact counts."""
    e = spark.range(600_000).select((F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((F.col("id") % 30).cast("int"))).alias("ts"), F.pmod(F.xxhash64("id"), F.lit(60_000) + (F.col("id") % 30) * 1000).alias("user"))
    days = periods.daily(e, F.col("ts"), F.col("user")).cache()
    assert days.count() == 30 and max(len(r["keys"]) for r in days.collect()) < 40_000
    users = {d.day: set(u) for d, u in e.groupBy(F.to_date("ts").alias("d")).agg(F.collect_set("user").alias("u")).collect()}
    for first, last in ((1, 30), (3, 9), (7, 7)):
        exact = len(set().union(*[users[d] for d in range(first, last + 1)]))
        r = periods.between(days, f"2024-01-{first:02d}", f"2024-01-{last:02d}").select("n", periods.count(F.col("keys")).alias("k")).first()
        assert abs(r["k"] - exact) < 0.05 * exact and r["n"] == 20_000 * (last - first + 1)
    for r in periods.retention(days, 7).filter("dayofmonth(day) in (14, 28)").collect():
        d = r["day"].day
        now, old = (set().union(*[users[k] for k in range(a, a + 7)]) for a in (d - 6, d - 13))
        assert all(abs(x - len(y)) < 0.05 * len(now | old) for x, y in ((r["keys"], now), (r["new_keys"], now - old), (r["returning"], now & old)))


def test_filter_or_all(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    assert [r.x for r in relational.filter_or_all(df, F.col("x") == 2).collect()] == [2]
    assert sorted(r.x for r in relational.filter_or_all(df, F.col("x") == 9).collect()) == [1, 2]


def test_dates_in_five_formats(spark):
    rows = [("2024-02-03",), ("03.02.2024",), ("03/02/2024",), ("2024/02/03",), ("03-02-2024",), ("soon",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(scalars.parse_date(F.col("s"))).collect()]
    assert got == [datetime.date(2024, 2, 3)] * 5 + [None, None]


def test_entities_positions(spark):
    d = spark.createDataFrame([(1, "ab 12 c 345"), (2, ""), (3, None)], "doc_id long, text string")
    assert [(r["pos"], r["value"]) for r in joins.entities(d).orderBy("nth").collect()] == [(3, "12"), (8, "345")]


def test_recursive_split_sizes_and_overlap():
    text = " ".join(f"word{i}" for i in range(400))
    got = chunking.recursive_split(text, 300, 60)
    assert max(map(len, got)) <= 300 and all(b.split()[0] in a for a, b in zip(got, got[1:], strict=False))
    assert chunking.recursive_split("") == []


def test_cascade_nests():
    got = chunking.cascade("# One\nshort\n1. part\n# Two\n")
    assert [g[:2] for g in got if g[0] == "section"] == [("section", "1"), ("section", "2")]
    assert got[0][3] == "# One\nshort\n1. part\n# Two\n".index("# Two")


def test_overlap_suppression_keeps_earlier_pattern():
    assert extraction.suppress_overlaps("v 10.2 and 7", [r"[0-9]+\.[0-9]+", "[0-9]+"]) == [(0, 2, 6, "10.2"), (1, 11, 12, "7")]


def test_upsert_last_version_wins(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k long, v string, version int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k long, v string, version int")
    assert sorted((r.k, r.v) for r in sinks.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "d"), (3, "e")]


def test_formats():
    assert formats.csv_text("a,b\n1,ж\n".encode("cp1251")) == "a | b\n1 | ж"
    assert formats.rtf_text(b"{\\rtf1\\b Hi\\par there}") == "Hi\nthere"
    assert formats.repair_name("закон".encode().decode("cp437")) == "закон"
    with pytest.raises(ValueError):
        formats.extract("x.bin", b"")


def test_file_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id long, s string")
    sinks.append(df, f"file://{tmp_path}/p")
    sinks.append(df, f"file://{tmp_path}/p")
    sinks.write_csv(df, f"file://{tmp_path}/c")
    sinks.write_json(df, f"file://{tmp_path}/j", "s")
    assert spark.read.parquet(f"file://{tmp_path}/p").count() == 4
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/c").columns == ["id", "s"]
    assert spark.read.json(f"file://{tmp_path}/j").count() == 2


def test_stream_retries(spark, sf):
    from quillspark.plans import streams

    assert {r["status"] for r in streams.retries(spark, sf).collect()} <= {"completed", "failed", "queued"}
    assert tasks.stream_of(spark, sf).isStreaming


LAW = "Глава 2. Общее\nСтатья 5. Первая\n1. Лицо обязано платить.\n2. Если иное, не вправе.\nСтатья 6. Вторая\n1. Гражданин может, см. статью 5 и 115-ФЗ.\n"


def test_russian_structure():
    got = [(level, LAW[a:b].split("\n")[0]) for level, _, a, b in chunking.cascade(LAW, "ru")]
    assert got[0] == ("chapter", "Глава 2. Общее") and [x for x in got if x[0] == "article"] == [("article", "Статья 5. Первая"), ("article", "Статья 6. Вторая")]
    assert [x[0] for x in got].count("part") == 3 and chunking.cascade("", "ru") == []


def test_russian_modality_and_references(spark):
    rows = [("Лицо обязано платить",), ("он не может",), ("он может",), ("если так",), ("СТАТЬЯ 12.1 и 115-ФЗ",)]
    df = spark.createDataFrame(rows, "t string")
    t = F.col("t")
    got = df.select(extraction.modality(t, "ru"), extraction.numbered(t, "article", "ru"), extraction.numbered(t, "law", "ru")).collect()
    assert [r[0] for r in got] == ["mandatory", "prohibited", "permitted", "conditional", "mandatory"]
    assert (got[4][1], got[4][2]) == (["12.1"], ["115"])


def test_leaves_of_many_starts_are_joined_not_stored(spark, monkeypatch):
    """Walks with leaves told apart give what walks without do, on a tangle with loops, double links, null ends and leaf starts, and
    write no row of a leaf that was not a start."""
    links = [(f"h{i % 7}", f"x{i}", "AB"[i % 2]) for i in range(60)] + [(f"x{i}", f"x{i * 3 % 60}", "C") for i in range(0, 60, 4)] + [("h0", "h1", "A"), ("h1", "h0", "B"), ("h2", "h2", "A"), ("h3", None, "A"), ("x1", "h1", "Z"), ("q", "p", "A")]
    e = spark.createDataFrame(links, "from_id string, to_id string, type string")
    starts = spark.createDataFrame([(f"x{i}",) for i in range(0, 60, 7)] + [("h3",), ("q",), ("gone",)], "id string")
    for directed, types in ((False, ()), (True, ()), (False, ("A", "C"))):
        got, wrote = [], []
        for many in (1_000, 1):
            monkeypatch.setattr(traversal, "MANY_STARTS", many)
            folders = []
            monkeypatch.setattr(traversal, "new_folder", lambda s, name, f=folders: f.append(new_folder(s, name)) or f[-1])
            found = traversal.traverse(e, starts, 3, types, directed)
            got.append(sorted(tuple(r) for r in found.collect()))
            wrote.append(spark.read.parquet(folders[0]).count())
        assert got[0] == got[1] and not any(r[1] is None for r in got[0])
        assert len(got[0]) == len({r[:2] for r in got[0]}) and wrote[1] < wrote[0] == len(got[0])


def test_weekly_users_are_exact_beyond_a_sketch(spark):
    """As many users as no sketch holds, with gaps of six to eight days, a null user and a null time, against sets."""
    e = spark.range(20_000).select(F.explode(F.array(*[F.col("id") % n + F.lit(k) for n, k in ((9, 0), (3, 9), (11, 18))])).alias("d"), F.col("id").alias("user"))
    e = e.filter("(user + d) % 3 > 0").unionByName(spark.createDataFrame([(2, None), (9, None), (None, 1)], "d int, user long"))
    rows = [(r["d"], r["user"]) for r in e.collect() if r["d"] is not None]
    got = {r["day"].day - 1: (r["keys"], r["new_keys"], r["returning"]) for r in periods.returning(e, F.date_add(F.lit("2024-01-01").cast("date"), F.col("d").cast("int")), F.col("user"), 7).collect()}
    want = {}
    for d in range(max(d for d, _ in rows) + 1):
        now, old = ({u for k, u in rows if x - 6 <= k <= x} for x in (d, d - 7))
        back = now & old - {None}
        if now:
            want[d] = (len(now), len(now) - len(back), len(back))
    assert got == want and max(x[0] for x in got.values()) > 1 << periods.LG_K


def test_counted_documents_meet_their_numbers_unsorted(spark, sf, capsys):
    """Documents as counted terms are wide, so a task does not sort them to find a number a document."""
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet").limit(3)
    extra = docs.select("doc_id", (F.col("doc_id") % 7 / 10).alias("extra"))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        best = search_index.build(docs.select("doc_id", "text")).best(items, 3, (lambda s, given, extra: s + extra,), extra)
        best.explain()
        plan = capsys.readouterr().out
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
        assert all(abs(r["final"] - r["s"] - r["doc_id"] % 7 / 10) < 1e-9 for r in best.collect())
    finally:
        spark.conf.set(key, before)


def test_products_rank_as_pairs_do(spark, sf, monkeypatch):
    """Best documents by products of matrices, in several passes and blocks, equal those of all pairs: copies, repeated ids, a term in
    half of the documents (a weight of nothing), queries of which all scores are equal or that meet nothing."""
    monkeypatch.setattr(search_index, "PASS_QUERIES", 9)
    monkeypatch.setattr(products, "PRODUCT_QUERIES", 4)
    some = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    copies = some.filter("doc_id < 60").withColumn("doc_id", F.col("doc_id") + 10_000)
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").filter("item_id < 12")
    items = items.unionByName(spark.createDataFrame([(500, "halfway"), (501, "halfway onlyhere"), (502, "nowhere"), (503, None)], "item_id long, text string"))
    for docs in (some.unionByName(copies), some.unionByName(some.filter("doc_id % 9 = 0"))):
        n = docs.count()
        half = docs.limit(n - n % 2).select("doc_id", F.when(F.col("doc_id") == 1, F.concat("text", F.lit(" onlyhere"))).otherwise(F.col("text")).alias("text"))
        half = half.withColumn("text", F.when(F.pmod("doc_id", F.lit(2)) == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" halfway"))).otherwise(F.col("text")))
        index = search_index.Index(spark, new_folder(spark, "index"), inverted=False)._segment(half, None)
        scores = index.scores(items).cache()  # by postings, which are made now
        pairs = {}
        for r in retrieval.normalized(scores).collect():
            pairs.setdefault(r["item_id"], {})[r["doc_id"]] = r["s"]
        hits = {r["item_id"]: r for r in index.hits(items).collect()}
        assert {i: len(v) for i, v in pairs.items()} == {i: r["n"] for i, r in hits.items()}
        for r in scores.groupBy("item_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi")).collect():
            assert (hits[r["item_id"]]["lo"], hits[r["item_id"]]["hi"]) == pytest.approx((r["lo"], r["hi"]))
        extra = {d: d % 7 / 10 for d in {r["doc_id"] for r in half.collect()} if d % 11}
        given = {(i, d): 0.5 + i % 3 / 8 for i in pairs for d in sorted(pairs[i])[::9]} | {(-1, 3): 1.0}
        finals = (lambda s, g, x: s, lambda s, g, x: np.round(np.fmin(s + x, 1.0), 6), lambda s, g, x: np.round(0.5 * s + 0.5 * g, 8))
        frame = spark.createDataFrame([(*k, v) for k, v in given.items()], "item_id long, doc_id long, given double")
        for lifts in (spark.createDataFrame(list(extra.items()), "doc_id long, extra double"),) if n > some.count() + 30 else (None,):
            got = {}
            for r in index.best(items, 6, finals, lifts, frame).orderBy("rank").collect():
                got.setdefault((r["form"], r["item_id"]), []).append((-r["final"], r["doc_id"]))
            for i, ds in pairs.items():
                for form, final in enumerate(finals):
                    want = sorted((-float(final(s, given.get((i, d), 0.0), extra.get(d, 0.0) if lifts else 0.0)), d) for d, s in ds.items() if not lifts or d in extra)[:6]
                    assert got[form, i] == want
            assert {i for _, i in got} == set(pairs)
    plan = index.best(items, 6)._jdf.queryExecution().executedPlan().toString()
    assert "postings" not in plan and plan.count("Exchange hashpartitioning") <= 4
