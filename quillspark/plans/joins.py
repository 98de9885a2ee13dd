"""Joins: equi, semi, range, overlap, containment, as-of and argmax joins; every theta join has an equi-key to go by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.text import jaccard, r6, tokens, words
from quillspark.operators.dictionary import find_terms
from quillspark.plans.relational import SENTENCES, sentences
from quillspark.registry import query
from quillspark.sources.tables import CHUNKS, chunks, table


@query("jn_01_users_permissions", "SELECT c_custkey, c_name, string_agg(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END, ',' ORDER BY o_orderkey) AS granted FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name")
def users_permissions(spark, sf) -> DataFrame:
    """Users with their granted permissions, ordered; the permissions are aggregated before the join."""
    o = table(spark, sf, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey"))
    g = o.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]), ",").alias("granted"))
    return table(spark, sf, "customer").select("c_custkey", "c_name").join(g, "c_custkey", "left")


@query("jn_02_permission_check", "SELECT o_orderkey, c_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_mktsegment = 'BUILDING'")
def permission_check(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return o.join(table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey", "c_mktsegment"), "c_custkey").select("o_orderkey", "c_custkey", "c_mktsegment")


@query("jn_03_revoke", "SELECT o_orderkey, CASE WHEN o_custkey = (SELECT max(c_custkey) FROM customer WHERE c_name = 'Customer#000000007' OR c_custkey = 7) THEN 'R' ELSE o_orderstatus END AS status FROM orders")
def revoke(spark, sf, user: int = 7) -> DataFrame:
    """An update by a scalar subquery: the permissions of one user are revoked."""
    who = table(spark, sf, "customer").filter((F.col("c_name") == f"Customer#{user:09d}") | (F.col("c_custkey") == user)).agg(F.max("c_custkey").alias("who"))
    o = table(spark, sf, "orders").join(F.broadcast(who))  # one row
    return o.select("o_orderkey", F.when(F.col("o_custkey") == F.col("who"), "R").otherwise(F.col("o_orderstatus")).alias("status"))


@query("jn_04_existence", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def existence(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


def bulk_duplicates(new: DataFrame, old: DataFrame, earlier: bool = False) -> DataFrame:
    """new, old(id, hash, name, type): how each new file is known: by hash first, else by name and type, else it is new.

    earlier: only files of smaller id count, so that a table can be held against itself."""
    by_hash = old.filter("hash is not null").groupBy("hash").agg(F.min("id").alias("hash_id"))
    by_name = old.groupBy("name", "type").agg(F.min("id").alias("name_id"))
    j = new.join(by_hash, "hash", "left").join(by_name, ["name", "type"], "left")
    if earlier:
        j = j.withColumns({c: F.when(F.col(c) < F.col("id"), F.col(c)) for c in ("hash_id", "name_id")})
    kind = F.when(F.col("hash_id").isNotNull(), "hash").when(F.col("name_id").isNotNull(), "name").otherwise("new")
    return j.select("id", kind.alias("kind"), F.coalesce("hash_id", "name_id").alias("existing_id"))


@query("jn_05_bulk_duplicates", """WITH f AS (SELECT doc_id AS id, sha256(text) AS hash, source AS name, lang AS type FROM documents),
j AS (SELECT id, CASE WHEN hash IS NOT NULL THEN min(id) OVER (PARTITION BY hash ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS hid,
             CASE WHEN name IS NOT NULL AND type IS NOT NULL THEN min(id) OVER (PARTITION BY name, type ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS nid FROM f)
SELECT id, CASE WHEN hid IS NOT NULL THEN 'hash' WHEN nid IS NOT NULL THEN 'name' ELSE 'new' END AS kind, coalesce(hid, nid) AS existing_id FROM j""")
def bulk_duplicates_query(spark, sf) -> DataFrame:
    """Every document against those before it."""
    f = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("hash"), F.col("source").alias("name"), F.col("lang").alias("type"))
    return bulk_duplicates(f, f, earlier=True)


def duplicate_summary(known: DataFrame) -> DataFrame:
    """bulk_duplicates() -> total_files, duplicates_found, new_files and duplicate_rate in percent (0 for no files)."""
    n, found = F.count("*"), F.count_if(F.col("kind") != "new")
    return known.agg(n.alias("total_files"), found.alias("duplicates_found"), F.count_if(F.col("kind") == "new").alias("new_files"), F.when(n > 0, r6(100 * found / n)).otherwise(0.0).alias("duplicate_rate"))


@query("jn_05_summary", """WITH j AS (SELECT count(*) OVER (PARTITION BY sha256(text) ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h, count(*) OVER (PARTITION BY source, lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM documents)
SELECT count(*) AS total_files, count(*) FILTER (h > 0 OR n > 0) AS duplicates_found, count(*) FILTER (h = 0 AND n = 0) AS new_files, round(100.0::DOUBLE * count(*) FILTER (h > 0 OR n > 0) / count(*), 6) AS duplicate_rate FROM j""")
def bulk_duplicates_summary(spark, sf) -> DataFrame:
    return duplicate_summary(bulk_duplicates_query(spark, sf))


@query("jn_06_default_zero", "SELECT d.doc_id, coalesce(l.quality, 0) AS semantic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def default_zero(spark, sf) -> DataFrame:
    l_ = table(spark, sf, "labels").select("doc_id", "quality")
    return table(spark, sf, "documents").select("doc_id").join(l_, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(0)).alias("semantic"))


#: Entities whose places are summed in one go; places of a text are sums of sums, so their cost grows with their number only.
RUN = 256


def places(before_own: Column) -> Column:
    """Starts of pieces from an array of (before, own): lengths of what lies before each piece and of the piece."""
    def running(xs: Column, gap, own) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, start, lambda s, x: F.struct((s["at"] + gap(x) + own(x)).alias("at"), F.array_append(s["out"], s["at"] + gap(x)).alias("out")))

    def whole(xs: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / RUN).cast("int")), lambda c: running(F.slice(xs, c * RUN + 1, F.lit(RUN)), lambda x: x["before"], lambda x: x["own"]))
        joined = lambda rs: F.flatten(F.zip_with(rs, running(rs, lambda r: F.lit(0), lambda r: r["at"])["out"], lambda r, s: F.transform(r["out"], lambda p: p + s)))
        return F.when(F.size(xs) > 0, F.get(F.transform(F.array(runs), joined), F.lit(0))).otherwise(F.array().cast("array<int>"))

    return F.get(F.transform(F.array(before_own), whole), F.lit(0))


def entities(docs: DataFrame) -> DataFrame:
    """doc_id, nth, pos, value: digit runs with their 0-based positions, from the lengths of what lies between."""
    parts = F.split("text", r"[0-9]+")
    found = F.regexp_extract_all("text", F.lit("([0-9]+)"), 1)
    lengths = F.zip_with(F.slice(parts, F.lit(1), F.size(found)), found, lambda p, f: F.struct(F.length(p).alias("before"), F.length(f).alias("own")))
    e = docs.select("doc_id", F.posexplode(F.arrays_zip(places(lengths).alias("pos"), found.alias("value"))).alias("nth", "e"))
    return e.select("doc_id", "nth", "e.pos", "e.value")


ENTITIES = r"""pf AS (SELECT doc_id, regexp_split_to_array(text, '[0-9]+') AS p, regexp_extract_all(text, '[0-9]+') AS f FROM documents),
ei AS (SELECT doc_id, p, f, unnest(range(len(f))) AS i FROM pf),
ents AS (SELECT doc_id, CAST(i AS INT) AS nth, CAST(coalesce(list_sum(list_transform(list_slice(p, 1, i + 1), lambda x: length(x))), 0) + coalesce(list_sum(list_transform(list_slice(f, 1, i), lambda x: length(x))), 0) AS INT) AS pos, f[i + 1] AS value FROM ei)"""
WINDOWS = "win AS (SELECT doc_id, CAST(k AS INT) AS k, CAST(k * 1000 AS INT) AS lo, CAST(least((k + 1) * 1000, n) AS INT) AS hi FROM (SELECT doc_id, length(text) AS n, unnest(range(CAST(ceil(length(text) / 1000.0) AS BIGINT))) AS k FROM documents))"


def fixed_windows(docs: DataFrame, size: int = 1000) -> DataFrame:
    n = F.length("text")
    return docs.filter(n > 0).select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), F.ceil(n / size).cast("int") - 1)).alias("k")).select("doc_id", "k", (F.col("k") * size).alias("lo"), F.least((F.col("k") + 1) * size, F.col("n")).alias("hi"))


@query("jn_07_entity_in_chunk", f"WITH {ENTITIES}, {WINDOWS} SELECT e.doc_id, e.nth, e.pos, w.k FROM ents e JOIN win w ON e.doc_id = w.doc_id AND w.lo <= e.pos AND e.pos < w.hi")
def entity_in_chunk(spark, sf) -> DataFrame:
    """Entities with the chunk that holds their start. Chunks are of one size, so the range condition is an equi-join on its number."""
    d = table(spark, sf, "documents")
    e = entities(d).withColumn("k", (F.col("pos") / 1000).cast("int"))
    w = fixed_windows(d)
    return e.join(w, ["doc_id", "k"]).filter("lo <= pos and pos < hi").select("doc_id", "nth", "pos", "k")


@query("jn_08_zone_overlap", f"WITH {ENTITIES}, {WINDOWS}, z AS (SELECT doc_id, nth, greatest(pos - 100, 0) AS a, pos + 100 AS b FROM ents) SELECT z.doc_id, z.nth, w.k FROM z JOIN win w ON z.doc_id = w.doc_id AND NOT (z.b < w.lo OR z.a > w.hi)")
def zone_overlap(spark, sf) -> DataFrame:
    """Zones of 100 characters around entities with the chunks that they touch, by the numbers of the chunks that a zone reaches."""
    d = table(spark, sf, "documents")
    z = entities(d).select("doc_id", "nth", F.greatest(F.col("pos") - 100, F.lit(0)).alias("a"), (F.col("pos") + 100).alias("b"))
    near = F.sequence(F.greatest(F.floor((F.col("a") - 1) / 1000), F.lit(0)).cast("int"), F.floor(F.col("b") / 1000).cast("int"))
    z = z.withColumn("k", F.explode(near))
    return z.join(fixed_windows(d), ["doc_id", "k"]).filter("not (b < lo or a > hi)").select("doc_id", "nth", "k")


#: Kinds of numbers by their length, and the relation that two kinds have, whichever comes first; others are near each other.
NUMBER_KINDS = {1: "ordinal", 2: "ordinal", 4: "year"}
PAIR_RULES = {("year", "year"): "PERIOD", ("ordinal", "year"): "DATED", ("ordinal", "ordinal"): "LISTED", ("amount", "year"): "VALUED_AT"}
_KIND_SQL = "CASE length({0}) " + " ".join(f"WHEN {n} THEN '{k}'" for n, k in NUMBER_KINDS.items()) + " ELSE 'amount' END"
_RULE_SQL = "CASE " + " ".join(f"WHEN least(k, m) = '{a}' AND greatest(k, m) = '{b}' THEN '{r}'" for (a, b), r in PAIR_RULES.items()) + " ELSE 'NEAR' END"


@query("jn_09_near_pairs", f"WITH {ENTITIES}, t AS (SELECT *, {_KIND_SQL.format('value')} AS kind FROM ents), p AS (SELECT a.doc_id, a.nth AS i, b.nth AS j, a.kind AS k, b.kind AS m FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.nth < b.nth AND abs(b.pos - a.pos) < 200) SELECT doc_id, i, j, {_RULE_SQL} AS relation FROM p")
def near_pairs(spark, sf, within: int = 200) -> DataFrame:
    """Pairs of entities of a document less than 200 characters apart, with the relation that a table of rules gives for their kinds:
    cells of that size and their neighbours are joined."""
    kind = F.coalesce(*[F.when(F.length("value") == n, k) for n, k in NUMBER_KINDS.items()], F.lit("amount"))
    e = entities(table(spark, sf, "documents")).withColumn("cell", F.floor(F.col("pos") / within)).withColumn("kind", kind)
    a = e.select("doc_id", F.col("nth").alias("i"), F.col("pos").alias("p"), F.col("kind").alias("k"), F.explode(F.array("cell", F.col("cell") + 1)).alias("cell"))
    b = e.select("doc_id", F.col("nth").alias("j"), F.col("pos").alias("q"), F.col("kind").alias("m"), "cell")
    p = a.join(b, ["doc_id", "cell"]).filter((F.col("i") < F.col("j")) & (F.abs(F.col("q") - F.col("p")) < within))
    rules = F.create_map(*[F.lit(x) for (k, m), r in PAIR_RULES.items() for x in (f"{k} {m}", r)])
    pair = F.concat_ws(" ", F.least("k", "m"), F.greatest("k", "m"))
    return p.select("doc_id", "i", "j", F.coalesce(F.try_element_at(rules, pair), F.lit("NEAR")).alias("relation"))


@query("jn_10_first_containing", f"WITH {CHUNKS}, e AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS value FROM documents) SELECT e.doc_id, e.value, coalesce(min(c.chunk_index), 0) AS chunk_index FROM e LEFT JOIN chunks c ON c.doc_id = e.doc_id AND contains(c.text, e.value) GROUP BY e.doc_id, e.value")
def first_containing(spark, sf) -> DataFrame:
    """Each value with the first chunk of its document that contains it, else the first of all.

    Chunks are lines, and a value has no line end, so it is first contained in the line of its first occurrence.
    """
    values = F.array_distinct(F.regexp_extract_all("text", F.lit("([0-9]+)"), 1))
    line = lambda v: F.size(F.split(F.substr(F.col("text"), F.lit(1), F.call_function("locate", v, F.col("text"))), "\n")) - 1
    found = F.transform(values, lambda v: F.struct(v.alias("value"), line(v).alias("chunk_index")))
    return table(spark, sf, "documents").select("doc_id", F.inline(found))


_CONCEPTS = r"concepts AS (SELECT DISTINCT unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: length(w) > 7)) AS concept FROM benchmark)"


def concept_table(spark, sf) -> DataFrame:
    """The dictionary of concepts: the long words of the benchmark's items."""
    return table(spark, sf, "benchmark").select(F.explode(tokens(F.col("text"), 7)).alias("term")).distinct()


@query("jn_11_concept_links", f"WITH {CHUNKS}, {_CONCEPTS}, h AS (SELECT doc_id, chunk_index, concept, regexp_matches(text, '[0-9]') AS bound FROM chunks JOIN concepts ON contains(lower(text), concept)) SELECT doc_id, chunk_index, concept, CASE WHEN chunk_index = 0 THEN 'DEFINES' ELSE 'EXPLAINS' END AS relation FROM h UNION ALL SELECT doc_id, chunk_index, concept, 'APPLIES_TO' FROM h WHERE bound")
def concept_links(spark, sf) -> DataFrame:
    """Concepts of a table with the chunks that contain them: the first chunk of a document defines, others explain, and those that
    hold a number, as constraints do, apply to them. One automaton holds all concepts."""
    c = chunks(table(spark, sf, "documents")).select("doc_id", "chunk_index", "text", F.col("text").rlike("[0-9]").alias("bound"))
    found = find_terms(c, ["doc_id", "chunk_index", "bound"], F.lower("text"), concept_table(spark, sf))
    kind = F.when(F.col("chunk_index") == 0, "DEFINES").otherwise("EXPLAINS")
    kinds = F.when(F.col("bound"), F.array(kind, F.lit("APPLIES_TO"))).otherwise(F.array(kind))
    return found.select("doc_id", "chunk_index", F.col("term").alias("concept"), F.explode(kinds).alias("relation"))


@query("jn_12_last_header", f"WITH {CHUNKS}, h AS (SELECT *, CASE WHEN length(text) < 60 THEN text END AS header FROM chunks) SELECT doc_id, chunk_index, last_value(header IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chapter FROM h")
def last_header(spark, sf) -> DataFrame:
    """As-of join: the last short line at or before each chunk."""
    h = F.when(F.length("text") < 60, F.col("text"))
    w = W.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(W.unboundedPreceding, 0)
    return chunks(table(spark, sf, "documents")).select("doc_id", "chunk_index", F.last(h, ignorenulls=True).over(w).alias("chapter"))


_PARENT = f"WITH {CHUNKS}, c AS (SELECT doc_id, chunk_index AS i, length(text) % 7 AS a, CASE WHEN length(text) < 60 THEN 1 ELSE 2 END AS level FROM chunks)"


@query("jn_13_best_parent", _PARENT + """, s AS (SELECT k.doc_id, k.i, p.i AS parent, row_number() OVER (PARTITION BY k.doc_id, k.i ORDER BY 0.8 * CAST(k.a = p.a AS INT) + 0.2 * greatest(0, 1 - (k.i - p.i) / 10000.0) DESC, p.i) AS r
FROM c k JOIN c p ON k.doc_id = p.doc_id AND p.level = k.level - 1 AND p.i < k.i) SELECT doc_id, i AS chunk_index, parent FROM s WHERE r = 1""")
def best_parent(spark, sf, far: int = 10_000) -> DataFrame:
    """The best earlier chunk one level up: .8 for the same article and .2 for nearness, which ends at ``far`` chunks.

    The same article always outweighs nearness, and of equals the nearest wins, or the first where all are too far to tell: so the
    winner is the last or first of its article before the chunk, or else of all, which windows give without a join.
    """
    c = chunks(table(spark, sf, "documents")).select("doc_id", F.col("chunk_index").alias("i"), (F.length("text") % 7).alias("a"), F.when(F.length("text") < 60, 1).otherwise(2).alias("level"))
    parent = F.when(F.col("level") == 1, F.col("i"))

    def best(*by: str) -> Column:
        w = W.partitionBy(*by).orderBy("i").rowsBetween(W.unboundedPreceding, -1)
        last = F.last(parent, ignorenulls=True).over(w)
        return F.when(F.col("i") - last >= far, F.min(parent).over(w)).otherwise(last)

    c = c.withColumn("parent", F.coalesce(best("doc_id", "a"), best("doc_id")))
    return c.filter("level = 2 and parent is not null").select("doc_id", F.col("i").alias("chunk_index"), "parent")


@query("jn_14_siblings", "SELECT a.n_nationkey AS node, b.n_nationkey AS sibling FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def siblings(spark, sf) -> DataFrame:
    n = table(spark, sf, "nation").select("n_regionkey", F.col("n_nationkey").alias("node"))
    return n.join(n.withColumnRenamed("node", "sibling"), "n_regionkey").filter("node <> sibling").select("node", "sibling")


@query("jn_15_nearest_line", f"WITH {CHUNKS}, {WINDOWS}, j AS (SELECT w.doc_id, w.k, c.chunk_index, row_number() OVER (PARTITION BY w.doc_id, w.k ORDER BY abs(w.lo - c.chunk_index * 50), c.chunk_index) AS r FROM win w JOIN chunks c ON w.doc_id = c.doc_id) SELECT doc_id, k, chunk_index AS line FROM j WHERE r = 1")
def nearest_line(spark, sf) -> DataFrame:
    """The structure line nearest to each segment, a line counting for 50 characters: the last one before it or the first after it."""
    d = table(spark, sf, "documents")
    none = F.lit(None).cast("int")
    lines = chunks(d).select("doc_id", (F.col("chunk_index") * 50).alias("at"), none.alias("k"), F.col("chunk_index").alias("line"))
    marks = fixed_windows(d).select("doc_id", F.col("lo").alias("at"), "k", none.alias("line")).unionByName(lines)
    w = W.partitionBy("doc_id").orderBy("at", F.col("k").isNotNull())
    before = F.last("line", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    after = F.first("line", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    j = marks.select("doc_id", "k", "at", before.alias("b"), after.alias("a")).filter("k is not null")
    nearer = F.when(F.col("a").isNull() | (F.col("at") - F.col("b") * 50 <= F.col("a") * 50 - F.col("at")), F.col("b")).otherwise(F.col("a"))
    return j.select("doc_id", "k", F.coalesce(nearer, "b").alias("line")).filter("line is not null")


_OVERLAP = r"""q AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: length(w) > 3)) AS ws FROM benchmark),
qw AS (SELECT item_id, len(ws) AS n, unnest(ws) AS w FROM q), dw AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: length(w) > 3)) AS w FROM documents),
o AS (SELECT item_id, doc_id, n, count(*) AS k FROM qw JOIN dw USING (w) GROUP BY item_id, doc_id, n),
b AS (SELECT item_id, doc_id, round(k / n::DOUBLE, 6) AS overlap, row_number() OVER (PARTITION BY item_id ORDER BY k DESC, doc_id) AS r FROM o)"""


def overlap(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """claims(item_id, text), sources(doc_id, text): shared words of each pair that shares one, joined on the word."""
    q = claims.select("item_id", F.array_distinct(tokens(F.col("text"), 3)).alias("ws")).select("item_id", F.size("ws").alias("n"), F.explode("ws").alias("w"))
    d = sources.select("doc_id", F.explode(F.array_distinct(tokens(F.col("text"), 3))).alias("w"))
    return d.join(q, "w").groupBy("item_id", "doc_id", "n").agg(F.count("*").alias("k"))


def _best(spark, sf) -> DataFrame:
    o = overlap(table(spark, sf, "benchmark"), table(spark, sf, "documents"))
    best = o.groupBy("item_id").agg(F.min_by(F.struct("doc_id", "k", "n"), F.struct(-F.col("k"), "doc_id")).alias("b"))
    return best.select("item_id", "b.doc_id", r6(F.col("b.k") / F.col("b.n")).alias("overlap"))


@query("jn_16_citation_source", f"WITH {_OVERLAP} SELECT item_id, doc_id, overlap, overlap > 0.3 AS found FROM b WHERE r = 1")
def citation_source(spark, sf) -> DataFrame:
    """The source that shares most words with each citation, found above 0.3."""
    return _best(spark, sf).withColumn("found", F.col("overlap") > 0.3)


@query("jn_17_claim_support", f"WITH {_OVERLAP} SELECT count(*) AS claims, count(*) FILTER (overlap > 0.3) AS supported, round(avg(overlap), 6) AS mean_overlap FROM b WHERE r = 1")
def claim_support(spark, sf) -> DataFrame:
    return _best(spark, sf).agg(F.count("*").alias("claims"), F.count_if(F.col("overlap") > 0.3).alias("supported"), r6(F.avg("overlap")).alias("mean_overlap"))


@query("jn_19_definition_article", "SELECT d.doc_id, l.quality AS article FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.quality = 1 WHERE d.lang = 'en'")
def definition_article(spark, sf) -> DataFrame:
    l_ = table(spark, sf, "labels").filter("quality = 1").select("doc_id", F.col("quality").alias("article"))
    return table(spark, sf, "documents").filter("lang = 'en'").select("doc_id").join(l_, "doc_id", "left")


@query("jn_20_spatial_pairs", "WITH e AS (SELECT vec_id AS id, vec_id // 50 AS page, round(embedding[1]::DOUBLE, 4) AS x, round(embedding[2]::DOUBLE, 4) AS y FROM embeddings) SELECT a.id AS a, b.id AS b, CASE WHEN abs(a.x - b.x) < abs(a.y - b.y) THEN 'above_below' ELSE 'beside' END AS relation FROM e a JOIN e b ON a.page = b.page AND a.id < b.id AND abs(a.x - b.x) < 0.05 AND abs(a.y - b.y) < 0.05")
def spatial_pairs(spark, sf, near: float = 0.05) -> DataFrame:
    """Elements of a page (fifty vectors in a row stand for one) that lie close: joined by grid cell and neighbours."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 50).alias("page"), F.round(F.get("embedding", F.lit(0)).cast("double"), 4).alias("x"), F.round(F.get("embedding", F.lit(1)).cast("double"), 4).alias("y"))
    cx, cy = F.floor(F.col("x") / near), F.floor(F.col("y") / near)
    shift = F.array(*[F.struct((cx + i).alias("cx"), (cy + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = e.select("page", F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(shift).alias("c"))
    b = e.select("page", F.col("id").alias("b"), "x", "y", F.struct(cx.alias("cx"), cy.alias("cy")).alias("c"))
    dx, dy = F.abs(F.col("ax") - F.col("x")), F.abs(F.col("ay") - F.col("y"))
    j = a.join(b, ["page", "c"]).filter((F.col("a") < F.col("b")) & (dx < near) & (dy < near))
    return j.select("a", "b", F.when(dx < dy, "above_below").otherwise("beside").alias("relation"))


@query("jn_21_alias_reference", r"WITH a AS (SELECT list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: length(w) > 5)[1] AS alias, min(item_id) AS element FROM benchmark GROUP BY 1) SELECT doc_id, alias, element, CASE WHEN element % 2 = 0 THEN 'table' ELSE 'chart' END AS kind FROM documents JOIN a ON contains(lower(text), alias)")
def alias_reference(spark, sf) -> DataFrame:
    """Elements (items of the benchmark) that texts refer to by an alias, their first long word; of equal aliases the first counts."""
    known = table(spark, sf, "benchmark").select(F.get(tokens(F.col("text"), 5), F.lit(0)).alias("alias"), "item_id")
    known = known.filter("alias is not null").groupBy("alias").agg(F.min("item_id").alias("element"))
    found = find_terms(table(spark, sf, "documents"), ["doc_id"], F.lower("text"), known.select(F.col("alias").alias("term")))
    kind = F.when(F.col("element") % 2 == 0, "table").otherwise("chart")
    return found.withColumnRenamed("term", "alias").join(known, "alias").select("doc_id", "alias", "element", kind.alias("kind"))
