"""Property graph over nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.traversal import inner_edges, within
from quillspark.operators.traversal import traverse as walk
from quillspark.registry import query
from quillspark.sources.tables import new_folder, table


def nodes(spark, sf) -> DataFrame:
    """Regions, nations and customers: id, type, name."""
    r = table(spark, sf, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("id"), F.lit("Region").alias("type"), F.col("r_name").alias("name"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("N"), "n_nationkey"), F.lit("Nation"), "n_name")
    c = table(spark, sf, "customer").select(F.concat(F.lit("C"), "c_custkey"), F.lit("Customer"), "c_name")
    return r.union(n).union(c)


def edges(spark, sf) -> DataFrame:
    """Containment and orders: from_id, to_id, type."""
    n = table(spark, sf, "nation").select(F.concat(F.lit("R"), "n_regionkey").alias("from_id"), F.concat(F.lit("N"), "n_nationkey").alias("to_id"), F.lit("CONTAINS").alias("type"))
    c = table(spark, sf, "customer").select(F.concat(F.lit("N"), "c_nationkey"), F.concat(F.lit("C"), "c_custkey"), F.lit("CONTAINS"))
    o = table(spark, sf, "orders").select(F.concat(F.lit("C"), "o_custkey"), F.concat(F.lit("O"), "o_orderkey"), F.lit("ORDERED"))
    return n.union(c).union(o)


_E = "e AS (SELECT 'R' || n_regionkey AS f, 'N' || n_nationkey AS t, 'CONTAINS' AS type FROM nation UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey, 'CONTAINS' FROM customer UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey, 'ORDERED' FROM orders)"
_U = f"{_E}, u AS (SELECT f AS a, t AS b FROM e UNION SELECT t, f FROM e)"


def find_nodes(n: DataFrame, label: str, properties: dict[str, object]) -> DataFrame:
    """Nodes of a label that hold all of the given properties; of none, all of the label."""
    test = F.col("type") == label
    for name, value in properties.items():
        test = test & (F.col(name) == value)
    return n.filter(test)


@query("flt_09_node_lookup", "SELECT 'C' || c_custkey AS id, c_name AS name FROM customer WHERE c_custkey = 42 AND c_name = 'Customer#000000042'")
def node_lookup(spark, sf) -> DataFrame:
    """Nodes by label and property map; the tests are pushed into the branch of the label."""
    return find_nodes(nodes(spark, sf), "Customer", {"id": "C42", "name": "Customer#000000042"}).select("id", "name")


#: Levels of a document from coarse to fine, each with its letter and the value that names it (null where it has none).
DOCUMENT_LEVELS = [("Source", "S", "source"), ("Language", "L", "lang"), ("Shelf", "H", "CASE WHEN n_chars >= 1000 THEN CAST(n_chars // 10000 AS VARCHAR) END"), ("Box", "B", "CASE WHEN doc_id % 3 > 0 THEN CAST(n_chars // 1000 AS VARCHAR) END"), ("Document", "D", "CAST(doc_id AS VARCHAR)")]


def _levels_sql() -> str:
    out, path, parent = [], "''", "CAST(NULL AS VARCHAR)"
    for kind, letter, value in DOCUMENT_LEVELS:
        out.append(f"SELECT DISTINCT '{letter}:' || {path} || ({value}) AS id, '{kind}' AS type, {parent} AS parent FROM documents WHERE ({value}) IS NOT NULL")
        parent = f"CASE WHEN ({value}) IS NOT NULL THEN '{letter}:' || {path} || ({value}) ELSE {parent} END"
        path = f"{path} || coalesce({value}, '') || '/'"
    return " UNION ALL ".join(out)


@query("grf_01_document_nodes", _levels_sql())
def document_nodes(spark, sf) -> DataFrame:
    """One node a level from each document with the edge to its parent, the nearest ancestor that is there."""
    d = table(spark, sf, "documents")
    path, parent, made = F.lit(""), F.lit(None).cast("string"), []
    for kind, letter, value in DOCUMENT_LEVELS:
        v = F.expr(value.replace("VARCHAR", "STRING").replace("//", "DIV"))
        own = F.concat(F.lit(f"{letter}:"), path, v)
        made.append(F.struct(own.alias("id"), F.lit(kind).alias("type"), parent.alias("parent")))
        path, parent = F.concat(path, F.coalesce(v, F.lit("")), F.lit("/")), F.coalesce(own, parent)
    return d.select(F.inline(F.array(*made))).filter("id is not null").distinct()


def _walk(start: str, depth: int) -> str:
    return f"WITH RECURSIVE {_U}, w(id, d) AS (SELECT '{start}', 0 UNION SELECT u.b, w.d + 1 FROM w JOIN u ON u.a = w.id WHERE w.d < {depth}), m AS (SELECT id, min(d) AS distance FROM w GROUP BY id)"


@query("grf_02_one_hop", f"{_walk('N3', 1)} SELECT id, distance FROM m")
def one_hop(spark, sf) -> DataFrame:
    return within(edges(spark, sf), spark.createDataFrame([("N3",)], "id string"), 1)


def _paths(starts: str, depth: int, types: tuple[str, ...] = ()) -> str:
    """The same in DuckDB, all walks: start, id, distance, first_type, path."""
    kept = f"WHERE type IN ({', '.join(repr(t) for t in types)})" if types else ""
    return f"""WITH RECURSIVE {_E}, b AS (SELECT f AS a, t AS b, type FROM e {kept} UNION ALL SELECT t, f, type FROM e {kept}),
w(start, id, d, first_type, path) AS (SELECT id, id, 0, NULL::VARCHAR, [id] FROM ({starts}) UNION SELECT w.start, b.b, w.d + 1, coalesce(w.first_type, b.type), list_append(w.path, b.b) FROM w JOIN b ON b.a = w.id WHERE w.d < {depth} AND NOT list_contains(w.path, b.b)),
m AS (SELECT start, id, d AS distance, first_type, path FROM w QUALIFY row_number() OVER (PARTITION BY start, id ORDER BY d, path, first_type) = 1)"""


@query("grf_03_traverse", f"{_paths("SELECT 'C7' AS id", 3)}, r AS (SELECT count(*) AS relations FROM e WHERE f IN (SELECT id FROM m) AND t IN (SELECT id FROM m)) SELECT id, distance, first_type, array_to_string(path, '>') AS path, relations, (CASE WHEN relations > 0 THEN least(0.8 + 0.05 * relations, 1) ELSE 0.2 END)::DOUBLE AS confidence FROM m, r")
def traverse(spark, sf, start: str = "C7", depth: int = 3) -> DataFrame:
    """Nodes up to three steps away with their shortest path and the type that it begins with, the number of relations between them,
    and the confidence that this number gives."""
    e = edges(spark, sf)
    f = walk(e, spark.createDataFrame([(start,)], "id string"), depth)
    n = F.count("*")
    known = inner_edges(e, f).agg(n.alias("relations"), F.when(n > 0, F.least(0.8 + 0.05 * n, F.lit(1.0))).otherwise(0.2).alias("confidence"))
    return f.select("id", "distance", "first_type", F.array_join("path", ">").alias("path")).join(F.broadcast(known))


@query("grf_04_related", f"{_walk('R1', 2)} SELECT id, distance FROM m WHERE distance > 0 ORDER BY distance, id LIMIT 20")
def related(spark, sf, k: int = 20) -> DataFrame:
    f = within(edges(spark, sf), spark.createDataFrame([("R1",)], "id string"), 2)
    return f.filter("distance > 0").orderBy("distance", "id").limit(k)


_PATH_STARTS = "SELECT 'R' || r_regionkey AS id FROM region UNION ALL SELECT 'C' || c_custkey FROM customer WHERE c_acctbal > 9900"


@query("jn_18_path_join", f"{_paths(_PATH_STARTS, 2, ('CONTAINS',))} SELECT start, id, distance, first_type, array_to_string(path, '>') AS path FROM m WHERE distance > 0")
def path_join(spark, sf, types: tuple[str, ...] = ("CONTAINS",)) -> DataFrame:
    """Paths of one or two containment relations from every region and every rich customer at once."""
    r = table(spark, sf, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("id"))
    c = table(spark, sf, "customer").filter("c_acctbal > 9900").select(F.concat(F.lit("C"), "c_custkey").alias("id"))
    found = walk(edges(spark, sf), r.unionByName(c), 2, types).filter("distance > 0")
    return found.select("start", "id", "distance", "first_type", F.array_join("path", ">").alias("path"))


def graph_bonus(related: DataFrame) -> DataFrame:
    """related(key, distance, is_reference) -> key, bonus of at most 0.15."""
    part = lambda n, each: F.least(F.lit(0.05), each * n)
    return related.groupBy("key").agg(F.round(part(F.count("*"), 0.01) + part(F.count_if(F.col("distance") == 1), 0.025) + part(F.count_if("is_reference"), 0.03), 6).alias("bonus"))


_BONUS = "b AS (SELECT o_custkey AS key, round(least(0.05, 0.01 * count(*)) + least(0.05, 0.025 * count(*) FILTER (o_orderkey % 3 = 1)) + least(0.05, 0.03 * count(*) FILTER (o_orderstatus = 'F')), 6)::DOUBLE AS bonus FROM orders GROUP BY o_custkey)"


@query("grf_05_bonus", f"WITH {_BONUS} SELECT key, bonus FROM b")
def bonus(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), (F.col("o_orderkey") % 3).alias("distance"), (F.col("o_orderstatus") == "F").alias("is_reference"))
    return graph_bonus(o)


@query("grf_06_enrich", f"WITH {_BONUS} SELECT c_custkey, round(least(c_acctbal / 10000, 1) + coalesce(bonus, 0), 6) AS final FROM customer LEFT JOIN b ON c_custkey = key ORDER BY 2 DESC, c_custkey LIMIT 50")
def enrich(spark, sf) -> DataFrame:
    """Results re-sorted by their score and the graph's bonus."""
    j = table(spark, sf, "customer").select("c_custkey", "c_acctbal").join(bonus(spark, sf).withColumnRenamed("key", "c_custkey"), "c_custkey", "left")
    final = F.round(F.least(F.col("c_acctbal") / 10000, F.lit(1.0)) + F.coalesce("bonus", F.lit(0.0)), 6)
    return j.select("c_custkey", final.alias("final")).orderBy(F.desc("final"), "c_custkey").limit(50)


@query("grf_07_definition_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), '11 x') OR contains(lower(p_type), '11 x') OR contains(lower(p_name), '117') OR contains(lower(p_type), '117')")
def definition_search(spark, sf, term: str = "11 x", words=("117",)) -> DataFrame:
    """Entries of which any field holds the term or any of its words longer than two characters."""
    tests = [F.contains(F.lower(c), F.lit(w)) for c in ("p_name", "p_type") for w in (term, *words)]
    hit = tests[0]
    for t in tests[1:]:
        hit = hit | t
    return table(spark, sf, "part").filter(hit).select("p_partkey", "p_name")


@query("grf_08_constraint_type", r"WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+ ?(?:%|days|EUR)?')) AS v FROM documents) SELECT doc_id, v AS value, CASE WHEN contains(v, '%') THEN 'percentage' WHEN contains(v, 'days') THEN 'temporal' WHEN contains(v, 'EUR') THEN 'monetary' ELSE 'number' END AS kind FROM m")
def constraint_type(spark, sf) -> DataFrame:
    v = F.col("value")
    m = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]+ ?(?:%|days|EUR)?"), 0)).alias("value"))
    return m.withColumn("kind", F.when(v.contains("%"), "percentage").when(v.contains("days"), "temporal").when(v.contains("EUR"), "monetary").otherwise("number"))


@query("grf_09_clear", "SELECT 'R' || r_regionkey AS id FROM region WHERE false")
def clear(spark, sf) -> DataFrame:
    """A stored graph overwritten with nothing: its schema stays."""
    path = new_folder(spark, "graph")
    n = nodes(spark, sf).select("id")
    n.write.parquet(path)
    spark.createDataFrame([], n.schema).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
