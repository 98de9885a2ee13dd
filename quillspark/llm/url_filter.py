"""URL filter by listed rules: a blocked Bloom filter ahead of an exact hash join, in DataFrame functions only.

A rule is a canonical key ``host + path`` with a verdict. It fits its host and all subdomains when the url's path starts with
the rule's path; the longest fitting rule decides. The filter holds the rules' hosts and their whole keys. A url's host suffixes (by
the label counts listed) are tried first, one 256-bit block each; those that pass are expanded to candidate keys (path prefixes by
the lengths listed), which are tried in turn. All that happens where the page is read: only survivors are shuffled, to an exact
join on the key, which removes the false positives.

Defined cases: a null url or one without ``://`` has empty host and path and fits no rule; empty tables give empty results;
repeated rows are all judged; extra columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits a listed key gets in the filter, and keys a 256-bit block holds at that density.
BITS_PER_KEY, BLOCK_BITS, WORDS = 16, 256, 8
#: Blocks of a filter at most (about 100 bytes each in a broadcast table); with more keys than that asks for, it lets more through.
MAX_BLOCKS = 1 << 20
#: Exact rule tables up to this many rows may be broadcast.
BROADCAST_RULES = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or where ``://`` is missing."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    """One bit in each of the block's eight 32-bit words, from a second hash of the key."""
    h = F.xxhash64(F.lit("bits"), key)
    return [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(h, 5 * w).bitwiseAND(F.lit(31)).cast("int")) for w in range(WORDS)]


def build_filter(rules: DataFrame, n_rules: int) -> tuple[DataFrame, int]:
    """rules(key) -> (block, w0..w7) and the number of blocks: bits are or-ed by block in one aggregation."""
    n_blocks = 1
    while n_blocks * BLOCK_BITS < n_rules * BITS_PER_KEY and n_blocks < MAX_BLOCKS:
        n_blocks *= 2
    bits = rules.select(_block(F.col("key"), n_blocks).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits(F.col("key")))])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]), n_blocks


def probe(rows: DataFrame, key: Column, bloom: DataFrame, n_blocks: int) -> DataFrame:
    """Rows whose key the filter may hold, by a broadcast join: none is shuffled."""
    names = rows.columns
    passed = rows.withColumn("key_", key).withColumn("block", _block(F.col("key_"), n_blocks)).join(F.broadcast(bloom), "block")
    for i, b in enumerate(_bits(F.col("key_"))):
        passed = passed.filter(F.col(f"w{i}").bitwiseAND(b) == b)
    return passed.select(*names)


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages(page_id, url), rules(host, path, verdict) -> page_id, host, path, rule, verdict.

    ``default`` is the verdict where no rule fits. Repeated rules collapse; of equal keys with both verdicts, block wins.
    """
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").filter("host is not null and path is not null")
    listed = rules.groupBy("host", "path").agg(F.max(F.struct(F.col("verdict") == "block", "verdict"))["verdict"].alias("verdict"))
    listed = listed.select("host", "path", "verdict", F.concat("host", "path").alias("key"))
    # Bounded by the lengths that hosts and paths of urls can have, not by the number of rules.
    shape = listed.agg(
        F.count("*").alias("n"),
        F.sort_array(F.collect_set(F.size(F.split("host", r"\.")))).alias("labels"),
        F.sort_array(F.collect_set(F.length("path"))).alias("lengths"),
    ).first()
    host, path = split_url(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    if not shape["n"]:
        return judged.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    host_key, whole_key = F.concat(F.lit("host "), F.col("suffix")), F.concat("suffix", "prefix")
    held = listed.select(F.explode(F.array("key", F.concat(F.lit("host "), "host"))).alias("key")).distinct()
    bloom, n_blocks = build_filter(held, 2 * shape["n"])
    suffixes = F.array(*[F.when(F.size(F.split("host", r"\.")) >= n, F.substring_index("host", ".", -n)) for n in shape["labels"]])
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in shape["lengths"]])
    tried = judged.select("host", "path", F.explode(suffixes).alias("suffix")).filter("suffix is not null")
    tried = probe(tried, host_key, bloom, n_blocks)
    tried = tried.withColumn("prefix", F.explode(prefixes)).filter("prefix is not null")
    passed = probe(tried, whole_key, bloom, n_blocks).distinct()
    exact = listed.select("key", F.col("host").alias("suffix"), F.col("path").alias("prefix"), "verdict")
    exact = F.broadcast(exact) if shape["n"] <= BROADCAST_RULES else exact
    hits = passed.join(exact, ["suffix", "prefix"])
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("key", "verdict"), F.struct(F.length("key"), F.length("suffix"))).alias("best"))
    return judged.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


#: The rules of the registered query.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")
