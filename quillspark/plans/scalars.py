"""Scalar functions over strings, dates, numbers, arrays, maps and JSON, each shown on a column of the corpus tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import WORD, cosine, jaccard, r6, tokens, words
from quillspark.plans.relational import nearest_to_one
from quillspark.functions.numbers import amount, spelled
from quillspark.registry import query
from quillspark.sources.tables import table

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


#: Rewrites in their order: join words around a hyphen and a line end by a space; join lines in mid-sentence; drop a hyphen that
#: starts a line; join the parts of a hyphenated word; squeeze blanks; none before punctuation or after an opening bracket; at most
#: two line ends.
REWRITES = [
    (r"([\p{L}\p{N}_]+)[ \t\r\f\n]*-[ \t\r\f\n]*\n[ \t\r\f\n]*([\p{L}\p{N}_])", "\\1 \\2"),
    (r"(\p{Ll}+)[ \t\r\f\n]*\n[ \t\r\f\n]*(\p{Ll}\p{Ll}+)", "\\1 \\2"),
    (r"\n[ \t\r\f\n]*-[ \t\r\f\n]+([\p{L}\p{N}_])", " \\1"),
    (r"(\p{Ll}+)-[ \t\r\f\n]*\n[ \t\r\f\n]*(\p{Ll}+)", "\\1\\2"),
    (r"[ \t]+", " "),
    (r"[ \t\r\f\n]+([,.;:!?)])", "\\1"),
    (r"[(][ \t\r\f\n]+", "("),
    (r"\n{3,}", "\n\n"),
]


#: The same for Java where a rewrite would try every start in a word or a run of blanks: the character before is looked back at, and must
#: not be of the match before, which has consumed it (``\\G``); runs are taken whole.
LINEAR = {
    0: (r"(?=[ \t\r\f\n-])(?<=[\p{L}\p{N}_])(?!\G)[ \t\r\f\n]*+-[ \t\r\f]*+\n[ \t\r\f\n]*+([\p{L}\p{N}_])", " \\1"),
    1: (r"(?=[ \t\r\f\n])(?<=\p{Ll})(?!\G)[ \t\r\f]*+\n[ \t\r\f\n]*+(\p{Ll}\p{Ll}+)", " \\1"),
    2: (r"(?<![ \t\r\f\n])([ \t\r\f]*+)\n[ \t\r\f\n]*+-[ \t\r\f\n]++([\p{L}\p{N}_])", "\\1 \\2"),
    3: (r"(?=-)(?<=\p{Ll})(?!\G)-[ \t\r\f]*+\n[ \t\r\f\n]*+(\p{Ll}+)", "\\1"),
    5: (r"(?<![ \t\r\f\n])[ \t\r\f\n]++([,.;:!?)])", "\\1"),
}


def normalize(text: Column) -> Column:
    """The ordered rewrites, and lines stripped."""
    for i, rewrite in enumerate(REWRITES):
        pattern, instead = LINEAR.get(i, rewrite)
        text = F.regexp_replace(text, pattern, instead.replace("\\1", "$1").replace("\\2", "$2"))
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), "\n")


def _rewritten(text: str) -> str:
    for pattern, instead in REWRITES:
        text = f"regexp_replace({text}, '{pattern}', E'{instead.replace(chr(92), chr(92) * 2).replace(chr(10), chr(92) + 'n')}', 'g')"
    return text


_NORMAL = f"array_to_string(list_transform(string_split({_rewritten('text')}, chr(10)), lambda x: trim(x)), chr(10))"


@query("str_01_normalize", f"SELECT doc_id, md5({_NORMAL}) AS digest FROM documents")
def normalize_query(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(normalize(F.col("text"))).alias("digest"))


def normalize_term(term: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(term), r"\s+", " "))


@query("str_02_contains_term", r"SELECT doc_id, contains(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), 'of the') AS found FROM documents")
def contains_term(spark, sf, term: str = "of  The") -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.contains(normalize_term(F.col("text")), normalize_term(F.lit(term))).alias("found"))


def context(text: Column, term: str, around: int = 100) -> Column:
    """The characters around the first hit, with dots where the text goes on."""
    at = F.locate(term, F.lower(text)) - 1
    lo, hi = F.greatest(at - around, F.lit(0)), F.least(at + len(term) + around, F.length(text))
    cut = F.concat(F.when(lo > 0, "...").otherwise(""), F.substring(text, lo + 1, hi - lo), F.when(hi < F.length(text), "...").otherwise(""))
    return F.when(at >= 0, cut)


@query("str_03_context", "WITH a AS (SELECT doc_id, text, strpos(lower(text), 'license') - 1 AS at_ FROM documents), b AS (SELECT *, greatest(at_ - 100, 0) AS lo, least(at_ + 107, length(text)) AS hi FROM a) SELECT doc_id, CASE WHEN at_ >= 0 THEN CASE WHEN lo > 0 THEN '...' ELSE '' END || substr(text, lo + 1, hi - lo) || CASE WHEN hi < length(text) THEN '...' ELSE '' END END AS context FROM b")
def context_query(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", context(F.col("text"), "license").alias("context"))


#: References that stay one token, with what joins their parts: a law's number, an article with and without a part. A point within a
#: reference is put aside as a private character while marks are dropped.
_POINT = "\ue000"
REFERENCE_TOKENS = [
    (r"([0-9]+)(-?) ?(фз|act)", r"\1\2\3"), (r"(статья|article|section|version)\s+([0-9]+)[.]([0-9]+)", rf"\1_\2{_POINT}\3"), (r"(статья|article|section|version)\s+([0-9]+)", r"\1_\2"),
]


def protected_tokens(text: Column, phrases: list[str]) -> Column:
    """Lower-cased white-space tokens longer than two, without marks; phrases, law numbers and articles stay one token each."""
    t = F.lower(text)
    for p in phrases:
        t = F.replace(t, F.lit(p), F.lit(p.replace(" ", "_")))
    for p, r in REFERENCE_TOKENS:
        t = F.regexp_replace(t, p, re.sub(r"\\([0-9])", r"$\1", r))
    long_ = F.filter(F.split(t, r"\s+"), lambda w: F.length(w) > 2)
    clean = F.transform(long_, lambda w: F.replace(F.regexp_replace(w, rf"[^\p{{L}}\p{{N}}_{_POINT}-]", ""), F.lit(_POINT), F.lit(".")))
    return F.filter(clean, lambda w: w != "")


_PROTECTED = "replace(replace(lower(text), 'public license', 'public_license'), 'of the', 'of_the')"
for _p, _r in REFERENCE_TOKENS:
    _PROTECTED = f"regexp_replace({_PROTECTED}, '{_p}', '{_r}', 'g')"


@query("str_04_tokenizer", rf"SELECT doc_id, array_to_string(list_filter(list_transform(list_filter(regexp_split_to_array({_PROTECTED}, '\s+'), lambda w: length(w) > 2), lambda w: replace(regexp_replace(w, '[^\p{{L}}\p{{N}}_{_POINT}-]', '', 'g'), '{_POINT}', '.')), lambda w: w <> ''), ' ') AS tokens FROM documents")
def tokenizer(spark, sf) -> DataFrame:
    t = protected_tokens(F.col("text"), ["public license", "of the"])
    return table(spark, sf, "documents").select("doc_id", F.array_join(t, " ").alias("tokens"))


STOP, SPECIAL = ["the", "and", "for", "that", "with", "der", "die", "und", "los", "las", "les"], ["license", "version", "public"]


def keywords(text: Column, n: int = 10) -> Column:
    """Words longer than two but stop words, special terms first (the last met first), at most ten."""
    w = F.filter(tokens(text), lambda x: ~x.isin(*STOP))
    special = F.filter(w, lambda x: x.isin(*SPECIAL))
    return F.slice(F.concat(F.reverse(special), F.filter(w, lambda x: ~x.isin(*SPECIAL))), 1, n)


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


@query("str_05_keywords", f"WITH w AS (SELECT item_id, list_filter({_WORDS}, lambda x: length(x) > 2 AND x NOT IN {_in(STOP)}) AS ws FROM benchmark) SELECT item_id, array_to_string(list_slice(list_concat(list_reverse(list_filter(ws, lambda x: x IN {_in(SPECIAL)})), list_filter(ws, lambda x: x NOT IN {_in(SPECIAL)})), 1, 10), ' ') AS keywords FROM w")
def keywords_query(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", F.array_join(keywords(F.col("text")), " ").alias("keywords"))


#: Kinds of numbers: with a percent sign or word, years, days, magnitudes, plain; and of references, matched on lower case.
NUMBERS = [r"[0-9]+(?:[.,][0-9]+)? *%", r"[0-9]+(?:[.,][0-9]+)? *percent[a-z]*", r"[0-9]+ *years?", r"[0-9]+ *days?", r"[0-9]+(?:[.,][0-9]+)? *(?:thousand|million|billion)", r"[0-9]+(?:[.,][0-9]+)?"]
REFERENCES = [r"article +[0-9]+(?:[.][0-9]+)?", r"point +[0-9]+", r"part +[0-9]+", r"version +[0-9]+(?:[.][0-9]+)*", r"general public license", r"licen[cs]e"]


def _all(patterns: list[str]) -> str:
    return "list_concat(" + ", ".join(f"regexp_extract_all(lower(text), '{p}')" for p in patterns) + ")"


@query("str_06_numbers", f"SELECT doc_id, array_to_string(list_sort(list_distinct({_all(NUMBERS)})), ' ') AS numbers FROM documents")
def numbers(spark, sf) -> DataFrame:
    """Distinct numbers of all kinds, in order."""
    found = F.concat(*[F.regexp_extract_all(F.lower("text"), F.lit(p), 0) for p in NUMBERS])
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(F.array_distinct(found)), " ").alias("numbers"))


@query("str_07_references", f"SELECT doc_id, array_to_string({_all(REFERENCES)}, ' ') AS refs FROM documents")
def references(spark, sf) -> DataFrame:
    """References of all kinds, kind by kind in the order of the text."""
    found = F.concat(*[F.regexp_extract_all(F.lower("text"), F.lit(p), 0) for p in REFERENCES])
    return table(spark, sf, "documents").select("doc_id", F.array_join(found, " ").alias("refs"))


@query("str_08_law_numbers", r"SELECT doc_id, coalesce(nullif(regexp_extract(text, '[Vv]ersion ([0-9]+)', 1), ''), nullif(regexp_extract(text, '([0-9]+)\.0', 1), '')) AS number FROM documents")
def law_numbers(spark, sf) -> DataFrame:
    found = [F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for p in (r"[Vv]ersion ([0-9]+)", r"([0-9]+)\.0")]
    return table(spark, sf, "documents").select("doc_id", F.coalesce(*found).alias("number"))


SYNONYMS = [("license", "permit"), ("license", "licence"), ("public", "open"), ("version", "release")]
#: Abbreviations with what they stand for.
ABBREVIATIONS = [("gnu", "gnu is not unix"), ("cc", "creative commons"), ("mit", "massachusetts institute of technology")]
_SYN = ", ".join(f"('{a}', '{b}')" for a, b in SYNONYMS + ABBREVIATIONS)


@query("str_09_synonyms", f"WITH s(term, other) AS (VALUES {_SYN}), t AS (SELECT doc_id, lower(text) AS q FROM documents) SELECT doc_id, text AS variant FROM documents UNION SELECT doc_id, replace(q, term, other) FROM t JOIN s ON contains(q, term)")
def synonyms(spark, sf, pairs: list[tuple[str, str]] = SYNONYMS + ABBREVIATIONS) -> DataFrame:
    """The text, and a variant for each synonym of a term and each meaning of an abbreviation that occurs, all distinct; the
    dictionary is a literal of fixed size."""
    known = F.array(*[F.struct(F.lit(a).alias("term"), F.lit(b).alias("other")) for a, b in pairs])
    d = table(spark, sf, "documents").select("doc_id", "text", F.lower("text").alias("q"))
    made = F.transform(F.filter(known, lambda x: F.contains(F.col("q"), x["term"])), lambda x: F.replace(F.col("q"), x["term"], x["other"]))
    return d.select("doc_id", F.explode(F.concat(F.array("text"), F.coalesce(made, F.array().cast("array<string>")))).alias("variant")).distinct()


@query("str_10_query_variants", r"WITH q AS (SELECT item_id, lower(trim(text)) AS q, array_to_string(list_slice(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: length(w) > 5), 1, 5), ' ') AS k FROM benchmark), v AS (SELECT item_id, 0 AS n, q AS variant FROM q UNION ALL SELECT item_id, 1, q || ' in law' FROM q UNION ALL SELECT item_id, 2, CASE WHEN starts_with(q, 'the') THEN 'what is ' || q WHEN starts_with(q, 'a') THEN 'explain ' || q END FROM q UNION ALL SELECT item_id, 3, nullif(k, '') FROM q) SELECT item_id, n, variant FROM v WHERE variant IS NOT NULL")
def query_variants(spark, sf) -> DataFrame:
    """A query, one with context, the first fitting reformulation only, and its key terms."""
    q = normalized = F.lower(F.trim("text"))
    reform = F.when(F.startswith(q, F.lit("the")), F.concat(F.lit("what is "), normalized)).when(F.startswith(q, F.lit("a")), F.concat(F.lit("explain "), normalized))
    key = F.nullif(F.array_join(F.slice(tokens(F.col("text"), 5), 1, 5), " "), F.lit(""))
    v = table(spark, sf, "benchmark").select("item_id", F.posexplode(F.array(q, F.concat(q, F.lit(" in law")), reform, key)).alias("n", "variant"))
    return v.filter("variant is not null")


#: What a prompt must not say, fixed patterns.
INJECTIONS = [
    r"(?i)ignore\s+(all\s+)?previous\s+instructions?", r"(?i)forget\s+(all\s+)?previous\s+(instructions?|context)", r"(?i)you\s+are\s+now\s+a", r"(?i)system\s*prompt",
    r"(?i)reveal\s+(your|the)\s+(system|hidden|secret)", r"(?i)override\s+(system|instructions?|safety)", r"(?i)disregard\s+(all|any|the)\s+(above|previous|prior)",
    r"(?i)new\s+instructions?:\s*", r"(?i)<\s*/?\s*system\s*>", r"(?i)\[\s*SYSTEM\s*\]",
]


@query("str_11_sanitize", "SELECT conv_id, turn, md5(" + "regexp_replace(" * (len(INJECTIONS) + 1) + r"substr(text, 1, 5000), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')" + "".join(f", '{p}', '[removed]', 'g')" for p in INJECTIONS) + ") AS digest FROM conversations")
def sanitize(spark, sf, longest: int = 5000) -> DataFrame:
    """A question cut at the length that a prompt takes, without control characters and with injections replaced."""
    t = F.regexp_replace(F.substring("text", 1, longest), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    for p in INJECTIONS:
        t = F.regexp_replace(t, p, "[removed]")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(t).alias("digest"))


PII = [(r"https?://[^ \n]+", "[url]"), (r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}", "[card]"), (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "[mail]")]


@query("str_12_pii", "SELECT doc_id, md5(" + "regexp_replace(" * len(PII) + "text" + "".join(f", '{p}', '{r}', 'g')" for p, r in PII) + ") AS digest FROM documents")
def pii(spark, sf) -> DataFrame:
    t = F.col("text")
    for p, r in PII:
        t = F.regexp_replace(t, p, r)
    return table(spark, sf, "documents").select("doc_id", F.md5(t).alias("digest"))


@query("str_13_law_reference", "SELECT doc_id, concat_ws(', ', CASE WHEN source IS NOT NULL THEN 'source ' || source END, CASE WHEN doc_id % 2 = 0 THEN 'art. ' || doc_id END, lang) AS ref FROM documents")
def law_reference(spark, sf) -> DataFrame:
    d = F.col("doc_id")
    ref = F.concat_ws(", ", F.concat(F.lit("source "), "source"), F.when(d % 2 == 0, F.concat(F.lit("art. "), d)), "lang")
    return table(spark, sf, "documents").select("doc_id", ref.alias("ref"))


@query("str_14_file_size", "SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN CAST(n_chars // 1024 AS VARCHAR) || '.' || CAST((n_chars % 1024) * 10 // 1024 AS VARCHAR) || ' KB' ELSE CAST(n_chars // 1048576 AS VARCHAR) || ' MB' END AS size, CAST(greatest(ceil(n_chars / 4000.0), 1) AS BIGINT) AS messages FROM documents")
def file_size(spark, sf) -> DataFrame:
    """Size for people, and the messages of 4000 characters that a text takes."""
    n = F.col("n_chars")
    kb = F.concat(F.floor(n / 1024), F.lit("."), F.floor((n % 1024) * 10 / 1024), F.lit(" KB"))
    size = F.when(n < 1024, F.concat(n, F.lit(" B"))).when(n < 1048576, kb).otherwise(F.concat(F.floor(n / 1048576), F.lit(" MB")))
    return table(spark, sf, "documents").select("doc_id", size.alias("size"), F.greatest(F.ceil(n / 4000.0), F.lit(1).cast("long")).alias("messages"))


@query("str_15_density", rf"WITH w AS (SELECT doc_id, text, {_WORDS} AS ws FROM documents) SELECT doc_id, round(len(list_filter(ws, lambda x: x IN {_in(SPECIAL)})) / greatest(len(ws), 1)::DOUBLE, 6) AS density, len(regexp_extract_all(text, '[0-9]+\.[0-9]+')) AS citations, contains(lower(text), 'issue') AND contains(lower(text), 'rule') AS structured FROM w")
def density(spark, sf) -> DataFrame:
    w, low = words(F.col("text")), F.lower("text")
    share = F.size(F.filter(w, lambda x: x.isin(*SPECIAL))) / F.greatest(F.size(w), F.lit(1))
    return table(spark, sf, "documents").select("doc_id", r6(share).alias("density"), F.regexp_count("text", F.lit(r"[0-9]+\.[0-9]+")).cast("long").alias("citations"), (low.contains("issue") & low.contains("rule")).alias("structured"))


@query("str_16_response_quality", "SELECT conv_id, turn, greatest(0, 100 - CASE WHEN length(text) < 50 THEN 30 ELSE 0 END - CASE WHEN NOT regexp_matches(text, '[0-9]') THEN 20 ELSE 0 END - CASE WHEN contains(text, '?') THEN 10 ELSE 0 END - CASE WHEN length(text) > 2000 THEN 15 ELSE 0 END) AS score FROM conversations WHERE role = 'assistant'")
def response_quality(spark, sf) -> DataFrame:
    t = F.col("text")
    rules = [(F.length(t) < 50, 30), (~t.rlike("[0-9]"), 20), (t.contains("?"), 10), (F.length(t) > 2000, 15)]
    score = F.lit(100)
    for test, cost in rules:
        score = score - F.when(test, cost).otherwise(0)
    return table(spark, sf, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.greatest(score, F.lit(0)).alias("score"))


@query("str_17_key_points", "WITH p AS (SELECT conv_id, turn, list_slice(list_filter(list_transform(string_split(text, '.'), lambda x: trim(x)), lambda x: length(x) > 10), 1, CASE role WHEN 'system' THEN 5 WHEN 'assistant' THEN 3 ELSE 2 END) AS ps FROM conversations) SELECT conv_id, turn, array_to_string(ps, ' | ') AS points FROM p")
def key_points(spark, sf) -> DataFrame:
    """First sentences longer than ten characters, more of them for more important roles."""
    n = F.when(F.col("role") == "system", 5).when(F.col("role") == "assistant", 3).otherwise(2)
    p = F.filter(F.transform(F.split("text", r"\."), lambda x: F.trim(x)), lambda x: F.length(x) > 10)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(F.slice(p, F.lit(1), n), " | ").alias("points"))


@query("str_18_semantic_hash", r"SELECT conv_id, turn, substr(md5(regexp_replace(lower(trim(text)), '[^\p{L}\p{N}_\s]', '', 'g')), 1, 16) AS hash FROM conversations")
def semantic_hash(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.substring(F.md5(F.regexp_replace(F.lower(F.trim("text")), r"[^\p{L}\p{N}_\s]", "")), 1, 16).alias("hash"))


#: Formats of dates in the order in which they are tried; fixed values.
DATE_FORMATS = ["yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy", "yyyy/MM/dd", "dd-MM-yyyy"]


def parse_date(text: Column) -> Column:
    return F.coalesce(*[F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in DATE_FORMATS])


@query("dat_01_parse", "WITH s AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 3 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 4 THEN strftime(o_orderdate, '%d-%m-%Y') ELSE 'none' END AS s FROM orders) SELECT o_orderkey, strftime(coalesce(try_strptime(s, '%Y-%m-%d'), try_strptime(s, '%d.%m.%Y'), try_strptime(s, '%d/%m/%Y'), try_strptime(s, '%Y/%m/%d'), try_strptime(s, '%d-%m-%Y')), '%Y-%m-%d') AS day FROM s")
def parse_dates(spark, sf) -> DataFrame:
    k = F.col("o_orderkey") % 6
    s = F.lit("none")
    for i, f in enumerate(DATE_FORMATS):
        s = F.when(k == i, F.date_format("o_orderdate", f)).otherwise(s)
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(parse_date(s), "yyyy-MM-dd").alias("day"))


_AGE = "datediff('day', CAST(o_orderdate AS DATE), DATE '1998-12-31')"


def _age(as_of: str = "1998-12-31") -> Column:
    return F.datediff(F.lit(as_of).cast("date"), F.col("o_orderdate").cast("date"))


def recency_a(age: Column, most: float = 0.1) -> Column:
    """The bonus of an age in days, falling in steps; the steps of this and the next query are fixed values."""
    return F.when(age <= 30, most).when(age <= 365, most * (1 - age / 365) * 0.8).when(age <= 1095, 0.02).otherwise(0.0)


@query("dat_02_recency", f"WITH a AS (SELECT o_orderkey, {_AGE} AS age FROM orders) SELECT o_orderkey, round(CASE WHEN age <= 30 THEN 0.1 WHEN age <= 365 THEN 0.1 * (1 - age / 365.0::DOUBLE) * 0.8 WHEN age <= 1095 THEN 0.02 ELSE 0 END, 6)::DOUBLE AS bonus FROM a")
def recency(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", r6(recency_a(_age())).alias("bonus"))


@query("dat_03_recency_steps", f"WITH a AS (SELECT o_orderkey, {_AGE} AS age FROM orders) SELECT o_orderkey, (CASE WHEN age < 30 THEN 0.15 WHEN age < 90 THEN 0.10 WHEN age < 365 THEN 0.05 WHEN age < 1825 THEN 0.02 ELSE 0 END)::DOUBLE AS bonus FROM a")
def recency_steps(spark, sf) -> DataFrame:
    age = _age()
    return table(spark, sf, "orders").select("o_orderkey", F.when(age < 30, 0.15).when(age < 90, 0.10).when(age < 365, 0.05).when(age < 1825, 0.02).otherwise(0.0).alias("bonus"))


@query("dat_04_duration", "WITH u AS (SELECT event_id, event_id % 40 AS n, ['year', 'month', 'day'][1 + event_id % 3] AS unit FROM events) SELECT event_id, (n * CASE unit WHEN 'year' THEN 365 WHEN 'month' THEN 30 ELSE 1 END)::DOUBLE AS days FROM u")
def duration(spark, sf) -> DataFrame:
    """Days of a duration: a year counts 365, a month 30."""
    e = F.col("event_id")
    unit = F.element_at(F.array(F.lit(365), F.lit(30), F.lit(1)), (e % 3 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", (e % 40 * unit).cast("double").alias("days"))


@query("mth_01_sigmoid_blend", "SELECT event_id, round(0.6 / (1 + exp(-(value / 50 - 1))) + 0.4 * (value / 100), 6) AS score FROM events")
def sigmoid_blend(spark, sf) -> DataFrame:
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", r6(0.6 / (1 + F.exp(-(v / 50 - 1))) + 0.4 * (v / 100)).alias("score"))


@query("mth_02_cosine", "SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q")
def cosine_query(spark, sf) -> DataFrame:
    return nearest_to_one(spark, sf).select("vec_id", "similarity")


@query("mth_03_jaccard", rf"WITH c AS (SELECT conv_id, turn, list_distinct({_WORDS}) AS ws, lead(list_distinct({_WORDS})) OVER (PARTITION BY conv_id ORDER BY turn) AS ns FROM conversations) SELECT conv_id, turn, round(len(list_intersect(ws, ns)) / greatest(len(list_distinct(list_concat(ws, ns))), 1)::DOUBLE, 6) AS jaccard FROM c WHERE ns IS NOT NULL")
def jaccard_query(spark, sf) -> DataFrame:
    """Word overlap of each message with the next."""
    from pyspark.sql import Window as W

    c = table(spark, sf, "conversations").select("conv_id", "turn", words(F.col("text")).alias("ws"))
    c = c.withColumn("ns", F.lead("ws").over(W.partitionBy("conv_id").orderBy("turn"))).filter("ns is not null")
    return c.select("conv_id", "turn", r6(jaccard(F.col("ws"), F.col("ns"))).alias("jaccard"))


MAGNITUDES = {"thousand": 1e3, "million": 1e6, "billion": 1e9}


@query("mth_04_magnitude", "WITH m AS (SELECT event_id, round(value, 2) AS v, ['thousand', 'million', 'billion', ''][1 + event_id % 4] AS unit FROM events) SELECT event_id, v * CASE unit WHEN 'thousand' THEN 1000.0::DOUBLE WHEN 'million' THEN 1000000.0::DOUBLE WHEN 'billion' THEN 1000000000.0::DOUBLE ELSE 1 END AS amount FROM m")
def magnitude(spark, sf) -> DataFrame:
    e = F.col("event_id")
    unit = F.element_at(F.array(*map(F.lit, [*MAGNITUDES, ""])), (e % 4 + 1).cast("int"))
    factor = F.coalesce(*[F.when(unit == k, F.lit(v)) for k, v in MAGNITUDES.items()], F.lit(1.0))
    return table(spark, sf, "events").select("event_id", (F.round("value", 2) * factor).alias("amount"))


@query("mth_04_number_words", "SELECT event_id, ((event_id * 7919 + CAST(round(value * 1000000) AS BIGINT)) % 1000000000)::DOUBLE AS amount, event_id % 3 = 0 AS share FROM events")
def number_words(spark, sf) -> DataFrame:
    """Numbers below a thousand million, written out in words within a sentence and read again, some of them as percentages."""
    e = table(spark, sf, "events")
    n = (F.col("event_id") * 7919 + F.round(F.col("value") * 1000000).cast("long")) % 1000000000
    text = F.concat(F.lit("No more than "), F.array_join(spelled(n), " "), F.when(F.col("event_id") % 3 == 0, " percent").otherwise(" days"))
    return e.select("event_id", amount(text).alias("a")).select("event_id", F.col("a.value").alias("amount"), F.col("a.share").alias("share"))


@query("arr_01_codec", r"WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM benchmark) SELECT item_id, array_to_string(ws, '|') AS piped, to_json(ws)::VARCHAR AS js, len(string_split(array_to_string(ws, '|'), '|')) AS n FROM w")
def codec(spark, sf) -> DataFrame:
    """Arrays as pipe-joined text and as JSON, and read back."""
    b = table(spark, sf, "benchmark").select("item_id", words(F.col("text")).alias("ws"))
    piped = F.concat_ws("|", "ws")
    return b.select("item_id", piped.alias("piped"), F.to_json("ws").alias("js"), F.size(F.split(piped, r"\|")).cast("long").alias("n"))


@query("arr_02_fenced_json", """WITH f AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '```json' || chr(10) || props || chr(10) || '```' ELSE props END AS s FROM events) SELECT event_id, json_extract_string(coalesce(nullif(regexp_extract(s, '(?s)```(?:json)?\\s*(.*?)\\s*```', 1), ''), s), '$.k') AS k FROM f""")
def fenced_json(spark, sf) -> DataFrame:
    """JSON from model output, whether fenced or plain; null if it does not parse."""
    s = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.col("props"))
    inner = F.coalesce(F.nullif(F.regexp_extract(s, r"(?s)```(?:json)?\s*(.*?)\s*```", 1), F.lit("")), s)
    return table(spark, sf, "events").select("event_id", F.try_variant_get(F.try_parse_json(inner), "$.k", "string").alias("k"))


@query("map_01_overlay", "SELECT doc_id, lang AS lang, CASE WHEN doc_id % 2 = 0 THEN 'override' ELSE source END AS source FROM documents")
def overlay(spark, sf) -> DataFrame:
    """Two maps as one, the right one winning."""
    base = F.create_map(F.lit("lang"), "lang", F.lit("source"), "source")
    extra = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("source"), F.lit("override"))).otherwise(F.create_map().cast("map<string,string>"))
    kept = F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(extra, k)), extra)
    return table(spark, sf, "documents").select("doc_id", kept["lang"].alias("lang"), kept["source"].alias("source"))
