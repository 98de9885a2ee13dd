"""File sources, shown on contents made from the corpus tables; ``read_files`` takes any binaryFile scan."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.registry import query
from quillspark.sources.formats import read_files, repair_name, rtf_column
from quillspark.sources.tables import table


@query("src_01_dispatch", "SELECT 'd' || doc_id || '.txt' AS path, text FROM documents")
def dispatch(spark, sf) -> DataFrame:
    """Files by extension to text."""
    d = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id", F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return read_files(d).select("path", "text")


def _made(spark, rows: list[tuple[str, bytes]]) -> DataFrame:
    return spark.createDataFrame([(p, bytearray(b)) for p, b in rows], "path string, content binary")


def _zip(files: dict[str, str]) -> bytes:
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, t in files.items():
            z.writestr(n, t)
    return out.getvalue()


@query("src_02_docx")
def docx(spark, sf) -> DataFrame:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>One line.</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    return read_files(_made(spark, [("a.docx", _zip({"word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>"}))]))


@query("src_03_doc")
def doc(spark, sf) -> DataFrame:
    return read_files(_made(spark, [("a.doc", b"\xd0\xcf\x11\xe0 old")]))


@query("src_04_rtf", r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace('{\rtf1\b ' || text || '\par end}', '\\par[d]?\b ?', chr(10), 'g'), '\\[a-zA-Z]+-?[0-9]* ?', '', 'g'), '[{}]', '', 'g')) AS text FROM documents")
def rtf(spark, sf) -> DataFrame:
    t = F.concat(F.lit("{\\rtf1\\b "), "text", F.lit("\\par end}"))
    return table(spark, sf, "documents").select("doc_id", rtf_column(t).alias("text"))


@query("src_05_csv_text", "SELECT 'c_custkey | c_name' AS header, string_agg(c_custkey || ' | ' || c_name, chr(10) ORDER BY c_custkey) AS body FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 100)")
def csv_text(spark, sf, rows: int = 100) -> DataFrame:
    """A table as text: header and its first hundred rows."""
    c = table(spark, sf, "customer").orderBy("c_custkey").limit(rows).select("c_custkey", F.concat_ws(" | ", "c_custkey", "c_name").alias("line"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", "line"))), lambda x: x["line"]), "\n")
    return c.agg(F.lit("c_custkey | c_name").alias("header"), body.alias("body"))


@query("src_06_xlsx")
def xlsx(spark, sf) -> DataFrame:
    sheet = '<worksheet><sheetData><row><c t="s"><v>0</v></c><c><v>1</v></c></row></sheetData></worksheet>'
    return read_files(_made(spark, [("a.xlsx", _zip({"xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>", "xl/worksheets/sheet1.xml": sheet}))]))


@query("src_07_pdf")
def pdf(spark, sf) -> DataFrame:
    return read_files(_made(spark, [("a.pdf", b"%PDF-1.4\n1 0 obj\nstream\nBT (Page one) Tj ET\nendstream\nendobj")]))


@query("src_08_archive")
def archive(spark, sf) -> DataFrame:
    return read_files(_made(spark, [("a.zip", _zip({"x.txt": "inside", "y.bin": "?"}))]))


@query("src_09_name_repair")
def name_repair(spark, sf) -> DataFrame:
    """File names that were read in the wrong charset."""
    broken = [(n, n.encode("utf-8").decode("cp437")) for n in ("закон.txt", "straße.txt", "plain.txt")]

    def run(batches):
        for pdf in batches:
            yield pdf.assign(repaired=pdf["broken"].map(repair_name))[["name", "repaired"]]

    return spark.createDataFrame(broken, "name string, broken string").mapInPandas(run, "name string, repaired string")


_FIELDS = "max_chunks bigint, similarity_threshold double, max_chunk_length bigint, chunk_size bigint, chunk_overlap bigint, enable_reranking boolean, boost_exact_matches boolean, metadata_weight double, adaptive_threshold boolean, min_similarity double, max_similarity double, enable_cache boolean, cache_ttl bigint"
#: Retrieval configurations that ship with the engine, in the order of the fields; fixed values.
CONFIGS = {
    "conservative": (5, 0.7, 1000, 1000, 200, False, True, 0.1, False, 0.5, 0.9, True, 300, "high quality, fewer results"),
    "balanced": (7, 0.65, 1200, 1000, 250, True, True, 0.15, False, 0.5, 0.9, True, 300, "between quality and coverage"),
    "aggressive": (10, 0.6, 1500, 800, 300, True, True, 0.2, False, 0.5, 0.9, True, 300, "most coverage"),
    "adaptive": (8, 0.65, 1200, 1000, 200, True, True, 0.15, True, 0.5, 0.8, True, 300, "thresholds set as results come in"),
    "optimal": (15, 0.6, 1000, 1000, 200, True, True, 0.25, False, 0.5, 0.9, True, 300, "hard questions with filters"),
}
_NAMES = [*(f.split()[0] for f in _FIELDS.split(", ")), "description"]


@query("src_14_configs", "SELECT * FROM (VALUES " + ", ".join("('" + n + "', " + ", ".join(f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{v}::DOUBLE" if isinstance(v, float) else f"{v}::BIGINT" for v in c) + ")" for n, c in CONFIGS.items()) + f") t(name, {', '.join(_NAMES)})")
def configs(spark, sf) -> DataFrame:
    """Named configurations from a JSON map to rows."""
    one = spark.createDataFrame([(json.dumps({n: dict(zip(_NAMES, c, strict=True)) for n, c in CONFIGS.items()}),)], "js string")
    kind = "map<string, struct<" + (_FIELDS + ", description string").replace(" ", ": ").replace(",: ", ", ") + ">>"
    return one.select(F.explode(F.from_json("js", kind)).alias("name", "c")).select("name", "c.*")
