"""Text from file contents, by extension: functions of bytes, and their use on the columns of Spark's binaryFile source.

Office files are read from their XML with the standard library; PDF text from its content streams. What needs a missing tool
(rar, 7z, scanned pages, old binary documents) gives a placeholder that says so.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Charsets in the order in which they are tried, and limits of rows; fixed values.
CHARSETS = ("utf-8", "cp1251", "latin-1", "iso-8859-1")
CSV_ROWS, SHEET_ROWS = 100, 50
KINDS = ("txt", "csv", "rtf", "docx", "doc", "xlsx", "xls", "pdf")


def decode(data: bytes) -> str:
    for c in CHARSETS:
        try:
            return data.decode(c)
        except UnicodeDecodeError:
            pass
    return data.decode("utf-8", "replace")


def csv_text(data: bytes) -> str:
    rows = list(csv.reader(io.StringIO(decode(data))))
    return "\n".join(" | ".join(r) for r in rows[: CSV_ROWS + 1])


def rtf_text(data: bytes) -> str:
    t = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), data.decode("latin-1"))
    t = re.sub(r"\\par[d]?\b ?", "\n", t)
    return re.sub(r"[{}]", "", re.sub(r"\\[a-zA-Z]+-?\d* ?", "", t)).strip()


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def docx_text(data: bytes) -> str:
    """Paragraphs and tables in body order; headings get ``## ``."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))[0]
    out = []
    for e in body:
        if _local(e.tag) == "p":
            text = "".join(x.text or "" for x in e.iter() if _local(x.tag) == "t")
            style = next((v for x in e.iter() if _local(x.tag) == "pStyle" for v in x.attrib.values()), "")
            if text:
                out.append(f"## {text}" if style.lower().startswith("heading") else text)
        elif _local(e.tag) == "tbl":
            rows = [" | ".join("".join(t.text or "" for t in c.iter() if _local(t.tag) == "t") for c in r if _local(c.tag) == "tc") for r in e if _local(r.tag) == "tr"]
            out += ["[TABLE]", *rows, "[/TABLE]"]
    return "\n".join(out)


def xlsx_text(data: bytes) -> str:
    """Every non-empty sheet, its first rows."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter() if _local(t.tag) == "t") for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        out = []
        for n in sorted((x for x in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", x)), key=lambda x: int(re.sub(r"\D", "", x.rpartition("/")[2]))):
            lines = []
            for r in [x for x in ElementTree.fromstring(z.read(n)).iter() if _local(x.tag) == "row"][:SHEET_ROWS]:
                cells = []
                for c in r:
                    v = next((x.text or "" for x in c.iter() if _local(x.tag) in ("v", "t")), "")
                    cells.append(shared[int(v)] if c.attrib.get("t") == "s" and v else v)
                lines.append(" | ".join(cells))
            if any(x.strip(" |") for x in lines):
                out += [f"[SHEET {n.rpartition('/')[2][:-4]}]", *lines]
    return "\n".join(out)


def pdf_text(data: bytes) -> str:
    """Text shown by the content streams, a line for each text object; strings in brackets or in hexadecimal digits."""
    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        raw = m[1]
        try:
            raw = zlib.decompress(raw)
        except zlib.error:
            pass
        for block in re.findall(rb"BT(.*?)ET", raw, re.S):
            shown = [
                bytes.fromhex((h.decode() + "0")[: (len(h) + 1) // 2 * 2]) if h else re.sub(rb"\\([()\\])", rb"\1", s)
                for s, h in re.findall(rb"\(((?:\\.|[^\\()])*)\)|<([0-9A-Fa-f]+)>", block)
            ]
            if line := b"".join(shown).decode("latin-1").strip():
                out.append(line)
    return "\n".join(out)


def extract(path: str, data: bytes) -> str:
    """Text of one file; an unknown extension is an error."""
    kind = path.rpartition(".")[2].lower()
    if kind not in KINDS:
        raise ValueError(f"no reader for .{kind}")
    if kind == "doc" or kind == "xls":
        return f"[{kind.upper()} document, {len(data)} bytes: no converter available]"
    return {"txt": decode, "csv": csv_text, "rtf": rtf_text, "docx": docx_text, "xlsx": xlsx_text, "pdf": pdf_text}[kind](data)


def members(path: str, data: bytes) -> list[tuple[str, bytes]]:
    """Files of a zip archive, names repaired; other archives are not opened."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [(repair_name(i.filename) if not i.flag_bits & 0x800 else i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]


def repair_name(name: str) -> str:
    """A name that a zip reader took for cp437, in the first charset that fits and gives letters."""
    try:
        raw = name.encode("cp437")
    except UnicodeEncodeError:
        return name
    for c in ("utf-8", "cp1251", "cp866", "koi8-r", "iso-8859-5", "latin1"):
        try:
            return raw.decode(c)
        except UnicodeDecodeError:
            pass
    return name


def read_files(files: DataFrame) -> DataFrame:
    """files(path, content) as of the binaryFile source -> path, text, error. Zip archives give a row for each member."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    inner = members(path, data) if path.lower().endswith(".zip") else [(None, data)]
                except zipfile.BadZipFile as e:
                    rows.append((path, None, str(e)))
                    continue
                for name, content in inner:
                    full = path if name is None else f"{path}!{name}"
                    try:
                        rows.append((full, extract(full, bytes(content)), None))
                    except Exception as e:  # noqa: BLE001 - one bad file must not fail the batch
                        rows.append((full, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")


def rtf_column(text: Column) -> Column:
    """The fallback reader of RTF as an expression: control words, then braces, then outer blanks."""
    t = F.regexp_replace(text, r"\\par[d]?\b ?", "\n")
    t = F.regexp_replace(t, r"\\[a-zA-Z]+-?[0-9]* ?", "")
    return F.trim(F.regexp_replace(t, r"[{}]", ""))
