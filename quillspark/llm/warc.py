"""WARC archives: a writer with payload dedup (revisit records) and a sequential reader.

Archives hold one gzip member per record. The reader goes through a file once: it inflates member by member from fixed-size
reads, frames blocks by Content-Length, and verifies block and payload digests while the bytes pass, so its memory does not
depend on the size of a file, nor (without payloads) of a record.

Files go to a folder that all executors share, under names that hold the task attempt; the manifest (path, n_records) is a
table of Spark's, so it lists the files of attempts that succeeded only.

Defined cases: null html is the empty payload; a null page_id is written as ``null``, never keeps a payload for others and is
read back as null; pages that share a page_id and a payload are all responses if they are the keeper; an empty table gives no
archive; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import work

#: An archive is closed after so many bytes; the reader asks for so many at a time.
ARCHIVE_BYTES, READ_BYTES = 64 << 20, 64 << 10
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def judge(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, html, refers_to: of equal payloads of ``min_bytes`` or more, all but the
    largest page_id refer to it.

    Payloads are compared by digest in a table of ids; the pages themselves are dealt out by page_id and digest only, so a payload
    that very many pages share does not bring them together.
    """
    html = F.coalesce("html", F.lit(""))
    p = pages.select("page_id", "url", "html", F.sha1(html).alias("digest"))
    ids = p.filter(F.octet_length(html) >= min_bytes).select("page_id", "digest")
    keep = ids.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1 and keeper is not null").drop("n")
    again = ids.join(keep, "digest").filter(~F.col("page_id").eqNullSafe(F.col("keeper"))).select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "keeper").distinct()
    out = p.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    return out.select("page_id", "url", "html", F.col("keeper").alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(judged: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """judged(page_id, url, html, refers_to) -> the manifest, stored: path, n_records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}"
        store, root = fs.FileSystem.from_uri(folder)
        out, at, k, n, done = None, 0, 0, 0, []
        for b in batches:
            for page, url, html, refers in zip(*(b.column(i) for i in range(4)), strict=True):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out, at, n = store.open_output_stream(f"{root}/{name}-{k}.warc.gz", compression=None), 0, 0
                squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = squeeze.compress(record(page.as_py(), url.as_py(), (html.as_py() or "").encode(), refers.as_py())) + squeeze.flush()
                out.write(data)
                at, n = at + len(data), n + 1
                if at >= ARCHIVE_BYTES:
                    out.close()
                    done.append((f"{name}-{k}.warc.gz", n))
                    out, k = None, k + 1
        if out is not None:
            out.close()
            done.append((f"{name}-{k}.warc.gz", n))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([x for _, x in done], pa.int64())], ["path", "n_records"])

    cols = judged.select(F.col("page_id").cast("long"), "url", "html", F.col("refers_to").cast("long"))
    return work.cut(cols.mapInArrow(work.task(run), "path string, n_records long"), "warc-manifest")


class Member:
    """One gzip member of a stream, inflated as it is asked for."""

    def __init__(self, read, rest: bytes):
        self.read, self.rest, self.z, self.out = read, rest, zlib.decompressobj(31), bytearray()

    def fill(self, n: int) -> bool:
        """True once n bytes are there; False if the member ends before."""
        while len(self.out) < n and not self.z.eof:
            data = self.z.unconsumed_tail or self.rest or self.read(READ_BYTES)
            if not self.z.unconsumed_tail:
                self.rest = b""
            if not data:
                raise ValueError("archive ends inside a record")
            self.out += self.z.decompress(data, READ_BYTES)
        return len(self.out) >= n

    def take(self, n: int) -> bytes:
        data = bytes(self.out[:n])
        del self.out[:n]
        return data

    def line(self) -> bytes:
        while (at := self.out.find(b"\r\n")) < 0:
            if not self.fill(len(self.out) + 1):
                raise ValueError("a header line does not end")
        return self.take(at + 2)[:-2]

    def end(self) -> bytes:
        """Check that the member holds nothing more; what was read beyond it belongs to the next."""
        while not self.z.eof:
            if self.fill(len(self.out) + 1):
                break
        if self.out:
            raise ValueError("bytes after a record's end")
        return self.z.unused_data or self.rest


def records(read, payloads: bool = False) -> Iterator[dict]:
    """Records of an archive in order. read(n) gives up to n bytes, b'' at the end."""
    rest = b""
    while True:
        rest = rest or read(READ_BYTES)
        if not rest:
            return
        m = Member(read, rest)
        if not (version := m.line()).startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {version[:20]!r}")
        head: dict[str, str] = {}
        while line := m.line():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        left = int(head["content-length"])
        block, payload, length, kept, http, http_left = hashlib.sha1(), hashlib.sha1(), 0, [], b"", True
        while left:
            m.fill(min(left, READ_BYTES))
            data = m.take(min(left, READ_BYTES))
            if not data:
                raise ValueError("a block is shorter than its Content-Length")
            left -= len(data)
            block.update(data)
            if http_left:
                http += data
                if (at := http.find(b"\r\n\r\n")) < 0:
                    continue
                data, http, http_left = http[at + 4 :], http[:at], False
            payload.update(data)
            length += len(data)
            if payloads:
                kept.append(data)
        if not (m.fill(4) and m.take(4) == b"\r\n\r\n"):
            raise ValueError("a record does not end in two line ends")
        rest = m.end()
        told = head.get("warc-payload-digest", "").removeprefix("sha1:")
        revisit = head.get("warc-type") == "revisit"
        if revisit:
            fields = dict(x.lower().split(b": ", 1) for x in http.split(b"\r\n")[1:] if b": " in x)
            length, digest = int(fields[b"content-length"]), told
        else:
            digest = base64.b32encode(payload.digest()).decode()
        whole = head.get("warc-block-digest", "").removeprefix("sha1:") == base64.b32encode(block.digest()).decode()
        yield {"head": head, "length": length, "digest": digest, "valid": whole and digest == told, "payload": b"".join(kept) if payloads and not revisit else None}


def _page(uri: str | None) -> int | None:
    x = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(x) if x.lstrip("-").isdigit() else None


def read(manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """manifest(path) -> page_id, url, record_type, refers_to, payload_bytes, payload_digest, valid, payload (null unless asked for).

    Files are dealt out one to a partition as far as the session's partitions go; a broken record fails the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "valid", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{path}", compression=None) as f:
                    for r in records(f.read, payloads):
                        h = r["head"]
                        rows.append((_page(h.get("warc-record-id")), h.get("warc-target-uri"), h["warc-type"], _page(h.get("warc-refers-to")), r["length"], r["digest"], r["valid"], r["payload"]))
                        held += 200 + len(r["payload"] or b"")
                        if held > 8 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, valid boolean, payload binary"
    return manifest.select("path").repartition(work.tasks(manifest.sparkSession), "path").mapInArrow(work.task(run), schema)


def checked(records: DataFrame) -> DataFrame:
    """records as ``read`` gives them, those of revisits valid only if the response that they refer to is there, valid, and has the
    payload digest that they state."""
    there = records.filter("record_type = 'response'").groupBy(F.col("page_id").alias("p"), F.col("payload_digest").alias("d")).agg(F.bool_or("valid").alias("there"))
    out = records.join(there, (F.col("refers_to") == F.col("p")) & (F.col("payload_digest") == F.col("d")), "left")
    valid = F.col("valid") & ((F.col("record_type") != "revisit") | F.coalesce("there", F.lit(False)))
    return out.select(*[valid.alias(c) if c == "valid" else c for c in records.columns])


def archive(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, payloads: bool = False) -> DataFrame:
    """Write every page to archives in ``folder`` (default: a new one in the shared folder) and read them back, revisits checked."""
    folder = folder or work.new_path(pages.sparkSession, "warc")
    return checked(work.cut(read(write(judge(pages, min_bytes), folder), folder, payloads), "warc-records"))
