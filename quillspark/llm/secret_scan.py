"""Secret scans by a worklist of decoded layers: nested URL, Unicode, base64 and compressed layers are unwrapped until nothing new
comes, every layer is scanned with the same patterns, and what is found is mapped back to code points of the original text.

A layer is a text with the place of each of its characters in the original. The original is the first; each layer adds

* itself with percent escapes decoded, and itself with Unicode escapes decoded (backslash u, U and x, and numeric entities);
* the content of each run of base64 in it, in either alphabet, at whichever of the four alignments gives text, lines joined;
* the content of compressed data (gzip, zlib, bz2, xz, zstd) that base64 or percent escapes carry.

Decoding by escapes and base64 shrinks a text, so it ends by itself. Decompression may not: its results are told by their digest and
their place, and one met before is not opened again, so data that unpacks to itself ends too. What unpacks is scanned in blocks, cut
at characters that no pattern or escape spans, so memory is bounded by a block and not by what a bomb unpacks to, unless that is a
single token. A find within an escape or a base64 run maps to the characters that carry it, one in compressed data to the whole run.

Patterns are applied to each kind from left to right without overlaps, and matches that are too short are dropped afterwards; finds
of the original text always stay and are marked as base. A text is one row, so nothing is shuffled.

Defined cases: a null text is empty and has no finds; null doc_ids and repeated rows are scanned like others, a row each; broken
base64, escapes or streams are left as they stand, and what came before the break counts; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import work

#: Kinds in the order in which they are listed; their patterns and least lengths are fixed values.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]{12,}"), re.compile(r"[0-9a-f]{32,}")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_VALUE = 8

#: Characters that a run of base64 has at least, bytes of plain text that make its content worth a layer, bytes of a block.
LEAST_RUN, LEAST_TEXT, BLOCK = 20, 8, 1 << 20
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_PACKED = re.compile(r"(?:%1[fF]%8[bB]|(?:%78|x)%(?:01|5[eE]|9[cC]|[dD][aA])|BZh[1-9]1AY%26SY|%[fF][dD]7zXZ%00|%28%[bB]5%2[fF]%[fF][dD])(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~!*'()/-])*")
_ESCAPE = re.compile(r"\\+u\{([0-9A-Fa-f]{1,6})\}|\\+u([0-9A-Fa-f]{4})|\\+U([0-9A-Fa-f]{8})|\\+x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});|%u([0-9A-Fa-f]{4})")
_RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST_RUN},}}={{0,2}}(?:\r?\n[A-Za-z0-9+/]{{{LEAST_RUN},}}={{0,2}})*(?:\r?\n[A-Za-z0-9+/]{{2,}}={{0,2}}(?![A-Za-z0-9+/]))?")
_PARTS = [re.compile(rf"{c}{{{LEAST_RUN},}}") for c in ("[A-Za-z0-9+/]", "[A-Za-z0-9_-]", "[A-Za-z0-9]")]
_PLAIN = re.compile(rb"[\t\n\r\x20-\x7e]{%d}|(?:[\t\n\r\x20-\x7e]\0){%d}" % (LEAST_TEXT, LEAST_TEXT))
#: Bytes at which unpacked data may be cut: no pattern, escape or run of base64 holds them.
_CUTS = b"\0\t,()<>?!|*[]$@^`"
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\0|\x28\xb5\x2f\xfd")

Span = tuple[int, int]


def base_finds(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns in a text as it stands."""
    out = []
    low = text.lower()  # ASCII letters stay where they are or not, which matters to the pattern, not to this test
    if any(w in low for w in _WORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


class Whole:
    """All of a layer stands for one span."""

    def __init__(self, start: int, end: int):
        self.at = (start, end)

    def span(self, a: int, b: int) -> Span:
        return self.at

    def of(self, inner: Place) -> Place:
        return self


class Same:
    """A layer that is the original."""

    def span(self, a: int, b: int) -> Span:
        return a, b

    def of(self, inner: Place) -> Place:
        return inner


class Each:
    """Every character of a layer has a span of its own."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray):
        self.starts, self.ends = starts, ends

    def span(self, a: int, b: int) -> Span:
        return int(self.starts[a]), int(self.ends[b - 1])

    def of(self, inner: Place) -> Place:
        if isinstance(inner, Whole):
            return Whole(*self.span(*inner.at))
        return Each(self.starts[inner.starts], self.ends[inner.ends - 1])


Place = Whole | Same | Each


@dataclass
class Layer:
    text: str
    place: Place
    chain: tuple[str, ...] = ()


def _text(data: bytes) -> str:
    return data.decode("utf-8", "surrogateescape")


def _char_bytes(text: str) -> np.ndarray:
    """First byte of each character in the bytes that ``_text`` was given, and their end."""
    sizes = np.ones(len(text), np.int64) if text.isascii() else np.fromiter((len(c.encode("utf-8", "surrogateescape")) for c in text), np.int64, len(text))
    return np.concatenate([[0], np.cumsum(sizes)])


def _replaced(text: str, parts: list[tuple[int, int, str, np.ndarray]]) -> Layer | None:
    """text with (start, end, content, bounds) put in; bounds: where each character of the content starts and the last ends."""
    if not parts:
        return None
    out, starts, ends, at = [], [], [], 0
    for a, b, content, bounds in [*parts, (len(text), len(text), "", np.zeros(1, np.int64))]:
        gap = np.arange(at, a)
        out += [text[at:a], content]
        starts += [gap, bounds[:-1]]
        ends += [gap + 1, bounds[1:]]
        at = b
    return Layer("".join(out), Each(np.concatenate(starts), np.concatenate(ends)))


def percent_decoded(text: str) -> Layer | None:
    parts = []
    for m in _PERCENT.finditer(text):
        content = _text(bytes.fromhex(m[0].replace("%", "")))
        parts.append((*m.span(), content, m.start() + 3 * _char_bytes(content)))
    return _replaced(text, parts)


def unicode_decoded(text: str) -> Layer | None:
    parts: list[tuple[int, int, str, np.ndarray]] = []
    high: tuple[int, int, int] | None = None  # the first half of a pair
    for m in _ESCAPE.finditer(text):
        a, b = m.span()
        code = int(m[6]) if m[6] else int(next(g for g in m.groups() if g), 16)
        if high and high[1] == a and 0xDC00 <= code < 0xE000:
            a, code = high[0], 0x10000 + ((high[2] - 0xD800) << 10) + code - 0xDC00
        high = (a, b, code) if 0xD800 <= code < 0xDC00 else None
        if code <= 0x10FFFF and not 0xD800 <= code < 0xE000:
            parts.append((a, b, chr(code), np.array([a, b])))
    return _replaced(text, parts)


def _unpacked(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """The content of compressed data, piece by piece, up to its end or a break."""
    first = next(blocks, b"")
    first_kind = first[:1]
    try:
        if first_kind == b"B":
            d = bz2.BZ2Decompressor()
        elif first_kind == b"\xfd":
            d = lzma.LZMADecompressor()
        elif first_kind == b"\x28":
            d = zstandard.ZstdDecompressor().decompressobj()
        else:
            d = zlib.decompressobj(47)
        while first:
            if isinstance(d, (bz2.BZ2Decompressor, lzma.LZMADecompressor)):
                yield d.decompress(first, BLOCK)
                while not d.needs_input and not d.eof:
                    yield d.decompress(b"", BLOCK)
            elif first_kind == b"\x28":
                for i in range(0, len(first), 1 << 12):  # a small part at a time, as this kind has no bound on what comes out
                    if not d.eof:
                        yield d.decompress(first[i : i + (1 << 12)])
            else:
                yield d.decompress(first, BLOCK)
                while d.unconsumed_tail:
                    yield d.decompress(d.unconsumed_tail, BLOCK)
            rest = d.unused_data if getattr(d, "eof", False) else b""
            if rest and _MAGIC.match(rest) and rest[:2] == b"\x1f\x8b":  # a further member
                d, first = zlib.decompressobj(47), rest
                continue
            first = b"" if getattr(d, "eof", False) else next(blocks, b"")
    except (OSError, ValueError, EOFError, zlib.error, lzma.LZMAError, zstandard.ZstdError):
        return


def _joined(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """Blocks of about ``BLOCK`` bytes, cut where no token goes on."""
    held = bytearray()
    for b in blocks:
        held += b
        if len(held) >= BLOCK:
            cut = max(held.rfind(bytes([c])) for c in _CUTS)
            if cut > 0:
                yield bytes(held[:cut])
                del held[:cut]
    if held:
        yield bytes(held)


def unpacked_layers(data: bytes, place: Whole, chain: tuple[str, ...], seen: set) -> Iterator[Layer]:
    """The layers of compressed data, packed again as often as it may be."""
    open_: Callable[[], Iterator[bytes]] = lambda: iter([data])
    while True:
        digest = hashlib.sha256()
        for b in open_():
            digest.update(b)
        key = (digest.digest(), place.at)
        if key in seen:
            return
        seen.add(key)
        chain = (*chain, "compressed")
        inner = lambda made=open_: (b for b in _unpacked(made()) if b)
        head = next(inner(), b"")
        if not _MAGIC.match(head):
            for block in _joined(inner()):
                yield Layer(_text(block), place, chain)
            return
        open_ = inner


def _content(run: str, at: np.ndarray) -> tuple[bytes, np.ndarray] | None:
    """(bytes, bounds) of base64 at the alignment that gives compressed data or most plain text; at: places of the characters."""
    best: tuple[int, bytes, int] | None = None
    for skip in range(4):
        body = run[skip:].rstrip("=")
        body = body[: len(body) - (len(body) % 4 == 1)]
        if len(body) < LEAST_RUN - 3:
            break
        data = base64.b64decode(body + "=" * (-len(body) % 4), altchars=b"-_") if "-" in body or "_" in body else base64.b64decode(body + "=" * (-len(body) % 4))
        worth = 1 << 40 if _MAGIC.match(data) else LEAST_TEXT * len(_PLAIN.findall(data))
        if worth and (best is None or worth > best[0]):
            best = (worth, data, skip)
    if best is None:
        return None
    _, data, skip = best
    k = np.arange(len(data) + 1)
    starts = at[np.minimum(skip + k * 8 // 6, len(at) - 1)]
    ends = at[np.minimum(skip + (k * 8 + 7) // 6, len(at) - 1)] + 1
    return data, np.stack([starts, ends])


def base64_contents(text: str) -> Iterator[tuple[bytes, np.ndarray, Span]]:
    """(bytes, (starts, ends) of each, span) of the runs of base64 in a text."""
    for m in _RUN.finditer(text):
        open_: set[Span] = set()
        for a, b in [m.span(), *[(m.start() + p.start(), m.start() + p.end()) for r in _PARTS for p in r.finditer(m[0])]]:
            if any(x <= a and b <= y for x, y in open_):
                continue
            at = np.array([i for i in range(a, b) if text[i] not in "\r\n="], np.int64) if "\n" in text[a:b] else np.arange(a, b)
            run = text[a:b].replace("\r", "").replace("\n", "")
            run = run.replace("=", "") if "=" in run.rstrip("=") else run
            found = _content(run.replace("+", "-").replace("/", "_"), at) if len(at) else None
            if found:
                open_.add((a, b))
                yield found[0], found[1], (a, b)


def _children(layer: Layer, seen: set) -> Iterator[Layer]:
    text, place, chain = layer.text, layer.place, layer.chain
    if "%" in text and (made := percent_decoded(text)):
        yield Layer(made.text, place.of(made.place), (*chain, "url"))
        for m in _PACKED.finditer(text):
            data = unquote_to_bytes(m[0])
            yield from unpacked_layers(data, Whole(*place.span(*m.span())), (*chain, "url"), seen)
    if ("\\" in text or "&#" in text or "%u" in text) and (made := unicode_decoded(text)):
        yield Layer(made.text, place.of(made.place), (*chain, "unicode"))
    for data, bounds, (a, b) in base64_contents(text):
        if _MAGIC.match(data):
            yield from unpacked_layers(data, Whole(*place.span(a, b)), (*chain, "base64"), seen)
        content = _text(data)
        if len(data) > 3 and not any(data[1::2]):
            content, first = data[: len(data) // 2 * 2].decode("utf-16-le", "replace"), 2 * np.arange(len(data) // 2 + 1)
        else:
            first = _char_bytes(content)
        if len(content) == len(first) - 1 and content:
            yield Layer(content, place.of(Each(bounds[0][first[:-1]], bounds[1][first[1:] - 1])), (*chain, "base64"))


def find(text: str) -> list[tuple[str, int, int, str, bool]]:
    """(kind, start, end, layer, base) of all finds in a text and its layers, by start, kind and end; layer: what was unwrapped."""
    found: dict[tuple[str, int, int], tuple[str, bool]] = {x: ("", True) for x in base_finds(text)}
    todo, seen = deque([Layer(text, Same())]), set()
    while todo:
        for made in _children(todo.popleft(), seen):
            key = (hashlib.sha256(made.text.encode("utf-8", "surrogatepass")).digest(), made.place.span(0, len(made.text)) if made.text else (0, 0))
            if key in seen:
                continue
            seen.add(key)
            for kind, a, b in base_finds(made.text):
                found.setdefault((kind, *made.place.span(a, b)), (">".join(made.chain), False))
            todo.append(made)
    return sorted(((*k, *v) for k, v in found.items()), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


FINDS = "array<struct<kind:string,start:long,end:long,layer:string,base:boolean>>"


def scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, finds: kind, start and end in code points of the text, the layers unwrapped, and whether it is base."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, ends = [], [0]
            for text in b.column(1):
                rows += find(text.as_py() or "")
                ends.append(len(rows))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            flat = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["kind", "start", "end", "layer", "base"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["doc_id", "finds"])

    work.small_batches(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work.task(run), f"doc_id {kind}, finds {FINDS}")


def listed(finds: Column) -> Column:
    """kind:start:end of each find, comma-joined."""
    return F.array_join(F.transform(finds, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """scan() -> doc_id, counts of base finds by kind, base_sha256, spans, n_decoded (finds that only a layer shows)."""
    base = F.filter("finds", lambda x: x["base"])
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("finds")).alias("spans"), F.size(F.filter("finds", lambda x: ~x["base"])).cast("long").alias("n_decoded"))
