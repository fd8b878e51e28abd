"""Secret scans through nested encodings (operator 11).

Each text is the first layer of a worklist. Percent and Unicode escapes of a layer's lines are
undone, base64 runs are decoded and decompressed; what comes out are further layers, which are scanned and
unwrapped in their turn until nothing new appears. A layer carries the place in the original text
of each of its characters, so what is found in it is reported where it stands in the document. Spark
deals out the documents; none needs another one, so nothing is shuffled.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import html
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

#: The contract's kinds in order, their forms and shortest lengths (fixed values).
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
SHORTEST_VALUE = 6
#: A text with none of these, in lower case, has no assignment.
NAMES = ("passw", "secret", "token", "apikey", "api_key")

#: One escape or more: percent bytes, \xHH bytes, UTF-16 units, code points, HTML references.
ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+|(?:\\x[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
#: What may be base64, in either alphabet.
BLOB = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: First bytes of compressed streams (fixed values).
MAGIC = {b"\x1f\x8b\x08": "gzip", b"\x78\x01": "zlib", b"\x78\x5e": "zlib", b"\x78\x9c": "zlib", b"\x78\xda": "zlib", b"BZh": "bzip2", b"\xfd7zXZ\x00": "xz", b"\x28\xb5\x2f\xfd": "zstd"}
#: Bytes that one compressed layer may unfold to; a longer one is left packed and reported.
LARGEST = 64 << 20

FOUND = "array<struct<kind:string,start:int,end:int,value:string,path:string>>"


def spans_of(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the forms in one layer; per kind leftmost and without overlaps, failing matches dropped."""
    low = text.lower()
    if any(n in low for n in NAMES):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= SHORTEST_VALUE:
                yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


def _of_bytes(raw: bytes, width: int) -> list[tuple[str, int]] | None:
    """Characters of UTF-8 bytes that took ``width`` characters each, and how many those took; None if they are no UTF-8."""
    try:
        return [(c, width * len(c.encode())) for c in raw.decode()]
    except UnicodeDecodeError:
        return None


def _undone(escape: str) -> list[tuple[str, int]]:
    """The characters that one match of ``ESCAPES`` stands for, each with the number of characters that it took.

    Bytes that are no UTF-8 become characters one by one if they are ASCII and stay as they are if not.
    """
    if escape[0] == "&":
        c = html.unescape(escape)
        return [(c, len(escape))] if len(c) == 1 else [(x, 1) for x in escape]
    if escape[0] == "%" or escape[1] == "x":
        width = 3 if escape[0] == "%" else 4
        parts = [escape[k : k + width] for k in range(0, len(escape), width)]
        raw = bytes(int(p[-2:], 16) for p in parts)
        whole = _of_bytes(raw, width)
        if whole is not None:
            return whole
        return [x for p, b in zip(parts, raw, strict=True) for x in ([(chr(b), width)] if b < 128 else [(c, 1) for c in p])]
    if escape[1] == "U" or escape[2] == "{":
        code = int(escape[2:].strip("{}"), 16)
        return [(chr(code), len(escape))] if code < 0x110000 and not 0xD800 <= code < 0xE000 else [(x, 1) for x in escape]
    out: list[tuple[str, int]] = []
    units = [int(escape[k + 2 : k + 6], 16) for k in range(0, len(escape), 6)]
    k = 0
    while k < len(units):
        u = units[k]
        if 0xD800 <= u < 0xDC00 and k + 1 < len(units) and 0xDC00 <= units[k + 1] < 0xE000:
            out.append((chr(0x10000 + ((u - 0xD800) << 10) + units[k + 1] - 0xDC00), 12))
            k += 2
            continue
        out += [(x, 1) for x in escape[6 * k : 6 * k + 6]] if 0xD800 <= u < 0xE000 else [(chr(u), 6)]
        k += 1
    return out


class Layer:
    """A decoded text, the original start and end of each of its characters, and how it came about."""

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray, path: tuple[str, ...]):
        self.text, self.starts, self.ends, self.path = text, starts, ends, path

    def place(self, a: int, z: int) -> tuple[int, int]:
        """The span of the original text from which the characters from a to z came."""
        return int(self.starts[a]), int(self.ends[z - 1])


def _without_escapes(layer: Layer) -> Iterator[Layer]:
    """One layer for each line that holds escapes, with all of them undone once."""
    text, at = layer.text, 0
    while (m := ESCAPES.search(text, at)) is not None:
        low, high = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
        high = len(text) if high < 0 else high
        out: list[str] = []
        starts, ends, kinds = [], [], set()
        done = low
        for m in ESCAPES.finditer(text, low, high):
            chars = _undone(m[0])
            stops = m.start() + np.cumsum([n for _, n in chars])
            begins = stops - np.array([n for _, n in chars])
            out += [text[done : m.start()], *(c for c, _ in chars)]
            starts += [layer.starts[done : m.start()], layer.starts[begins]]
            ends += [layer.ends[done : m.start()], layer.ends[stops - 1]]
            kinds.add("url" if m[0][0] == "%" else "unicode")
            done = m.end()
        out.append(text[done:high])
        line = "".join(out)
        if line != text[low:high]:
            yield Layer(line, np.concatenate([*starts, layer.starts[done:high]]), np.concatenate([*ends, layer.ends[done:high]]), (*layer.path, "+".join(sorted(kinds))))
        at = high


def _unpacked(raw: bytes, largest: int) -> tuple[str, bytes | None] | None:
    """(codec, content) of a compressed stream; content None if it is larger than ``largest``; None if it is none."""
    codec = next((MAGIC[k] for k in MAGIC if raw.startswith(k)), None)
    try:
        if codec in ("gzip", "zlib"):
            out = zlib.decompressobj(31 if codec == "gzip" else 15).decompress(raw, largest + 1)
        elif codec == "bzip2":
            out = bz2.BZ2Decompressor().decompress(raw, largest + 1)
        elif codec == "xz":
            out = lzma.LZMADecompressor(memlimit=largest).decompress(raw, largest + 1)
        elif codec == "zstd":
            out = zstandard.ZstdDecompressor(max_window_size=largest).stream_reader(raw).read(largest + 1)
        else:
            return None
    except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError, zstandard.ZstdError):
        return None
    return codec, (out if len(out) <= largest else None)


def _base64(run: str) -> bytes | None:
    body = run.rstrip("=").translate(str.maketrans("-_", "+/"))
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def _from_blobs(layer: Layer, seen: set, largest: int) -> Iterator[Layer | None]:
    """One layer for each base64 run whose content, decompressed as often as it takes, is text; None for one that is too large.

    ``seen`` holds the contents met at a place: a stream that unfolds to itself ends there.
    """
    for m in BLOB.finditer(layer.text):
        raw, path = _base64(m[0]), [*layer.path, "base64"]
        a, z = layer.place(m.start(), m.end())
        while raw is not None and (a, z, raw) not in seen:
            more = _unpacked(raw, largest)
            if more is None:
                break
            seen.add((a, z, raw))
            path.append(more[0])
            raw = more[1]
            if raw is None:
                yield None
        if not raw or (a, z, raw) in seen:
            continue
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            continue
        yield Layer(text, np.broadcast_to(np.int64(a), len(text)), np.broadcast_to(np.int64(z), len(text)), tuple(path))


def unwrapped(text: str, largest: int = LARGEST) -> tuple[list[Layer], int]:
    """All layers below ``text`` and the number of streams that were too large to unfold.

    Every step either shortens a text or decompresses one, and a text is taken up once at each place, so the work ends.
    """
    todo = [Layer(text, np.arange(len(text)), np.arange(1, len(text) + 1), ())]
    seen: set[tuple] = set()
    out, large = [], 0
    while todo:
        layer = todo.pop()
        for new in [*_without_escapes(layer), *_from_blobs(layer, seen, largest)]:
            if new is None:
                large += 1
            elif new.text and (key := (*new.place(0, len(new.text)), new.text)) not in seen:
                seen.add(key)
                out.append(new)
                todo.append(new)
    return out, large


def _outermost(found: dict) -> dict:
    """Without those that lie inside a span of the same kind and value: a run read with and without its escaped end."""
    far: dict[tuple, int] = {}
    out = {}
    for key in sorted(found, key=lambda x: (x[1], -x[2])):
        kind, _, end = key
        same = (kind, found[key][0])
        if end > far.get(same, -1):
            far[same], out[key] = end, found[key]
    return out


def secrets(text: str, largest: int = LARGEST) -> tuple[list[tuple], int]:
    """((kind, start, end, value, path), ...) by start, then kind, then end, and the number of streams left packed.

    path is empty for the text itself. A span found in several layers is reported once, from the outermost.
    """
    found = {(k, a, z): (text[a:z], "") for k, a, z in spans_of(text)}
    large = 0
    if ESCAPES.search(text) or BLOB.search(text):
        layers, large = unwrapped(text, largest)
        deep: dict[tuple, tuple[str, str]] = {}
        for layer in sorted(layers, key=lambda x: len(x.path)):
            for kind, a, z in spans_of(layer.text):
                deep.setdefault((kind, *layer.place(a, z)), (layer.text[a:z], ">".join(layer.path)))
        found = _outermost(deep) | found
    order = sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    return [(*key, *found[key]) for key in order], large


def scan(docs: DataFrame, *, text: str = "text", carry: list[str] | None = None, largest: int = LARGEST) -> DataFrame:
    """The ``carry`` columns (all of ``docs``) with secrets and n_packed, which replace columns of these names.

    secrets: array of (kind, start, end, value, path) by start, then kind; places are code points of the whole text,
    the end is exclusive; path names the layers (url, unicode, base64, gzip, ...), from the outermost; what
    stands in the text itself has none. A null text is empty and has none. n_packed counts compressed streams of over ``largest`` bytes,
    which stay packed so that a small text can't fill an executor. Rows are independent: repeated ones are each scanned.
    """
    new = ("secrets", "n_packed")
    carry = [c for c in (docs.columns if carry is None else carry) if c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, large = [], []
            for x in batch.column(batch.num_columns - 1):
                rows, n = secrets(x.as_py() or "", largest)
                kept.append([dict(zip(("kind", "start", "end", "value", "path"), r, strict=True)) for r in rows])
                large.append(n)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("path", pa.string())]))
            columns = [*batch.columns[:-1], pa.array(kept, kind), pa.array(large, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], *new])

    types = dict(docs.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in carry], f"secrets {FOUND}", "n_packed int"])
    return docs.select(*carry, F.col(text).alias(unused("text", carry))).mapInArrow(run, schema)


def _label(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts by kind and digest of what the texts hold themselves, and all spans as text."""
    base = F.filter("secrets", lambda x: x["path"] == "")
    of_kind = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in KINDS]
    return scanned.select(key, *counts, F.sha2(_label(base), 256).alias("base_sha256"), _label(F.col("secrets")).alias("spans"))
