"""Secret scans with a recursive decoding worklist.

Three kinds of secret are looked for in a text and in every layer that can be unwrapped from it: percent-encoded and
escaped characters (\\u0041, \\x41, &#65;) are decoded in place, runs of base64 and compressed streams become layers
of their own, and each layer is scanned and unwrapped again until nothing new turns up. A layer remembers how its
bytes map to the layer above, so that a find is told as a span of the text itself.

Layers of one text are told apart by their bytes and the span they come from; one that has been there is not unwrapped
again, which ends cycles (a compressed stream can hold itself).
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import html.entities
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlens.llm.common import bounded

# The kinds in the order in which spans are told, and the base patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")

PERCENT = re.compile(rb"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(rb"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&(?:quot|apos|amp|lt|gt|equals|colon|num);)+")
ONE_ESCAPE = re.compile(rb"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\u\{([0-9A-Fa-f]{1,6})\}|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});|&([a-z]+);")
BASE64 = re.compile(rb"[A-Za-z0-9+/_-]{16,}={0,2}")
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|\x28\xb5\x2f\xfd|BZh[1-9]1AY&SY|\xfd7zXZ\x00")
URL_SAFE = bytes.maketrans(b"-_", b"+/")
#: Bytes of a piece of a decompressed stream, and how many its neighbour repeats.
PIECE, OVERLAP = 4_000_000, 65_536


def base_spans(data: bytes) -> list[tuple[int, int, int]]:
    """Kind, start and end of what the patterns find, leftmost and non-overlapping for each kind."""
    found = []
    low = data.lower()  # ASCII letters only
    starts = sorted({m.start() for key in KEYWORDS if key in low for m in re.finditer(re.escape(key), low)})
    done = 0
    for at in starts:
        if at >= done and (m := ASSIGN.match(data, at)):
            done = m.end()
            if done - m.start(1) >= 6:
                found.append((0, at, done))
    if b"AKIA" in data:
        found += [(1, *m.span()) for m in ACCESS.finditer(data)]
    found += [(2, *m.span()) for m in HEX.finditer(data)]
    return found


class Layer:
    """Bytes, the layer they were unwrapped from, and which bytes of that each of them comes from.

    edits: (first byte here, bytes here, first byte above, bytes above) of what was replaced, in order; all else is
    copied. every: bytes here and above that belong together in a run of base64 (3 and 4), which starts at above.
    """

    def __init__(self, data: bytes, up: Layer | None = None, edits: list[tuple[int, int, int, int]] | None = None, above: int = 0, every: tuple[int, int] | None = None):
        self.data, self.up, self.above, self.every = data, up, above, every
        self.edits = edits or []
        self.firsts = [e[0] for e in self.edits]

    def origin(self, start: int, end: int) -> tuple[int, int]:
        """The span of the text that these bytes come from."""
        if self.up is None:
            return start, end
        if self.every:
            here, there = self.every
            a, b = self.above + start // here * there, self.above + ((end - 1) // here + 1) * there
        else:
            a, b = self._place(start)[0], self._place(end - 1)[1]
        return self.up.origin(a, min(b, len(self.up.data)))

    def _place(self, x: int) -> tuple[int, int]:
        i = bisect_right(self.firsts, x) - 1
        if i < 0:
            return self.above + x, self.above + x + 1
        here, n, there, width = self.edits[i]
        if x < here + n:
            return there, there + width
        return there + width + x - here - n, there + width + x - here - n + 1

    def touched(self, start: int, end: int) -> bool:
        """Whether a byte of the span was decoded here or above; what was copied all the way is found without us."""
        if self.up is None:
            return False
        if self.every:
            return True
        i = bisect_right(self.firsts, end - 1) - 1
        if i >= 0 and self.edits[i][0] + self.edits[i][1] > start:
            return True
        return self.up.touched(self._place(start)[0], self._place(end - 1)[1])


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match of the pattern decoded."""
    out, edits, last, size = [], [], 0, 0
    for m in pattern.finditer(layer.data):
        for there, width, new in decode(m):
            gap = layer.data[last:there]
            size += len(gap)
            out += [gap, new]
            edits.append((size, len(new), there, width))
            size, last = size + len(new), there + width
    if not edits:
        return None
    return Layer(b"".join([*out, layer.data[last:]]), layer, edits)


def _percent(m: re.Match) -> Iterator[tuple[int, int, bytes]]:
    for at in range(m.start(), m.end(), 3):
        yield at, 3, bytes.fromhex(m.string[at + 1 : at + 3].decode())


def _escaped(m: re.Match) -> Iterator[tuple[int, int, bytes]]:
    """Escapes of a run; two halves of a surrogate pair are one character, a lone half is left as it is."""
    half = None
    for one in ONE_ESCAPE.finditer(m.string, m.start(), m.end()):
        four, eight, braces, two, decimal, hexadecimal, name = one.groups()
        if name is not None:
            code = {b"colon": 58, b"equals": 61, b"num": 35, b"apos": 39}.get(name) or html.entities.name2codepoint.get(name.decode(), -1)
        else:
            code = int(decimal) if decimal else int(next(x for x in (four, eight, braces, two, hexadecimal) if x), 16)
        if 0xD800 <= code < 0xDC00:
            half = (one.start(), code)
        elif 0xDC00 <= code < 0xE000:
            if half:
                yield half[0], one.end() - half[0], chr(0x10000 + ((half[1] - 0xD800) << 10) + code - 0xDC00).encode()
            half = None
        else:
            half = None
            if 0 <= code < 0x110000:
                yield one.start(), one.end() - one.start(), chr(code).encode()


def _from_base64(layer: Layer) -> Iterator[Layer]:
    """Each run of base64, from its first four characters on: letters before it may have joined the run."""
    for m in BASE64.finditer(layer.data):
        run = m.group().rstrip(b"=").translate(URL_SAFE)
        for shift in range(4):
            part = run[shift:]
            part = part[: len(part) - (len(part) % 4 == 1)]
            if len(part) >= 12:
                yield Layer(base64.b64decode(part + b"=" * (-len(part) % 4)), layer, above=m.start() + shift, every=(3, 4))


def _unpacked(data: memoryview) -> Iterator[bytes]:
    """The stream that starts here, in pieces; as far as it can be read."""
    if data[:2] == b"\x1f\x8b":
        reader = zlib.decompressobj(31)
    elif data[:1] == b"\x78":
        reader = zlib.decompressobj()
    elif data[:3] == b"BZh":
        reader = bz2.BZ2Decompressor()
    elif data[:1] == b"\xfd":
        reader = lzma.LZMADecompressor()
    else:
        try:
            with zstandard.ZstdDecompressor().stream_reader(data) as stream:
                while piece := stream.read(PIECE):
                    yield piece
        except zstandard.ZstdError:
            pass
        return
    try:
        while True:
            piece = reader.decompress(data, PIECE)
            if piece:
                yield piece
            data = reader.unconsumed_tail if hasattr(reader, "unconsumed_tail") else b""
            if reader.eof or not piece and (not data or getattr(reader, "needs_input", False)):
                return
    except (zlib.error, OSError, lzma.LZMAError, EOFError):
        return


def _decompressed(layer: Layer) -> Iterator[Layer]:
    """Streams in the layer's bytes, each piece with the end of the one before; all of it maps to the stream's start."""
    for m in PACKED.finditer(layer.data):
        before = b""
        for piece in _unpacked(memoryview(layer.data)[m.start() :]):
            whole = before + piece
            yield Layer(whole, layer, [(0, len(whole), m.start(), len(layer.data) - m.start())])
            before = whole[-OVERLAP:]


def unwrapped(data: bytes) -> Iterator[Layer]:
    """The text and all its layers, each once."""
    todo, seen = [Layer(data)], set()
    while todo:
        layer = todo.pop()
        if not layer.data:
            continue
        if layer.up is not None:
            key = (hashlib.blake2b(layer.data, digest_size=16).digest(), *layer.origin(0, len(layer.data)))
            if key in seen:
                continue
            seen.add(key)
        yield layer
        if b"%" in layer.data and (new := _replaced(layer, PERCENT, _percent)):
            todo.append(new)
        if (b"\\" in layer.data or b"&" in layer.data) and (new := _replaced(layer, ESCAPE, _escaped)):
            todo.append(new)
        todo += _from_base64(layer)
        if layer.up is not None:  # a string has no compressed bytes of its own
            todo += _decompressed(layer)


def find_secrets(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans and those found in decoded layers (kinds with '-decoded' behind), in code points of the text,
    by start, then kind, then end."""
    data = text.encode("utf-8", "surrogatepass")
    base, more = [], set()
    for layer in unwrapped(data):
        for kind, start, end in base_spans(layer.data):
            if layer.up is None:
                base.append((start, kind, end))
            elif layer.touched(start, end):
                a, b = layer.origin(start, end)
                more.add((a, len(KINDS) + kind, b))
    points = _points(data, {x for s in (base, more) for a, _, b in s for x in (a, b)})
    names = (*KINDS, *(f"{k}-decoded" for k in KINDS))
    told = lambda spans: [(names[k], points[a], points[b]) for a, k, b in sorted(spans)]
    return told(base), told(more)


def _points(data: bytes, at: set[int]) -> dict[int, int]:
    """Code points before each byte offset."""
    if data.isascii():
        return {x: x for x in at}
    out, last, n = {}, 0, 0
    for x in sorted(at):
        n += len(data[last:x].decode("utf-8", "surrogatepass"))
        out[x], last = n, x
    return out


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, base and decoded (arrays of kind, start, end: code points, end exclusive).

    Needs doc_id and text. A null text is empty and has no spans. Repeated rows give repeated results; null ids stay;
    other columns are ignored; an empty table gives an empty result. Whole texts and whole layers are scanned: a
    compressed stream is read in pieces of bounded size, so that memory stays bounded and time follows its length.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for batch in (part for whole in batches for part in bounded(whole)):
            found = [find_secrets(t or "") for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array([told(b) for b, _ in found], span), pa.array([told(m) for _, m in found], span)], names=["doc_id", "base", "decoded"])

    kind = "array<struct<kind: string, start: long, end: long>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, base {kind}, decoded {kind}")


def with_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of secret_scan's rows."""
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    order = F.create_map(*(F.lit(x) for i, k in enumerate((*KINDS, *(f"{k}-decoded" for k in KINDS))) for x in (k, i)))
    both = F.array_sort(F.transform(F.concat("base", "decoded"), lambda s: F.struct(s["start"].alias("start"), F.element_at(order, s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(both).alias("spans"))
