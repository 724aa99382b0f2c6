"""Secret scans with a recursive decoding worklist.

Base findings come from the text itself: three kinds, each matched leftmost and without overlap,
matches that are too short dropped. Then a worklist of layers. In each layer these are decoded, and
each result is a new layer that is scanned and unwrapped in turn until nothing new comes up:

* blank-free runs with URL escapes (``%41``), as bytes;
* blank-free runs with ``\\u0041`` or ``\\x41``, as characters, and as bytes if one is beyond ASCII;
* base64 of 16 characters or more, also wrapped over lines, in all four alignments (a prefix such as
  ``id/`` shifts it), as bytes;
* zlib and gzip streams in any of those bytes: at the start, or anywhere with a usual header. A cut
  or damaged stream is scanned as far as it goes, further members are read.

Bytes that are no UTF-8 stay as single characters, so one of them hides nothing. A layer seen before at
the same place of the text is not taken up again (cycles end); an escape of escapes more than
``DEEP`` levels deep (``%252525...``) is taken down to one level in one step. Every layer keeps, for each
of its characters, the start and end in the original text, so a finding in any depth maps to a span
of the original, in code points, end exclusive; what was compressed has the span of its stream's run.

Time is linear in the size of each layer. A stream is inflated in pieces of ``PIECE`` bytes that overlap
by ``OVERLAP``, whatever its length, and each piece is a layer.

Cases. Null or empty text: no findings, spans empty. Very long texts: whole, also without a blank.
Repeated rows: a row each. Null ids: kept. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

import binascii
import re
import zlib
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

PIECE, OVERLAP = 1 << 24, 1 << 20
DEEP = 8

# The kinds in their order, with what a match needs to count
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

PERCENT = re.compile(rb"%[0-9A-Fa-f]{2}")
ESCAPE = re.compile(r"\\(?:u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2})")
NESTED = re.compile(rf"%(?:25){{{DEEP},}}|\\(?:u005[cC]){{{DEEP},}}|\\(?:x5[cC]){{{DEEP},}}")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}")
WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]{4,})+")
STREAM = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
# what a decoded layer must hold to be of use: part of a finding, or of a further layer
USEFUL = re.compile(rb"(?i:passw|secret|token|api)|AKIA|[0-9a-f]{32}|%[0-9A-Fa-f]{2}|\\[ux]|[A-Za-z0-9+/_-]{16}|" + STREAM.pattern)


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the findings of one layer."""
    low = text.encode("utf-8", "surrogatepass").lower()
    out = []
    if b"passw" in low or b"secret" in low or b"token" in low or b"api" in low:
        out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


Mapping = Callable[[], tuple[np.ndarray, np.ndarray]]


class Layer:
    """A text and where its characters come from: nowhere else (the original), one span, or a mapping made when needed."""

    __slots__ = ("text", "whole", "_make", "_spans")

    def __init__(self, text: str, whole: tuple[int, int] | None = None, make: Mapping | None = None):
        self.text, self.whole, self._make, self._spans = text, whole, make, None

    @property
    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        if self._spans is None:
            self._spans, self._make = self._make(), None
        return self._spans

    def span(self, begin: int, end: int) -> tuple[int, int]:
        """The original span of characters [begin, end); decoding keeps their order."""
        if self.whole is not None:
            return self.whole
        if self._make is None and self._spans is None:
            return begin, end
        starts, ends = self.spans
        return int(starts[begin]), int(ends[end - 1])

    def below(self, text: str, first: Callable[[], np.ndarray], last: Callable[[], np.ndarray], begin: int, end: int) -> Layer:
        """A layer decoded from characters [begin, end): ``first`` and ``last`` give the places of each character's source."""
        if self.whole is not None:
            return Layer(text, self.whole)

        def make() -> tuple[np.ndarray, np.ndarray]:
            a, b = first(), last()
            if self._make is None and self._spans is None:
                return a, b + 1
            starts, ends = self.spans
            return starts[a], ends[b]

        return Layer(text, None, make)


_STRAY = re.compile("[\ud800-\udc7f\udd00-\udfff]")


def to_bytes(text: str) -> bytes:
    """UTF-8, with the bytes that earlier layers could not decode as they were."""
    try:
        return text.encode("utf-8", "surrogateescape")
    except UnicodeEncodeError:
        return _STRAY.sub("\ufffd", text).encode("utf-8", "surrogateescape")


def byte_counts(text: str) -> np.ndarray:
    """Bytes of each character in ``to_bytes``."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    escaped = (code >= 0xDC80) & (code <= 0xDCFF)
    return np.where(escaped, 1, 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000))


def byte_layers(layer: Layer, data: bytes, first: Callable[[], np.ndarray], last: Callable[[], np.ndarray], begin: int, end: int) -> Iterator[Layer]:
    """Decoded bytes as text, and what is compressed in them. ``first``, ``last``: places of each byte's source."""
    if USEFUL.search(data) is None and not is_stream(data):
        return
    text = data.decode("utf-8", "surrogateescape")
    if len(text) == len(data):
        yield layer.below(text, first, last, begin, end)
    else:

        def ends() -> np.ndarray:
            return np.cumsum(byte_counts(text))

        yield layer.below(text, lambda: first()[np.concatenate([[0], ends()[:-1]])], lambda: last()[ends() - 1], begin, end)
    yield from inflated(data, layer.span(begin, end))


def is_stream(data: bytes) -> bool:
    return data[:2] == b"\x1f\x8b" or (len(data) > 2 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0)


def stream_pieces(data: memoryview) -> Iterator[bytes | int]:
    """What a zlib or gzip stream holds, piece by piece, a cut or damaged one as far as it goes; last, how many bytes it took."""
    took, held, fresh = 0, bytearray(), False
    while took < len(data) and is_stream(bytes(data[took : took + 3])):  # a member after the other
        d, at = zlib.decompressobj(47), took
        try:
            while not d.eof and at < len(data):
                block = bytes(data[at : at + (1 << 16)])
                at += len(block)
                while block and not d.eof:
                    held += (got := d.decompress(block, PIECE))
                    fresh |= bool(got)
                    block = d.unconsumed_tail
                    if len(held) >= PIECE:
                        yield bytes(held)
                        held, fresh = held[-OVERLAP:], False
        except zlib.error:
            break
        if not d.eof:
            took = len(data)
            break
        took = at - len(d.unused_data)
    if fresh:
        yield bytes(held)
    yield took


def inflated(data: bytes, whole: tuple[int, int]) -> Iterator[Layer]:
    """A layer for every piece of every stream in ``data``."""
    view, at = memoryview(data), 0
    starts = [0] if is_stream(data) else []
    for start in [*starts, *(m.start() for m in STREAM.finditer(data) if m.start() or not starts)]:
        if start < at:
            continue  # inside of the stream before
        for piece in stream_pieces(view[start:]):
            if isinstance(piece, int):
                at = max(at, start + piece)
                break
            yield Layer(piece.decode("utf-8", "surrogateescape"), whole)
            if is_stream(piece) or STREAM.search(piece):  # compressed more than once
                yield from inflated(piece, whole)


def _blank_free(text: str, pattern: re.Pattern) -> Iterator[tuple[int, int]]:
    """Blank-free runs of ``text`` that hold the pattern."""
    for m in re.finditer(r"\S+", text):
        if pattern.search(text, m.start(), m.end()):
            yield m.start(), m.end()


_PERCENT_TEXT = re.compile("%[0-9A-Fa-f]{2}")


def _percent(layer: Layer, begin: int, end: int) -> Iterator[Layer]:
    run = layer.text[begin:end]
    raw = to_bytes(run)
    at = np.array([m.start() for m in PERCENT.finditer(raw)], np.int64)
    bytes_in = np.frombuffer(raw, np.uint8).copy()
    digits = np.stack([bytes_in[at + 1], bytes_in[at + 2]]).astype(np.int64)
    digits = np.where(digits < 58, digits - 48, (digits | 32) - 87)
    bytes_in[at] = digits[0] * 16 + digits[1]
    keep = np.ones(len(raw), bool)
    keep[at + 1] = keep[at + 2] = False

    def places(behind: int) -> np.ndarray:
        place = np.arange(len(raw))
        place[at] += behind
        kept = place[keep]
        if len(raw) != len(run):
            kept = np.repeat(np.arange(len(run)), byte_counts(_STRAY.sub("\ufffd", run)))[kept]
        return kept + begin

    yield from byte_layers(layer, bytes_in[keep].tobytes(), lambda: places(0), lambda: places(2), begin, end)


def _escapes(layer: Layer, begin: int, end: int) -> Iterator[Layer]:
    run = layer.text[begin:end]
    found = [(m.start(), m.end(), int(m[0][2:], 16)) for m in ESCAPE.finditer(run)]
    code = np.frombuffer(run.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    at, stop, value = (np.array(x, np.int64) for x in zip(*found, strict=True))
    keep, final = np.ones(len(code), bool), np.arange(len(code))
    for i in range(1, 6):
        inner = at[stop - at > i] + i
        keep[inner] = False
    code[at], final[at] = value, stop - 1
    kept, first, last = code[keep], np.flatnonzero(keep), final[keep]
    high = np.flatnonzero((kept[:-1] >> 10 == 0x36) & (kept[1:] >> 10 == 0x37))  # surrogate pairs become one character
    kept[high] = 0x10000 + ((kept[high] & 0x3FF) << 10) + (kept[high + 1] & 0x3FF)
    last[high] = last[high + 1]
    single = np.ones(len(kept), bool)
    single[high + 1] = False
    chars, first, last = kept[single], first[single] + begin, last[single] + begin
    text = chars.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    yield layer.below(text, lambda: first, lambda: last, begin, end)
    beyond = np.array([run[a + 1] == "x" for a in at.tolist()]) & (value >= 0x80)
    if beyond.any():  # \\x escapes as bytes
        raw = "".join([chr(0xDC00 + c) if b else chr(c) for c, b in zip(chars.tolist(), np.isin(first - begin, at[beyond]).tolist(), strict=True)])
        width = byte_counts(_STRAY.sub("\ufffd", raw))
        yield from byte_layers(layer, to_bytes(raw), lambda: np.repeat(first, width), lambda: np.repeat(last, width), begin, end)


def _base64(layer: Layer, begin: int, end: int) -> Iterator[Layer]:
    """The run in its four alignments; line ends and what indents the next line are left out."""
    run = layer.text[begin:end]
    core = re.sub(r"[\r\n \t]", "", run).replace("-", "+").replace("_", "/").encode()
    places = None
    for shift in range(4):
        part = core[shift:]
        part = part[: len(part) - (len(part) % 4 == 1)]
        data = binascii.a2b_base64(part + b"=" * (-len(part) % 4))
        if USEFUL.search(data) is None and not is_stream(data):
            continue
        if places is None:
            places = np.flatnonzero(np.frombuffer(run.encode("ascii"), np.uint8) > 32) + begin

        def first(n: int = len(data), shift: int = shift, places: np.ndarray = places) -> np.ndarray:
            i = np.arange(n)
            return places[shift + i // 3 * 4 + i % 3]

        def last(n: int = len(data), shift: int = shift, places: np.ndarray = places) -> np.ndarray:
            i = np.arange(n)
            return places[np.minimum(shift + i // 3 * 4 + i % 3 + 1, len(places) - 1)]

        yield from byte_layers(layer, data, first, last, begin, end)


def _nested(layer: Layer) -> Iterator[Layer]:
    """Very deep escapes of escapes, taken down to one level."""
    found = [(m.start(), m.end(), m.start() + {"%": 3, "u": 6, "x": 4}[m[0][0] if m[0][0] == "%" else m[0][1]]) for m in NESTED.finditer(layer.text)]
    if not found:
        return
    parts, at = [], 0
    keep, final = np.ones(len(layer.text), bool), np.arange(len(layer.text))
    for start, end, stop in found:
        parts += [layer.text[at:stop]]
        keep[stop:end] = False
        final[stop - 1] = end - 1
        at = end
    parts.append(layer.text[at:])
    yield layer.below("".join(parts), lambda: np.flatnonzero(keep), lambda: final[keep], 0, len(layer.text))


def unwrap(layer: Layer) -> Iterator[Layer]:
    """The layers directly below one."""
    text = layer.text
    if "%" in text or "\\" in text:
        if NESTED.search(text):
            yield from _nested(layer)
            return
        if "%" in text:
            for begin, end in _blank_free(text, _PERCENT_TEXT):
                yield from _percent(layer, begin, end)
        if "\\" in text:
            for begin, end in _blank_free(text, ESCAPE):
                yield from _escapes(layer, begin, end)
    for m in BASE64.finditer(text):
        yield from _base64(layer, m.start(), m.end())
    if "\n" in text:
        for m in WRAPPED.finditer(text):
            yield from _base64(layer, m.start(), m.end())


def find_secrets(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base findings, all findings) as sorted (start, kind index, end) in the original text."""
    if not text:
        return [], []
    base = scan(text)
    found, work = set(base), [Layer(text)]
    seen = set()  # the same layer may stand at several places; at one place it is a cycle
    while work:
        layer = work.pop()
        for below in unwrap(layer):
            if not below.text:
                continue
            key = (xxh3_128_digest(below.text.encode("utf-32-le", "surrogatepass")), *below.span(0, len(below.text)))
            if key in seen:
                continue
            seen.add(key)
            for start, kind, end in scan(below.text):
                s, e = below.span(start, end)
                found.add((s, kind, e))
            work.append(below)
    return base, sorted(found)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{s}:{e}" for s, k, e in spans])


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and digest of the base findings, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out: tuple[list, ...] = ([], [], [], [], [])
                for text in part.column(1).to_pylist():
                    base, every = find_secrets(text)
                    for k in range(3):
                        out[k].append(sum(x[1] == k for x in base))
                    out[3].append(sha256(listed(base).encode()).hexdigest())
                    out[4].append(listed(every))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(v, pa.int64()) for v in out[:3]], *[pa.array(v, pa.string()) for v in out[3:]]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
