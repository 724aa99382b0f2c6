"""Removal of long repeated byte strings by depth-limited radix passes over anchored suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else, in the same
document or another. A suffix array over all positions would shuffle many times the input, so the
order is built over anchored suffixes and only as deep as the threshold:

* Anchors. Of all ``GRAM``-byte strings inside a window of LENGTH bytes, the leftmost with the least
  hash is the window's anchor. It depends on the window's bytes alone, so equal windows have their
  anchors at the same place, and every window has one. About two anchors fall in LENGTH - GRAM bytes.
* Digit 1, the gram: anchors whose gram occurs once are done; their windows are unique.
* Digit 2, the whole context: the bytes from LENGTH - GRAM before the anchor to LENGTH behind it (or
  to the document's ends), which hold every window with this anchor. Anchors with equal contexts
  repeat each other over the whole context if that is LENGTH bytes or longer.
* Digit 3, the half context: a window that reaches further to the left of the gram than to the right
  holds all of the (LENGTH - GRAM) / 2 bytes to the left, any other all of those to the right. An
  anchor that shares neither half with another context is done; else it goes, one anchor of each
  context, to the group of its left half, of its right half, or both, each with the windows it is for.
* Further digits, only for groups of more than ``GROUP`` contexts: contexts that agree in all bytes of
  the group's windows repeat each other; of each such class one goes on. The range of windows is cut
  in two, and each half makes groups by the bytes that all of its windows hold. So the strings that
  are compared grow from the gram to whole windows, in at most ``LEVELS`` passes, and a context is in
  at most two groups more per pass, whatever the size of the group.
* Last pass, for groups of up to ``GROUP`` contexts: their strings of LENGTH bytes are sorted by (group,
  place, hash) in one task: equal groups are exactly the repeated windows.

Hashes of strings have 64 bits and are only compared within a gram; those of rows have 128.

Scale. What is shuffled: anchors (one per about 170 bytes, 40 bytes each), and compressed texts twice,
once to cut the contexts of unsettled anchors, once to remove the ranges. Rows of a large group are
dealt with salt, and joins by gram or group have written tables on both sides, so adaptive execution
can split a hot one. A document's own ranges are the only thing gathered per key.

Cases. Null or empty text, and texts under LENGTH bytes: nothing removed. Very long texts: whole, walked
in segments. Repeated rows and equal
texts repeat each other. Rows are told apart by a key of their own, so null or repeated ids
are no matter. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SharedTables, blocks_of, byte_texts, mix64, release_shuffles, row_key

LENGTH, GRAM = 400, 64
SIDE = LENGTH - GRAM  # how far a window can reach to either side of its gram
HALF = SIDE // 2
GROUP = 2048
LEVELS = 1 + (SIDE - HALF).bit_length() + 1
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0xD1B54A32D192ED03))


class _Powers:
    """Powers of the base and of its inverse, grown as needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up), 1 << 16)
            cls.up = np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, _BASE)]).astype(np.uint64), dtype=np.uint64)
            cls.down = np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, _BASE_INVERSE)]).astype(np.uint64), dtype=np.uint64)
        return cls.up[:n], cls.down[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums of byte values times powers of the base; one longer than ``data``."""
    up, _ = _Powers.to(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [begin, end); equal bytes, equal hashes."""
    _, down = _Powers.to(len(prefix))
    return mix64((prefix[end] - prefix[begin]) * down[begin] + (end - begin).astype(np.uint64))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width``."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, _U(0xFFFFFFFFFFFFFFFF))
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


_PLACE = _U((1 << 31) - 1)


def anchors_of(grams: np.ndarray, width: int) -> np.ndarray:
    """Positions that are, for some run of ``width`` grams, the leftmost with the least hash (33 bits)."""
    ranked = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    at = (sliding_least(ranked, width) & _PLACE).astype(np.int64)
    return at[np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))]


SEGMENT = 1 << 21


def anchor_rows(data: bytes) -> tuple[np.ndarray, ...] | None:
    """(position, gram, context, left half, right half, context's begin and end) of every anchor.

    None: too short for one. A longer text is walked in segments of windows, so the work arrays stay
    bounded; each segment sees as many bytes to both sides as its anchors' contexts need.
    """
    n, side = len(data), SIDE
    if n < LENGTH:
        return None
    parts, last = [], -1
    for first in range(0, n - LENGTH + 1, SEGMENT):
        lo, hi = max(0, first - side), min(n, first + SEGMENT + 2 * LENGTH)
        raw = np.frombuffer(data, np.uint8, hi - lo, lo)
        prefix = prefix_hash(raw)
        starts = np.arange(first - lo, min(first + SEGMENT + side, n - GRAM + 1) - lo)
        grams = span_hash(prefix, starts, starts + GRAM)
        own = anchors_of(grams, side + 1)
        at = own + first
        fresh = at > last  # the first anchor may be the last of the segment before
        at, gram = at[fresh], grams[own[fresh]]
        if not len(at):
            continue
        last = int(at[-1])
        begin, end = np.maximum(at - side, 0), np.minimum(at + LENGTH, n)
        context = mix64(span_hash(prefix, begin - lo, end - lo) + (at - begin).astype(np.uint64))
        half = HALF
        left = np.where(at >= half, span_hash(prefix, np.maximum(at - half, 0) - lo, at - lo), 0)
        right = np.where(at + GRAM + half <= n, span_hash(prefix, at + GRAM - lo, np.minimum(at + GRAM + half, n) - lo), 0)
        parts.append((at, gram, context, left, right, begin, end))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


ANCHORS = "row long, row2 long, at int, begin int, end int, gram long, context long, lhalf long, rhalf long"
_ANCHOR_NAMES = ["row", "row2", "at", "begin", "end", "gram", "context", "lhalf", "rhalf"]


def _anchor_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, rows2, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), byte_texts(b.column(2))
        for lo, hi in blocks_of(texts, 1 << 20):
            parts: list[list[np.ndarray]] = [[] for _ in _ANCHOR_NAMES]
            for row, row2, t in zip(rows[lo:hi], rows2[lo:hi], texts[lo:hi], strict=True):
                got = anchor_rows(t or b"")
                if got is None:
                    continue
                at, gram, context, left, right, begin, end = got
                for to, v in zip(parts, (np.full(len(at), row), np.full(len(at), row2), at, begin, end, gram, context, left, right), strict=True):
                    to.append(v)
            if parts[0]:
                cols = [np.concatenate(p) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), *[pa.array(c.astype(np.int32)) for c in cols[2:5]], *[pa.array(c.astype(np.uint64).view(np.int64)) for c in cols[5:]]], _ANCHOR_NAMES)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, the texts, compressed for the shuffle."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            *rest, texts = b.slice(at, 1024).columns
            yield pa.RecordBatch.from_arrays([*rest, pa.array([squeeze(t or b"") for t in byte_texts(texts)], pa.binary())], [*b.schema.names[:-1], "z"])


def _open(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z) if z else b""


MEMBERS = "core long, c long, gram long, context long, lo int, hi int, lead int, bytes binary"
_MEMBERS = pa.schema([("core", pa.int64()), ("c", pa.int64()), ("gram", pa.int64()), ("context", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("lead", pa.int32()), ("bytes", pa.binary())])


def member(core: int, c: int, gram: int, context: int, lo: int, hi: int, lead: int, data: bytes) -> tuple | None:
    """A context in a group whose windows start ``lo`` to ``hi`` bytes before the gram, trimmed to those it has.

    ``lead``: bytes of ``data`` before the gram. None: it has no such window.
    """
    lo, hi = max(lo, LENGTH - len(data) + lead), min(hi, lead)
    if lo > hi:
        return None
    return core, c, gram, context, lo, hi, hi, data[lead - hi : lead - lo + LENGTH]


def _members_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), _MEMBERS, strict=True)], schema=_MEMBERS)


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(z, wanted anchors) to one row per wanted context and half, with the bytes of its windows."""
    for b in batches:
        for at in range(0, b.num_rows, 64):
            part = b.slice(at, 64)
            out = []
            for z, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                data = _open(z)
                for w in own:
                    lo, hi = (HALF + 1, SIDE) if w["left"] else (0, HALF)
                    got = member(w["core"], w["c"], w["gram"], w["context"], lo, hi, w["at"] - w["begin"], data[w["begin"] : w["end"]])
                    if got:
                        out.append(got)
            if out:
                yield _members_batch(out)


def settle(rows: list[tuple]) -> list[tuple]:
    """Whole groups of members to (gram, context, lo, hi): byte ranges around the gram's place that repeated windows cover."""
    data = [r[7] for r in rows]
    core = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    lead = np.array([r[6] for r in rows], np.int64)
    count = np.array([r[5] - r[4] + 1 for r in rows], np.int64)
    keys = []
    for at in range(0, len(rows), 1024):  # hashed some at a time
        n = count[at : at + 1024]
        length = n + LENGTH - 1
        prefix = prefix_hash(np.frombuffer(b"".join(data[at : at + 1024]), np.uint8))
        own = np.repeat(np.arange(len(n)), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        begin = (np.cumsum(length) - length)[own] + step
        place = lead[at + own] - step  # bytes of the window before the gram
        keys.append(span_hash(prefix, begin, begin + LENGTH) ^ mix64(core[at + own] + place.astype(np.uint64) * _BASE))
    _, back, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    who, step = np.repeat(np.arange(len(rows)), count), np.arange(len(back)) - np.repeat(np.cumsum(count) - count, count)
    sure = np.flatnonzero(n[back] > 1)
    who, start = who[sure], step[sure] - lead[who[sure]]
    if not len(who):
        return []
    cut = np.flatnonzero((who[1:] != who[:-1]) | (start[1:] > start[:-1] + LENGTH)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(who)]]) - 1
    return [(rows[w][2], rows[w][3], lo, hi + LENGTH) for w, lo, hi in zip(who[first].tolist(), start[first].tolist(), start[last].tolist(), strict=True)]


def _settled_batch(found: list[tuple]) -> pa.RecordBatch:
    return _members_batch([(None, None, gram, context, lo, hi, None, None) for gram, context, lo, hi in found])


def _meet_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members sorted by group: small groups to covered ranges (no bytes), members of large ones as they are."""
    held: list[tuple] = []
    size = 0
    for b in batches:
        large = pc.greater(b.column(1), GROUP)
        if (over := b.filter(large)).num_rows:
            yield over
        for row in zip(*(c.to_pylist() for c in b.filter(pc.invert(large)).columns), strict=True):
            if held and size > 1 << 19 and row[0] != held[-1][0]:
                if found := settle(held):
                    yield _settled_batch(found)
                held, size = [], 0
            held.append(row)
            size += len(row[7])
    if held and (found := settle(held)):
        yield _settled_batch(found)


def _whole_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members with a key over all bytes of their windows."""
    for b in batches:
        data = b.column(7).to_pylist()
        prefix = prefix_hash(np.frombuffer(b"".join(data), np.uint8))
        end = np.cumsum([len(x) for x in data])
        lo, hi = (np.array(b.column(i), np.uint64) for i in (4, 5))
        key = span_hash(prefix, np.concatenate([[0], end[:-1]]).astype(np.int64), end) ^ mix64(lo * _BASE + hi)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(mix64(key).view(np.int64))], [*b.schema.names, "whole"])


def split_member(row: tuple, lo: int, hi: int) -> list[tuple]:
    """A member of a group with windows ``lo`` to ``hi`` as member of the two groups that halve this range."""
    core, c, gram, context, _, _, lead, data = row
    out = []
    middle = (lo + hi) // 2
    for a, b in ((lo, middle), (middle + 1, hi)):
        got = member(core, c, gram, context, a, b, lead, data)
        if got:
            held = data[lead - a : lead - b + LENGTH]  # what all windows of the half hold
            own = prefix_hash(np.frombuffer(held, np.uint8))
            key = span_hash(own, np.array([0]), np.array([len(held)])) ^ mix64(np.array([core], np.int64).view(np.uint64) + np.uint64(a))
            out.append((int(mix64(key).view(np.int64)[0]), None, *got[2:]))
    return out


def _halve(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lo, hi = window_range(row[4], level)
                if lo < hi:
                    out += split_member(row, lo, hi)
            if out:
                yield _members_batch(out)

    return run


def window_range(at: int, level: int) -> tuple[int, int]:
    """The range of a group on ``level`` of halving that holds the windows at ``at``."""
    lo, hi = (HALF + 1, SIDE) if at > HALF else (0, HALF)
    for _ in range(level):
        middle = (lo + hi) // 2
        lo, hi = (lo, middle) if at <= middle else (middle + 1, hi)
    return lo, hi


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_kept long"


def merged_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


class RepeatedStrings:
    """The tables of one run; ``ranges`` has (row, row2, lo, hi) of bytes to remove, overlapping."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        spark = docs.sparkSession
        t = self.tables = SharedTables(spark, "repeats")
        # the row key must be the same in every pass: it is made from the row's content
        source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        self.source = source.select("*", *row_key("doc_id", "text"))
        anchors = t.write(self.source.select("row", "row2", "text").mapInArrow(_anchor_partition, ANCHORS), "anchors")
        shared = t.write(anchors.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "shared")
        live = t.write(anchors.join(shared, "gram", "left_semi"), "live")
        t.drop("anchors")
        pick = F.min(F.struct("row", "row2", "at", "begin", "end")).alias("one")
        contexts = t.write(live.groupBy("gram", "context", "lhalf", "rhalf").agg(F.count("*").alias("n"), pick), "contexts")
        whole = live.join(contexts.where(f"n > 1 AND one.end - one.begin >= {LENGTH}").select("gram", "context"), ["gram", "context"])
        sure = whole.select("row", "row2", F.col("begin").alias("lo"), F.col("end").alias("hi"))
        halves = [self._half(contexts, side) for side in ("lhalf", "rhalf")]
        wanted = halves[0].unionByName(halves[1])
        per_row = wanted.groupBy("row", "row2").agg(F.collect_list("w").alias("own"))
        packed = self.source.select("row", "row2", "text").mapInArrow(_pack, "row long, row2 long, z binary")
        one_each = packed.join(per_row, ["row", "row2"]).dropDuplicates(["row", "row2"])
        pending = one_each.select("z", "own").mapInArrow(_cut_contexts, MEMBERS)
        pieces = []
        for level in range(LEVELS):
            salt = F.when(F.col("c") > GROUP, F.pmod(F.xxhash64("context"), F.ceil(F.col("c") / GROUP))).otherwise(0)
            dealt = pending.repartition("core", salt).sortWithinPartitions("core")
            found = t.write(dealt.mapInArrow(_meet_partition, MEMBERS), f"found{level}")
            release_shuffles(spark)
            pieces.append(found.where("bytes IS NULL").select("gram", "context", "lo", "hi"))
            large = found.where("bytes IS NOT NULL")
            if large.isEmpty():
                break
            settled, pending = self._digit(large, level)
            pieces.append(settled)
        covered = pieces[0]
        for more in pieces[1:]:
            covered = covered.unionByName(more)
        # a covered piece of a context counts for every anchor with that context
        spread = live.join(t.write(covered.distinct(), "covered"), ["gram", "context"]).select("row", "row2", (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi"))
        self.ranges = t.write(sure.union(spread).distinct(), "ranges")
        for name in ("live", "shared", "contexts", "lhalf", "rhalf", "covered", *[f"{x}{n}" for x in ("found", "keyed", "classes", "halves", "sizes") for n in range(level + 1)]):
            t.drop(name)
        release_shuffles(spark)

    def _half(self, contexts: DataFrame, side: str) -> DataFrame:
        """(row, row2, w): the contexts that share this half with another one, ``c`` in all, as members of its group."""
        shared = contexts.where(F.col(side) != 0).groupBy("gram", side).agg(F.count("*").alias("c")).where("c > 1")
        rows = contexts.join(self.tables.write(shared, side), ["gram", side])
        core = F.xxhash64("gram", side, F.lit(side)).alias("core")
        return rows.select("one.row", "one.row2", F.struct(core, "c", "gram", "context", F.col("one.at").alias("at"), F.col("one.begin").alias("begin"), F.col("one.end").alias("end"), F.lit(side == "lhalf").alias("left")).alias("w"))

    def _digit(self, large: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
        """Members of large groups: the ranges of those that agree in all their windows, and the members of the next groups."""
        t = self.tables
        keyed = t.write(large.mapInArrow(_whole_key, f"{MEMBERS}, whole long"), f"keyed{level}")
        classes = t.write(keyed.groupBy("core", "whole").agg(F.count("*").alias("n"), F.min("context").alias("first")), f"classes{level}")
        met = keyed.join(classes, ["core", "whole"])
        settled = met.where("n > 1").select("gram", "context", (-F.col("hi")).alias("lo"), (F.lit(LENGTH) - F.col("lo")).alias("hi"))
        onward = met.where("context = first").select("core", "c", "gram", "context", "lo", "hi", "lead", "bytes")
        halves = t.write(onward.mapInArrow(_halve(level), MEMBERS), f"halves{level}")
        sizes = t.write(halves.groupBy("core").agg(F.count("*").alias("n")).where("n > 1"), f"sizes{level}")
        return settled, halves.join(sizes, "core").select("core", F.col("n").alias("c"), "gram", "context", "lo", "hi", "lead", "bytes")

    def result(self) -> DataFrame:
        """One row per document: sizes, number of removed runs, digest of what is left."""
        return self._apply(_digest, RESULT)

    def cleaned(self) -> DataFrame:
        """(doc_id, text) with the repeated bytes removed; bytes that are no UTF-8 any more are replaced."""
        return self._apply(_clean, "doc_id long, text string")

    def _apply(self, function, schema: str) -> DataFrame:
        per_row = self.ranges.groupBy("row", "row2").agg(F.collect_list(F.struct("lo", "hi")).alias("own"))
        packed = self.source.select("row", "row2", "doc_id", "text").mapInArrow(_pack, "row long, row2 long, doc_id long, z binary")
        return packed.join(per_row, ["row", "row2"], "left").select("doc_id", "z", "own").mapInArrow(function, schema)


def _kept(z: bytes, own: list[dict] | None) -> tuple[int, list[tuple[int, int]], bytes]:
    data = _open(z)
    gone = merged_ranges([(r["lo"], r["hi"]) for r in own or ()])
    if not gone:
        return len(data), [], data
    parts, at = [], 0
    for lo, hi in gone:
        parts.append(data[at:lo])
        at = hi
    parts.append(data[at:])
    return len(data), gone, b"".join(parts)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            rows = []
            for z, own in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                n, gone, left = _kept(z, own)
                rows.append((n, n - len(left), len(gone), sha256(left).hexdigest(), len(left)))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string()), pa.array(cols[4], pa.int64())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept"])


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            texts = [_kept(z, own)[2].decode("utf-8", "replace") for z, own in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept."""
    return RepeatedStrings(docs, id_col, text_col).result()
