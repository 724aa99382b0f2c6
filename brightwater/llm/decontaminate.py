"""Benchmark decontamination by a prefix-filtered set join.

Words are lower-cased (A-Z) runs of letters, digits and characters beyond ASCII. An item's windows
are its runs of ``WINDOW`` words; a shorter item is one window. A window occurs in a document where
its words stand in a row, and all words of an occurrence are hit.

Method. A window is a set of word shingles (``SHINGLE`` words, or all of a shorter window). To hold a
window, a document must hold all of them, so the necessary prefix is one shingle: the rarest of the
window by its count over all documents. Documents are joined on those rarest shingles only. Each
match fixes where the window would start: the positional bound rejects starts before the document
and the length bound ends behind it. What is left is verified exactly, over the whole window, by the
hash of its words and by the words themselves.

Scale. Documents are never shuffled: each block of items, at most ``ITEM_BLOCK_WORDS`` words (about
100 MB of tables), is sent to the executors and met by one pass over the documents; a larger
benchmark is more blocks, so what is broadcast has a fixed bound. Shingle counts come from a first
pass whose partial sums are added up by shingle. Hits of several blocks are merged per document, by 128
bits of its id and text.

Cases. Null or empty text: no words, no hit. Very long texts: whole. Null doc ids: kept. Items without
words: no window. Ties between rarest shingles: the first. Repeated documents: a row each;
an item id that repeats counts once, with the windows of all its rows. No benchmark rows: nothing hit. Null item ids: windows count for hits, not
in the item list. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks_of, byte_texts, hash_words, row_key, run_hashes

WINDOW, SHINGLE = 10, 5
ITEM_BLOCK_WORDS = 1_000_000

# Digits, lower-case letters and all bytes beyond ASCII make words; A-Z become a-z
_WORD_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


class Index:
    """Windows of a block of items, by their rarest shingle."""

    def __init__(self, items: list[tuple[object, list[bytes]]], counts: dict[int, int] | None = None):
        self.item_ids = [i for i, _ in items]
        self.shingle_lengths: set[int] = set()
        wins: dict[tuple[bytes, ...], list[int]] = {}
        for at, (_, words) in enumerate(items):
            for i in range(max(1, len(words) - WINDOW + 1) if words else 0):
                own = wins.setdefault(tuple(words[i : i + WINDOW]), [])
                if not own or own[-1] != at:
                    own.append(at)
        self.windows = list(wins)
        self.items_of = list(wins.values())
        prefix, self.shingles = [], set()
        for w, window in enumerate(self.windows):
            h = hash_words(list(window))
            k = min(SHINGLE, len(window))
            own = run_hashes(h, k).tolist()
            self.shingles.update(own)
            self.shingle_lengths.add(k)
            if counts is not None:
                at = min(range(len(own)), key=lambda i: (counts.get(own[i], 0), own[i], i))
                if counts.get(own[at], 0):  # a shingle that no document has: the window occurs nowhere
                    prefix.append((own[at], k, at, w, int(run_hashes(h, len(window))[0])))
        self.prefix: dict[int, list[tuple[int, int, int]]] = {}
        for h, k, at, w, whole in prefix:
            self.prefix.setdefault(h, []).append((w, at, whole))
        self.keys = {k: np.unique(np.array([p[0] for p in prefix if p[1] == k], np.uint64)) for k in self.shingle_lengths}
        self.lengths = sorted(self.shingle_lengths)


def members(values: np.ndarray, keys: np.ndarray, bits: int = 16) -> np.ndarray:
    """Where ``values`` are in the sorted ``keys``: a bit table first, then a search."""
    if not len(keys) or not len(values):
        return np.zeros(0, np.int64)
    shift = np.uint64(64 - bits)
    mask = np.zeros(1 << bits, bool)
    mask[(keys >> shift).astype(np.int64)] = True
    at = np.flatnonzero(mask[(values >> shift).astype(np.int64)])
    found = keys[np.minimum(np.searchsorted(keys, values[at]), len(keys) - 1)] == values[at]
    return at[found]


def _count_partition(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value)
        keys = np.array(sorted(index.shingles), np.uint64)
        bits = max(16, int(len(keys)).bit_length() + 4)
        total = np.zeros(len(keys), np.int64)
        for b in batches:
            texts = byte_texts(b.column(0))
            for lo, hi in blocks_of(texts):
                for t in texts[lo:hi]:
                    h = hash_words(words_of(t))
                    for k in index.lengths:
                        run = run_hashes(h, k)
                        at = members(run, keys, bits)
                        if len(at):
                            np.add.at(total, np.searchsorted(keys, run[at]), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(total[some])], ["shingle", "n"])

    return run


def hits_in(words: list[bytes], index: Index) -> tuple[list[tuple[int, int]], set[int]]:
    """Word ranges of all occurrences, and the numbers of the items they belong to."""
    ranges, items = [], set()
    if not index.windows or not words:
        return ranges, items
    h = hash_words(words)
    for k in index.lengths:
        run = run_hashes(h, k)
        for at in members(run, index.keys[k]).tolist():
            for w, offset, _ in index.prefix[int(run[at])]:
                window, start = index.windows[w], at - offset
                if start < 0 or start + len(window) > len(words):  # positional and length bounds
                    continue
                if tuple(words[start : start + len(window)]) == window:
                    ranges.append((start, start + len(window)))
                    items.update(index.items_of[w])
    return ranges, items


def _union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _hit_partition(shared, counts):
    """Rows of all documents: row key, words, hit ranges, item ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value, counts.value)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                n_words, spans, items = [], [], []
                for t in byte_texts(part.column(1)):
                    words = words_of(t)
                    ranges, found = hits_in(words, index)
                    n_words.append(len(words))
                    spans.append([{"s": s, "e": e} for s, e in _union(ranges)])
                    items.append(sorted({str(index.item_ids[i]) for i in found if index.item_ids[i] is not None}))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.array(items, pa.list_(pa.string())), part.column(2), part.column(3)], ["doc_id", "n_words", "spans", "items", "row", "row2"])

    return run


HITS = "doc_id long, n_words long, spans array<struct<s:long,e:long>>, items array<string>, row long, row2 long"


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items as (id, words), in blocks of a bounded number of words; one block is held at a time."""
    block, held = [], 0
    for item, text in benchmark.select(id_col, text_col).toLocalIterator():
        words = words_of(text.encode() if text is not None else None)
        if held and held + len(words) > ITEM_BLOCK_WORDS:
            yield block
            block, held = [], 0
        block.append((item, words))
        held += len(words)
    yield block


def shingle_counts(docs: DataFrame, shared, text_col: str) -> dict[int, int]:
    """Counts over all documents of the shingles of one block of items (bounded by the block)."""
    rows = docs.select(text_col).mapInArrow(_count_partition(shared), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).toLocalIterator()
    return {int(np.int64(r["shingle"]).view(np.uint64)): r["n"] for r in rows}


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, spans (merged word ranges), items (ids as strings)."""
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.select("doc_id", "text", *row_key("doc_id", "text"))
    parts = []
    for block in item_blocks(benchmark, item_col, item_text_col):  # one block without rows if there are none
        shared = spark.sparkContext.broadcast(block)
        counts = spark.sparkContext.broadcast(shingle_counts(docs, shared, text_col) if block else {})
        parts.append(rows.mapInArrow(_hit_partition(shared, counts), HITS))
    out = parts[0]
    if len(parts) > 1:
        for more in parts[1:]:
            out = out.unionByName(more)
        # equal rows meet here, each once per block
        copies = F.explode(F.sequence(F.lit(1), (F.col("n") / len(parts)).cast("int")))
        out = out.groupBy("row", "row2", "doc_id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_set("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.count("*").alias("n")).withColumn("copy", copies)
        merge = "aggregate(array_sort(spans), struct(0L AS n, -1L AS e), (a, x) -> struct(a.n + greatest(0L, x.e - greatest(x.s, a.e)) AS n, greatest(a.e, x.e) AS e), a -> a.n)"
    else:
        merge = "aggregate(spans, 0L, (a, x) -> a + x.e - x.s)"
    return out.select("doc_id", "n_words", F.expr(merge).alias("n_hit"), "spans", F.array_sort("items").alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, **columns: str) -> DataFrame:
    """One row per document: counts of words and hits, the items found, and whether any was."""
    hits = find_hits(docs, benchmark, **columns)
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents without any hit, all columns kept. One narrow pass per block of items."""
    spark = docs.sparkSession
    out = docs
    for block in item_blocks(benchmark, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(block)
        counts = spark.sparkContext.broadcast(shingle_counts(docs, shared, text_col) if block else {})

        def clean(batches: Iterator[pa.RecordBatch], shared=shared, counts=counts) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, counts.value)
            for b in batches:
                at = b.schema.get_field_index(text_col)
                keep = [not hits_in(words_of(t), index)[0] for t in byte_texts(b.column(at))]
                yield b.filter(pa.array(keep, pa.bool_()))

        out = out.mapInArrow(clean, docs.schema)
    return out


def items_digest(items: list[str]) -> str:
    """The digest of a list of item ids, as the query gives it."""
    return sha256(",".join(sorted(items)).encode()).hexdigest()
