"""Language identification by error-correcting output codes.

Each known language gets a codeword of ``bits`` bits, chosen greedily far from the others and from
their complements. For each bit a binary n-gram classifier predicts it from hashed byte n-grams of
the lower-cased text: the log ratio of the smoothed n-gram rates of the languages with and without the
bit, every language weighing the same. The mean margin of a text per bit goes through a logistic
loss against every codeword; the nearest by summed loss wins. ``score`` is its share of
exp(-loss) over all codewords; ``ambiguous`` marks a lead under ``MARGIN``.

Learning uses all labelled rows given: partitions sum n-gram counts into one vector per language, so
what reaches the driver is languages x buckets whatever the corpus; the languages are bounded by
``MOST_LANGUAGES``, an error beyond.

Cases. Null text, or text without a letter: ``und``, score 0. Rows with null language or text teach
nothing. Nothing to learn from: all ``und``. Long texts: whole. Repeated rows: a row each, and each
counts in learning. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks_of

ORDERS = (2, 3)
BUCKET_BITS = 12
BITS = 15
MARGIN = 0.1
SHARPNESS = 4.0
MOST_LANGUAGES = 512
UNKNOWN = "und"
PARTS = 64


def codewords(n: int, bits: int = BITS) -> np.ndarray:
    """n rows of +1/-1, picked greedily to lie far from one another and from each complement."""
    while 1 << (bits - 1) < 4 * n:
        bits += 4
    rng = np.random.default_rng(20240607)
    pool = np.where(rng.random((max(4096, 16 * n), bits)) < 0.5, -1, 1).astype(np.int8)
    rows = [pool[0]]
    least = np.full(len(pool), bits)
    for _ in range(n - 1):
        away = (pool != rows[-1]).sum(1)
        least = np.minimum(least, np.minimum(away, bits - away))
        rows.append(pool[int(least.argmax())])
    return np.array(rows)


def features(data: np.ndarray) -> np.ndarray:
    """Hash buckets of all n-grams of a byte string, order by order."""
    out = []
    wide = data.astype(np.uint32)
    for i, k in enumerate(ORDERS):
        n = len(wide) - k + 1
        if n <= 0:
            break
        h = wide[:n].copy()
        for j in range(1, k):
            h *= np.uint32(0x01000193)
            h += wide[j : j + n]
        h *= np.uint32(0x9E3779B1)
        h >>= np.uint32(32 - BUCKET_BITS)
        h += np.uint32(i << BUCKET_BITS)
        out.append(h)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


SIZE = len(ORDERS) << BUCKET_BITS


def prepared(text: str) -> np.ndarray:
    return np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-8", "surrogatepass"), np.uint8)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Model:
    """Codewords of the languages and one weight per n-gram bucket and bit."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.code = codewords(len(languages)) if languages else np.zeros((0, BITS), np.int8)
        self.weights = np.zeros((SIZE, self.code.shape[1]), np.float32)
        if not languages:
            return
        rates = np.empty_like(counts, dtype=np.float64)
        for k in range(len(ORDERS)):
            part = slice(k << BUCKET_BITS, (k + 1) << BUCKET_BITS)
            own = counts[:, part] + 0.5
            rates[:, part] = own / own.sum(1, keepdims=True)
        for j in range(self.code.shape[1]):
            on = self.code[:, j] > 0
            if on.all() or not on.any():
                continue
            self.weights[:, j] = np.log(rates[on].mean(0) / rates[~on].mean(0))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        sums = np.zeros(self.code.shape[1])
        data = prepared(text)
        for at in range(0, len(data), 1 << 16):  # work arrays stay small; n-grams across the seam are kept
            piece = features(data[at : at + (1 << 16) + max(ORDERS) - 1])
            if len(piece) < SIZE // 16:
                sums += self.weights[piece].sum(0)
            else:
                sums += np.bincount(piece, minlength=SIZE).astype(np.float32) @ self.weights
        margin = sums / len(data)
        loss = np.logaddexp(0, -SHARPNESS * self.code * margin).sum(1)
        near = np.exp(loss.min() - loss)
        share = near / near.sum()
        best = int(share.argmax())
        rest = np.delete(share, best)
        return self.languages[best], float(share[best]), bool(len(rest) and share[best] - rest.max() < MARGIN)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from every row with text and language."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = total.setdefault(lang, np.zeros(SIZE, np.int64))
                data = prepared(text)
                for at in range(0, len(data), 1 << 18):
                    own += np.bincount(features(data[at : at + (1 << 18) + max(ORDERS) - 1]), minlength=SIZE)
        yield _vectors(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = total.setdefault(lang, np.zeros(SIZE, np.int64))
                own += np.frombuffer(zlib.decompress(counts), "<i8")
        yield _vectors(total)

    schema = "lang string, counts binary"
    partial = rows.mapInArrow(count, schema).withColumn("part", F.spark_partition_id() % PARTS)
    # the vectors of a language are added up in PARTS groups first, then per language
    summed = partial.repartition("lang", "part").select("lang", "counts").mapInArrow(add, schema)
    got = summed.repartition("lang").mapInArrow(add, schema).limit(MOST_LANGUAGES + 1).collect()
    if len(got) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    got = sorted(got, key=lambda r: r["lang"])
    return Model([r["lang"] for r in got], np.array([np.frombuffer(zlib.decompress(r["counts"]), "<i8") for r in got]).reshape(len(got), SIZE))


def _vectors(total: dict[str, np.ndarray]) -> pa.RecordBatch:
    langs = sorted(total)
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([zlib.compress(total[x].astype("<i8").tobytes(), 1) for x in langs], pa.binary())], ["lang", "counts"])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score, ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x buckets: bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            out = [own.predict(t) for lo, hi in blocks_of(texts) for t in texts[lo:hi]]
            lang, score, unsure = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
