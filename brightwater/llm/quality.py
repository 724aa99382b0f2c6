"""Quality classification by an interpolated modified Kneser-Ney n-gram model of trusted text.

Trusted documents (a label of good quality and none of toxic) of each language train one model over
the ``ORDER``-grams of the lower-cased UTF-8 bytes. Byte n-grams suit text whose words are mostly
rare. Counts of the highest order come from all trusted training text; lower orders use continuation
counts; discounts for counts of 1, 2 and 3 or more are estimated per language and order. Counts,
context totals and lower-order probabilities meet in joins sharded by (language, n-gram), which give
one table of probabilities of all seen n-grams and one of back-off weights.

A document's perplexity is exp of its mean negative log probability per byte; its peak is the same
over its worst word of ``PEAK_BYTES`` bytes or more, which a single insult or junk token raises even
in a long clean text; its spread is the least standard deviation of the words' nats per byte in any
``FLAT_WORDS`` words in a row, which falls to 0 where one word is repeated. A document is rejected if
perplexity or peak is over its language's threshold, or the spread under ``FLAT_SHARE`` of its lower
one: the ``QUANTILE`` (for the spread, 1 - ``QUANTILE``) of the trusted documents of that language that training left out (one in ``HOLD_OUT`` by
hash). Where these are fewer than ``LEAST_HELD``, each of the ``HOLD_OUT`` parts is scored by a model of
the others, and the threshold comes from all of them; with fewer than ``LEAST_HELD`` of these as well
there is none and the language's documents are kept.

The peak is a maximum over words, so its threshold goes by their number. Up to the mean of trusted
documents it is that quantile. With n times as many words, a word may pass it n times less often:
the peaks (nats per byte) over the ``TAIL`` quantile of trusted documents give their mean excess, and
the threshold rises by that times ln(n), as in an exponential tail.

Scoring. The model goes to the executors in blocks of at most ``MODEL_ROWS`` rows (about 200 MB of
tables): whole languages together while they fit, each document being scored in its language's block.
A language that is larger by itself is split by the byte before the predicted one, which is the same
for all orders of a position; its documents are then scored once per part and the word sums added.
So no table of unbounded size is ever broadcast.

Trusted ids meet the texts by a broadcast set only up to ``TRUSTED_IDS`` ids, tables of a row per
language are broadcast only up to ``MOST_LANGUAGES`` (counts decide); else these are joins.

Cases. Null or empty text: perplexity null, kept. Very long texts: whole. Values equal to a limit: kept.
Fewer than ``FLAT_WORDS`` words: spread null, no limit on it. A language (or null) without trusted text: no
model, perplexity null, kept. One with too little of it: limits null, kept. Repeated rows: a row each; a trusted id counts all rows that bear it.
No labels: all kept. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SharedTables, blocks_of, claim, mix64, release_shuffles

ORDER = 5
PEAK_BYTES = 4
QUANTILE = 0.99
TAIL = 0.8
FLAT_WORDS, FLAT_SHARE = 8, 0.5
HOLD_OUT, LEAST_HELD = 4, 50
MODEL_ROWS = 6_000_000
TRUSTED_IDS = 4_000_000
MOST_LANGUAGES = 100_000
_U = np.uint64
NO_LANG = "\x00"


def text_bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def gram_keys(data: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For padded bytes: the key of the ``order`` bytes that end at each position from ORDER - 1 on."""
    n = len(data) - ORDER + 1
    out = np.zeros(n, np.uint64)
    for j in range(ORDER - order, ORDER):
        out = (out << _U(8)) | data[j : j + n]
    return out


def padded(text: str) -> np.ndarray:
    return np.frombuffer(b"\n" * (ORDER - 1) + text_bytes(text), np.uint8)


class Table:
    """uint64 keys to float32 values by open addressing; missing keys give nan."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.shift = _U(64 - size.bit_length() + 1)
        self.mask = size - 1
        self.keys = np.full(size, _U(0xFFFFFFFFFFFFFFFF))
        self.values = np.full(size, np.nan, np.float32)
        todo = np.arange(len(keys))
        at = self._slot(keys)
        while len(todo):
            free = self.keys[at] == _U(0xFFFFFFFFFFFFFFFF)
            self.keys[at[free]] = keys[todo[free]]  # of several for one slot the last stays
            placed = self.keys[at] == keys[todo]
            self.values[at[placed]] = values[todo[placed]]
            todo, at = todo[~placed], (at[~placed] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = self.values[at]
        held = self.keys[at]
        odd = np.flatnonzero(held != keys)
        out[odd] = np.nan
        odd = odd[held[odd] != _U(0xFFFFFFFFFFFFFFFF)]
        at = at[odd]
        while len(odd):
            at = (at + 1) & self.mask
            held = self.keys[at]
            hit = held == keys[odd]
            out[odd[hit]] = self.values[at[hit]]
            go = ~hit & (held != _U(0xFFFFFFFFFFFFFFFF))
            odd, at = odd[go], at[go]
        return out


class Scorer:
    """The tables of one language (or of the part of it with some previous bytes)."""

    def __init__(self, orders: np.ndarray, keys: np.ndarray, values: np.ndarray, kinds: np.ndarray, previous: frozenset[int] | None = None):
        pick = lambda o, k: (orders == o) & (kinds == k)
        self.prob = {o: Table(keys[m], values[m]) for o in range(1, ORDER + 1) if (m := pick(o, 0)) is not None}
        self.back = {o: Table(keys[m], values[m]) for o in range(1, ORDER + 1) if (m := pick(o, 1)) is not None}
        self.previous = None if previous is None else np.isin(np.arange(256), list(previous))

    def surprise(self, data: np.ndarray) -> np.ndarray:
        """Negative log probability of each byte behind the padding; 0 where another part answers."""
        keys = gram_keys(data)
        out = np.zeros(len(keys))
        todo = np.arange(len(keys)) if self.previous is None else np.flatnonzero(self.previous[((keys >> _U(8)) & _U(255)).astype(np.int64)])
        owed = np.zeros(len(keys))
        for order in range(ORDER, 0, -1):
            own = keys[todo] & _U((1 << 8 * order) - 1)
            got = self.prob[order].get(own).astype(np.float64)
            hit = ~np.isnan(got)
            out[todo[hit]] = got[hit] + owed[todo[hit]]
            todo, own = todo[~hit], own[~hit]
            if not len(todo):
                return out
            weight = self.back[order].get(own >> _U(8)).astype(np.float64)
            owed[todo] += np.nan_to_num(weight, nan=0.0)  # an unseen context: all of the mass goes down
        out[todo] = np.log(256) + owed[todo]
        return out

    def words(self, text: str) -> tuple[float, np.ndarray, np.ndarray]:
        """(sum over all bytes, sum of each word, bytes of each word)."""
        data = padded(text)
        s = self.surprise(data)
        blank = data[ORDER - 1 :] <= 32
        edge = np.flatnonzero(np.concatenate([[True], blank[1:] != blank[:-1]]))
        sums = np.add.reduceat(s, edge)
        sizes = np.diff(np.append(edge, len(s)))
        word = ~blank[edge]
        return float(s.sum()), sums[word], sizes[word]


def long_words(sizes: np.ndarray) -> int:
    return int((sizes >= PEAK_BYTES).sum())


def peak_of(sums: np.ndarray, sizes: np.ndarray) -> float:
    long = sizes >= PEAK_BYTES
    return float((sums[long] / sizes[long]).max()) if long.any() else 0.0


def spread_of(sums: np.ndarray, sizes: np.ndarray) -> float | None:
    """The least standard deviation of the nats per byte of FLAT_WORDS words in a row; null for fewer words."""
    if len(sums) < FLAT_WORDS:
        return None
    rate = sums / sizes
    until = [np.concatenate([[0.0], np.cumsum(x)]) for x in (rate, rate * rate)]
    mean, square = ((c[FLAT_WORDS:] - c[:-FLAT_WORDS]) / FLAT_WORDS for c in until)
    return float(np.sqrt(max(0.0, (square - mean * mean).min())))


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """Ids whose labels all say good quality and none toxic."""
    per = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id"))
    per = per.agg(F.min(F.coalesce(F.col(quality_col), F.lit(0))).alias("q"), F.max(F.coalesce(F.col(toxic_col), F.lit(0))).alias("t"))
    return per.where("q = 1 AND t = 0").select("doc_id")


def fold(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(HOLD_OUT)).cast("int")


def left_out(doc_id: Column) -> Column:
    return fold(doc_id) == 0


COUNTS = "lang string, key long, n long"


def _count_partition(ids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def fold(lang: str) -> None:
            keys = np.concatenate([k for k, _ in held[lang]])
            counts = np.concatenate([c for _, c in held[lang]])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            held[lang] = [(keys[cut], np.add.reduceat(counts, cut))]

        for b in batches:
            if ids is not None:
                wanted = ids.value
                own = b.column(0).to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(wanted, own), max(0, len(wanted) - 1))
                b = b.filter(pa.array(wanted[at] == own if len(wanted) else np.zeros(len(own), bool)))
            texts, langs = b.column(1).to_pylist(), b.column(2).to_pylist()
            for lang in set(langs):
                mine = [t for t, x in zip(texts, langs, strict=True) if x == lang and t]
                for lo, hi in blocks_of(mine, 1 << 22):
                    keys, counts = np.unique(np.concatenate([gram_keys(padded(t)) for t in mine[lo:hi]]), return_counts=True)
                    held.setdefault(lang, []).append((keys, counts))
                if lang in held and len(held[lang]) > 4:
                    fold(lang)
        for lang in sorted(held):
            fold(lang)
            keys, counts = held[lang][0]
            for at in range(0, len(keys), 100_000):
                k, c = keys[at : at + 100_000], counts[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], ["lang", "key", "n"])

    return run


def train(tables: SharedTables, docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(lang, kind, ord, key, value): kind 0 negative log probabilities, kind 1 negative log back-off weights.

    ``docs``: doc_id, text, lang (null already named); ``trusted``: doc_id.
    """
    spark = docs.sparkSession
    learn = trusted.where(~left_out(F.col("doc_id")))
    few = learn.limit(TRUSTED_IDS + 1).count() <= TRUSTED_IDS
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    if few:
        got = np.sort(np.array([r[0] for r in learn.toLocalIterator()], np.int64))
        ids = spark.sparkContext.broadcast(got)
        counted = rows.mapInArrow(_count_partition(ids), COUNTS)
    else:
        counted = rows.join(learn, "doc_id", "left_semi").mapInArrow(_count_partition(None), COUNTS)
    return fit(tables, counted)


def few_languages(df: DataFrame) -> bool:
    """Whether a table of a row per language is small enough to broadcast."""
    return df.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() <= MOST_LANGUAGES


def fit(tables: SharedTables, counted: DataFrame) -> DataFrame:
    """The model of counted ``ORDER``-grams (``COUNTS``)."""
    grams = {ORDER: tables.write(counted.groupBy("lang", "key").agg(F.sum("n").alias("c")), f"grams{ORDER}")}
    for order in range(ORDER - 1, 0, -1):
        low = F.col("key").bitwiseAND(F.lit((1 << 8 * order) - 1))
        grams[order] = tables.write(grams[order + 1].groupBy("lang", low.alias("key")).agg(F.count("*").alias("c")), f"grams{order}")
    few = few_languages(grams[1])
    out = None
    below = None
    for order in range(1, ORDER + 1):
        table = grams[order]
        n = [F.sum((F.col("c") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)]
        spectrum = table.groupBy("lang").agg(*n)  # one row per language
        y = F.when(F.col("n1") + 2 * F.col("n2") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)

        def discount(i: int, y: Column = y) -> Column:
            d = i - (i + 1) * y * F.col(f"n{i + 1}") / F.nullif(F.col(f"n{i}"), F.lit(0.0))
            return F.least(F.greatest(F.coalesce(d, F.lit(0.5 * i)), F.lit(0.1 * i)), F.lit(0.95 * i)).alias(f"d{i}")

        discounts = spectrum.select("lang", *[discount(i) for i in (1, 2, 3)])
        with_d = table.join(F.broadcast(discounts) if few else discounts, "lang").withColumn("ctx", F.shiftright("key", 8)).withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        contexts = with_d.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), F.sum("d").alias("freed"))
        placed = with_d.select("lang", "key", "ctx", "c", "d").join(contexts, ["lang", "ctx"])
        own, gamma = (F.col("c") - F.col("d")) / F.col("total"), F.col("freed") / F.col("total")
        if below is None:
            probs = placed.select("lang", "key", (own + gamma / 256).alias("p"))
        else:
            low = F.col("key").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1))
            lower = below.select("lang", F.col("key").alias("low"), F.col("p").alias("q"))
            probs = placed.withColumn("low", low).join(lower, ["lang", "low"]).select("lang", "key", (own + gamma * F.col("q")).alias("p"))
        below = tables.write(probs, f"probs{order}")
        weights = contexts.select("lang", F.lit(1).alias("kind"), F.lit(order).alias("ord"), F.col("ctx").alias("key"), (-F.log(gamma)).alias("value"))
        part = below.select("lang", F.lit(0).alias("kind"), F.lit(order).alias("ord"), "key", (-F.log("p")).alias("value")).unionByName(weights)
        out = part if out is None else out.unionByName(part)
    return tables.write(out.withColumn("prev", F.when((F.col("kind") == 0) & (F.col("ord") > 1), F.shiftright("key", 8).bitwiseAND(F.lit(255))).when((F.col("kind") == 1) & (F.col("ord") > 1), F.col("key").bitwiseAND(F.lit(255)))), "model")


def model_blocks(model: DataFrame) -> Iterator[tuple[list[str], frozenset[int] | None]]:
    """(languages, previous bytes or None for all) with at most MODEL_ROWS rows each."""
    sizes = {r["lang"]: r["n"] for r in model.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    block, held = [], 0
    for lang in sorted(sizes):
        n = sizes[lang]
        if n > MODEL_ROWS:
            part, part_n = set(), 0
            for r in model.where(F.col("lang") == lang).groupBy("prev").agg(F.count("*").alias("n")).where("prev IS NOT NULL").orderBy("prev").collect():
                if part and part_n + r["n"] > MODEL_ROWS:
                    yield [lang], frozenset(part)
                    part, part_n = set(), 0
                part.add(r["prev"])
                part_n += r["n"]
            yield [lang], frozenset(part) | frozenset(set(range(256)) - _seen(model, lang))
            continue
        if block and held + n > MODEL_ROWS:
            yield block, None
            block, held = [], 0
        block.append(lang)
        held += n
    if block:
        yield block, None


def _seen(model: DataFrame, lang: str) -> set[int]:
    return {r[0] for r in model.where((F.col("lang") == lang) & F.col("prev").isNotNull()).select("prev").distinct().collect()}


def load_block(model: DataFrame, langs: list[str], previous: frozenset[int] | None) -> dict[str, tuple]:
    """The arrays of one block, by language (bounded by MODEL_ROWS)."""
    rows = model.where(F.col("lang").isin(langs))
    if previous is not None:
        rows = rows.where(F.col("prev").isNull() | F.col("prev").isin(sorted(previous)))
    numbered = F.create_map(*[x for i, lang in enumerate(langs) for x in (F.lit(lang), F.lit(i))])
    got = rows.select(numbered[F.col("lang")].alias("lang"), F.col("kind").cast("byte").alias("kind"), F.col("ord").cast("byte").alias("ord"), "key", F.col("value").cast("float").alias("value")).toArrow()
    lang = got["lang"].to_numpy()
    cols = [got[c].to_numpy() for c in ("ord", "key", "value", "kind")]
    return {name: (cols[0][lang == i], cols[1][lang == i].view(np.uint64), cols[2][lang == i], cols[3][lang == i]) for i, name in enumerate(langs)}


SCORES = "doc_id long, lang string, n_bytes long, nats double, peak double, spread double, words long, sums array<double>, sizes array<int>, mark long"
_scorers: dict[str, dict[str, Scorer]] = {}


def scorers_of(name: str, shared, previous: frozenset[int] | None) -> dict[str, Scorer]:
    """The worker's tables of one block, for all tasks that run there; one block at a time stays in memory."""
    claim("quality", _scorers.clear)
    if name not in _scorers:
        _scorers.clear()
        _scorers[name] = {lang: Scorer(*cols, previous) for lang, cols in shared.value.items()}
    return _scorers[name]


def _score_partition(shared, previous: frozenset[int] | None):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = scorers_of(name, shared, previous)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                out: tuple[list, ...] = ([], [], [], [], [], [], [])
                for text, lang in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    if not text or lang not in scorers:
                        row = (len(text_bytes(text or "")), None, None, None, None, None, None)
                    else:
                        total, sums, sizes = scorers[lang].words(text)
                        whole = previous is None
                        row = (len(text_bytes(text)), total, peak_of(sums, sizes) if whole else None, spread_of(sums, sizes) if whole else None, long_words(sizes), None if whole else sums, None if whole else sizes.astype(np.int32))
                    for to, v in zip(out, row, strict=True):
                        to.append(v)
                kinds = (pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *[pa.array(v, k) for v, k in zip(out, kinds, strict=True)], part.column(3)], ["doc_id", "lang", "n_bytes", "nats", "peak", "spread", "words", "sums", "sizes", "mark"])

    return run


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id, lang, n_bytes, nats, peak, spread (in nats per byte), words (those that can be the peak), mark: one row per document."""
    spark: SparkSession = docs.sparkSession
    rows = docs.select("doc_id", "text", "lang", F.xxhash64("doc_id", "text", "lang").alias("mark"))
    blocks = list(model_blocks(model))
    parts, covered = [], []
    split: dict[str, list[DataFrame]] = {}
    plain = ["doc_id", "lang", "n_bytes", "nats", "peak", "spread", "words", "mark"]
    if len(blocks) == 1 and blocks[0][1] is None:  # the usual case: one pass over everything
        shared = spark.sparkContext.broadcast(load_block(model, *blocks[0]))
        release_shuffles(spark)
        return rows.mapInArrow(_score_partition(shared, None), SCORES).select(*plain)
    for langs, previous in blocks:
        shared = spark.sparkContext.broadcast(load_block(model, langs, previous))
        got = rows.where(F.col("lang").isin(langs)).mapInArrow(_score_partition(shared, previous), SCORES)
        covered += langs
        if previous is None:
            parts.append(got.select(*plain))
        else:
            split.setdefault(langs[0], []).append(got)
    for passes in split.values():
        every = passes[0]
        for more in passes[1:]:
            every = every.unionByName(more)
        # copies of a row share its mark: their sums come several times and are averaged out
        add = "transform(sequence(0, size(sizes) - 1), i -> aggregate(every, 0D, (a, s) -> a + s[i]) / copies)"
        merged = every.groupBy("doc_id", "lang", "mark").agg(F.max("n_bytes").alias("n_bytes"), F.sum("nats").alias("nats"), F.max("words").alias("words"), F.collect_list("sums").alias("every"), F.first("sizes", ignorenulls=True).alias("sizes"), (F.count("*") / len(passes)).alias("copies"))
        merged = merged.withColumn("rates", F.expr(f"CASE WHEN size(sizes) > 0 THEN zip_with({add}, sizes, (s, n) -> s / n) END"))
        worst = f"CASE WHEN rates IS NOT NULL THEN coalesce(array_max(zip_with(rates, sizes, (r, n) -> CASE WHEN n >= {PEAK_BYTES} THEN r END)), 0D) WHEN nats IS NOT NULL THEN 0D END"
        moments = f"aggregate(slice(rates, i + 1, {FLAT_WORDS}), struct(0D AS a, 0D AS q), (t, x) -> struct(t.a + x AS a, t.q + x * x AS q), t -> sqrt(greatest(t.q / {FLAT_WORDS} - t.a * t.a / {FLAT_WORDS * FLAT_WORDS}, 0D)))"
        flat = f"CASE WHEN size(rates) >= {FLAT_WORDS} THEN array_min(transform(sequence(0, size(rates) - {FLAT_WORDS}), i -> {moments})) END"
        merged = merged.select("doc_id", "lang", "n_bytes", (F.col("nats") / F.col("copies")).alias("nats"), F.expr(worst).alias("peak"), F.expr(flat).alias("spread"), "words", "mark", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
        parts.append(merged.select(*plain))
    rest = rows.where(~F.col("lang").isin(covered)) if covered else rows
    empty = spark.sparkContext.broadcast({})
    parts.append(rest.mapInArrow(_score_partition(empty, None), SCORES).select(*plain))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def limits_of(held: DataFrame, quantile: float, few: bool) -> DataFrame:
    """lang, perplexity_limit, peak_base, tail, mean_words, spread_limit: the thresholds that the scores of trusted documents give."""
    at = lambda c, q: F.percentile_approx(c, F.lit(q), F.lit(20000))
    per = held.groupBy("lang").agg(F.count("*").alias("held"), at("perplexity", quantile).alias("perplexity_limit"), at("peak", quantile).alias("peak_base"), at("peak", min(TAIL, quantile)).alias("u"), (FLAT_SHARE * at("spread", 1 - quantile)).alias("spread_limit"), F.greatest(F.avg("words"), F.lit(1.0)).alias("mean_words")).where(F.col("held") >= LEAST_HELD)
    bounds = per.select("lang", "u")
    over = held.join(F.broadcast(bounds) if few else bounds, "lang").where("peak > u")
    tail = over.groupBy("lang").agg(F.avg(F.col("peak") - F.col("u")).alias("tail"))
    return per.join(tail, "lang", "left").select("lang", "perplexity_limit", "peak_base", F.coalesce("tail", F.lit(0.0)).alias("tail"), "mean_words", "spread_limit")


def cross_scores(docs: DataFrame, trusted: DataFrame, langs: list[str]) -> DataFrame:
    """Like ``score`` for the trusted documents of ``langs`` outside of part 0, each by a model of the other parts."""
    tables = SharedTables(docs.sparkSession, "quality-parts")
    rows = docs.where(F.col("lang").isin(langs) & F.col("doc_id").isNotNull() & F.col("text").isNotNull()).join(trusted, "doc_id", "left_semi")
    rows = tables.write(rows.select("doc_id", "text", "lang", fold(F.col("doc_id")).alias("part")), "rows")
    named = lambda part: F.concat("lang", F.lit(NO_LANG), part.cast("string"))
    others = rows.select("*", F.explode(F.array(*[F.lit(i) for i in range(1, HOLD_OUT)])).alias("model")).where("model <> part")
    model = fit(tables, others.select("doc_id", "text", named(F.col("model")).alias("lang")).mapInArrow(_count_partition(None), COUNTS))
    found = score(rows.where("part > 0").select("doc_id", "text", named(F.col("part")).alias("lang")), model)
    return found.withColumn("lang", F.expr(f"left(lang, length(lang) - {1 + len(str(HOLD_OUT - 1))})"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """One row per document: doc_id, lang, n_bytes, perplexity, peak, spread, their limits, kept, mark."""
    tables = SharedTables(docs.sparkSession, "quality")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"))
    trusted = tables.write(trusted_ids(labels), "trusted")
    model = train(tables, rows, trusted)
    scored = tables.write(score(rows, model), "scores")
    for order in range(1, ORDER + 1):
        tables.drop(f"grams{order}")
        tables.drop(f"probs{order}")
    perplexity = F.when(F.col("n_bytes") > 0, F.exp(F.col("nats") / F.col("n_bytes")))
    scored = scored.withColumn("perplexity", perplexity)
    good = scored.where("perplexity IS NOT NULL").join(trusted, "doc_id", "left_semi").withColumn("out", left_out(F.col("doc_id")))
    unseen = good.where("out").select("lang", "perplexity", "peak", "spread", "words")
    few = good.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.col("out").cast("int")).alias("held")).where((F.col("held") < LEAST_HELD) & (F.col("n") >= LEAST_HELD))
    if langs := [r["lang"] for r in few.collect()]:  # a row per language
        more = tables.write(cross_scores(rows, trusted, langs), "more").withColumn("perplexity", perplexity)
        unseen = unseen.unionByName(more.where("perplexity IS NOT NULL").select("lang", "perplexity", "peak", "spread", "words"))
    small = few_languages(good)
    limits = tables.write(limits_of(unseen, quantile, small), "limits")
    judged = scored.join(F.broadcast(limits) if small else limits, "lang", "left").withColumn("peak_limit", F.col("peak_base") + F.col("tail") * F.log(F.greatest(F.col("words") / F.col("mean_words"), F.lit(1.0))))
    judged = judged.withColumn("peak", F.when(F.col("n_bytes") > 0, F.exp("peak"))).withColumn("peak_limit", F.exp("peak_limit"))
    kept = F.coalesce((F.col("perplexity") <= F.col("perplexity_limit")) & (F.col("peak") <= F.col("peak_limit")), F.lit(True)) & F.coalesce(F.col("spread") >= F.col("spread_limit"), F.lit(True))
    named = F.when(F.col("lang") != NO_LANG, F.col("lang"))
    return judged.select("doc_id", named.alias("lang"), "n_bytes", "perplexity", "peak", "spread", "perplexity_limit", "peak_limit", "spread_limit", kept.alias("kept"), "mark")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """The documents that are not rejected, all columns kept. Copies of a row share their verdict."""
    bad = classify(docs, labels, id_col, text_col, lang_col, quantile).where("NOT kept").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    mark = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col), F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)))
    marked = docs.withColumn("_at", mark)
    return marked.join(bad, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_at") == F.col("_mark")), "left_anti").drop("_at")
