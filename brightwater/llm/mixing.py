"""Mixing sources to target weights by systematic sampling.

Only DataFrame operations: no Python runs on the executors.

Sizes. A document's size is its number of words, runs of characters other than space and the
control characters 9 to 13 (null text: 0).

Targets. Sources in code-point order, null last, weigh ``weights``, repeating. They share
``budget`` times all words; a target stops at ``max_epochs`` times its source's words and the excess
goes to the others by weight until none is above. This water filling has a closed form: order the
sources by cap per weight; those before the first whose fair level fits are capped, the rest get
weight times that level.

Sampling. A document of a source with target t and size s has t / s expected copies. With the
documents of a source in (size, id) order, running sums of the expected copies plus one random offset
of the source give each document as many copies as integers are passed. Since neighbours in the
order have about the same size, the words taken stay within about one document of the target, and
no document passes ``ceil(t / s) <= max_epochs`` integers. The offset comes from a hash of (seed,
source), so reruns agree.

Scale. The text is read once, to count words. What is shuffled is (id, source, size). A hot source
is dealt over all partitions by range of (source, size, id), and ranks come from partition totals.

Cases. Null or empty text: size 0, taken 0. Very long texts: counted whole. A source without words: target 0. Empty table: empty
result. Null ids order last. Repeated rows are documents of their own. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SharedTables, prefix_sums, row_key

SEED = "brightwater-mix"


def word_count(text: Column) -> Column:
    """Runs of characters other than [\\x20\\x09-\\x0D]; null: 0."""
    plain = F.trim(F.translate(text, "\t\n\x0b\f\r", "     "))
    return F.when(text.isNull() | (plain == ""), F.lit(0)).otherwise(F.size(F.split(plain, " +"))).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """(source, size) rows to one row per source: source_size, target."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_at") - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("_at", F.row_number().over(order)).withColumn("_w", pick)
    per = per.withColumn("_cap", max_epochs * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    by_ratio = Window.orderBy("_ratio", "_at")
    done = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (
        per.withColumn("_sum", budget * F.sum("source_size").over(whole))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(done), F.lit(0.0)))
        .withColumn("_open", F.sum("_w").over(rest))
        .withColumn("_level", (F.col("_sum") - F.col("_capped")) / F.col("_open"))
    )
    # the first source, by cap per weight, whose cap is not reached fixes the level of all later ones
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_at", "_level"))).over(whole)
    per = per.withColumn("_found", level)
    target = F.least("_cap", F.coalesce(F.col("_w") * F.col("_found._level"), F.col("_cap")))
    return per.select("source", "source_size", target.alias("target"))


def source_offset(source: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from a hash of the seed and the source."""
    digest = F.md5(F.concat(F.lit(seed), F.when(source.isNull(), F.lit("|null")).otherwise(F.concat(F.lit("|="), source))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, max_epochs: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, row_key: str | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    ``row_key`` names a further column that is carried along (a row's own key, for joining back).
    """
    tables = SharedTables(docs.sparkSession, "mix")
    extra = [F.col(row_key).alias("row_key")] if row_key else []
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.lit(1).cast("long").alias("_one"), *extra)
    ranked = prefix_sums(tables, sizes, ["size", "doc_id"], {"_rank": "_one"}, ["source"])
    read = docs.sparkSession.read.schema(sizes.schema).parquet(tables.path("ranged"))
    targets = source_targets(read, weights, budget, max_epochs)
    placed = ranged_join(ranked, targets)
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    u = source_offset(F.col("source"), seed)
    copies = F.floor(step * (F.col("_rank") + 1) + u) - F.floor(step * F.col("_rank") + u)
    return placed.withColumn("copies", copies.cast("long")).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["row_key"] if row_key else []))


def ranged_join(ranked: DataFrame, targets: DataFrame) -> DataFrame:
    """Attach each source's totals; the join may split a hot source (one row on the other side)."""
    return ranked.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.*", "t.source_size", "t.target")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, max_epochs: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The documents of the mix, each row as often as it is taken, all columns kept.

    Rows meet their number of copies by 128 bits over all columns; rows equal in all columns pool theirs.
    """
    keyed = docs.withColumn("_key", F.struct(*row_key(*docs.columns)))
    taken = mix(keyed, weights, budget, max_epochs, id_col, text_col, source_col, seed, row_key="_key")
    times = taken.groupBy(F.col("row_key").alias("_key")).agg(F.sum("copies").alias("_times")).where("_times > 0")
    rows = keyed.dropDuplicates(["_key"]).join(times, "_key")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select(*docs.columns)
