"""As-of joins: for each left row the single nearest right row in time.

Both sides are unioned and ordered by (by, side) inside each key group; a running ``last`` of the right
rows gives the match, so the join is one shuffle and linear, never a product. Groups that are too
large for one task, or no equality keys at all, are cut into ranges of ``by``: each range finds its
matches on its own, and rows that find none take the last right row of the nearest earlier range, of
which there is one per (group, range). Large inputs are looked at for such groups before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import col

OPERATORS = (">=", ">", "<=", "<")


def _range_of(df: DataFrame, by: str, ranges: int) -> Column:
    """The number of the range of ``by``, from approximate quantiles over all rows."""
    value = col(by).cast("double") if dict(df.dtypes)[by] not in ("timestamp", "timestamp_ntz", "date") else F.unix_micros(col(by).cast("timestamp")).cast("double")
    cuts = df.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 1000).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    if not cuts:
        return F.lit(0)
    bounds, steps = F.array(*[F.lit(c) for c in cuts]), len(cuts).bit_length()
    state = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    def halve(a: Column, _: Column) -> Column:
        middle = F.floor((a["lo"] + a["hi"]) / 2)
        return F.when(a["lo"] >= a["hi"], a).when(F.get(bounds, middle.cast("int")) <= value, state(middle + 1, a["hi"])).otherwise(state(a["lo"], middle))

    # the number of cuts that are not greater, by halving
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state(F.lit(0), F.lit(len(cuts))), halve, lambda a: a["lo"])


HOT_BYTES, HOT_ROWS = 1 << 30, 5_000_000


def _ranges_for(left: DataFrame, right: DataFrame, on: list[str]) -> int:
    """1 while no group of the keys is too large for one task, else as many ranges as its rows need.

    Inputs that the optimizer estimates under ``HOT_BYTES`` can't have such a group, so nothing is run for them.
    """
    size = sum(int(str(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for d in (left, right))
    if size < HOT_BYTES:
        return 1
    keys = left.select(*map(col, on)).unionAll(right.select(*map(col, on)))
    most = keys.groupBy(*map(col, on)).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return 1 + most // HOT_ROWS


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], by: tuple[str, str], how: str = "inner", suffix: str = "_right", ranges: int | None = None) -> DataFrame:
    """``by`` is (column, operator): left.by operator right.by. Null keys and null ``by`` never match."""
    column, op = by
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op!r}, one of {', '.join(OPERATORS)}")
    if how not in ("inner", "left"):
        raise ValueError(f"as-of joins are inner or left, not {how!r}")
    on = list(on)
    if ranges is None:
        ranges = _ranges_for(left, right, on) if on else int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    backward = op in (">=", ">")
    names = [c for c in right.columns if c not in on]
    renamed = {c: f"{c}{suffix}" if c in left.columns else c for c in names}
    payload = F.struct(*[col(c).alias(c) for c in names])
    usable = right.where(col(column).isNotNull())
    for k in on:
        usable = usable.where(col(k).isNotNull())
    l_rows = left.select(*[col(k).alias(f"__k{i}") for i, k in enumerate(on)], col(column).alias("__by"), F.lit(1).alias("__side"), F.struct(*[col(c).alias(c) for c in left.columns]).alias("__left"), F.lit(None).cast(usable.select(payload.alias("p")).schema["p"].dataType).alias("__right"))
    r_rows = usable.select(*[col(k).alias(f"__k{i}") for i, k in enumerate(on)], col(column).alias("__by"), F.lit(2).alias("__side"), F.lit(None).cast(l_rows.schema["__left"].dataType).alias("__left"), payload.alias("__right"))
    both = l_rows.unionByName(r_rows)
    # at equal times a right row stands before the left ones for >= and <=, behind them for > and <
    side = F.col("__side").desc() if op in (">=", "<=") else F.col("__side").asc()
    time = F.col("__by").asc_nulls_last() if backward else F.col("__by").desc_nulls_last()
    keys = [F.col(f"__k{i}") for i in range(len(on))]
    if ranges > 1:
        both = both.withColumn("__range", _range_of(both, "__by", ranges))
        keys_in = [*keys, F.col("__range")]
    else:
        keys_in = keys
    order = [time, side, F.to_json("__right")] if not on else [time, side]
    window = Window.partitionBy(*keys_in).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    matched = both.withColumn("__match", F.last("__right", ignorenulls=True).over(window))
    if ranges > 1:
        pick = F.max_by if backward else F.min_by
        ends = both.where("__side = 2").groupBy(*keys_in).agg(pick("__right", "__by").alias("__end"))
        near = Window.partitionBy(*keys).orderBy(F.col("__range").asc() if backward else F.col("__range").desc()).rowsBetween(Window.unboundedPreceding, -1)
        grid = both.select(*keys_in).distinct().join(ends, [f"__k{i}" for i in range(len(on))] + ["__range"], "left")
        carried = grid.withColumn("__carry", F.last("__end", ignorenulls=True).over(near)).drop("__end")
        matched = matched.where("__side = 1").join(carried, [f"__k{i}" for i in range(len(on))] + ["__range"], "left").withColumn("__match", F.coalesce("__match", "__carry"))
    # null keys and null times find nothing
    found = F.col("__by").isNotNull()
    for k in keys:
        found = found & k.isNotNull()
    matched = matched.where("__side = 1").withColumn("__match", F.when(found, F.col("__match")))
    if how == "inner":
        matched = matched.where("__match IS NOT NULL")
    return matched.select(*[F.col("__left")[c].alias(c) for c in left.columns], *[F.col("__match")[c].alias(renamed[c]) for c in names])
