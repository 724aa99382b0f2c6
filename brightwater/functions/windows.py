"""Window expressions with ROWS, RANGE and GROUPS frames and EXCLUDE.

Spark has ROWS and RANGE frames; those make plain Columns, which any arithmetic takes. A GROUPS frame
becomes a RANGE frame over the dense rank of the order. Exclusions of sum, count and avg are algebra
over running windows: the frame, less the part of it that the row's peers (or the row) make up, plus
the row for TIES. Those of min and max combine the frames before and behind the excluded rows; only
where these can't be told by rows or groups (value ranges of min and max) is the frame gathered.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dialect import literal, quote_name, translate
from .expr import as_column, col

UNBOUNDED = "unbounded"
CURRENT = "current"


def order_columns(order: object) -> list[Column]:
    """Names, Columns, or {"asc"|"desc": name(s)} to sort columns; nulls come last either way."""
    if order is None:
        return []
    if isinstance(order, Mapping):
        order = [(way, c) for way, cs in order.items() for c in ([cs] if isinstance(cs, (str, Column)) else cs)]
    elif isinstance(order, (str, Column)):
        order = [order]
    out = []
    for o in order:
        way, c = o if isinstance(o, tuple) else ("asc", o)
        if isinstance(c, Column):
            out.append(c if not isinstance(o, tuple) else (c.desc_nulls_last() if way == "desc" else c.asc_nulls_last()))
        else:
            out.append(col(c).desc_nulls_last() if way == "desc" else col(c).asc_nulls_last())
    return out


@dataclass(frozen=True)
class Over:
    """``expr`` over a window; ``frame`` is (rows|range|groups, start, end), ends are whole numbers (in a
    range also other numbers and timedeltas), "current" or "unbounded"; ``exclude`` is current, group,
    ties or no_others. It becomes a column by itself, in ``mutate``."""

    expr: object
    partition_by: Sequence[str] = ()
    order_by: object = None
    frame: tuple | None = None
    exclude: str | None = None
    kind: str | None = field(default=None)  # sum, count, avg, min or max: needed with exclude

    @property
    def keys(self) -> list[Column]:
        parts = [self.partition_by] if isinstance(self.partition_by, str) else list(self.partition_by or ())
        return [p if isinstance(p, Column) else col(p) for p in parts]


def over(expr: object, partition_by: Sequence[str] | str = (), order_by: object = None, frame: tuple | None = None, exclude: str | None = None, kind: str | None = None) -> Over | Column:
    """A Column, or for GROUPS frames and exclusions an ``Over`` that ``mutate`` takes."""
    if frame and frame[0] not in ("rows", "range", "groups"):
        raise ValueError(f"unknown frame {frame[0]!r}")
    if exclude not in (None, "current", "group", "ties", "no_others"):
        raise ValueError(f"unknown exclusion {exclude!r}")
    spec = Over(expr, partition_by, order_by, frame, exclude, kind)
    if exclude not in (None, "no_others") or (frame and frame[0] == "groups"):
        return spec
    return _plain_window(spec)


def _plain_window(spec: Over) -> Column:
    if spec.frame and any(isinstance(x, (float, Decimal, dt.timedelta)) for x in spec.frame[1:]):
        return _range_text(spec)
    expr, order = as_column(spec.expr), order_columns(spec.order_by)
    if not order and _needs_order(expr):
        order = [F.monotonically_increasing_id()]
    window = Window.partitionBy(*spec.keys)
    window = window.orderBy(*order) if order else window
    if spec.frame:
        lo, hi = _bound(spec.frame[1], True), _bound(spec.frame[2], False)
        window = window.rowsBetween(lo, hi) if spec.frame[0] == "rows" else window.rangeBetween(lo, hi)
    return expr.over(window)


def _range_text(spec: Over) -> Column:
    """A range over numbers or time, which only SQL text can say: the expression, keys and order must be text."""
    if spec.frame[0] != "range" or not isinstance(spec.expr, str):
        raise ValueError("such bounds need a range frame and an expression as text")
    keys = [spec.partition_by] if isinstance(spec.partition_by, str) else list(spec.partition_by or ())
    order = spec.order_by
    if isinstance(order, Mapping):
        order = [(way, c) for way, cs in order.items() for c in ([cs] if isinstance(cs, str) else cs)]
    order = [order] if isinstance(order, (str, tuple)) else list(order or ())
    order = [o if isinstance(o, tuple) else ("asc", o) for o in order]

    def bound(x: object, way: str) -> str:
        if x == UNBOUNDED:
            return f"UNBOUNDED {way}"
        if x in (CURRENT, 0):
            return "CURRENT ROW"
        if isinstance(x, dt.timedelta):
            size, ahead = f"INTERVAL '{abs(x) // dt.timedelta(microseconds=1) / 10**6:.6f}' SECOND", x > dt.timedelta(0)
        else:
            size, ahead = literal(Decimal(str(abs(x)))), x > 0
        return f"{size} {'FOLLOWING' if ahead else 'PRECEDING'}"

    parts = f"PARTITION BY {', '.join(map(quote_name, keys))} " if keys else ""
    by = ", ".join(f"{quote_name(c)} {way} NULLS LAST" for way, c in order)
    return F.expr(f"{translate(spec.expr)} OVER ({parts}ORDER BY {by} RANGE BETWEEN {bound(spec.frame[1], 'PRECEDING')} AND {bound(spec.frame[2], 'FOLLOWING')})")


def _bound(value: object, first: bool) -> int:
    if value == UNBOUNDED:
        return Window.unboundedPreceding if first else Window.unboundedFollowing
    return 0 if value in (CURRENT, 0) else int(value)


def _needs_order(expr: Column) -> bool:
    return any(f"{n}(" in str(expr).lower() for n in ("row_number", "rank", "dense_rank", "ntile", "lag", "lead", "percent_rank", "cume_dist", "nth_value"))


def add_window(df: DataFrame, name: str, spec: Over) -> DataFrame:
    """``df`` with the window expression as column ``name``."""
    expr, order = as_column(spec.expr), order_columns(spec.order_by)
    if not order and _needs_order(expr):
        order = [F.monotonically_increasing_id()]
    base = Window.partitionBy(*spec.keys)
    ordered = base.orderBy(*order) if order else base
    work, drop, window = df, [], ordered
    if spec.frame:
        kind, lo, hi = spec.frame[0], _bound(spec.frame[1], True), _bound(spec.frame[2], False)
        if kind == "rows":
            window = ordered.rowsBetween(lo, hi)
        elif kind == "range":
            window = ordered.rangeBetween(lo, hi)
        else:
            work = work.withColumn("__rank", F.dense_rank().over(ordered).cast("long"))
            drop.append("__rank")
            window = base.orderBy("__rank").rangeBetween(lo, hi)
    if spec.exclude in (None, "no_others"):
        return work.withColumn(name, expr.over(window)).drop(*drop)
    if spec.kind not in ("sum", "count", "avg", "min", "max"):
        raise ValueError("exclude needs kind: sum, count, avg, min or max of the expression")
    if spec.kind in ("sum", "count", "avg"):
        return _without(work, name, spec, expr, base, ordered, window).drop(*drop)
    parts = _around(spec, base, ordered)
    if parts is not None:
        pick, best = (F.min, F.least) if spec.kind == "min" else (F.max, F.greatest)
        names = {"__peer": F.dense_rank().over(ordered).cast("long"), "__rn": F.row_number().over(ordered)}
        work = work.withColumns({k: v for k, v in names.items() if k == parts[0]})
        found = [pick(expr).over(w) for w in parts[1]]
        if spec.exclude == "ties":
            found.append(expr)
        return work.withColumn(name, best(*found) if len(found) > 1 else found[0] if found else F.lit(None).cast("double")).drop(parts[0], *drop)
    work = work.withColumn("__rn", F.row_number().over(ordered)).withColumn("__peer", F.dense_rank().over(ordered)).withColumn("__v", expr)
    drop += ["__rn", "__peer", "__v", "__frame"]
    if spec.frame and spec.frame[0] == "rows":
        window = base.orderBy("__rn").rowsBetween(lo, hi)
    work = work.withColumn("__frame", F.collect_list(F.struct("__rn", "__peer", "__v")).over(window))
    out_of = {
        "current": lambda x: x["__rn"] != F.col("__rn"),
        "group": lambda x: x["__peer"] != F.col("__peer"),
        "ties": lambda x: (x["__peer"] != F.col("__peer")) | (x["__rn"] == F.col("__rn")),
    }[spec.exclude]
    kept = F.filter(F.transform(F.filter("__frame", out_of), lambda x: x["__v"]), lambda v: v.isNotNull())
    size = F.size(kept)
    added = F.aggregate(kept, F.lit(0.0), lambda a, v: a + v)
    value = {"sum": F.when(size > 0, added), "count": size.cast("long"), "avg": F.when(size > 0, added / size), "min": F.array_min(kept), "max": F.array_max(kept)}[spec.kind]
    return work.withColumn(name, value).drop(*drop)


def _without(work: DataFrame, name: str, spec: Over, expr: Column, base, ordered, window) -> DataFrame:
    """sum, count or avg of a frame less its excluded rows."""
    total, n = F.sum(expr).over(window), F.count(expr).over(window)
    kind, lo, hi = (spec.frame[0], _bound(spec.frame[1], True), _bound(spec.frame[2], False)) if spec.frame else ("range", Window.unboundedPreceding, 0 if spec.order_by else Window.unboundedFollowing)
    own, one = F.coalesce(expr, F.lit(0)), F.when(expr.isNotNull(), 1).otherwise(0)
    held = lo <= 0 <= hi  # the row, and for ranges and groups all of its peers, are in the frame
    if spec.exclude == "current":
        gone, gone_n = (own, one) if held else (F.lit(0), F.lit(0))
    else:
        work = work.withColumn("__peer", F.dense_rank().over(ordered))
        peers = Window.partitionBy(*spec.keys, "__peer")
        if kind == "rows":  # peers are neighbours, so the frame's part of them is a frame among them
            work = work.withColumn("__rn", F.row_number().over(ordered))
            peers = peers.orderBy("__rn").rowsBetween(lo, hi)
        gone, gone_n = (F.coalesce(F.sum(expr).over(peers), F.lit(0)), F.count(expr).over(peers)) if held or kind == "rows" else (F.lit(0), F.lit(0))
        if spec.exclude == "ties" and held:
            gone, gone_n = gone - own, gone_n - one
    work = work.withColumns({"__total": total, "__n": n, "__gone": gone, "__gone_n": gone_n})
    rest_n = F.col("__n") - F.col("__gone_n")
    rest = F.when(rest_n > 0, F.col("__total") - F.col("__gone"))
    value = {"sum": rest, "count": rest_n.cast("long"), "avg": rest / F.when(rest_n > 0, rest_n)}[spec.kind]
    return work.withColumn(name, value).drop("__peer", "__rn", "__total", "__n", "__gone", "__gone_n")


def _around(spec: Over, base, ordered) -> tuple[str, list] | None:
    """The frames before and behind the excluded rows, over row numbers or peer ranks; None if neither can say them."""
    kind, first, last = spec.frame or ("range", UNBOUNDED, CURRENT if spec.order_by else UNBOUNDED)
    lo, hi = _bound(first, True), _bound(last, False)
    by_groups = kind == "groups" or (kind == "range" and {first, last} <= {UNBOUNDED, CURRENT, 0})
    if spec.exclude == "current" and kind == "rows":
        key, frame = "__rn", lambda a, b: base.orderBy("__rn").rowsBetween(a, b)
    elif spec.exclude in ("group", "ties") and by_groups and (spec.exclude == "group" or lo <= 0 <= hi):
        key, frame = "__peer", lambda a, b: base.orderBy("__peer").rangeBetween(a, b)
    else:
        return None
    return key, [frame(a, b) for a, b in ((lo, min(hi, -1)), (max(lo, 1), hi)) if a <= b]
