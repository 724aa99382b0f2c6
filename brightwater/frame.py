"""The lazy frame: an immutable wrapper around one Spark DataFrame and its pending group columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.expr import as_column, col, sql
from .functions.windows import Over, add_window, order_columns
from .operators import asof as _asof
from .operators import fts as _fts
from .operators import json_verbs as _json
from .operators import reshape as _reshape
from .plans.display import table_text
from .plans.events import span
from .sources import io as _io

JOINS = {"inner": "inner", "left": "left", "right": "right", "cross": "cross", "semi": "left_semi", "anti": "left_anti"}


def _names(cols: tuple) -> list[str]:
    flat: list[str] = []
    for c in cols:
        flat += [c] if isinstance(c, str) else list(c)
    return flat


class Frame:
    """A lazy table. Verbs return new frames; nothing runs before a verb that needs rows."""

    def __init__(self, df: DataFrame, groups: Sequence[str] = ()):
        self.df, self.groups = df, tuple(groups)

    # sources

    @classmethod
    def from_query(cls, spark: SparkSession, text: str) -> Frame:
        return cls(_io.from_query(spark, text))

    @classmethod
    def from_list(cls, spark: SparkSession, rows: Sequence[Mapping[str, object]]) -> Frame:
        return cls(_io.from_list(spark, rows))

    @classmethod
    def from_csv(cls, spark: SparkSession, path: str, **opts: object) -> Frame:
        return cls(_io.from_csv(spark, path, **opts))

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str | Sequence[str], **opts: object) -> Frame:
        return cls(_io.from_parquet(spark, path, **opts))

    @classmethod
    def from_ndjson(cls, spark: SparkSession, path: str) -> Frame:
        return cls(_io.from_ndjson(spark, path))

    @classmethod
    def from_excel(cls, spark: SparkSession, path: str, **opts: object) -> Frame:
        return cls(_io.from_excel(spark, path, **opts))

    @classmethod
    def from_attached(cls, spark: SparkSession, db: str, table: str, **opts: object) -> Frame:
        return cls(_io.ATTACHED.from_attached(spark, db, table, **opts))

    @classmethod
    def from_arrow(cls, spark: SparkSession, table: object) -> Frame:
        return cls(spark.createDataFrame(table))

    # rows and columns

    def _with(self, df: DataFrame) -> Frame:
        return Frame(df, self.groups)

    def _need(self, names: Sequence[str]) -> None:
        have = {c.lower() for c in self.df.columns}
        missing = [n for n in names if n.lower() not in have]
        if missing:
            raise ValueError(f"no such columns: {', '.join(missing)}")

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def select(self, *cols: object) -> Frame:
        names = _names(cols)
        self._need(names)
        return self._with(self.df.select(*[col(c) for c in names]))

    def discard(self, *cols: object) -> Frame:
        """All columns but these; a name that is not there is an error."""
        names = _names(cols)
        self._need(names)
        return self._with(self.df.drop(*names))

    def filter(self, *conditions: Column) -> Frame:
        df = self.df
        for c in conditions:
            df = df.filter(as_column(c))
        return self._with(df)

    def filter_with(self, text: str, *pins: object, **named: object) -> Frame:
        """Dialect text; ``$1`` or ``:name`` stand for values."""
        return self._with(self.df.filter(sql(text, *pins, **named)))

    def drop_nil(self, *cols: object) -> Frame:
        """Rows where all these columns have a value (nan is a value)."""
        names = _names(cols)
        self._need(names)
        df = self.df
        for c in names:
            df = df.filter(col(c).isNotNull())
        return self._with(df)

    def mutate(self, **exprs: object) -> Frame:
        """Add or replace columns, in order; later ones see earlier ones. Windows come from ``over``."""
        df = self.df
        for name, e in exprs.items():
            df = add_window(df, name, e) if isinstance(e, Over) else df.withColumn(name, as_column(e))
        return self._with(df)

    mutate_with = mutate

    def rename(self, mapping: Mapping[str, str] | None = None, **named: str) -> Frame:
        """old=new; columns keep their places, groups follow."""
        m = {**(mapping or {}), **named}
        self._need(list(m))
        return Frame(self.df.withColumnsRenamed(m), [m.get(g, g) for g in self.groups])

    def sort_by(self, *order: object, **ways: object) -> Frame:
        """Names (ascending), ("desc", name) pairs, or asc=/desc= lists; nulls come last either way."""
        spec: list = []
        for o in order:
            spec += order_columns(o if isinstance(o, (str, Mapping, Column)) else [o] if isinstance(o, tuple) else list(o))
        spec += order_columns(ways) if ways else []
        return self._with(self.df.orderBy(*spec))

    def head(self, n: int = 10) -> Frame:
        return self._with(self.df.limit(n))

    def slice(self, offset: int, length: int) -> Frame:
        return self._with(self.df.offset(offset).limit(length))

    def distinct(self, *cols: object) -> Frame:
        """Distinct rows, or one whole row (any) for each value of ``cols``."""
        names = _names(cols)
        self._need(names)
        return self._with(self.df.dropDuplicates(names) if names else self.df.distinct())

    # groups

    def group_by(self, *cols: object) -> Frame:
        names = _names(cols)
        self._need(names)
        return Frame(self.df, names)

    def ungroup(self) -> Frame:
        return Frame(self.df)

    def summarise(self, **aggs: object) -> Frame:
        """One row per group (null is a group), or one row in all; groups are cleared."""
        exprs = [as_column(e).alias(n) for n, e in aggs.items()]
        if not self.groups:
            return Frame(self.df.agg(*exprs))
        return Frame(self.df.groupBy(*[col(g) for g in self.groups]).agg(*exprs))

    summarise_with = summarise

    def cube(self, *cols: str, **aggs: object) -> Frame:
        return Frame(self.df.cube(*[col(c) for c in cols]).agg(*[as_column(e).alias(n) for n, e in aggs.items()]))

    def rollup(self, *cols: str, **aggs: object) -> Frame:
        return Frame(self.df.rollup(*[col(c) for c in cols]).agg(*[as_column(e).alias(n) for n, e in aggs.items()]))

    # two frames

    def join(self, other: Frame, on: object = None, how: str = "inner", suffix: str = "_right", hint: str | None = None) -> Frame:
        """Equality joins. ``on``: a name, names, or (left, right) pairs; equal names give one key column.

        Other columns of the same name get ``suffix`` on the right. ``hint``: broadcast, merge,
        shuffle_hash; without one, sizes and adaptive execution decide.
        """
        if how not in JOINS:
            raise ValueError(f"unknown join {how!r}, one of {', '.join(JOINS)}")
        left, right = self.df, other.df.hint(hint) if hint else other.df
        if how != "cross" and not on:
            raise ValueError(f"a join of kind {how} needs on")
        pairs = [(o, o) if isinstance(o, str) else tuple(o) for o in ([on] if isinstance(on, str) or (isinstance(on, tuple) and len(on) == 2 and all(isinstance(x, str) for x in on)) else on or ())]
        self._need([p[0] for p in pairs])
        other._need([p[1] for p in pairs])
        if how in ("semi", "anti"):
            keys = right.select(*[col(r).alias(f"__k{i}") for i, (_, r) in enumerate(pairs)])
            cond = [col(lname) == F.col(f"__k{i}") for i, (lname, _) in enumerate(pairs)]
            return self._with(left.join(keys, cond, JOINS[how]))
        using = bool(pairs) and all(a == b for a, b in pairs)
        keys = [a for a, _ in pairs] if using else []
        taken = {c.lower() for c in left.columns}
        right = right.select(*[col(c).alias(c if c in keys or c.lower() not in taken else f"{c}{suffix}") for c in right.columns])
        if how == "cross":
            return self._with(left.crossJoin(right))
        if using:
            return self._with(left.join(right, keys, JOINS[how]))
        cond = [col(a) == col(b if b.lower() not in taken else f"{b}{suffix}") for a, b in pairs]
        return self._with(left.join(right, cond, JOINS[how]))

    def broadcast_join(self, other: Frame, on: object, how: str = "inner", threshold: int = 256 << 20, suffix: str = "_right") -> Frame:
        """Broadcast ``other`` if the optimizer's size estimate is at most ``threshold`` bytes, else let Spark choose."""
        return self.join(other, on, how, suffix, hint="broadcast" if should_broadcast(other, threshold) else None)

    def asof_join(self, other: Frame, by: tuple[str, str], on: object = (), how: str = "inner", suffix: str = "_right", ranges: int | None = None) -> Frame:
        names = _names((on,)) if on else []
        self._need([*names, by[0]])
        other._need([*names, by[0]])
        return self._with(_asof.asof_join(self.df, other.df, names, by, how, suffix, ranges))

    def concat_rows(self, *others: Frame, by_name: bool = False) -> Frame:
        df = self.df
        for o in others:
            df = df.unionByName(o.df) if by_name else df.union(o.df)
        return self._with(df)

    def union_distinct(self, other: Frame) -> Frame:
        return self._with(self.df.union(other.df).distinct())

    def intersect(self, other: Frame) -> Frame:
        return self._with(self.df.intersect(other.df))

    def except_(self, other: Frame) -> Frame:
        return self._with(self.df.subtract(other.df))

    # shape

    def pivot_wider(self, names_from: str, values_from: str, agg: str = "sum") -> Frame:
        self._need([names_from, values_from])
        return Frame(_reshape.pivot_wider(self.df, names_from, values_from, agg))

    def pivot_longer(self, cols: Sequence[str], names_to: str = "name", values_to: str = "value") -> Frame:
        self._need(list(cols))
        return self._with(_reshape.pivot_longer(self.df, list(cols), names_to, values_to))

    def json_extract(self, column: str, fields: Mapping[str, str]) -> Frame:
        return self._with(_json.extract(self.df, column, fields))

    def json_unnest(self, column: str, path: str | None = None, as_: str | None = None) -> Frame:
        return self._with(_json.unnest(self.df, column, path, as_))

    def json_expand(self, column: str, most: int = _json.MOST_KEYS) -> Frame:
        return self._with(_json.expand(self.df, column, most))

    def fts_index(self, id_col: str, text_cols: Sequence[str] | str, **options: object) -> _fts.FtsIndex:
        return _fts.create_index(self.df, id_col, text_cols, **options)

    # results

    def compute(self, broadcast_threshold: int | None = None) -> Frame:
        """Run now and keep the rows on the executors (memory, then disk); lost parts are recomputed.

        ``broadcast_threshold``: bytes up to which this run's joins broadcast a side.
        """
        conf, key = self.df.sparkSession.conf, "spark.sql.autoBroadcastJoinThreshold"
        before = conf.get(key)
        with span(("query",), n_columns=len(self.columns)) as info:
            try:
                if broadcast_threshold is not None:
                    conf.set(key, str(broadcast_threshold))
                df = self.df.persist(StorageLevel.MEMORY_AND_DISK)
                info["n_rows"] = df.count()
            finally:
                conf.set(key, before)
        return self._with(df)

    collect = compute

    def release(self) -> None:
        self.df.unpersist()

    def to_rows(self) -> list[dict]:
        with span(("query",), n_columns=len(self.columns)) as info:
            rows = [{k: _plain(v) for k, v in r.asDict(recursive=True).items()} for r in self.df.collect()]
            info["n_rows"] = len(rows)
        return rows

    def to_columns(self) -> dict[str, list]:
        rows = self.to_rows()
        return {c: [r[c] for r in rows] for c in self.columns}

    def to_arrow(self):
        return self.df.toArrow()

    def n_rows(self) -> int:
        return self.df.count()

    def to_tensor(self, column: str) -> np.ndarray:
        """A numpy array of a numeric, date or time column without nulls."""
        self._need([column])
        kind = self.df.schema[column].dataType
        if isinstance(kind, T.BooleanType):
            raise ValueError(f"{column!r} is boolean: cast it to a number first")
        if isinstance(kind, T.DecimalType) or not isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.TimeType, T.DayTimeIntervalType)):
            raise ValueError(f"{column!r} of type {kind.simpleString()} is no tensor")
        got = self.df.select(col(column).alias("x")).toArrow()["x"]
        if got.null_count:
            raise ValueError(f"{column!r} has nulls")
        return got.to_numpy()

    def sql_preview(self) -> str:
        """The optimized plan, without running it."""
        return self.df._jdf.queryExecution().optimizedPlan().toString()

    def explain(self, mode: str = "formatted") -> None:
        self.df.explain(mode)

    def peek(self, limit: int = 5) -> str:
        return table_text(self.df, limit)

    def __repr__(self) -> str:
        kinds = ", ".join(f"{n}: {t}" for n, t in self.df.dtypes)
        return f"#Frame<lazy [{kinds}]" + (f" groups {list(self.groups)}" if self.groups else "") + ">"

    # sinks

    def to_csv(self, path: str, **opts: object) -> None:
        _io.to_csv(self.df, path, **opts)

    def to_parquet(self, path: str, **opts: object) -> None:
        _io.to_parquet(self.df, path, **opts)

    def to_ndjson(self, path: str, **opts: object) -> None:
        _io.to_ndjson(self.df, path, **opts)

    def to_excel(self, path: str) -> None:
        _io.to_excel(self.df, path)

    def insert_into(self, table: str, create: bool = False) -> None:
        _io.insert_into(self.df, table, create)

    # execution

    def distribute(self, partitions: int | None = None) -> Frame:
        """Spark runs distributed as it is; a number repartitions."""
        return self._with(self.df.repartition(partitions)) if partitions else self

    def local(self) -> Frame:
        return self


def should_broadcast(frame: Frame, threshold: int = 256 << 20) -> bool:
    """Whether the optimizer's estimate of the size is at most ``threshold`` bytes."""
    size = frame.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= threshold


def _plain(v: object) -> object:
    """Decimals as int when whole, else float."""
    if isinstance(v, Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, list):
        return [_plain(x) for x in v]
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    return v
