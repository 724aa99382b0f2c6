"""Column helpers: names, literals, conditions, concatenation and engine-style arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import quote_name, spark_type, translate


def col(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col(quote_name(name))


def lit(value: object) -> Column:
    return F.lit(value)


def sql(text: str, *pins: object, **named: object) -> Column:
    """Dialect text as a Column; ``$1`` or ``:name`` stand for values, which are never spliced as code."""
    return F.expr(translate(text, named or pins))


def as_column(value: object) -> Column:
    """Columns stay, text is dialect text, other values are literals."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return sql(value)
    return F.lit(value)


def cond(*branches: tuple[Column, object], otherwise: object = None) -> Column:
    """The value of the first branch that holds; ``True`` as a condition always holds; else ``otherwise``."""
    out: Column | None = None
    for test, value in branches:
        if test is True:
            otherwise = value
            break
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(test, v) if out is None else out.when(test, v)
    rest = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return rest if out is None else out.otherwise(rest)


def if_(test: Column, yes: object, no: object = None) -> Column:
    return cond((test, yes), otherwise=no)


def is_in(column: Column, values: Sequence[object]) -> Column:
    """Membership; never true for an empty list."""
    return column.isin(list(values)) if values else F.lit(False)


def joined(*parts: Column) -> Column:
    """Concatenation that is null if a part is."""
    return F.concat(*parts)


def div(a: Column, b: Column) -> Column:
    """Float division: by zero it gives infinity, or nan for zero by zero."""
    x, y = a.cast("double"), b.cast("double")
    by_zero = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).when(x.isNotNull(), F.lit(float("nan")))
    return F.when(y != 0, F.try_divide(x, y)).when(y.isNotNull(), by_zero)


def cast(a: Column, kind: str) -> Column:
    return a.cast(spark_type(kind).lower())
