"""Pivots."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import quote_name, translate
from ..functions.expr import col


def pivot_wider(df: DataFrame, names_from: str, values_from: str, agg: str = "sum") -> DataFrame:
    """One column per distinct non-null name, in sorted order; all other columns are the group keys."""
    keys = [c for c in df.columns if c not in (names_from, values_from)]
    limit = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
    names = [r[0] for r in df.select(names_from).where(col(names_from).isNotNull()).distinct().orderBy(names_from).limit(limit + 1).collect()]
    if len(names) > limit:
        raise ValueError(f"more than {limit} columns from {names_from!r}")
    expr = F.expr(translate(f"{agg}({quote_name(values_from)})"))
    wide = df.groupBy(*[col(k) for k in keys]).pivot(names_from, names).agg(expr) if names else df.select(*[col(k) for k in keys]).distinct()
    if re.fullmatch(r"count", agg.strip(), re.IGNORECASE) and names:
        wide = wide.na.fill(0, [c for c in wide.columns if c not in keys])
    return wide


def pivot_longer(df: DataFrame, cols: Sequence[str], names_to: str = "name", values_to: str = "value") -> DataFrame:
    """One row per row and column of ``cols``; null values give none."""
    keep = [col(c) for c in df.columns if c not in cols]
    return df.unpivot(keep, [col(c) for c in cols], names_to, values_to).where(col(values_to).isNotNull())
