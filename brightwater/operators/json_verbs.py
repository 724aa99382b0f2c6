"""JSON verbs on text columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import literal, quote_name
from ..functions.expr import col

MOST_KEYS = 100


def _path(path: str) -> str:
    return path if path.startswith("$") else f"$.{path}"


def extract(df: DataFrame, column: str, fields: Mapping[str, str]) -> DataFrame:
    """Add one text column per field; missing and JSON null are null, objects stay JSON text."""
    return df.withColumns({out: F.get_json_object(col(column), _path(path)) for out, path in fields.items()})


def unnest(df: DataFrame, column: str, path: str | None = None, as_: str | None = None) -> DataFrame:
    """One row per array element or object value, as JSON text; empty and null give no rows."""
    text = f"get_json_object({quote_name(column)}, {literal(_path(path))})" if path else quote_name(column)
    out = as_ or f"{column}_value"
    parsed = df.withColumn("__json", F.expr(f"try_parse_json({text})")).where("__json IS NOT NULL")
    spread = parsed.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("__json").outer()).select(F.to_json("value").alias("__value")))
    return spread.select(*[col(c) for c in df.columns], F.col("__value").alias(out))


def expand(df: DataFrame, column: str, most: int = MOST_KEYS) -> DataFrame:
    """One text column per distinct top-level key, in order of name; finding the keys runs a job. More than ``most`` keys are an error."""
    keys = df.where(col(column).isNotNull()).select(F.explode(F.json_object_keys(col(column))).alias("k")).distinct().orderBy("k").limit(most + 1)
    found = [r["k"] for r in keys.collect()]
    if len(found) > most:
        raise ValueError(f"{column!r} has more than {most} keys: name the ones wanted with json_extract, or raise most")
    return df.withColumns({k: F.get_json_object(col(column), f"$['{k}']" if not k.isidentifier() else f"$.{k}") for k in found})
