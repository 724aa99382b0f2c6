"""Loaders of small public teaching data sets from a folder of CSV files (none are shipped)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..frame import Frame
from ..operators.graph import Graph

# The files that write missing values as NA
MARKED_NA = ("penguins", "flights", "planes")
NAMES = ("penguins", "gapminder", "flights", "airlines", "airports", "planes")


def load(spark: SparkSession, name: str, folder: str) -> Frame:
    if name not in NAMES:
        raise ValueError(f"unknown data set {name!r}, one of {', '.join(NAMES)}")
    return Frame.from_csv(spark, f"{folder}/{name}.csv", **({"nullstr": "NA"} if name in MARKED_NA else {}))


def karate_club(spark: SparkSession, folder: str) -> Graph:
    """34 members; each friendship is an edge in both directions."""
    e = Frame.from_csv(spark, f"{folder}/karate_club.csv").df.selectExpr("CAST(src AS BIGINT) src", "CAST(dst AS BIGINT) dst")
    return Graph(spark.range(1, 35).toDF("id"), e.union(e.select("dst", "src")))
