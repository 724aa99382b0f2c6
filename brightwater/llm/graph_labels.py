"""Connected components of a link table, as DataFrame iterations over shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SharedTables


def component_labels(tables: SharedTables, links: DataFrame, name: str) -> DataFrame:
    """(key, label) for every key in ``links`` (x, y): label is the smallest key that is reachable.

    Each round takes the least label among neighbours, then the label of that label (pointer
    jumping), so chains shorten geometrically. Rounds are written to the shared folder, which cuts
    lineage; only the number of changed rows comes to the driver.
    """
    both = tables.write(links.select("x", "y").union(links.select(F.col("y"), F.col("x"))).distinct(), f"{name}_edges")
    labels = tables.write(both.groupBy("x").agg(F.least("x", F.min("y")).alias("label")).withColumnRenamed("x", "key"), f"{name}_0")
    n = 0
    while True:
        n += 1
        near = both.join(labels.withColumnRenamed("key", "y"), "y").groupBy(F.col("x").alias("key")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "key").select("key", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("key").alias("label"), F.col("label").alias("next"))
        new = lower.join(jump, "label", "left").select("key", "old", F.least("label", F.coalesce("next", "label")).alias("label"))
        written = tables.write(new, f"{name}_{n}")
        changed = written.where("old <> label").limit(1).count()
        tables.drop(f"{name}_{n - 1}")
        labels = written.select("key", "label")
        if not changed:
            return labels
