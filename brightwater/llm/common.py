"""Shared pieces of the training-data operators.

* ``shared_dir`` / ``SharedTables``: intermediate tables go to the folder named by
  ``spark.checkpoint.dir``, which all executors and the driver reach through Spark's own file
  systems. A table written there cuts lineage and survives the loss of any executor.
* ``prefix_sums``: distributed running totals in a total order, no global window over rows.
* ``text_blocks``: walks Arrow batches in blocks of bounded bytes, so that the numpy work arrays of
  a Python worker stay small whatever the batch holds.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

BLOCK_BYTES = 1 << 21
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a local one if everything runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = spark.sparkContext.getCheckpointDir() or f"file://{tempfile.mkdtemp(prefix='brightwater-')}"
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app].rstrip("/")


TABLES_PER_RELEASE = 10


class SharedTables:
    """Parquet tables of one operator run, under one fresh folder of the shared directory.

    After every ``TABLES_PER_RELEASE`` tables of the process the driver lets go of what it holds of
    finished jobs: plans and results in its memory, and on the executors the shuffle files.
    """

    written = 0

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/brightwater/{label}-{uuid.uuid4().hex}"
        atexit.register(self._quiet_drop)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, codec: str = "snappy", partition_by: Sequence[str] = ()) -> DataFrame:
        """Write ``df`` and return the table read back (its schema is kept, also for no rows)."""
        out = df.write.option("compression", codec)
        if partition_by:
            out = out.partitionBy(*partition_by)
        out.parquet(self.path(name))
        SharedTables.written += 1
        if SharedTables.written % TABLES_PER_RELEASE == 0:
            release_shuffles(self.spark)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str | None = None) -> None:
        """Delete one table (or all): its readers must be done."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _quiet_drop(self) -> None:
        try:
            self.drop()
        except Exception:  # noqa: BLE001 - the session is gone; the folder belongs to it
            pass


def release_shuffles(spark: SparkSession) -> None:
    """Let the driver notice shuffles that nothing refers to any more, so that their files go."""
    gc.collect()  # Python's handles first
    pa.default_memory_pool().release_unused()
    spark._jvm.System.gc()


def row_key(*columns: str) -> tuple[Column, Column]:
    """``row`` and ``row2``: 128 bits that the values of ``columns`` determine (null is a value of its own)."""
    known = [F.col(f"`{c}`").isNull() for c in columns]
    values = [F.col(f"`{c}`") for c in columns]
    return F.xxhash64(*values, *known).alias("row"), F.xxhash64(F.lit("2"), *known, *values).alias("row2")


_held: list[tuple[str, Callable[[], None]]] = []


def claim(owner: str, clear: Callable[[], None]) -> None:
    """In a Python worker, which serves one operator after another: let go of the tables that the one before kept there."""
    if _held and _held[0][0] != owner:
        _held.pop()[1]()
        gc.collect()
        pa.default_memory_pool().release_unused()
    if not _held:
        _held.append((owner, clear))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def prefix_sums(tables: SharedTables, df: DataFrame, order: Sequence[str], sums: Mapping[str, str], group: Sequence[str] = (), name: str = "ranged") -> DataFrame:
    """Add each ``out`` of ``sums`` ({out: value}): the sum of ``value`` over all earlier rows of the same ``group`` in ``order``.

    The rows are dealt by range of (group, order), so a hot group spreads over many partitions; the
    totals of (group, partition) are few and get their offsets from a window over those totals; the
    last step is a window inside each (group, partition). Rows equal in ``order`` take their places
    in any order, the same for all sums. ``df`` should be narrow. Adds the columns ``_shard`` and the sums.
    """
    spark = tables.spark
    keys = [*group, *order]
    ranged = df.repartitionByRange(max(1, shuffle_partitions(spark)), *[F.col(k).asc_nulls_last() for k in keys])
    ranged = tables.write(ranged.withColumn("_shard", F.spark_partition_id()), name)
    totals = ranged.groupBy(*group, "_shard").agg(*[F.sum(value).alias(f"_total_{out}") for out, value in sums.items()])
    before = Window.partitionBy(*group).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "_shard", *[F.coalesce(F.sum(f"_total_{out}").over(before), F.lit(0)).alias(f"_before_{out}") for out in sums])
    inside = Window.partitionBy(*group, "_shard").orderBy(*[F.col(k).asc_nulls_last() for k in order]).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.select("*", *[F.coalesce(F.sum(value).over(inside), F.lit(0)).alias(f"_inside_{out}") for out, value in sums.items()])
    same = F.col("p._shard") == F.col("o._shard")
    for g in group:
        same = same & F.col(f"p.{g}").eqNullSafe(F.col(f"o.{g}"))
    # (group, partition) totals: at most partitions + groups rows
    joined = placed.alias("p").join(offsets.alias("o"), same)
    return joined.select("p.*", *[(F.col(f"_before_{out}") + F.col(f"_inside_{out}")).alias(out) for out in sums]).drop(*[f"_inside_{out}" for out in sums])


def byte_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def blocks_of(texts: Sequence[bytes | str | int | None], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` (or of their sizes) with about ``limit`` bytes each; a longer text is a block of its own."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        n = t if isinstance(t, int) else len(t or b"")
        if held and held + n > limit:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(texts):
        yield begin, len(texts)


_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds); a bijection on uint64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


KNOWN_WORDS = 400_000


class WordHashes(dict):
    """64-bit hashes of words; kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        h = xxh3_64_intdigest(word)
        if len(self) < KNOWN_WORDS:
            self[word] = h
        return h


_hashes = WordHashes()


def hash_words(words: list[bytes]) -> np.ndarray:
    claim("words", _hashes.clear)
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


_STEP = _U(0x9E3779B97F4A7C15)


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` words."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for i in range(1, length):
        h *= _STEP
        h += words[i : i + n]
    return mix64(h ^ _U(length))
