"""Session settings, the shared checkpoint folder and lineage cuts."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SIZE = re.compile(r"\d+(\.\d+)?\s*([KMGT]i?)?B?", re.IGNORECASE)


def session(app: str = "brightwater", master: str | None = None, memory_limit: str | None = None, temp_directory: str | None = None, broadcast_threshold: int | None = None, **conf: object) -> SparkSession:
    """A session in UTC with adaptive execution; limits are checked before anything starts."""
    if memory_limit is not None and not _SIZE.fullmatch(memory_limit):
        raise ValueError(f"not a memory size: {memory_limit!r}")
    if temp_directory is not None and (not temp_directory.startswith("/") or re.search(r"['\";\n\0]", temp_directory)):
        raise ValueError(f"not a directory: {temp_directory!r}")
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    # sides whose partitions turn out small are joined by hash, without sorting the other side
    b = b.config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
    if master:
        b = b.master(master)
    if memory_limit:
        b = b.config("spark.driver.memory", memory_limit.upper().replace("IB", "").replace("B", "").replace(" ", "").lower())
    if temp_directory:
        b = b.config("spark.local.dir", temp_directory)
    if broadcast_threshold is not None:
        b = b.config("spark.sql.autoBroadcastJoinThreshold", str(broadcast_threshold))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), str(v))
    return b.getOrCreate()


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where nothing is set, a local one if everything runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = f"file://{tempfile.mkdtemp(prefix='brightwater-')}"
    return _own_dirs[app]


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system that Spark reaches."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _drop_quietly(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # noqa: BLE001 - the session is gone; the folder belongs to it
        pass


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a table in the shared folder and cut its lineage there; it goes with the process."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/brightwater/cut-{uuid.uuid4().hex}"
    named = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # any name is allowed, also one that occurs twice
    named.write.parquet(path)
    atexit.register(_drop_quietly, spark, path)
    return spark.read.schema(named.schema).parquet(path).toDF(*df.columns)
