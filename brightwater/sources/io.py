"""Readers and writers."""

from __future__ import annotations

import datetime as dt
import os
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dialect import quote_name, spark_type, tokens
from ..functions.expr import col
from ..plans.events import span
from ..plans.macros import query_text
from ..plans.session import delete
from . import xlsx

CSV_OPTIONS = ("delimiter", "header", "skip", "null_padding", "auto_detect", "nullstr", "types", "columns", "multiline")
EXCEL_OPTIONS = ("sheet", "range", "header", "all_varchar", "ignore_errors", "empty_as_varchar", "stop_at_empty")


def from_query(spark: SparkSession, text: str) -> DataFrame:
    return spark.sql(query_text(with_globs(spark, text)))


def files_like(spark: SparkSession, pattern: str) -> list[str]:
    """Files that match a pattern, on any file system that Spark reaches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or ())


def with_globs(spark: SparkSession, text: str) -> str:
    """``FROM glob('pattern')`` as the table (file) of what matches now."""
    toks = [x for x in tokens(text)]
    for i in range(len(toks) - 3):
        if toks[i][0] == "name" and toks[i][1].lower() == "glob" and [toks[i + 1][1], toks[i + 2][0], toks[i + 3][1]] == ["(", "string", ")"]:
            found = files_like(spark, toks[i + 2][1][1:-1].replace("''", "'"))
            rows = ", ".join("('" + f.replace("'", "''") + "')" for f in found)
            table = f"(SELECT file FROM VALUES {rows} AS g(file))" if found else "(SELECT CAST(NULL AS STRING) AS file WHERE FALSE)"
            toks[i : i + 4] = [("op", table), *[("space", "")] * 3]
    return "".join(t for _, t in toks)


def from_list(spark: SparkSession, rows: Sequence[Mapping[str, object]]) -> DataFrame:
    """Columns are the keys of the first row, sorted; no rows give a frame without columns."""
    if not rows:
        return spark.createDataFrame([], T.StructType([]))
    names = sorted(map(str, rows[0]))
    keyed = [{str(k): v for k, v in r.items()} for r in rows]
    data = [tuple(r[n] for n in names) for r in keyed]
    if any(all(r[i] is None for r in data) for i in range(len(names))):
        fields = []
        for i, n in enumerate(names):
            seen = next((r[i] for r in data if r[i] is not None), None)
            kind = spark.createDataFrame([(seen,)], [n]).schema[0].dataType if seen is not None else T.StringType()
            fields.append(T.StructField(n, kind))
        return spark.createDataFrame(data, T.StructType(fields))
    return spark.createDataFrame(data, names)


def from_csv(spark: SparkSession, path: str, **opts: object) -> DataFrame:
    """delimiter, header, skip (lines), nullstr, types ({name: type}), columns (names), auto_detect, null_padding, multiline.

    Values with line breaks need ``multiline``, with which a file is one task. By default the lines are
    looked at first: where none has an odd number of quotes, no value goes over one, and files are split.
    """
    unknown = set(opts) - set(CSV_OPTIONS)
    if unknown:
        raise ValueError(f"unknown CSV options {sorted(unknown)}")
    nulls = opts.get("nullstr", "")
    nulls = [nulls] if isinstance(nulls, str) else list(nulls)
    r = spark.read.option("header", bool(opts.get("header", True))).option("sep", opts.get("delimiter", ",")).option("inferSchema", opts.get("auto_detect", True) is not False).option("nullValue", nulls[0]).option("escape", '"').option("mode", "PERMISSIVE")
    if opts.get("skip"):
        df = _skipping(spark, r, path, int(opts["skip"]))
    else:
        multiline = opts.get("multiline")
        df = r.option("multiLine", breaks_lines(spark, path) if multiline is None else bool(multiline)).csv(path)
    if opts.get("columns"):
        df = df.toDF(*opts["columns"])
    for extra in nulls[1:]:
        df = df.replace(extra, None)
    for name, kind in dict(opts.get("types") or {}).items():
        df = df.withColumn(name, col(name).cast(spark_type(kind).lower()))
    return df


def breaks_lines(spark: SparkSession, path: str) -> bool:
    """Whether a quoted value may go over a line: some line has an odd number of quotes."""
    quotes = F.char_length("value") - F.char_length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


MOST_FILES = 100_000


def _skipping(spark: SparkSession, reader, path: str, n: int) -> DataFrame:
    """Leave out the first ``n`` lines of each file. Lines are read one by one, so none spans two."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"))
    # the first lines of a file are in its first partition: the least ids of the file
    heads = lines.groupBy("f").agg(F.min("i").alias("first"))
    few = len(spark.read.text(path).inputFiles()) <= MOST_FILES  # then a row per file may be sent to all, and lines keep their order
    kept = lines.join(F.broadcast(heads) if few else heads, "f").where(F.col("i") >= F.col("first") + n)
    kept = kept if few else kept.orderBy("i")
    texts = getattr(kept.select("value")._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(reader._jreader.csv(texts), spark)


def from_parquet(spark: SparkSession, path: str | Sequence[str], hive_partitioning: bool = True, union_by_name: bool = False) -> DataFrame:
    r = spark.read
    if union_by_name:
        r = r.option("mergeSchema", True)
    paths = [path] if isinstance(path, str) else list(path)
    if any("**" in p for p in paths):
        base = paths[0].split("**")[0].rstrip("/")
        r = r.option("basePath", base) if hive_partitioning else r.option("recursiveFileLookup", True)
        return r.parquet(base) if hive_partitioning else r.option("pathGlobFilter", os.path.basename(paths[0])).parquet(base)
    if not hive_partitioning:
        r = r.option("recursiveFileLookup", True)
    return r.parquet(*paths)


def from_ndjson(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def from_excel(spark: SparkSession, path: str, **opts: object) -> DataFrame:
    """A sheet of a workbook. A workbook is one file of bounded size (about a million rows a sheet)."""
    unknown = set(opts) - set(EXCEL_OPTIONS)
    if unknown:
        raise ValueError(f"unknown Excel options {sorted(unknown)}")
    rows = list(xlsx.clip(xlsx.read_rows(path, opts.get("sheet")), opts.get("range")))
    header = opts.get("header", True)
    if not rows:
        return spark.createDataFrame([], T.StructType([]))
    width = max(map(len, rows))
    names = [str(v) if v is not None else xlsx.column_name(i) for i, v in enumerate(rows[0] + [None] * (width - len(rows[0])))] if header else [xlsx.column_name(i) for i in range(width)]
    body = [r + [None] * (width - len(r)) for r in (rows[1:] if header else rows)]
    if opts.get("stop_at_empty", True):
        stop = next((i for i, r in enumerate(body) if all(v is None for v in r)), len(body))
        body = body[:stop]
    kinds, data = [], []
    for i in range(width):
        seen = next((r[i] for r in body if r[i] is not None), None)
        own = type(seen) if seen is not None and not opts.get("all_varchar") else str
        kinds.append(own)
    for r in body:
        data.append(tuple(_as(v, k, bool(opts.get("ignore_errors"))) for v, k in zip(r, kinds, strict=True)))
    spark_kinds = {str: T.StringType(), float: T.DoubleType(), bool: T.BooleanType(), dt.datetime: T.TimestampNTZType()}
    return spark.createDataFrame(data, T.StructType([T.StructField(n, spark_kinds[k]) for n, k in zip(names, kinds, strict=True)]))


def _as(value: object, kind: type, lenient: bool) -> object:
    if value is None or isinstance(value, kind):
        return value
    if kind is str:
        return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)
    try:
        return kind(value)
    except (TypeError, ValueError):
        if lenient:
            return None
        raise ValueError(f"{value!r} is no {kind.__name__}") from None


def _single_file(df: DataFrame, path: str, kind: str, **options: object) -> None:
    """One file at ``path``: Spark writes a folder beside it, and its one part is moved, on the target's own file system."""
    spark = df.sparkSession
    new = spark._jvm.org.apache.hadoop.fs.Path
    target, folder = new(path), f"{path}.writing-{uuid.uuid4().hex}"
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        df.coalesce(1).write.options(**options).format(kind).save(folder)
        parts = files.globStatus(new(f"{folder}/part-*")) or ()
        if len(parts) != 1:
            raise ValueError(f"write failed: {len(parts)} files in {folder}")
        files.delete(target, True)
        if not files.rename(parts[0].getPath(), target):
            raise ValueError(f"write failed: the file can't be moved to {path}")
        if files.getScheme() == "file":  # the checksum of the file that was there before
            files.delete(new(target.getParent(), f".{target.getName()}.crc"), False)
    finally:
        delete(spark, folder)


def to_csv(df: DataFrame, path: str, delimiter: str = ",", header: bool = True, single_file: bool = True) -> None:
    with span(("io", "write"), format="csv", path=path):
        options = {"sep": delimiter, "header": header, "escape": '"', "emptyValue": "", "nullValue": ""}
        _single_file(df, path, "csv", **options) if single_file else df.write.options(**options).csv(path)


def to_parquet(df: DataFrame, path: str, compression: str = "snappy", row_group_size: int | None = None, partition_by: str | Sequence[str] | None = None) -> None:
    """A Parquet folder, written in parallel; ``row_group_size`` in bytes."""
    with span(("io", "write"), format="parquet", path=path):
        w = df.write.option("compression", compression)
        if row_group_size:
            w = w.option("parquet.block.size", row_group_size)
        if partition_by:
            w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
        w.parquet(path)


def to_ndjson(df: DataFrame, path: str, single_file: bool = True) -> None:
    with span(("io", "write"), format="ndjson", path=path):
        _single_file(df, path, "json", ignoreNullFields=False) if single_file else df.write.option("ignoreNullFields", False).json(path)


def to_excel(df: DataFrame, path: str) -> None:
    """Rows stream through the driver into the workbook; they are never all held."""
    with span(("io", "write"), format="excel", path=path):
        xlsx.write_rows(path, df.columns, (tuple(r) for r in df.toLocalIterator()))


def insert_into(df: DataFrame, table: str, create: bool = False) -> None:
    """Append to a table, or make it; ``name.table`` of an attached database goes there, written by all executors."""
    spark = df.sparkSession
    if table.split(".")[0] in ATTACHED.entries:
        db, _, name = table.partition(".")
        with span(("io", "write"), format="attached", path=table):
            ATTACHED.insert_into(df, db, name, create)
        return
    with span(("io", "write"), format="table", path=table):
        if create:
            df.write.saveAsTable(table)
            return
        if not spark.catalog.tableExists(table):
            raise ValueError(f"insert failed: no table {table!r}")
        df.write.insertInto(table)


def exec_sql(spark: SparkSession, text: str) -> DataFrame:
    return spark.sql(query_text(text))


class Attached:
    """External databases by name: JDBC sources or Spark catalogs, and credentials for stores."""

    KINDS = ("postgres", "mysql", "sqlite", "duckdb", "jdbc", "iceberg", "delta", "ducklake")
    DRIVERS = {"postgres": ("jdbc:postgresql://", "org.postgresql.Driver"), "mysql": ("jdbc:mysql://", "com.mysql.cj.jdbc.Driver"), "sqlite": ("jdbc:sqlite:", "org.sqlite.JDBC"), "duckdb": ("jdbc:duckdb:", "org.duckdb.DuckDBDriver"), "jdbc": ("jdbc:", "")}

    def __init__(self) -> None:
        self.entries: dict[str, dict] = {}
        self.secrets: dict[str, dict] = {}

    def attach(self, name: str, connection: str, type: str, read_only: bool = True) -> None:
        if type not in self.KINDS:
            raise ValueError(f"unknown database type {type!r}")
        self.entries[name] = {"name": name, "type": type, "path": connection, "read_only": read_only}

    def detach(self, name: str) -> None:
        if name not in self.entries:
            raise ValueError(f"no attached database {name!r}")
        del self.entries[name]

    def list_attached(self) -> list[dict]:
        return [{k: e[k] for k in ("name", "type", "path")} for e in self.entries.values()]

    def create_secret(self, name: str, type: str, password_env: str | None = None, **fields: object) -> None:
        known = ("key_id", "secret", "region", "provider", "scope", "host", "user", "password", "endpoint")
        own = {k: v for k, v in fields.items() if k in known and v is not None}
        if password_env:
            own["password"] = os.environ[password_env]
        self.drop_secret(name)
        self.secrets[name] = {"type": type, **own}
        if spark := SparkSession.getActiveSession():
            self.use_secrets(spark)

    def use_secrets(self, spark: SparkSession) -> None:
        """Put the settings of all secrets for stores into the session; new ones go there by themselves."""
        conf = spark._jsc.hadoopConfiguration()
        for name in self.secrets:
            for k, v in self.hadoop_conf(name).items():
                conf.set(k, v)

    def drop_secret(self, name: str) -> None:
        spark = SparkSession.getActiveSession()
        if name in self.secrets and spark:
            for k in self.hadoop_conf(name):
                spark._jsc.hadoopConfiguration().unset(k)
        self.secrets.pop(name, None)

    def hadoop_conf(self, name: str) -> dict[str, str]:
        """Settings that a secret means for the store it is for."""
        s = self.secrets[name]
        if s["type"] == "s3":
            bucket = str(s.get("scope") or "").removeprefix("s3://").removeprefix("s3a://").split("/")[0]
            head = f"fs.s3a.bucket.{bucket}." if bucket else "fs.s3a."
            pairs = {"access.key": s.get("key_id"), "secret.key": s.get("secret"), "endpoint.region": s.get("region"), "endpoint": s.get("endpoint")}
            return {head + k: str(v) for k, v in pairs.items() if v}
        return {}

    def jdbc_options(self, db: str, table: str) -> dict[str, str]:
        e = self.entries[db]
        prefix, driver = self.DRIVERS[e["type"]]
        url = e["path"] if e["path"].startswith("jdbc:") else prefix + e["path"].removeprefix(f"{e['type']}://")
        out = {"url": url, "dbtable": table, **({"driver": driver} if driver else {})}
        for s in self.secrets.values():
            if s["type"] == e["type"]:
                out |= {k: str(s[k]) for k in ("user", "password") if k in s}
        return out

    def table_name(self, db: str, table: str, version: object = None, as_of: object = None) -> str:
        name = ".".join(quote_name(p) for p in [db, *table.split(".")])
        if version is not None:
            return f"{name} VERSION AS OF {int(version)}"
        if as_of is not None:
            return f"{name} TIMESTAMP AS OF '{as_of}'"
        return name

    def from_attached(self, spark: SparkSession, db: str, table: str, version: object = None, as_of: object = None, partition_by: str | None = None, partitions: int = 8) -> DataFrame:
        if db not in self.entries:
            raise ValueError(f"no attached database {db!r}")
        e = self.entries[db]
        if e["type"] in self.DRIVERS:
            opts = self.jdbc_options(db, table)
            if partition_by:
                return spark.read.jdbc(opts["url"], table, predicates=self.hash_predicates(partition_by, partitions), properties={k: v for k, v in opts.items() if k not in ("url", "dbtable")})
            return spark.read.format("jdbc").options(**opts).load()
        return spark.sql(f"SELECT * FROM {self.table_name(db, table, None if partition_by else version, None if partition_by else as_of)}")

    def insert_into(self, df: DataFrame, db: str, table: str, create: bool = False) -> None:
        """Append ``df``, every partition over a connection of its own; ``create`` makes the table first."""
        e = self.entries[db]
        if e["read_only"]:
            raise ValueError(f"insert failed: {db!r} is attached read-only")
        if e["type"] in self.DRIVERS:
            df.write.format("jdbc").options(**self.jdbc_options(db, table)).mode("error" if create else "append").save()
        elif create:
            df.writeTo(self.table_name(db, table)).create()
        else:
            df.writeTo(self.table_name(db, table)).append()

    @staticmethod
    def hash_predicates(column: str, partitions: int) -> list[str]:
        """Disjoint conditions over whole-number keys, one per partition, that cover all rows."""
        quoted = '"' + column.replace('"', '""') + '"'
        return [f"MOD(MOD({quoted}, {partitions}) + {partitions}, {partitions}) = {i}" + (f" OR {quoted} IS NULL" if i == 0 else "") for i in range(partitions)]


ATTACHED = Attached()
