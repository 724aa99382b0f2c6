"""URL rules by a sort-merge range join over reversed-host keys.

A host's canonical key is its labels in reverse, each followed by a dot: ``www.example.com`` becomes
``com.example.www.``. A rule for a host fits that host and its subdomains, so it covers exactly the
keys from ``com.example.`` up to, not including, ``com.example/`` (the next character after the
dot): an interval. URLs and rules are dealt by ranges of the key and sorted; one sweep over each
range keeps a stack of the nested rule hosts that are active at the current key. The paths of a host
nest as well: each is the interval of the paths that it starts. They are kept sorted, each with the
next shorter one that holds it, so the longest path that starts a URL's is found by one search and a
walk up that chain, however many rules the host has. The longest rule of the stack wins.

Verdict without a rule: ``default`` ("allow": rules name what to block and its exceptions).

Scale. Range bounds come from a sample, the rows whose hash is under a threshold that their number sets,
``SAMPLE_PER_RANGE`` a range; it only steers balance. A bound holds key, path and row id, so URLs of one hot host spread over ranges. A
rule is copied to the ranges that its interval meets: a broad one to many, a narrow one to one.

Cases. Null URL or one without ``://``: empty host and path, no rule. Very long URLs: whole. Null page ids: kept. Repeated pages: a row each.
No rules or no pages: no rule fits, or no rows. Of equal rules the blocking one counts. Extra columns
are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

SAMPLE_PER_RANGE = 32
RULE_SCHEMA = "host string, path string, verdict string"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: str) -> str:
    """``a.b.c`` as ``c.b.a.``: a host and its subdomains are then one interval of keys."""
    return ".".join(reversed(host.split("."))) + "."


def key_after(key: str) -> str:
    """The first key after all keys that start with ``key`` (which ends with a dot)."""
    return key[:-1] + "/"


class Paths:
    """The paths of one host's rules as nested intervals."""

    def __init__(self, rules: dict[str, tuple[str, str]]):
        self.rules, self.sorted = rules, sorted(rules)
        self.outer: list[int] = []  # the longest other path that starts this one
        held: list[int] = []
        for i, path in enumerate(self.sorted):
            while held and not path.startswith(self.sorted[held[-1]]):
                held.pop()
            self.outer.append(held[-1] if held else -1)
            held.append(i)

    def __lt__(self, other: Paths) -> bool:
        return False  # hosts differ

    def longest(self, path: str) -> str | None:
        """The longest of the paths that starts ``path``."""
        at = bisect_right(self.sorted, path) - 1
        while at >= 0 and not path.startswith(self.sorted[at]):
            at = self.outer[at]
        return self.sorted[at] if at >= 0 else None


class Sweep:
    """Sorted URL keys against rules sorted by key: a stack of the nested hosts now active."""

    def __init__(self, rules: Iterable[tuple[str, str, str, str]]):
        """rules: (key, path, rule text, verdict)."""
        by_key: dict[str, dict[str, tuple[str, str]]] = {}
        for key, path, text, verdict in rules:
            paths = by_key.setdefault(key, {})
            if path not in paths or verdict == "block":
                paths[path] = (text, verdict)
        self.hosts = sorted((k, Paths(p)) for k, p in by_key.items())
        self.next = 0
        self.active: list[tuple[str, Paths]] = []

    def match(self, key: str, path: str) -> tuple[str, str] | None:
        """The longest fitting rule; calls must come in order of ``key``."""
        while self.next < len(self.hosts) and self.hosts[self.next][0] <= key:
            opened = self.hosts[self.next]
            while self.active and not opened[0].startswith(self.active[-1][0]):
                self.active.pop()
            self.active.append(opened)
            self.next += 1
        while self.active and not key.startswith(self.active[-1][0]):
            self.active.pop()
        best, length = None, -1
        for host, paths in self.active:
            found = paths.longest(path)
            if found is not None and len(host) + len(found) >= length:
                best, length = paths.rules[found], len(host) + len(found)
        return best


OUT_SCHEMA = "page_id long, host string, path string, rule string, verdict string"


def _sweep_partition(default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rules, sweep = None, [], None
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for piece, is_url, key, path, host, row, text, verdict in zip(*cols, strict=True):
                if piece != at:
                    at, rules, sweep = piece, [], None
                if not is_url:  # the rules of a range come before its URLs
                    rules.append((key, path, text, verdict))
                    continue
                if sweep is None:
                    sweep = Sweep(rules)
                found = sweep.match(key, path)
                for to, v in zip(out, (row, host, path, *(found or (None, default))), strict=True):
                    to.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()), strict=True)], ["page_id", "host", "path", "rule", "verdict"])

    return run


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict. ``rules``: host, path, verdict."""
    spark = pages.sparkSession
    n = shuffle_partitions(spark)
    hosts = pages.select(F.col(id_col).alias("row"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    key = F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit("."))
    urls = hosts.withColumn("key", key)
    mark = F.coalesce(F.col("row").cast("string"), F.lit(""))
    # the rows under a threshold of the hash: about n * SAMPLE_PER_RANGE of them; the limit only holds off copies of one row
    wanted = n * SAMPLE_PER_RANGE
    share = min(1.0, wanted / max(1, pages.count()))
    spot = F.pmod(F.xxhash64("mark", "key", "path"), F.lit(1 << 30)) < int(share * (1 << 30))
    seen = urls.select("key", "path", mark.alias("mark")).where(spot).limit(4 * wanted).collect()
    seen = sorted((r["key"], r["path"], r["mark"]) for r in seen)
    bounds = sorted({seen[len(seen) * i // n] for i in range(1, n)}) if seen else []

    def piece_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, p, m = (b.column(i).to_pylist() for i in range(3))
            at = [bisect_right(bounds, x) for x in zip(k, p, m, strict=True)]
            rest = [b.column(i) for i in range(3, b.num_columns)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([True] * len(at)), b.column(0), b.column(1), *rest], names)

    names = ["piece", "is_url", "key", "path", "host", "row", "text", "verdict"]
    schema = "piece int, is_url boolean, key string, path string, host string, row long, text string, verdict string"
    none = F.lit(None).cast("string")
    url_rows = urls.select("key", "path", mark.alias("mark"), "host", F.col("row").cast("long").alias("row"), none.alias("text"), none.alias("verdict")).mapInArrow(piece_of, schema)

    def rule_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for host, path, verdict in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if host is None:
                    continue
                k = host_key(host)
                first, last = bisect_right(bounds, (k,)), bisect_left(bounds, (key_after(k),))
                rows += [(i, False, k, path or "", None, None, host + (path or ""), verdict) for i in range(first, last + 1)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=pa.schema([("piece", pa.int32()), ("is_url", pa.bool_()), ("key", pa.string()), ("path", pa.string()), ("host", pa.string()), ("row", pa.int64()), ("text", pa.string()), ("verdict", pa.string())]))

    rule_rows = rules.select("host", "path", "verdict").mapInArrow(rule_pieces, schema)
    dealt = url_rows.unionByName(rule_rows).repartition(n, "piece").sortWithinPartitions("piece", "is_url", "key")
    return dealt.mapInArrow(_sweep_partition(default), OUT_SCHEMA)
