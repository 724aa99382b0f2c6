"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

Words are lower-cased (A-Z) runs of characters other than space and the control characters 9 to 13;
a document's set is its distinct five-word shingles (with fewer words, the whole sequence as one).
Two documents are linked if 100 * intersection >= 75 * union, confirmed on the full sets.

Sketch. ``COORDS`` coordinates per set. In round r < COORDS each element falls into a hashed bin with
the value (round, hash), in round COORDS + i every element falls into bin i; a bin keeps its least
value, and a document stops at the first round with all bins filled. So each coordinate is filled for
certain, and matching coordinates concentrate around the similarity. ``BANDS`` bands of ``ROWS``
coordinates: two sets at the threshold share no band with probability under 3e-6, and less above it.
The other coordinates sharpen estimates.

Equal sets are one node: sets meet by a 64-bit hash and are told apart by 64 more bits (``_node_table``).
Nodes that share a band value are compared:

1. in rounds, each node of a bucket that holds several components with one hub of another of them, a
   star, so a round confirms at most one pair per node; components are joined, and rounds go on
   with other hubs while one pair in ``LEAST_YIELD`` is a link (``STAR_ROUNDS`` at most);
2. in buckets that still hold several components, nodes of different components in blocks of bounded
   size. First by sketch: a node is flagged if another node of its block, of another component, agrees
   with it in at least ``LEAST_MATCHES`` coordinates (five standard deviations under the threshold),
   the sizes allow the threshold, and so do their similarities to a common hub (the triangle
   inequality). Then the texts of flagged nodes come to their blocks, every pair of different
   components is counted on the full sets, and a block gives out only links that join two of its
   components: at most one per component, however many pairs it compares. No bucket is capped.

Texts move once, to find those of candidate nodes; confirmations group them by the star's centre in
salted groups of bounded size. Both sides of the joins by bucket, hub and label are written tables, so
adaptive execution can split a hot key. Components are DataFrame iterations; nothing but counts
reaches the driver.

Cases. Null or empty text, or text without words: n_shingles 0, linked with nothing. Very long texts
are taken whole; blocks are cut by shingles as well as by nodes, so they stay bounded. Repeated rows
and exact copies: linked. Null doc_id: takes part; the smallest non-null id names the component (null
if there is none). Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import SharedTables, blocks_of, byte_texts, hash_words, mix64, release_shuffles, run_hashes
from .graph_labels import component_labels

SHINGLE = 5
COORDS, ROWS, BANDS = 480, 5, 48
LEAST_MATCHES = 313
STAR_GROUP, BLOCK, BLOCK_SHINGLES = 256, 512, 1 << 20
STAR_ROUNDS, LEAST_YIELD = 8, 20
_U = np.uint64
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(run_hashes(hash_words(words), min(SHINGLE, len(words))))


def set_key(shingles: np.ndarray) -> int | None:
    """The node of a set; null for the empty set."""
    return int(np.uint64(xxh3_64_intdigest(shingles.tobytes())).view(np.int64)) if len(shingles) else None


def set_check(shingles: np.ndarray) -> int | None:
    """64 more bits, independent of the key."""
    return int(np.uint64(xxh3_64_intdigest(shingles.tobytes(), 1)).view(np.int64)) if len(shingles) else None


def apart_key(key: int, check: int) -> int:
    """The node of a set whose key another set has already."""
    return int(mix64(np.array([key], np.int64).view(np.uint64) ^ mix64(np.array([check], np.int64).view(np.uint64)))[0].view(np.int64))


def is_node(shingles: np.ndarray, key: int) -> bool:
    own = set_key(shingles)
    return own == key or (own is not None and apart_key(own, set_check(shingles)) == key)


def sketches(sets: list[np.ndarray], coords: int = COORDS) -> np.ndarray:
    """One row of ``coords`` filled coordinates per set (rows of empty sets stay unfilled)."""
    n = len(sets)
    out = np.full(n * coords, _EMPTY)
    lengths = np.array([len(s) for s in sets], np.int64)
    items = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    cell = np.repeat(np.arange(n, dtype=np.int64) * coords, lengths)
    open_rows = lengths > 0
    for r in range(2 * coords):
        if not len(items):
            break
        h = mix64(items + mix64(np.array([r + 1], np.uint64) * _U(0x9E3779B97F4A7C15)))
        at = cell + ((((h >> _U(32)) * _U(coords)) >> _U(32)).astype(np.int64) if r < coords else r - coords)
        np.minimum.at(out, at, (_U(r) << _U(32)) | (h & _U(0xFFFFFFFF)))
        full = open_rows & (out.reshape(n, coords) != _EMPTY).all(1)
        if full.any():
            open_rows &= ~full
            keep = open_rows[cell // coords]
            items, cell = items[keep], cell[keep]
    return out.reshape(n, coords)


def band_values(rows: np.ndarray) -> np.ndarray:
    """(n, BANDS) hashes of the bands of sketches."""
    parts = rows[:, : BANDS * ROWS].reshape(len(rows), BANDS, ROWS)
    acc = np.broadcast_to(mix64(np.arange(parts.shape[1], dtype=np.uint64)), parts.shape[:2]).copy()
    for i in range(ROWS):
        acc = mix64(acc * _U(0x9E3779B97F4A7C15) + parts[:, :, i])
    return acc


def sketch_bytes(rows: np.ndarray) -> np.ndarray:
    """One byte per coordinate, for estimates."""
    return (mix64(rows) >> _U(56)).astype(np.uint8)


SKETCHED = "doc_id long, mark long, n_shingles long, key long, check long, bands array<long>, sketch binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = byte_texts(b.column(1))
        for lo, hi in blocks_of(texts):
            sets = [shingle_set(t) for t in texts[lo:hi]]
            rows = sketches(sets)
            bands = band_values(rows).view(np.int64)
            marks = sketch_bytes(rows)
            filled = [len(s) > 0 for s in sets]
            offsets = np.concatenate([[0], np.cumsum(np.where(filled, bands.shape[1], 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).slice(lo, hi - lo),
                    b.column(2).slice(lo, hi - lo),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_key(s) for s in sets], pa.int64()),
                    pa.array([set_check(s) for s in sets], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[np.array(filled)].ravel())),
                    pa.array([m.tobytes() if f else None for m, f in zip(marks, filled, strict=True)], pa.binary()),
                ],
                ["doc_id", "mark", "n_shingles", "key", "check", "bands", "sketch"],
            )


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (grp, salt, centre, key, text) sorted with the centre first in each group, to compared pairs."""
    at, centre = None, None
    for b in batches:
        grp, salt, is_centre, key = (b.column(i).to_pylist() for i in range(4))
        xs, ys, js, linked = [], [], [], []
        for g, s, c, k, t in zip(grp, salt, is_centre, key, byte_texts(b.column(4)), strict=True):
            own = shingle_set(t)
            if not is_node(own, k):
                continue  # another text under the same id
            if c:
                at, centre = (g, s), own
            elif at == (g, s):
                common = len(np.intersect1d(centre, own, assume_unique=True))
                union = len(centre) + len(own) - common
                xs.append(g), ys.append(k), js.append(common / union), linked.append(100 * common >= 75 * union)
        yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64()), pa.array(js, pa.float64()), pa.array(linked, pa.bool_())], ["x", "y", "j", "linked"])


def _grouped(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows whose first three columns (b, lo, hi) name their block and come sorted by it: (block, rows) one by one."""
    at, held = None, []
    for batch in batches:
        for bb, lo, hi, *row in zip(*(batch.column(i).to_pylist() for i in range(width)), strict=True):
            if (bb, lo, hi) != at:
                if held:
                    yield at, held
                at, held = (bb, lo, hi), []
            held.append(tuple(row))
    if held:
        yield at, held


FLAGGED = "b long, lo int, hi int, key long, label long"


def _flag_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (b, lo, hi, side, key, label, n, sketch, pivot, j) to the nodes that may have a link in their block."""
    for at, held in _grouped(batches, 10):
        side, key, label, n = (np.array([h[i] for h in held], np.int64) for i in range(4))
        marks = np.frombuffer(b"".join([h[4] for h in held]), np.uint8).reshape(len(held), -1)
        pivot = np.array([h[5] if h[5] is not None else h[1] for h in held], np.int64)
        near = np.array([h[6] if h[6] is not None else 1.0 for h in held])
        within = at[1] == at[2]
        flag = np.zeros(len(held), bool)
        for i in range(len(held) - 1):
            rest = slice(i + 1, None)
            ok = (label[rest] != label[i]) & (4 * np.minimum(n[rest], n[i]) >= 3 * np.maximum(n[rest], n[i]))
            # 1 - similarity is a metric: nodes that differ by more from one pivot are not near each other
            ok &= (pivot[rest] != pivot[i]) | (np.abs(near[rest] - near[i]) <= 0.25 + 1e-9)
            if not within:
                ok &= side[rest] != side[i]
            other = np.flatnonzero(ok) + i + 1
            if len(other):
                other = other[(marks[other] == marks[i]).sum(1) >= LEAST_MATCHES]
                flag[other] = True
                flag[i] |= bool(len(other))
        some = np.flatnonzero(flag)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array([at[0]] * len(some), pa.int64()), pa.array([at[1]] * len(some), pa.int32()), pa.array([at[2]] * len(some), pa.int32()), pa.array(key[some]), pa.array(label[some])], ["b", "lo", "hi", "key", "label"])


def joining_links(keys: list[int], labels: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs at the threshold that join components: all pairs of different components are counted, a forest comes out."""
    up = {x: x for x in labels}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    sizes = np.array([len(s) for s in sets])
    _, words = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    own = np.zeros(int(words.max()) + 1, np.int64)
    out = []
    for i in range(1, len(sets)):
        mine = words[begin[i] : begin[i + 1]]
        own[mine] = 1
        common = np.add.reduceat(own[words[: begin[i]]], begin[:i])  # no set is empty
        own[mine] = 0
        for j in np.flatnonzero(100 * common >= 75 * (sizes[:i] + sizes[i] - common)).tolist():
            a, b = top(labels[i]), top(labels[j])
            if a != b:
                up[a] = b
                out.append((keys[j], keys[i]))
    return out


def _join_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (b, lo, hi, key, label, text) sorted by block, to the links (x, y) that join components of a block."""
    for _, held in _grouped(batches, 6):
        rows = [(k, label, s) for k, label, t in held if is_node(s := shingle_set(t.encode() if t else None), k)]
        rows = list({r[0]: r for r in rows}.values())  # rows of one id and text come once
        if len({r[1] for r in rows}) > 1:
            found = joining_links([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["x", "y"])


def confirmed(tables: SharedTables, pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """Candidate pairs (x, y) with their similarity j on the full sets of ``texts`` (key, text), and linked."""
    load = tables.write(pairs.groupBy("x").agg(F.ceil(F.count("*") / STAR_GROUP).cast("int").alias("salts")), f"{name}_load")
    members = pairs.join(load, "x").select(F.col("x").alias("grp"), F.pmod(F.xxhash64("y"), F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("centre"), F.col("y").alias("key"))
    centres = load.select(F.col("x").alias("grp"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("centre"), F.col("x").alias("key"))
    rows = members.unionByName(centres).join(texts, "key").select("grp", "salt", "centre", "key", "text")
    dealt = rows.repartition("grp", "salt").sortWithinPartitions("grp", "salt", F.desc("centre"))
    return dealt.mapInArrow(_confirm, "x long, y long, j double, linked boolean")


def _stars(tables: SharedTables, labelled: DataFrame, n: int) -> DataFrame:
    """One pair (x, y) for each node y in a bucket of several components: a hub x of another one.

    A bucket's hub is its first node in an order that changes with the round; a node takes the first of
    its hubs, so near copies meet at few hubs and make a pair each, however many bands they share. The
    first round's order is by weight, the sizes of a node's buckets: in a group of copies with edits
    of their own, the ones with the fewest edits come first.
    """
    order = -F.col("weight") if n == 0 else F.xxhash64("key", F.lit(n))
    hubs = labelled.groupBy("b").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(F.struct(order.cast("long").alias("o"), "key", "label")).alias("hub")).where("lo < hi")
    met = labelled.join(tables.write(hubs.select("b", "hub"), f"hubs{n}"), "b").where("label <> hub.label")
    return met.groupBy("key").agg(F.min("hub").alias("hub")).select(F.col("hub.key").alias("x"), F.col("key").alias("y"))


def _blocks(tables: SharedTables, labelled: DataFrame, nodes: DataFrame, pivots: DataFrame) -> DataFrame:
    """Buckets of several components, dealt in blocks: (b, lo, hi, side, key, label, n, sketch, pivot, j).

    The nodes of a bucket's largest component are not compared with one another, only with the rest.
    """
    marks = nodes.select("key", "n", "sketch").join(labelled.select("key").distinct(), "key", "left_semi").join(pivots, "key", "left")
    weighed = labelled.join(nodes.select("key", "n"), "key")
    per = weighed.groupBy("b", "label").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    mixed = per.groupBy("b").agg(F.count("*").alias("labels"), F.max(F.struct("c", "label", "w")).alias("top"), F.sum("c").alias("c"), F.sum("w").alias("w")).where("labels > 1")
    parts = lambda c, w: F.greatest(F.ceil(c / BLOCK), F.ceil(w / BLOCK_SHINGLES)).cast("int")
    mixed = mixed.select("b", F.col("top.label").alias("top"), parts(F.col("top.c"), F.col("top.w")).alias("tops"), parts(F.col("c") - F.col("top.c"), F.col("w") - F.col("top.w")).alias("rests"))
    rows = labelled.join(tables.write(mixed, "mixed"), "b").join(marks, "key")
    spot = F.xxhash64("key")
    major = F.col("label") == F.col("top")
    rows = rows.withColumn("side", F.when(major, -1 - F.pmod(spot, F.col("tops"))).otherwise(F.pmod(spot, F.col("rests"))).cast("int"))
    among = lambda j: F.struct(F.least("side", j).alias("lo"), F.greatest("side", j).alias("hi"))
    to_rests = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), among)
    to_tops = F.transform(F.sequence(-F.col("tops"), F.lit(-1)), among)
    rows = rows.withColumn("at", F.explode(F.when(major, to_rests).otherwise(F.concat(to_tops, to_rests))))
    rows = rows.select("b", "at.lo", "at.hi", "side", "key", "label", "n", "sketch", "pivot", "j")
    return rows.repartition("b", "lo", "hi").sortWithinPartitions("b", "lo", "hi")


def block_links(tables: SharedTables, blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """The links (x, y) that join components inside of blocks: flagged by sketch, confirmed on the full sets."""
    flagged = tables.write(blocks.mapInArrow(_flag_block, FLAGGED), "flagged")
    rows = flagged.join(texts, "key").select("b", "lo", "hi", "key", "label", "text")
    dealt = rows.repartition("b", "lo", "hi").sortWithinPartitions("b", "lo", "hi")
    return tables.write(dealt.mapInArrow(_join_block, "x long, y long"), "joining")


def _node_table(tables: SharedTables, sketched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``sketched`` and its nodes (key, rep, n, bands, sketch), every set with a key of its own.

    Where sets share a key, all but one get another; a pair of sets in 10^19 does.
    """
    for n in range(8):
        checks = [F.min("check").alias("check"), F.max("check").alias("last")]
        per_node = sketched.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), *checks)
        nodes = tables.write(per_node, f"nodes{n}")
        shared = nodes.where("check <> last").select("key", F.col("check").alias("first"))
        if shared.isEmpty():
            return sketched, nodes

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys = [k if first is None or first == check else apart_key(k, check) for k, check, first in zip(*(b.column(c).to_pylist() for c in ("key", "check", "first")), strict=True)]
                yield b.set_column(b.schema.get_field_index("key"), "key", pa.array(keys, pa.int64())).select(names)

        names = sketched.columns
        sketched = tables.write(sketched.join(shared, "key", "left").select(*names, "first").mapInArrow(move, sketched.schema), f"apart{n}")
    raise ValueError("sets can't be told apart by 128 bits")


def relabelled(tables: SharedTables, labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """(key, label) after joining the components that ``links`` connect."""
    ends = links.join(labels.select(F.col("key").alias("x"), F.col("label").alias("lx")), "x").join(labels.select(F.col("key").alias("y"), F.col("label").alias("ly")), "y")
    joined = ends.where("lx <> ly").select(F.col("lx").alias("x"), F.col("ly").alias("y")).distinct()
    moved = component_labels(tables, joined, name).select(F.col("key").alias("label"), F.col("label").alias("to"))
    return tables.write(labels.join(moved, "label", "left").select("key", F.coalesce("to", "label").alias("label")), f"{name}_labels")


class NearDuplicates:
    """The tables of one run: ``rows`` (doc_id, mark, n_shingles, key) and ``nodes`` (key, component)."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        spark = docs.sparkSession
        t = self.tables = SharedTables(spark, "neardup")
        source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        marked = source.withColumn("mark", F.xxhash64("text"))
        sketched, nodes = _node_table(t, t.write(marked.select("doc_id", "text", "mark").mapInArrow(_sketch, SKETCHED), "sketched"))
        self.rows = sketched.select("doc_id", "mark", "n_shingles", "key")
        banded = nodes.select("key", F.explode("bands").alias("b"))
        shared = banded.groupBy("b").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("b")
        found = t.write(banded.join(shared, "b").select("b", "key"), "found")
        sizes = found.groupBy("b").agg(F.count("*").alias("c"))
        weights = found.join(sizes, "b").groupBy("key").agg(F.sum("c").alias("weight"))
        members = t.write(found.join(weights, "key"), "members")
        wanted = members.select("key").distinct()
        reps = nodes.select("key", "rep").join(wanted, "key")
        texts = t.write(source.join(reps, source["doc_id"].eqNullSafe(reps["rep"])).select("key", "text"), "texts", "zstd")
        release_shuffles(spark)
        labels = t.write(wanted.select("key", F.col("key").alias("label")), "labels")
        for n in range(STAR_ROUNDS):
            labelled = t.write(members.join(labels, "key"), f"labelled{n}")
            stars = t.write(_stars(t, labelled, n), f"stars{n}")
            compared = t.write(confirmed(t, stars, texts, f"stars{n}"), f"compared{n}")
            links = compared.where("linked").select("x", "y")
            found = links.count()
            if found:
                labels = relabelled(t, labels, links, f"round{n}")
            if LEAST_YIELD * found < stars.count():
                break
        pivots = spark.read.parquet(t.path("compared0")).select(F.col("y").alias("key"), F.col("x").alias("pivot"), "j").dropDuplicates(["key"]) if STAR_ROUNDS else labels.select("key", F.col("key").alias("pivot"), F.lit(1.0).alias("j"))
        labelled = t.write(members.join(labels, "key"), "labelled")
        links = block_links(t, _blocks(t, labelled, nodes, pivots), texts)
        if not links.isEmpty():
            labels = relabelled(t, labels, links, "last")
        for name in ("texts", "found", "members", "labelled", "flagged"):
            t.drop(name)
        named = nodes.select("key", "rep").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
        least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
        self.nodes = t.write(named.select("key", "label").join(least, "label").select("key", "label", "component_id"), "components")

    def result(self) -> DataFrame:
        """One row per document: doc_id, n_shingles, component_id, kept."""
        own = self.rows.join(self.nodes, "key", "left")
        component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        return own.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))

    def survivors(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One document of each component (least id, then least text hash), and all without words."""
        first = self.rows.join(self.nodes, "key").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("s"))
        first = first.select(F.col("s.doc_id").alias("_id"), F.col("s.mark").alias("_mark")).distinct()
        marked = docs.withColumn("_at", F.xxhash64(F.col(text_col)))
        plain = F.trim(F.translate(F.coalesce(F.col(text_col), F.lit("")), "\t\n\x0b\f\r", "     "))
        filled = marked.where(plain != "")
        kept = filled.join(first, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_at") == F.col("_mark")), "left_semi")
        return kept.dropDuplicates([id_col, "_at"]).unionByName(marked.where(plain == "")).drop("_at")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    return NearDuplicates(docs, id_col, text_col).result()
