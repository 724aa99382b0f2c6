import random

import numpy as np
import plain
import pyarrow as pa
import pytest
from brightwater.llm import near_dups as nd
from brightwater.llm.common import SharedTables


def key(r):
    return tuple((x is None, x) for x in r)


def test_components_equal_brute_force(spark):
    rows = plain.corpus()
    df = spark.createDataFrame(rows, plain.SCHEMA).withColumn("component_id", __import__("pyspark").sql.functions.lit("clash")).withColumn("key", __import__("pyspark").sql.functions.lit(1))
    run = nd.NearDuplicates(df)
    got = sorted(map(tuple, run.result().select("doc_id", "n_shingles", "component_id", "kept").collect()), key=key)
    assert got == sorted(plain.near_duplicates(rows), key=key)
    left = run.survivors(df)
    assert left.columns == df.columns
    want = plain.near_duplicates(rows)
    groups = {w[2] for w in want if w[1]}
    empties = sum(1 for w in want if not w[1])
    assert left.count() == len(groups) + empties


def test_blocks_find_what_stars_miss(spark, monkeypatch):
    # one bucket for all: every star has the same centre, which is near only one of two groups
    monkeypatch.setattr(nd, "BLOCK", 2)
    monkeypatch.setattr(nd, "STAR_ROUNDS", 0)
    rows = [(i, t, None, None, None) for i, t in enumerate(["a b c d e f g h", "q w e r t y u i o p a s d f g h j k l z", "q w e r t y u i o p a s d f g h j k l z x"])]
    got = nd.near_duplicates(spark.createDataFrame(rows, plain.SCHEMA)).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got)) == [(0, 0), (1, 1), (2, 1)]


def near_group(n, seed):
    """Copies of one text with edits of their own: many pairs a little under the threshold, some over it."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words), None, None, None))
    return rows


@pytest.mark.parametrize("rounds", [0, 8])
def test_blocks_of_a_large_near_group_equal_brute_force(spark, monkeypatch, rounds):
    monkeypatch.setattr(nd, "BLOCK", 16)
    monkeypatch.setattr(nd, "BLOCK_SHINGLES", 3000)
    monkeypatch.setattr(nd, "STAR_ROUNDS", rounds)
    rows = near_group(120, 4)
    run = nd.NearDuplicates(spark.createDataFrame(rows, plain.SCHEMA))
    got = sorted(map(tuple, run.result().select("doc_id", "n_shingles", "component_id", "kept").collect()))
    want = sorted(plain.near_duplicates(rows))
    assert got == want and 1 < len({w[2] for w in want}) < 100
    if rounds == 0:  # no more links than nodes leave a block, whatever the number of near pairs
        assert spark.read.parquet(run.tables.path("joining")).count() <= nd.BANDS * len(rows)


def block_batch(sets, labels):
    marks = nd.sketch_bytes(nd.sketches(sets))
    names = ["b", "lo", "hi", "side", "key", "label", "n", "sketch", "pivot", "j"]
    n = len(sets)
    cols = [pa.array([1] * n), pa.array([0] * n), pa.array([0] * n), pa.array([0] * n), pa.array(range(10, 10 + n)), pa.array(labels), pa.array([len(s) for s in sets]), pa.array([m.tobytes() for m in marks]), pa.array([10] * n), pa.array([1.0, 0.9, 0.1][:n])]
    return pa.RecordBatch.from_arrays(cols, names)


def test_flags_cross_label_pairs_only():
    sets = [nd.shingle_set(t) for t in (b"a b c d e f g h i j k l m n o p q r s t", b"a b c d e f g h i j k l m n o p q r s t u", b"z y x w v u t s r q p o n m l k j")]
    flagged = lambda labels: [k for out in nd._flag_block(iter([block_batch(sets, labels)])) for k in out.column(3).to_pylist()]
    assert flagged([10, 11, 12]) == [10, 11] and flagged([10, 10, 12]) == []


def test_joining_links_are_a_forest():
    rng = random.Random(2)
    sets = [np.unique(np.array([rng.randrange(30) for _ in range(60)], np.uint64)) for _ in range(25)]
    links = nd.joining_links(list(range(25)), list(range(25)), sets)
    near = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))
    assert 0 < len(links) < 25 and all(near(sets[x], sets[y]) for x, y in links)

    def groups(pairs):
        up = list(range(25))
        for x, y in pairs:
            a, b = up[x], up[y]
            up = [b if u == a else u for u in up]
        return {frozenset(i for i in range(25) if up[i] == u) for u in up}

    assert groups(links) == groups([(i, j) for i in range(25) for j in range(i) if near(sets[i], sets[j])])
    assert nd.joining_links([1, 2, 3], [7, 7, 9], [sets[0], sets[0], sets[0]]) == [(1, 3)]  # one label is joined already


def test_sets_that_share_a_key_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(nd, "set_key", lambda s: None if not len(s) else 77)
    t = SharedTables(spark, "t")
    rows = [(1, 5, 3, 77, 1, [1], b"a"), (2, 5, 3, 77, 1, [1], b"a"), (3, 6, 4, 77, 2, [1], b"b"), (4, 7, 0, None, None, [], None)]
    sketched, nodes = nd._node_table(t, t.write(spark.createDataFrame(rows, nd.SKETCHED), "s"))
    got = {r["doc_id"]: r["key"] for r in sketched.collect()}
    assert got == {1: 77, 2: 77, 3: nd.apart_key(77, 2), 4: None} and sorted(r["rep"] for r in nodes.collect()) == [1, 3]
    s = np.arange(4, dtype=np.uint64)
    assert nd.is_node(s, 77) and nd.is_node(s, nd.apart_key(77, nd.set_check(s))) and not nd.is_node(s, 78)


def test_every_coordinate_fills_and_estimates():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 900, dtype=np.uint64)
    sets = [np.unique(a[:600]), np.unique(a[150:750]), np.unique(a[:1]), np.zeros(0, np.uint64)]
    rows = nd.sketches(sets)
    assert (rows[:3] != nd._EMPTY).all() and (rows[3] == nd._EMPTY).all()
    assert abs((rows[0] == rows[1]).mean() - 450 / 750) < 0.12


def test_empty_table(spark):
    assert nd.near_duplicates(spark.createDataFrame([], plain.SCHEMA)).collect() == []
