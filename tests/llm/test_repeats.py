import random

import plain
import pytest
from brightwater.llm import repeats as rp


def key(r):
    return tuple((x is None, x) for x in r)


def rows_with_repeats():
    rng = random.Random(9)
    rows = plain.corpus()
    long = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    more = [long[:900] + "XYZ" + long[900:2000], "é" * 30 + long[300:1300], long[1000:1399], long[1000:1400] + "q", long[:450] + long[:450], ("spam line. " * 60), ("spam line. " * 45), "z" * 401, long[2000:2420], "A" + long[2010:2430]]
    hot = [f"{'p%d ' % i * 60}{long[2500:2950]}{' q%d' % i * 60}" for i in range(12)]
    return [*rows, *[(1000 + i, t, "en", "a", None) for i, t in enumerate([*more, *hot])]]


@pytest.mark.parametrize("group", [4096, 3])
def test_equals_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(rp, "GROUP", group)
    rows = rows_with_repeats()
    df = spark.createDataFrame(rows, plain.SCHEMA)
    df = df.withColumn("row", df["doc_id"]).withColumn("gram", df["text"])
    run = rp.RepeatedStrings(df)
    got = sorted(map(tuple, run.result().drop("n_kept").collect()), key=key)
    assert got == sorted(plain.repeated_bytes(rows), key=key)
    assert run.result().where("n_kept <> n_bytes - n_removed").count() == 0
    assert run.cleaned().count() == len(rows)


def test_empty_table(spark):
    assert rp.repeated_strings(spark.createDataFrame([], plain.SCHEMA)).collect() == []


def test_segments_give_the_same_anchors(monkeypatch):
    rng = random.Random(1)
    data = bytes(rng.choice(b"abcd") for _ in range(9000)) + b"z" * 1500 + bytes(rng.choice(b"xy ") for _ in range(4000))
    whole = rp.anchor_rows(data)
    monkeypatch.setattr(rp, "SEGMENT", 700)
    parts = rp.anchor_rows(data)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def contexts_of_one_gram(rng, n):
    """(context, lead, bytes) around one gram, sharing more or less of both sides."""
    core = bytes(rng.choice(b"abcdef") for _ in range(736))
    out = []
    for i in range(n):
        left, right = rng.choice([0, 100, 167, 168, 169, 200, 300, 336]), rng.choice([0, 100, 167, 168, 200, 250, 336])
        own = lambda k: bytes(rng.choice(b"xyz") for _ in range(k))
        before, behind = rng.choice([336, 336, 250]), rng.choice([336, 336, 180])  # documents that begin or end there
        data = own(max(0, before - left)) + core[336 - min(left, before) : 400 + min(right, behind)] + own(max(0, behind - right))
        out.append((i, before, data))
    return core[336:400], out


def covered_by_pairs(rows):
    """(context, byte) around the gram that a repeated window at the same place covers."""
    seen = {}
    for context, lead, data in rows:
        for i in range(len(data) - rp.LENGTH + 1):
            if i <= lead <= i + rp.LENGTH - rp.GRAM:
                seen.setdefault((i - lead, data[i : i + rp.LENGTH]), []).append(context)
    return {(c, p) for (at, _), cs in seen.items() if len(cs) > 1 for c in cs for p in range(at, at + rp.LENGTH)}


def test_settled_groups_equal_pairs():
    gram, rows = contexts_of_one_gram(random.Random(6), 14)
    got = set()
    for lo, hi in ((rp.HALF + 1, rp.SIDE), (0, rp.HALF)):
        members = [m for c, lead, data in rows if (m := rp.member(5, 14, 1, c, lo, hi, lead, data))]
        for g, c, a, b in rp.settle(members):
            got |= {(c, p) for p in range(a, b)}
    assert got == covered_by_pairs(rows) and got


@pytest.mark.parametrize("group", [100, 2])
def test_digits_of_a_large_group_equal_pairs(spark, monkeypatch, group):
    """One gram in many contexts, in documents: with groups of 2 every digit is used."""
    monkeypatch.setattr(rp, "GROUP", group)
    gram, rows = contexts_of_one_gram(random.Random(8), 30)
    docs = [(c, data.decode(), None, None, None) for c, _, data in rows]
    got = rp.repeated_strings(spark.createDataFrame(docs, plain.SCHEMA)).drop("n_kept").collect()
    assert sorted(map(tuple, got)) == sorted(plain.repeated_bytes(docs))


def test_window_ranges_halve_down_to_single_windows():
    for at in range(rp.SIDE + 1):
        ranges = [rp.window_range(at, n) for n in range(rp.LEVELS - 1)]
        assert all(a <= x <= at <= y <= b for (a, b), (x, y) in zip(ranges, ranges[1:], strict=False)) and ranges[-1] == (at, at)
