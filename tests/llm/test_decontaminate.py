import plain
import pytest
from brightwater.llm import decontaminate as dc


def key(r):
    return tuple((x is None, x) for x in r)


@pytest.mark.parametrize("block", [1_000_000, 20])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(dc, "ITEM_BLOCK_WORDS", block)
    rows = plain.corpus()
    t = rows[20][1].split()
    items = [(1, " ".join(t[3:20])), (2, "one TWO"), (2, "..."), (3, None), (4, "a b c d e"), (None, " ".join(rows[21][1].split()[:11])), (5, "x" * 900), (5, "x" * 900), (6, " ".join(t[3:12] + ["other"])), (7, "É é")]
    docs = spark.createDataFrame(rows, plain.SCHEMA).selectExpr("*", "1 AS row", "'x' AS items")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, dc.contamination(docs, bench).collect()), key=key)
    want = sorted(plain.contamination(rows, items), key=key)
    assert got == want
    left = dc.remove_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == sum(not w[5] for w in want)


def test_empty_tables(spark):
    docs, none = spark.createDataFrame(plain.corpus(), plain.SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert dc.contamination(docs, none).where("contaminated").count() == 0
    assert dc.contamination(spark.createDataFrame([], plain.SCHEMA), none).count() == 0
    assert dc.remove_contaminated(docs, none).count() == docs.count()
