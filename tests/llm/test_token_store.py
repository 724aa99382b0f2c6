import random

import numpy as np
import plain
import pyarrow as pa
import public_tokenizers
import pytest
from brightwater.llm import token_store as ts
from brightwater.llm.common import SharedTables

PATH = public_tokenizers.path("word_bpe_49k.json")


def encoded(enc, texts):
    ids, n = enc.encode(pa.array(texts, pa.string()))
    return [x.tobytes() for x in np.split(ids, np.cumsum(n)[:-1])]


def test_rows_equal_whole_text_encoding(spark):
    from tokenizers import Tokenizer

    rows = plain.corpus()
    tables = SharedTables(spark, "t")
    store = ts.write_store(spark.createDataFrame(rows, plain.SCHEMA).selectExpr("*", "1 AS start", "'x' AS keys"), PATH, tables=tables)
    got = sorted(map(tuple, store.digests().collect()), key=lambda r: r[1])
    want = plain.token_rows(rows, Tokenizer.from_file(PATH))
    by_id = lambda rs: sorted((r[0] is None, r[0] or 0, r[2], r[3]) for r in rs)
    assert by_id(got) == by_id(want)
    at = 0
    for r in got:
        assert r[1] == at
        at += r[2]
    assert [r[0] for r in got] == [r[0] for r in want]
    keys = [r["key"] for r in store.chunks.collect()]
    assert len(keys) == len(set(keys)) < sum(len(r["keys"]) for r in store.recipes.collect())
    assert store.manifest_holds()


def test_damage_is_found(spark):
    tables = SharedTables(spark, "t")
    store = ts.write_store(spark.createDataFrame(plain.corpus(), plain.SCHEMA), PATH, tables=tables)
    from pyspark.sql import functions as F

    store.chunks = store.chunks.withColumn("payload", F.when(F.col("n_ids") > 60, F.concat(F.expr("substring(payload, 3)"), F.lit(b"ab"))).otherwise(F.col("payload")))
    with pytest.raises(Exception, match="missing or damaged"):
        store.digests().collect()


def test_lost_and_changed_recipes_are_found(spark):
    from pyspark.sql import functions as F

    for damage in (lambda r: r.where("doc_id <> 7 OR doc_id IS NULL"), lambda r: r.withColumn("root", F.when(F.col("doc_id") == 7, F.lit(b"0" * 16)).otherwise(F.col("root"))), lambda r: r.limit(0)):
        store = ts.write_store(spark.createDataFrame(plain.corpus(), plain.SCHEMA), PATH)
        assert store.manifest_holds()
        store.recipes = damage(store.recipes)
        with pytest.raises(ValueError, match="manifest"):
            store.digests()


def test_encoder_equals_library():
    enc = ts.Encoder(open(PATH, encoding="utf-8").read())
    assert enc.piecewise
    rng = random.Random(1)
    alphabet = "abzABZ 019 \t\n\x1c\xa0éÉßŞİK'’.,!<|>́日本½²_-"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["it's <|endoftext|> x<|endoftext|>y they'LL'd ''s I'm", "", "  "]
    want = [np.array(e.ids, "<u2").tobytes() for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoded(enc, texts) == want == encoded(enc, texts)


def test_encoder_equals_library_on_all_code_points():
    enc = ts.Encoder(open(PATH, encoding="utf-8").read())
    rng = random.Random(3)
    points = [chr(c) for c in range(0x250)] + [" "] * 60 + ["̈", "İ", "\u2028", "\u200b", "\ufeff", "日", "😀"]
    texts = ["".join(rng.choice(points) for _ in range(rng.randrange(30))) for _ in range(20000)]
    texts += [chr(c) for c in range(0x250)] + [f"a{chr(c)}b {chr(c)}" for c in range(0x250)] + ["\x1b[0m", "a\x00b"]
    want = [np.array(e.ids, "<u2").tobytes() for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    bad = [t for t, a, b in zip(texts, encoded(enc, texts), want, strict=True) if a != b]
    assert not bad, [ascii(t) for t in bad[:5]]


def test_other_tokenizers_take_whole_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not ts.Encoder(open(path, encoding="utf-8").read()).piecewise
    from tokenizers import Tokenizer

    rows = plain.corpus()
    got = ts.write_store(spark.createDataFrame(rows, plain.SCHEMA), path).digests().collect()
    by_id = lambda rs: sorted((r[0] is None, r[0] or 0, r[2], r[3]) for r in rs)
    assert by_id(map(tuple, got)) == by_id(plain.token_rows(rows, Tokenizer.from_file(path)))


def test_cuts_cover_documents_and_follow_content():
    gear, rng = ts._gear(), np.random.default_rng(2)
    a = rng.integers(0, 49000, 9000).astype(np.uint16)
    b = np.concatenate([rng.integers(0, 49000, 700).astype(np.uint16), a])
    cuts = ts.cut_points(np.concatenate([a, b]), [len(a), len(b)], gear)
    for x, ends in zip((a, b), cuts, strict=True):
        assert ends[-1] == len(x) and all(0 < n <= ts.MOST for n in np.diff([0, *ends]))
    pieces = lambda x, e: {x[s:t].tobytes() for s, t in zip([0, *e], e, strict=False)}
    assert len(pieces(a, cuts[0]) & pieces(b, cuts[1])) >= len(cuts[0]) - 3


def test_empty_table(spark):
    assert ts.write_store(spark.createDataFrame([], plain.SCHEMA), PATH).digests().collect() == []
