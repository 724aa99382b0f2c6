import math
import random
import statistics
from collections import defaultdict

import plain
import pytest
from brightwater.llm import quality as ql
from brightwater.llm.common import SharedTables


def rows_and_labels():
    rng = random.Random(4)

    def prose(n):
        return " ".join(f"{rng.choice(plain.WORDS)}{rng.choice(plain.WORDS)}" for _ in range(n))

    rows = [(i, prose(rng.randrange(5, 60)), "en" if i % 3 else "fr", "s", None) for i in range(160)]
    labels = [(i, 1, 0) for i in range(120)] + [(5, 0, 0), (6, 1, 1), (7, None, None), (None, 1, 0)]
    rows += [(900, "qqq zzjx wvvk !!@@ ##$$ qzx jjq", "en", "s", None), (901, prose(50) + " xqzjvw " + prose(50), "en", "s", None), (902, None, "en", "s", None), (903, "", None, "s", None), (904, "no model", "xx", "s", None), (5, prose(9), "en", "s", None), rows[3], rows[3]]
    return rows, labels


def brute(rows, trusted):
    """lang -> function of (context, byte): interpolated modified Kneser-Ney probabilities."""
    models = {}
    for lang in {r[2] for r in rows if r[2]}:
        grams = [defaultdict(int) for _ in range(ql.ORDER + 1)]
        for r in rows:
            if r[2] == lang and r[0] in trusted and r[1]:
                data = bytes(ql.padded(r[1]))
                for i in range(ql.ORDER, len(data) + 1):
                    grams[ql.ORDER][data[i - ql.ORDER : i]] += 1
        if not grams[ql.ORDER]:
            continue
        for n in range(ql.ORDER - 1, 0, -1):
            for g in grams[n + 1]:
                grams[n][g[1:]] += 1
        stats = []
        for n in range(1, ql.ORDER + 1):
            t = [sum(1 for c in grams[n].values() if c == i) for i in range(5)]
            y = t[1] / (t[1] + 2 * t[2]) if t[1] + 2 * t[2] else 0.5
            d = [0.0] * 4
            for i in (1, 2, 3):
                raw = i - (i + 1) * y * t[i + 1] / t[i] if t[i] else 0.5 * i
                d[i] = min(max(raw, 0.1 * i), 0.95 * i)
            total, freed = defaultdict(float), defaultdict(float)
            for g, c in grams[n].items():
                total[g[:-1]] += c
                freed[g[:-1]] += d[min(c, 3)]
            stats.append((d, total, freed))

        def prob(ctx, b, n=ql.ORDER, grams=grams, stats=stats):
            if n == 0:
                return 1 / 256
            d, total, freed = stats[n - 1]
            c = ctx[len(ctx) - n + 1 :]
            lower = prob(ctx, b, n - 1, grams, stats)
            if c not in total:
                return lower
            count = grams[n].get(c + bytes([b]), 0)
            return (count - d[min(count, 3)] if count else 0) / total[c] + freed[c] / total[c] * lower

        models[lang] = prob
    return models


@pytest.mark.parametrize("limits", [(6_000_000, 4_000_000), (300, 0)])
def test_scores_equal_brute_force(spark, monkeypatch, limits):
    monkeypatch.setattr(ql, "MODEL_ROWS", limits[0])
    monkeypatch.setattr(ql, "TRUSTED_IDS", limits[1])
    rows, labels = rows_and_labels()
    docs = spark.createDataFrame(rows, plain.SCHEMA).withColumnRenamed("n_chars", "key")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    tables = SharedTables(spark, "t")
    ids = ql.trusted_ids(lab)
    learned = {r[0] for r in ids.where(~ql.left_out(ids["doc_id"])).collect()}
    assert 5 not in learned and 6 not in learned and 7 not in learned
    named = docs.selectExpr("doc_id", "text", f"coalesce(lang, '{ql.NO_LANG}') AS lang")
    got = ql.score(named, ql.train(tables, named, ids)).collect()
    models = brute(rows, learned)
    want = {}
    for r in rows:
        if not r[1] or r[2] not in models:
            want.setdefault((r[0], r[1]), (None, None, None))
            continue
        data = bytes(ql.padded(r[1]))
        s = [-math.log(models[r[2]](data[: i], data[i])) for i in range(ql.ORDER - 1, len(data))]
        peak, at, rates = 0.0, 0, []
        for w in r[1].lower().encode().split():
            at = r[1].lower().encode().index(w, at)
            if len(w) >= ql.PEAK_BYTES:
                peak = max(peak, sum(s[at : at + len(w)]) / len(w))
            rates.append(sum(s[at : at + len(w)]) / len(w))
            at += len(w)
        want[(r[0], r[1])] = (sum(s), peak, min((statistics.pstdev(rates[i : i + ql.FLAT_WORDS]) for i in range(len(rates) - ql.FLAT_WORDS + 1)), default=None))
    assert len(got) == len(rows)
    assert sorted(x["nats"] is None for x in got) == sorted(want[(r[0], r[1])][0] is None for r in rows)
    by_id = defaultdict(list)
    for x in got:
        by_id[x["doc_id"]].append((x["nats"], x["peak"], x["spread"]))
    for (i, _), w in want.items():
        assert any((g[0] is None and w[0] is None) or (g[0] is not None and w[0] is not None and abs(g[0] - w[0]) < 1e-3 * max(1, w[0]) and abs(g[1] - w[1]) < 1e-3 and (g[2] is None) == (w[2] is None) and abs((g[2] or 0) - (w[2] or 0)) < 1e-3) for g in by_id[i]), (i, w, by_id[i])


def test_rejects_junk_and_insults_and_keeps_clean(spark):
    rows, labels = rows_and_labels()
    docs, lab = spark.createDataFrame(rows, plain.SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in ql.classify(docs, lab).collect()}
    assert not kept[900] and not kept[901] and kept[902] and kept[903] and kept[904]
    assert sum(kept[i] for i in range(160)) >= 150
    left = ql.keep_good(docs, lab)
    assert left.columns == docs.columns and left.where("doc_id in (900, 901)").count() == 0 and left.where("doc_id = 3").count() == 3


def test_rejects_repeated_words(spark):
    rows, labels = rows_and_labels()
    words = rows[0][1].split()[:5]
    rows += [(2000, rows[0][1] + f" {words[0]}" * 30, "en", "s", None), (2001, " ".join(w for w in words for _ in range(20)), "en", "s", None), (2002, f"{words[0]} " * 5, "en", "s", None)]
    got = {r["doc_id"]: r for r in ql.classify(spark.createDataFrame(rows, plain.SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert not got[2000]["kept"] and not got[2001]["kept"] and got[2000]["spread"] < 1e-3 and got[2002]["spread"] is None
    assert sum(got[i]["kept"] for i in range(160)) >= 150


def test_empty_tables(spark):
    empty = spark.createDataFrame([], plain.SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert ql.classify(empty, none).count() == 0
    rows, _ = rows_and_labels()
    assert ql.classify(spark.createDataFrame(rows, plain.SCHEMA), none).where("NOT kept").count() == 0


def test_very_long_clean_documents_stay(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 11))) for _ in range(20000)]
    weights = [1 / (i + 10) for i in range(len(vocabulary))]

    def prose(n):
        return " ".join(rng.choices(vocabulary, weights, k=n))

    rows = [(i, prose(rng.randrange(20, 100)), "en", "s", None) for i in range(600)]
    rows += [(1000 + i, prose(6000), "en", "s", None) for i in range(20)]
    docs, lab = spark.createDataFrame(rows, plain.SCHEMA), spark.createDataFrame([(i, 1, 0) for i in range(600)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in ql.classify(docs, lab).collect()}
    assert sum(kept[1000 + i] for i in range(20)) >= 18
    assert sum(kept[i] for i in range(600)) >= 585


def test_limits_come_from_unseen_documents(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 11))) for _ in range(3000)]

    def prose():
        return " ".join(rng.choices(vocabulary, k=rng.randrange(20, 60)))

    rows = [(i, prose(), "en", "s", None) for i in range(300)] + [(1000 + i, prose(), "fr", "s", None) for i in range(60)]
    labels = [(i, 1, 0) for i in range(120)] + [(1000, 1, 0), (1001, 1, 0)]
    docs, lab = spark.createDataFrame(rows, plain.SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in ql.classify(docs, lab).collect()}
    assert all(got[1000 + i]["kept"] and got[1000 + i]["peak_limit"] is None for i in range(60))
    assert len({r["perplexity_limit"] for i, r in got.items() if i < 300}) == 1
    # the limit is the quantile of the scores that plain models of the other parts give
    trusted = spark.createDataFrame([(i,) for i in range(120)], "doc_id long")
    part = {r[0]: r[1] for r in trusted.select("doc_id", ql.fold(trusted["doc_id"])).collect()}
    assert sum(p == 0 for p in part.values()) < ql.LEAST_HELD
    scores = []
    for p in range(ql.HOLD_OUT):
        prob = brute(rows[:300], {i for i in part if part[i] != p})["en"]
        for i in [i for i in part if part[i] == p]:
            data = bytes(ql.padded(rows[i][1]))
            s = [-math.log(prob(data[:k], data[k])) for k in range(ql.ORDER - 1, len(data))]
            scores.append(math.exp(sum(s) / len(s)))
    assert got[0]["perplexity_limit"] == pytest.approx(sorted(scores)[math.ceil(0.99 * 120) - 1], rel=1e-3)
