import hashlib
import math
from collections import Counter, defaultdict

import plain
import public_tokenizers
from brightwater.llm import mixing, quality


def brute_mix(rows, weights=(5, 2, 1), budget=1.5, cap=2.0):
    """(doc_id, source, size, target, copies) by repeated resharing and one pass per source."""
    sized = [(r[0], r[3], len(plain.words5(r[1])), r[1]) for r in rows]
    total = defaultdict(int)
    for _, s, n, _ in sized:
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {}, budget * sum(total.values()), set(order)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = cap * total[s]
            left -= target[s]
            open_.remove(s)
    out = []
    for s in order:
        own = sorted([x for x in sized if x[1] == s], key=lambda x: (x[2], x[0] is None, x[0] or 0))
        digest = hashlib.md5((mixing.SEED + ("|null" if s is None else f"|={s}")).encode()).hexdigest()
        u, step = int(digest[:12], 16) / 2**48, target[s] / total[s] if total[s] else 0.0
        for i, x in enumerate(own):
            out.append((x[0], s, x[2], target[s], math.floor(step * (i + 1) + u) - math.floor(step * i + u), x[3]))
    return out


def test_mix_equals_brute_force(spark):
    rows = [r for r in plain.corpus()]
    got = mixing.mix(spark.createDataFrame(rows, plain.SCHEMA).selectExpr("*", "1 AS size", "2 AS _rank")).collect()
    want = brute_mix(rows)
    assert len(got) == len(rows)
    k = lambda x: tuple((v is None, v) for v in x)
    assert sorted([(x["doc_id"], x["source"], x["size"]) for x in got], key=k) == sorted([w[:3] for w in want], key=k)
    taken = Counter()
    for x in got:
        assert 0 <= x["copies"] <= 2 and x["taken"] == x["copies"] * x["size"]
        taken[x["source"]] += x["taken"]
    for s in {w[1] for w in want}:
        target = next(w[3] for w in want if w[1] == s)
        assert abs(next(x["target"] for x in got if x["source"] == s) - target) < 1e-6 * max(1, target)
        assert sum(x["copies"] for x in got if x["source"] == s) == sum(w[4] for w in want if w[1] == s)
        assert abs(taken[s] - target) <= 2 * max(w[2] for w in want if w[1] == s)
    again = mixing.mix(spark.createDataFrame(rows[::-1], plain.SCHEMA)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    many = mixing.mixed_documents(spark.createDataFrame(rows, plain.SCHEMA))
    assert many.columns == ["doc_id", "text", "lang", "source", "n_chars"] and many.count() == sum(x["copies"] for x in got)


def test_mix_empty(spark):
    assert mixing.mix(spark.createDataFrame([], plain.SCHEMA)).collect() == []


def test_pipeline_equals_plain_python(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline

    rows = [r for r in plain.corpus() if r[0] is not None]
    items = [(1, " ".join(rows[20][1].split()[2:14])), (2, "..."), (3, None)]
    labels = [(i, 1, 0) for i in range(0, 38)]
    docs = spark.createDataFrame(rows, plain.SCHEMA)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("labels", lab), ("benchmark", spark.createDataFrame(items, "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    verdict = {(r["doc_id"]): r["kept"] for r in quality.classify(docs, lab).collect()}
    left = [r for r in rows if verdict[r[0]]]
    near = plain.near_duplicates(left)
    seen, deduped = set(), []
    for r, n in sorted(zip(left, near, strict=True), key=lambda x: x[0][0]):
        if not n[1]:
            deduped.append(r)
        elif n[3] and n[2] not in seen:
            seen.add(n[2])
            deduped.append(r)
    clean = [r for r, c in zip(deduped, plain.contamination(deduped, items), strict=True) if not c[5]]
    mixed = [r for r in brute_mix(clean) for _ in range(r[4])]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = plain.token_rows([(m[0], m[5]) for m in mixed], tok)
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=lambda r: r[1])
    assert got == want


def stage_inputs(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, plain.SCHEMA).selectExpr("*", "'own' AS row", "1 AS key", "doc_id AS component_id", "'x' AS kept", "2 AS copies")
    for name, df in (("labels", spark.createDataFrame([(i, 1, 0) for i in range(38)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([(1, "a b c d e"), (None, None), (2, "")], "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return docs


def test_stages_take_nulls_empty_tables_and_further_columns(spark, tmp_path):
    import corpus_pipeline

    rows = plain.corpus()
    docs = stage_inputs(spark, tmp_path, rows)
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, str(tmp_path))
            n = out.count()
            if name == "token_ids":
                assert n == given.count()
                continue
            assert out.columns == docs.columns, name
            assert n == 0 if given is not docs else 0 < n <= 2 * len(rows), name
            if given is docs and name != "mix":  # null ids and texts stay, copies of a row go only in near_dedup
                assert out.where("doc_id IS NULL AND text IS NULL").count() == 1, name
                assert out.where("text IS NULL").count() == docs.where("text IS NULL").count(), name
