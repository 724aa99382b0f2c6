"""The registered queries of the training-data operators: thin calls with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dups import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS sh
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT x, y FROM common JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS MATERIALIZED (SELECT x, y FROM links UNION SELECT y, x FROM links),
r AS (SELECT x AS doc_id, x AS seen FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.seen = e.x),
c AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id, coalesce(component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_store import write_store

    return write_store(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).digests()


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import RULE_SCHEMA, judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, RULE_SCHEMA))


OP4_SQL = """
WITH rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
urls AS (
  SELECT page_id,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
fits AS (
  SELECT u.page_id, u.host, u.path, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY u.page_id, u.host, u.path ORDER BY length(r.host || r.path) DESC NULLS LAST) AS n
  FROM urls u LEFT JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE n = 1
"""


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_digests, store_texts

    return media_digests(store_texts(table(spark, sf_dir, "documents")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import held_out, identify, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    found = identify(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import repeated_strings

    return repeated_strings(table(spark, sf_dir, "documents"))


# Every window of 400 bytes by its digest; those that occur twice cover runs of bytes, what is left is put together in hex
OP6_SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS MATERIALIZED (SELECT r, i, md5_number(hex(b[i : i + 399])) AS h FROM (SELECT r, b, unnest(generate_series(1, octet_length(b) - 399)) AS i FROM d WHERE octet_length(b) >= 400)),
hit AS MATERIALIZED (SELECT r, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
runs AS MATERIALIZED (SELECT r, min(i) AS lo, max(i) + 399 AS hi FROM (
  SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM hit)) GROUP BY r, g),
ends AS (SELECT r, lo, hi FROM runs UNION ALL SELECT r, octet_length(b) + 1, octet_length(b) + 1 FROM d),
kept AS (SELECT r, lo, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo, hi), 0) + 1 AS a FROM ends),
parts AS (SELECT k.r, string_agg(CASE WHEN k.lo > k.a THEN hex(b[k.a : k.lo - 1]) ELSE '' END, '' ORDER BY k.lo) AS x FROM kept k JOIN d USING (r) GROUP BY k.r),
sums AS (SELECT r, sum(hi - lo + 1)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(x)) AS kept_sha256, octet_length(b)::BIGINT - coalesce(n_removed, 0) AS n_kept
FROM d JOIN parts USING (r) LEFT JOIN sums USING (r)
"""


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ordered AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS pos FROM per),
w AS (SELECT *, CASE (pos - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap FROM ordered),
lev AS (
  SELECT *, cap / w AS ratio,
    (1.5::DOUBLE * (SELECT sum(source_size)::DOUBLE FROM per) - coalesce(sum(cap) OVER (ORDER BY cap / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(w) OVER (ORDER BY cap / w, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
found AS (SELECT level FROM lev WHERE level <= ratio ORDER BY ratio, pos LIMIT 1),
targets AS (SELECT source, source_size, least(cap, coalesce(w * (SELECT level FROM found), cap)) AS target FROM lev),
placed AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS step,
    (('0x' || substr(md5('brightwater-mix' || CASE WHEN s.source IS NULL THEN '|null' ELSE '|=' || s.source END), 1, 12))::BIGINT)::DOUBLE / 281474976710656.0::DOUBLE AS u,
    row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id NULLS LAST) - 1 AS rank
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
taken AS (SELECT *, CAST(floor(step * (rank + 1) + u) - floor(step * rank + u) AS BIGINT) AS copies FROM placed)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM taken
"""


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# Words in a row of each text, joined with spaces; an occurrence of a window is a match of its words
OP9_SQL = """
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM bw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM wins),
dws AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM dw, ks WHERE len(w) >= k)),
hits AS (SELECT DISTINCT d.doc_id, d.i, d.k, t.item_id FROM dws d JOIN wins t ON d.k = t.k AND d.win = t.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("mark")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_dedup": op1_minhash_dedup,
        "op2_token_store": op2_token_store,
        "op3_media": op3_media,
        "op4_url_filter": op4_url_filter,
        "op5_language_id": op5_language_id,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_mix": op7_mix,
        "op8_secret_scan": op8_secret_scan,
        "op9_decontaminate": op9_decontaminate,
        "op10_quality": op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_dedup": OP1_SQL, "op4_url_filter": OP4_SQL, "op6_suffix_dedup": OP6_SQL, "op7_mix": OP7_SQL, "op9_decontaminate": OP9_SQL}
