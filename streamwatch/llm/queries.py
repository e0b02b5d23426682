"""The registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chosen_path, filter_audit, html_wrappers, kdtree, language_id, mixing, packing, periodic_runs, pii, sharding, token_counts, toxicity, winnowing
from .common import read

COUNT_MODEL, PACK_MODEL = "piece_bpe_32k.model", "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_kd_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_documents(read(spark, sf_dir, "documents"))


def op3_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


def op4_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.join_documents(read(spark, sf_dir, "documents"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(read(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), tokenizer_path(COUNT_MODEL))


def op7_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path(PACK_MODEL))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprint_documents(read(spark, sf_dir, "documents"))


def op10_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract_pages(read(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_documents(read(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest_documents(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_kd_tree_search, op2_personal_data, op3_stratified_shards, op4_chosen_path_join, op5_source_mix,
        op6_token_counts, op7_cutting_stock_packing, op8_toxicity, op9_winnowing, op10_html_wrappers, op11_filter_audit,
        op12_language_filters, op13_periodic_runs,
    )
}

ORACLES: dict[str, str] = {}

ORACLES["op1_kd_tree_search"] = """
WITH parts AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256.0::DOUBLE * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)), TRUE)
),
scores AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.row <> c.row AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

ORACLES["op5_source_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         len(regexp_extract_all(coalesce(text, ''), '[#$%&*!?~^|<>{}\[\]=_+]{2,}')) AS marks, len(regexp_extract_all(coalesce(text, ''), '[0-9]')) AS digits,
         CAST(length(coalesce(text, '')) AS DOUBLE) AS chars, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
),
m AS (SELECT *, chars / (size + 1) AS mean FROM d),
w AS (
  SELECT *, 0.25::DOUBLE + 0.25::DOUBLE * (CAST(size AS DOUBLE) / (size + 4 * marks + 1)) + 0.25::DOUBLE * (1.0::DOUBLE - digits / (chars + 1))
         + 0.25::DOUBLE * CASE WHEN mean < 3 THEN mean / 3.0::DOUBLE WHEN mean > 10 THEN 10.0::DOUBLE / mean ELSE 1.0::DOUBLE END AS weight
  FROM m
),
k AS (SELECT *, -ln((CAST(('0x' || substr(h, 1, 12)) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 281474976710656.0::DOUBLE) / weight AS key FROM w),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
o AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS sw FROM s),
l AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / sw, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(sw) OVER () - coalesce(sum(sw) OVER (ORDER BY 2.0::DOUBLE * source_size / sw, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level,
         row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / sw, source IS NULL, source) AS place
  FROM o
),
f AS (SELECT arg_min(level, place) AS level FROM l WHERE level * sw < cap),
t AS (SELECT source, source_size, round(coalesce(least(cap, f.level * sw), cap), 6) AS target FROM l LEFT JOIN f ON TRUE),
p AS (
  SELECT k.doc_id, k.size, t.source_size, t.target, k.source, k.weight, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, h, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, source, weight,
       CAST(epochs * size + greatest(0, least(size, round(target) - epochs * source_size - before)) AS BIGINT) AS taken
FROM p
"""

ORACLES["op11_filter_audit"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
),
l AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, FALSE)) AS good, bool_or(coalesce(toxic = 1, FALSE)) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
),
f AS (
  SELECT d.part, l.good, l.toxic,
         CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id
),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
),
g AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, n, good, toxic, fails,
         contains(fails, substr(filter_order, step, 1)) AS here, length(translate(substr(filter_order, 1, step - 1), fails, '')) < step - 1 AS gone
  FROM m, o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step) s
),
r AS (
  SELECT part, filter_order, step, letter,
         CAST(coalesce(sum(n) FILTER (WHERE NOT here AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE here AND NOT gone), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (WHERE here AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (WHERE fails = letter), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (WHERE here AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (WHERE here AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM g GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM r
"""
