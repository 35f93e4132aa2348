"""The opN_<name> queries: each applies its operator with production parameters to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivane.llm import ann, crosstok, html_extract, itq_dedup, langid, mixing, ngram_join, packing, pii, pitman_yor, sharding, tandem, toxicity
from trivane.llm.common import held_out, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.not_held_out())
    return toxicity.score(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out("doc_id", 4, 2)
    model = langid.fit(docs, ~out)
    return langid.predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "cosine", "rejected")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_itq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op11_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pitman_yor.score(table(spark, sf_dir, "documents"), pitman_yor.not_held_out())
    return rows.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op12_crosstok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstok.align(table(spark, sf_dir, "documents"))


def op13_tandem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tandem.digest(tandem.find(table(spark, sf_dir, "documents"), tandem.planted))


OP4_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, text, coalesce(CAST(doc_id AS VARCHAR), '~') AS k FROM documents),
crc_table AS (
  SELECT i, list_reduce(list_prepend(i, [0,0,0,0,0,0,0,0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM range(256) r(i)),
tab AS (SELECT list(v ORDER BY i) AS t FROM crc_table),
hexed AS (SELECT DISTINCT text, hex(encode(coalesce(text, ''))) AS h FROM d),
summed AS (
  SELECT text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h), 2), lambda p: ('0x' || substr(h, p + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295::BIGINT) AS crc
  FROM hexed, tab),
nodes AS (SELECT * FROM (VALUES (40), (41)) s(n)),
region AS (
  SELECT k, n, arg_min(r, -ln((('0x' || substr(md5(k || '|region|' || r), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0) + 1.1102230246251565e-16) / (CASE WHEN r < 2 THEN 20.0 ELSE 1.0 END)) AS r
  FROM (SELECT DISTINCT k FROM d), nodes, range(3) q(r) WHERE r < 2 OR n = 41 GROUP BY k, n),
rack AS (
  SELECT k, n, r, arg_min(a, -ln((('0x' || substr(md5(k || '|rack|' || r || '|' || a), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0) + 1.1102230246251565e-16) / 5.0) AS a
  FROM region, range(4) q(a) WHERE r < 2 OR a = 0 GROUP BY k, n, r),
leaf AS (
  SELECT k, n, r, a, arg_min(l, -ln((('0x' || substr(md5(k || '|shard|' || r || '|' || a || '|' || l), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0) + 1.1102230246251565e-16)) AS l
  FROM rack, range(5) q(l) WHERE r < 2 OR l = 0 GROUP BY k, n, r, a),
placed AS (SELECT k, max(r * 20 + a * 5 + l) FILTER (n = 40) AS shard, max(r * 20 + a * 5 + l) FILTER (n = 41) AS grown FROM leaf GROUP BY k),
rows AS (
  SELECT d.doc_id, strlen(coalesce(d.text, '')) + 16 AS size, summed.crc AS crc, placed.shard, placed.grown,
    ('0x' || substr(md5(k || '|slot'), 1, 13))::BIGINT AS u
  FROM d JOIN placed USING (k) JOIN summed ON d.text IS NOT DISTINCT FROM summed.text)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY u, doc_id NULLS FIRST, crc, size) - 1 AS BIGINT) AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM rows
"""

OP8_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '~') || '|mix|' || coalesce(md5(text), '~')), 1, 13))::BIGINT AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1 AS w FROM s),
r AS (SELECT *, 3 * source_size AS lim, CAST(3 * source_size AS DOUBLE) / w AS r FROM w),
l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(lim) OVER before, 0) AS DOUBLE) / CAST(sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS DOUBLE) AS lam
  FROM r WINDOW before AS (ORDER BY r, source COLLATE "C" NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT lam FROM l WHERE lam <= r ORDER BY r, source COLLATE "C" NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(CAST(lim AS DOUBLE), (SELECT lam FROM level) * w) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS base FROM t),
n AS (SELECT *, target - base * source_size AS need FROM b),
g AS (SELECT source, h, sum(size) AS part, count(*) AS n FROM d GROUP BY source, h),
c AS (SELECT source, h, part, n, sum(part) OVER (PARTITION BY source ORDER BY h) AS cum FROM g),
x AS (
  SELECT c.source, min(h) AS h, arg_min(part, h) AS part, arg_min(c.n, h) AS n, arg_min(cum, h) AS cum, any_value(need) AS need
  FROM c JOIN n ON c.source IS NOT DISTINCT FROM n.source WHERE need > 0 AND source_size > 0 AND cum > need GROUP BY c.source),
thr AS (SELECT source, h AS cut, CAST(floor((need - (cum - part)) * n / part + 0.5) AS BIGINT) AS take FROM x),
num AS (SELECT *, row_number() OVER (PARTITION BY source, h ORDER BY doc_id, size) AS i FROM d)
SELECT d.doc_id, d.size, n.source_size, n.target,
  CAST(d.size * (n.base + CASE WHEN d.h < thr.cut OR d.h = thr.cut AND d.i <= thr.take THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM num d JOIN n ON d.source IS NOT DISTINCT FROM n.source LEFT JOIN thr ON d.source IS NOT DISTINCT FROM thr.source
"""

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_pii, op3_packing, op4_sharding, op5_langid, op6_ann, op7_itq_dedup, op8_mixing, op9_ngram_join, op10_html, op11_pitman_yor, op12_crosstok, op13_tandem)}
ORACLES = {"op4_sharding": OP4_SQL, "op8_mixing": OP8_SQL}
