"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.llm import byte_bpe, importance, langid, licenses, masked_lm, mixing, ngram_join, quality_rules, resharding, vantage
from murmura.sources import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[1]


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.cluster(table(spark, sf_dir, "documents"))


def op8_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.train_and_score(table(spark, sf_dir, "documents"))


def op9_vantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage.nearest(table(spark, sf_dir, "embeddings"))


def op10_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = resharding.reshard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_importance": op2_importance,
    "op3_langid": op3_langid,
    "op4_licenses": op4_licenses,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_quality_rules": op6_quality_rules,
    "op7_ngram_join": op7_ngram_join,
    "op8_masked_lm": op8_masked_lm,
    "op9_vantage": op9_vantage,
    "op10_resharding": op10_resharding,
}

ORACLE_SQL = {
    "op4_licenses": licenses.scan_sql(),
    "op1_mixing": rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk
  FROM sized GROUP BY source),
weighted AS (
  SELECT source, source_size, 1 + rnk % 3 AS w, 3 * source_size AS cap, (sum(source_size) OVER ())::BIGINT AS total FROM totals),
ordered AS (
  SELECT *, coalesce(sum(cap) OVER before, 0)::BIGINT AS used, (sum(w) OVER (ORDER BY cap / w::DOUBLE, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest
  FROM weighted WINDOW before AS (ORDER BY cap / w::DOUBLE, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (
  SELECT *, w::DOUBLE * (total - used)::DOUBLE > cap::DOUBLE * rest::DOUBLE AS is_full FROM ordered),
level AS (
  SELECT coalesce(sum(cap) FILTER (is_full), 0)::BIGINT AS used, (sum(w) FILTER (NOT is_full))::BIGINT AS rest FROM marked),
targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE (total - level.used)::DOUBLE * w / level.rest::DOUBLE END AS target
  FROM marked, level),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM targets),
bars AS (
  SELECT *, lower(lpad(to_hex(least(ceil((rate - floor(rate)) * {float(1 << mixing.BITS)}::DOUBLE), {(1 << mixing.BITS) - 1})::BIGINT), {mixing.BITS // 4}, '0')) AS bar FROM rates),
joined AS (
  SELECT s.doc_id, s.source, s.size, r.source_size, r.target, r.rate, r.bar
  FROM sized s JOIN bars r ON s.source IS NOT DISTINCT FROM r.source),
drawn AS (
  SELECT *, substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':20:' || k), 1, {mixing.BITS // 4}) < bar AS more
  FROM joined, (SELECT range AS k FROM range({mixing.DRAWS}))),
tries AS (
  SELECT source, k, abs(sum(CASE WHEN more THEN size ELSE 0 END)::DOUBLE - any_value(rate - floor(rate)) * any_value(source_size)) AS d
  FROM drawn GROUP BY source, k),
chosen AS (SELECT source, k FROM tries QUALIFY row_number() OVER (PARTITION BY source ORDER BY d, k) = 1)
SELECT j.doc_id, j.size, j.source_size, j.target, j.size * (floor(j.rate)::BIGINT + CASE WHEN j.more THEN 1 ELSE 0 END) AS taken
FROM drawn j JOIN chosen c ON j.source IS NOT DISTINCT FROM c.source AND j.k = c.k
""",
}
