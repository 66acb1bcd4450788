"""The queries opN_<name> over whole tables, and SQL that tells the same rows where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmosaic.llm.alignment import cross_align
from jobmosaic.llm.ball_tree import top_k
from jobmosaic.llm.byte_bpe import encode_and_decode
from jobmosaic.llm.chunking import repeated_spans
from jobmosaic.llm.co_training import score_quality
from jobmosaic.llm.exact_dedup import exact_dedup
from jobmosaic.llm.importance import resample
from jobmosaic.llm.language_id import held_out, identify_languages
from jobmosaic.llm.secret_scan import scan_secrets
from jobmosaic.llm.simhash import simhash_components
from jobmosaic.llm.source_mix import mix_documents
from jobmosaic.llm.suffix_array import cut_repeated_bytes
from jobmosaic.llm.token_counts import length_table

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_documents(spark, sf_dir))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(_documents(spark, sf_dir), words=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_table(_documents(spark, sf_dir), VOCABULARY, PATTERN)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(_documents(spark, sf_dir))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = encode_and_decode(_documents(spark, sf_dir), VOCABULARY, PATTERN)
    ids = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(_documents(spark, sf_dir), weights=(5, 2, 1), share=1.5, cap=2)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = identify_languages(docs, docs.filter(~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), query_every=50, k=5, scale=256)


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut_repeated_bytes(_documents(spark, sf_dir), length=200)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), percent=10, least_words=20, most=1, seed=2024, buckets=10_000)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_align(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_exact_dedup, op3_simhash_near_dedup, op4_token_counts, op5_substring_dedup, op6_quality_classifier, op7_byte_bpe, op8_source_mix, op9_language_id, op10_topk_search, op11_suffix_array_dedup, op12_importance_resampling, op13_tokenizer_alignment)}

_OP2 = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""

_OP8 = r"""
WITH d AS (
  SELECT doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM d GROUP BY source
), w AS (
  SELECT *, CAST(CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS weight, 2 * source_size AS most FROM s
), f AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS budget,
    sum(most) OVER o - most AS most_before,
    sum(weight) OVER () - sum(weight) OVER o + weight AS weight_left
  FROM w WINDOW o AS (ORDER BY most / weight, rank ROWS UNBOUNDED PRECEDING)
), g AS (SELECT *, most * weight_left <= (budget - most_before) * weight AS full_ FROM f
), h AS (
  SELECT *, coalesce(sum(most) FILTER (full_) OVER (), 0) AS most_full, coalesce(sum(weight) FILTER (NOT full_) OVER (), 1) AS weight_open FROM g
), p AS (
  SELECT source, source_size, CASE WHEN full_ THEN most::DOUBLE ELSE (budget - most_full) / weight_open * weight END AS target FROM h
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM p
), c AS (
  SELECT d.doc_id, d.size, q.source_size, q.target, q.whole, q.target - q.whole * q.source_size AS rest,
    sum(d.size) OVER u AS upto, sum(d.size) OVER (PARTITION BY d.source, d.place) AS tied
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
  WINDOW u AS (PARTITION BY d.source ORDER BY d.place RANGE UNBOUNDED PRECEDING)
)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN 2 * upto - tied <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""

#: crc32 of each different word, byte by byte over a table made by its rule.
_OP12 = r"""
WITH table_of AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n))
), docs AS (
  SELECT doc_id, row_number() OVER () AS row_, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), marks AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), d AS (SELECT row_, unnest(words) AS word FROM docs
), m AS (SELECT unnest(words) AS word FROM marks
), distinct_words AS (SELECT DISTINCT word FROM (SELECT word FROM d UNION ALL SELECT word FROM m)
), bytes AS (
  SELECT word, list_transform(range(length(hex(word)) // 2), lambda i: CAST('0x' || substr(hex(word), 2 * i + 1, 2) AS BIGINT)) AS b FROM distinct_words
), buckets AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, table_of
), s AS (SELECT bucket, count(*) AS n FROM d JOIN buckets USING (word) GROUP BY bucket
), t AS (SELECT bucket, count(*) AS n FROM m JOIN buckets USING (word) GROUP BY bucket
), totals AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t_all
), gains AS (
  SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + 10000) / ((s.n + 1)::DOUBLE * (t_all + 10000)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), totals
), weights AS (
  SELECT row_, CAST(sum(gain) AS BIGINT) AS weight FROM d JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY row_
), scores AS (
  SELECT docs.row_, doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM docs LEFT JOIN weights USING (row_)
), places AS (
  SELECT row_, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS eligible FROM scores WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * eligible // 100 THEN place END AS rank FROM scores LEFT JOIN places USING (row_)
"""

ORACLE_SQL = {"op12_importance_resampling": _OP12, "op2_exact_dedup": _OP2, "op8_source_mix": _OP8}
