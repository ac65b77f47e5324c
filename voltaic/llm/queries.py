"""The registered queries ``opN_<name>``: each applies one operator to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltaic.llm.centroids import cluster_vectors
from voltaic.llm.decontam import benchmark_hits, is_contaminated
from voltaic.llm.html import extract_main_text
from voltaic.llm.jaccard import jaccard_join
from voltaic.llm.langid import fold_of, identify, train
from voltaic.llm.linededup import drop_recurring_lines
from voltaic.llm.lm import fit as fit_network, score_documents
from voltaic.llm.mixing import block_positions, mix_sources, source_plan
from voltaic.llm.pstable import embedding_dedup
from voltaic.llm.quality import fit as fit_quality, score_quality
from voltaic.llm.registry import register
from voltaic.llm.sharding import assign_shards
from voltaic.llm.tokenfile import read_token_files, write_token_files
from voltaic.llm.whitening import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


@register("op1_ngram_jaccard_join")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), shingle=4, num=85, den=100)


def _masked_sql(line: str) -> str:
    spaced = f"trim(regexp_replace({line}, '[ \\t\\x0B\\f\\r]+', ' ', 'g'), ' ')"
    return f"regexp_replace({spaced}, '[^ ]*[0-9][^ ]*', '<*>', 'g')"


@register("op2_line_template_dedup", f"""
WITH forms AS (
  SELECT DISTINCT key, form, tokens, [CAST(tokens AS VARCHAR), array_to_string(string_split(form, ' ')[1:3], ' ')] AS leaf
  FROM (SELECT key, form, CASE WHEN form = '' THEN 0 ELSE length(form) - length(replace(form, ' ', '')) + 1 END AS tokens
        FROM (SELECT text AS key, unnest(list_transform(string_split(text, chr(10)), lambda l: {_masked_sql('l')})) AS form
              FROM documents WHERE text IS NOT NULL))
  WHERE tokens >= 3),
busy AS (SELECT leaf FROM forms GROUP BY leaf HAVING COUNT(DISTINCT key) >= 5),
variants AS (SELECT DISTINCT leaf, form, tokens FROM forms JOIN busy USING (leaf)),
counts AS (SELECT leaf, COUNT(*) AS variants FROM variants GROUP BY leaf HAVING COUNT(*) > 1),
words AS (SELECT leaf, form, variants, unnest(string_split(form, ' ')) AS word, unnest(range(tokens)) AS pos
          FROM variants JOIN counts USING (leaf)),
often AS (SELECT leaf, pos, word, COUNT(*) AS n FROM words WHERE pos >= 3 GROUP BY leaf, pos, word, variants
          HAVING 2 * COUNT(*) >= variants),
common AS (SELECT leaf, pos, word FROM often
           QUALIFY row_number() OVER (PARTITION BY leaf, pos ORDER BY n DESC, word) = 1),
agrees AS (SELECT leaf, form, COUNT(*) AS agree FROM words JOIN common USING (leaf, pos, word) GROUP BY leaf, form),
mapped AS (SELECT leaf, form, COALESCE(agree, 0) + least(tokens, 3) >= CAST(0.7 AS DOUBLE) * tokens AS general
           FROM variants LEFT JOIN agrees USING (leaf, form)),
templates AS (SELECT leaf, form, general, CASE WHEN general THEN leaf ELSE [form] END AS template FROM mapped),
recurring AS (SELECT general, template FROM templates JOIN forms USING (leaf, form) GROUP BY general, template
              HAVING COUNT(DISTINCT key) >= 5),
gone AS (SELECT COALESCE(list(DISTINCT form), []) AS gone FROM templates JOIN recurring USING (general, template)),
cut AS (SELECT doc_id, string_split(text, chr(10)) AS lines,
               list_filter(string_split(text, chr(10)), lambda l: NOT list_contains(gone, {_masked_sql('l')})) AS kept
        FROM documents, gone)
SELECT doc_id, CAST(COALESCE(len(lines), 0) AS INTEGER) AS n_lines,
       CAST(COALESCE(len(lines) - len(kept), 0) AS INTEGER) AS n_dropped,
       CASE WHEN lines IS NOT NULL THEN md5(COALESCE(array_to_string(kept, chr(10)), '')) END AS kept_md5
FROM cut""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_recurring_lines(table(spark, sf_dir, "documents"), min_texts=5)
    return out.select("doc_id", "n_lines", "n_dropped", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


@register("op3_stratified_shards")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def _seeded_sql(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


@register("op5_temperature_mixing", f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS src,
         len(regexp_extract_all(COALESCE(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS tokens,
         {_seeded_sql("concat_ws('|', 'mix', COALESCE(CAST(doc_id AS VARCHAR), ''))")} AS h
  FROM documents),
totals AS (SELECT src, CAST(SUM(tokens) AS BIGINT) AS tokens FROM docs GROUP BY src),
steps(n, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT n + 1, lo + greatest(i - 1, 0) * ((hi - lo) / 16), lo + i * ((hi - lo) / 16)
  FROM (SELECT n, lo, hi, COALESCE(
          (SELECT MIN(p.i) FROM (
             SELECT r.i, MAX(pow(t.tokens, steps.lo + r.i * ((steps.hi - steps.lo) / 16)) / t.tokens)
                         / MIN(pow(t.tokens, steps.lo + r.i * ((steps.hi - steps.lo) / 16)) / t.tokens) AS most
             FROM totals t, (SELECT unnest(range(17)) AS i) r WHERE t.tokens > 0 GROUP BY r.i) p WHERE p.most <= 2.0), 16) AS i
        FROM steps WHERE n < 8)),
alpha AS (SELECT hi AS a FROM steps WHERE n = 8),
powers AS (SELECT src, tokens, pow(tokens, a) AS p FROM totals, alpha WHERE tokens > 0),
norm AS (SELECT SUM(p) AS z, MIN(p / tokens) AS least FROM powers),
passes AS (SELECT src, tokens, ROUND(p / z * (z / least) / tokens, 9) AS passes FROM powers, norm
           UNION ALL SELECT src, tokens, 1.0 FROM totals WHERE tokens = 0),
plan AS (SELECT src, CAST(floor(passes) AS INTEGER) AS whole,
                CAST(floor((passes - floor(passes)) * tokens) AS BIGINT) AS rest FROM passes),
taken AS (SELECT d.*, whole + CASE WHEN rest > 0 AND SUM(tokens) OVER (PARTITION BY src ORDER BY h) <= rest THEN 1 ELSE 0 END
                 AS times FROM docs d JOIN plan USING (src)),
mixed AS (SELECT doc_id, source, src, tokens, CAST(unnest(range(1, times + 1)) AS INTEGER) AS epoch FROM taken)
SELECT doc_id, source, epoch, CAST(tokens AS BIGINT) AS tokens,
       row_number() OVER (PARTITION BY src, epoch ORDER BY
         {_seeded_sql("concat_ws('|', 'mix', CAST(epoch AS VARCHAR), COALESCE(CAST(doc_id AS VARCHAR), ''))")}, doc_id, tokens) - 1
         AS position
FROM mixed""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return block_positions(mix_sources(docs, source_plan(docs, max_repeat=2.0)))


@register("op7_winnowing_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13)
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                       is_contaminated().alias("contaminated"))


@register("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False))
    model = train(docs, ~held_out)
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@register("op6_embedding_near_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"), least_cosine=0.9)


@register("op10_html_main_text")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


@register("op4_quality_neighbour_votes")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False))
    model = fit_quality(docs, table(spark, sf_dir, "labels"), ~held_out)
    return score_quality(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@register("op9_masked_pseudo_likelihood")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit_network(docs))


@register("op11_subvector_clusters")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = cluster_vectors(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dim=64, scale=256.0, seed=2)
    return placed.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                         F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256).alias("centroid_sha256"))


@register("op12_incremental_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), components=4, scale=256.0)


@register("op13_token_files")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path
    files = write_token_files(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), end_id=0)
    return read_token_files(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
