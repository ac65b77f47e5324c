"""Training-corpus pipeline: five stages over ``documents``, each one operator of ``voltaic.llm``.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; :func:`run` writes each stage's rows as
Parquet in the shared folder and reads them as the next stage's input. All stages but the last return the
columns of ``documents``.

Rows without an id, source or language and null or empty texts go through every stage: language ID rejects texts
without a letter, the others keep what they cannot judge. An empty table gives an empty result.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltaic.llm.decontam import benchmark_hits, is_contaminated
from voltaic.llm.graph import free_names, small_side
from voltaic.llm.jaccard import jaccard_join
from voltaic.llm.langid import identify, train
from voltaic.llm.mixing import mix_sources, source_plan
from voltaic.llm.sharding import assign_shards
from voltaic.session import cut_lineage

LEAST_LANGUAGE_SCORE = 0.5
SHARDS = 24


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8, learned from all rows with a language: drops documents without a letter and those whose
    best language has a posterior below ``LEAST_LANGUAGE_SCORE``."""
    model = train(docs, F.lit(True))
    found = identify(docs, model, keep=tuple(docs.columns))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1 on five-word shingles at a similarity of 0.8: the smallest id of each group stays, once."""
    joined = cut_lineage(jaccard_join(docs, shingle=5, num=80, den=100), "pipeline-components")
    gone = cut_lineage(joined.where("doc_id <> component_id").select("doc_id").distinct(), "pipeline-copies")
    twice = cut_lineage(joined.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
                        .where("n > 1").select("doc_id"), "pipeline-repeats")
    first = joined.where("doc_id = component_id").select("doc_id").distinct()
    # an id that stands for one group and was dropped from another (rows that repeat an id) stays
    gone = cut_lineage(gone.join(first, "doc_id", "left_anti"), "pipeline-gone")
    kept = docs.join(small_side(gone), "doc_id", "left_anti")
    if not twice.isEmpty():
        one = small_side(twice)
        kept = kept.join(one, "doc_id", "left_anti").unionByName(
            kept.join(one, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return kept.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7 against ``benchmark``: documents with one hit word in twenty go."""
    bench = spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet"))
    key, = free_names(docs, "_hit")
    hit = cut_lineage(benchmark_hits(docs, bench, window=13).where(is_contaminated())
                      .select(F.col("text_key").alias(key)).distinct(), "pipeline-hit")
    return docs.join(small_side(hit), F.xxhash64("text") == F.col(key), "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: every document at least once, small sources up to twice."""
    epoch, = free_names(docs, "epoch")
    return mix_sources(docs, source_plan(docs, max_repeat=2.0), epoch=epoch).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: shard and slot of every row."""
    return assign_shards(docs, SHARDS)


STAGES = [("language_id", language_id), ("ngram_jaccard_join", near_duplicates),
          ("benchmark_decontamination", decontamination), ("temperature_mixing", mixing),
          ("stratified_sharding", sharding)]

ORACLE_SQL = None     # language models and signature trees are not SQL: tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
