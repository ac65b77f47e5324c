"""what a refresh leaves on disk; blocks written in slices; ended documents are met where postings are read."""
import os
from collections import Counter

from pyspark.sql import functions as F

from voltaic import session
from voltaic.operators import postings as I
from voltaic.streaming import refresh as R

DOCS = "doc_id long, text string, lang string, source string, deleted boolean"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_a_refresh_leaves_nothing_staged(spark, tmp_path):
    before = set(os.listdir(session.checkpoint_dir(spark)))
    docs = spark.createDataFrame([(i, f"some words of text number {i}", "en", "web", False) for i in range(9)], DOCS)
    R.apply_batch(spark, str(tmp_path), docs, 0)
    R.apply_batch(spark, str(tmp_path), docs.where("doc_id < 4").withColumn("deleted", F.col("doc_id") == 1), 1)
    assert set(os.listdir(session.checkpoint_dir(spark))) == before
    assert {r.token: r.df for r in R.index_term_stats(spark, str(tmp_path)).collect()}["some"] == 8


def test_only_texts_of_repeated_ids_are_shuffled(spark):
    rows = [(1, "a", "en", "s", None), (2, "b", "en", "s", True), (None, "c", "en", "s", None)]
    newest, ids = R._newest(spark.createDataFrame(rows, DOCS))
    assert "Exchange" not in plan(newest) and sorted(r[0] for r in ids.collect()) == [1, 2]
    newest, _ = R._newest(spark.createDataFrame(rows + [(1, "z", "it", "s", None)], DOCS))
    assert sorted((r.doc_id, r.text, r.deleted) for r in newest.collect()) == [(1, "z", False), (2, "b", True)]


def test_blocks_in_slices_hold_all_postings(spark, tmp_path, monkeypatch):
    for name, value in (("LIST_SIZE", 300), ("TASK_POSTINGS", 100), ("BLOCK_SIZE", 50), ("SLICE_TOKENS", 500)):
        monkeypatch.setattr(I, name, value)
    p = spark.range(6000).select(
        F.when(F.col("id") % 2 == 0, F.lit("the")).otherwise(F.concat(F.lit("w"), (F.col("id") % 97).cast("string"))).alias("token"),
        F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("chunk_id"), (F.col("id") % 3 + 1).alias("tf"), (F.col("id") % 40 + 9).alias("dl"))
    path, calls, of = str(tmp_path / "blocks"), [], I._blocks_of
    monkeypatch.setattr(I, "_blocks_of", lambda *a: calls.append(a) or of(*a))
    for _ in range(2):                                   # a replayed batch writes the same
        I.write_blocks(p, 12_000, 20.0, path, buckets=8)
    assert len(calls) == 2 * min(8, -(-12_000 // max(500, 100 * spark.sparkContext.defaultParallelism))) > 2
    rows = spark.read.parquet(path).collect()
    assert len({r.block for r in rows}) == len(rows)
    key = lambda r: (r.bucket, r.token, r.level)
    want = Counter()
    for r in I.to_blocks(p, 20.0, buckets=8).collect():
        want[key(r)] += r.n
    got = Counter()
    for r in rows:
        got[key(r)] += r.n
    assert got == want
    assert sorted((r.token, x.doc_id, x.tf, x.dl) for r in rows for x in r.postings) == sorted((r.token, r.doc_id, r.tf, r.dl) for r in p.collect())


def test_stored_tables_leave_no_shuffle_files(spark):
    before = spark.conf.get(session._FREE_SHUFFLES, None)
    seen = []
    with session.shuffles_freed(spark):
        seen.append(spark.conf.get(session._FREE_SHUFFLES))
    assert seen == ["true"] and spark.conf.get(session._FREE_SHUFFLES, None) == before


def test_many_ended_documents_are_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dead = session.cut_lineage(spark.range(150_000).select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("until")))
        rows = spark.range(300_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("seg"))
        live = I.alive(rows, dead)
        assert "hashpartitioning" not in plan(live) and live.count() == 225_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
