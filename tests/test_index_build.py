"""The index build: words counted where a chunk is read, blocks made behind one shuffle; texts in pieces for phrase matching."""

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from voltaic.operators import phrases as P
from voltaic.operators import postings as I
from voltaic.operators import search as S


def _exchanges(df):
    return len(re.findall(r"\bExchange\b", df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]))


def test_words_are_counted_without_a_shuffle(spark):
    rows = [(1, 1, "b a b c b A"), (2, 1, ""), (3, 1, "a"), (4, 2, None), (5, 1, "b b"), (6, 1, "x y z y")]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_id long, content string")
    postings, stats = S.build_index(chunks)
    assert _exchanges(postings) == 0
    want = {(d, c, t, n, sum(w.values())) for d, c, x in rows for w in [Counter((x or "").lower().split())] for t, n in w.items()}
    assert {(r.doc_id, r.chunk_id, r.token, r.tf, r.dl) for r in postings.collect()} == want


def test_repeated_and_null_ids_add_up(spark):
    rows = [(1, 1, "b a b"), (1, 1, "b a b"), (None, 1, "a c"), (None, 1, "a d"), (2, 1, "b"), (2, None, "b")]
    postings, _ = S.build_index(spark.createDataFrame(rows, "doc_id long, chunk_id long, content string"))
    got = sorted(((r.doc_id, r.chunk_id, r.token, r.tf) for r in postings.collect()), key=str)
    assert got == sorted([(1, 1, "a", 2), (1, 1, "b", 4), (None, 1, "a", 2), (None, 1, "c", 1), (None, 1, "d", 1), (2, 1, "b", 1),
                          (2, None, "b", 1)], key=str)


def test_blocks_are_made_behind_one_shuffle(spark, monkeypatch):
    for name, value in (("LIST_SIZE", 300), ("TASK_POSTINGS", 500), ("BLOCK_SIZE", 50)):
        monkeypatch.setattr(I, name, value)
    p = spark.range(6000).select(
        F.when(F.col("id") % 2 == 0, F.lit("the")).otherwise(F.concat(F.lit("w"), (F.col("id") % 97).cast("string"))).alias("token"),
        F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("chunk_id"), (F.col("id") % 3 + 1).alias("tf"), (F.col("id") % 40 + 9).alias("dl"))
    blocks = I.to_blocks(p, 20.0, buckets=4)
    assert _exchanges(blocks) <= 2                       # postings, and the few counted lists sent to every task
    rows = blocks.withColumn("task", F.spark_partition_id()).collect()
    assert len({r.block for r in rows}) == len(rows) and max(r.n for r in rows) <= 50 and len({r.task for r in rows}) > 4
    assert all(len({r.bucket for r in rows if r.task == t}) == 1 for t in {r.task for r in rows})
    assert all((r.n, r.cf, r.max_tf, r.min_dl) == (len(r.postings), sum(x.tf for x in r.postings), max(x.tf for x in r.postings),
                                                   min(x.dl for x in r.postings)) for r in rows)
    got = sorted((r.token, x.doc_id, x.tf, x.dl) for r in rows for x in r.postings)
    assert got == sorted((r.token, r.doc_id, r.tf, r.dl) for r in p.collect())


def test_texts_are_matched_in_pieces(monkeypatch):
    monkeypatch.setattr(P, "PIECE_TOKENS", 10)
    texts = [["a", "b"], [], None, ["a"] * 25, ["c", "a", "b"], ["b"]] * 4
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.list_(pa.string())), pa.array([[]] * len(texts), P._MATCHES)],
                                       names=["id", "_tokens", "_found"])
    shared = type("B", (), {"value": P.build_trie([(["a", "b"], "X")])})
    out = list(P._look_up(shared, True, True)([batch]))
    assert len(out) > 4 and [i for b in out for i in b.column(0).to_pylist()] == list(range(len(texts)))
    assert [x for b in out for x in b.column(2).to_pylist()] == ["X", "", "", " ".join("a" * 25), "c X", "b"] * 4
