"""Exact search on awkward vectors; the inverted file's recall against it, crowded lists and odd rows."""
import random

import pytest
from pyspark.sql import functions as F

from voltaic.operators import search as S
from voltaic.operators import vector_index as V
from voltaic.sources.tables import Tables

NAN, INF = float("nan"), float("inf")
ODD = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.9, 0.1]), (4, None), (5, [NAN, 1.0]), (6, [INF, 1.0]), (7, [None, 1.0]), (8, []),
       (9, [1.0, 0.0, 0.0]), (10, [-1e-200, 1e-200]), (11, [1e200, -1e200]), (3, [0.9, 0.1])]


def found(df):
    return [(r.query_id, r.rank, r.vec_id, r.cosine) for r in df.orderBy("query_id", "rank").collect()]


def want(rows, queries, k):
    import math
    ok = lambda v: v and None not in v and all(map(math.isfinite, v)) and any(v)
    out = []
    for qid, q in queries:
        if not ok(q):
            continue
        unit = lambda v: [x / math.hypot(*[y / max(map(abs, v)) for y in v]) / max(map(abs, v)) for x in v]
        got = sorted((-round(sum(a * b for a, b in zip(unit(q), unit(v))), 6), i) for i, v in rows if ok(v) and len(v) == len(q))
        out += [(qid, r + 1, i, -c) for r, (c, i) in enumerate(got[:k])]
    return out


def test_exact_search_skips_vectors_without_a_direction(spark):
    corpus = spark.createDataFrame(ODD, "vec_id long, embedding array<double>")
    queries = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [NAN, 0.0]), (5, [0.0, 2.0, 0.0]), (6, [3.0, 3.0])]
    q = spark.createDataFrame(queries, "query_id long, qvec array<double>")
    assert found(S.vector_search(corpus, q, 4)) == want(ODD, queries, 4)
    assert found(S.vector_search(corpus, q.where("query_id in (2, 3)"), 4)) == []
    assert found(S.vector_search(corpus.limit(0), q, 4)) == []
    path = V.write_vector_index(corpus)
    heads = spark.read.parquet(path + "/centroids").count()
    assert found(V.search_vector_index(spark, path, q, 4, probes=heads)) == want(ODD, queries, 4)
    assert found(V.search_vector_index(spark, V.write_vector_index(corpus.where("vec_id = 2")), q, 4)) == []


def recall(spark, corpus, queries):
    exact = {(q, i) for q, _, i, _ in found(S.vector_search(corpus, queries, 5))}
    path = V.write_vector_index(corpus)
    got = found(V.search_vector_index(spark, path, queries, 5))
    cosines = {(q, i): c for q, _, i, c in found(S.vector_search(corpus, queries, 5))}
    assert all(cosines.get((q, i), c) == c for q, _, i, c in got)
    assert spark.read.parquet(path + "/lists").count() == corpus.where(S.has_direction(F.col("embedding"))).count()
    return len(exact & {(q, i) for q, _, i, _ in got}) / len(exact), path


def test_recall_on_the_given_vectors(spark):
    emb = Tables(spark, "/root/testdata/sf0.01").embeddings
    q = emb.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    assert recall(spark, emb, q)[0] >= 0.9


@pytest.mark.parametrize("hot", [0.0, 0.5])
def test_recall_on_clusters_and_one_crowded_list(spark, hot):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(30)]
    rows = []
    for i in range(3000):
        c = centres[0] if rng.random() < hot else rng.choice(centres)
        rows.append((i, [x + rng.gauss(0, 0.15) for x in c], "other"))
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>, list string")
    q = corpus.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    got, path = recall(spark, corpus, q)
    assert got >= 0.9
    heads = spark.read.parquet(path + "/centroids").collect()
    assert heads[0].probes <= len(heads) // 2                   # clusters: a search reads a part of the lists
