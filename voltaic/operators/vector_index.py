"""R5, approximate form: an inverted file over learned centroids.

The centroids are fitted (Spark ML k-means, cosine distance) on a bounded sample: at most ``FIT_ROWS`` vectors, those with
the smallest seeded hash of their id, whatever the size of the corpus. Every vector is then indexed: it goes to
the list of its nearest centroid, and the lists are stored sorted, so a search reads only the lists it probes. A list is no
unit of work: a crowded one spreads over as many files and tasks as it needs.

How many lists a query probes is measured, not guessed: on the sample, the least number (doubling) that finds
``RECALL`` of the exact neighbours. On data without clusters that is a large part of all lists, and the
search is then hardly cheaper than the exact one.

Vectors without a direction (null, empty, zero, null or non-finite components) are not indexed and find nothing; those of
another length than most of the sample's are kept in list -1, which every query probes (lengths that differ never meet).
"""

from __future__ import annotations

import math
import os

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from voltaic.operators.relational import top_n_per_group
from voltaic.operators.search import best_rows, has_direction, normal, query_block, query_blocks, search_schema, vectors_by_length
from voltaic.session import cut_lineage, scratch_path

FIT_ROWS = 10_000
MOST_LISTS = 1_024
RECALL = 0.97           # aimed at on the sample; the corpus is held to 0.9 by the tests
PROBE_QUERIES = 256


def _assign(shared, names: list[str]):
    def run(batches):
        centroids = shared.value
        for batch in batches:
            lists = np.full(batch.num_rows, -1, np.int32)
            for rows, vectors in vectors_by_length(batch.column(1)):
                if vectors.shape[1] == centroids.shape[1]:
                    lists[rows] = (normal(vectors) @ centroids.T).argmax(1)
            yield pa.RecordBatch.from_arrays([pa.array(lists), batch.column(0), batch.column(1)], names=names)
    return run


def _probes_needed(sample: np.ndarray, centroids: np.ndarray, k: int) -> int:
    """The least number of lists (1, 2, 4, ..) with ``RECALL`` of the ``k`` nearest of the sample's first rows."""
    queries = sample[:PROBE_QUERIES]
    near = np.argsort(-(queries @ sample.T), axis=1, kind="stable")[:, :k]
    of = (sample @ centroids.T).argmax(1)
    place = np.empty((len(queries), len(centroids)), np.int64)      # at which probe a query reaches each list
    np.put_along_axis(place, np.argsort(-(queries @ centroids.T), axis=1), np.arange(len(centroids))[None], 1)
    reached = np.take_along_axis(place, of[near], 1)
    probes = 1
    while probes < len(centroids) and (reached < probes).mean() < RECALL:
        probes *= 2
    return min(probes, len(centroids))


def write_vector_index(corpus: DataFrame, path: str | None = None, lists: int | None = None, k: int = 5, seed: int = 7,
                       id_col: str = "vec_id", vec_col: str = "embedding") -> str:
    """Fits, indexes every vector and returns the index folder (``lists``: about the root of the number of vectors)."""
    spark = corpus.sparkSession
    path = path or scratch_path(spark, "vector-index")
    rows = corpus.where(has_direction(F.col(vec_col))).select(id_col, F.col(vec_col).cast("array<double>").alias(vec_col))
    drawn = cut_lineage(rows.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(FIT_ROWS), "vector-sample")
    sizes = drawn.groupBy(F.size(vec_col).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        centroids, probes = np.zeros((0, 1)), 0
    else:
        fit = drawn.where(F.size(vec_col) == sizes.d).select(vec_col)
        largest = F.array_max(F.transform(vec_col, F.abs))        # no square over- or underflows
        lists = lists or min(MOST_LISTS, max(1, math.isqrt(rows.count())))
        model = KMeans(k=max(2, min(lists, sizes.n)), seed=seed, maxIter=10, distanceMeasure="cosine", featuresCol="f").fit(
            fit.select(array_to_vector(F.transform(vec_col, lambda x: x / largest)).alias("f"))) if sizes.n > 1 else None
        sample = normal(np.array([r[0] for r in fit.collect()], np.float64))          # at most FIT_ROWS
        centroids = normal(np.array(model.clusterCenters())) if model else sample
        probes = _probes_needed(sample, centroids, k)
    spark.createDataFrame([(i, c.tolist(), probes) for i, c in enumerate(centroids)],
                          "list int, centroid array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(
        os.path.join(path, "centroids"))
    shared = spark.sparkContext.broadcast(centroids)
    kind = rows.schema[id_col].dataType.simpleString()
    listed = cut_lineage(rows.mapInArrow(_assign(shared, ["list", id_col, vec_col]),
                                         f"list int, `{id_col}` {kind}, `{vec_col}` array<double>"), "vector-lists")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # by list and id, so that a crowded list is cut into several files
    (listed.repartitionByRange(parts, "list", id_col).sortWithinPartitions("list", id_col)
     .write.mode("overwrite").parquet(os.path.join(path, "lists")))
    return path


def _probed(shared, k: int, names: list[str], qid_type):
    def run(batches):
        queries, probed = shared.value
        for batch in batches:
            lists = batch.column(0).to_numpy()
            for rows, vectors in vectors_by_length(batch.column(2)):
                if vectors.shape[1] not in queries:
                    continue
                ids, unit = queries[vectors.shape[1]]
                key = batch.column(1).take(pa.array(rows))
                order = pa.compute.sort_indices(key).to_numpy()
                for one in np.unique(lists[rows]):
                    asked = np.flatnonzero(probed[vectors.shape[1]][:, one]) if one >= 0 else np.arange(len(ids))
                    mine = order[lists[rows][order] == one]
                    if len(asked):
                        best, got = best_rows(unit[asked], vectors[mine], k)
                        yield pa.RecordBatch.from_arrays(
                            [key.take(pa.array(mine[best].ravel())),
                             pa.array([ids[q] for q in asked for _ in range(best.shape[1])], qid_type), pa.array(got.ravel())],
                            names=names)
    return run


def search_vector_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 5, probes: int | None = None,
                        qid_col: str = "query_id", qvec_col: str = "qvec") -> DataFrame:
    """Top ``k`` of the probed lists -> ``(query_id, rank, vec_id, cosine)``; cosines are exact. ``probes`` overrides the
    measured number of lists."""
    index = spark.read.parquet(os.path.join(path, "lists"))
    id_col, vec_col = index.columns[1:]
    heads = spark.read.parquet(os.path.join(path, "centroids")).orderBy("list").collect()            # at most MOST_LISTS
    centroids = np.array([h.centroid for h in heads], np.float64).reshape(len(heads), -1 if heads else 0)
    schema = search_schema(index, queries, id_col, qid_col)
    qid_type = to_arrow_type(queries.schema[qid_col].dataType)
    out = None
    for block in query_blocks(queries, qid_col, qvec_col):
        by_dim = query_block(block)
        probed = {}
        for dim, (ids, unit) in by_dim.items():
            probed[dim] = np.zeros((len(ids), max(1, len(heads))), bool)
            if len(heads) and dim == centroids.shape[1]:
                nearest = np.argsort(-(unit @ centroids.T), axis=1, kind="stable")[:, :probes or heads[0].probes]
                np.put_along_axis(probed[dim], nearest, True, 1)
        wanted = sorted({-1, *(int(c) for p in probed.values() for c in np.flatnonzero(p.any(0)))})
        shared = spark.sparkContext.broadcast((by_dim, probed))
        part = index.where(F.col("list").isin(wanted)).mapInArrow(_probed(shared, k, [id_col, qid_col, "cosine"], qid_type), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return top_n_per_group(out, [qid_col], [F.desc("cosine"), F.asc(id_col)], k)
