"""Centroid clustering over subvector dictionaries (operator 11).

Vectors become integer vectors, component by component ``floor(scale * x)``, cut into blocks of ``BLOCK`` dimensions. The
distinct subvectors of every block are counted once over all vectors, and each vector is stored as the dictionary
codes of its blocks. In a round a task computes the exact squared distance of every dictionary entry to the same block
of every centroid once; a vector's distances to all centroids are sums of those partial distances by code.

The dictionary is sent to all tasks, so it has a bound: of more than ``ENTRIES`` distinct subvectors those stay that
occur at least so often (a power of two) that they fit. The other subvectors are stored as themselves, and each Arrow
batch makes a dictionary of its own for them, so the encoding stays lossless and distances exact at any size.

Tasks give sums and counts per centroid, which Spark adds up; the driver sees 40 x 64 sums a round. Everything is
integer arithmetic: no result depends on partitions or order.

Kept are vectors of exactly ``dim`` components, none null or non-finite; other rows have no cluster and are not
returned. Copies, also of whole rows, count each. The first centroids are the vectors with the smallest SHA-256
of ``<seed>:<id>`` (equal ids: smaller vector first; rows without an id never start a cluster); with fewer vectors
there are fewer centroids. Ties go to the smaller number, empty clusters keep their centroid. Integers are held
within +-(2**27 - 1), so that a distance fits a long. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltaic.llm.graph import free_names
from voltaic.session import cut_lineage

BLOCK = 2                      # dimensions of a block
ENTRIES = 1 << 17              # dictionary entries of all blocks together
SLICE = 4096                   # vectors a task holds distances of at once
HELD = (1 << 27) - 1
_SPAN = 1 << 28


def whole(vector: Column, dim: int) -> Column:
    """Whether an array of doubles has ``dim`` components, none null or non-finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dim) & fine, F.lit(False))


def to_integers(x: np.ndarray, scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * scale), -HELD, HELD).astype(np.int64)


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _keys(ints: np.ndarray) -> np.ndarray:
    """(vectors x blocks): the components of a block as one long."""
    a = ints + HELD
    return a[:, 0::2] * _SPAN + a[:, 1::2]


def _parts(keys: np.ndarray) -> np.ndarray:
    """(keys x 2): the components of packed subvectors."""
    return np.stack([keys // _SPAN, keys % _SPAN], -1) - HELD


def _count(dim: int, scale: float):
    def merged(keys: list) -> pa.RecordBatch:
        found = [np.unique(col, return_counts=True) for col in np.concatenate(keys).T]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(found), dtype=np.int32), [len(k) for k, _ in found])),
             pa.array(np.concatenate([k for k, _ in found])), pa.array(np.concatenate([n for _, n in found]))],
            names=["block", "key", "n"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(_keys(to_integers(_matrix(batch.column("v"), dim), scale)))
            rows += batch.num_rows
            if rows >= 1 << 16:
                yield merged(held)
                held, rows = [], 0
        if rows:
            yield merged(held)
    return run


def _encode(dictionary, dim: int, scale: float):
    """codes: place in the dictionary, or -1 for the next of ``rest``."""
    def run(batches):
        keys_of, starts = dictionary.value
        for batch in batches:
            keys = _keys(to_integers(_matrix(batch.column("v"), dim), scale))
            codes = np.full(keys.shape, -1, np.int32)
            for b, (lo, hi) in enumerate(zip(starts, starts[1:])):
                if hi > lo:
                    at = np.minimum(np.searchsorted(keys_of[lo:hi], keys[:, b]), hi - lo - 1)
                    codes[:, b] = np.where(keys_of[lo:hi][at] == keys[:, b], lo + at, -1)
            own = codes < 0
            ends = np.concatenate([[0], np.cumsum(own.sum(1))]).astype(np.int32)
            rows = np.arange(batch.num_rows + 1, dtype=np.int32) * codes.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.ListArray.from_arrays(pa.array(rows), pa.array(codes.ravel())),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[own]))], names=["id", "codes", "rest"])
    return run


def _partial(entries: np.ndarray, blocks: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(entries x centroids): exact squared distances within the entries' blocks."""
    out = np.zeros((len(entries), len(centroids)), np.int64)
    for j in range(BLOCK):
        gap = entries[:, j, None] - centroids.T[blocks * BLOCK + j]
        out += gap * gap
    return out


def _assigned(batches, dictionary, centroids: np.ndarray):
    """(ids, components, cluster, distance) per slice of vectors."""
    keys_of, starts = dictionary
    entries = _parts(keys_of)
    table = _partial(entries, np.repeat(np.arange(len(starts) - 1), np.diff(starts)), centroids)
    table = np.concatenate([table, np.zeros((1, len(centroids)), np.int64)])
    for whole_batch in batches:
        for lo in range(0, whole_batch.num_rows, SLICE):
            batch = whole_batch.slice(lo, SLICE)
            codes = _matrix(batch.column("codes"), len(starts) - 1)
            # this batch's own dictionary of (block, subvector)
            row, block = np.nonzero(codes < 0)
            rest = batch.column("rest").flatten().to_numpy(zero_copy_only=False)
            order = np.lexsort([rest, block])
            new = np.ones(len(order), bool)
            new[1:] = (rest[order][1:] != rest[order][:-1]) | (block[order][1:] != block[order][:-1])
            own = np.empty(len(order), np.int64)
            own[order] = np.cumsum(new) - 1
            extra = _parts(rest[order][new])
            codes = codes.astype(np.int64)
            codes[row, block] = len(entries)                             # a row of zeros
            total = np.zeros((len(codes), len(centroids)), np.int64)
            for b in range(codes.shape[1]):
                total += table[codes[:, b]]
            if len(row):
                at = np.flatnonzero(np.diff(row, prepend=-1))
                total[row[at]] += np.add.reduceat(_partial(extra, block[order][new], centroids)[own], at)
            codes[row, block] = len(entries) + own
            parts = np.concatenate([entries, extra])
            best = total.argmin(1)                                       # ties: the smaller number
            yield batch.column("id"), parts[codes].reshape(len(codes), -1), best, total[np.arange(len(best)), best]


def _sums(dictionary, centroids: np.ndarray):
    def run(batches):
        k, dim = centroids.shape
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for _, ints, best, _ in _assigned(batches, dictionary.value, centroids):
            counts += np.bincount(best, minlength=k)
            of = np.zeros((k, len(best)))
            of[best, np.arange(len(best))] = 1
            sums += (of @ ints).astype(np.int64)                         # whole numbers below 2**53: exact
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(counts[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))],
            names=["cluster", "n", "sums"])
    return run


def _places(dictionary, centroids: np.ndarray):
    def run(batches):
        for ids, _, best, distance in _assigned(batches, dictionary.value, centroids):
            yield pa.RecordBatch.from_arrays([ids, pa.array(best, pa.int32()), pa.array(distance)],
                                             names=["id", "cluster", "distance"])
    return run


def _dictionary(rows: DataFrame, dim: int, scale: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(subvectors by block and key, where each block starts), at most ``most``."""
    counted = cut_lineage(rows.select("v").mapInArrow(_count(dim, scale), "block int, key long, n long")
                          .groupBy("block", "key").agg(F.sum("n").alias("n")), "subvectors")
    sizes = {r.p: r.e for r in counted.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count("*").alias("e")).collect()}
    least, held = 64, 0
    while least > 0 and held + sizes.get(least - 1, 0) <= most:
        least -= 1
        held += sizes.get(least, 0)
    kept = counted.where(F.floor(F.log2("n")) >= least).select("block", "key").toPandas().sort_values(["block", "key"])
    starts = np.searchsorted(kept["block"].to_numpy(), np.arange(dim // BLOCK + 1))
    return kept["key"].to_numpy(np.int64), starts


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: float = 256.0, seed: int = 2,
                    id_col: str = "vec_id", vector_col: str = "embedding", entries: int = ENTRIES) -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid) of every kept vector; ``centroid`` is the final
    centroid's components."""
    if dim % BLOCK:
        raise ValueError(f"dim must be a multiple of {BLOCK}")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        whole(F.col("v"), dim))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.where("id is not null").orderBy(drawn, "v").limit(k).collect()
    centroids = to_integers(np.array([r.v for r in first], np.float64).reshape(-1, dim), scale)
    if not first:
        empty = "cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
        return spark.createDataFrame([], f"`{id_col}` long, {empty}")
    dictionary = spark.sparkContext.broadcast(_dictionary(rows, dim, scale, entries))
    coded = cut_lineage(rows.mapInArrow(_encode(dictionary, dim, scale), "id long, codes array<int>, rest array<long>"), "coded")
    for _ in range(rounds):
        got = (coded.mapInArrow(_sums(dictionary, centroids), "cluster int, n long, sums array<long>")
               .select("cluster", "n", F.posexplode("sums").alias("d", "s")).groupBy("cluster", "d")
               .agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
        centroids = centroids.copy()
        for r in got:                                                   # k x dim numbers
            centroids[r.cluster, r.d] = int(r.s) // int(r.n)
    placed = cut_lineage(coded.mapInArrow(_places(dictionary, centroids), "id long, cluster int, distance long"), "placed")
    inertia = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    total = sum(int(r.s) for r in inertia)
    fits = lambda x: x if x < 1 << 63 else None
    names = free_names(vectors.select(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")
    per = spark.createDataFrame([(r.cluster, fits(int(r.s)), fits(total), centroids[r.cluster].tolist()) for r in inertia],
                                "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return (placed.join(F.broadcast(per), "cluster")                    # at most k rows
            .select(F.col("id").alias(id_col), *[F.col(c).alias(n) for c, n in
                                                 zip(("cluster", "distance", "cluster_inertia", "inertia", "centroid"), names)]))
