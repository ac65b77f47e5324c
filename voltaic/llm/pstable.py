"""Embedding near-dedup by Euclidean p-stable hashing (operator 6).

Vectors are normalised, so a cosine of ``c`` is a distance of ``sqrt(2 - 2c)``. In each of ``TABLES`` tables
``PROJECTIONS`` Gaussian projections, shifted and quantised to ``WIDTH``, give one bucket. Vectors of a bucket are
compared by exact cosine in double precision, in blocks of at most two times ``BLOCK`` vectors a task. A pair
is counted in the first table that brings it together, so each link counts once; tasks give links per
vector and local groups, never pairs.

At a cosine of 0.9 a table finds a pair with probability 0.048, all tables with 0.993; at 0.95 with 0.99999. Pairs
of unrelated vectors (cosine 0) share a table's bucket with probability 1.5e-5. Projections are computed on integers held
in doubles, so a vector's buckets do not depend on the batch it is hashed in.

Equal vectors are one class: their copies link by definition and are counted, not compared. Null, zero or empty
vectors and vectors with null or non-finite components link with nothing and are their own component;
vectors of different length never meet. A row without an id has no component and is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltaic.llm import hashing as H
from voltaic.llm.graph import connected_components
from voltaic.llm.jaccard import local_groups
from voltaic.session import cut_lineage

TABLES = 100
PROJECTIONS = 24
WIDTH = 3.0
BLOCK = 256
U64, I64 = np.uint64, np.int64
_FINE, _GAUSS = float(1 << 20), float(1 << 12)       # integer grids of the vectors and the projections
_models: dict[int, tuple] = {}


def _model(dim: int):
    if dim not in _models:
        rng = np.random.default_rng([dim, 911])
        a = np.rint(rng.standard_normal((dim, TABLES * PROJECTIONS)) * _GAUSS)
        _models[dim] = a, np.rint(rng.random(TABLES * PROJECTIONS) * WIDTH * _FINE * _GAUSS)
    return _models[dim]


def normalise(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)              # no square over- or underflows
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def bucket_codes(unit: np.ndarray) -> np.ndarray:
    """(vectors x tables) bucket codes of normalised vectors."""
    a, shift = _model(unit.shape[1])
    cells = np.floor((np.rint(unit * _FINE) @ a + shift) / (WIDTH * _FINE * _GAUSS)).astype(I64).view(U64)
    cells = cells.reshape(len(unit), TABLES, PROJECTIONS)
    h = np.zeros((len(unit), TABLES), U64)
    for p in range(PROJECTIONS):
        h = (h + cells[:, :, p]) * H.MIX[p] + (h >> U64(31))
    return H.finalise(h + np.arange(TABLES).astype(U64) * H.MIX[40] + U64(unit.shape[1])).view(I64)


def _hash(batches):
    """Class hash (null: links with nothing), bucket codes (of the first copy a task sees) and the vector."""
    seen: dict = {}
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            vectors = part.column("v").to_pylist()
            h1, h2, codes, kept = [], [], [], []
            by_dim: dict[int, list] = {}
            for i, v in enumerate(vectors):
                ok = v and None not in v
                x = np.asarray(v, np.float64) if ok else None
                ok = bool(ok and np.isfinite(x).all() and x.any())
                h1.append(None)
                h2.append(None)
                codes.append([])
                kept.append(None)
                if ok:
                    x = x + 0.0                                        # -0.0 is 0.0
                    bits = x.view(U64) + np.arange(len(x)).astype(U64) * H.MIX[41]
                    a = int(H.finalise(bits).sum(dtype=U64).view(I64))
                    b = int(H.finalise(bits * H.MIX[42]).sum(dtype=U64).view(I64))
                    h1[i], h2[i] = a, b
                    if (a, b) not in seen:
                        if len(seen) >= 100_000:
                            seen.clear()
                        seen[(a, b)] = None
                        by_dim.setdefault(len(x), []).append((i, x))
            for rows in by_dim.values():
                got = bucket_codes(normalise(np.stack([x for _, x in rows])))
                for (i, x), c in zip(rows, got):
                    codes[i], kept[i] = c.tolist(), x.tolist()
            yield pa.RecordBatch.from_arrays([
                part.column("id"), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                pa.array(codes, pa.list_(pa.int64())), pa.array(kept, pa.list_(pa.float64()))],
                names=["id", "h1", "h2", "codes", "v"])


def _link(least_cosine: float):
    def group(rows: list) -> list:
        seen: dict = {}
        for r in rows:
            seen.setdefault(r[0], r)
        rows = sorted(seen.values(), key=lambda r: r[0])
        table, i, j = rows[0][4], rows[0][5], rows[0][6]
        if len(rows) < 2:
            return []
        unit = normalise(np.stack([r[2] for r in rows]))
        left = np.array([r[3] == i for r in rows])
        right = left if i == j else ~left
        a, b = np.flatnonzero(left), np.flatnonzero(right)
        x, y = np.nonzero(unit[a] @ unit[b].T >= least_cosine)
        x, y = a[x], b[y]
        if i == j:
            x, y = x[x < y], y[x < y]
        if not len(x):
            return []
        if table:                                        # counted in an earlier table already?
            met = np.unique(np.concatenate([x, y]))
            codes = bucket_codes(unit[met])[:, :table]
            new = ~(codes[np.searchsorted(met, x)] == codes[np.searchsorted(met, y)]).any(1)
            x, y = x[new], y[new]
        copies = np.array([r[1] for r in rows], I64)
        links = np.zeros(len(rows), I64)
        np.add.at(links, x, copies[y])
        np.add.at(links, y, copies[x])
        low = local_groups(len(rows), x, y)
        return [(rows[m][0], rows[low[m]][0], int(links[m])) for m in np.flatnonzero(links)]

    def run(batches):
        now, rows, out = None, [], []
        for batch in batches:
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("code", "i", "j", "tab", "blk", "id", "copies")}
            v = batch.column("v")
            flat = v.flatten().to_numpy(zero_copy_only=False)
            off = v.offsets.to_numpy() - v.offsets[0].as_py() if len(v) else []
            for r in range(batch.num_rows):
                key = (cols["code"][r], cols["i"][r], cols["j"][r])
                if key != now:
                    if rows:
                        out += group(rows)
                    now, rows = key, []
                rows.append((int(cols["id"][r]), int(cols["copies"][r]), flat[off[r]:off[r + 1]].copy(),
                             cols["blk"][r], int(cols["tab"][r]), cols["i"][r], cols["j"][r]))
        if rows:
            out += group(rows)
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)],
                                         names=["id", "low", "links"])
    return run


def embedding_dedup(vectors: DataFrame, least_cosine: float = 0.9, id_col: str = "vec_id",
                    vector_col: str = "embedding") -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    hashed = cut_lineage(rows.mapInArrow(_hash, "id long, h1 long, h2 long, codes array<long>, v array<double>"), "hashed")
    classes = cut_lineage(hashed.where("h1 is not null and id is not null").groupBy("h1", "h2").agg(
        F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    found = hashed.where("id is not null").select("h1", "h2", F.posexplode("codes").alias("tab", "code"))
    sizes = (found.groupBy("code").agg(F.count("*").alias("n"), F.min("h1").alias("a"), F.max("h1").alias("b"))
             .where("a <> b").select("code", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    named = classes.join(hashed.where("v is not null").select("h1", "h2", "codes", "v"), ["h1", "h2"]).dropDuplicates(["h1", "h2"])
    met = (named.select(F.col("rep").alias("id"), "copies", "v", F.posexplode("codes").alias("tab", "code"))
           .join(sizes, "code"))
    dealt = (met.withColumn("blk", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("code", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"),
                     "tab", "blk", "id", "copies", "v"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    linked = cut_lineage(dealt.repartition(parts, "code", "i", "j").sortWithinPartitions("code", "i", "j")
                         .mapInArrow(_link(least_cosine), "id long, low long, links long"), "linked")
    groups = connected_components(linked, "id", "low")
    links = linked.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    out = (classes.join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
           .where("copies > 1 or links is not null")
           .select("h1", "h2", F.coalesce("root", "rep").alias("comp"),
                   (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")))
    got = hashed.select("id", "h1", "h2").join(out, ["h1", "h2"], "left")
    comp = F.when(F.col("id").isNotNull(), F.coalesce("comp", "id"))
    return got.select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
                      comp.alias("component_id"), F.coalesce(comp == F.col("id"), F.lit(True)).alias("kept"))
