"""Connected components and staged tables for the operators of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltaic.session import cut_lineage

BROADCAST_BYTES = 8 << 20      # parquet bytes of a stored table up to which it may be broadcast
IDS_BROADCAST = 2_000_000      # ids (one long each, some 80 MB as a hash table) that may be broadcast to keep rows from a shuffle


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a stored table (by the file system that holds them)."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for f in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(f)
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return total


def small_side(stored: DataFrame) -> DataFrame:
    """``stored`` hinted for broadcast if its files are small; else as it is (a shuffled join)."""
    return F.broadcast(stored) if stored_bytes(stored) <= BROADCAST_BYTES else stored


def met_ids(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """``rows`` joined to ``stored`` on a long ``key``. If ``stored`` is too large to broadcast, its ids alone (while they are few
    enough) first drop the rows that meet none, so only rows that are in the result are shuffled."""
    if stored_bytes(stored) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(stored), key)
    if stored.count() <= IDS_BROADCAST:
        rows = rows.join(F.broadcast(stored.select(key).distinct()), key, "left_semi")
    return rows.join(stored, key)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an undirected edge list; root is the smallest node of its component.

    Each round points every node to its smallest neighbour, follows the pointers twice and contracts the
    edges; the next round works on what is left. Nothing but the emptiness of the edge table reaches the
    driver, and every round is written to the shared folder, so a lost executor costs one round at most.
    Null ends and loops are ignored.
    """
    cur = cut_lineage(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
                      .where("a is not null and b is not null and a <> b").distinct(), "edges")
    maps = []
    while not cur.isEmpty():
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        p = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select(
            "v", F.least("v", "m").alias("p"))
        p = cut_lineage(p, "pointers")
        for _ in range(2):
            up = p.select(F.col("v").alias("p"), F.col("p").alias("up"))
            p = p.join(up, "p", "left").select("v", F.coalesce("up", "p").alias("p"))
        p = cut_lineage(p, "pointers")
        maps.append(p)
        cur = cut_lineage(
            cur.join(p.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a")
            .join(p.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
            .where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct(), "edges")
    if not maps:
        return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    out = maps[-1]
    for p in reversed(maps[:-1]):
        out = p.join(out.select(F.col("v").alias("p"), F.col("p").alias("up")), "p", "left").select(
            "v", F.coalesce("up", "p").alias("p"))
    return out.select(F.col("v").alias("node"), F.col("p").alias("root"))
