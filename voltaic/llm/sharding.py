"""Proportional stratified interleaving into shards (operator 3, DataFrame functions only).

Rows of a source are ranked in a seeded shuffle; ``(rank + 1/2) / rows of the source`` is the row's
fractional rank; all rows in order of fractional rank are cut into shards of equal counts (at most one
apart), so every shard holds each source in its share. A source with a third of all rows is ranked in
buckets (:mod:`voltaic.llm.ranks`), and only narrow rows are shuffled.

Null text: size ``8`` and the checksum of no bytes. Null sources are one source. Rows equal in every column
that is read are interchangeable; rows that share an id or a text are placed on their own. No rows: none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltaic.llm.ranks import bucket_count, rank_in_groups, seeded
from voltaic.session import cut_lineage


def assign_shards(docs: DataFrame, shards: int, seed: str = "shard", id_col: str = "doc_id",
                  text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, text_crc32, source, shard, slot) of every row; slots are gapless from 0 in each shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut_lineage(docs.select(
        F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("bytes"),
        F.crc32(text.cast("binary")).alias("crc"), F.col(source_col).alias("source"),
        F.when(F.col(source_col).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(source_col))).alias("src"),
        seeded(seed, id_col).alias("h")), "shard-rows")
    n = rows.count()
    buckets = bucket_count(n)
    ranked = cut_lineage(rank_in_groups(rows, ["src"], "h", ["id", "crc", "bytes"], buckets, "rank", "of")
                         .withColumn("part", (F.col("rank") + F.lit(0.5)) / F.col("of")), "shard-ranks")
    place = rank_in_groups(ranked, [], "part", ["src", "rank"], buckets, "place", "n",
                           bucket=F.floor(F.col("part") * F.lit(buckets)).cast("long"))
    return (place.withColumn("shard", F.expr(f"place * {shards} div n").cast("int"))
            .withColumn("slot", F.col("place") - F.expr(f"(shard * n + {shards - 1}) div {shards}"))
            .select(F.col("id").alias(id_col), (F.col("bytes") + 8).alias("size"), F.col("crc").alias("text_crc32"),
                    F.col("source").alias(source_col), "shard", "slot"))


def write_shards(docs: DataFrame, path: str, shards: int, seed: str = "shard", id_col: str = "doc_id") -> None:
    """Writes ``docs`` (unique ids) as one folder per shard, rows in slot order."""
    placed = assign_shards(docs, shards, seed, id_col).select(F.col(id_col), "shard", "slot")
    (docs.join(placed, id_col).repartition(shards, "shard").sortWithinPartitions("shard", "slot")
     .write.mode("overwrite").partitionBy("shard").parquet(path))
