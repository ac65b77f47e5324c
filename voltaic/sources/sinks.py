"""Sinks: writing tables so that later reads prune (S4, S5, S6 outputs).

Facts are written partitioned by a month column (a filter on the month reads only its folders) and
sorted within each file by a key, so parquet row-group statistics skip data for key filters too.
Rows are spread by (partition, key hash) so one large month is written by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                sort_within: list[str] | None = None, mode: str = "overwrite", spread: int = 64) -> None:
    """``CREATE OR REPLACE TABLE``/``INSERT`` as parquet under ``path`` (shared storage).

    ``mode="append"`` adds files (S4 after id assignment), ``"overwrite"`` replaces the table (S5/S6:
    parquet has no UPDATE, a new version is written). With ``partition_by`` each partition value is
    spread over ``spread`` writers by a hash of ``sort_within`` (or of the whole row).
    """
    out = df
    if partition_by:
        salt_cols = sort_within or df.columns
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in salt_cols]), F.lit(spread))
        out = out.repartition(*[F.col(c) for c in partition_by], salt)
    if sort_within:
        out = out.sortWithinPartitions(*[F.col(c) for c in (partition_by or []) + sort_within])
    w = out.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, keys: list[str], buckets: int = 64) -> DataFrame:
    """``CREATE TABLE .. AS SELECT`` bucketed and sorted by ``keys`` under ``path`` (shared storage); returns the table.

    Tables bucketed by the same keys into the same number of buckets are co-located: they join and group on these
    keys bucket by bucket, without a shuffle of either side, as often as they are used. Rows are dealt to the
    buckets before the write, so each bucket is one file. A key that holds a large part of all rows makes one
    large bucket: join such tables unbucketed, where AQE splits it.
    """
    # the bucket of a row is pmod(hash(keys), buckets), the partition that repartition(buckets, keys) deals it to
    (df.repartition(buckets, *keys).write.mode("overwrite").option("path", path).bucketBy(buckets, *keys).sortBy(*keys)
     .format("parquet").saveAsTable(table))
    return df.sparkSession.table(table)
