"""Exact ranks in seeded-shuffle order without a task that holds a whole group (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP = 1 << 60


def seeded(seed: str, *cols) -> Column:
    """A uniform long in [0, 2**60) from an MD5 over the seed and the columns (null as an empty field)."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"),
                                                      F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def bucket_count(rows: int) -> int:
    """About two square roots of the rows: a bucket of a group stays near sqrt(rows), and so does the
    table of counts per bucket that the running sums go over."""
    return max(1, math.isqrt(4 * rows))


def bucket_of(h: str, buckets: int) -> Column:
    return F.floor(F.col(h).cast("double") / F.lit(float(TOP)) * F.lit(buckets)).cast("long")


def rank_in_groups(df: DataFrame, groups: list[str], h: str, ties: list[str], buckets: int,
                   rank: str, total: str, bucket: Column | None = None) -> DataFrame:
    """Adds the 0-based rank within ``groups`` by (h, ties) and the group's size.

    Rows are dealt to buckets of ``h``; a bucket's offset is the running sum of the counts before it, so
    only the counts are summed in order, and rows are sorted within (group, bucket) alone. ``groups``
    must not be null. ``df`` is read twice: give a stored table.
    """
    rows = df.withColumn("_bucket", bucket_of(h, buckets) if bucket is None else bucket)
    order = Window.partitionBy(*groups).orderBy("_bucket") if groups else Window.partitionBy(F.lit(0)).orderBy("_bucket")
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    starts = (rows.groupBy(*groups, "_bucket").agg(F.count("*").alias("_n"))
              .withColumn("_start", F.sum("_n").over(order) - F.col("_n"))
              .withColumn(total, F.sum("_n").over(whole)).drop("_n"))
    within = Window.partitionBy(*groups, "_bucket").orderBy(h, *ties)
    return (rows.join(starts, [*groups, "_bucket"])
            .withColumn(rank, F.col("_start") + F.row_number().over(within) - 1)
            .drop("_bucket", "_start"))
