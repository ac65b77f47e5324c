"""Relational operators that need more than one DataFrame call (J1, J5, A12, S4, S6, S9, K*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from voltaic.session import cut_lineage


def key_audit(fact: DataFrame, fact_key: str, fk: str, dim: DataFrame, pk: str, name: str) -> DataFrame:
    """Declared-key audit -> rows (check, n_bad, n_rows).

    * duplicate primary keys of ``dim`` (aggregate on the key, partial aggregation map-side);
    * orphan foreign keys of ``fact`` (``left_anti`` join; AQE broadcasts ``dim`` only when its
      measured size is under the threshold, otherwise it stays a sort-merge anti join).
    """
    dup = (dim.groupBy(pk).count().where("count > 1")
           .agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("n_bad"))
           .select(F.lit(f"{name}: duplicate {pk}").alias("check"), "n_bad",
                   dim.select(F.count(F.lit(1))).scalar().alias("n_rows")))
    dup_fact = (fact.groupBy(fact_key).count().where("count > 1")
                .agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("n_bad"))
                .select(F.lit(f"{name}: duplicate {fact_key}").alias("check"), "n_bad",
                        fact.select(F.count(F.lit(1))).scalar().alias("n_rows")))
    orphans = (fact.where(F.col(fk).isNotNull())
               .join(dim.select(F.col(pk).alias(fk)), fk, "left_anti")
               .agg(F.count(F.lit(1)).alias("n_bad"))
               .select(F.lit(f"{name}: orphan {fk}").alias("check"), "n_bad",
                       fact.select(F.count(F.lit(1))).scalar().alias("n_rows")))
    return dup.unionByName(dup_fact).unionByName(orphans)


def share_of_total(df: DataFrame, value: str, alias: str = "share") -> DataFrame:
    """``value / sum(value) over ()`` after aggregation.

    The total is a scalar subquery (one partial + final aggregate, then a literal in the projection),
    not an unpartitioned window, so the groups are never pulled into one task.
    """
    total = df.select(F.sum(value)).scalar()
    return df.withColumn(alias, F.col(value) / total)


def period_grid(entities: DataFrame, as_of: Column, n_months: int, month_col: str = "month",
                offset_col: str = "months_ago") -> DataFrame:
    """One row per entity and month, ``n_months`` months ending at ``trunc(as_of)``.

    The calendar is generated per row by ``explode(sequence(..))`` (a generator, no join), so the grid
    is produced where the entity row already lives and never shuffles.
    """
    g = entities.withColumn(offset_col, F.explode(F.sequence(F.lit(0), F.lit(n_months - 1))))
    return g.withColumn(month_col, F.add_months(F.trunc(as_of.cast("date"), "MM"), -F.col(offset_col)))


def assign_ids(df: DataFrame, order_by: list[str], start: Column | int, id_col: str = "id") -> DataFrame:
    """S4/W1 at scale: ``start + row_number() over (order by ..)`` without a single-partition window.

    The rows are range-partitioned and sorted (``orderBy``), each row gets its partition and its
    position inside it, and that numbered table is written once to the shared checkpoint folder;
    per-partition counts (one row per partition, size bounded by the partition count) give the
    offsets, and a broadcast join adds them back. Equivalent to the unpartitioned ``row_number`` window,
    but every step runs in parallel. ``order_by`` must be unique per row, so a recomputed
    partition (after an executor loss) numbers its rows the same way.
    """
    start_c = start if isinstance(start, Column) else F.lit(start)
    s = (df.orderBy(*order_by).withColumn("_pid", F.spark_partition_id())
         .withColumn("_mid", F.monotonically_increasing_id()))
    # sort and number once, store in the shared folder; counts and rows then read the same numbers
    s = cut_lineage(s, "numbered")
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: the only unpartitioned window in the library, on a bounded input
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    out = s.join(F.broadcast(offsets.select("_pid", "_off", "_first")), "_pid")
    out = out.withColumn(id_col, start_c + F.col("_off") + (F.col("_mid") - F.col("_first")) + 1)
    return out.drop("_pid", "_mid", "_off", "_first")


def append_rows(existing: DataFrame, new: DataFrame, id_col: str, order_by: list[str]) -> DataFrame:
    """``INSERT INTO t SELECT ..`` with auto-increment ids continuing after ``max(id)``."""
    start = F.coalesce(existing.select(F.max(id_col)).scalar(), F.lit(0))
    return existing.unionByName(assign_ids(new, order_by, start, id_col).select(*existing.columns))


def dependent_update(df: DataFrame, passes: list[dict[str, Column]]) -> DataFrame:
    """Whole-table ``UPDATE SET`` passes where a later pass reads columns set by an earlier one.

    Each pass is a ``withColumns`` on the previous result; parquet has no UPDATE, so callers write the
    result to a new path. Catalyst collapses the projections into one codegen stage.
    """
    for p in passes:
        df = df.withColumns(p)
    return df


def bounded_fetch(df: DataFrame, order_by: list, n: int = 50):
    """First ``n`` rows to a local pandas frame; the cut happens on the cluster (top-k)."""
    return df.orderBy(*order_by).limit(n).toPandas()


def top_n(df: DataFrame, order_by: list, n: int) -> DataFrame:
    """K1/K2/K3: ``ORDER BY .. LIMIT n`` -> ``TakeOrderedAndProject`` (per-partition top-n, then merge)."""
    return df.orderBy(*order_by).limit(n)


def top_n_per_group(df: DataFrame, group: list[str], order_by: list[Column], n: int,
                    rank_col: str = "rank") -> DataFrame:
    """Top ``n`` rows per group by ``row_number``.

    Spark plans the ``row_number() <= n`` filter as a partial ``WindowGroupLimit`` before the shuffle,
    so each map task ships at most ``n`` rows per group: a hot group costs ``n`` x map tasks rows at
    the reducer, not its full size.
    """
    w = Window.partitionBy(*group).orderBy(*order_by)
    ranked = df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)
    return ranked.withColumn(rank_col, F.col(rank_col).cast("long"))
