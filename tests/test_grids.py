"""Generated grids and sums over them: dealt to tasks by key, grouped where they lie, exact in any size."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from voltaic.plans.domain_model import C
from voltaic.plans.metrics import LIMB_SUM, SemanticModel
from voltaic.sources import generate as G


def _parts(spark, n):
    return spark.range(n).select(F.col("id").alias("p_partkey"), F.lit("LARGE").alias("p_type"), F.lit("n").alias("p_name"),
                                 (F.col("id") % 50).cast("int").alias("p_size")).coalesce(1)


def test_grid_is_dealt_by_key(spark, monkeypatch):
    monkeypatch.setattr(G, "GRID_ROWS", 365 * 25)
    grid = G.production(_parts(spark, 200), F.lit("2024-06-30"))
    sizes = [r[0] for r in grid.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 200 * 365 and len(sizes) > 4 and max(sizes) < 100 * 365
    cust = G.customers(spark.range(4000).coalesce(1), "id", F.lit("2024-06-30"))
    assert G.consumption(cust, F.lit("2024-06-30")).select(F.spark_partition_id()).distinct().count() > 2


def test_own_key_groups_without_a_shuffle_of_the_grid(spark, monkeypatch):
    monkeypatch.setattr(G, "GRID_ROWS", 365 * 25)
    # plant 7 stands twice, one plant has no key: its days add up
    parts = _parts(spark, 100).unionByName(_parts(spark, 8).where("p_partkey = 7")).unionByName(
        _parts(spark, 1).withColumn("p_partkey", F.lit(None).cast("long")))
    m = SemanticModel("m")
    m.table("P", lambda: G.production(parts, F.lit("2024-06-30")).withColumn(
        "production_id", F.expr("plant_id * 1000000 + datediff(day, DATE'1970-01-01')")), ["plant_id", "day"], row_dims=["ID", "GIORNO"])
    m.dimension("ID", "P", "production_id")
    m.dimension("GIORNO", "P", "day")
    m.metric("E", "P", "SUM(energy_cents)", parts=[("wsum", "energy_cents")], final="CAST({0} AS LONG)")
    got = m.query(["E"], ["ID", "GIORNO"])
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1         # the keys
    want = G.production(parts, F.lit("2024-06-30")).groupBy("plant_id", "day").agg(F.sum("energy_cents").alias("E"))
    rows = sorted((str(r.GIORNO), r.E or 0, r.ID is None) for r in got.collect())
    assert rows == sorted((str(r.day), r.E or 0, r.plant_id is None) for r in want.collect()) and len(rows) == 101 * 365


@pytest.mark.parametrize("values", [[5, -7, 3], [2**62, 2**62, 2**62, -1], [-2**63, -2**63, 2**63 - 1, 17], [None, None], [None, 4]])
def test_limb_sums_are_exact(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x long")
    known = [v for v in values if v is not None]
    assert df.agg(F.expr(LIMB_SUM.format("x"))).first()[0] == (Decimal(sum(known)) if known else None)


def test_cents_round_halves_away_from_zero(spark):
    values = [0.005, 0.015, 0.025, -0.005, -0.015, -0.025, 1.005, 0.0, 123456.785, 2.5e-3, 0.00499999, 1e13 + 0.01, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    r = df.select(F.expr(C.format(c="x")).alias("a"), F.expr("CAST(ROUND(x * 100) AS BIGINT)").alias("b")).collect()
    assert [x.a for x in r] == [x.b for x in r]
