"""Business questions Q1-Q11, Q18-Q24 and metric checks M7-M24, all built on the metrics layer.

Relative periods take ``as_of`` from the data (latest date of the fact), as a scalar subquery, so the
plan stays one lazy DataFrame and the result does not depend on the day it runs.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltaic.plans.registry import register
from voltaic.plans.utility_model import build_model
from voltaic.sources.tables import TABLE_NAMES, Tables

MONTH = "CAST(date_trunc('month', {c}) AS DATE)"
CENTS = "CAST(ROUND({c} * 100) AS BIGINT)"


def _latest_month(df: DataFrame, col: str) -> datetime.date:
    """``trunc(max(col), 'MM')``: one number, computed before the plan so that it can prune scans."""
    return df.select(F.trunc(F.max(F.col(col)).cast("date"), "MM")).first()[0]


def add_months(month: datetime.date, n: int) -> datetime.date:
    y, m = divmod(month.year * 12 + month.month - 1 + n, 12)
    return datetime.date(y, m + 1, 1)


def in_months(col: str, start: datetime.date, end: datetime.date | None = None):
    """Predicate on a raw timestamp column (typed literals, so it reaches the parquet scan): from the
    first of ``start`` to before the first of ``end``."""
    at = lambda x: F.lit(str(x)).cast("timestamp_ntz")
    p = F.col(col) >= at(start)
    return p if end is None else p & (F.col(col) < at(end))


@register("q1_supplies_by_contract", f"""
SELECT o_orderpriority AS contract_type, COUNT(o_orderkey) AS n_supplies
FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
def q1(spark: SparkSession, d: str) -> DataFrame:
    """Q1 (P4, A2): active supplies per contract type."""
    return build_model(spark, d).query(["n_supplies"], ["contract_type"], where="supply_status = 'F'")


@register("q2_customers_by_city_segment", """
SELECT n.n_name AS city, c.c_mktsegment AS segment, COUNT(c.c_custkey) AS n_customers
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1, 2""")
def q2(spark, d):
    """Q2 (J3, M14): customers by city and segment."""
    return build_model(spark, d).query(["n_customers"], ["city", "segment"])


@register("q3_segment_in_city", """
SELECT COUNT(c.c_custkey) AS n_customers
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE c.c_mktsegment = 'BUILDING' AND n.n_name = 'NATION_1'""")
def q3(spark, d):
    """Q3 (A8): customers of one segment in one city (global aggregate, two filters)."""
    return build_model(spark, d).query(["n_customers"], where="segment = 'BUILDING' AND city = 'NATION_1'")


@register("q4_mean_monthly_bill_by_segment", f"""
WITH cm AS (
  SELECT c.c_mktsegment AS segment, c.c_custkey, {MONTH.format(c='o.o_orderdate')} AS m,
         SUM({CENTS.format(c='o.o_totalprice')}) AS rc
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2, 3)
SELECT segment, CAST(SUM(rc) AS DOUBLE) / COUNT(rc) / 100 AS avg_monthly_bill,
       COUNT(*) AS n_customer_months
FROM cm GROUP BY segment""")
def q4(spark, d):
    """Q4 (hard point 2): mean over customer-months, so sum per customer-month first."""
    cm = build_model(spark, d).query(["revenue_cents"], ["segment", "customer_id", "supply_month"])
    return cm.groupBy("segment").agg(
        (F.sum("revenue_cents").cast("double") / F.count("revenue_cents") / 100).alias("avg_monthly_bill"),
        F.count(F.lit(1)).alias("n_customer_months"))


@register("q5_revenue_last_6_months", f"""
SELECT {MONTH.format(c='o_orderdate')} AS supply_month,
       CAST(SUM({CENTS.format(c='o_totalprice')}) AS DOUBLE) / 100 AS total_revenue
FROM orders
WHERE {MONTH.format(c='o_orderdate')} >=
      (SELECT CAST(date_trunc('month', max(o_orderdate)) - INTERVAL 5 MONTH AS DATE) FROM orders)
GROUP BY 1""")
def q5(spark, d):
    """Q5 (P7, F14, F15): total bill per month over the 6 calendar months ending at the latest."""
    t = Tables(spark, d)
    start = add_months(_latest_month(t.orders, "o_orderdate"), -5)
    return build_model(spark, d).query(["total_revenue"], ["supply_month"],
                                       where=F.col("supply_month") >= start, where_dims=["supply_month"],
                                       scan={"supplies": in_months("o_orderdate", start)})


@register("q6_top10_customers_last_month", f"""
SELECT c.c_custkey AS customer_id, c.c_name AS customer_name,
       CAST(SUM({CENTS.format(c='o.o_totalprice')}) AS DOUBLE) / 100 AS total_revenue
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
WHERE {MONTH.format(c='o.o_orderdate')} = (SELECT {MONTH.format(c='max(o_orderdate)')} FROM orders)
GROUP BY 1, 2 ORDER BY total_revenue DESC, customer_id LIMIT 10""")
def q6(spark, d):
    """Q6 (K3): top 10 customers by bill in the latest month."""
    t = Tables(spark, d)
    last = _latest_month(t.orders, "o_orderdate")
    return build_model(spark, d).query(
        ["total_revenue"], ["customer_id", "customer_name"], where=F.col("supply_month") == last,
        where_dims=["supply_month"], order_by=[F.desc("total_revenue"), F.asc("customer_id")], limit=10,
        scan={"supplies": in_months("o_orderdate", last)})


@register("q7_capacity_by_plant_type", """
SELECT p_type AS plant_type, CAST(SUM(p_size) AS BIGINT) AS total_capacity, COUNT(p_partkey) AS n_plants
FROM part GROUP BY 1""")
def q7(spark, d):
    """Q7 (M22, M23): installed capacity and plant count per plant type."""
    return build_model(spark, d).query(["total_capacity", "n_plants"], ["plant_type"])


@register("q8_efficiency_by_plant_type", f"""
SELECT p_type AS plant_type,
       CAST(SUM({CENTS.format(c='p_retailprice')}) AS DOUBLE) / COUNT(p_retailprice) / 100 AS avg_efficiency
FROM part GROUP BY 1""")
def q8(spark, d):
    """Q8 (A5): mean efficiency per plant type."""
    return build_model(spark, d).query(["avg_efficiency"], ["plant_type"])


@register("q9_production_previous_month", f"""
SELECT l_partkey AS plant_id, CAST(SUM(l_quantity) AS DOUBLE) AS total_production
FROM lineitem
WHERE {MONTH.format(c='l_shipdate')} =
      (SELECT CAST(date_trunc('month', max(l_shipdate)) - INTERVAL 1 MONTH AS DATE) FROM lineitem)
GROUP BY 1""")
def q9(spark, d):
    """Q9 (M17): energy per plant in the month before the latest one."""
    t = Tables(spark, d)
    last = _latest_month(t.lineitem, "l_shipdate")
    prev = add_months(last, -1)
    m = build_model(spark, d)
    # plant_id is the plant key; reading it through the relationship keeps the model's grain check
    return m.query(["total_production"], ["plant_id"], where=F.col("reading_month") == prev,
                   where_dims=["reading_month"], scan={"consumption": in_months("l_shipdate", prev, last)})


@register("q10_open_supplies_by_contract", """
SELECT o_orderpriority AS contract_type, COUNT(o_orderkey) AS n_supplies
FROM orders WHERE o_orderstatus = 'O' GROUP BY 1""")
def q10(spark, d):
    """Q10: open items per category."""
    return build_model(spark, d).query(["n_supplies"], ["contract_type"], where="supply_status = 'O'")


@register("q11_resolution_by_kind", f"""
SELECT event_type AS ticket_kind, COUNT(event_id) AS n_tickets,
       CAST(SUM({CENTS.format(c='value')}) AS DOUBLE) / COUNT(value) / 100 AS avg_resolution
FROM events GROUP BY 1""")
def q11(spark, d):
    """Q11 (M15, M16): tickets and mean resolution time per kind."""
    return build_model(spark, d).query(["n_tickets", "avg_resolution"], ["ticket_kind"])


@register("q18_customers_by_segment_province", """
SELECT c.c_mktsegment AS segment, r.r_name AS province, COUNT(c.c_custkey) AS n_customers
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1, 2""")
def q18(spark, d):
    """Q18 (J3 chained two steps): customers by type and province."""
    return build_model(spark, d).query(["n_customers"], ["segment", "province"])


Q19_SQL = """
SELECT n.n_name AS city, CAST(SUM(l.l_quantity) AS DOUBLE) AS total_kwh
FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
LEFT JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY 1 ORDER BY total_kwh DESC, city LIMIT 5"""


@register("q19_top_cities", Q19_SQL)
def q19(spark, d):
    """Q19 (S1, J3, M8, K2): the 5 cities with most energy; lineitem -> orders -> customer -> nation."""
    return build_model(spark, d).query(["total_kwh"], ["city"],
                                       order_by=[F.desc("total_kwh"), F.asc("city")], limit=5)


@register("q20_mean_bill_by_segment", f"""
SELECT c.c_mktsegment AS segment,
       CAST(SUM({CENTS.format(c='o.o_totalprice')}) AS DOUBLE) / COUNT(o.o_totalprice) / 100 AS avg_bill
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1""")
def q20(spark, d):
    """Q20 (J3, A5): mean bill per segment."""
    return build_model(spark, d).query(["avg_bill"], ["segment"])


_PLANT_SQL = f"""
SELECT p.p_type AS plant_type, CAST(SUM(l.l_quantity) AS DOUBLE) AS total_production,
       CAST(SUM(CAST(l.l_quantity AS BIGINT) * {CENTS.format(c='p.p_retailprice')}) AS DOUBLE) / 100
       - CAST(SUM({CENTS.format(c='l.l_extendedprice')} * {CENTS.format(c='l.l_discount')}) AS DOUBLE) / 10000
         AS production_margin
FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1"""


@register("q21_production_margin_by_type", _PLANT_SQL)
def q21(spark, d):
    """Q21 (M17, M24 derived = M19 - M18): production and margin per plant type."""
    return build_model(spark, d).query(["total_production", "production_margin"], ["plant_type"])


@register("q22_customers_by_segment", """
SELECT c_mktsegment AS segment, COUNT(c_custkey) AS n_customers FROM customer GROUP BY 1""")
def q22(spark, d):
    """Q22 (M14)."""
    return build_model(spark, d).query(["n_customers"], ["segment"])


@register("q23_kpi_last_3_months", f"""
WITH lo AS (SELECT CAST(date_trunc('month', max(o_orderdate)) - INTERVAL 3 MONTH AS DATE) AS s FROM orders)
SELECT
  (SELECT ROUND(CAST(SUM(l.l_quantity) AS DOUBLE), 0) FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
    WHERE {MONTH.format(c='o.o_orderdate')} >= (SELECT s FROM lo)) AS tot_kwh,
  (SELECT ROUND(CAST(SUM({CENTS.format(c='l.l_tax')}) AS DOUBLE) / 100, 0) FROM lineitem l
    JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE {MONTH.format(c='o.o_orderdate')} >= (SELECT s FROM lo)) AS tot_smc,
  ROUND(CAST(SUM({CENTS.format(c='o_totalprice')}) AS DOUBLE) / 100, 0) AS tot_cost,
  ((2 * SUM({CENTS.format(c='o_totalprice')}) + COUNT(o_totalprice)) // (2 * COUNT(o_totalprice))) / 100.0::DOUBLE AS avg_cost,
  COUNT(DISTINCT o_custkey) AS num_customers
FROM orders WHERE {MONTH.format(c='o_orderdate')} >= (SELECT s FROM lo)""")
def q23(spark, d):
    """Q23 (A8, P7): KPI row of the last 3 months (``>= trunc(as_of) - 3 months``, quirk 10)."""
    t = Tables(spark, d)
    start = add_months(_latest_month(t.orders, "o_orderdate"), -3)
    k = build_model(spark, d).query(
        ["total_kwh", "total_smc", "total_revenue", "avg_bill_cents_rounded", "n_active_customers"],
        where=F.col("supply_month") >= start, where_dims=["supply_month"],
        scan={"supplies": in_months("o_orderdate", start)})
    return k.select(F.round("total_kwh", 0).alias("tot_kwh"), F.round("total_smc", 0).alias("tot_smc"),
                    F.round("total_revenue", 0).alias("tot_cost"),
                    (F.col("avg_bill_cents_rounded") / 100.0).alias("avg_cost"),
                    F.col("n_active_customers").alias("num_customers"))


@register("q24_row_counts", "\nUNION ALL\n".join(
    f"SELECT '{n}' AS table_name, COUNT(*) AS row_count FROM {n}" for n in TABLE_NAMES))
def q24(spark, d):
    """Row count of every table, one ``UNION ALL`` (load check)."""
    t = Tables(spark, d)
    parts = [t.get(n).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"),
                                                                         "row_count") for n in TABLE_NAMES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("m7_customer_star_metrics", f"""
WITH li AS (
  SELECT c.c_mktsegment AS segment, CAST(SUM(l.l_quantity) AS DOUBLE) AS total_kwh,
         CAST(SUM({CENTS.format(c='l.l_tax')}) AS DOUBLE) / 100 AS total_smc,
         CAST(SUM({CENTS.format(c='l.l_extendedprice')}) AS DOUBLE) / 100 / NULLIF(SUM(l.l_quantity), 0) AS cost_per_kwh,
         CAST(SUM(l.l_quantity) AS DOUBLE) / COUNT(l.l_quantity) AS avg_kwh
  FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1),
od AS (
  SELECT c.c_mktsegment AS segment, CAST(SUM({CENTS.format(c='o.o_totalprice')}) AS DOUBLE) / 100 AS total_revenue,
         COUNT(o.o_orderkey) AS n_supplies
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1),
cu AS (SELECT c_mktsegment AS segment, COUNT(c_custkey) AS n_customers FROM customer GROUP BY 1),
ev AS (
  SELECT c.c_mktsegment AS segment, COUNT(e.event_id) AS n_tickets,
         CAST(SUM({CENTS.format(c='e.value')}) AS DOUBLE) / COUNT(e.value) / 100 AS avg_resolution
  FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey GROUP BY 1)
SELECT COALESCE(li.segment, od.segment, cu.segment, ev.segment) AS segment,
       total_kwh, total_smc, total_revenue, cost_per_kwh, n_supplies, avg_kwh, n_customers, n_tickets,
       avg_resolution
FROM li FULL OUTER JOIN od ON li.segment IS NOT DISTINCT FROM od.segment
FULL OUTER JOIN cu ON COALESCE(li.segment, od.segment) IS NOT DISTINCT FROM cu.segment
FULL OUTER JOIN ev ON COALESCE(li.segment, od.segment, cu.segment) IS NOT DISTINCT FROM ev.segment""")
def m7_customer(spark, d):
    """Every customer-star metric by segment; four base tables, drill-across."""
    return build_model(spark, d).query(
        ["total_kwh", "total_smc", "total_revenue", "cost_per_kwh", "n_supplies", "avg_kwh",
         "n_customers", "n_tickets", "avg_resolution"], ["segment"])


@register("m17_plant_star_metrics", f"""
WITH li AS (
  SELECT p.p_type AS plant_type, CAST(SUM(l.l_quantity) AS DOUBLE) AS total_production,
         CAST(SUM({CENTS.format(c='l.l_extendedprice')} * {CENTS.format(c='l.l_discount')}) AS DOUBLE) / 10000 AS production_cost,
         CAST(SUM(CAST(l.l_quantity AS BIGINT) * {CENTS.format(c='p.p_retailprice')}) AS DOUBLE) / 100 AS potential_revenue,
         CAST(SUM(l.l_linenumber) AS DOUBLE) / COUNT(l.l_linenumber) AS avg_hours,
         CAST(SUM({CENTS.format(c='l.l_discount')}) AS DOUBLE) / COUNT(l.l_discount) / 100 AS avg_availability
  FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1),
pa AS (SELECT p_type AS plant_type, CAST(SUM(p_size) AS BIGINT) AS total_capacity, COUNT(p_partkey) AS n_plants
       FROM part GROUP BY 1)
SELECT COALESCE(li.plant_type, pa.plant_type) AS plant_type, total_production, production_cost,
       potential_revenue, avg_hours, avg_availability, total_capacity, n_plants,
       potential_revenue - production_cost AS production_margin
FROM li FULL OUTER JOIN pa ON li.plant_type IS NOT DISTINCT FROM pa.plant_type""")
def m17_plant(spark, d):
    """Every plant-star metric by plant type, derived margin after drill-across."""
    return build_model(spark, d).query(
        ["total_production", "production_cost", "potential_revenue", "avg_hours", "avg_availability",
         "total_capacity", "n_plants", "production_margin"], ["plant_type"])


@register("j4_drill_across_by_customer", f"""
WITH od AS (SELECT o_custkey AS k, COUNT(o_orderkey) AS n_supplies,
                   CAST(SUM({CENTS.format(c='o_totalprice')}) AS DOUBLE) / 100 AS total_revenue
            FROM orders GROUP BY 1),
ev AS (SELECT user_id AS k, COUNT(event_id) AS n_tickets FROM events GROUP BY 1)
SELECT c.c_custkey AS customer_id, n_supplies, total_revenue, n_tickets
FROM (SELECT COALESCE(od.k, ev.k) AS k, n_supplies, total_revenue, n_tickets
      FROM od FULL OUTER JOIN ev ON od.k = ev.k) x
LEFT JOIN customer c ON x.k = c.c_custkey""")
def j4(spark, d):
    """Bills and tickets per customer, each aggregated at its own grain, then combined on the key."""
    return build_model(spark, d).query(["n_supplies", "total_revenue", "n_tickets"], ["customer_id"])
