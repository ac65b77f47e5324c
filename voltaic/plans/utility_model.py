"""The energy-utility semantic model, bound to the driver's tables (role map in FIXTURES.md §C).

Two disconnected stars, as in the domain: customers (supplies = orders/lineitem, tickets = events)
and plants (parts, production = lineitem by part). Lineitem sits in both: its path to customers runs
through orders, its path to plants through part.

Money facts are integer cents (exact sums), turned back into doubles by the metric expressions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from voltaic.plans.metrics import SemanticModel
from voltaic.sources.tables import Tables

SUM_CENTS = "CAST(SUM(CAST({f} AS DECIMAL(38,0))) AS DOUBLE) / 100"
AVG_CENTS = "CAST(SUM(CAST({f} AS DECIMAL(38,0))) AS DOUBLE) / COUNT({f}) / 100"
AVG_PLAIN = "CAST(SUM({f}) AS DOUBLE) / COUNT({f})"


def build_model(spark: SparkSession, sf_dir: str) -> SemanticModel:
    t = Tables(spark, sf_dir)
    m = SemanticModel("utility_model", "customers, supplies, tickets and plants of an energy utility")

    # M1 logical tables
    m.table("customers", lambda: t.customer, ["c_custkey"], ["clienti", "clients", "customer"],
            "customer master data")
    m.table("cities", lambda: t.nation, ["n_nationkey"], ["città", "city", "comune"], "city of a customer")
    m.table("provinces", lambda: t.region, ["r_regionkey"], ["provincia", "province"], "province")
    m.table("supplies", lambda: t.orders, ["o_orderkey"], ["forniture", "bills", "bollette"],
            "monthly supply and bill per customer")
    m.table("consumption", lambda: t.lineitem, ["l_orderkey", "l_linenumber"],
            ["consumi", "consumption", "readings"], "metered consumption lines")
    m.table("tickets", lambda: t.events, ["event_id"], ["feedback", "reclami", "ticket"],
            "customer tickets")
    m.table("plants", lambda: t.part, ["p_partkey"], ["impianti", "impianto", "plant"],
            "generation plants")

    # M2 relationships (many-to-one, to the primary key)
    m.relate("consumption_to_supply", "consumption", ["l_orderkey"], "supplies", ["o_orderkey"])
    m.relate("supply_to_customer", "supplies", ["o_custkey"], "customers", ["c_custkey"])
    m.relate("ticket_to_customer", "tickets", ["user_id"], "customers", ["c_custkey"])
    m.relate("customer_to_city", "customers", ["c_nationkey"], "cities", ["n_nationkey"])
    m.relate("city_to_province", "cities", ["n_regionkey"], "provinces", ["r_regionkey"])
    m.relate("production_to_plant", "consumption", ["l_partkey"], "plants", ["p_partkey"])

    # M3 facts
    m.fact("kwh", "consumption", "l_quantity", ["consumo kwh", "energy"], "energy, kWh")
    m.fact("smc_cents", "consumption", "CAST(ROUND(l_tax * 100) AS BIGINT)", ["gas"], "gas volume")
    m.fact("energy_cost_cents", "consumption", "CAST(ROUND(l_extendedprice * 100) AS BIGINT)",
           ["costo energia"], "energy cost")
    m.fact("production_cost_cents", "consumption",
           "CAST(ROUND(l_extendedprice * 100) AS BIGINT) * CAST(ROUND(l_discount * 100) AS BIGINT)",
           ["costo produzione"], "production cost, cents x percent points")
    m.fact("potential_revenue_cents", "consumption",
           "CAST(l_quantity AS BIGINT) * CAST(ROUND(p_retailprice * 100) AS BIGINT)",
           ["ricavo"], "energy x sale price", requires=["plants"])
    m.fact("hours", "consumption", "l_linenumber", ["ore funzionamento"], "operating hours")
    m.fact("availability_cents", "consumption", "CAST(ROUND(l_discount * 100) AS BIGINT)",
           ["disponibilità"], "availability")
    m.fact("bill_cents", "supplies", "CAST(ROUND(o_totalprice * 100) AS BIGINT)",
           ["costo totale", "bolletta"], "total bill")
    m.fact("resolution_cents", "tickets", "CAST(ROUND(value * 100) AS BIGINT)",
           ["tempo risoluzione"], "resolution time")
    m.fact("capacity", "plants", "p_size", ["capacità", "mw"], "installed capacity")
    m.fact("efficiency_cents", "plants", "CAST(ROUND(p_retailprice * 100) AS BIGINT)",
           ["efficienza"], "efficiency")

    # M4 dimensions
    m.dimension("customer_id", "customers", "c_custkey", ["id cliente"])
    m.dimension("customer_name", "customers", "c_name", ["nome", "cliente"])
    m.dimension("segment", "customers", "c_mktsegment", ["segmento", "tipo cliente", "customer type"])
    m.dimension("city", "cities", "n_name", ["città", "comune", "citta"])
    m.dimension("province", "provinces", "r_name", ["provincia"])
    m.dimension("supply_id", "supplies", "o_orderkey", ["id fornitura"])
    m.dimension("supply_status", "supplies", "o_orderstatus", ["stato contratto", "stato"])
    m.dimension("contract_type", "supplies", "o_orderpriority", ["tipo contratto", "priorità"])
    m.dimension("supply_month", "supplies", "trunc(CAST(o_orderdate AS DATE), 'MM')", ["mese"])
    m.dimension("reading_month", "consumption", "trunc(CAST(l_shipdate AS DATE), 'MM')",
                ["data produzione", "mese produzione"])
    m.dimension("return_flag", "consumption", "l_returnflag", ["fascia oraria"])
    m.dimension("line_status", "consumption", "l_linestatus", ["fonte energia"])
    m.dimension("ticket_kind", "tickets", "event_type", ["categoria", "priorità ticket"])
    m.dimension("ticket_month", "tickets", "trunc(CAST(ts AS DATE), 'MM')", ["data feedback"])
    m.dimension("plant_id", "plants", "p_partkey", ["id impianto"])
    m.dimension("plant_name", "plants", "p_name", ["nome impianto"])
    m.dimension("plant_type", "plants", "p_type", ["tipo impianto", "tipologia"])
    m.dimension("plant_brand", "plants", "p_brand", ["località", "regione impianto"])
    # quirk 2 of the survey: logical name over a differently named physical column
    m.dimension("plant_state", "plants", "p_brand", ["stato impianto"])

    # M8-M23 metrics, M24 derived. ``parts``/``final`` restate each additive metric as partial
    # aggregates (sum/count) and a final expression, so the planner may aggregate before joining.
    m.metric("total_kwh", "consumption", "CAST(SUM(kwh) AS DOUBLE)", ["consumo totale"], cast="double",
             parts=[('sum', 'kwh')], final='CAST({0} AS DOUBLE)')
    m.metric("total_smc", "consumption", SUM_CENTS.format(f="smc_cents"), ["gas totale"],
             parts=[('wsum', 'smc_cents')], final='CAST({0} AS DOUBLE) / 100')
    m.metric("total_revenue", "supplies", SUM_CENTS.format(f="bill_cents"), ["fatturato"],
             parts=[('wsum', 'bill_cents')], final='CAST({0} AS DOUBLE) / 100')
    m.metric("cost_per_kwh", "consumption",
             "CAST(SUM(CAST(energy_cost_cents AS DECIMAL(38,0))) AS DOUBLE) / 100 / NULLIF(SUM(kwh), 0)", ["costo medio kwh"],
             parts=[('wsum', 'energy_cost_cents'), ('sum', 'kwh')], final='CAST({0} AS DOUBLE) / 100 / NULLIF({1}, 0)')
    m.metric("n_supplies", "supplies", "COUNT(o_orderkey)", ["numero forniture"],
             parts=[('count', 'o_orderkey')], final='{0}')
    m.metric("revenue_cents", "supplies", "SUM(CAST(bill_cents AS DECIMAL(38,0)))", ["fatturato centesimi"],
             parts=[('wsum', 'bill_cents')], final='{0}')
    m.metric("avg_bill", "supplies", AVG_CENTS.format(f="bill_cents"), ["bolletta media"],
             parts=[('wsum', 'bill_cents'), ('count', 'bill_cents')], final='CAST({0} AS DOUBLE) / {1} / 100')
    # mean bill rounded half-up to whole cents in integer arithmetic (ROUND(avg, 2) of a double can
    # differ between engines at .xx5)
    m.metric("avg_bill_cents_rounded", "supplies",
             "(2 * SUM(CAST(bill_cents AS DECIMAL(38,0))) + COUNT(bill_cents)) DIV (2 * COUNT(bill_cents))",
             parts=[("wsum", "bill_cents"), ("count", "bill_cents")], final="(2 * {0} + {1}) DIV (2 * {1})")
    m.metric("n_active_customers", "supplies", "COUNT(DISTINCT o_custkey)", ["clienti attivi"])
    # mergeable form for very large keys: partial sketches instead of a shuffle of distinct keys
    m.metric("n_active_customers_approx", "supplies", "HLL_SKETCH_ESTIMATE(HLL_SKETCH_AGG(o_custkey, 14))", ["clienti attivi stimati"],
             parts=[("distinct", "o_custkey")], final="HLL_SKETCH_ESTIMATE({0})")
    m.metric("avg_kwh", "consumption", AVG_PLAIN.format(f="kwh"), ["consumo medio"],
             parts=[('sum', 'kwh'), ('count', 'kwh')], final='CAST({0} AS DOUBLE) / {1}')
    m.metric("n_customers", "customers", "COUNT(c_custkey)", ["numero clienti"],
             parts=[('count', 'c_custkey')], final='{0}')
    m.metric("n_tickets", "tickets", "COUNT(event_id)", ["numero ticket"],
             parts=[('count', 'event_id')], final='{0}')
    m.metric("avg_resolution", "tickets", AVG_CENTS.format(f="resolution_cents"), ["tempo medio"],
             parts=[('wsum', 'resolution_cents'), ('count', 'resolution_cents')], final='CAST({0} AS DOUBLE) / {1} / 100')
    m.metric("total_production", "consumption", "CAST(SUM(kwh) AS DOUBLE)", ["produzione totale"],
             parts=[('sum', 'kwh')], final='CAST({0} AS DOUBLE)')
    m.metric("production_cost", "consumption",
             "CAST(SUM(CAST(production_cost_cents AS DECIMAL(38,0))) AS DOUBLE) / 10000", ["costo produzione totale"],
             parts=[('wsum', 'production_cost_cents')], final='CAST({0} AS DOUBLE) / 10000')
    m.metric("potential_revenue", "consumption", SUM_CENTS.format(f="potential_revenue_cents"),
             ["ricavo potenziale"],
             parts=[('wsum', 'potential_revenue_cents')], final='CAST({0} AS DOUBLE) / 100')
    m.metric("avg_hours", "consumption", AVG_PLAIN.format(f="hours"), ["ore medie"],
             parts=[('sum', 'hours'), ('count', 'hours')], final='CAST({0} AS DOUBLE) / {1}')
    m.metric("avg_availability", "consumption", AVG_CENTS.format(f="availability_cents"),
             ["disponibilità media"],
             parts=[('wsum', 'availability_cents'), ('count', 'availability_cents')], final='CAST({0} AS DOUBLE) / {1} / 100')
    m.metric("total_capacity", "plants", "CAST(SUM(capacity) AS BIGINT)", ["capacità totale"],
             parts=[('sum', 'capacity')], final='CAST({0} AS BIGINT)')
    m.metric("n_plants", "plants", "COUNT(p_partkey)", ["numero impianti"],
             parts=[('count', 'p_partkey')], final='{0}')
    m.derived("production_margin", "potential_revenue - production_cost",
              ["potential_revenue", "production_cost"], ["margine"])
    # not a named metric in the domain (Q8 averages a fact directly), kept here for reuse
    m.metric("avg_efficiency", "plants", AVG_CENTS.format(f="efficiency_cents"), ["efficienza media"],
             parts=[('wsum', 'efficiency_cents'), ('count', 'efficiency_cents')], final='CAST({0} AS DOUBLE) / {1} / 100')
    return m
