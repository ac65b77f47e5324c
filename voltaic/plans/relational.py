"""Registered queries for sources, predicates, joins, aggregates, sort/limit and scalar functions
(S1-S9, P1-P12, J1, J5, A1-A12, W2, W3, K1-K3, U1, F1-F22). Each docstring lists the IDs covered."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltaic.functions import scalar as X
from voltaic.operators.conversation import CHART_WORDS
from voltaic.operators import relational as R
from voltaic.plans.registry import register
from voltaic.sources.tables import Tables

CENTS = "CAST(ROUND({c} * 100) AS BIGINT)"

# Order status code table and contact channels used as a 5-value code table.
STATUS_LABELS = {"F": "CLOSED", "O": "OPEN", "P": "SUSPENDED"}
CHANNELS = ["EMAIL", "TELEFONO", "APP", "SOCIAL", "SPORTELLO"]


@register("p1_projection", """
SELECT c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS segment,
       c_acctbal AS balance FROM customer""")
def p1(spark, d):
    """Projection with aliases over a declared-schema scan (ReadSchema keeps 4 columns)."""
    c = Tables(spark, d).customer
    return c.select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"),
                    F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))


@register("p2_code_tables", f"""
SELECT CASE o_orderstatus {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS_LABELS.items())} END
         AS status_label,
       {[*CHANNELS]}[(o_orderkey % {len(CHANNELS)}) + 1] AS channel,
       COUNT(*) AS n_orders
FROM orders GROUP BY 1, 2""")
def p2(spark, d):
    """Simple CASE over a code table and a modular code lookup (``element_at``)."""
    o = Tables(spark, d).orders
    status = F.create_map(*[F.lit(x) for kv in STATUS_LABELS.items() for x in kv])[F.col("o_orderstatus")]
    return (o.select(status.alias("status_label"),
                     X.code_lookup("o_orderkey", CHANNELS).alias("channel"))
            .groupBy("status_label", "channel").agg(F.count(F.lit(1)).alias("n_orders")))


@register("p3_length_bands", """
SELECT lang, CASE WHEN n_chars > 10000 THEN 'long' WHEN n_chars > 1000 THEN 'medium' ELSE 'short' END AS band,
       COUNT(*) AS n_docs
FROM documents GROUP BY 1, 2""")
def p3(spark, d):
    """Searched CASE (banding) on a numeric column."""
    docs = Tables(spark, d).documents
    band = F.when(F.col("n_chars") > 10000, "long").when(F.col("n_chars") > 1000, "medium").otherwise("short")
    return docs.select("lang", band.alias("band")).groupBy("lang", "band").agg(F.count(F.lit(1)).alias("n_docs"))


@register("p4_p5_filters", f"""
SELECT o_orderpriority AS priority, COUNT(*) AS n_orders,
       CAST(SUM({CENTS.format(c='o_totalprice')}) AS DOUBLE) / 100 AS total_price
FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1""")
def p4_p5(spark, d):
    """Equality and IN-list filters (both pushed to the parquet scan)."""
    o = Tables(spark, d).orders
    return (o.where((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
            .groupBy(F.col("o_orderpriority").alias("priority"))
            .agg(F.count(F.lit(1)).alias("n_orders"), X.from_cents_sum(X.cents("o_totalprice")).alias("total_price")))


@register("p6_wrapped_month_range", """
SELECT month(l_shipdate) AS ship_month, COUNT(*) AS n_lines,
       CAST(SUM(CASE WHEN month(l_shipdate) BETWEEN 10 AND 3 THEN 1 ELSE 0 END) AS BIGINT) AS n_naive_between
FROM lineitem WHERE month(l_shipdate) >= 10 OR month(l_shipdate) <= 3 GROUP BY 1""")
def p6(spark, d):
    """Month range that wraps the year (Oct..Mar); the naive BETWEEN 10 AND 3 is empty."""
    li = Tables(spark, d).lineitem
    return (li.where(X.month_in_wrapped("l_shipdate", 10, 3))
            .groupBy(F.month("l_shipdate").cast("long").alias("ship_month"))
            .agg(F.count(F.lit(1)).alias("n_lines"),
                 F.count_if(F.month("l_shipdate").between(10, 3)).alias("n_naive_between")))


@register("p9_limit_ordered", """
SELECT doc_id, lang, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10""")
def p9(spark, d):
    """P9, K1 form: LIMIT always behind a key order (quirk 12)."""
    docs = Tables(spark, d).documents
    return R.top_n(docs.select("doc_id", "lang", "source", "n_chars"), [F.desc("n_chars"), "doc_id"], 10)


@register("p10_distinct", """
SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS priority FROM orders""")
def p10(spark, d):
    """SELECT DISTINCT on two columns (partial distinct map-side, then final)."""
    o = Tables(spark, d).orders
    return o.select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).distinct()


# Our own requests, one for each order priority.
REQUESTS = {"1-URGENT": "Mostra subito un GRAFICO delle forniture sospese", "2-HIGH": "Quante forniture sono aperte?",
            "3-MEDIUM": "Plot the supplies of this quarter", "5-LOW": "Una torta dei clienti per segmento"}


@register("p12_request_intent", f"""
WITH r AS (SELECT o_custkey, CASE o_orderpriority {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REQUESTS.items())} ELSE 'Elenco dei clienti' END
                             || ' numero ' || CAST(o_orderkey AS VARCHAR) AS request FROM orders)
SELECT o_custkey AS customer_id, COUNT(*) AS n_requests,
       CAST(SUM(CASE WHEN regexp_matches(lower(request), '{"|".join(CHART_WORDS)}') THEN 1 ELSE 0 END) AS BIGINT) AS n_chart_requests
FROM r GROUP BY 1""")
def p12_requests(spark, d):
    """Intent flag of the requests that customers' orders stand for; some ask for a chart and some don't."""
    o = Tables(spark, d).orders
    said = F.coalesce(*[F.when(F.col("o_orderpriority") == k, v) for k, v in REQUESTS.items()], F.lit("Elenco dei clienti"))
    request = F.lower(F.concat(said, F.lit(" numero "), F.col("o_orderkey").cast("string")))
    return o.groupBy(F.col("o_custkey").alias("customer_id")).agg(
        F.count(F.lit(1)).alias("n_requests"), F.count_if(request.rlike("|".join(CHART_WORDS))).alias("n_chart_requests"))


@register("p12_chart_intent", f"""
SELECT conv_id, COUNT(*) AS n_user_turns,
       CAST(SUM(CASE WHEN regexp_matches(lower(text), '{"|".join(CHART_WORDS)}') THEN 1 ELSE 0 END) AS BIGINT)
         AS n_chart_requests
FROM conversations WHERE role = 'user' GROUP BY 1""")
def p12(spark, d):
    """Keyword intent flag (lower-cased text contains any word of a list)."""
    c = Tables(spark, d).conversations
    flag = F.lower("text").rlike("|".join(CHART_WORDS))
    return (c.where(F.col("role") == "user").groupBy("conv_id")
            .agg(F.count(F.lit(1)).alias("n_user_turns"), F.count_if(flag).alias("n_chart_requests")))


@register("a1_a7_orders_by_status", f"""
SELECT o_orderstatus AS status, COUNT(*) AS n_rows, COUNT(o_orderkey) AS n_keys,
       COUNT(DISTINCT o_custkey) AS n_customers,
       CAST(SUM({CENTS.format(c='o_totalprice')}) AS DOUBLE) / 100 AS total_price,
       CAST(SUM({CENTS.format(c='o_totalprice')}) AS DOUBLE) / COUNT(o_totalprice) / 100 AS avg_price,
       MIN(o_totalprice) AS min_price, MAX(o_totalprice) AS max_price,
       CAST(SUM(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS n_urgent
FROM orders GROUP BY 1""")
def a1_a7(spark, d):
    """A1 COUNT(*), A2 COUNT(col), A3 COUNT(DISTINCT), A4 SUM, A5 AVG, A6 MIN/MAX, A7 conditional count."""
    o = Tables(spark, d).orders
    c = X.cents("o_totalprice")
    return o.groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("o_orderkey").alias("n_keys"),
        F.count_distinct("o_custkey").alias("n_customers"),
        X.from_cents_sum(c).alias("total_price"), X.exact_avg_cents(c).alias("avg_price"),
        F.min("o_totalprice").alias("min_price"), F.max("o_totalprice").alias("max_price"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"))


@register("a8_global_kpi", f"""
SELECT COUNT(*) AS n_orders, COUNT(DISTINCT o_custkey) AS n_customers,
       CAST(SUM({CENTS.format(c='o_totalprice')}) AS DOUBLE) / 100 AS total_price,
       MIN(o_orderdate) AS first_order, MAX(o_orderdate) AS last_order
FROM orders""")
def a8(spark, d):
    """Global aggregate, no keys (one KPI row)."""
    o = Tables(spark, d).orders
    return o.agg(F.count(F.lit(1)).alias("n_orders"), F.count_distinct("o_custkey").alias("n_customers"),
                 X.from_cents_sum(X.cents("o_totalprice")).alias("total_price"),
                 F.min("o_orderdate").alias("first_order"), F.max("o_orderdate").alias("last_order"))


@register("a9_a11_line_ratios", f"""
SELECT l_returnflag AS return_flag,
       CAST(SUM({CENTS.format(c='l_extendedprice')}) AS DOUBLE) / 100 / NULLIF(SUM(l_quantity), 0) AS price_per_unit,
       CAST(SUM(CAST(l_quantity AS BIGINT) * {CENTS.format(c='l_extendedprice')}) AS DOUBLE) / 100 AS qty_x_price,
       CAST(SUM(CAST(l_quantity AS BIGINT) * {CENTS.format(c='l_extendedprice')}) AS DOUBLE) / 100
         - CAST(SUM({CENTS.format(c='l_extendedprice')}) AS DOUBLE) / 100 AS derived_gap
FROM lineitem GROUP BY 1""")
def a9_a11(spark, d):
    """A9 guarded ratio of sums, A10 sum of a product, A11 metric derived from two metrics."""
    li = Tables(spark, d).lineitem
    price = X.cents("l_extendedprice")
    g = li.groupBy(F.col("l_returnflag").alias("return_flag")).agg(
        X.safe_ratio(F.sum(price).cast("double") / 100, F.sum("l_quantity")).alias("price_per_unit"),
        (F.sum(F.col("l_quantity").cast("long") * price).cast("double") / 100).alias("qty_x_price"),
        (F.sum(price).cast("double") / 100).alias("_sum_price"))
    return g.withColumn("derived_gap", F.col("qty_x_price") - F.col("_sum_price")).drop("_sum_price")


@register("a12_w3_segment_share", """
SELECT c_mktsegment AS segment, COUNT(*) AS n_customers, COUNT(*) / SUM(COUNT(*)) OVER () AS share
FROM customer GROUP BY 1""")
def a12(spark, d):
    """Share of total per group (pie-chart data); total as a scalar subquery."""
    c = Tables(spark, d).customer
    g = c.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n_customers"))
    return R.share_of_total(g, "n_customers")


@register("j1_w2_customer_month_grid", """
SELECT c_custkey AS customer_id, m AS months_ago,
       CAST(date_trunc('month', (SELECT max(o_orderdate) FROM orders)) - to_months(m) AS DATE) AS month
FROM customer, range(12) r(m)""")
def j1(spark, d):
    """Entity x calendar fact grid, 12 months ending at the latest order month."""
    t = Tables(spark, d)
    as_of = t.orders.select(F.max("o_orderdate")).scalar()
    g = R.period_grid(t.customer.select(F.col("c_custkey").alias("customer_id")), as_of, 12)
    return g.withColumn("months_ago", F.col("months_ago").cast("long"))


@register("j5_key_audit", """
SELECT 'orders: duplicate c_custkey' AS "check",
       (SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) FROM (SELECT COUNT(*) n FROM customer GROUP BY c_custkey HAVING COUNT(*) > 1)) AS n_bad,
       (SELECT COUNT(*) FROM customer) AS n_rows
UNION ALL SELECT 'orders: duplicate o_orderkey',
       (SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) FROM (SELECT COUNT(*) n FROM orders GROUP BY o_orderkey HAVING COUNT(*) > 1)),
       (SELECT COUNT(*) FROM orders)
UNION ALL SELECT 'orders: orphan o_custkey',
       (SELECT COUNT(*) FROM orders o WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)),
       (SELECT COUNT(*) FROM orders)
UNION ALL SELECT 'events: duplicate c_custkey',
       (SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) FROM (SELECT COUNT(*) n FROM customer GROUP BY c_custkey HAVING COUNT(*) > 1)),
       (SELECT COUNT(*) FROM customer)
UNION ALL SELECT 'events: duplicate event_id',
       (SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) FROM (SELECT COUNT(*) n FROM events GROUP BY event_id HAVING COUNT(*) > 1)),
       (SELECT COUNT(*) FROM events)
UNION ALL SELECT 'events: orphan user_id',
       (SELECT COUNT(*) FROM events e WHERE user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = e.user_id)),
       (SELECT COUNT(*) FROM events)""")
def j5(spark, d):
    """Unique primary keys and orphan foreign keys for two declared relationships."""
    t = Tables(spark, d)
    return (R.key_audit(t.orders, "o_orderkey", "o_custkey", t.customer, "c_custkey", "orders")
            .unionByName(R.key_audit(t.events, "event_id", "user_id", t.customer, "c_custkey", "events")))


@register("s4_append_with_ids", """
WITH base AS (SELECT c_custkey AS id, c_name, c_mktsegment FROM customer WHERE c_mktsegment <> 'AUTOMOBILE')
SELECT * FROM base
UNION ALL
SELECT (SELECT max(id) FROM base) + row_number() OVER (ORDER BY c_custkey) AS id, c_name, c_mktsegment
FROM customer WHERE c_mktsegment = 'AUTOMOBILE'""")
def s4(spark, d):
    """S4, W1 at scale: append rows with auto-increment ids after ``max(id)`` (distributed numbering)."""
    c = Tables(spark, d).customer
    base = c.where(F.col("c_mktsegment") != "AUTOMOBILE").select(F.col("c_custkey").alias("id"), "c_name",
                                                                 "c_mktsegment")
    new = c.where(F.col("c_mktsegment") == "AUTOMOBILE").select("c_custkey", "c_name", "c_mktsegment")
    return R.append_rows(base, new, "id", ["c_custkey"])


@register("s6_dependent_cost_update", """
WITH a AS (
  SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DECIMAL(12,2)) AS kwh, CAST(l_tax * 100 AS DECIMAL(12,2)) AS smc,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS energy_cost FROM lineitem),
b AS (
  SELECT *, CAST(kwh * 0.03 + smc * 0.05 AS DECIMAL(12,2)) AS transport_cost,
            CAST(kwh * 0.02 + smc * 0.03 AS DECIMAL(12,2)) AS charges FROM a)
SELECT l_orderkey, l_linenumber, transport_cost, charges,
       CAST(energy_cost + transport_cost + charges AS DECIMAL(12,2)) AS total_cost FROM b""")
def s6(spark, d):
    """Two dependent UPDATE passes (second reads the first), stored as NUMBER(12,2)."""
    li = Tables(spark, d).lineitem
    dec = "decimal(12,2)"
    base = li.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast(dec).alias("kwh"),
                     F.round(F.col("l_tax") * 100, 2).cast(dec).alias("smc"),
                     F.col("l_extendedprice").cast(dec).alias("energy_cost"))
    out = R.dependent_update(base, [
        {"transport_cost": (F.col("kwh") * F.lit(0.03).cast("decimal(3,2)")
                            + F.col("smc") * F.lit(0.05).cast("decimal(3,2)")).cast(dec),
         "charges": (F.col("kwh") * F.lit(0.02).cast("decimal(3,2)")
                     + F.col("smc") * F.lit(0.03).cast("decimal(3,2)")).cast(dec)},
        {"total_cost": (F.col("energy_cost") + F.col("transport_cost") + F.col("charges")).cast(dec)},
    ])
    return out.select("l_orderkey", "l_linenumber", "transport_cost", "charges", "total_cost")


@register("f_scalar_math", f"""
SELECT o_orderkey, o_orderkey % 3 AS mod3,
       ROUND({CENTS.format(c='o_totalprice')} / 10.0) / 10 AS price_1dp,
       CAST(CEIL(o_totalprice / 1000) AS BIGINT) AS price_k,
       NULLIF(o_orderstatus, 'P') AS status_or_null,
       {CENTS.format(c='o_totalprice')} * 3 AS triple_cents
FROM orders""")
def f_math(spark, d):
    """F1 MOD, F2 ROUND (on exact cents), F3 CEIL, F5 NULLIF, F6 exact arithmetic."""
    o = Tables(spark, d).orders
    c = X.cents("o_totalprice")
    return o.select("o_orderkey", F.pmod("o_orderkey", F.lit(3)).alias("mod3"),
                    (F.round(c / 10.0) / 10).alias("price_1dp"),
                    F.ceil(F.col("o_totalprice") / 1000).cast("long").alias("price_k"),
                    F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status_or_null"),
                    (c * 3).alias("triple_cents"))


@register("f_scalar_string", """
SELECT c_custkey, substr(c_name, 1, 8) || '...' AS name_preview,
       lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS padded_key,
       'IT001E' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS pod,
       lower(c_mktsegment) AS segment_lower, length(c_name) AS name_len,
       array_to_string(list_transform(string_split(lower(replace(c_mktsegment || '_client', '_', ' ')), ' '),
                       lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS segment_label,
       CAST(c_nationkey AS VARCHAR) || '-' || c_mktsegment AS nation_segment
FROM customer""")
def f_string(spark, d):
    """F7 SUBSTR, F8 concat, F9 LPAD, F10 LOWER, F11 LENGTH, F12 cast to text, F21 label tidy."""
    c = Tables(spark, d).customer
    return c.select("c_custkey", X.preview("c_name", 8).alias("name_preview"),
                    F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("padded_key"),
                    F.concat(F.lit("IT001E"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("pod"),
                    F.lower("c_mktsegment").alias("segment_lower"), F.length("c_name").cast("long").alias("name_len"),
                    X.tidy_label(F.lower(F.concat("c_mktsegment", F.lit("_client")))).alias("segment_label"),
                    F.concat(F.col("c_nationkey").cast("string"), F.lit("-"), "c_mktsegment").alias("nation_segment"))


@register("f_scalar_date", """
SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start,
       CAST(date_trunc('month', o_orderdate) - INTERVAL 3 MONTH AS DATE) AS three_months_back,
       CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS plus_one_month,
       CAST(CAST(o_orderdate AS DATE) - INTERVAL 30 DAY AS DATE) AS minus_30_days,
       o_orderdate - INTERVAL 5 HOUR AS minus_5_hours,
       month(o_orderdate) AS month_no, year(o_orderdate) AS year_no
FROM orders""")
def f_date(spark, d):
    """F13 explicit as-of, F14 DATEADD (day, month, hour), F15 DATE_TRUNC month, F16 MONTH."""
    o = Tables(spark, d).orders
    day = F.col("o_orderdate").cast("date")
    return o.select("o_orderkey", X.month_start("o_orderdate").alias("month_start"),
                    X.months_back(F.col("o_orderdate"), 3).alias("three_months_back"),
                    F.add_months(day, 1).alias("plus_one_month"), F.date_sub(day, 30).alias("minus_30_days"),
                    (F.col("o_orderdate") - F.expr("INTERVAL 5 HOURS")).alias("minus_5_hours"),
                    F.month("o_orderdate").cast("long").alias("month_no"),
                    F.year("o_orderdate").cast("long").alias("year_no"))


@register("f_scalar_json", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
       CAST(json_extract(props, '$.k') AS INTEGER) + 1 AS k_plus_one,
       json_extract(props, '$.missing') IS NULL AS missing_is_null,
       len([event_type, 'x']) AS n_tags
FROM events""")
def f_json(spark, d):
    """F17 PARSE_JSON (VARIANT), F18 path access ``v:k::int``, F19 array literal."""
    e = Tables(spark, d).events
    v = F.parse_json("props")
    return e.select("event_id", F.variant_get(v, "$.k", "int").alias("k"),
                    (F.variant_get(v, "$.k", "int") + 1).alias("k_plus_one"),
                    F.try_variant_get(v, "$.missing", "string").isNull().alias("missing_is_null"),
                    F.size(F.array("event_type", F.lit("x"))).cast("long").alias("n_tags"))


@register("f20_locale_amounts", f"""
SELECT o_orderpriority AS priority,
       translate(format('{{:,.2f}}', CAST(SUM({CENTS.format(c='o_totalprice')}) AS DOUBLE) / 100), ',.', '.,') || ' EUR'
         AS total_eur
FROM orders GROUP BY 1""")
def f20(spark, d):
    """Italian number format ``1.234.567,89 EUR`` of an exact sum."""
    o = Tables(spark, d).orders
    g = o.groupBy(F.col("o_orderpriority").alias("priority")).agg(
        X.from_cents_sum(X.cents("o_totalprice")).alias("t"))
    return g.select("priority", X.locale_number("t", 2, "EUR").alias("total_eur"))
