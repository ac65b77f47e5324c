"""Registered conversation-log and chart-data queries: C1, C2, C3 with Q15-Q17."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltaic.operators import conversation as C
from voltaic.operators.relational import share_of_total
from voltaic.plans.business import _latest_month, add_months, in_months
from voltaic.plans.registry import register
from voltaic.plans.utility_model import build_model
from voltaic.sources.tables import Tables

MONTH = "CAST(date_trunc('month', {c}) AS DATE)"
CENTS = "CAST(ROUND({c} * 100) AS BIGINT)"


@register("c1_pack_history", """
WITH lu AS (SELECT conv_id, MAX(turn) AS last_user FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT c.conv_id, COUNT(*) AS n_messages,
       CAST(to_json(list({'role': role, 'content': [{'type': 'text', 'text': text}]} ORDER BY turn)) AS VARCHAR) AS messages_json
FROM conversations c JOIN lu USING (conv_id) WHERE c.turn <= lu.last_user GROUP BY c.conv_id""")
def c1(spark, d):
    """Chat history packed into the model's message list, latest user turn last."""
    p = C.pack_history(Tables(spark, d).conversations)
    return p.select("conv_id", F.col("n_messages").cast("long").alias("n_messages"),
                    F.to_json("messages").alias("messages_json"))


def event_log(spark, d):
    """The ``events`` table read as an agent event log (conversation = user, order = ts, event_id).

    Fixed mapping used by the tests; ``k`` is the event's number and decides between the kinds of a type,
    so that all eleven occur: view -> text delta, thinking or message delta; click -> status or tool use;
    purchase -> tool result, analyst delta or chart; signup -> final text or whole response; error -> error.
    """
    e = Tables(spark, d).events.withColumn("k", F.variant_get(F.parse_json("props"), "$.k", "int"))
    k = F.col("k")
    s, et = k.cast("string"), F.col("event_type")
    say = lambda pre, post="": F.concat(F.lit(pre), s, F.lit(post))
    by3, by2 = k % 3, k % 2
    sql = F.when(by2 == 1, say("SELECT ")).otherwise("")
    result = F.array(F.struct(F.lit("json").alias("type"), F.struct(
        sql.alias("sql"), F.concat(F.lit("t"), (k % 7).cast("string"), F.lit(" ")).alias("text"),
        F.when(k % 5 == 0, F.array(say("c"))).alias("charts")).alias("json")))
    body = F.struct(sql.alias("sql"), say("a", " ").alias("text"))
    message = F.array(
        F.struct(F.lit("text").alias("type"), say("m", " ").alias("text"), F.lit(None).cast(
            "struct<content:array<struct<type:string,json:struct<sql:string,text:string>>>>").alias("tool_results")),
        F.struct(F.lit("tool_results").alias("type"), F.lit(None).cast("string").alias("text"), F.struct(F.array(F.struct(
            F.lit("json").alias("type"), F.struct(say("SELECT m").alias("sql"), say("r", " ").alias("text")).alias("json"))
        ).alias("content")).alias("tool_results")))
    whole = F.concat(
        F.lit('{"content":[{"type":"text","text":"whole '), s, F.lit('"},{"type":"chart","chart":{"chart_spec":"w'), s,
        F.lit('"}},{"type":"tool_result","tool_result":{"content":[{"type":"json","json":{"sql":"SELECT w'), s, F.lit('"}}]}}]}'))
    js = lambda c, name: F.to_json(F.struct(c.alias(name)))
    kinds = [
        ((et == "view") & (by3 == 0), C.TEXT_DELTA, js(say("w", " "), "text")),
        ((et == "view") & (by3 == 1), C.THINKING, js(say("hm "), "text")),
        (et == "view", C.MESSAGE_DELTA, js(F.struct(message.alias("content")), "delta")),
        ((et == "click") & (by2 == 0), C.STATUS, js(say("step_"), "status")),
        (et == "click", C.TOOL_USE, js(F.when(k % 4 == 1, "Ricerca_Contratti").otherwise("Analisi_Dati"), "name")),
        ((et == "purchase") & (by3 == 0), C.TOOL_RESULT, js(result, "content")),
        ((et == "purchase") & (by3 == 1), C.ANALYST_DELTA, F.when(by2 == 0, js(body, "delta")).otherwise(F.to_json(body))),
        (et == "purchase", C.CHART, js(say("n"), "chart_spec")),
        ((et == "signup") & (by2 == 0), C.FINAL_TEXT, js(say("final "), "text")),
        (et == "signup", C.RESPONSE, whole),
        (et == "error", C.ERROR, F.when(k % 10 == 0, "{}").otherwise(js(say("code "), "message")))]
    kind = F.coalesce(*[F.when(on, name) for on, name, _ in kinds])
    data = F.coalesce(*[F.when(on, value) for on, _, value in kinds])
    return e.select(F.col("user_id").alias("conv_id"), "ts", "event_id", kind.alias("event"), data.alias("data"))


@register("c2_fold_event_log", r"""
WITH RECURSIVE m AS (SELECT user_id AS conv_id, ts, event_id, event_type AS et, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),
e AS (SELECT conv_id, et, k, row_number() OVER (PARTITION BY conv_id ORDER BY ts, event_id) AS i,
  CASE WHEN et = 'view' AND k % 3 = 0 THEN 'w' || k || ' '
       WHEN et = 'view' AND k % 3 = 2 THEN 'm' || k || ' r' || k || ' '
       WHEN et = 'purchase' AND k % 3 = 1 THEN 'a' || k || ' '
       WHEN et = 'error' THEN chr(10) || 'Errore: ' || CASE WHEN k % 10 = 0 THEN '{}' ELSE 'code ' || k END END AS added,
  CASE WHEN et = 'signup' THEN CASE WHEN k % 2 = 0 THEN 'final ' || k ELSE 'whole ' || k END END AS if_empty,
  CASE WHEN et = 'purchase' AND k % 3 = 0 THEN 't' || (k % 7) || ' ' END AS if_unsaid,
  CASE WHEN et = 'view' AND k % 3 = 2 THEN 'SELECT m' || k
       WHEN et = 'purchase' AND k % 3 < 2 AND k % 2 = 1 THEN 'SELECT ' || k
       WHEN et = 'signup' AND k % 2 = 1 THEN 'SELECT w' || k END AS new_sql,
  CASE WHEN et = 'purchase' AND k % 3 = 0 AND k % 5 = 0 THEN 'c' || k
       WHEN et = 'purchase' AND k % 3 = 2 THEN 'n' || k
       WHEN et = 'signup' AND k % 2 = 1 THEN 'w' || k END AS new_chart,
  CASE WHEN et = 'click' THEN CASE WHEN k % 2 = 0 THEN ['planning'] WHEN k % 4 = 1 THEN ['search'] ELSE ['tool_call'] END
       WHEN et = 'purchase' AND k % 3 = 0 THEN list_concat(CASE WHEN k % 2 = 1 THEN ['sql_generation'] ELSE [] END,
                                                           CASE WHEN k % 5 = 0 THEN ['chart'] ELSE [] END)
       WHEN et = 'error' THEN ['error'] ELSE [] END AS new_steps,
  CASE WHEN et = 'view' AND k % 3 = 0 THEN 'response' WHEN et = 'view' AND k % 3 = 1 THEN 'thinking'
       WHEN et = 'purchase' AND k % 3 = 2 THEN 'chart' END AS once
  FROM m),
f AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '' AS t, '' AS sql, '' AS chart, CAST([] AS VARCHAR[]) AS steps
  FROM (SELECT DISTINCT conv_id FROM e)
  UNION ALL
  SELECT f.conv_id, e.i,
    f.t || CASE WHEN added IS NOT NULL THEN added WHEN if_empty IS NOT NULL AND f.t = '' THEN if_empty
                WHEN if_unsaid IS NOT NULL AND NOT contains(f.t, if_unsaid) THEN if_unsaid ELSE '' END,
    COALESCE(new_sql, f.sql), COALESCE(new_chart, f.chart),
    list_concat(f.steps, CASE WHEN once IS NOT NULL AND NOT list_contains(f.steps, once) THEN [once] ELSE new_steps END)
  FROM f JOIN e ON e.conv_id = f.conv_id AND e.i = f.i + 1),
n AS (SELECT conv_id, COUNT(*) AS n_events FROM e GROUP BY conv_id)
SELECT f.conv_id, regexp_replace(t, '!\[.*?\]\(data:image/png;base64,.*?\)', '[Grafico visualizzato sopra]', 'g') AS text,
       sql, chart AS chart_spec,
       array_to_string(CASE WHEN sql <> '' THEN list_append(steps, 'sql_execution') ELSE steps END, ',') AS steps, n_events
FROM f JOIN n ON n.conv_id = f.conv_id AND n.n_events = f.i""")
def c2(spark, d):
    """Fold an event log per conversation (all eleven kinds, last SQL and chart, ordered steps)."""
    return C.fold_events(event_log(spark, d), "conv_id", ["ts", "event_id"], "event", "data")


def _series_sql(base: str, order: str, x: str, series: list[str], kind: str) -> str:
    top = f"top AS (SELECT *, row_number() OVER (ORDER BY {order}) AS row_no FROM ({base}) ORDER BY {order})"
    parts = [f"SELECT '{kind}' AS chart, row_no, CAST({x} AS VARCHAR) AS x, '{s}' AS series, "
             f"CAST({s} AS DOUBLE) AS value FROM top" for s in series]
    return f"WITH {top}\n" + "\nUNION ALL\n".join(parts)


Q15_BASE = f"""
SELECT segment, CAST(SUM(rc) AS DOUBLE) / COUNT(rc) / 100 AS avg_monthly_bill, COUNT(*) AS n_customer_months
FROM (SELECT c.c_mktsegment AS segment, c.c_custkey, {MONTH.format(c='o.o_orderdate')} AS m,
             SUM({CENTS.format(c='o.o_totalprice')}) AS rc
      FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
      WHERE {MONTH.format(c='o.o_orderdate')} >=
            (SELECT CAST(date_trunc('month', max(o_orderdate)) - INTERVAL 5 MONTH AS DATE) FROM orders)
      GROUP BY 1, 2, 3) GROUP BY segment"""


@register("q15_c3_bars_monthly_bill", _series_sql(Q15_BASE, "segment", "segment",
                                                  ["avg_monthly_bill", "n_customer_months"], "grouped_bar"))
def q15(spark, d):
    """Bars of the mean monthly bill per customer type over the last 6 months."""
    t = Tables(spark, d)
    start = add_months(_latest_month(t.orders, "o_orderdate"), -5)
    cm = build_model(spark, d).query(["revenue_cents"], ["segment", "customer_id", "supply_month"],
                                     where=F.col("supply_month") >= start, where_dims=["supply_month"],
                                     scan={"supplies": in_months("o_orderdate", start)})
    base = cm.groupBy("segment").agg(
        (F.sum("revenue_cents").cast("double") / F.count("revenue_cents") / 100).alias("avg_monthly_bill"),
        F.count(F.lit(1)).alias("n_customer_months"))
    return C.chart_series(base, ["segment"]).withColumn("row_no", F.col("row_no").cast("long"))


Q16_BASE = """
SELECT c_mktsegment AS segment, COUNT(*) AS n_customers, COUNT(*) / SUM(COUNT(*)) OVER () AS share
FROM customer GROUP BY 1"""


@register("q16_c3_pie_segments", _series_sql(Q16_BASE, "segment", "segment", ["n_customers", "share"],
                                             "grouped_bar"))
def q16(spark, d):
    """Customers per segment with shares (pie data)."""
    g = build_model(spark, d).query(["n_customers"], ["segment"])
    return C.chart_series(share_of_total(g, "n_customers"), ["segment"]).withColumn(
        "row_no", F.col("row_no").cast("long"))


Q17_BASE = f"""
SELECT {MONTH.format(c='l.l_shipdate')} AS reading_month, p.p_type AS plant_type,
       CAST(SUM(l.l_quantity) AS DOUBLE) AS total_production
FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2"""


@register("q17_c3_production_trend", _series_sql(Q17_BASE, "reading_month, plant_type", "reading_month",
                                                 ["total_production"], "hbar"))
def q17(spark, d):
    """Monthly production per plant type; every (month, type) row."""
    g = build_model(spark, d).query(["total_production"], ["reading_month", "plant_type"])
    return C.chart_series(g, ["reading_month", "plant_type"]).withColumn("row_no", F.col("row_no").cast("long"))
