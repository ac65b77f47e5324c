"""The domain's own questions (Q1-Q11, Q13-Q24) on the domain model over the generated
domain tables. Each oracle rebuilds the five tables from the generators' SQL and asks the same
question in plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltaic.operators.relational import share_of_total
from voltaic.plans.domain_model import DIMENSIONS, FACTS, build_domain_model
from voltaic.plans.generated import G1_SQL, G2_SQL, G4_SQL, PRODUCTION_GRID_SQL, _draw
from voltaic.plans.registry import register
from voltaic.sources import generate as G
from voltaic.sources.tables import Tables

_KIND = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in G.PLANT_KIND_BY_TYPE.items()) + " END"
PLANTS_SQL = f"""
SELECT p_partkey AS plant_id, p_name AS name, {_KIND} AS kind, CAST(p_size AS BIGINT) AS capacity_mw,
       CASE WHEN p_partkey % 5 = 0 THEN 'MANUTENZIONE' ELSE 'OPERATIVO' END AS state,
       {_draw('p_partkey', 13, 2000, 9500)} / 100.0::DOUBLE AS efficiency_pct
FROM part"""

DOMAIN = f"""WITH CLIENTI AS ({G1_SQL}),
CONSUMI_ENERGIA AS ({G2_SQL}),
FEEDBACK_CLIENTI AS ({G4_SQL}),
IMPIANTI AS ({PLANTS_SQL}),
PRODUZIONE_ENERGIA AS ({PRODUCTION_GRID_SQL})"""
C = "CAST(ROUND({c} * 100) AS BIGINT)"


def model(spark, d):
    return build_domain_model(spark, d)


@register("q1_domain_active_by_contract", f"""{DOMAIN}
SELECT contract_type AS TIPO_CONTRATTO, COUNT(customer_id) AS NUMERO_CLIENTI
FROM CLIENTI WHERE contract_state = 'ATTIVO' GROUP BY 1""")
def q1d(spark, d):
    """Q1 on the domain tables: active customers per contract type."""
    return model(spark, d).query(["NUMERO_CLIENTI"], ["TIPO_CONTRATTO"], where="STATO_CONTRATTO = 'ATTIVO'")


@register("q2_domain_by_city_segment", f"""{DOMAIN}
SELECT city AS CITTA, segment AS SEGMENTO, COUNT(customer_id) AS NUMERO_CLIENTI FROM CLIENTI GROUP BY 1, 2""")
def q2d(spark, d):
    """Q2 on the domain tables: customers by city and segment."""
    return model(spark, d).query(["NUMERO_CLIENTI"], ["CITTA", "SEGMENTO"])


@register("q3_domain_premium_in_milano", f"""{DOMAIN}
SELECT COUNT(customer_id) AS NUMERO_CLIENTI FROM CLIENTI WHERE segment = 'PREMIUM' AND city = 'Milano'""")
def q3d(spark, d):
    """Q3 on the domain tables: PREMIUM customers in Milano."""
    return model(spark, d).query(["NUMERO_CLIENTI"], where="SEGMENTO = 'PREMIUM' AND CITTA = 'Milano'")


@register("q4_domain_mean_kwh_by_type", f"""{DOMAIN}
SELECT c.customer_type AS TIPO_CLIENTE,
       CAST(SUM({C.format(c='e.kwh')}) AS DOUBLE) / COUNT(e.kwh) / 100 AS CONSUMO_MEDIO_KWH
FROM CONSUMI_ENERGIA e LEFT JOIN CLIENTI c ON e.customer_id = c.customer_id GROUP BY 1""")
def q4d(spark, d):
    """Q4 on the domain tables: mean monthly kWh per customer type (one row per customer-month)."""
    return model(spark, d).query(["CONSUMO_MEDIO_KWH"], ["TIPO_CLIENTE"])


@register("q5_domain_cost_last_6_months", f"""{DOMAIN}
SELECT month AS MESE, CAST(SUM({C.format(c='total_cost')}) AS DOUBLE) / 100 AS FATTURATO_TOTALE
FROM CONSUMI_ENERGIA
WHERE month >= (SELECT CAST(date_trunc('month', max(o_orderdate)) - INTERVAL 5 MONTH AS DATE) FROM orders)
GROUP BY 1""")
def q5d(spark, d):
    """Q5 on the domain tables: total cost per month, last 6 months (as_of from the data)."""
    t = Tables(spark, d)
    start = F.add_months(t.orders.select(F.trunc(F.max("o_orderdate").cast("date"), "MM")).scalar(), -5)
    return model(spark, d).query(["FATTURATO_TOTALE"], ["MESE"], where=F.col("MESE") >= start, where_dims=["MESE"])


@register("q6_domain_top10_last_month", f"""{DOMAIN}
SELECT c.customer_id AS CLIENTE_ID, c.last_name AS COGNOME,
       CAST(SUM({C.format(c='e.kwh')}) AS DOUBLE) / 100 AS CONSUMO_TOTALE_KWH
FROM CONSUMI_ENERGIA e LEFT JOIN CLIENTI c ON e.customer_id = c.customer_id
WHERE e.month = (SELECT CAST(date_trunc('month', max(o_orderdate)) AS DATE) FROM orders)
GROUP BY 1, 2 ORDER BY CONSUMO_TOTALE_KWH DESC, CLIENTE_ID LIMIT 10""")
def q6d(spark, d):
    """Q6 on the domain tables: the 10 customers with the highest consumption in the latest month."""
    t = Tables(spark, d)
    last = t.orders.select(F.trunc(F.max("o_orderdate").cast("date"), "MM")).scalar()
    return model(spark, d).query(["CONSUMO_TOTALE_KWH"], ["CLIENTE_ID", "COGNOME"], where=F.col("MESE") == last,
                                 where_dims=["MESE"], order_by=[F.desc("CONSUMO_TOTALE_KWH"), F.asc("CLIENTE_ID")],
                                 limit=10)


@register("q7_domain_capacity_by_type", f"""{DOMAIN}
SELECT kind AS TIPO, CAST(SUM(capacity_mw) AS BIGINT) AS CAPACITA_TOTALE_MW, COUNT(plant_id) AS NUMERO_IMPIANTI
FROM IMPIANTI GROUP BY 1""")
def q7d(spark, d):
    """Q7 on the domain tables: installed capacity and plant count per plant type."""
    return model(spark, d).query(["CAPACITA_TOTALE_MW", "NUMERO_IMPIANTI"], ["TIPO"])


@register("q8_domain_efficiency_by_type", f"""{DOMAIN}
SELECT kind AS TIPO, CAST(SUM({C.format(c='efficiency_pct')}) AS DOUBLE) / COUNT(efficiency_pct) / 100 AS EFFICIENZA_MEDIA
FROM IMPIANTI GROUP BY 1""")
def q8d(spark, d):
    """Q8 on the domain tables: mean efficiency per plant type."""
    return model(spark, d).query(["EFFICIENZA_MEDIA"], ["TIPO"])


@register("q9_domain_energy_previous_month", f"""{DOMAIN}
SELECT plant_id AS IMPIANTO_ID, CAST(SUM(energy_cents) AS DOUBLE) / 100 AS PRODUZIONE_TOTALE_MWH
FROM PRODUZIONE_ENERGIA
WHERE CAST(date_trunc('month', day) AS DATE) =
      (SELECT CAST(date_trunc('month', max(l_shipdate)) - INTERVAL 1 MONTH AS DATE) FROM lineitem)
GROUP BY 1""")
def q9d(spark, d):
    """Q9 on the domain tables: energy per plant in the month before the latest."""
    t = Tables(spark, d)
    prev = F.add_months(t.lineitem.select(F.trunc(F.max("l_shipdate").cast("date"), "MM")).scalar(), -1)
    return model(spark, d).query(["PRODUZIONE_TOTALE_MWH"], ["IMPIANTO_ID"], where=F.col("MESE_PRODUZIONE") == prev,
                                 where_dims=["MESE_PRODUZIONE"])


@register("q10_domain_open_tickets_by_category", f"""{DOMAIN}
SELECT category AS CATEGORIA, COUNT(ticket_id) AS NUMERO_TICKET FROM FEEDBACK_CLIENTI WHERE state = 'APERTO' GROUP BY 1""")
def q10d(spark, d):
    """Q10 on the domain tables: open tickets per category."""
    return model(spark, d).query(["NUMERO_TICKET"], ["CATEGORIA"], where="STATO_TICKET = 'APERTO'")


@register("q11_domain_resolution_by_priority", f"""{DOMAIN}
SELECT priority AS PRIORITA,
       CAST(SUM({C.format(c='resolution_hours')}) AS DOUBLE) / COUNT(resolution_hours) / 100 AS TEMPO_MEDIO_RISOLUZIONE
FROM FEEDBACK_CLIENTI GROUP BY 1""")
def q11d(spark, d):
    """Q11 on the domain tables: mean resolution time per priority."""
    return model(spark, d).query(["TEMPO_MEDIO_RISOLUZIONE"], ["PRIORITA"])


@register("q14_domain_billing_complaint_share", f"""{DOMAIN}
SELECT category AS CATEGORIA, COUNT(ticket_id) AS NUMERO_TICKET,
       COUNT(ticket_id) / SUM(COUNT(ticket_id)) OVER () AS share
FROM FEEDBACK_CLIENTI GROUP BY 1""")
def q14d(spark, d):
    """Q14 (data part) on the domain tables: ticket share per category (billing among them)."""
    return share_of_total(model(spark, d).query(["NUMERO_TICKET"], ["CATEGORIA"]), "NUMERO_TICKET")


@register("q16_domain_customers_by_segment", f"""{DOMAIN}
SELECT segment AS SEGMENTO, COUNT(customer_id) AS NUMERO_CLIENTI,
       COUNT(customer_id) / SUM(COUNT(customer_id)) OVER () AS share
FROM CLIENTI GROUP BY 1""")
def q16d(spark, d):
    """Q16 on the domain tables: customers per segment with shares (pie data)."""
    return share_of_total(model(spark, d).query(["NUMERO_CLIENTI"], ["SEGMENTO"]), "NUMERO_CLIENTI")


@register("q21_domain_production_margin_by_type", f"""{DOMAIN}
SELECT i.kind AS TIPO, CAST(SUM(p.energy_cents) AS DOUBLE) / 100 AS PRODUZIONE_TOTALE_MWH,
       CAST(SUM(p.energy_cents * {C.format(c='p.price_mwh')}) AS DOUBLE) / 10000
       - CAST(SUM({C.format(c='p.production_cost')}) AS DOUBLE) / 100 AS MARGINE_PRODUZIONE
FROM PRODUZIONE_ENERGIA p LEFT JOIN IMPIANTI i ON p.plant_id = i.plant_id GROUP BY 1""")
def q21d(spark, d):
    """Q21 on the domain tables: production and margin (revenue - production cost) per plant type."""
    return model(spark, d).query(["PRODUZIONE_TOTALE_MWH", "MARGINE_PRODUZIONE"], ["TIPO"])


@register("q22_domain_customers_by_type", f"""{DOMAIN}
SELECT customer_type AS TIPO_CLIENTE, COUNT(customer_id) AS NUMERO_CLIENTI FROM CLIENTI GROUP BY 1""")
def q22d(spark, d):
    """Q22 on the domain tables: customers per type."""
    return model(spark, d).query(["NUMERO_CLIENTI"], ["TIPO_CLIENTE"])


def _series(base, order, x, series, kind):
    from voltaic.plans.conversation import _series_sql
    return DOMAIN + ",\n" + _series_sql(base, order, x, series, kind)[len("WITH "):]


@register("q15_domain_bars_mean_kwh", _series(f"""
SELECT c.customer_type AS TIPO_CLIENTE, CAST(SUM({C.format(c='e.kwh')}) AS DOUBLE) / COUNT(e.kwh) / 100 AS CONSUMO_MEDIO_KWH
FROM CONSUMI_ENERGIA e LEFT JOIN CLIENTI c ON e.customer_id = c.customer_id
WHERE e.month >= (SELECT CAST(date_trunc('month', max(o_orderdate)) - INTERVAL 5 MONTH AS DATE) FROM orders)
GROUP BY 1""", "TIPO_CLIENTE", "TIPO_CLIENTE", ["CONSUMO_MEDIO_KWH"], "hbar"))
def q15d(spark, d):
    """Q15 on the domain tables: bars of mean monthly kWh per customer type, last 6 months."""
    from voltaic.operators.conversation import chart_series
    t = Tables(spark, d)
    start = F.add_months(t.orders.select(F.trunc(F.max("o_orderdate").cast("date"), "MM")).scalar(), -5)
    g = model(spark, d).query(["CONSUMO_MEDIO_KWH"], ["TIPO_CLIENTE"], where=F.col("MESE") >= start, where_dims=["MESE"])
    return chart_series(g, ["TIPO_CLIENTE"]).withColumn("row_no", F.col("row_no").cast("long"))


@register("q17_domain_production_trend", _series(f"""
SELECT CAST(date_trunc('month', p.day) AS DATE) AS MESE_PRODUZIONE, i.kind AS TIPO,
       CAST(SUM(p.energy_cents) AS DOUBLE) / 100 AS PRODUZIONE_TOTALE_MWH
FROM PRODUZIONE_ENERGIA p LEFT JOIN IMPIANTI i ON p.plant_id = i.plant_id GROUP BY 1, 2""",
    "MESE_PRODUZIONE, TIPO", "MESE_PRODUZIONE", ["PRODUZIONE_TOTALE_MWH"], "hbar"))
def q17d(spark, d):
    """Q17 on the domain tables: monthly production per plant type, first 50 rows as series."""
    from voltaic.operators.conversation import chart_series
    g = model(spark, d).query(["PRODUZIONE_TOTALE_MWH"], ["MESE_PRODUZIONE", "TIPO"])
    return chart_series(g, ["MESE_PRODUZIONE", "TIPO"]).withColumn("row_no", F.col("row_no").cast("long"))


@register("q18_domain_customers_by_type_province", f"""{DOMAIN}
SELECT customer_type AS TIPO_CLIENTE, province AS PROVINCIA, COUNT(customer_id) AS NUMERO_CLIENTI FROM CLIENTI GROUP BY 1, 2""")
def q18d(spark, d):
    """Q18 on the domain tables: customers by type and province."""
    return model(spark, d).query(["NUMERO_CLIENTI"], ["TIPO_CLIENTE", "PROVINCIA"])


@register("q19_domain_top5_cities_energy", f"""{DOMAIN}
SELECT c.city AS CITTA, CAST(SUM({C.format(c='e.kwh')}) AS DOUBLE) / 100 AS CONSUMO_TOTALE_KWH
FROM CONSUMI_ENERGIA e LEFT JOIN CLIENTI c ON e.customer_id = c.customer_id
GROUP BY 1 ORDER BY CONSUMO_TOTALE_KWH DESC, CITTA LIMIT 5""")
def q19d(spark, d):
    """Q19 on the domain tables: the 5 cities with the most energy consumed."""
    return model(spark, d).query(["CONSUMO_TOTALE_KWH"], ["CITTA"],
                                 order_by=[F.desc("CONSUMO_TOTALE_KWH"), F.asc("CITTA")], limit=5)


@register("q20_domain_mean_bill_by_segment", f"""{DOMAIN}
SELECT c.segment AS SEGMENTO,
       CAST(SUM({C.format(c='e.total_cost')}) AS DOUBLE) / COUNT(e.total_cost) / 100 AS COSTO_MEDIO_BOLLETTA
FROM CONSUMI_ENERGIA e LEFT JOIN CLIENTI c ON e.customer_id = c.customer_id GROUP BY 1""")
def q20d(spark, d):
    """Q20 on the domain tables: mean bill per customer segment."""
    return model(spark, d).query(["COSTO_MEDIO_BOLLETTA"], ["SEGMENTO"])


@register("q23_domain_kpi_last_3_months", f"""{DOMAIN}
SELECT ROUND(CAST(SUM({C.format(c='kwh')}) AS DOUBLE) / 100, 0) AS TOT_KWH,
       ROUND(CAST(SUM({C.format(c='smc')}) AS DOUBLE) / 100, 0) AS TOT_SMC,
       ROUND(CAST(SUM({C.format(c='total_cost')}) AS DOUBLE) / 100, 0) AS TOT_COSTO,
       ((2 * SUM({C.format(c='total_cost')}) + COUNT(total_cost)) // (2 * COUNT(total_cost))) / 100.0::DOUBLE AS AVG_COSTO,
       COUNT(DISTINCT customer_id) AS NUM_CLIENTI
FROM CONSUMI_ENERGIA
WHERE month >= (SELECT CAST(date_trunc('month', max(o_orderdate)) - INTERVAL 3 MONTH AS DATE) FROM orders)""")
def q23d(spark, d):
    """Q23 on the domain tables: the KPI row of the last 3 months (``>= trunc(as_of) - 3 months``)."""
    t = Tables(spark, d)
    start = F.add_months(t.orders.select(F.trunc(F.max("o_orderdate").cast("date"), "MM")).scalar(), -3)
    k = model(spark, d).query(["CONSUMO_TOTALE_KWH", "CONSUMO_TOTALE_SMC", "FATTURATO_TOTALE",
                               "COSTO_MEDIO_CENTESIMI", "CLIENTI_ATTIVI"],
                              where=F.col("MESE") >= start, where_dims=["MESE"])
    return k.select(F.round("CONSUMO_TOTALE_KWH", 0).alias("TOT_KWH"), F.round("CONSUMO_TOTALE_SMC", 0).alias("TOT_SMC"),
                    F.round("FATTURATO_TOTALE", 0).alias("TOT_COSTO"), (F.col("COSTO_MEDIO_CENTESIMI") / 100.0).alias("AVG_COSTO"),
                    F.col("CLIENTI_ATTIVI").alias("NUM_CLIENTI"))


# Our own wording of the document halves of the two mixed questions.
SUSPENSION_Q = [(1, "In quali casi la fornitura viene interrotta per un periodo?")]
COMPLAINT_Q = [(1, "Che passi seguono quando un importo della bolletta viene contestato?")]


def _mixed_sql(question, data_col_sql: str, alias: str) -> str:
    from voltaic.plans.search import bm25_sql
    from voltaic.plans.text import _sql_values
    q = f"queries(query_id, query) AS (VALUES {_sql_values(question)})"
    return f"""{DOMAIN},{bm25_sql(q, 3)}
SELECT rank, doc_id, chunk_id, score, ({data_col_sql}) AS {alias} FROM top WHERE rank <= 3"""


@register("q13_domain_suspended_and_clause", _mixed_sql(
    SUSPENSION_Q, "SELECT COUNT(customer_id) FROM CLIENTI WHERE contract_state = 'SOSPESO'", "NUMERO_CLIENTI_SOSPESI"))
def q13d(spark, d):
    """Q13 on the domain tables (R7): suspended customers next to the top 3 clauses on suspension."""
    from voltaic.plans.search import _search
    q = spark.createDataFrame(SUSPENSION_Q, "query_id int, query string")
    res = _search(spark, d, q, 3)
    n = model(spark, d).query(["NUMERO_CLIENTI"], where="STATO_CONTRATTO = 'SOSPESO'")
    return res.select("rank", "doc_id", "chunk_id", "score", n.scalar().alias("NUMERO_CLIENTI_SOSPESI"))


@register("q14_domain_billing_share_and_clause", _mixed_sql(
    COMPLAINT_Q, "SELECT SUM(CASE WHEN category = 'FATTURAZIONE' THEN 1 ELSE 0 END) / COUNT(*) FROM FEEDBACK_CLIENTI",
    "QUOTA_RECLAMI_FATTURAZIONE"))
def q14d_mixed(spark, d):
    """Q14 on the domain tables (A12, R7): share of billing tickets next to the top 3 complaint clauses."""
    from voltaic.plans.search import _search
    q = spark.createDataFrame(COMPLAINT_Q, "query_id int, query string")
    res = _search(spark, d, q, 3)
    tk = G.tickets(Tables(spark, d).events)
    share = tk.select(F.count_if(F.col("category") == "FATTURAZIONE") / F.count(F.lit(1))).scalar()
    return res.select("rank", "doc_id", "chunk_id", "score", share.alias("QUOTA_RECLAMI_FATTURAZIONE"))


def _own_key_sql(table: str) -> str:
    """Every dimension and fact of a domain table, one row per key."""
    def values(i, t):
        return "[" + ", ".join(f"{t} '" + str(r[i]).replace("'", "''") + "'" for r in G.PLANTS) + f"][CAST(plant_id % {len(G.PLANTS)} AS INTEGER) + 1]"
    special = {"consumption_id": "customer_id * 100000 + year(month) * 12 + month(month)",
               "production_id": "plant_id * 1000000 + date_diff('day', DATE '1970-01-01', day)",
               "town": values(2, ""), "region": values(3, ""), "in_service": values(6, "DATE"),
               "co2_tons": f"CAST({values(8, '')} AS BIGINT)"}
    dims = [f"{special.get(c, c)} AS {n}" for n, c, _ in DIMENSIONS[table]]
    facts = [f"CAST({C.format(c=special.get(c, c))} AS DOUBLE) / 100 AS SOMMA_{n}" for n, c in FACTS[table]]
    return f"{DOMAIN}\nSELECT " + ", ".join(dims + facts) + f"\nFROM {table}"


def _own_key(table: str):
    def run(spark, d):
        return model(spark, d).query([f"SOMMA_{n}" for n, _ in FACTS[table]], [n for n, _, _ in DIMENSIONS[table]])
    run.__doc__ = f"M3, M4: all facts and dimensions of {table}, at the table's own key."
    return run


for _t in FACTS:
    register(f"m3_m4_domain_{_t.lower()}", _own_key_sql(_t))(_own_key(_t))


@register("t9_domain_kpi_report_prompt", f"""{DOMAIN},
k AS (SELECT CAST(ROUND(CAST(SUM({C.format(c='kwh')}) AS DOUBLE) / 100, 0) AS BIGINT) AS kwh,
             CAST(ROUND(CAST(SUM({C.format(c='smc')}) AS DOUBLE) / 100, 0) AS BIGINT) AS smc,
             CAST(ROUND(CAST(SUM({C.format(c='total_cost')}) AS DOUBLE) / 100, 0) AS BIGINT) AS tot,
             (2 * SUM({C.format(c='total_cost')}) + COUNT(total_cost)) // (2 * COUNT(total_cost)) AS mean,
             COUNT(DISTINCT customer_id) AS n
      FROM CONSUMI_ENERGIA
      WHERE month >= (SELECT CAST(date_trunc('month', max(o_orderdate)) - INTERVAL 3 MONTH AS DATE) FROM orders))
SELECT 'Riassumi gli ultimi 3 mesi in 200 parole al massimo. Elettricità: ' || kwh || ' kWh; gas: ' || smc || ' smc; spesa: '
       || tot || ' EUR; spesa media: ' || (mean // 100) || '.' || lpad(CAST(mean % 100 AS VARCHAR), 2, '0')
       || ' EUR; clienti: ' || n || '. Spiega andamento e consigli.' AS prompt
FROM k""")
def t9d(spark, d):
    """T9 on the domain tables: the five KPI numbers of the last 3 months in one report prompt (our own words)."""
    t = Tables(spark, d)
    start = F.add_months(t.orders.select(F.trunc(F.max("o_orderdate").cast("date"), "MM")).scalar(), -3)
    k = model(spark, d).query(["CONSUMO_TOTALE_KWH", "CONSUMO_TOTALE_SMC", "FATTURATO_TOTALE",
                               "COSTO_MEDIO_CENTESIMI", "CLIENTI_ATTIVI"],
                              where=F.col("MESE") >= start, where_dims=["MESE"])
    whole = lambda c: F.round(c, 0).cast("long").cast("string")
    mean = F.col("COSTO_MEDIO_CENTESIMI").cast("long")
    return k.select(F.concat(
        F.lit("Riassumi gli ultimi 3 mesi in 200 parole al massimo. Elettricità: "), whole("CONSUMO_TOTALE_KWH"),
        F.lit(" kWh; gas: "), whole("CONSUMO_TOTALE_SMC"), F.lit(" smc; spesa: "), whole("FATTURATO_TOTALE"),
        F.lit(" EUR; spesa media: "), F.floor(mean / 100).cast("string"), F.lit("."),
        F.lpad(F.pmod(mean, F.lit(100)).cast("string"), 2, "0"), F.lit(" EUR; clienti: "),
        F.col("CLIENTI_ATTIVI").cast("string"), F.lit(". Spiega andamento e consigli.")).alias("prompt"))


_DOMAIN_TABLES = ["CLIENTI", "CONSUMI_ENERGIA", "FEEDBACK_CLIENTI", "IMPIANTI", "PRODUZIONE_ENERGIA"]


@register("q24_domain_row_counts", f"""{DOMAIN}
""" + "\nUNION ALL\n".join(f"SELECT '{t}' AS TABELLA, COUNT(*) AS RECORD FROM {t}" for t in _DOMAIN_TABLES))
def q24d(spark, d):
    """Q24 / U1 on the domain tables: row count of each generated domain table (the load check)."""
    from voltaic.plans.domain_model import domain_tables
    tb = domain_tables(spark, d)
    parts = [tb[t]().agg(F.count(F.lit(1)).alias("RECORD")).select(F.lit(t).alias("TABELLA"), "RECORD")
             for t in _DOMAIN_TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
