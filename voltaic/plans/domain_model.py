"""The domain's own semantic model, bound to the domain tables generated from the driver's tables.

Tables (all derived from the given data, so they grow with it):
customers (G1, from customer keys), monthly consumption (G2+G3), tickets (G4, from events), plants
(from parts) and daily production (G5, from parts). Table, dimension and metric names are the
domain's (fixed values). Money and quantities are summed as integer cents, as in the utility model.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from voltaic.plans.metrics import SemanticModel
from voltaic.sources import generate as G
from voltaic.sources.tables import Tables

# CAST(ROUND({c} * 100) AS BIGINT) of a double: RINT rounds halves to even, put right where that went towards zero (ROUND
# goes through a decimal string, which costs more than all else a row needs)
C = ("CAST(RINT({c} * 100) + CASE WHEN {c} > 0 AND {c} * 100 - RINT({c} * 100) = 0.5D THEN 1 "
     "WHEN {c} < 0 AND {c} * 100 - RINT({c} * 100) = -0.5D THEN -1 ELSE 0 END AS BIGINT)")
WHOLE = {"capacity_mw", "co2_tons"}     # integer columns


# The domain's 16 facts by table, with the column behind each.
FACTS = {
    "CLIENTI": [("POTENZA_IMPEGNATA_KW", "power_kw")],
    "CONSUMI_ENERGIA": [("CONSUMO_KWH", "kwh"), ("CONSUMO_SMC", "smc"), ("COSTO_ENERGIA_EUR", "energy_cost"),
                        ("COSTO_TRASPORTO_EUR", "transport_cost"), ("COSTO_ONERI_EUR", "charges"),
                        ("COSTO_TOTALE_EUR", "total_cost")],
    "FEEDBACK_CLIENTI": [("TEMPO_RISOLUZIONE_ORE", "resolution_hours")],
    "IMPIANTI": [("CAPACITA_MW", "capacity_mw"), ("EFFICIENZA_PERCENTUALE", "efficiency_pct"),
                 ("EMISSIONI_CO2_TON", "co2_tons")],
    "PRODUZIONE_ENERGIA": [("ENERGIA_PRODOTTA_MWH", "energy_mwh"), ("ORE_FUNZIONAMENTO", "hours"),
                           ("DISPONIBILITA_PERCENTUALE", "availability"), ("COSTO_PRODUZIONE_EUR", "production_cost"),
                           ("PREZZO_VENDITA_MWH_EUR", "price_mwh")],
}
# The domain's 38 dimensions by table, with the column behind each and further names.
DIMENSIONS = {
    "CLIENTI": [
        ("CLIENTE_ID", "customer_id", []), ("NOME", "first_name", ["nome cliente"]), ("COGNOME", "last_name", []),
        ("CODICE_FISCALE", "fiscal_code", ["codice fiscale"]), ("EMAIL", "email", []), ("TELEFONO", "phone", []),
        ("INDIRIZZO", "address", []), ("CITTA", "city", ["città", "comune"]), ("PROVINCIA", "province", []),
        ("CAP", "cap", ["codice postale"]), ("TIPO_CLIENTE", "customer_type", []), ("TIPO_CONTRATTO", "contract_type", []),
        ("STATO_CONTRATTO", "contract_state", []), ("SEGMENTO", "segment", ["segmento"]),
        ("DATA_ATTIVAZIONE", "activation_date", ["data contratto"])],
    "CONSUMI_ENERGIA": [
        ("CONSUMO_ID", "consumption_id", []), ("MESE", "month", ["mese"]), ("FASCIA_ORARIA", "time_band", []),
        ("FONTE_ENERGIA", "energy_source", ["fonte"]), ("POD", "pod", ["punto di prelievo"]),
        ("PDR", "pdr", ["punto di riconsegna"])],
    "FEEDBACK_CLIENTI": [
        ("FEEDBACK_ID", "ticket_id", []), ("DATA_FEEDBACK", "created_at", ["data ticket"]), ("CANALE", "channel", []),
        ("CATEGORIA", "category", []), ("TESTO_FEEDBACK", "text", ["testo"]), ("PRIORITA", "priority", ["priorità"]),
        ("STATO_TICKET", "state", []), ("OPERATORE", "operator", ["agente"])],
    "IMPIANTI": [
        ("IMPIANTO_ID", "plant_id", []), ("NOME_IMPIANTO", "name", ["nome centrale"]), ("TIPO", "kind", ["tipo impianto"]),
        ("LOCALITA", "town", ["ubicazione"]), ("REGIONE", "region", []), ("STATO_IMPIANTO", "state", []),
        ("DATA_ENTRATA_SERVIZIO", "in_service", ["data avvio"])],
    "PRODUZIONE_ENERGIA": [("PRODUZIONE_ID", "production_id", []), ("DATA_PRODUZIONE", "day", ["giorno produzione"])],
}


def _sum(f):
    return dict(parts=[("wsum", f)], final="CAST({0} AS DOUBLE) / 100")


def _avg(f):
    return dict(parts=[("wsum", f), ("count", f)], final="CAST({0} AS DOUBLE) / {1} / 100")


def domain_tables(spark: SparkSession, sf_dir: str) -> dict:
    t = Tables(spark, sf_dir)
    as_of = t.orders.select(F.max("o_orderdate").cast("date")).scalar()
    prod_as_of = t.lineitem.select(F.max("l_shipdate").cast("date")).scalar()
    cust = G.customers(t.customer, "c_custkey", as_of)
    return {
        "CLIENTI": lambda: cust,
        # a row's own key as one number (customer and month; plant and day)
        "CONSUMI_ENERGIA": lambda: G.consumption(cust, as_of, 12).withColumn(
            "consumption_id", F.expr("customer_id * 100000 + year(month) * 12 + month(month)")),
        "FEEDBACK_CLIENTI": lambda: G.tickets(t.events),
        "IMPIANTI": lambda: G.plants(t.part).select("*", *[
            G.pick([r[i] for r in G.PLANTS], F.col("plant_id")).alias(c)
            for i, c in ((2, "town"), (3, "region"), (8, "co2_tons"))],
            G.pick([r[6] for r in G.PLANTS], F.col("plant_id")).cast("date").alias("in_service")),
        "PRODUZIONE_ENERGIA": lambda: G.production(t.part, prod_as_of, 365).withColumn(
            "production_id", F.expr("plant_id * 1000000 + datediff(day, DATE'1970-01-01')")),
    }


def build_domain_model(spark: SparkSession, sf_dir: str) -> SemanticModel:
    tb = domain_tables(spark, sf_dir)
    m = SemanticModel("domain_model", "customers, consumption, feedback, plants and production")
    m.table("CLIENTI", tb["CLIENTI"], ["customer_id"], ["clienti", "customers"])
    m.table("CONSUMI_ENERGIA", tb["CONSUMI_ENERGIA"], ["customer_id", "month"], ["consumi", "bollette"],
            row_dims=["CONSUMO_ID", "MESE"])
    m.table("FEEDBACK_CLIENTI", tb["FEEDBACK_CLIENTI"], ["ticket_id"], ["feedback", "ticket", "reclami"])
    m.table("IMPIANTI", tb["IMPIANTI"], ["plant_id"], ["impianti", "centrali"])
    m.table("PRODUZIONE_ENERGIA", tb["PRODUZIONE_ENERGIA"], ["plant_id", "day"], ["produzione"],
            row_dims=["PRODUZIONE_ID", "DATA_PRODUZIONE"])
    m.relate("CONSUMI_CLIENTI", "CONSUMI_ENERGIA", ["customer_id"], "CLIENTI", ["customer_id"])
    m.relate("FEEDBACK_CLIENTI_REL", "FEEDBACK_CLIENTI", ["customer_id"], "CLIENTI", ["customer_id"])
    m.relate("PRODUZIONE_IMPIANTI", "PRODUZIONE_ENERGIA", ["plant_id"], "IMPIANTI", ["plant_id"])

    m.fact("KWH_CENTS", "CONSUMI_ENERGIA", C.format(c="kwh"))
    m.fact("SMC_CENTS", "CONSUMI_ENERGIA", C.format(c="smc"))
    m.fact("COSTO_ENERGIA_CENTS", "CONSUMI_ENERGIA", C.format(c="energy_cost"))
    m.fact("COSTO_TOTALE_CENTS", "CONSUMI_ENERGIA", C.format(c="total_cost"))
    m.fact("ORE_RISOLUZIONE_CENTS", "FEEDBACK_CLIENTI", C.format(c="resolution_hours"))
    m.fact("ENERGIA_CENTS", "PRODUZIONE_ENERGIA", "energy_cents")
    m.fact("COSTO_PRODUZIONE_CENTS", "PRODUZIONE_ENERGIA", C.format(c="production_cost"))
    m.fact("RICAVO_CENTS2", "PRODUZIONE_ENERGIA", f"energy_cents * {C.format(c='price_mwh')}")
    m.fact("ORE_CENTS", "PRODUZIONE_ENERGIA", C.format(c="hours"))
    m.fact("DISPONIBILITA_CENTS", "PRODUZIONE_ENERGIA", C.format(c="availability"))
    m.fact("EFFICIENZA_CENTS", "IMPIANTI", C.format(c="efficiency_pct"))

    for table, facts in FACTS.items():
        for name, column in facts:
            m.fact(name, table, column)
            m.fact(f"{name}_CENTS", table, f"{column} * 100" if column in WHOLE else C.format(c=column))
            m.metric(f"SOMMA_{name}", table, f"CAST(SUM(CAST({name}_CENTS AS DECIMAL(38,0))) AS DOUBLE) / 100",
                     **_sum(f"{name}_CENTS"))
    for table, dimensions in DIMENSIONS.items():
        for name, column, syn in dimensions:
            m.dimension(name, table, column, syn)
    m.dimension("MESE_PRODUZIONE", "PRODUZIONE_ENERGIA", "trunc(day, 'MM')", ["data produzione"])

    # The domain's metric names.
    m.metric("CONSUMO_TOTALE_KWH", "CONSUMI_ENERGIA", "CAST(SUM(CAST(KWH_CENTS AS DECIMAL(38,0))) AS DOUBLE) / 100", **_sum("KWH_CENTS"))
    m.metric("CONSUMO_TOTALE_SMC", "CONSUMI_ENERGIA", "CAST(SUM(CAST(SMC_CENTS AS DECIMAL(38,0))) AS DOUBLE) / 100", **_sum("SMC_CENTS"))
    m.metric("FATTURATO_TOTALE", "CONSUMI_ENERGIA", "CAST(SUM(CAST(COSTO_TOTALE_CENTS AS DECIMAL(38,0))) AS DOUBLE) / 100",
             **_sum("COSTO_TOTALE_CENTS"))
    m.metric("COSTO_MEDIO_PER_KWH", "CONSUMI_ENERGIA",
             "CAST(SUM(CAST(COSTO_ENERGIA_CENTS AS DECIMAL(38,0))) AS DOUBLE) / NULLIF(SUM(CAST(KWH_CENTS AS DECIMAL(38,0))), 0)",
             parts=[("wsum", "COSTO_ENERGIA_CENTS"), ("wsum", "KWH_CENTS")], final="CAST({0} AS DOUBLE) / NULLIF({1}, 0)")
    m.metric("NUMERO_FORNITURE", "CONSUMI_ENERGIA", "COUNT(customer_id)",
             parts=[("count", "customer_id")], final="{0}")
    m.metric("CONSUMO_MEDIO_KWH", "CONSUMI_ENERGIA", "CAST(SUM(CAST(KWH_CENTS AS DECIMAL(38,0))) AS DOUBLE) / COUNT(KWH_CENTS) / 100",
             **_avg("KWH_CENTS"))
    m.metric("COSTO_MEDIO_BOLLETTA", "CONSUMI_ENERGIA",
             "CAST(SUM(CAST(COSTO_TOTALE_CENTS AS DECIMAL(38,0))) AS DOUBLE) / COUNT(COSTO_TOTALE_CENTS) / 100", **_avg("COSTO_TOTALE_CENTS"))
    m.metric("COSTO_MEDIO_CENTESIMI", "CONSUMI_ENERGIA",
             "(2 * SUM(CAST(COSTO_TOTALE_CENTS AS DECIMAL(38,0))) + COUNT(COSTO_TOTALE_CENTS)) DIV (2 * COUNT(COSTO_TOTALE_CENTS))",
             parts=[("wsum", "COSTO_TOTALE_CENTS"), ("count", "COSTO_TOTALE_CENTS")], final="(2 * {0} + {1}) DIV (2 * {1})")
    m.metric("CLIENTI_ATTIVI", "CONSUMI_ENERGIA", "COUNT(DISTINCT customer_id)")  # not decomposable: row plan
    m.metric("NUMERO_CLIENTI", "CLIENTI", "COUNT(customer_id)", parts=[("count", "customer_id")], final="{0}")
    m.metric("NUMERO_TICKET", "FEEDBACK_CLIENTI", "COUNT(ticket_id)", parts=[("count", "ticket_id")], final="{0}")
    m.metric("TEMPO_MEDIO_RISOLUZIONE", "FEEDBACK_CLIENTI",
             "CAST(SUM(CAST(ORE_RISOLUZIONE_CENTS AS DECIMAL(38,0))) AS DOUBLE) / COUNT(ORE_RISOLUZIONE_CENTS) / 100",
             **_avg("ORE_RISOLUZIONE_CENTS"))
    m.metric("PRODUZIONE_TOTALE_MWH", "PRODUZIONE_ENERGIA", "CAST(SUM(CAST(ENERGIA_CENTS AS DECIMAL(38,0))) AS DOUBLE) / 100",
             **_sum("ENERGIA_CENTS"))
    m.metric("COSTO_PRODUZIONE_TOTALE", "PRODUZIONE_ENERGIA", "CAST(SUM(CAST(COSTO_PRODUZIONE_CENTS AS DECIMAL(38,0))) AS DOUBLE) / 100",
             **_sum("COSTO_PRODUZIONE_CENTS"))
    m.metric("RICAVO_POTENZIALE", "PRODUZIONE_ENERGIA", "CAST(SUM(CAST(RICAVO_CENTS2 AS DECIMAL(38,0))) AS DOUBLE) / 10000",
             parts=[("wsum", "RICAVO_CENTS2")], final="CAST({0} AS DOUBLE) / 10000")
    m.metric("ORE_MEDIE_FUNZIONAMENTO", "PRODUZIONE_ENERGIA",
             "CAST(SUM(CAST(ORE_CENTS AS DECIMAL(38,0))) AS DOUBLE) / COUNT(ORE_CENTS) / 100", **_avg("ORE_CENTS"))
    m.metric("DISPONIBILITA_MEDIA", "PRODUZIONE_ENERGIA",
             "CAST(SUM(CAST(DISPONIBILITA_CENTS AS DECIMAL(38,0))) AS DOUBLE) / COUNT(DISPONIBILITA_CENTS) / 100", **_avg("DISPONIBILITA_CENTS"))
    m.metric("CAPACITA_TOTALE_MW", "IMPIANTI", "CAST(SUM(capacity_mw) AS BIGINT)",
             parts=[("sum", "capacity_mw")], final="CAST({0} AS BIGINT)")
    m.metric("NUMERO_IMPIANTI", "IMPIANTI", "COUNT(plant_id)", parts=[("count", "plant_id")], final="{0}")
    m.metric("EFFICIENZA_MEDIA", "IMPIANTI", "CAST(SUM(CAST(EFFICIENZA_CENTS AS DECIMAL(38,0))) AS DOUBLE) / COUNT(EFFICIENZA_CENTS) / 100",
             **_avg("EFFICIENZA_CENTS"))
    m.derived("MARGINE_PRODUZIONE", "RICAVO_POTENZIALE - COSTO_PRODUZIONE_TOTALE",
              ["RICAVO_POTENZIALE", "COSTO_PRODUZIONE_TOTALE"], ["margine"])
    return m
