"""Registered queries over stored forms: documents as files (S7, S8) and co-located tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from voltaic.operators import search as S
from voltaic.operators import text as T
from voltaic.plans.registry import register
from voltaic.plans.text import _html_sql
from voltaic.session import scratch_path
from voltaic.sources import documents as D
from voltaic.sources.sinks import write_bucketed
from voltaic.sources.tables import Tables


def _page_files(spark, d) -> str:
    path = scratch_path(spark, "page-files")
    D.write_documents(Tables(spark, d).pages, path, "page_id", "html")
    return path


@register("s7_document_files", """
SELECT page_id, CAST(strlen(COALESCE(html, '')) + 1 AS BIGINT) AS length FROM pages""")
def s7_documents(spark, d):
    """Listing of a folder of documents, one file per page: name and length (with the line feed that ends a file)."""
    files = D.list_documents(spark, _page_files(spark, d), "page_id")
    return files.select(F.col("page_id").cast("long").alias("page_id"), "length")


@register("s8_documents_from_files", f"""
WITH t AS (SELECT page_id, {_html_sql()} AS text FROM pages),
c AS (SELECT page_id, text, unnest(range(0, CAST(ceil(length(text) / 2000) AS BIGINT))) AS i FROM t)
SELECT page_id, i + 1 AS chunk_id, 'Sezione ' || CAST(i + 1 AS VARCHAR) AS section, CAST(ceil((i + 1) * 2000 / 3000) AS BIGINT) AS page,
       substr(text, i * 2000 + 1, 2000) AS content
FROM c WHERE length(substr(text, i * 2000 + 1, 2000)) > 10""")
def s8(spark, d):
    """Documents read whole from their files, turned from markup to text and cut into chunks in page order."""
    files = D.read_documents(spark, _page_files(spark, d), "page_id", "html")
    texts = files.select(F.col("page_id").cast("long").alias("page_id"), T.html_to_text(F.coalesce("html", F.lit(""))).alias("text"))
    return S.chunk(texts, "page_id", "text").select("page_id", "chunk_id", "section", "page", "content")


def colocated(spark, d, buckets: int = 16):
    """(orders, lineitem) bucketed and sorted by the order key under the shared folder."""
    t, run = Tables(spark, d), uuid.uuid4().hex[:12]
    orders = write_bucketed(t.orders, f"orders_{run}", scratch_path(spark, "orders-bucketed"), ["o_orderkey"], buckets)
    lines = write_bucketed(t.lineitem, f"lineitem_{run}", scratch_path(spark, "lineitem-bucketed"), ["l_orderkey"], buckets)
    return orders, lines


def bill_by_priority(orders, lines):
    """Lines joined to their orders bucket by bucket; quantities and revenue cents per order priority."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("decimal(38,0)")
    j = lines.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return j.groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count(F.lit(1)).alias("n_lines"), (F.sum(cents).cast("double") / 100).alias("price"))


@register("j3_s5_colocated_join", """
SELECT o_orderpriority AS priority, COUNT(*) AS n_lines, CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS price
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def j3_colocated(spark, d):
    """Fact and dimension written as co-located tables, joined without a shuffle of either."""
    return bill_by_priority(*colocated(spark, d))


@register("a3_m7_active_customers", """
SELECT c.c_mktsegment AS segment, COUNT(DISTINCT o_custkey) AS n_active_customers, TRUE AS estimate_within_4_percent
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1""")
def a3(spark, d):
    """A3, M7: active customers per segment, exactly and by merged HyperLogLog sketches (eager plan); the estimate is held
    to five standard errors."""
    from voltaic.plans.utility_model import build_model
    m = build_model(spark, d)
    exact = m.query(["n_active_customers"], ["segment"])
    guess = m.query(["n_active_customers_approx"], ["segment"])
    close = F.abs(F.col("n_active_customers_approx") - F.col("n_active_customers")) <= F.ceil(F.col("n_active_customers") * 0.04)
    return (exact.join(guess.withColumnRenamed("segment", "_s"), F.col("segment").eqNullSafe(F.col("_s")))
            .select("segment", "n_active_customers", close.alias("estimate_within_4_percent")))
