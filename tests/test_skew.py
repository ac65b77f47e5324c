"""Hot keys: one key holding a third of the rows must not change results or land whole in one task's
memory. Checks results against plain aggregation and the plan shapes that bound per-key work."""
import contextlib
import io

from pyspark.sql import functions as F

from voltaic.operators.relational import top_n_per_group
from voltaic.operators.text import score_distinct, sentiment
from voltaic.plans.metrics import SemanticModel


def formatted(df, mode="formatted"):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def _skewed_lines(spark, n=30000):
    # a third of all lines belong to order 0
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("l_orderkey"),
        (F.col("id") % 7 + 1).cast("double").alias("l_quantity"))


def test_eager_aggregation_with_hot_order_key(spark):
    lines = _skewed_lines(spark)
    orders = spark.range(30000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 5).alias("o_custkey"))
    m = SemanticModel("skew")
    m.table("lines", lambda: lines, ["l_orderkey", "l_quantity"])
    m.table("orders", lambda: orders, ["o_orderkey"])
    m.relate("l_o", "lines", ["l_orderkey"], "orders", ["o_orderkey"])
    m.fact("qty", "lines", "l_quantity")
    m.dimension("cust", "orders", "o_custkey")
    m.metric("total", "lines", "SUM(qty)", parts=[("sum", "qty")], final="{0}")
    got = {r.cust: r.total for r in m.query(["total"], ["cust"]).collect()}
    want = {r.cust: r.total for r in lines.join(orders, lines.l_orderkey == orders.o_orderkey)
            .groupBy(F.col("o_custkey").alias("cust")).agg(F.sum("l_quantity").alias("total")).collect()}
    assert got == want
    # the hot order collapses to one partial row per map task before the join shuffle
    assert "HashAggregate(keys=[l_orderkey" in formatted(m.query(["total"], ["cust"]), "simple")


def test_top_k_with_hot_group_is_partial_before_shuffle(spark):
    df = spark.range(60000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("g"),
                                   F.col("id").alias("v"))
    out = top_n_per_group(df, ["g"], [F.desc("v"), F.asc("g")], 3)
    p = formatted(out)
    assert p.count("WindowGroupLimit") >= 2  # partial (map side) and final
    hot = sorted(r.v for r in out.where("g = 0").collect())
    assert hot == [59991, 59994, 59997]


def test_hot_duplicate_texts_scored_once(spark):
    texts = ["the same complaint again"] * 2000 + [f"unique text {i}" for i in range(1000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    lex = spark.createDataFrame([("complaint", -1.0), ("unique", 0.5)], "token string, weight double")
    calls = []

    def scorer(uniq, i, c):
        calls.append(uniq)
        return sentiment(uniq, i, c, lex)
    out = score_distinct(df, "text", scorer)
    assert out.count() == 3000
    assert calls[0].count() == 1001  # distinct texts only
    # partial dedup before the shuffle: an aggregate below the exchange and one above it
    tree = formatted(calls[0]).split("\n\n")[0]
    assert tree.count("Aggregate") >= 2 and tree.index("Exchange") < tree.rindex("Aggregate")
