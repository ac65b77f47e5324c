"""Metrics layer: grain safety, path finding, synonyms (M5), description (M6), derived metrics."""
import pytest
from pyspark.sql import functions as F

from voltaic.plans.metrics import ModelError
from voltaic.plans.utility_model import build_model


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return build_model(spark, sf_dir)


def test_dimension_from_other_star_is_rejected(model):
    with pytest.raises(ModelError, match="no many-to-one path"):
        model.query(["n_customers"], ["plant_type"])


def test_finer_dimension_is_rejected(model):
    # customers -> supplies is one-to-many: a customer metric cannot be split by supply month
    with pytest.raises(ModelError):
        model.query(["n_customers"], ["supply_month"])


def test_limit_needs_order(model):
    with pytest.raises(ModelError):
        model.query(["n_customers"], ["segment"], limit=3)


def test_chained_path(model):
    assert [r.name for r in model.path("consumption", "provinces")] == [
        "consumption_to_supply", "supply_to_customer", "customer_to_city", "city_to_province"]


def test_no_fan_out_across_facts(spark, sf_dir, model):
    # tickets and supplies both hang off customers; joining raw facts would multiply rows
    out = model.query(["n_supplies", "n_tickets"], ["segment"]).agg(F.sum("n_supplies"), F.sum("n_tickets")).first()
    from voltaic.sources.tables import Tables
    t = Tables(spark, sf_dir)
    assert out[0] == t.orders.count() and out[1] == t.events.count()


def test_derived_metric(model):
    r = model.query(["potential_revenue", "production_cost", "production_margin"]).first()
    assert abs(r.production_margin - (r.potential_revenue - r.production_cost)) < 1e-6


def test_synonym_lookup_ignores_case_and_accents(model):
    assert ("dimension", "city") in model.lookup("CITTÀ")
    assert ("dimension", "segment") in model.lookup("Segmento")
    assert model.lookup("no such term") == []


def test_resolve_terms_join(spark, model):
    terms = spark.createDataFrame([("CITTA",), ("fatturato",), ("xyz",)], "term string")
    got = {(r.term, r.name) for r in model.resolve_terms(terms).collect()}
    assert ("CITTA", "city") in got and ("fatturato", "total_revenue") in got and ("xyz", None) in got


def test_describe_lists_every_entry(spark, model):
    d = model.describe(spark)
    kinds = {r.kind: r.n for r in d.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds["table"] == 7 and kinds["relationship"] == 6
    assert kinds["metric"] == len(model.metrics) and kinds["dimension"] == len(model.dimensions)


@pytest.mark.parametrize("metrics,dims,where", [
    (["total_kwh"], ["city"], None),
    (["total_kwh", "total_smc", "cost_per_kwh", "avg_kwh"], ["province", "segment"], None),
    (["n_supplies", "avg_bill", "n_tickets", "avg_resolution", "n_customers"], ["segment"], None),
    (["total_production", "production_cost", "avg_hours", "total_capacity"], ["plant_type"], None),
    (["total_revenue"], ["supply_month"], "city = 'NATION_3'"),
    (["total_kwh"], [], "segment = 'BUILDING' AND plant_type = 'SMALL'"),
])
def test_eager_aggregation_equals_row_level(model, metrics, dims, where):
    def rows(eager):
        df = model.query(metrics, dims, where=where, eager=eager)
        return sorted(tuple(r) for r in df.collect())
    assert rows(True) == rows(False)


def test_eager_plan_aggregates_before_joining(model):
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        model.query(["total_kwh"], ["city"]).explain()
    plan = buf.getvalue()
    # the line table is grouped by its order key before it meets the orders table
    assert "HashAggregate(keys=[l_orderkey" in plan


def test_eager_count_over_empty_selection_is_zero(model):
    r = model.query(["n_customers", "n_supplies"], where="segment = 'NO_SUCH_SEGMENT'").first()
    assert r.n_customers == 0 and r.n_supplies == 0


def test_dangling_keys_form_a_null_group_in_both_plans(spark):
    from voltaic.plans.metrics import SemanticModel
    cust = spark.createDataFrame([(1, "A"), (2, "B")], "ck long, seg string")
    orders = spark.createDataFrame([(10, 1, 5), (11, 2, 7), (12, 3, 9)], "ok long, oc long, amt long")  # 3 dangles
    tickets = spark.createDataFrame([(100, 1), (101, 4), (102, None)], "tk long, tc long")
    m = SemanticModel("dangling")
    m.table("c", lambda: cust, ["ck"])
    m.table("o", lambda: orders, ["ok"])
    m.table("t", lambda: tickets, ["tk"])
    m.relate("o_c", "o", ["oc"], "c", ["ck"])
    m.relate("t_c", "t", ["tc"], "c", ["ck"])
    m.dimension("seg", "c", "seg")
    m.metric("amount", "o", "SUM(amt)", parts=[("sum", "amt")], final="{0}")
    m.metric("n_tickets", "t", "COUNT(tk)", parts=[("count", "tk")], final="{0}")
    for eager in (True, False):
        got = {r.seg: (r.amount, r.n_tickets) for r in m.query(["amount", "n_tickets"], ["seg"], eager=eager).collect()}
        assert got == {"A": (5, 1), "B": (7, None), None: (9, 2)}, eager


def test_dimension_named_like_a_foreign_key(spark):
    from voltaic.plans.metrics import SemanticModel
    cust = spark.createDataFrame([(1, "A"), (2, "B")], "ck long, seg string")
    orders = spark.createDataFrame([(10, 1, 5), (11, 2, 7), (12, 1, 9)], "ok long, oc long, amt long")
    m = SemanticModel("fkdim")
    m.table("c", lambda: cust, ["ck"])
    m.table("o", lambda: orders, ["ok"])
    m.relate("o_c", "o", ["oc"], "c", ["ck"])
    m.dimension("oc", "o", "oc")
    m.dimension("seg", "c", "seg")
    m.metric("amount", "o", "SUM(amt)", parts=[("sum", "amt")], final="{0}")
    for eager in (True, False):
        got = {(r.oc, r.seg): r.amount for r in m.query(["amount"], ["oc", "seg"], eager=eager).collect()}
        assert got == {(1, "A"): 14, (2, "B"): 7}, eager
