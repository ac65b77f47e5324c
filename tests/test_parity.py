"""Every registered query against its DuckDB oracle (the driver's correctness gate, run locally)."""
import pytest

import __spark_entry__ as E
from compare import rows_sorted
from voltaic.plans import load_all

QUERIES = E.queries()
ORACLES = E.oracle_sql()


def test_every_query_is_registered_with_survey_id():
    queries, oracles = load_all()
    assert len(queries) >= 100 and len(oracles) >= 100
    for name in queries:
        assert name.split("_")[0][0] in "spjakwufgtrmqcvx", name


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cols = df.columns
    got = rows_sorted(cols, [tuple(r) for r in df.collect()])
    res = duck.execute(ORACLES[name])
    ocols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(ocols)
    want = rows_sorted(ocols, res.fetchall())
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_queries_run(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.count() > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 5
    assert df.columns == ["city", "total_kwh"]
