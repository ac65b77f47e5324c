"""Property-based checks on random inputs (few examples each: every example runs Spark jobs)."""
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voltaic.operators import relational as R
from voltaic.operators import search as S

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(texts=st.lists(st.text(alphabet="ab çé.\n", min_size=0, max_size=90), min_size=1, max_size=5),
       size=st.integers(min_value=1, max_value=25))
def test_chunks_cover_every_text(spark, texts, size):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ch = S.chunk(df, size=size, min_len=-1).collect()
    for i, t in enumerate(texts):
        parts = sorted((r.chunk_id, r.content) for r in ch if r.doc_id == i)
        assert "".join(p for _, p in parts) == t
        assert [c for c, _ in parts] == list(range(1, len(parts) + 1))
        assert all(len(p) == size for _, p in parts[:-1])
        for r in (r for r in ch if r.doc_id == i):
            assert r.page == -(-r.chunk_id * size // 3000)


@SETTINGS
@given(keys=st.lists(st.integers(min_value=-10**6, max_value=10**6), min_size=1, max_size=60, unique=True),
       start=st.integers(min_value=0, max_value=10**9), parts=st.integers(min_value=1, max_value=6))
def test_assigned_ids_are_contiguous_in_key_order(spark, keys, start, parts):
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(parts)
    rows = R.assign_ids(df, ["k"], start, "id").collect()
    assert sorted(r.id for r in rows) == list(range(start + 1, start + 1 + len(keys)))
    assert [r.k for r in sorted(rows, key=lambda r: r.id)] == sorted(keys)
