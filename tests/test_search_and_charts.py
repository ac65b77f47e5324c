"""Stored index (R3 written partitioned by token bucket) gives the same BM25 top-k as the on-the-fly
plan; chart shapes (C3) follow the column-type rule."""
import os
import tempfile

from pyspark.sql import functions as F

from voltaic.operators import postings as I
from voltaic.operators import search as S
from voltaic.operators.conversation import chart_kind, chart_series
from voltaic.sources.tables import Tables


def test_stored_index_search_equals_on_the_fly(spark, sf_dir):
    t = Tables(spark, sf_dir)
    chunks = S.chunk(t.documents)
    q = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    path = os.path.join(tempfile.mkdtemp(prefix="idx-"), "index")
    postings, stats = S.build_index(chunks)
    I.write_index(postings, stats, path, buckets=8)
    assert any(x.startswith("bucket=") for x in os.listdir(os.path.join(path, "blocks")))
    stored = S.bm25(I.read_postings(spark, path), spark.read.parquet(f"{path}/chunk_stats"), q, 5)
    fly = S.bm25_chunks(chunks, q, 5)
    key = ["query_id", "rank", "doc_id", "chunk_id", "score"]
    want = sorted(tuple(r) for r in fly.select(key).collect())
    assert sorted(tuple(r) for r in stored.select(key).collect()) == want
    one = q.where("query_id = 3")
    pruned = I.search_index(spark, path, one, 5, buckets=8)
    assert sorted(tuple(r) for r in pruned.select(key).collect()) == sorted(
        tuple(r) for r in S.bm25_chunks(chunks, one, 5).select(key).collect())
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        pruned.explain("formatted")
    assert "PartitionFilters: [bucket" in buf.getvalue()


def test_chart_shapes(spark):
    grouped = spark.createDataFrame([("a", 1, 2.0, 3, 4, 5)], "k string, a int, b double, c int, d int, e int")
    assert chart_kind(grouped)[0] == "grouped_bar" and len(chart_kind(grouped)[2]) == 4
    assert chart_kind(spark.createDataFrame([("a", 1)], "k string, v int"))[0] == "hbar"
    line = spark.createDataFrame([(1, 10.0), (2, 20.0)], "x int, y double")
    assert chart_kind(line)[0] == "line"
    rows = chart_series(line, ["x"]).collect()
    assert [(r.chart, r.row_no, r.x, r.series, r.value) for r in rows] == [
        ("line", 1, "1", "y", 10.0), ("line", 2, "2", "y", 20.0)]
    big = spark.range(500).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v"))
    assert chart_series(big, ["v"]).count() == big.count() > 50  # the whole series
    assert chart_series(big, ["v"], max_rows=50).count() == 50


def test_respond_chart_or_table(spark, sf_dir):
    from voltaic.operators.conversation import respond
    from voltaic.plans.utility_model import build_model
    df = build_model(spark, sf_dir).query(["n_customers", "total_revenue"], ["segment"])
    kind, shown = respond(df, "Mostrami un grafico a barre per segmento", ["segment"])
    pdf = shown.toPandas()
    assert kind == "chart:grouped_bar" and set(pdf.series) == {"n_customers", "total_revenue"}
    kind, shown = respond(df, "Quanti clienti per segmento?", ["segment"])
    pdf = shown.toPandas()
    assert kind == "table" and len(pdf) == 5 and list(pdf.columns) == ["segment", "n_customers", "total_revenue"]


def test_stored_index_is_written_once_and_follows_its_table(spark, tmp_path):
    rows = [(1, "alpha beta gamma delta", "en", "a"), (2, "alpha alpha epsilon zeta", "de", "b"), (3, None, "en", "b")]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(path)
    first = I.stored_index(spark.read.parquet(path))
    assert I.stored_index(spark.read.parquet(path)) == first
    q = spark.createDataFrame([(1, "alpha zeta")], "query_id int, query string")
    assert [r.doc_id for r in I.search_index(spark, first, q).orderBy("rank").collect()] == [2, 1]
    assert [r.doc_id for r in I.search_index(spark, first, q, where="lang = 'en'").collect()] == [1]
    spark.createDataFrame([(4, "zeta zeta zeta", "en", "a")], "doc_id long, text string, lang string, source string"
                          ).write.mode("append").parquet(path)
    second = I.stored_index(spark.read.parquet(path))
    assert second != first
    # two terms (one of them twice) outweigh one term three times, which outweighs one term once
    assert [r.doc_id for r in I.search_index(spark, second, q).orderBy("rank").collect()] == [2, 4, 1]


def scored(spark, sf):
    """(postings opened, candidates, postings that an unbounded search would score) for the benchmark queries."""
    t = Tables(spark, f"/root/testdata/{sf}")
    q = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    path, plan = I.stored_index(t.documents), {}
    found = I.search_index(spark, path, q, 5, plan=plan, direct=0).count()
    unbounded = plan["worth"].agg(F.sum("df")).first()[0]
    return found, plan["met"].count(), plan["pairs"].count(), unbounded, q.count()


def test_bounds_skip_most_postings_and_work_stays_near_the_size_of_the_corpus(spark):
    found, opened, pairs, unbounded, queries = scored(spark, "sf0.01")
    assert found == 5 * queries
    t = Tables(spark, "/root/testdata/sf0.01")
    q = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    both = [sorted(map(tuple, I.search_index(spark, I.stored_index(t.documents), q, 5, direct=d).collect())) for d in (0, I.DIRECT)]
    assert both[0] == both[1]
    assert opened < unbounded / 4 and pairs < unbounded / 10
    small_found, small_opened, _, small_unbounded, small_queries = scored(spark, "sf0.001")
    # per query, an unbounded search grows with the corpus; what bounds leave open grows no faster
    assert opened / queries < 1.2 * (unbounded / queries) / (small_unbounded / small_queries) * (small_opened / small_queries)


def test_bounded_search_on_ties_filters_and_missing_terms(spark, tmp_path):
    rows = [(i, f"common word {'rare ' * (i % 3)}tail{i % 4}", "en" if i % 2 else "it", None if i % 5 else "s") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    path = str(tmp_path / "idx")
    chunks = S.chunk(docs, keep=["lang", "source"])
    I.write_index(*S.build_index(chunks, keep=("lang", "source")), path, 4, ("lang", "source"))
    q = spark.createDataFrame([(1, "common"), (2, "rare rare tail1"), (3, "nowhere"), (4, ""), (5, None), (6, "tail2 nowhere word")],
                              "query_id int, query string")
    key = ["query_id", "rank", "doc_id", "chunk_id", "score"]
    for where, ks in ((None, (1, 30)), ("source is null and lang = 'it'", (30,)), ("lang = 'xx'", (30,))):
        for k in ks:
            want = sorted(map(tuple, S.bm25_chunks(chunks if where is None else chunks.where(where), q, k).select(key).collect()))
            for direct in (0, I.DIRECT):
                got = I.search_index(spark, path, q, k, buckets=4, where=where, direct=direct)
                assert sorted(map(tuple, got.select(key).collect())) == want
    assert spark.read.parquet(path + "/blocks").where("token = 'common'").count() > 1      # a common token: several blocks
