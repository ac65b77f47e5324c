"""Co-located tables (no shuffle of either side), documents as files, distinct sketches."""
import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from voltaic.plans.storage import bill_by_priority, colocated
from voltaic.plans.utility_model import build_model
from voltaic.sources import documents as D


def plan(df):
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_colocated_tables_join_without_a_shuffle(spark, sf_dir):
    orders, lines = colocated(spark, sf_dir, buckets=8)
    joined = lines.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    p = plan(joined)
    assert "SortMergeJoin" in p and "Exchange" not in p and p.count("Bucketed: true") == 2
    assert joined.count() == lines.count()
    grouped = plan(lines.groupBy("l_orderkey").agg(F.sum("l_quantity")))
    assert "Exchange" not in grouped
    assert plan(bill_by_priority(orders, lines)).count("Arguments: hashpartitioning") == 1         # of the groups alone
    files = {f.rsplit("_", 1)[1][:5] for f in lines.inputFiles()}
    assert len(files) == len(lines.inputFiles()) <= 8                                              # one file per bucket


def test_documents_as_files(spark, tmp_path):
    rows = [("a b/c", "line\n\nline  ü\r\n"), ("2", ""), ("3", None), ("4", "x" * 300_000)]
    path = str(tmp_path / "docs")
    D.write_documents(spark.createDataFrame(rows, "name string, html string"), path, "name", "html")
    got = {r.name: r.content for r in D.read_documents(spark, path, "name").collect()}
    assert got == {n: (c or "") + "\n" for n, c in rows}
    listed = {r.name: r.length for r in D.list_documents(spark, path, "name").collect()}
    assert listed == {n: len((c or "").encode()) + 1 for n, c in rows}


def test_documents_lie_in_few_folders(spark, tmp_path):
    """A file per document, but no folder per document: the listing was 10,000 tasks, the write mostly folders."""
    path = tmp_path / "page_id=root" / "docs"
    rows = spark.range(0, 1200, 1, 3).selectExpr("id AS page_id", "concat('text ', id) AS html")
    D.write_documents(rows, str(path), "page_id", "html")
    files = list(path.rglob("*.txt"))
    assert len(files) == 1200 and len({f.parent for f in files}) <= 3 * D.FOLDERS
    assert not any(f.name.startswith("_temporary") for f in path.iterdir())
    got = D.read_documents(spark, str(path), "page_id", "html").collect()
    assert sorted((int(r.page_id), r.html) for r in got) == [(i, f"text {i}\n") for i in range(1200)]
    assert D.read_documents(spark, str(path), "page_id").rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    listed = D.list_documents(spark, str(path), "page_id").collect()
    assert sorted((int(r.page_id), r.length) for r in listed) == [(i, len(f"text {i}") + 1) for i in range(1200)]


def test_document_names_copies_and_modes(spark, tmp_path):
    path, schema = str(tmp_path / "docs"), "name string, html string"

    def read():
        return sorted((r.name, r.content) for r in D.read_documents(spark, path, "name").collect())

    names = ["a.txt", "b.c.d", "50%", "%41", "x=y", "p+q", "'[]{}^\"#*:?\\", "tab\there", "_hidden", ".dot", "n" * 250, "name=z/1"]
    D.write_documents(spark.createDataFrame([(n, f"of {n}") for n in names], schema), path, "name", "html")
    assert read() == sorted((n, f"of {n}\n") for n in names)
    twice = spark.createDataFrame([("1", "a"), ("2", "b"), ("1", "c"), (None, "d"), ("", "e")], schema).coalesce(1)
    D.write_documents(twice, path, "name", "html")                                # overwrites; a name's rows share a file
    first = [("1", "a\nc\n"), ("2", "b\n"), ("__HIVE_DEFAULT_PARTITION__", "d\ne\n")]
    assert read() == first
    D.write_documents(spark.createDataFrame([("3", "f")], schema), path, "name", "html", mode="append")
    assert read() == sorted([*first, ("3", "f\n")])
    kept = spark.range(4, numPartitions=2).selectExpr("string(id) AS name", "if(id = 3, raise_error('stop'), 'x') AS html")
    with pytest.raises(Exception, match="stop"):
        D.write_documents(kept, path, "name", "html")
    assert read() == sorted([*first, ("3", "f\n")])                               # a job that fails leaves the files as they were
    path = str(tmp_path / "spark")
    D.write_documents(spark.createDataFrame([("a.b/c", "x"), ("2", None)], schema), path, "name", "html", mode="error")
    assert read() == [("2", "\n"), ("a.b/c", "x\n")]                              # Spark's writer: a folder per name


def test_sketched_distinct_counts_merge_within_their_error(spark):
    big = "/root/testdata/sf0.01"
    m = build_model(spark, big)
    for dims in ([], ["segment"], ["city"], ["supply_month"]):
        exact = {tuple(r[d] for d in dims): r.n_active_customers for r in m.query(["n_active_customers"], dims).collect()}
        close = {tuple(r[d] for d in dims): r.n_active_customers_approx for r in m.query(["n_active_customers_approx"], dims).collect()}
        assert set(exact) == set(close)
        assert all(abs(close[k] - n) <= max(1, 0.04 * n) for k, n in exact.items())


def test_staged_tables_are_dropped_on_request(spark, monkeypatch):
    import os

    from voltaic import session
    monkeypatch.setattr(session, "_made", [])
    staged = session.cut_lineage(spark.range(10), "stage-to-drop")
    kept = session.checkpoint_dir(spark)
    assert staged.count() == 10 and any(f.startswith("stage-to-drop") for f in os.listdir(kept))
    session.scratch_path(spark, "never-written")
    assert session.drop_scratch(spark) == 1 and session.drop_scratch(spark) == 0
    assert not any(f.startswith("stage-to-drop") for f in os.listdir(kept))
