"""The pipeline's stages against brute force."""
import corpus_pipeline
import pytest

from voltaic.llm.queries import table

from . import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "benchmark_decontamination",
                                                      "temperature_mixing", "stratified_sharding"]


def test_stages(spark, sf_dir, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = corpus_pipeline.language_id(spark, docs, sf_dir)
    assert kept.columns == COLUMNS and kept.count() >= 0.98 * len(rows)
    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert kept.columns == COLUMNS
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c, _ in brute.jaccard(rows, 5, 80, 100)})
    clean = corpus_pipeline.decontamination(spark, docs, sf_dir)
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    hits = brute.hits(rows, items, 13)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, (w, h, _) in hits.items() if not (h and 20 * h >= w))
    mixed = corpus_pipeline.mixing(spark, docs, sf_dir)
    assert mixed.columns == COLUMNS and {r.doc_id for r in mixed.collect()} == {i for i, _ in rows}
    assert corpus_pipeline.sharding(spark, docs, sf_dir).count() == len(rows)


def test_awkward_rows_go_through(spark, sf_dir):
    text = "some words in a text that is long enough to count as english prose for the model here"
    rows = [(None, text, "en", None, 1, "x"), (1, None, "en", "a", 0, "x"), (2, "", None, "a", 0, "x"), (3, text, "en", "a", 1, "x"),
            (3, text, "en", "a", 1, "x"), (4, text + " " + text, None, "a", 1, "x"), (5, "12 34", "en", "b", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _hit string")
    first = corpus_pipeline.language_id(spark, docs, sf_dir)
    assert sorted(str(r.doc_id) for r in first.collect()) == ["3", "3", "4", "None"]
    second = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert sorted(str(r.doc_id) for r in second.collect()) == ["1", "2", "3", "4", "5", "None"]
    for _, stage in corpus_pipeline.STAGES[2:]:
        assert stage(spark, docs, sf_dir).count() >= len(rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
