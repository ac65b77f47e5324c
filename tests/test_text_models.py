"""T7/T13 phrase tables, T10 bigrams, T11 held out, T14 free conditions, T15 embedding: properties and small brute force."""
import math
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from voltaic.operators import phrases as P
from voltaic.operators import text as T

WORDS = ["a", "b", "c", "d", "É"]


def brute_matches(tokens, table):
    out, i = [], 0
    while i < len(tokens):
        best = max((n for n in range(1, len(tokens) - i + 1) if tuple(tokens[i:i + n]) in table), default=0)
        if best:
            out.append((i, best, table[tuple(tokens[i:i + best])]))
        i += best or 1
    return out


@pytest.mark.parametrize("most", [200_000, 5])
def test_phrases_are_cut_longest_first_with_any_number_of_tries(spark, monkeypatch, most):
    monkeypatch.setattr(P, "TRIE_PHRASES", most)
    rng = random.Random(4)
    entries = [(" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 5))), f"k{i}") for i in range(40)]
    entries += [(None, "x"), ("", "y"), ("?!", "z"), ("a", None)]
    texts = [" ".join(rng.choice([*WORDS, "zz"]) for _ in range(rng.randrange(0, 40))) for _ in range(60)] + [None, "", "...", "a " * 3000]
    table = {}
    for p, k in entries:
        t = tuple(re.findall(r"\w+", (p or "").lower()))
        if t and k is not None:
            table[t] = min(k, table.get(t, k))
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id int, text string, matches_ int")
    got = {r.id: [tuple(m) for m in r.matches] for r in P.match_phrases(df, F.col("text"), spark.createDataFrame(entries, "phrase string, key string")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_matches(re.findall(r"\w+", (t or "").lower()), table)
    said = {r.id: r.out for r in P.replace_phrases(df, F.col("text"), spark.createDataFrame(entries, "phrase string, key string"), "out").collect()}
    for i, t in enumerate(texts):
        tokens, found = re.findall(r"\w+", (t or "").lower()), dict((p, (n, k)) for p, n, k in got[i])
        want, j = [], 0
        while j < len(tokens):
            n, k = found.get(j, (1, tokens[j]))
            want.append(k)
            j += n
        assert said[i] == " ".join(want)
    assert P.match_phrases(df, F.col("text"), spark.createDataFrame([], "phrase string, key string")).where("size(matches) > 0").count() == 0


def test_overlapping_places(spark):
    places = spark.createDataFrame([("San Giuliano",), ("San Giuliano Milanese",), ("Milanese Nord",), ("Cassano d'Adda",), ("Cassano",)], "place string")
    df = spark.createDataFrame([(1, "Da San Giuliano Milanese Nord a Cassano d'Adda, poi Cassano e san giuliano"), (2, None)], "id int, text string")
    got = {r.id: (r.places, r.n_places) for r in T.entities(df, "id", "text", places).collect()}
    assert got == {1: ("Cassano;Cassano d'Adda;San Giuliano Milanese", 3), 2: ("", 0)}


def test_tickets_name_places_of_every_length(spark, sf_dir):
    names = {r[0] for r in E.queries()["t13_ticket_entities"](spark, sf_dir).select(F.explode(F.split("places", ";"))).distinct().collect()}
    assert {"San Giuliano", "San Giuliano Milanese", "Cassano", "Cassano d'Adda", "Sesto San Giovanni"} <= names
    assert "San Giovanni" not in names


def test_free_conditions_part_the_texts(spark):
    texts = ["the meter is broken and dark", "a broken meter", "thanks for the kind service", "kind thanks", "", None, "nothing of that"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    conditions = spark.createDataFrame([(1, "broken meter"), (2, "kind thanks"), (3, "unknown words only"), (4, "")], "condition_id int, condition string")
    got = {(r.id, r.condition_id): (r.score, r.holds) for r in T.ai_filter(df, "id", "text", conditions).collect()}
    assert len(got) == len(texts) * 4
    assert {i for (i, c), (_, h) in got.items() if h and c == 1} == {0, 1}
    assert {i for (i, c), (_, h) in got.items() if h and c == 2} == {2, 3}
    assert not any(h or s for (_, c), (s, h) in got.items() if c == 4) and all(s in range(1001) for s, _ in got.values())
    fixed = spark.createDataFrame([(1, 0), (2, 1001)], "condition_id int, threshold int")
    got = {(r.id, r.condition_id): r.holds for r in T.ai_filter(df, "id", "text", conditions, thresholds=fixed).collect()}
    assert all(got[i, 1] for i in range(len(texts))) and not any(got[i, c] for i in range(len(texts)) for c in (2, 3, 4))


def test_conditions_of_the_query_answer_differently(spark):
    holds = {r.condition_id: r.n for r in E.queries()["t14_semantic_filter"](spark, "/root/testdata/sf0.01").where("holds").groupBy(
        "condition_id").agg(F.count("*").alias("n")).collect()}
    n = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    assert len(set(holds.values())) >= 3 and all(0 < v < n for v in holds.values())


def test_held_out_classification_finds_every_outcome(spark):
    rows = E.queries()["t11_classify_held_out"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) > 100 and len({r.label for r in rows}) == 4
    for truth in {r.truth for r in rows}:
        own = [r for r in rows if r.truth == truth]
        assert len(own) >= 5 and sum(r.label == truth for r in own) / len(own) >= 0.8, truth


def test_bigram_completion(spark):
    corpus = spark.createDataFrame([(1, "A b, a b a c. x"), (2, "b a"), (3, None), (4, "one")], "id int, text string")
    model = {r.token: r.next for r in T.next_words(corpus, "id", "text").collect()}
    assert model == {"a": "b", "b": "a", "c": "x"}
    prompts = spark.createDataFrame([(1, "say a"), (2, "see C"), (3, "x"), (4, ""), (5, None), (6, "unknown"), (6, "say a")], "id int, p string")
    got = sorted((r.id, r.completion) for r in T.complete_by_bigrams(prompts, "id", "p", T.next_words(corpus, "id", "text"), 3).collect())
    assert got == [(1, "b a b"), (2, "x"), (3, ""), (4, ""), (5, ""), (6, ""), (6, "b a b")]


def test_embedding_is_signed_normalised_and_total(spark):
    texts = ["alpha beta gamma", "alpha beta gamma", "delta", None, "", "alpha delta " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.embedding for r in T.embed(df, "id", "text", 32).collect()}
    assert set(got) == set(range(len(texts))) and all(len(v) == 32 for v in got.values())
    assert got[0] == got[1] and any(x < 0 for v in got.values() for x in v)
    assert all(abs(math.sqrt(sum(x * x for x in got[i])) - 1) < 1e-4 for i in (0, 2, 5)) and not any(got[3]) and not any(got[4])
