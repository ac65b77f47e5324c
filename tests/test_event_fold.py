"""C2 as a mergeable fold: any cut of a conversation gives the plain fold's result; a long one is spread over tasks."""
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voltaic.operators import conversation as C

OPS = st.lists(st.tuples(st.sampled_from([C.ADD, C.ADD, C.IF_EMPTY, C.IF_UNSAID, C.IF_UNSAID, C.SQL, C.CHART_SPEC, C.STEP, C.STEP_ONCE]),
                         st.text("ab", min_size=1, max_size=3)), max_size=25)


def plain(ops):
    text, sql, chart, steps = "", "", "", []
    for op, v in ops:
        if op == C.ADD or op == C.IF_EMPTY and not text or op == C.IF_UNSAID and v not in text:
            text += v
        sql, chart = v if op == C.SQL else sql, v if op == C.CHART_SPEC else chart
        if op == C.STEP or op == C.STEP_ONCE and v not in steps:
            steps.append(v)
    return text, sql, chart, steps


def folded(ops):
    s = C.Partial()
    for op, v in ops:
        s.n += 1
        s.add(op, v)
    return s


def merged(*states):
    out = C.Partial()
    for s in states:
        out.merge(s.n, [(k, "".join(t)) for k, t in s.parts], s.sql, s.chart, list(s.steps))
    return out


@settings(max_examples=400, deadline=None)
@given(OPS, st.integers(0, 25), st.integers(0, 25))
def test_any_cut_gives_the_plain_fold(ops, i, j):
    i, j = sorted((i, j))
    runs = ops[:i], ops[i:j], ops[j:]
    want = plain(ops)
    for s in (folded(ops), merged(*map(folded, runs)), merged(merged(folded(runs[0]), folded(runs[1])), folded(runs[2])),
              merged(folded(runs[0]), merged(folded(runs[1]), folded(runs[2])))):
        assert (s.text(), s.sql, s.chart, [v for _, v in s.steps]) == want
        assert s.n == len(ops)


def events(n, seed=1):
    """(event, data, operations) of every kind with a text part or step, many of them said before."""
    rng = random.Random(seed)
    for _ in range(n):
        v = rng.choice("abc") * rng.randrange(1, 4)
        kind = rng.randrange(6)
        if kind == 0:
            yield C.FINAL_TEXT, {"text": v}, [(C.IF_EMPTY, v)]
        elif kind == 1:
            yield C.TOOL_RESULT, {"content": [{"type": "json", "json": {"text": v}}]}, [(C.IF_UNSAID, v)]
        elif kind == 2:
            yield C.THINKING, {"text": v}, [(C.STEP_ONCE, "thinking")]
        elif kind == 3:
            yield C.STATUS, {"status": v}, [(C.STEP, "planning")]
        elif kind == 4:
            yield C.ANALYST_DELTA, {"sql": v}, [(C.SQL, v)]
        else:
            yield C.TEXT_DELTA, {"text": v + " "}, [(C.ADD, v + " "), (C.STEP_ONCE, "response")]


@pytest.mark.parametrize("most", [1, 7, 100_000])
def test_pieces_of_any_size_give_the_plain_fold(spark, monkeypatch, most):
    monkeypatch.setattr(C, "PIECE_EVENTS", most)
    rows, want = [], {}
    for conv in (None, "a", "b"):
        made = list(events(150, seed=len(want)))
        rows += [(conv, i, e, json.dumps(d)) for i, (e, d, _) in enumerate(made)]
        want[conv] = plain([op for _, _, ops in made for op in ops])
    random.Random(1).shuffle(rows)
    log = spark.createDataFrame(rows, "conv_id string, seq int, event string, data string")
    got = {r.conv_id: r for r in C.fold_events(log).collect()}
    assert set(got) == set(want)
    for conv, (text, sql, chart, steps) in want.items():
        assert (got[conv].text, got[conv].sql, got[conv].chart_spec, got[conv].n_events) == (text, sql, chart, 150)
        assert got[conv].steps == ",".join(steps + ["sql_execution"] * (sql != ""))
    assert C.fold_events(log.limit(0)).collect() == []


def test_one_conversation_of_a_million_events_is_spread_over_tasks(spark):
    n = 1_000_000
    data = F.when(F.col("id") % 10 == 3, F.concat(F.lit('{"content":[{"type":"json","json":{"text":"t'), (F.col("id") % 50).cast("string"), F.lit(' "}}]}')))
    log = spark.range(n).select(F.lit(7).alias("conv_id"), F.col("id").alias("seq"), F.when(F.col("id") % 10 == 3, C.TOOL_RESULT).otherwise(
        C.TEXT_DELTA).alias("event"), F.coalesce(data, F.concat(F.lit('{"text":"w'), F.col("id").cast("string"), F.lit('"}'))).alias("data"))
    tasks = spark.sparkContext.statusTracker()
    got, = C.fold_events(log).collect()
    text, said = [], set()
    for i in range(n):
        if i % 10 == 3:
            v = f"t{i % 50} "
            if v not in said:
                said.add(v)
                text.append(v)
        else:
            text.append(f"w{i}")
    assert got.text == "".join(text) and got.n_events == n and got.steps == "response"
    jobs = [tasks.getJobInfo(j) for j in tasks.getJobIdsForGroup(None)]
    stages = [tasks.getStageInfo(s) for j in jobs if j for s in j.stageIds]
    assert max(s.numTasks for s in stages if s) >= 8
