"""User functions over rows.

V1 runs a *registered* Python function on every row of a batch and returns, per row,
``struct<success, output, error, execution_time>``: one bad row never fails the task, and text
written to stderr also marks the row failed. Functions are looked up by name in
:data:`FUNCTIONS`, never compiled from row data. It runs in ``mapInPandas`` (Arrow batches), so the
per-row loop is the user's function itself, with Spark parallel by partition.

V2 wraps a model as an iterator ``pandas_udf``: the model is built once per task (not per row or
batch), and :func:`apply_distinct` scores each distinct input once and joins the result back.
"""

from __future__ import annotations

import concurrent.futures as cf
import contextlib
import io
import json
import sys
import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT_TYPE = T.StructType([
    T.StructField("success", T.BooleanType()), T.StructField("output", T.StringType()),
    T.StructField("error", T.StringType()), T.StructField("execution_time", T.DoubleType())])


def _inverse_k(text: str) -> str:
    """Example: ``100 // (k mod 7)`` of a JSON ``{"k": n}``; fails for multiples of 7."""
    k = json.loads(text)["k"]
    return str(100 // (k % 7))


def _warn_on_even(text: str) -> str:
    import sys
    k = json.loads(text)["k"]
    if k % 2 == 0:
        print(f"even k={k}", file=sys.stderr)
    return str(k)


FUNCTIONS: dict[str, Callable[[str], object]] = {
    "inverse_k": _inverse_k,
    "warn_on_even": _warn_on_even,
}


def register_function(name: str, fn: Callable[[str], object]) -> None:
    FUNCTIONS[name] = fn


class _ThreadStderr(io.TextIOBase):
    """``sys.stderr`` with a stream per thread: a call that outlives its row writes to its own row's
    buffer only. Installed once per process; other threads reach the stream that was there before."""

    def __init__(self, outer):
        self.outer, self.by_thread = outer, {}

    def write(self, s):
        return self.by_thread.get(threading.get_ident(), self.outer).write(s)

    def flush(self):
        self.by_thread.get(threading.get_ident(), self.outer).flush()


@contextlib.contextmanager
def _stderr_to(stream):
    if not hasattr(sys.stderr, "by_thread"):
        sys.stderr = _ThreadStderr(sys.stderr)
    streams, me = sys.stderr.by_thread, threading.get_ident()
    streams[me] = stream
    try:
        yield
    finally:
        streams.pop(me, None)


class _Runner:
    """One worker thread per task; a timed-out call is abandoned with its thread (it cannot be
    killed), and later rows get a fresh thread so they never queue behind it."""

    def __init__(self):
        self.pool = cf.ThreadPoolExecutor(max_workers=1)

    def abandon(self):
        self.pool.shutdown(wait=False, cancel_futures=True)
        self.pool = cf.ThreadPoolExecutor(max_workers=1)

    def close(self):
        self.pool.shutdown(wait=False, cancel_futures=True)


def _run_one(fn: Callable[[str], object], value: str, timeout: float, runner: "_Runner") -> dict:
    t0 = time.perf_counter()
    err = io.StringIO()

    def call():
        with _stderr_to(err):
            return fn(value)

    try:
        out = runner.pool.submit(call).result(timeout=timeout)
        ok, output, error = True, "" if out is None else str(out), ""
    except cf.TimeoutError:
        # like a thread join with timeout: the call is abandoned, the row is marked failed
        runner.abandon()
        ok, output, error = False, "", f"timed out after {timeout} s"
    except Exception as e:  # noqa: BLE001 - the row's failure is the result
        ok, output, error = False, "", f"{type(e).__name__}: {e}"
    if ok and err.getvalue():
        ok, error = False, err.getvalue()
    return {"success": ok, "output": output, "error": error, "execution_time": time.perf_counter() - t0}


def run_rows(df: DataFrame, index_col: str, input_col: str, function: str, timeout: float = 90.0,
             out_col: str = "result") -> DataFrame:
    """V1: ``(index, input)`` rows -> ``(index, result struct)``, one result per input row."""
    if function not in FUNCTIONS:
        raise KeyError(f"unknown function {function}; register it with register_function")
    schema = T.StructType([df.schema[index_col], T.StructField(out_col, RESULT_TYPE)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = FUNCTIONS[function]
        runner = _Runner()
        try:
            for b in batches:
                res = [_run_one(fn, v, timeout, runner) for v in b[input_col].tolist()]
                yield pd.DataFrame({index_col: b[index_col].values, out_col: res})
        finally:
            runner.close()

    return df.select(index_col, input_col).mapInPandas(run, schema)


def model_udf(factory: Callable[[], Callable[[pd.Series], pd.Series]],
              return_type: T.DataType = T.StringType()):
    """V2: iterator pandas UDF; ``factory()`` builds the model once per task."""
    @F.pandas_udf(return_type)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for s in batches:
            yield model(s)
    return apply


def apply_distinct(df: DataFrame, input_col: str, udf, out_col: str) -> DataFrame:
    """V2/T10 cost control: each distinct input is scored once, then joined back by its hash."""
    keyed = df.withColumn("_h", F.sha2(F.col(input_col), 256))
    uniq = keyed.groupBy("_h").agg(F.first(input_col).alias("_in"))
    scored = uniq.select("_h", udf(F.col("_in")).alias(out_col))
    return keyed.join(scored.withColumnRenamed("_h", "_h2"), F.col("_h").eqNullSafe(F.col("_h2")), "left").drop("_h", "_h2")


# Words that raise the urgency of a request in the stand-in completion model.
URGENT_WORDS = ["urgent", "urgente", "dringend", "urgence", "guasto", "failure", "immediately", "subito"]


def keyword_completion_model() -> Callable[[pd.Series], pd.Series]:
    """Stand-in for a hosted completion model (T10): deterministic urgency and action per prompt.

    Replace with any factory returning ``Series -> Series`` (a local model loaded once per task).
    """
    words = tuple(URGENT_WORDS)

    def model(prompts: pd.Series) -> pd.Series:
        low = prompts.fillna("").str.lower()
        hits = sum(low.str.count(w) for w in words)
        level = pd.cut(hits, [-1, 0, 1, 3, 1 << 30], labels=["LOW", "MEDIUM", "HIGH", "CRITICAL"]).astype(str)
        return "1) " + level + " 2) Review the request and contact the customer."
    return model


def complete(df: DataFrame, prompt_col: str, out_col: str = "completion",
             factory: Callable[[], Callable[[pd.Series], pd.Series]] = keyword_completion_model) -> DataFrame:
    """Batch completion of a prompt column through a pluggable model (distinct prompts once)."""
    return apply_distinct(df, prompt_col, model_udf(factory), out_col)


def result_fields(c: str = "result") -> list[Column]:
    return [F.col(f"{c}.{f}").alias(f) for f in ("success", "output", "error", "execution_time")]
