"""Conversation logs and chart data.

C1 packs a chat history into the message list a model call takes; C2 folds an agent's event log into
(text, sql, chart, steps); C3 turns an aggregate result into long-form chart series. The input order of rows
never matters.

C1's output is one value per conversation holding all of its messages (that is the operator), so a conversation is
held by one task while it is assembled. C2 folds long conversations in pieces that many tasks work on.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from voltaic.functions.scalar import strip_inline_images
from voltaic.operators.relational import assign_ids


def pack_history(conv: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """``(conv_id, n_messages, messages)`` where ``messages`` is
    ``array<struct<role, content: array<struct<type, text>>>>`` in turn order (one ``text`` part per
    message), ending with the latest user turn (turns after it, which answer it, are not yet part of the
    request)."""
    # latest user turn per conversation: a partial aggregate (one row per conversation and map
    # task), joined back on the key; no window buffering a whole conversation
    last_user = conv.groupBy(conv_col).agg(F.max(F.when(F.col(role_col) == "user", F.col(turn_col))).alias("_last_user"))
    c = conv.join(last_user, conv_col).where(F.col(turn_col) <= F.col("_last_user"))
    g = c.groupBy(conv_col).agg(F.array_sort(F.collect_list(F.struct(
        F.col(turn_col).alias("t"), F.col(role_col).alias("role"), F.col(text_col).alias("text")))).alias("_m"))
    msgs = F.transform("_m", lambda x: F.struct(x["role"].alias("role"), F.array(
        F.struct(F.lit("text").alias("type"), x["text"].alias("text"))).alias("content")))
    return g.select(conv_col, F.size("_m").alias("n_messages"), msgs.alias("messages"))


# Event kinds of the agent stream.
THINKING = "response.thinking.delta"
STATUS = "response.status"
TOOL_USE = "response.tool_use"
TEXT_DELTA = "response.text.delta"
FINAL_TEXT = "response.text"
TOOL_RESULT = "response.tool_result"
ANALYST_DELTA = "response.tool_result.analyst.delta"
CHART = "response.chart"
RESPONSE = "response"
ERROR = "error"
MESSAGE_DELTA = "message.delta"
# Fixed value: prefix of an error message appended to the reply text.
ERROR_PREFIX = "\nErrore: "

_RESULT = "array<struct<type: string, json: struct<sql: string, text: string, charts: array<string>>>>"
EVENT_DATA = f"""text string, status string, name string, tool_name string, message string, sql string, chart_spec string,
    content array<struct<type: string, text: string, chart: struct<chart_spec: string>,
                         json: struct<sql: string, text: string, charts: array<string>>,
                         tool_result: struct<content: {_RESULT}>>>,
    delta struct<sql: string, text: string, content: array<struct<type: string, text: string,
                                                                   tool_results: struct<content: {_RESULT}>>>>"""

# What an event does to the reply, in order: add text, set it if still empty, add it unless it is already said,
# replace the SQL or the chart, record a step, record a step once.
ADD, IF_EMPTY, IF_UNSAID, SQL, CHART_SPEC, STEP, STEP_ONCE = range(7)
_OPS = "array<struct<op: int, v: string>>"


def _op(kind: int, value: Column | str, when: Column | None = None) -> Column:
    """A one-element list, empty unless ``value`` is non-empty (and ``when`` holds)."""
    value = F.lit(value) if isinstance(value, str) else value
    ok = F.coalesce(value, F.lit("")) != ""
    one = F.array(F.struct(F.lit(kind).alias("op"), value.alias("v")))
    return F.when(ok if when is None else ok & F.coalesce(when, F.lit(False)), one).otherwise(
        F.array().cast(_OPS)).cast(_OPS)


def _each(items: Column, ops) -> Column:
    return F.flatten(F.transform(F.coalesce(items, F.array()), ops))


def _results(items: Column, text: int | None, steps: bool, charts: bool = True) -> Column:
    """What the JSON parts of a tool result do."""
    def one(c):
        j, is_json = c["json"], c["type"] == "json"
        first = F.get(j["charts"], 0)
        parts = [_op(SQL, j["sql"], is_json)]
        if steps:
            parts.append(_op(STEP, "sql_generation", is_json & (j["sql"] != "")))
        if text is not None:
            parts.append(_op(text, j["text"], is_json))
        if charts:
            parts.append(_op(CHART_SPEC, first, is_json))
        if charts and steps:
            parts.append(_op(STEP, "chart", is_json & (F.size(j["charts"]) > 0)))
        return F.concat(*parts)
    return _each(items, one)


def event_ops(event: Column, data: Column, raw: Column) -> Column:
    """The operations of one event, by its kind (unknown kinds: none)."""
    d = data
    tool = F.coalesce(d["name"], d["tool_name"], F.lit("strumento"))
    delta = lambda f: F.when(d["delta"].isNotNull(), d["delta"][f]).otherwise(d[f])
    final = lambda c: F.concat(
        _op(IF_EMPTY, c["text"], c["type"] == "text"), _op(CHART_SPEC, c["chart"]["chart_spec"], c["type"] == "chart"),
        F.when(c["type"] == "tool_result", _results(c["tool_result"]["content"], None, False)).otherwise(
            F.array().cast(_OPS)))
    message = lambda c: F.concat(
        _op(ADD, c["text"], c["type"] == "text"),
        F.when(c["type"] == "tool_results", _results(c["tool_results"]["content"], ADD, False, charts=False)).otherwise(
            F.array().cast(_OPS)))
    return (F.when(event == THINKING, _op(STEP_ONCE, "thinking", d["text"] != ""))
            .when(event == STATUS, _op(STEP, "planning", d["status"] != ""))
            .when(event == TOOL_USE, _op(STEP, F.when(tool.contains("Ricerca") | F.lower(tool).contains("search"),
                                                      "search").otherwise("tool_call")))
            .when(event == TEXT_DELTA, F.concat(_op(ADD, d["text"]), _op(STEP_ONCE, "response")))
            .when(event == FINAL_TEXT, _op(IF_EMPTY, d["text"]))
            .when(event == TOOL_RESULT, F.concat(_op(SQL, d["sql"]), _op(STEP, "sql_generation", d["sql"] != ""),
                                                 _results(d["content"], IF_UNSAID, True)))
            .when(event == ANALYST_DELTA, F.concat(_op(SQL, delta("sql")), _op(ADD, delta("text"))))
            .when(event == CHART, F.concat(_op(CHART_SPEC, d["chart_spec"]), _op(STEP_ONCE, "chart")))
            .when(event == RESPONSE, _each(d["content"], final))
            .when(event == ERROR, F.concat(_op(ADD, F.concat(F.lit(ERROR_PREFIX), F.coalesce(d["message"], raw))),
                                           _op(STEP, "error")))
            .when(event == MESSAGE_DELTA, _each(d["delta"]["content"], message))
            .otherwise(F.array().cast(_OPS)))


PIECE_EVENTS = 100_000      # events folded into one partial state
PIECE_CHARS = 16 << 20      # characters of text in one partial state


class Partial:
    """What a run of a conversation's events does, as a value that merges: ``merge(a, b)`` of two neighbouring runs is the
    state of both, however a conversation is cut.

    ``parts`` are (kind, text): text that is surely added (``ADD``), and what depends on the text before the run. Of the
    latter little is left. The first text of a conversation is always added, whatever its kind, and text stays
    non-empty from there on; so ``IF_EMPTY`` can only matter as a run's first part. Once ``IF_UNSAID`` was met, its
    text is in the conversation, added or said before; so only the first of equal ones in a run can matter, and only
    if no sure text before it in the run holds it. ``steps`` are (once, kind); a step to be recorded once matters only
    if no step of its kind stands before it in the run.
    """

    __slots__ = ("n", "parts", "chars", "unsaid", "sql", "chart", "steps", "kinds")

    def __init__(self):
        self.n, self.parts, self.chars, self.unsaid = 0, [], 0, set()
        self.sql, self.chart, self.steps, self.kinds = "", "", [], set()

    def add(self, op: int, v: str) -> None:
        if op == ADD:
            if self.parts and self.parts[-1][0] == ADD:
                self.parts[-1][1].append(v)
            else:
                self.parts.append((ADD, [v]))
            self.chars += len(v)
        elif op == IF_EMPTY:
            if not self.parts:
                self.parts.append((IF_EMPTY, [v]))
                self.chars += len(v)
        elif op == IF_UNSAID:
            if v not in self.unsaid:
                self.unsaid.add(v)
                if not any(k == ADD and v in self._run(i) for i, (k, _) in enumerate(self.parts)):
                    self.parts.append((IF_UNSAID, [v]))
                    self.chars += len(v)
        elif op == SQL:
            self.sql = v
        elif op == CHART_SPEC:
            self.chart = v
        elif op == STEP or v not in self.kinds:
            self.steps.append((op == STEP_ONCE, v))
            self.kinds.add(v)

    def _run(self, i: int) -> str:
        texts = self.parts[i][1]
        if len(texts) > 1:
            texts[:] = ["".join(texts)]
        return texts[0]

    def merge(self, n: int, parts, sql: str, chart: str, steps) -> None:
        """Appends the state of the next run."""
        self.n += n
        for kind, text in parts:
            self.add(kind, text)
        self.sql, self.chart = sql or self.sql, chart or self.chart
        for once, v in steps:
            self.add(STEP_ONCE if once else STEP, v)

    def text(self) -> str:
        """The text of a whole conversation: what is still open is decided from the start on."""
        out = []
        for kind, texts in self.parts:
            v = "".join(texts)
            if kind == IF_UNSAID:
                out[:] = ["".join(out)]
                if v in out[0]:
                    continue
            out.append(v)
        return "".join(out)


def _fold_runs(kind: pa.DataType):
    def rows(done: list, first: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([c for c, _ in done], kind), pa.array(range(first, first + len(done)), pa.int64()),
            pa.array([s.n for _, s in done], pa.int64()), pa.array([[k for k, _ in s.parts] for _, s in done], pa.list_(pa.int32())),
            pa.array([["".join(t) for _, t in s.parts] for _, s in done], pa.list_(pa.string())),
            pa.array([s.sql for _, s in done], pa.string()), pa.array([s.chart for _, s in done], pa.string()),
            pa.array([[o for o, _ in s.steps] for _, s in done], pa.list_(pa.bool_())),
            pa.array([[v for _, v in s.steps] for _, s in done], pa.list_(pa.string()))],
            names=["conv", "piece", "n", "kinds", "texts", "sql", "chart", "once", "steps"])

    def run(batches):
        piece = TaskContext.get().partitionId() << 32                # runs are numbered in order: partitions are ranges
        done, now, state = [], None, None
        for batch in batches:
            conv, ops = batch.column(0).to_pylist(), batch.column(1)
            off = ops.offsets.to_pylist()
            each = ops.flatten()
            op, value = each.field("op").to_pylist(), each.field("v").to_pylist()
            off = [o - off[0] for o in off]
            for i, c in enumerate(conv):
                if state is None or c != now or state.n >= PIECE_EVENTS or state.chars >= PIECE_CHARS:
                    if state is not None:
                        done.append((now, state))
                    now, state = c, Partial()
                    if len(done) >= 1_000 or sum(s.chars for _, s in done[-1:]) >= PIECE_CHARS:
                        yield rows(done, piece)
                        piece, done = piece + len(done), []
                state.n += 1
                for j in range(off[i], off[i + 1]):
                    state.add(op[j], value[j])
        if state is not None:
            yield rows([*done, (now, state)], piece)
    return run


def _finish(kind: pa.DataType):
    def rows(done: list) -> pa.RecordBatch:
        steps = [[v for _, v in s.steps] + ["sql_execution"] * (s.sql != "") for _, s in done]
        return pa.RecordBatch.from_arrays([
            pa.array([c for c, _ in done], kind), pa.array([s.text() for _, s in done], pa.string()),
            pa.array([s.sql for _, s in done], pa.string()), pa.array([s.chart for _, s in done], pa.string()),
            pa.array([",".join(s) for s in steps], pa.string()), pa.array([s.n for _, s in done], pa.int64())],
            names=["conv", "text", "sql", "chart_spec", "steps", "n_events"])

    def run(batches):
        now, state, done = None, None, []
        for batch in batches:
            for r in batch.to_pylist():
                if state is None or r["conv"] != now:
                    if state is not None:
                        done.append((now, state))
                    if len(done) >= 1_000 or done and done[-1][1].chars >= PIECE_CHARS:
                        yield rows(done)
                        done = []
                    now, state = r["conv"], Partial()
                state.merge(r["n"], zip(r["kinds"], r["texts"]), r["sql"], r["chart"], zip(r["once"], r["steps"]))
        if state is not None:
            yield rows([*done, (now, state)])
    return run


def fold_events(log: DataFrame, conv_col: str = "conv_id", seq_cols: list[str] | None = None,
                event_col: str = "event", data_col: str = "data") -> DataFrame:
    """Fold an event log ``(conv, seq.., event, data JSON)`` into ``(conv, text, sql, chart_spec,
    steps, n_events)``.

    All eleven kinds count. Each event becomes a list of operations, and a conversation's operations are applied in order:

    * ``text``: text, analyst and message deltas and ``"\\nErrore: " || message`` (the whole data
      without a message) are added; a final text counts only while the text is empty; a tool result's
      text (its SQL may also stand flat in the data) is added unless the text already holds it, wherever in the text
      and across whatever parts;
    * ``sql``, ``chart_spec``: the last non-empty one (the first chart of a tool result's list);
    * ``steps``: step kinds in order, comma-joined (``thinking``, ``response`` and a chart event's
      ``chart`` only if not yet there), then ``sql_execution`` when an SQL was seen.

    Inline base64 images in the text are replaced by a placeholder (F21). Data that is not JSON or null
    counts as empty; null ids form one conversation; events equal in ``seq`` are ordered by kind and data.

    The log is sorted by range of (conversation, seq), so a long conversation is spread over tasks; each run of its events
    becomes one :class:`Partial` state in linear time, and a conversation's few states are merged. Only the text that is
    the result meets in one place; what is still open there (distinct texts to be said once) is looked up in it at memory
    speed. The log is read twice (ranges, then rows): give a stored one.
    """
    seq_cols = seq_cols or ["seq"]
    parts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = log.schema[conv_col].dataType
    arrow, name = to_arrow_type(kind), kind.simpleString()
    order = [F.col(c) for c in (conv_col, *seq_cols, event_col, data_col)]
    e = log.select(*dict.fromkeys([conv_col, *seq_cols, event_col, data_col])).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    e = e.select(conv_col, F.col(event_col).alias("_event"), F.col(data_col).alias("_raw"), F.from_json(F.col(data_col), EVENT_DATA).alias("_data"))
    ops = e.select(F.col(conv_col).alias("conv"), event_ops(F.col("_event"), F.col("_data"), F.coalesce("_raw", F.lit(""))).alias("ops"))
    runs = ops.mapInArrow(_fold_runs(arrow), f"conv {name}, piece long, n long, kinds array<int>, texts array<string>, sql string, "
                                             "chart string, once array<boolean>, steps array<string>")
    whole = (runs.repartition(parts, "conv").sortWithinPartitions("conv", "piece")
             .mapInArrow(_finish(arrow), f"conv {name}, text string, sql string, chart_spec string, steps string, n_events long"))
    return whole.select(F.col("conv").alias(conv_col), strip_inline_images(F.col("text")).alias("text"), "sql", "chart_spec", "steps", "n_events")


NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def chart_kind(df: DataFrame) -> tuple[str, list[str], list[str]]:
    """C3 shape rule from the schema: text + 2 or more numbers -> grouped bars (at most 4 series);
    text + 1 number -> horizontal bars; 2 or more numbers, no text -> line; else none."""
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]
    txt = [f.name for f in df.schema.fields if f.name not in num]
    if txt and len(num) >= 2:
        return "grouped_bar", txt, num[:4]
    if txt and len(num) == 1:
        return "hbar", txt, num
    if len(num) >= 2:
        return "line", [], num[:2]
    return "none", txt, num


def chart_series(df: DataFrame, order_by: list[str], max_rows: int | None = None) -> DataFrame:
    """Long-form series ``(chart, row_no, x, series, value)`` of every row of ``df``.

    Rows are numbered in parallel (:func:`assign_ids`; ``order_by`` is unique per row). A caller that
    can show only so many points passes ``max_rows``: an ordered ``limit`` on the cluster. ``x`` is the first text column (for a line
    chart the first number), ``series`` the numeric column name, ``value`` a double.
    """
    kind, txt, num = chart_kind(df)
    top = assign_ids(df if max_rows is None else df.orderBy(*order_by).limit(max_rows), order_by, 0, "row_no")
    if kind == "line":
        x = F.col(num[0]).cast("string")
        series = num[1:]
    else:
        x = F.col(txt[0]).cast("string") if txt else F.lit(None).cast("string")
        series = num
    base = top.select(F.lit(kind).alias("chart"), "row_no", x.alias("x"),
                      *[F.col(c).cast("double").alias(c) for c in series])
    return base.unpivot(["chart", "row_no", "x"], series, "series", "value")


# Words that ask for a chart in a request (same list as the P12 intent flag).
CHART_WORDS = ["grafico", "chart", "visualizza", "mostra", "plot", "istogramma", "torta", "barre"]


def wants_chart(request: str) -> bool:
    """P12 for one request held by the caller (the same rule the intent query applies to a column)."""
    low = request.lower()
    return any(w in low for w in CHART_WORDS)


def respond(df: DataFrame, request: str, order_by: list[str], max_rows: int = 50) -> tuple[str, DataFrame]:
    """Entry point A after the query ran: chart series (C3) when the request asks for a chart, else the first
    ``max_rows`` rows. Returns ``(kind, DataFrame)`` with kind ``"chart:<shape>"`` or ``"table"``: a chart gets its
    whole series, which may be long, so fetching it is the caller's choice (S9)."""
    if wants_chart(request):
        return f"chart:{chart_kind(df)[0]}", chart_series(df, order_by).orderBy("row_no", "series")
    return "table", df.orderBy(*order_by).limit(max_rows)
