"""One result row per input, failures isolated per row, stderr means failure."""
from pyspark.sql import functions as F

from voltaic.operators.udf import complete, register_function, result_fields, run_rows


def test_failing_rows_are_isolated(spark):
    df = spark.createDataFrame([(i, '{"k": %d}' % i) for i in range(1, 22)], "idx long, code string")
    out = run_rows(df, "idx", "code", "inverse_k").select("idx", *result_fields()).collect()
    assert len(out) == 21
    bad = {r.idx for r in out if not r.success}
    assert bad == {7, 14, 21}
    assert all("ZeroDivisionError" in r.error for r in out if not r.success)
    assert {r.output for r in out if r.idx == 1} == {"100"}


def test_stderr_marks_failure(spark):
    df = spark.createDataFrame([(i, '{"k": %d}' % i) for i in range(4)], "idx long, code string")
    out = {r.idx: r for r in run_rows(df, "idx", "code", "warn_on_even").select("idx", *result_fields()).collect()}
    assert not out[0].success and "even k=0" in out[0].error
    assert out[1].success and out[1].output == "1"


def test_timeout_marks_failure(spark):
    import time

    def slow(x):
        time.sleep(float(x))
        return "done"
    register_function("slow_for_test", slow)
    df = spark.createDataFrame([(0, "0"), (1, "3"), (2, "0.1")], "idx long, code string").coalesce(1)
    out = {r.idx: r for r in run_rows(df, "idx", "code", "slow_for_test", timeout=1.0)
           .select("idx", *result_fields()).collect()}
    assert out[0].success and not out[1].success and "timed out" in out[1].error
    assert out[2].success  # the row after a timed-out one does not wait behind it


def test_completion_scores_distinct_prompts_once(spark):
    df = spark.createDataFrame([(1, "urgent: no power"), (2, "urgent: no power"), (3, "thanks")], "id long, p string")
    out = {r.id: r.completion for r in complete(df, "p").collect()}
    assert out[1] == out[2] and out[1].startswith("1) MEDIUM") and out[3].startswith("1) LOW")


def test_event_fold_replaces_inline_images_and_appends_errors(spark):
    from voltaic.operators.conversation import fold_events
    log = spark.createDataFrame([
        (1, 1, "response.text.delta", '{"text": "see ![c](data:image/png;base64,AAAA) here"}'),
        (1, 2, "error", '{"message": "boom"}'),
        (1, 3, "response.tool_result", '{"sql": "SELECT 1"}'),
        (2, 1, "response.text", '{"text": "final only"}'),
        (2, 2, "response.thinking.delta", '{"text": "hmm"}'),
        (2, 3, "response.thinking.delta", '{"text": "more"}'),
    ], "conv_id long, seq long, event string, data string")
    out = {r.conv_id: r for r in fold_events(log).collect()}
    assert out[1].text == "see [Grafico visualizzato sopra] here\nErrore: boom"
    assert out[1].sql == "SELECT 1"
    assert out[1].steps == "response,error,sql_generation,sql_execution"
    assert out[2].text == "final only" and out[2].steps == "thinking" and out[2].sql == ""


def test_event_fold_reads_every_kind(spark):
    from voltaic.operators.conversation import fold_events
    nested = '{"content": [{"type": "json", "json": {"sql": "SELECT 2", "text": "found", "charts": [{"mark": "bar"}]}}]}'
    log = spark.createDataFrame([
        (1, 1, "response.tool_use", '{"name": "Ricerca_Contratti"}'),
        (1, 2, "response.tool_result", nested), (1, 3, "response.tool_result", nested),
        (1, 4, "response.chart", '{"chart_spec": ""}'),
        (1, 5, "response.tool_result.analyst.delta", '{"delta": {"sql": "SELECT 3", "text": " more"}}'),
        (1, 6, "message.delta", '{"delta": {"content": [{"type": "text", "text": " end"}, {"type": "tool_results", '
                                '"tool_results": {"content": [{"type": "json", "json": {"sql": "SELECT 4", "text": "!"}}]}}]}}'),
        (1, 7, "response", '{"content": [{"type": "text", "text": "late"}]}'),
        (2, 1, "response", '{"content": [{"type": "text", "text": "whole"}, {"type": "chart", "chart": {"chart_spec": "spec"}}]}'),
        (2, 2, "response.text", '{"text": "ignored"}'), (2, 3, "unknown", None), (2, 4, "error", "{}"),
        (3, 1, "response.status", "not json"),
    ], "conv_id long, seq long, event string, data string")
    out = {r.conv_id: r for r in fold_events(log).collect()}
    assert out[1].text == "found more end!" and out[1].sql == "SELECT 4" and out[1].chart_spec == '{"mark":"bar"}'
    assert out[1].steps == "search,sql_generation,chart,sql_generation,chart,sql_execution"
    assert out[2].text == "whole\nErrore: {}" and out[2].chart_spec == "spec" and out[2].steps == "error"
    assert (out[3].text, out[3].steps, out[3].n_events) == ("", "", 1)


def test_event_log_of_the_queries_uses_every_kind(spark, sf_dir):
    from voltaic.plans.conversation import event_log
    assert event_log(spark, sf_dir).select("event").distinct().count() == 11
