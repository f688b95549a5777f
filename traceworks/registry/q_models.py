"""Data tests of all models, every kind of ledger event, every audit table, bars of price services."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceworks import fixtures as fx
from traceworks.functions import redact
from traceworks.operators import indicators as ind
from traceworks.plans import data_tests, emit
from traceworks.registry.base import ORACLES, query
from traceworks.registry.q_ledger import staged
from traceworks.registry.q_market import clean_sql
from traceworks.registry.q_quality import _mask_sql, _summarise_sql
from traceworks.sources import bar_rows, sinks

RAW = f"({fx.TRACE_EVENTS_SQL})"


# Data tests -------------------------------------------------------------------------
def _count_sql(t) -> str:
    if t.kind == "unique":
        return f"(select count(*) from (select {t.column} from m where {t.column} is not null group by 1 having count(*) > 1))"
    if t.kind == "not_null":
        return f"(select count(*) from m where {t.column} is null)"
    return f"(select count(*) from m where {t.column} not in {t.values!r})"


def _tests_sql(model: str, source: str, tests) -> str:
    rows = " union all ".join(f"select '{model}' as model, '{t.name}' as test, '{t.column}' as column_name, "
                              f"{_count_sql(t)} as failures" for t in tests)
    return f"(with m as materialized ({source}) {rows})"


_ORACLE_OF = {name.split("_", 1)[1]: sql for name, sql in ORACLES.items()}


@query("m30_all_model_tests", "select * from " + " union all select * from ".join(
    _tests_sql(m, _ORACLE_OF[m], tests) for m, tests in data_tests.MODEL_TESTS.items()))
def _(spark, sf):
    return data_tests.model_results(staged(spark, sf))


@query("m30_source_tests", "select * exclude (model) from " + _tests_sql("", f"select * from {RAW}", data_tests.SOURCE_TESTS))
def _(spark, sf):
    return data_tests.source_results(fx.trace_events(spark, sf))


# Ledger events ----------------------------------------------------------------------
_FILLED = ["trace_id", "request_id", "event_type", "actor_type", "actor_id", "ai_action_summary", "status",
           "boundary_violated", "risk_flags", "sql_hash", "prompt_hash", "error_message"]
#: Per kind: event type, actor type, actor, summary, status, boundary flag, risk flags.
_DEFAULTS = ("ai_action_summary", "coalesce(status, 'ok')", "boundary_violated", "risk_flags")
_KINDS_SQL = {
    "request_received": ("'request_received'", "'user'", "case when actor_id <> '' then actor_id else user_id end", *_DEFAULTS),
    "sql_generated": ("'sql_generated'", "'assistant'", "coalesce(model_name, 'llm')",
                      "'Generated SQL for ' || coalesce(datasource_name, 'datasource')", *_DEFAULTS[1:]),
    "sql_validated": ("case when status = 'ok' then 'sql_validated' else 'sql_blocked' end", "'system'", "'sql_validator'",
                      "'SQL validation: ' || policy_result", *_DEFAULTS[1:]),
    "sql_executed": ("'sql_executed'", "'tool'", "'sql_executor'", "coalesce(ai_action_summary, 'Executed SQL on ' "
                     "|| coalesce(datasource_name, 'datasource'))", *_DEFAULTS[1:]),
    "policy_check": ("case when passed then 'policy_check_passed' else 'policy_check_failed' end", "'system'",
                     "'policy_engine'", "ai_action_summary", "case when passed then 'ok' else 'blocked' end", *_DEFAULTS[2:]),
    "model_invoked": ("'model_invoked'", "'assistant'", "model_name", *_DEFAULTS),
    "tool_invoked": ("'tool_invoked'", "'tool'", "tool_name", *_DEFAULTS),
    "human_feedback": ("'human_feedback_received'", "'user'", "user_id", *_DEFAULTS),
    "agent_action": ("'agent_action'", "'agent'", "agent_name", *_DEFAULTS),
    "agent_boundary_violation": ("'agent_boundary_violation'", "'agent'", "agent_name", "ai_action_summary", "'violation'",
                                 "true", """coalesce(risk_flags, '["BOUNDARY_VIOLATION"]')"""),
    "response_returned": ("'response_returned'", "'system'", "actor_id", *_DEFAULTS),
}


def _kind_sql(kind: str) -> str:
    names = ["event_type", "actor_type", "actor_id", "ai_action_summary", "status", "boundary_violated", "risk_flags"]
    made = ", ".join(f"{e} as {n}" for e, n in zip(_KINDS_SQL[kind], names))
    masked = _mask_sql("sql_text", redact.CREDENTIAL_PATTERNS)
    return f"""select '{kind}' as kind, trace_id, request_id, {made}, sha256(nullif({masked}, '')) as sql_hash,
      sha256(nullif(prompt_text, '')) as prompt_hash, nullif({_summarise_sql('error_message', 500)}, '') as error_message from given"""


@query("s31_all_event_kinds", f"""with given as (select *, error_code is null as passed,
  case when event_type = 'model_invoked' then question_text || 'prompt' end as prompt_text from {RAW}
  where request_id <> '') """ + " union all ".join(map(_kind_sql, _KINDS_SQL)))
def _(spark, sf):
    given = fx.trace_events(spark, sf).where("request_id <> ''").withColumns({
        "passed": F.col("error_code").isNull(),
        "prompt_text": F.expr("if(event_type = 'model_invoked', question_text || 'prompt', null)")})
    return emit.events_of_kinds(given, list(emit.KINDS), _FILLED)


# Audit tables -----------------------------------------------------------------------
_RUN_LISTS = {
    "pii_columns": "case when pii_columns_count > 3 then 'email,ssn' else 'phone' end",
    "high_risk_columns": "case when pii_columns_count > 5 then 'ssn' end",
    "masked_columns": "case when masked_columns_count > 0 then 'email' end",
    "quality_issues": "case when failed_steps > 0 then 'failed steps' end",
    "pipeline_status": "status", "timestamp": "started_at",
}
#: Per audit table: the rows it is filled from and the columns that are named otherwise there.
_AUDIT_ROWS = {
    "etl_pipeline_runs": ("runs", {}),
    "etl_agent_steps": ("steps", {"tool_args_json": "repeat(step_id, 20)", "result_preview": "repeat(step_id, 40)"}),
    "etl_data_mutations": ("mutations", {"timestamp": "mutated_at", "rows_affected": "abs(rows_after - rows_before)"}),
    "etl_llm_calls": ("llm_calls", {"timestamp": "call_ts", "total_tokens": "prompt_tokens + completion_tokens"}),
    "etl_compliance_events": ("compliance_events", {"timestamp": "event_ts"}),
    "etl_audit_log": ("runs", _RUN_LISTS),
}


def _audit_table_sql(name: str) -> str:
    source, more = _AUDIT_ROWS[name]
    columns = [c.split()[0] for c in sinks.AUDIT_SCHEMAS[name].split(",")]
    given = {c for c, _ in fx._AUDIT[source][1]} | set(more)
    limits = {"tool_args_json": 200, "result_preview": 500, "error_message": 500}
    cells = [f"{c}[:{limits[c]}] as {c}" if c in limits and c in given else c if c in given else f"null as {c}" for c in columns]
    extra = "".join(f", {e} as {c}" for c, e in more.items())
    return f"select {', '.join(cells)} from (select *{extra} from ({fx.audit_sql(source)}))"


def _register_audit(name: str) -> None:
    @query(f"s22_{name}", _audit_table_sql(name))
    def _(spark, sf):
        """Two appends: every second run first."""
        source, more = _AUDIT_ROWS[name]
        rows = fx.audit_table(spark, sf, source).selectExpr("*", *[f"{e} as {c}" for c, e in more.items()])
        path = sinks.scratch_path(spark, name)
        late = F.pmod(F.hash("run_id"), F.lit(2)) == 1
        sinks.append_audit(rows.where(~late), name, path)
        sinks.append_audit(rows.where(late), name, path)
        return spark.read.schema(sinks.AUDIT_SCHEMAS[name]).parquet(path)


for _name in _AUDIT_ROWS:
    _register_audit(_name)


# Bars of price services -------------------------------------------------------------
_DATED = f"""(select ticker, tf, ts, open, high, low, a as close, volume from (
  select *, case when day(ts) = 13 then null else close / 2 end as a from ({fx.DAILY_BARS_SQL})) where a is not null)"""


@query("v03_adjusted_close", f"select * from {clean_sql(_DATED)}")
def _(spark, sf):
    rows = fx.daily_bars(spark, sf).withColumns({
        "date": F.date_format("ts", "yyyy-MM-dd"),
        "adjusted_close": F.expr("case when day(ts) = 13 then null else close / 2 end")}).drop("ts", "tf")
    return ind.clean_bars(bar_rows.dated_bars(rows))


@query("v03_epoch_bars", f"select * from {clean_sql(f'({fx.INTRADAY_BARS_SQL})')} where tf = '1h'")
def _(spark, sf):
    rows = fx.intraday_bars(spark, sf).where("tf = '1h'").selectExpr(
        "ticker", "unix_millis(cast(ts as timestamp)) as t", "open as o", "high as h", "low as l", "close as c", "volume as v")
    return ind.clean_bars(bar_rows.epoch_bars(rows, "1h"))
