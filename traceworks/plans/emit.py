"""Ledger events built from plain rows, and pipeline runs mirrored into them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceworks.functions.redact import mask_credentials, summarise, text_hash

# Columns of a ledger row.
LEDGER_COLUMNS = [
    "trace_id", "parent_trace_id", "tenant_id", "workspace_id", "user_id", "session_id", "request_id",
    "event_type", "event_timestamp", "actor_type", "actor_id", "datasource_type", "datasource_name",
    "model_name", "tool_name", "agent_name", "policy_result", "question_text", "sql_text",
    "sensitivity_level", "pii_detected", "pii_fields", "ai_action_summary", "boundary_violated", "risk_flags",
    "sql_hash", "prompt_hash", "context_refs", "status", "error_code", "error_message", "etl_run_id",
]
BOOLEANS = {"pii_detected", "boundary_violated"}


@dataclass(frozen=True)
class Kind:
    """How one kind of event is filled: SQL expressions over the input row."""

    event_type: str
    actor_type: str
    actor_id: str
    summary: str | None = None
    status: str | None = None
    fixed: tuple[tuple[str, str], ...] = ()


# Event kinds with their actors and defaults.
KINDS = {
    "request_received": Kind("'request_received'", "user", "coalesce(nullif(actor_id, ''), user_id)"),
    "sql_generated": Kind("'sql_generated'", "assistant", "coalesce(model_name, 'llm')",
                          "concat('Generated SQL for ', coalesce(datasource_name, 'datasource'))"),
    "sql_validated": Kind("if(status = 'ok', 'sql_validated', 'sql_blocked')", "system", "'sql_validator'",
                          "concat('SQL validation: ', policy_result)"),
    "sql_executed": Kind("'sql_executed'", "tool", "'sql_executor'",
                         "coalesce(ai_action_summary, concat('Executed SQL on ', coalesce(datasource_name, 'datasource')))"),
    "policy_check": Kind("if(passed, 'policy_check_passed', 'policy_check_failed')", "system", "'policy_engine'",
                         status="if(passed, 'ok', 'blocked')"),
    "model_invoked": Kind("'model_invoked'", "assistant", "model_name"),
    "tool_invoked": Kind("'tool_invoked'", "tool", "tool_name"),
    "human_feedback": Kind("'human_feedback_received'", "user", "user_id"),
    "agent_action": Kind("'agent_action'", "agent", "agent_name"),
    "agent_boundary_violation": Kind(
        "'agent_boundary_violation'", "agent", "agent_name", status="'violation'",
        fixed=(("boundary_violated", "true"), ("risk_flags", "coalesce(risk_flags, '[\"BOUNDARY_VIOLATION\"]')"))),
    "response_returned": Kind("'response_returned'", "system", "actor_id"),
}
EXTRA_INPUTS = {"passed": "boolean", "prompt_text": "string"}


def _made(what: str, kind: str, given: Column) -> Column:
    """An id in the usual form of 8, 4, 4, 4 and 12 hexadecimal digits, from what a row says."""
    digest = F.sha2(F.concat_ws("|", F.lit(what), F.lit(kind), given), 256)
    return F.concat_ws("-", *[F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


#: Made once per row, whatever the kinds: texts with typed credentials masked, the error text, hashes.
SHARED = {"question_text": "_question", "sql_text": "_sql", "sql_hash": "_sql_hash", "prompt_hash": "_prompt_hash",
          "error_message": "_error"}
KNOWN = dict.fromkeys(LEDGER_COLUMNS, "string") | {c: "boolean" for c in BOOLEANS} | EXTRA_INPUTS


def _unnamed() -> Column:
    """Whether a row lacks one of its ids."""
    return F.col("trace_id").isNull() | F.col("request_id").isNull() | (F.col("request_id") == "")


def _prepared(rows: DataFrame) -> DataFrame:
    """Rows with every column that a kind may read, and the columns that no kind changes; what a row says only where it needs an id."""
    for name, dtype in KNOWN.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(dtype))
    rows = rows.withColumn("status", F.coalesce("status", F.lit("ok")))
    made = rows.withColumns({
        "_given": F.when(_unnamed(), F.to_json(F.struct(*[F.col(c) for c in KNOWN]))),
        "_question": mask_credentials(F.col("question_text")),
        "_sql": mask_credentials(F.col("sql_text")),
        "_prompt_hash": text_hash(F.col("prompt_text")),
        "_error": summarise(F.col("error_message"), 500)})
    return made.withColumns({"_sql_hash": text_hash(F.col("_sql")), "_error": F.nullif("_error", F.lit(""))})


def _filled(kind: str, columns: list[str], named: bool = False) -> list[Column]:
    """Ledger columns of one kind over prepared rows, all of which have their ids if ``named``."""
    k = KINDS[kind]
    given = F.col("_given")
    values: dict[str, Column] = {c: F.col(SHARED.get(c, c)) for c in LEDGER_COLUMNS}
    if not named:
        values["trace_id"] = F.coalesce("trace_id", _made("trace", kind, given))
        values["request_id"] = F.coalesce(F.nullif("request_id", F.lit("")), _made("request", kind, given))
    values |= {
        "event_timestamp": F.coalesce("event_timestamp", F.date_format(
            F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")),
        "event_type": F.expr(k.event_type),
        "actor_type": F.lit(k.actor_type),
        "actor_id": F.expr(k.actor_id),
    }
    if k.summary:
        values["ai_action_summary"] = F.expr(k.summary)
    if k.status:
        values["status"] = F.expr(k.status)
    for name, expr in k.fixed:
        values[name] = F.expr(expr)
    return [values[c].cast(KNOWN[c]).alias(c) for c in columns]


def to_trace_events(rows: DataFrame, kind: str) -> DataFrame:
    """Rows as ledger events of one kind.

    Ids and times are taken from the rows where given, else made here: an id
    is a hash of the row's own values, so a task that runs again, or a batch
    that is sent again, makes the same id and the first write wins. Typed
    credentials are masked in question and SQL before they are hashed.
    """
    return _prepared(rows).select(*_filled(kind, LEDGER_COLUMNS))


def events_of_kinds(rows: DataFrame, kinds: list[str], columns: list[str] = LEDGER_COLUMNS) -> DataFrame:
    """Every row as one event of each kind, as :func:`to_trace_events` makes them, with the ``kind`` in front.

    Masking and hashing are done once per row, not once per event. Rows without an id are a branch of their own, so
    that the others are not turned to JSON and their code stays short.
    """
    def made(part: DataFrame, named: bool) -> DataFrame:
        return part.select(F.inline(F.array(*[
            F.struct(F.lit(k).alias("kind"), *_filled(k, columns, named)) for k in kinds])))

    rows = _prepared(rows)
    return made(rows.where(~_unnamed()), True).unionByName(made(rows.where(_unnamed()), False))


def mirrored_runs(runs: DataFrame) -> DataFrame:
    """Each pipeline run as ledger events: request, tool call, generated SQL
    (when there is one) and response, in that order.

    ``runs`` has tenant_id, workspace_id, user_id, session_id, run_id,
    started_at, request, status, compliance_status, llm_model, generated_sql.
    """
    request_id = F.concat(F.lit("req-"), F.col("run_id"))
    root = F.concat(request_id, F.lit("-0"))
    good = F.col("status").isin("completed", "ok")
    outcome = F.when(good, "ok").otherwise("failed")

    def event(i: int, kind: str, **columns: Column) -> Column:
        names = ["actor_id", "model_name", "tool_name", "datasource_type", "datasource_name", "question_text",
                 "sql_text", "ai_action_summary", "status", "etl_run_id"]
        return F.struct(
            F.lit(kind).alias("kind"), F.concat(request_id, F.lit(f"-{i}")).alias("trace_id"),
            (F.lit(None).cast("string") if i == 0 else root).alias("parent_trace_id"),
            *[columns.get(n, F.lit(None)).cast("string").alias(n) for n in names])

    run = F.col("run_id")
    events = F.array(
        event(0, "request_received", question_text=F.col("request"), actor_id=F.col("user_id")),
        event(1, "tool_invoked", tool_name=F.lit("run_etl_pipeline"), etl_run_id=run, status=outcome,
              actor_id=F.lit("etl_agent_swarm"),
              ai_action_summary=F.concat(F.lit("compliance="), F.col("compliance_status"),
                                         F.lit(" status="), F.col("status"))),
        F.when(F.col("generated_sql").isNotNull(),
               event(2, "sql_generated", sql_text=F.col("generated_sql"), model_name=F.col("llm_model"), etl_run_id=run,
                     datasource_name=F.lit("duckdb_etl"), datasource_type=F.lit("duckdb"))),
        event(3, "response_returned", actor_id=F.lit("etl_pipeline"), etl_run_id=run, status=outcome,
              ai_action_summary=F.col("compliance_status")))
    rows = runs.select(
        "tenant_id", "workspace_id", "user_id", "session_id", request_id.alias("request_id"),
        F.col("started_at").alias("event_timestamp"),
        F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select("*", "e.*").drop("e")
    out = None
    for kind in ("request_received", "tool_invoked", "sql_generated", "response_returned"):
        part = to_trace_events(rows.where(F.col("kind") == kind).drop("kind"), kind)
        out = part if out is None else out.unionByName(part)
    return out
