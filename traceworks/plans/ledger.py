"""Typed ledger view, request timeline and the request/session reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceworks.functions.times import day, millis_between, minutes_between, parse_ts
from traceworks.operators.aggregates import (
    distinct_counts, distinct_list, first_match, most_severe, rate_pct, safe, some, tally,
    vocabulary_size,
)
from traceworks.operators.sliced import ordered_texts, sequence_in_group, with_texts
from traceworks.sources.sinks import scratch_path, write_counted

# Event vocabularies the flags are defined over.
SQL_EVENTS = ["sql_generated", "sql_validated", "sql_blocked", "sql_executed"]
AGENT_EVENTS = ["agent_action", "agent_boundary_violation", "tool_invoked"]
ERROR_STATUSES = ["failed", "blocked", "violation"]
BLOCKING_STATUSES = ["blocked", "violation"]
BLOCKING_EVENTS = ["policy_check_failed", "agent_boundary_violation"]
VIOLATION_EVENTS = ["sql_blocked", "policy_check_failed", "agent_boundary_violation"]
HIGH_LEVELS = ["HIGH", "CRITICAL"]

REQUIRED = ["trace_id", "tenant_id", "user_id", "event_type"]


def kind(*names: str) -> Column:
    return F.col("event_type").isin(*names)


PII = "pii_detected"


def complete_rows(events: DataFrame) -> DataFrame:
    """Rows that carry every required identity field."""
    return events.dropna(subset=REQUIRED)


def with_flags(events: DataFrame) -> DataFrame:
    status, level = F.col("status"), F.col("sensitivity_level")
    return events.withColumns({
        "is_sql_event": safe(kind(*SQL_EVENTS)),
        "is_agent_event": safe(kind(*AGENT_EVENTS)),
        "is_error": safe(status.isin(ERROR_STATUSES)),
        "is_policy_blocked": safe(kind(*BLOCKING_EVENTS)) | safe(status.isin(BLOCKING_STATUSES)),
        "is_boundary_violation": safe(F.col("boundary_violated")),
        "is_high_sensitivity": safe(level.isin(HIGH_LEVELS)),
        "is_human_correction": safe(kind("human_feedback_received")),
    })


def staged_events(raw: DataFrame) -> DataFrame:
    """Typed, quality-filtered ledger with derived flags."""
    typed = complete_rows(raw).withColumn("event_timestamp", parse_ts("event_timestamp"))
    return with_flags(typed)


def request_timeline(staged: DataFrame) -> DataFrame:
    """Every event with its place and timing inside its request."""
    seq = sequence_in_group(staged, ["tenant_id", "request_id"], "event_timestamp", "trace_id")
    start, end = F.col("group_start"), F.col("group_end")
    return seq.withColumns({
        "request_started_at": start,
        "request_ended_at": end,
        "total_request_ms": millis_between(start, end),
        "ms_since_request_start": millis_between(start, F.col("event_timestamp")),
    }).drop("group_start", "group_end", "prev_ts")


BOUNDARY_RISKS = ("risk_flags", "is_boundary_violation", ", ")
AGENT_ACTIONS = ("ai_action_summary", "is_agent_event", " | ")


def in_event_order(staged: DataFrame, keys: list[str], **texts: tuple[str, str, str]) -> DataFrame:
    return ordered_texts(staged, keys, "event_timestamp", "trace_id", texts)


SESSION_KEYS = ["tenant_id", "workspace_id", "user_id", "session_id"]


def session_summary(staged: DataFrame) -> DataFrame:
    """One row per session with volume, governance counts and a risk level."""
    ts = F.col("event_timestamp")
    grouped = staged.groupBy(*SESSION_KEYS).agg(
        F.min(ts).alias("session_started_at"),
        F.max(ts).alias("session_last_activity_at"),
        minutes_between(F.min(ts), F.max(ts)).alias("session_duration_minutes"),
        F.count_distinct("request_id").alias("total_requests"),
        vocabulary_size("model_name").alias("distinct_models_used"),
        F.count("*").alias("total_events"),
        distinct_list("model_name").alias("models_used"),
        distinct_list("datasource_name").alias("datasources_accessed"),
        *tally(
            sql_events="is_sql_event",
            sql_generated_count=kind("sql_generated"),
            sql_executed_count=kind("sql_executed"),
            sql_blocked_count=kind("sql_blocked"),
            policy_blocks="is_policy_blocked",
            error_events="is_error",
            human_corrections="is_human_correction",
            agent_events="is_agent_event",
            boundary_violations="is_boundary_violation",
            high_sensitivity_events="is_high_sensitivity",
            pii_events=PII,
        ),
        first_match([
            (some("is_boundary_violation"), "CRITICAL"),
            (some(kind("sql_blocked")), "HIGH"),
            (some("is_policy_blocked or is_high_sensitivity or pii_detected"), "MEDIUM"),
            (some("is_error"), "LOW"),
        ], "NONE").alias("session_risk_level"),
    )
    risks = in_event_order(staged, SESSION_KEYS, boundary_violation_risks=BOUNDARY_RISKS)
    return with_texts(grouped, SESSION_KEYS, risks, ["boundary_violation_risks"])


REQUEST_KEYS = ["tenant_id", "workspace_id", "user_id", "session_id", "request_id", "etl_run_id"]


def request_summary(staged: DataFrame, one_row_per_request: bool = False) -> DataFrame:
    """Compliance record per request.

    The whole-request duration comes from the grouped rows, so the raw events
    are shuffled once, after map-side combining. ``one_row_per_request`` folds
    rows that differ only in ``etl_run_id``.
    """
    events = staged
    keys = REQUEST_KEYS
    if one_row_per_request:
        keys = [k for k in REQUEST_KEYS if k != "etl_run_id"]

    def newest(event: str, col: str) -> Column:
        return F.max(F.when(kind(event), F.col(col)))

    ts = F.col("event_timestamp")
    grouped = events.groupBy(*keys).agg(
        *([F.max("etl_run_id").alias("etl_run_id")] if one_row_per_request else []),
        F.min(ts).alias("request_started_at"),
        F.max(ts).alias("request_ended_at"),
        newest("request_received", "question_text").alias("question_text"),
        newest("sql_generated", "sql_text").alias("sql_generated_text"),
        newest("sql_executed", "sql_text").alias("sql_executed_text"),
        newest("sql_generated", "sql_hash").alias("sql_hash"),
        most_severe("sensitivity_level").alias("highest_sensitivity_level"),
        some(PII).cast("int").alias("pii_detected"),
        distinct_list("pii_fields").alias("all_pii_fields"),
        some("is_boundary_violation").cast("int").alias("boundary_violated"),
        F.max("model_name").alias("primary_model"),
        distinct_list("datasource_name").alias("datasources_touched"),
        F.max(F.when(F.col("is_policy_blocked"), F.col("error_message"))).alias("policy_block_reason"),
        *tally(
            agent_event_count="is_agent_event",
            sql_generated_count=kind("sql_generated"),
            sql_executed_count=kind("sql_executed"),
            sql_blocked_count=kind("sql_blocked"),
            policy_blocks="is_policy_blocked",
            error_count="is_error",
            human_corrections="is_human_correction",
        ),
    )
    level = F.col("highest_sensitivity_level")
    boundary = F.col("boundary_violated") > 0
    sql_blocked = F.col("sql_blocked_count") > 0
    errors = F.col("error_count") > 0
    # Rows without a request id would all meet in one window: they are spread, and their span is aggregated by tenant
    # and written, so that the planner knows how large that table is when it joins it.
    unnamed = F.col("request_id").isNull()
    request = Window.partitionBy("tenant_id", "request_id", F.when(unnamed, F.xxhash64(*keys)))
    spans = events.where(unnamed).groupBy(F.col("tenant_id").alias("_tenant")).agg(
        F.min(ts).alias("_from"), F.max(ts).alias("_to"))
    texts = in_event_order(events, keys, agent_actions_taken=AGENT_ACTIONS, boundary_violation_risks=BOUNDARY_RISKS)
    grouped = with_texts(grouped, keys, texts, ["agent_actions_taken", "boundary_violation_risks"])
    path = scratch_path(events.sparkSession, "spans")
    if write_counted(spans, path):
        spans = events.sparkSession.read.schema(spans.schema).parquet(path)
        grouped = grouped.join(spans, unnamed & F.col("tenant_id").eqNullSafe(F.col("_tenant")), "left")
    else:
        grouped = grouped.withColumns({c: F.lit(None).cast("timestamp_ntz") for c in ("_from", "_to")})
    return grouped.withColumns({
        "total_request_ms": millis_between(
            F.coalesce("_from", F.min("request_started_at").over(request)),
            F.coalesce("_to", F.max("request_ended_at").over(request))),
        "risk_level": first_match([
            (boundary | safe(level == "CRITICAL"), "CRITICAL"),
            (sql_blocked | (F.col("policy_blocks") > 0) | safe(level == "HIGH"), "HIGH"),
            (F.col("pii_detected") > 0, "MEDIUM"),
            (errors, "LOW"),
        ], "NONE"),
        "request_status": first_match(
            [(boundary, "violation"), (sql_blocked, "blocked"), (errors, "failed")], "ok"),
    }).drop("_tenant", "_from", "_to")


def policy_violations(staged: DataFrame) -> DataFrame:
    """Every blocked, failed or out-of-scope event, classified."""
    status = F.col("status")
    hits = staged.where(
        F.col("is_policy_blocked") | F.col("is_boundary_violation") | F.col("is_error")
        | kind(*VIOLATION_EVENTS)
    )
    return hits.select(
        "trace_id", "parent_trace_id", "tenant_id", "workspace_id", "user_id", "session_id",
        "request_id", "event_type", "event_timestamp", "actor_id", "datasource_type",
        "datasource_name", "model_name", "tool_name", "agent_name", "policy_result",
        "question_text", "sql_text", "sql_hash", "sensitivity_level", "pii_detected", "pii_fields",
        "ai_action_summary", "boundary_violated", "risk_flags", "status", "error_code",
        "error_message", "etl_run_id",
        first_match([
            (F.col("is_boundary_violation"), "AGENT_BOUNDARY_VIOLATION"),
            (kind("sql_blocked"), "SQL_BLOCKED"),
            (kind("policy_check_failed"), "POLICY_FAILED"),
            (status == "blocked", "ACTION_BLOCKED"),
            (status == "failed", "ACTION_FAILED"),
        ], "UNKNOWN").alias("violation_type"),
        day("event_timestamp").alias("violation_date"),
    )


def sql_risk_summary(staged: DataFrame) -> DataFrame:
    """SQL risk per user, datasource and day."""
    level = F.col("sensitivity_level")
    grouped = staged.where("is_sql_event").groupBy(
        "tenant_id", "workspace_id", "user_id", "datasource_type", "datasource_name",
        day("event_timestamp").alias("event_date"),
    ).agg(
        F.count("*").alias("total_sql_events"),
        *tally(
            sql_generated=kind("sql_generated"),
            sql_validated=kind("sql_validated"),
            sql_executed=kind("sql_executed"),
            sql_blocked=kind("sql_blocked"),
            critical_sensitivity_count=level == "CRITICAL",
            high_sensitivity_count=level == "HIGH",
            pii_event_count=PII,
            human_corrections="is_human_correction",
            errors="is_error",
        ),
        F.count_distinct("sql_hash").alias("distinct_sql_hashes"),
    )
    blocked = F.col("sql_blocked")
    return grouped.withColumns({
        "block_rate_pct": rate_pct(blocked, F.col("sql_generated")),
        "risk_level": first_match([
            (blocked > 5, "HIGH"),
            ((blocked > 0) | (F.col("critical_sensitivity_count") > 0)
             | (F.col("pii_event_count") > 0), "MEDIUM"),
            (F.col("errors") > 0, "LOW"),
        ], "NONE"),
    }).drop("errors")


def model_usage(staged: DataFrame) -> DataFrame:
    """Model invocations per user, model and day."""
    used = staged.where(kind("model_invoked") & F.col("model_name").isNotNull())
    return used.groupBy(
        "tenant_id", "workspace_id", "user_id", "model_name", day("event_timestamp").alias("usage_date"),
    ).agg(
        F.count("*").alias("invocations"),
        *distinct_counts(distinct_sessions="session_id", distinct_requests="request_id"),
        *tally(failed_invocations="is_error"),
        rate_pct(F.count_if("is_error"), F.count("*")).alias("failure_rate_pct"),
    )


def session_overview(staged: DataFrame) -> DataFrame:
    return session_summary(staged).drop("sql_events")
