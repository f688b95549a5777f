"""Ledger search, request replay and first-versus-corrected SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceworks.functions.times import millis_between, parse_ts
from traceworks.operators.sliced import sequence_in_group
from traceworks.plans.ledger import SQL_EVENTS

# Event kinds of the replay views.
TOOL_CHAIN = ["model_invoked", "tool_invoked"]
POLICY_DECISIONS = ["policy_check_started", "policy_check_passed", "policy_check_failed"]
FEEDBACK = "human_feedback_received"
REPLAY_ERRORS = ["failed", "blocked"]


def search(events: DataFrame, tenant_id: str, *, user_id=None, workspace_id=None, event_type=None, datasource=None,
           status=None, sensitivity_level=None, pii_detected=None, from_ts=None, to_ts=None, etl_run_id=None,
           limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest matching events of one tenant. All predicates reach the scan."""
    equal = {"tenant_id": tenant_id, "user_id": user_id, "workspace_id": workspace_id, "event_type": event_type,
             "datasource_name": datasource, "status": status, "sensitivity_level": sensitivity_level,
             "etl_run_id": etl_run_id}
    out = events
    for name, value in equal.items():
        if value:
            out = out.where(F.col(name) == value)
    if pii_detected is not None:
        out = out.where(F.col("pii_detected") == pii_detected)
    if from_ts:
        out = out.where(F.col("event_timestamp") >= from_ts)
    if to_ts:
        out = out.where(F.col("event_timestamp") <= to_ts)
    return out.orderBy(F.desc("event_timestamp"), "trace_id").limit(limit + offset).offset(offset)


def by_trace(events: DataFrame, trace_id: str) -> DataFrame:
    return events.where(F.col("trace_id") == trace_id)


def by_session(events: DataFrame, tenant_id: str, session_id: str, limit: int = 200) -> DataFrame:
    scope = events.where((F.col("tenant_id") == tenant_id) & (F.col("session_id") == session_id))
    return scope.orderBy("event_timestamp", "trace_id").limit(limit)


def by_request(events: DataFrame, tenant_id: str, request_id: str) -> DataFrame:
    scope = events.where((F.col("tenant_id") == tenant_id) & (F.col("request_id") == request_id))
    return scope.orderBy("event_timestamp", "trace_id")


def tenant_count(events: DataFrame, tenant_id: str) -> DataFrame:
    return events.where(F.col("tenant_id") == tenant_id).agg(F.count("*").alias("n"))


def label() -> Column:
    base = F.initcap(F.replace("event_type", F.lit("_"), F.lit(" ")))
    return (F.when(F.col("tool_name") != "", F.concat(base, F.lit(" ("), F.col("tool_name"), F.lit(")")))
            .when(F.col("model_name") != "", F.concat(base, F.lit(" — "), F.col("model_name"))).otherwise(base))


def replay(events: DataFrame) -> DataFrame:
    """Ordered events of every request with the gap to the one before.

    ``events`` is the raw ledger. The error flag is narrower than the
    ledger's: failed or blocked only.
    """
    typed = events.withColumn("ts", parse_ts("event_timestamp"))
    seq = sequence_in_group(typed, ["tenant_id", "request_id"], "ts", "trace_id")
    return seq.withColumns({
        "duration_ms": millis_between(F.col("prev_ts"), F.col("ts")),
        "label": label(),
        "is_sql": F.col("event_type").isin(SQL_EVENTS),
        "is_error": F.col("status").isin(REPLAY_ERRORS),
        "summary": F.coalesce(F.nullif("output_summary", F.lit("")), F.nullif("input_summary", F.lit("")), F.lit("")),
    }).drop("group_start", "group_end", "prev_ts")


def cards(replayed: DataFrame) -> DataFrame:
    return replayed.select(
        "tenant_id", "request_id", "event_sequence", "label", "event_type", "status",
        F.col("actor_id").alias("actor"), F.col("event_timestamp").alias("timestamp"), "summary", "sql_hash",
        F.col("error_message").alias("error"), "duration_ms", "is_sql", "is_error",
        F.col("policy_result").alias("policy"))


def timeline_lines(replayed: DataFrame) -> DataFrame:
    """One text line per event, in replay order."""
    state = F.when(F.col("is_error"), F.upper("status")).otherwise(F.col("status"))
    gap = F.when(F.col("duration_ms") > 0, F.concat(F.lit(" +"), F.col("duration_ms").cast("string"), F.lit("ms"))).otherwise("")
    line = F.format_string(
        "%3d. %s  %-30s  %-20s  %-10s%10s  %s", "event_sequence", F.left("event_timestamp", F.lit(19)), "event_type",
        "actor_id", F.concat(F.lit("["), state, F.lit("]")), gap, F.left("summary", F.lit(80)))
    error = F.when(F.col("is_error") & (F.col("error_message") != ""),
                   F.concat(F.lit("\n      ERROR: "), F.left("error_message", F.lit(120)))).otherwise("")
    return replayed.select("tenant_id", "request_id", "event_sequence", F.concat(line, error).alias("line"))


def view(replayed: DataFrame, name: str) -> DataFrame:
    kinds = {"sql_chain": SQL_EVENTS, "tool_chain": TOOL_CHAIN, "policy_decisions": POLICY_DECISIONS,
             "human_corrections": [FEEDBACK]}
    return replayed.where(F.col("event_type").isin(kinds[name]))


def corrections(events: DataFrame) -> DataFrame:
    """First generated SQL of each request, and the first one generated after
    its first human feedback. Two map-side combined aggregations and an
    equality join; events are never gathered per request."""
    keys = ["tenant_id", "request_id"]
    typed = events.withColumn("ts", parse_ts("event_timestamp"))
    order = F.struct("ts", "trace_id")
    generated = F.col("event_type") == "sql_generated"
    first = typed.groupBy(*keys).agg(
        F.min_by("sql_hash", F.when(generated & F.col("ts").isNotNull(), order)).alias("first_sql_hash"),
        F.min(F.when(F.col("event_type") == FEEDBACK, F.col("ts"))).alias("feedback_at"),
        F.count_if(F.col("event_type") == FEEDBACK).alias("feedback_events"),
        F.count_if(F.col("event_type").isin(SQL_EVENTS)).alias("sql_events"))
    asked = first.where(F.col("feedback_at").isNotNull() & (F.col("sql_events") > 1)).select(
        *[F.col(k).alias(f"_{k}") for k in keys], "feedback_at")
    match = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    later = typed.where(generated).join(asked, match).where(F.col("ts") > F.col("feedback_at")).groupBy(*keys).agg(
        F.min_by("sql_hash", order).alias("corrected_sql_hash")).select(
        *[F.col(k).alias(f"_{k}") for k in keys], "corrected_sql_hash")
    return first.join(later, match, "left").select(
        *keys, "first_sql_hash", "corrected_sql_hash",
        F.col("corrected_sql_hash").isNotNull().alias("has_correction"), "feedback_events")


def flag_counts(staged: DataFrame, column: str) -> DataFrame:
    """Events per entry of a JSON list column."""
    items = staged.where(F.col(column).isNotNull()).select(
        "tenant_id", F.explode(F.from_json(column, "array<string>")).alias("item"))
    return items.groupBy("tenant_id", "item").agg(F.count("*").alias("events"))
