"""Star schema over the ledger: dimensions, facts and their joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceworks.functions.times import day
from traceworks.operators.aggregates import (
    SENSITIVITY_LEVELS, distinct_counts, distinct_list, first_match, rate_pct, some, tally,
    vocabulary_size,
)
from traceworks.plans.ledger import PII, kind, request_summary

BOUNDARY, BLOCKED = "is_boundary_violation", "is_policy_blocked"


def level_is(level: str) -> str:
    return f"sensitivity_level = '{level}'"


def _seen(first: str, last: str):
    return [F.min("event_timestamp").alias(first), F.max("event_timestamp").alias(last)]


def _tier(third_signal):
    """Risk tier: scope breach, blocked SQL, a dimension-specific signal, personal data."""
    return first_match(
        [(some(BOUNDARY), "CRITICAL"), (some(kind("sql_blocked")), "HIGH"), third_signal,
         (some(PII), "MEDIUM")], "LOW")


def dim_users(staged: DataFrame) -> DataFrame:
    worst_first = [(some(level_is(level)), level) for level in reversed(SENSITIVITY_LEVELS)]
    return staged.groupBy("tenant_id", "workspace_id", "user_id").agg(
        *_seen("first_seen_at", "last_seen_at"),
        *distinct_counts(total_sessions="session_id", total_requests="request_id"),
        F.count("*").alias("total_events"),
        *tally(
            sql_generated_count=kind("sql_generated"),
            sql_executed_count=kind("sql_executed"),
            sql_blocked_count=kind("sql_blocked"),
            agent_events="is_agent_event",
            boundary_violations=BOUNDARY,
            high_sensitivity_events="is_high_sensitivity",
            pii_events=PII,
            policy_blocks=BLOCKED,
        ),
        first_match(worst_first, None).alias("highest_sensitivity_seen"),
        _tier((some(BLOCKED), "MEDIUM")).alias("user_risk_tier"),
    )


def dim_workspaces(staged: DataFrame) -> DataFrame:
    return staged.groupBy("tenant_id", "workspace_id").agg(
        *_seen("first_active_at", "last_active_at"),
        *distinct_counts(distinct_users="user_id", total_sessions="session_id", total_requests="request_id"),
        vocabulary_size("model_name").alias("distinct_models_used"),
        vocabulary_size("datasource_name").alias("distinct_datasources"),
        distinct_list("model_name").alias("models_used"),
        distinct_list("datasource_name").alias("datasources_accessed"),
        *tally(
            sql_generated=kind("sql_generated"),
            sql_executed=kind("sql_executed"),
            sql_blocked=kind("sql_blocked"),
            agent_events="is_agent_event",
            boundary_violations=BOUNDARY,
            high_sensitivity_events="is_high_sensitivity",
            pii_events=PII,
            policy_blocks=BLOCKED,
        ),
        _tier((some(BLOCKED), "MEDIUM")).alias("workspace_risk_tier"),
    )


def dim_datasources(staged: DataFrame) -> DataFrame:
    named = staged.where(F.col("datasource_name").isNotNull())
    return named.groupBy("tenant_id", "workspace_id", "datasource_type", "datasource_name").agg(
        *_seen("first_accessed_at", "last_accessed_at"),
        *distinct_counts(
            distinct_users="user_id", distinct_sessions="session_id", distinct_requests="request_id",
            distinct_sql_patterns="sql_hash",
        ),
        *tally(
            sql_generated=kind("sql_generated"),
            sql_executed=kind("sql_executed"),
            sql_blocked=kind("sql_blocked"),
            agent_events="is_agent_event",
            boundary_violations=BOUNDARY,
            critical_events=level_is("CRITICAL"),
            high_sensitivity_events=level_is("HIGH"),
            pii_events=PII,
        ),
        _tier((some(level_is("HIGH")), "HIGH")).alias("datasource_risk_tier"),
    )


def dim_models(staged: DataFrame) -> DataFrame:
    used = staged.where(F.col("model_name").isNotNull())
    return used.groupBy("tenant_id", "workspace_id", "model_name").agg(
        *_seen("first_used_at", "last_used_at"),
        *distinct_counts(
            distinct_users="user_id", distinct_sessions="session_id", distinct_requests="request_id"),
        F.count("*").alias("total_invocations"),
        *tally(
            sql_generated=kind("sql_generated"),
            sql_blocked=kind("sql_blocked"),
            human_corrections="is_human_correction",
            error_events="is_error",
            boundary_violations=BOUNDARY,
            critical_sensitivity_events=level_is("CRITICAL"),
            pii_events=PII,
        ),
        rate_pct(F.count_if("is_error"), F.count("*")).alias("error_rate_pct"),
    )


def fct_requests(staged: DataFrame) -> DataFrame:
    return request_summary(staged)


IDENTITY = ["trace_id", "parent_trace_id", "tenant_id", "workspace_id", "user_id", "session_id",
            "request_id"]
OUTCOME = ["status", "error_code", "error_message", "etl_run_id"]
CLASSIFICATION = ["sensitivity_level", "pii_detected", "pii_fields"]
DATASOURCE = ["datasource_type", "datasource_name"]


def _fact(staged: DataFrame, events: list[str], prefix: str, columns: list) -> DataFrame:
    at = F.col("event_timestamp")
    on = "check_date" if prefix == "checked" else f"{prefix}_date"
    return staged.where(kind(*events)).select(
        *IDENTITY, at.alias(f"{prefix}_at"), day(at).alias(on), *columns, *CLASSIFICATION, *OUTCOME)


def fct_sql_generations(staged: DataFrame) -> DataFrame:
    risk = first_match(
        [(level_is("CRITICAL"), "CRITICAL"), (level_is("HIGH"), "HIGH"), (PII, "MEDIUM")], "LOW")
    return _fact(staged, ["sql_generated"], "generated", [
        "sql_text", "sql_hash", "ai_action_summary", *DATASOURCE, "model_name", "policy_result",
        risk.alias("sql_risk_level")])


def fct_sql_executions(staged: DataFrame) -> DataFrame:
    return _fact(staged, ["sql_executed"], "executed",
                 ["sql_text", "sql_hash", *DATASOURCE, "model_name", "policy_result"])


# The event kinds each fact holds.
POLICY_EVENTS = ["policy_check_started", "policy_check_passed", "policy_check_failed", "sql_blocked",
                 "agent_boundary_violation"]
TOOL_EVENTS = ["tool_invoked", "agent_action", "agent_boundary_violation"]
RETRIEVAL_EVENTS = ["rag_retrieved", "memory_retrieved"]


def fct_policy_checks(staged: DataFrame) -> DataFrame:
    outcome = first_match([
        (BOUNDARY, "AGENT_BOUNDARY_VIOLATION"),
        (kind("sql_blocked"), "SQL_BLOCKED"),
        (kind("policy_check_failed"), "POLICY_FAILED"),
        (kind("policy_check_passed"), "PASSED"),
    ], "OTHER")
    return _fact(staged, POLICY_EVENTS, "checked", [
        "event_type", "policy_result", "question_text", "sql_text", "sql_hash", "agent_name",
        "ai_action_summary", "boundary_violated", "risk_flags", "is_policy_blocked",
        "is_boundary_violation", "datasource_name", "model_name", outcome.alias("check_outcome")])


def fct_tool_calls(staged: DataFrame) -> DataFrame:
    risk = first_match([
        (BOUNDARY, "CRITICAL"), (BLOCKED, "HIGH"), (level_is("HIGH"), "HIGH"), (PII, "MEDIUM")], "LOW")
    return _fact(staged, TOOL_EVENTS, "invoked", [
        "event_type", "actor_type", "actor_id", "tool_name", "agent_name", "ai_action_summary",
        "boundary_violated", "is_boundary_violation", "risk_flags", "sql_text", "sql_hash",
        *DATASOURCE, "policy_result", "is_policy_blocked", risk.alias("tool_call_risk_level")])


def fct_rag_retrievals(staged: DataFrame) -> DataFrame:
    return _fact(staged, RETRIEVAL_EVENTS, "retrieved", [
        "event_type", "context_refs", "ai_action_summary", *DATASOURCE, "tool_name", "model_name"])


def request_star(staged: DataFrame) -> DataFrame:
    """Requests with their user, workspace and model rows.

    Dimensions are keyed by tenant and workspace as well, so no join fans out.
    No broadcast is forced: the planner picks one from measured sizes.
    """
    facts = fct_requests(staged).select(
        "tenant_id", "workspace_id", "user_id", "request_id", "etl_run_id", "primary_model", "risk_level")
    users = dim_users(staged).select("tenant_id", "workspace_id", "user_id", "user_risk_tier",
                                     F.col("total_events").alias("user_events"))
    workspaces = dim_workspaces(staged).select(
        "tenant_id", "workspace_id", "workspace_risk_tier", "distinct_users")
    models = dim_models(staged).select(
        "tenant_id", "workspace_id", F.col("model_name").alias("primary_model"), "total_invocations",
        "error_rate_pct")
    return (
        facts.join(users, ["tenant_id", "workspace_id", "user_id"], "left")
        .join(workspaces, ["tenant_id", "workspace_id"], "left")
        .join(models, ["tenant_id", "workspace_id", "primary_model"], "left")
    )


def datasource_star(staged: DataFrame) -> DataFrame:
    """SQL generations with the risk tier of the datasource they ran against."""
    tiers = dim_datasources(staged).select(
        "tenant_id", "workspace_id", "datasource_type", "datasource_name", "datasource_risk_tier")
    return fct_sql_generations(staged).select(
        "trace_id", "tenant_id", "workspace_id", "datasource_type", "datasource_name", "sql_risk_level",
    ).join(tiers, ["tenant_id", "workspace_id", "datasource_type", "datasource_name"], "left")


def generated_vs_executed(staged: DataFrame) -> DataFrame:
    """Each generated statement, with how often it ran inside its request."""
    keys = ["tenant_id", "request_id", "sql_hash"]
    generated = fct_sql_generations(staged).groupBy(*keys).agg(F.count("*").alias("generated"))
    executed = fct_sql_executions(staged).groupBy(*keys).agg(F.count("*").alias("executed"))
    return generated.join(executed, keys, "left").select(
        *keys, "generated", F.coalesce("executed", F.lit(0)).alias("executed"),
        F.col("executed").isNotNull().alias("was_executed"))


def with_parent(staged: DataFrame) -> DataFrame:
    """Each event that names a parent, beside that parent's kind and status.

    The parent side is unique on ``trace_id``; a parent with very many
    children is split by the adaptive skew join.
    """
    parents = staged.select(
        F.col("trace_id").alias("parent_trace_id"), F.col("event_type").alias("parent_event_type"),
        F.col("status").alias("parent_status"))
    children = staged.where(F.col("parent_trace_id").isNotNull()).select(
        "trace_id", "parent_trace_id", "event_type")
    return children.join(parents, "parent_trace_id", "left")
