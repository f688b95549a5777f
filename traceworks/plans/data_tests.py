"""The data tests that belong to the ledger and its eighteen models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceworks.operators.expectations import Expectation, failing_rows, run_expectations
from traceworks.plans import ledger, marts

MODELS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "stg_trace_events": lambda staged: staged,
    "int_request_timeline": ledger.request_timeline, "int_session_summary": ledger.session_summary,
    "rpt_request_summary": ledger.request_summary, "rpt_policy_violations": ledger.policy_violations,
    "rpt_sql_risk_summary": ledger.sql_risk_summary, "rpt_model_usage": ledger.model_usage,
    "rpt_session_overview": ledger.session_overview,
    "dim_ai_users": marts.dim_users, "dim_ai_workspaces": marts.dim_workspaces,
    "dim_ai_datasources": marts.dim_datasources, "dim_ai_models": marts.dim_models,
    "fct_ai_requests": marts.fct_requests, "fct_ai_sql_generations": marts.fct_sql_generations,
    "fct_ai_sql_executions": marts.fct_sql_executions, "fct_ai_policy_checks": marts.fct_policy_checks,
    "fct_ai_tool_calls": marts.fct_tool_calls, "fct_ai_rag_retrievals": marts.fct_rag_retrievals,
}

# The accepted values of each column, and which columns must be filled or unique.
EVENT_TYPES = (
    "request_received", "session_started", "memory_retrieved", "rag_retrieved", "policy_check_started",
    "policy_check_passed", "policy_check_failed", "model_invoked", "tool_invoked", "agent_action",
    "agent_boundary_violation", "sql_generated", "sql_validated", "sql_blocked", "sql_executed",
    "document_extracted", "response_returned", "human_feedback_received", "action_replayed")
ACTORS = ("user", "assistant", "system", "tool", "agent")
TIERS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
RISKS = ("NONE", "LOW", "MEDIUM", "HIGH")
VIOLATIONS = ("SQL_BLOCKED", "POLICY_FAILED", "ACTION_BLOCKED", "ACTION_FAILED", "UNKNOWN")
OUTCOMES = ("PASSED", "SQL_BLOCKED", "POLICY_FAILED", "AGENT_BOUNDARY_VIOLATION", "OTHER")


def _tests(filled: str, unique: str = "", **accepted: tuple[str, ...]) -> list[Expectation]:
    return [*[Expectation("not_null", c) for c in filled.split()], *[Expectation("unique", c) for c in unique.split()],
            *[Expectation("accepted_values", c, values) for c, values in accepted.items()]]


#: Tests of the raw ledger, before rows that miss an id are dropped.
SOURCE_TESTS = _tests(
    "trace_id tenant_id workspace_id user_id session_id request_id event_type event_timestamp actor_type", "trace_id",
    event_type=EVENT_TYPES, actor_type=ACTORS, status=("ok", "blocked", "failed", "pending", "violation"))
MODEL_TESTS = {
    "stg_trace_events": _tests("trace_id event_timestamp tenant_id user_id session_id event_type status", "trace_id",
                               status=("ok", "blocked", "failed", "pending")),
    "int_request_timeline": _tests("trace_id tenant_id request_id", "trace_id"),
    "int_session_summary": _tests("session_id tenant_id", session_risk_level=RISKS),
    "rpt_request_summary": _tests("request_id tenant_id", risk_level=RISKS),
    "rpt_policy_violations": _tests("trace_id", violation_type=VIOLATIONS),
    "rpt_sql_risk_summary": _tests("", risk_level=RISKS),
    "rpt_model_usage": _tests("model_name"),
    "rpt_session_overview": _tests("session_id", session_risk_level=RISKS),
    "dim_ai_users": _tests("tenant_id workspace_id user_id", user_risk_tier=TIERS),
    "dim_ai_workspaces": _tests("tenant_id workspace_id", workspace_risk_tier=TIERS),
    "dim_ai_datasources": _tests("tenant_id workspace_id datasource_name", datasource_risk_tier=TIERS),
    "dim_ai_models": _tests("tenant_id workspace_id model_name"),
    "fct_ai_requests": _tests("tenant_id workspace_id user_id request_id", risk_level=(*RISKS, "CRITICAL")),
    "fct_ai_sql_generations": _tests("trace_id tenant_id", "trace_id", sql_risk_level=TIERS),
    "fct_ai_sql_executions": _tests("trace_id tenant_id", "trace_id"),
    "fct_ai_policy_checks": _tests("trace_id tenant_id", "trace_id", check_outcome=OUTCOMES),
    "fct_ai_tool_calls": _tests("trace_id tenant_id", "trace_id", tool_call_risk_level=TIERS),
    "fct_ai_rag_retrievals": _tests("trace_id tenant_id", "trace_id"),
}


def source_results(raw: DataFrame) -> DataFrame:
    """(test, column_name, failures) of the raw ledger."""
    return run_expectations(raw, SOURCE_TESTS)


def model_results(staged: DataFrame, models: list[str] | None = None) -> DataFrame:
    """(model, test, column_name, failures) of every data test of the models, all by default.

    Each model's row tests are one pass over it, so columns that no test reads are pruned from its plan.
    """
    out = None
    for name in models or MODEL_TESTS:
        tested = run_expectations(MODELS[name](staged), MODEL_TESTS[name]).select(
            F.lit(name).alias("model"), "test", "column_name", "failures")
        out = tested if out is None else out.unionByName(tested)
    return out


def store_failures(staged: DataFrame, root: str, models: list[str] | None = None, cap: int | None = 1000) -> dict[str, str]:
    """Write the rows each failing test rejects below ``root``, the first ``cap`` by the tested column.

    Returns the folder per ``model.test``; a test without failures has none.
    """
    failed = model_results(staged, models).where("failures > 0").select("model", "test").collect()
    folders = {}
    for model, test in sorted(map(tuple, failed)):
        wanted = next(t for t in MODEL_TESTS[model] if t.name == test)
        folders[f"{model}.{test}"] = path = f"{root.rstrip('/')}/{model}/{test}"
        failing_rows(MODELS[model](staged), wanted, cap).write.mode("overwrite").parquet(path)
    return folders
