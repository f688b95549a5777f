"""Metric layer over the star schema: named measures grouped by any columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceworks.plans import ledger, marts


@dataclass(frozen=True)
class Metric:
    mart: str
    kind: str  # sum | average | count_distinct
    expr: str

    def column(self) -> Column:
        value = F.expr(self.expr)
        if self.kind == "sum":
            return F.sum(value)
        if self.kind == "average":
            return F.avg(value)
        return F.count_distinct(value)


MARTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "users": marts.dim_users, "workspaces": marts.dim_workspaces, "datasources": marts.dim_datasources,
    "models": marts.dim_models, "requests": marts.fct_requests, "sql_generations": marts.fct_sql_generations,
    "sql_executions": marts.fct_sql_executions, "policy_checks": marts.fct_policy_checks,
    "tool_calls": marts.fct_tool_calls, "rag_retrievals": marts.fct_rag_retrievals,
    "sql_risk": ledger.sql_risk_summary, "model_usage": ledger.model_usage,
    "request_report": ledger.request_summary, "session_report": ledger.session_overview,
}


def _sums(mart: str, names: dict[str, str]) -> dict[str, Metric]:
    return {name: Metric(mart, "sum", col) for name, col in names.items()}


def _if_true(mart: str, col: str, ident: str = "trace_id") -> Metric:
    return Metric(mart, "count_distinct", f"case when {col} then {ident} end")


# Metric names with the mart columns they read.
METRICS: dict[str, Metric] = {
    **_sums("users", {
        "total_user_sessions": "total_sessions", "total_user_requests": "total_requests",
        "total_sql_generated_by_user": "sql_generated_count", "total_sql_executed_by_user": "sql_executed_count",
        "total_sql_blocked_by_user": "sql_blocked_count", "total_agent_events_by_user": "agent_events",
        "total_boundary_violations_by_user": "boundary_violations",
        "total_high_sensitivity_by_user": "high_sensitivity_events", "total_pii_events_by_user": "pii_events",
        "total_policy_blocks_by_user": "policy_blocks"}),
    **_sums("workspaces", {
        "total_workspace_users": "distinct_users", "total_workspace_sessions": "total_sessions",
        "total_workspace_requests": "total_requests", "total_workspace_sql_generated": "sql_generated",
        "total_workspace_sql_executed": "sql_executed", "total_workspace_sql_blocked": "sql_blocked",
        "total_workspace_agent_events": "agent_events", "workspace_boundary_violations": "boundary_violations",
        "total_workspace_high_sensitivity": "high_sensitivity_events", "total_workspace_pii_events": "pii_events",
        "total_workspace_policy_blocks": "policy_blocks"}),
    **_sums("datasources", {
        "datasource_distinct_users": "distinct_users", "datasource_distinct_requests": "distinct_requests",
        "datasource_sql_generated": "sql_generated", "total_sql_executions": "sql_executed",
        "datasource_sql_blocked": "sql_blocked", "datasource_sql_patterns": "distinct_sql_patterns",
        "datasource_agent_events": "agent_events", "datasource_boundary_violations": "boundary_violations",
        "datasource_critical_events": "critical_events", "datasource_high_sensitivity": "high_sensitivity_events",
        "total_pii_events": "pii_events"}),
    **_sums("models", {
        "model_distinct_users": "distinct_users", "model_distinct_requests": "distinct_requests",
        "total_model_invocations": "total_invocations", "model_sql_generated": "sql_generated",
        "model_sql_blocked": "sql_blocked", "model_human_corrections": "human_corrections",
        "model_error_events": "error_events", "model_boundary_violations": "boundary_violations",
        "model_critical_sensitivity": "critical_sensitivity_events", "model_pii_events": "pii_events"}),
    "avg_model_error_rate": Metric("models", "average", "error_rate_pct"),
    "avg_request_latency_ms": Metric("requests", "average", "total_request_ms"),
    "avg_agent_events_per_request": Metric("requests", "average", "agent_event_count"),
    "requests_with_boundary_violation": _if_true("requests", "boundary_violated = 1", "request_id"),
    **_sums("requests", {
        "total_sql_generated": "sql_generated_count", "total_sql_executed": "sql_executed_count",
        "total_sql_blocked": "sql_blocked_count", "total_policy_blocks": "policy_blocks",
        "total_errors": "error_count", "total_human_corrections": "human_corrections"}),
    "pii_sql_generations": _if_true("sql_generations", "pii_detected"),
    "pii_sql_executions": _if_true("sql_executions", "pii_detected"),
    "total_boundary_violations": _if_true("policy_checks", "is_boundary_violation"),
    "agentic_boundary_violations": _if_true("tool_calls", "boundary_violated"),
    "tool_calls_with_pii": _if_true("tool_calls", "pii_detected"),
    "rag_retrievals_with_pii": _if_true("rag_retrievals", "pii_detected"),
    "report_sql_blocked": Metric("request_report", "sum", "sql_blocked_count"),
    "avg_block_rate": Metric("sql_risk", "average", "block_rate_pct"),
    "total_invocations": Metric("model_usage", "sum", "invocations"),
    "total_requests_sum": Metric("session_report", "sum", "total_requests"),
}


def metrics(staged: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """Metrics of one mart in one aggregation, grouped by its columns ``by``."""
    chosen = {n: METRICS[n] for n in names}
    sources = {m.mart for m in chosen.values()}
    if len(sources) != 1:
        raise ValueError(f"metrics of several marts asked at once: {sorted(sources)}")
    mart = MARTS[sources.pop()](staged)
    return mart.groupBy(*by).agg(*[m.column().alias(n) for n, m in chosen.items()])


def metric_report(staged: DataFrame, names: list[str], by: list[str], sets: list[list[str]]) -> DataFrame:
    """Metrics of any marts as rows (grain, by, metric, value), each mart built and aggregated once.

    ``sets`` are the groupings wanted, as lists out of ``by``, which are columns of all marts asked for; all sets of a
    mart are one aggregation. ``grain`` tells a rolled-up column from a null key: bit by bit, 1 for a column
    that is not grouped, the first of ``by`` highest. Sums and averages merge from partial ones.
    """
    wanted: dict[str, list[str]] = {}
    for name in names:
        wanted.setdefault(METRICS[name].mart, []).append(name)
    parts = []
    for mart, own in wanted.items():
        out = MARTS[mart](staged).groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in by]).agg(
            F.grouping_id().cast("long").alias("grain"), *[METRICS[n].column().cast("double").alias(n) for n in own])
        parts.append(out.unpivot(["grain", *by], own, "metric", "value"))
    return reduce(DataFrame.unionByName, parts)
