"""Ledger models, marts, replay views and search."""

from __future__ import annotations

from traceworks import fixtures as fx
from traceworks.plans import ledger, marts
from traceworks.registry.base import query
from traceworks.registry.sql import any_if, dlist, n_if, n_type, olist, over_staged, pct

SQL_COUNTS = ", ".join([
    n_type("sql_generated", "sql_generated_count"), n_type("sql_executed", "sql_executed_count"),
    n_type("sql_blocked", "sql_blocked_count")])
SQL_COUNTS_SHORT = SQL_COUNTS.replace("_count,", ",").removesuffix("_count")


def staged(spark, sf):
    return ledger.staged_events(fx.trace_events(spark, sf))


def _model(name, fn, sql):
    query(name, sql)(lambda spark, sf, fn=fn: fn(staged(spark, sf)))


_model("m01_stg_trace_events", lambda s: s, over_staged("select * from staged"))

TIMELINE_SQL = """select *, row_number() over (partition by tenant_id, request_id
    order by event_timestamp nulls last, trace_id) as event_sequence,
  min(event_timestamp) over r as request_started_at, max(event_timestamp) over r as request_ended_at,
  date_diff('millisecond', min(event_timestamp) over r, max(event_timestamp) over r) as total_request_ms,
  date_diff('millisecond', min(event_timestamp) over r, event_timestamp) as ms_since_request_start
from staged window r as (partition by tenant_id, request_id)"""
_model("m02_int_request_timeline", ledger.request_timeline, over_staged(TIMELINE_SQL))

SESSION_SQL = f"""select tenant_id, workspace_id, user_id, session_id,
  min(event_timestamp) as session_started_at, max(event_timestamp) as session_last_activity_at,
  date_diff('minute', min(event_timestamp), max(event_timestamp)) as session_duration_minutes,
  count(distinct request_id) as total_requests, count(*) as total_events,
  count(distinct model_name) as distinct_models_used,
  {dlist('model_name')} as models_used, {dlist('datasource_name')} as datasources_accessed,
  {n_if('is_sql_event', 'sql_events')}, {SQL_COUNTS}, {n_if('is_policy_blocked', 'policy_blocks')},
  {n_if('is_error', 'error_events')}, {n_if('is_human_correction', 'human_corrections')},
  {n_if('is_agent_event', 'agent_events')}, {n_if('is_boundary_violation', 'boundary_violations')},
  {olist('risk_flags', 'is_boundary_violation', ', ')} as boundary_violation_risks,
  {n_if('is_high_sensitivity', 'high_sensitivity_events')}, {n_if('pii_detected', 'pii_events')},
  case when {any_if('is_boundary_violation')} then 'CRITICAL'
    when {any_if("event_type = 'sql_blocked'")} then 'HIGH'
    when {any_if('is_policy_blocked or is_high_sensitivity or pii_detected')} then 'MEDIUM'
    when {any_if('is_error')} then 'LOW' else 'NONE' end as session_risk_level
from staged group by 1, 2, 3, 4"""
_model("m03_int_session_summary", ledger.session_summary, over_staged(SESSION_SQL))

REQUEST_CTES = (
    "spans as (select tenant_id, request_id, date_diff('millisecond', min(event_timestamp), "
    "max(event_timestamp)) as total_request_ms from staged group by 1, 2)",
    f"""grouped as (select tenant_id, workspace_id, user_id, session_id, request_id, etl_run_id,
  min(event_timestamp) as request_started_at, max(event_timestamp) as request_ended_at,
  max(question_text) filter (where event_type = 'request_received') as question_text,
  max(sql_text) filter (where event_type = 'sql_generated') as sql_generated_text,
  max(sql_text) filter (where event_type = 'sql_executed') as sql_executed_text,
  max(sql_hash) filter (where event_type = 'sql_generated') as sql_hash,
  case max(case sensitivity_level when 'LOW' then 1 when 'MEDIUM' then 2 when 'HIGH' then 3
    when 'CRITICAL' then 4 end) when 1 then 'LOW' when 2 then 'MEDIUM' when 3 then 'HIGH'
    when 4 then 'CRITICAL' end as highest_sensitivity_level,
  {any_if('pii_detected')}::int as pii_detected, {dlist('pii_fields')} as all_pii_fields,
  {olist('ai_action_summary', 'is_agent_event', ' | ')} as agent_actions_taken,
  {n_if('is_agent_event', 'agent_event_count')},
  {any_if('is_boundary_violation')}::int as boundary_violated,
  {olist('risk_flags', 'is_boundary_violation', ', ')} as boundary_violation_risks,
  max(model_name) as primary_model, {dlist('datasource_name')} as datasources_touched, {SQL_COUNTS},
  {n_if('is_policy_blocked', 'policy_blocks')},
  max(error_message) filter (where is_policy_blocked) as policy_block_reason,
  {n_if('is_error', 'error_count')}, {n_if('is_human_correction', 'human_corrections')}
from staged group by 1, 2, 3, 4, 5, 6)""",
    """requests as (select g.*, total_request_ms,
  case when boundary_violated > 0 or highest_sensitivity_level = 'CRITICAL' then 'CRITICAL'
    when sql_blocked_count > 0 or policy_blocks > 0 or highest_sensitivity_level = 'HIGH' then 'HIGH'
    when pii_detected > 0 then 'MEDIUM' when error_count > 0 then 'LOW' else 'NONE' end as risk_level,
  case when boundary_violated > 0 then 'violation' when sql_blocked_count > 0 then 'blocked'
    when error_count > 0 then 'failed' else 'ok' end as request_status
from grouped g join spans s on g.tenant_id is not distinct from s.tenant_id
  and g.request_id is not distinct from s.request_id)""",
)
_model("m04_rpt_request_summary", ledger.request_summary,
       over_staged("select * from requests", *REQUEST_CTES))

VIOLATIONS_SQL = """select trace_id, parent_trace_id, tenant_id, workspace_id, user_id, session_id, request_id,
  event_type, event_timestamp, actor_id, datasource_type, datasource_name, model_name, tool_name,
  agent_name, policy_result, question_text, sql_text, sql_hash, sensitivity_level, pii_detected,
  pii_fields, ai_action_summary, boundary_violated, risk_flags, status, error_code, error_message,
  etl_run_id,
  case when is_boundary_violation then 'AGENT_BOUNDARY_VIOLATION'
    when event_type = 'sql_blocked' then 'SQL_BLOCKED'
    when event_type = 'policy_check_failed' then 'POLICY_FAILED'
    when status = 'blocked' then 'ACTION_BLOCKED' when status = 'failed' then 'ACTION_FAILED'
    else 'UNKNOWN' end as violation_type,
  date_trunc('day', event_timestamp)::timestamp as violation_date
from staged where is_policy_blocked or is_boundary_violation or is_error"""
_model("m05_rpt_policy_violations", ledger.policy_violations, over_staged(VIOLATIONS_SQL))

SQL_RISK_SQL = f"""select tenant_id, workspace_id, user_id, datasource_type, datasource_name,
  date_trunc('day', event_timestamp)::timestamp as event_date, count(*) as total_sql_events,
  {n_type('sql_generated', 'sql_generated')}, {n_type('sql_validated', 'sql_validated')},
  {n_type('sql_executed', 'sql_executed')}, {n_type('sql_blocked', 'sql_blocked')},
  {pct("count(*) filter (where event_type = 'sql_blocked')",
       "count(*) filter (where event_type = 'sql_generated')")} as block_rate_pct,
  count(distinct sql_hash) as distinct_sql_hashes,
  {n_if("sensitivity_level = 'CRITICAL'", 'critical_sensitivity_count')},
  {n_if("sensitivity_level = 'HIGH'", 'high_sensitivity_count')}, {n_if('pii_detected', 'pii_event_count')},
  {n_if('is_human_correction', 'human_corrections')},
  case when count(*) filter (where event_type = 'sql_blocked') > 5 then 'HIGH'
    when {any_if("event_type = 'sql_blocked' or sensitivity_level = 'CRITICAL' or pii_detected")} then 'MEDIUM'
    when {any_if('is_error')} then 'LOW' else 'NONE' end as risk_level
from staged where is_sql_event group by 1, 2, 3, 4, 5, 6"""
_model("m06_rpt_sql_risk_summary", ledger.sql_risk_summary, over_staged(SQL_RISK_SQL))

_model("m07_rpt_model_usage", ledger.model_usage, over_staged(
    f"""select tenant_id, workspace_id, user_id, model_name,
  date_trunc('day', event_timestamp)::timestamp as usage_date, count(*) as invocations,
  count(distinct session_id) as distinct_sessions, count(distinct request_id) as distinct_requests,
  {n_if('is_error', 'failed_invocations')},
  {pct('count(*) filter (where is_error)', 'count(*)')} as failure_rate_pct
from staged where event_type = 'model_invoked' and model_name is not null group by 1, 2, 3, 4, 5"""))

_model("m08_rpt_session_overview", ledger.session_overview,
       over_staged("select * exclude (sql_events) from s", f"s as ({SESSION_SQL})"))

TIER = f"""case when {any_if('is_boundary_violation')} then 'CRITICAL'
    when {any_if("event_type = 'sql_blocked'")} then 'HIGH' when {any_if('THIRD')}"""
ACTIVITY = ", ".join([n_if("is_agent_event", "agent_events"),
                      n_if("is_boundary_violation", "boundary_violations"),
                      n_if("pii_detected", "pii_events")])
HIGH_AND_BLOCKS = ", ".join([n_if("is_high_sensitivity", "high_sensitivity_events"),
                             n_if("is_policy_blocked", "policy_blocks")])

DIM_USERS = f"""select tenant_id, workspace_id, user_id, min(event_timestamp) as first_seen_at,
  max(event_timestamp) as last_seen_at, count(distinct session_id) as total_sessions,
  count(distinct request_id) as total_requests, count(*) as total_events, {SQL_COUNTS}, {ACTIVITY},
  {HIGH_AND_BLOCKS},
  case max(case sensitivity_level when 'CRITICAL' then 4 when 'HIGH' then 3 when 'MEDIUM' then 2
    when 'LOW' then 1 end) when 4 then 'CRITICAL' when 3 then 'HIGH' when 2 then 'MEDIUM'
    when 1 then 'LOW' end as highest_sensitivity_seen,
  {TIER.replace('THIRD', 'is_policy_blocked or pii_detected')} then 'MEDIUM' else 'LOW' end as user_risk_tier
from staged group by 1, 2, 3"""
_model("m09_dim_ai_users", marts.dim_users, over_staged(DIM_USERS))

DIM_WORKSPACES = f"""select tenant_id, workspace_id, min(event_timestamp) as first_active_at,
  max(event_timestamp) as last_active_at, count(distinct user_id) as distinct_users,
  count(distinct session_id) as total_sessions, count(distinct request_id) as total_requests,
  count(distinct model_name) as distinct_models_used, {dlist('model_name')} as models_used,
  count(distinct datasource_name) as distinct_datasources,
  {dlist('datasource_name')} as datasources_accessed, {SQL_COUNTS_SHORT}, {ACTIVITY}, {HIGH_AND_BLOCKS},
  {TIER.replace('THIRD', 'is_policy_blocked or pii_detected')} then 'MEDIUM' else 'LOW' end
    as workspace_risk_tier
from staged group by 1, 2"""
_model("m10_dim_ai_workspaces", marts.dim_workspaces, over_staged(DIM_WORKSPACES))

DIM_DATASOURCES = f"""select tenant_id, workspace_id, datasource_type, datasource_name,
  min(event_timestamp) as first_accessed_at, max(event_timestamp) as last_accessed_at,
  count(distinct user_id) as distinct_users, count(distinct session_id) as distinct_sessions,
  count(distinct request_id) as distinct_requests, {SQL_COUNTS_SHORT},
  count(distinct sql_hash) as distinct_sql_patterns, {ACTIVITY},
  {n_if("sensitivity_level = 'CRITICAL'", 'critical_events')},
  {n_if("sensitivity_level = 'HIGH'", 'high_sensitivity_events')},
  {TIER.replace('THIRD', "sensitivity_level = 'HIGH'")} then 'HIGH' when {any_if('pii_detected')}
    then 'MEDIUM' else 'LOW' end as datasource_risk_tier
from staged where datasource_name is not null group by 1, 2, 3, 4"""
_model("m11_dim_ai_datasources", marts.dim_datasources, over_staged(DIM_DATASOURCES))

DIM_MODELS = f"""select tenant_id, workspace_id, model_name, min(event_timestamp) as first_used_at,
  max(event_timestamp) as last_used_at, count(distinct user_id) as distinct_users,
  count(distinct session_id) as distinct_sessions, count(distinct request_id) as distinct_requests,
  count(*) as total_invocations, {n_type('sql_generated', 'sql_generated')},
  {n_type('sql_blocked', 'sql_blocked')}, {n_if('is_human_correction', 'human_corrections')},
  {n_if('is_error', 'error_events')},
  {pct('count(*) filter (where is_error)', 'count(*)')} as error_rate_pct,
  {n_if('is_boundary_violation', 'boundary_violations')},
  {n_if("sensitivity_level = 'CRITICAL'", 'critical_sensitivity_events')}, {n_if('pii_detected', 'pii_events')}
from staged where model_name is not null group by 1, 2, 3"""
_model("m12_dim_ai_models", marts.dim_models, over_staged(DIM_MODELS))

_model("m13_fct_ai_requests", marts.fct_requests, over_staged("select * from requests", *REQUEST_CTES))

_ID = "trace_id, parent_trace_id, tenant_id, workspace_id, user_id, session_id, request_id"
_END = "sensitivity_level, pii_detected, pii_fields, status, error_code, error_message, etl_run_id"


def _fact_sql(prefix: str, on: str, columns: str, where: str) -> str:
    return over_staged(
        f"select {_ID}, event_timestamp as {prefix}_at, date_trunc('day', event_timestamp)::timestamp as {on}, "
        f"{columns}, {_END} from staged where {where}")


GENERATED_SQL = _fact_sql(
    "generated", "generated_date",
    """sql_text, sql_hash, ai_action_summary, datasource_type, datasource_name, model_name, policy_result,
  case when sensitivity_level in ('CRITICAL', 'HIGH') then sensitivity_level when pii_detected then 'MEDIUM'
    else 'LOW' end as sql_risk_level""", "event_type = 'sql_generated'")
_model("m14_fct_ai_sql_generations", marts.fct_sql_generations, GENERATED_SQL)
_model("m15_fct_ai_sql_executions", marts.fct_sql_executions, _fact_sql(
    "executed", "executed_date",
    "sql_text, sql_hash, datasource_type, datasource_name, model_name, policy_result",
    "event_type = 'sql_executed'"))
_model("m16_fct_ai_policy_checks", marts.fct_policy_checks, _fact_sql(
    "checked", "check_date",
    """event_type, policy_result, question_text, sql_text, sql_hash, agent_name, ai_action_summary,
  boundary_violated, risk_flags, is_policy_blocked, is_boundary_violation, datasource_name, model_name,
  case when is_boundary_violation then 'AGENT_BOUNDARY_VIOLATION' when event_type = 'sql_blocked'
    then 'SQL_BLOCKED' when event_type = 'policy_check_failed' then 'POLICY_FAILED'
    when event_type = 'policy_check_passed' then 'PASSED' else 'OTHER' end as check_outcome""",
    "event_type like 'policy_check_%' or event_type in ('sql_blocked', 'agent_boundary_violation')"))
_model("m17_fct_ai_tool_calls", marts.fct_tool_calls, _fact_sql(
    "invoked", "invoked_date",
    """event_type, actor_type, actor_id, tool_name, agent_name, ai_action_summary, boundary_violated,
  is_boundary_violation, risk_flags, sql_text, sql_hash, datasource_type, datasource_name, policy_result,
  is_policy_blocked, case when is_boundary_violation then 'CRITICAL'
    when is_policy_blocked or sensitivity_level = 'HIGH' then 'HIGH' when pii_detected then 'MEDIUM'
    else 'LOW' end as tool_call_risk_level""", "is_agent_event"))
_model("m18_fct_ai_rag_retrievals", marts.fct_rag_retrievals, _fact_sql(
    "retrieved", "retrieved_date",
    "event_type, context_refs, ai_action_summary, datasource_type, datasource_name, tool_name, model_name",
    "event_type in ('rag_retrieved', 'memory_retrieved')"))

_model("j01_star_join", marts.request_star, over_staged(
    """select r.tenant_id, r.workspace_id, r.user_id, r.request_id, r.etl_run_id, r.primary_model,
  r.risk_level, u.user_risk_tier, u.total_events as user_events, w.workspace_risk_tier, w.distinct_users,
  m.total_invocations, m.error_rate_pct
from requests r left join u using (tenant_id, workspace_id, user_id)
left join w using (tenant_id, workspace_id)
left join m on m.tenant_id = r.tenant_id and m.workspace_id = r.workspace_id
  and m.model_name = r.primary_model""",
    *REQUEST_CTES, f"u as ({DIM_USERS})", f"w as ({DIM_WORKSPACES})", f"m as ({DIM_MODELS})"))
_model("j01_datasource_star", marts.datasource_star, over_staged(
    """select trace_id, tenant_id, workspace_id, datasource_type, datasource_name,
  case when sensitivity_level in ('CRITICAL', 'HIGH') then sensitivity_level when pii_detected then 'MEDIUM'
    else 'LOW' end as sql_risk_level, datasource_risk_tier
from staged left join d using (tenant_id, workspace_id, datasource_type, datasource_name)
where event_type = 'sql_generated'""", f"d as ({DIM_DATASOURCES})"))
_model("j02_generated_vs_executed", marts.generated_vs_executed, over_staged(
    """select tenant_id, request_id, sql_hash, g.n as generated, coalesce(e.n, 0) as executed,
  e.n is not null as was_executed
from (select tenant_id, request_id, sql_hash, count(*) as n from staged
      where event_type = 'sql_generated' group by 1, 2, 3) g
left join (select tenant_id, request_id, sql_hash, count(*) as n from staged
      where event_type = 'sql_executed' group by 1, 2, 3) e using (tenant_id, request_id, sql_hash)"""))
_model("j15_parent_child", marts.with_parent, over_staged(
    """select c.trace_id, c.parent_trace_id, c.event_type, p.event_type as parent_event_type,
  p.status as parent_status
from staged c left join staged p on p.trace_id = c.parent_trace_id where c.parent_trace_id is not null"""))
