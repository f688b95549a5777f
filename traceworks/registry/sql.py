"""Shared pieces of check SQL."""

from __future__ import annotations

from traceworks.fixtures import TRACE_EVENTS_SQL

STAGED = f"""staged as (
select * replace (try_cast(event_timestamp as timestamp) as event_timestamp),
  coalesce(event_type like 'sql\\_%' escape '\\', false) as is_sql_event,
  coalesce(event_type in ('agent_action', 'agent_boundary_violation', 'tool_invoked'), false) as is_agent_event,
  coalesce(status in ('failed', 'blocked', 'violation'), false) as is_error,
  coalesce(event_type in ('policy_check_failed', 'agent_boundary_violation'), false)
    or coalesce(status in ('blocked', 'violation'), false) as is_policy_blocked,
  coalesce(boundary_violated, false) as is_boundary_violation,
  coalesce(sensitivity_level in ('HIGH', 'CRITICAL'), false) as is_high_sensitivity,
  coalesce(event_type = 'human_feedback_received', false) as is_human_correction
from ({TRACE_EVENTS_SQL})
where trace_id is not null and tenant_id is not null and user_id is not null and event_type is not null)"""


def over_staged(body: str, *ctes: str) -> str:
    return "with " + ",\n".join([STAGED, *ctes]) + "\n" + body


def n_if(cond: str, name: str) -> str:
    return f"count(*) filter (where {cond}) as {name}"


def n_type(event: str, name: str) -> str:
    return n_if(f"event_type = '{event}'", name)


def any_if(cond: str) -> str:
    return f"coalesce(bool_or({cond}), false)"


def dlist(col: str, sep: str = ", ") -> str:
    return f"coalesce(string_agg(distinct {col}, '{sep}' order by {col}), '')"


def olist(col: str, cond: str, sep: str) -> str:
    return (f"coalesce(string_agg({col}, '{sep}' order by event_timestamp nulls last, trace_id) "
            f"filter (where {cond} and {col} is not null), '')")


def pct(part: str, whole: str, digits: int = 1) -> str:
    return f"round(({part})::double * 100 / nullif(({whole}), 0)::double, {digits})"
