"""Pipeline monitoring, cost and budget queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceworks import fixtures as fx
from traceworks.functions import prices
from traceworks.plans import audit, cost
from traceworks.registry.base import query, table
from traceworks.registry.q_ledger import staged
from traceworks.registry.q_quality import lit
from traceworks.registry.sql import over_staged, pct

RUNS, STEPS, CALLS = fx.audit_sql("runs"), fx.audit_sql("steps"), fx.audit_sql("llm_calls")
MUTATIONS, EVENTS = fx.audit_sql("mutations"), fx.audit_sql("compliance_events")


def _t(name):
    return lambda spark, sf: fx.audit_table(spark, sf, name)


runs, steps, calls, mutations, events = map(
    _t, ["runs", "steps", "llm_calls", "mutations", "compliance_events"])


def _rate_sql(model: str, table_: dict, default, i: int, prefix: bool = False) -> str:
    names = sorted(table_, key=len, reverse=True)
    test = (lambda n: f"starts_with(lower({model}), '{n}')") if prefix else (lambda n: f"{model} = '{n}'")
    arms = " ".join(f"when {test(n)} then {round(table_[n][i] * 1000)}" for n in names)
    return f"(case {arms} else {round(default[i] * 1000)} end)"


def nanos_sql(table_: dict, default, prefix: bool = False) -> str:
    return (f"(prompt_tokens::bigint * {_rate_sql('model', table_, default, 0, prefix)} + "
            f"completion_tokens::bigint * {_rate_sql('model', table_, default, 1, prefix)})::bigint")


def usd_sql(expr: str, digits: int = 6) -> str:
    unit = 10 ** (9 - digits)
    return f"(floor((({expr})::bigint + {unit // 2}) / {unit}.0::double) / {float(10 ** digits)}::double)"


PRICED = f"(select *, prompt_tokens + completion_tokens as total_tokens, {nanos_sql(prices.AUDIT_PRICES, prices.AUDIT_DEFAULT)} as nanos from ({CALLS}))"
CONTROLLED = f"(select *, prompt_tokens + completion_tokens as total_tokens, {nanos_sql(prices.CONTROL_PRICES, prices.CONTROL_DEFAULT)} as nanos from ({CALLS}))"

RECENT_SQL = f"""select run_id, started_at, duration_ms, status, table_name, row_count, llm_provider, llm_model,
  compliance_status, total_steps, failed_steps, total_tokens, round(estimated_cost_usd, 6) as estimated_cost_usd
from ({RUNS}) order by started_at desc, run_id limit """


@query("l01_recent_runs", RECENT_SQL + "20")
def _(spark, sf):
    return audit.recent_runs(runs(spark, sf))


PERF_SQL = f"""select tool_name, count(*) as total_calls,
  round(avg(success::int) * 100, 1) as success_rate_pct, round(avg(duration_ms)) as avg_ms,
  round(quantile_cont(duration_ms::double, 0.5)) as p50_ms, round(quantile_cont(duration_ms::double, 0.95)) as p95_ms
from ({STEPS}) group by 1"""


@query("l02_tool_performance", PERF_SQL)
def _(spark, sf):
    return audit.tool_performance(steps(spark, sf))


@query("a10_exact_percentiles", """select l_returnflag, l_linestatus,
  round(quantile_cont(l_extendedprice, 0.5), 4) as p50, round(quantile_cont(l_extendedprice, 0.95), 4) as p95
from lineitem group by 1, 2""")
def _(spark, sf):
    from traceworks.operators.quantiles import exact_percentiles

    out = exact_percentiles(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice",
                            {"p50": 0.5, "p95": 0.95})
    return out.withColumns({c: F.round(c, 4) for c in ("p50", "p95")})


_MUTATED = f"select *, abs(rows_after - rows_before) as rows_affected from ({MUTATIONS})"


@query("l03_mutation_history", f"{_MUTATED} order by mutated_at desc, mutation_id limit 100")
def _(spark, sf):
    return audit.mutation_history(mutations(spark, sf))


@query("p08_mutations_of_run", f"select * from ({_MUTATED}) where run_id = 'run-17'")
def _(spark, sf):
    return audit.mutation_history(mutations(spark, sf), run_id="run-17")


@query("l04_model_costs", f"""select provider, model, count(*) as total_calls,
  sum(total_tokens)::bigint as total_tokens, {usd_sql('sum(nanos)')} as total_cost_usd,
  {usd_sql('floor(sum(nanos)::double / count(*))')} as avg_cost_per_call_usd
from {PRICED} group by 1, 2""")
def _(spark, sf):
    return audit.model_costs(calls(spark, sf))


@query("l05_compliance_events", f"select * from ({EVENTS}) order by event_ts desc, event_id limit 200")
def _(spark, sf):
    return audit.compliance_events(events(spark, sf))


TRENDS_SQL = f"""select column_name, pii_type, sensitivity,
  count(*) filter (where event_type = 'PII_DETECTED') as detection_count,
  count(*) filter (where event_type = 'MASKING_APPLIED') as masked_count,
  {pct("count(*) filter (where event_type = 'MASKING_APPLIED')",
       "count(*) filter (where event_type = 'PII_DETECTED')")} as mask_rate_pct
from ({EVENTS}) where event_type in ('PII_DETECTED', 'MASKING_APPLIED') and column_name <> '' group by 1, 2, 3"""


@query("l06_pii_trends", TRENDS_SQL)
def _(spark, sf):
    return audit.pii_trends(events(spark, sf))


HINT_SQL = "case tool_name " + " ".join(
    f"when '{k}' then {lit(v)}" for k, v in audit.FIX_HINTS.items()) + f" else {lit(audit.DEFAULT_HINT)} end"
FAILURES_SQL = f"""select tool_name, count(*) as failure_count, max(started_at) as last_seen,
  min_by(error_message, {{'a': started_at, 'b': step_id, 'c': error_message}}) as sample_error,
  {HINT_SQL} as suggested_fix
from ({STEPS}) where not success and error_message is not null group by tool_name"""


@query("l07_failure_analysis", FAILURES_SQL)
def _(spark, sf):
    return audit.failure_analysis(steps(spark, sf))


@query("j03_hint_lookup", f"select tool_name, {HINT_SQL} as hint, count(*) as steps from ({STEPS}) group by 1, 2")
def _(spark, sf):
    hint = audit.lookup(F.col("tool_name"), audit.FIX_HINTS, audit.DEFAULT_HINT)
    counted = steps(spark, sf).groupBy("tool_name").agg(F.count("*").alias("steps"))
    return counted.withColumn("hint", hint)


_OUTLIERS = f"""select run_id, table_name, total_steps, estimated_cost_usd, m as median_cost
from ({RECENT_SQL} 100), (select quantile_cont(estimated_cost_usd, 0.5) as m from ({RECENT_SQL} 100))
where estimated_cost_usd > m * 2"""


@query("a14_cost_outliers", _OUTLIERS)
def _(spark, sf):
    return audit.cost_outliers(runs(spark, sf))


@query("l08_refinement_report", f"""select 'reliability' as section, tool_name as item,
  concat(success_rate_pct, '% success (', total_calls, ' calls): ',
    {HINT_SQL.replace(lit(audit.DEFAULT_HINT), lit('Review logs.'))}) as detail
from ({PERF_SQL}) where success_rate_pct < 95
union all select 'performance', tool_name, concat('p95=', p95_ms, 'ms avg=', avg_ms, 'ms')
from ({PERF_SQL}) where p95_ms > 10000
union all (select 'cost', run_id, concat('$', estimated_cost_usd, ' table=', table_name, ' steps=', total_steps)
  from ({_OUTLIERS}) order by estimated_cost_usd desc, run_id limit 5)
union all (select 'compliance_gap', column_name, concat('sensitivity=', sensitivity, ' run=', run_id)
  from ({EVENTS}) where event_type = 'POLICY_VIOLATION' order by event_ts desc, event_id limit 10)
union all select 'masking_gap', column_name, concat('type=', coalesce(pii_type, 'null'), ' detected=',
  detection_count, ' masked=', masked_count) from ({TRENDS_SQL}) where coalesce(mask_rate_pct, 0) < 50
union all (select 'failure', tool_name, concat('x', failure_count, ' last=', last_seen, ': ', sample_error[:100])
  from ({FAILURES_SQL}) order by failure_count desc, tool_name limit 5)""")
def _(spark, sf):
    return audit.refinement_report(steps(spark, sf), runs(spark, sf), events(spark, sf))


@query("l09_finalised_runs", f"""select s.*, coalesce(c.total_tokens, 0)::bigint as total_tokens,
  {usd_sql('coalesce(c.nanos, 0)')} as estimated_cost_usd
from (select run_id, min(started_at) as started_at, max(started_at) as completed_at,
  sum(duration_ms)::bigint as duration_ms, count(*) as total_steps,
  count(*) filter (where not success) as failed_steps from ({STEPS}) group by 1) s
left join (select run_id, sum(total_tokens) as total_tokens, sum(nanos) as nanos from {PRICED} group by 1) c
  using (run_id)""")
def _(spark, sf):
    return audit.finalised_runs(steps(spark, sf), calls(spark, sf))


@query("j14_ledger_runs", over_staged(
    """select e.etl_run_id, event_type, count(*) as events, r.status as run_status, r.compliance_status
from staged e left join runs r on r.run_id = e.etl_run_id group by all""", f"runs as ({RUNS})"))
def _(spark, sf):
    return audit.with_run_status(staged(spark, sf), runs(spark, sf))


# Cost ---------------------------------------------------------------------
def _spend_sql(keys: str) -> str:
    return f"""select {keys}, count(*) as llm_calls, sum(total_tokens)::bigint as total_tokens,
  sum(nanos)::bigint as cost_nanos from {CONTROLLED} group by all"""


@query("k01_spend_by_agent", _spend_sql("run_id, agent_name"))
def _(spark, sf):
    return cost.spend_by(calls(spark, sf), "run_id", "agent_name")


@query("k01_spend_by_day", _spend_sql("call_ts[:10] as day"))
def _(spark, sf):
    return cost.spend_by(calls(spark, sf), cost.day_of("call_ts").alias("day"))


@query("f06_spend_by_month", _spend_sql("call_ts[:7] as month"))
def _(spark, sf):
    return cost.spend_by(calls(spark, sf), cost.month_of("call_ts").alias("month"))


AS_OF = "1998-08-01"


@query("a16_spend_totals", f"""select {usd_sql("coalesce(sum(nanos) filter (where run_id = 'run-17'), 0)")} as run_usd,
  {usd_sql(f"coalesce(sum(nanos) filter (where starts_with(call_ts, '{AS_OF}')), 0)")} as day_usd,
  {usd_sql(f"coalesce(sum(nanos) filter (where starts_with(call_ts, '{AS_OF[:7]}')), 0)")} as month_usd,
  coalesce(sum(total_tokens) filter (where run_id = 'run-17'), 0)::bigint as run_tokens from {CONTROLLED}""")
def _(spark, sf):
    return cost.spend_summary(calls(spark, sf), AS_OF, "run-17")


@query("p09_day_and_month_calls", f"""select call_id, call_ts, starts_with(call_ts, '{AS_OF}') as that_day
from ({CALLS}) where starts_with(call_ts, '{AS_OF[:7]}')""")
def _(spark, sf):
    return calls(spark, sf).where(F.col("call_ts").startswith(AS_OF[:7])).select(
        "call_id", "call_ts", F.col("call_ts").startswith(AS_OF).alias("that_day"))


@query("k02_budget_check", f"""select limit_type, period, spent_usd, floor(spent_usd / lim * 100 * 10 + 0.5) / 10.0::double as pct,
  case when spent_usd / lim * 100 >= 100 then 'STOP' when spent_usd / lim * 100 >= 80 then 'WARN' else 'OK' end as state,
  greatest(0.0::double, round(lim - spent_usd, 6)) as remaining_usd
from (select 'per_run' as limit_type, run_id as period, 1.0::double as lim, {usd_sql('sum(nanos)')} as spent_usd
      from {CONTROLLED} group by 2
  union all select 'per_day', call_ts[:10], 10.0, {usd_sql('sum(nanos)')} from {CONTROLLED} group by 2
  union all select 'per_month', call_ts[:7], 50.0, {usd_sql('sum(nanos)')} from {CONTROLLED} group by 2)""")
def _(spark, sf):
    return cost.budget_check(calls(spark, sf))


# Limits far below the defaults, so that the given spend reaches them.
TIGHT = cost.Budget(per_day=0.1, per_month=0.8)


@query("k03_dashboard", f"""with s as (select
    {usd_sql(f"coalesce(sum(nanos) filter (where starts_with(call_ts, '{AS_OF}')), 0)", 4)} as today_usd,
    {usd_sql(f"coalesce(sum(nanos) filter (where starts_with(call_ts, '{AS_OF[:7]}')), 0)", 4)} as month_usd
  from {CONTROLLED}),
m as (select model from {CONTROLLED} group by 1 order by sum(nanos) desc, 1 desc limit 1),
r as (select count(distinct run_id) filter (where starts_with(started_at, '{AS_OF}')) as runs_today,
  max_by(run_id, {{'a': estimated_cost_usd, 'b': run_id}}) as most_expensive_run,
  max(estimated_cost_usd) as most_expensive_usd from ({RUNS}))
select today_usd, month_usd, greatest(0.0::double, round(0.1 - today_usd, 4)) as today_remaining_usd,
  greatest(0.0::double, round(0.8 - month_usd, 4)) as month_remaining_usd,
  floor(today_usd / 0.1::double * 100 * 10 + 0.5) / 10.0::double as today_pct, floor(month_usd / 0.8::double * 100 * 10 + 0.5) / 10.0::double as month_pct,
  case when greatest(today_usd / 0.1, month_usd / 0.8) >= 1 then 'EXCEEDED'
    when greatest(today_usd / 0.1, month_usd / 0.8) >= 0.8 then 'WARNING'
    when greatest(today_usd / 0.1, month_usd / 0.8) >= 0.48 then 'WATCH' else 'OK' end as status,
  runs_today, case when runs_today > 0 then round(today_usd / runs_today, 4) else 0 end as avg_cost_per_run_usd,
  model as top_cost_model, most_expensive_run, most_expensive_usd
from s, m, r""")
def _(spark, sf):
    return cost.dashboard(calls(spark, sf), runs(spark, sf), AS_OF, TIGHT)


@query("o03_top_model_and_run", f"""select (select model from {CONTROLLED} group by 1 order by sum(nanos) desc, 1 desc
  limit 1) as top_cost_model, max_by(run_id, {{'a': estimated_cost_usd, 'b': run_id}}) as most_expensive_run
from ({RUNS})""")
def _(spark, sf):
    return cost.dashboard(calls(spark, sf), runs(spark, sf), AS_OF).select("top_cost_model", "most_expensive_run")


_PLAN_COLUMNS = "run_id, cast(pii_columns_count * 5 + 3 as bigint) as column_count, row_count * 1000 as row_count, llm_model as model"


@query("k04_run_estimate", f"""select *, case when nanos / 1e9 >= 1 then 'exceeds run budget'
  when nanos / 1e7 >= 80 then 'watch spend' else 'within budget' end as advice from (
select run_id, column_count, row_count, model, t as token_estimate, i as input_tokens, o as output_tokens,
  {usd_sql('nanos')} as cost_estimate_usd, {usd_sql('floor(nanos * 6 / 10.0::double)')} as cost_low_usd,
  {usd_sql('floor(nanos * 14 / 10.0::double)')} as cost_high_usd, nanos
from (select *, (i * {_rate_sql('model', prices.CONTROL_PRICES, prices.CONTROL_DEFAULT, 0)}
    + o * {_rate_sql('model', prices.CONTROL_PRICES, prices.CONTROL_DEFAULT, 1)})::bigint as nanos
  from (select *, floor(t * 0.6::double)::bigint as i, floor(t * 0.4::double)::bigint as o
    from (select *, (12200 + column_count * 240 + floor(row_count / 1000 * 20))::bigint as t
      from (select {_PLAN_COLUMNS} from ({RUNS}))))))""".replace("select *, case when nanos", "select * exclude (nanos), case when nanos"))
def _(spark, sf):
    return cost.estimate_runs(runs(spark, sf).selectExpr(*[
        "run_id", "cast(pii_columns_count * 5 + 3 as bigint) as column_count", "row_count * 1000 as row_count",
        "llm_model as model"]))


GUARDED = nanos_sql(prices.GUARD_PREFIX_PRICES, prices.GUARD_DEFAULT, prefix=True)


@query("k05_daily_guard", f"""select *, greatest(0.0::double, round(0.05::double - spent_usd, 6)) as remaining_usd,
  floor(spent_usd * 100 / 0.05::double * 10 + 0.5) / 10.0::double as pct_used, spent_usd >= 0.05 as exhausted
from (select call_ts[:10] as date, {usd_sql(f'sum({GUARDED})')} as spent_usd, count(*) as calls
  from ({CALLS}) group by 1)""")
def _(spark, sf):
    return cost.daily_guard(calls(spark, sf), cost.Budget(daily_guard=0.05))


@query("j05_longest_prefix_price", f"select call_id, model, {GUARDED} as cost_nanos from ({CALLS})")
def _(spark, sf):
    rate = prices.prefix_rate(F.col("model"))
    return calls(spark, sf).select("call_id", "model", prices.cost_nanos(
        rate, F.col("prompt_tokens"), F.col("completion_tokens")).alias("cost_nanos"))


@query("j04_exact_price", f"select call_id, model, nanos as cost_nanos, nanos / 1e9::double as cost_usd from {PRICED}")
def _(spark, sf):
    return audit.priced_calls(calls(spark, sf)).select(
        "call_id", "model", "cost_nanos", prices.usd(F.col("cost_nanos"), 9).alias("cost_usd"))


@query("f21_token_cost", f"select call_id, {usd_sql('nanos')} as cost_usd from {CONTROLLED}")
def _(spark, sf):
    priced = audit.priced_calls(calls(spark, sf), prices.CONTROL_PRICES, prices.CONTROL_DEFAULT)
    return priced.select("call_id", prices.usd(F.col("cost_nanos")).alias("cost_usd"))


_CHEAPER = "case model " + " ".join(f"when '{a}' then '{b}'" for a, b in prices.FALLBACKS.items()) + " end"


@query("k06_model_downgrade", f"""select call_id, model, budget_pct, coalesce(case when budget_pct < 80 then model
  when budget_pct < 95 and c is not null then c when budget_pct >= 95 then 'llama3.1' else c end, model) as next_model
from (select call_id, model, (prompt_tokens % 110)::double as budget_pct, {_CHEAPER} as c from ({CALLS}))""")
def _(spark, sf):
    return cost.downgrade(calls(spark, sf).selectExpr(
        "call_id", "model", "cast(prompt_tokens % 110 as double) as budget_pct"))


@query("j06_model_fallback", f"select model, {_CHEAPER} as cheaper, count(*) as calls from ({CALLS}) group by 1, 2")
def _(spark, sf):
    counted = calls(spark, sf).groupBy("model").agg(F.count("*").alias("calls"))
    return counted.withColumn("cheaper", prices.fallback_model(F.col("model")))


@query("f22_estimated_tokens", "select doc_id, (length(text) // 4)::bigint as tokens from documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", prices.estimated_tokens(F.col("text")).alias("tokens"))


@query("a12_step_averages", f"""select agent_name, round(avg(success::int) * 100, 1) as success_pct,
  sum(duration_ms)::bigint as total_ms, max(duration_ms) as max_ms, round(avg(duration_ms), 3) as avg_ms
from ({STEPS}) group by 1""")
def _(spark, sf):
    return steps(spark, sf).groupBy("agent_name").agg(
        F.round(F.avg(F.col("success").cast("int")) * 100, 1).alias("success_pct"),
        F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"),
        F.round(F.avg("duration_ms"), 3).alias("avg_ms"))


@query("f20_truncations", f"""select doc_id, text[:200] as args, text[:500] as preview from documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.left("text", F.lit(200)).alias("args"), F.left("text", F.lit(500)).alias("preview"))
