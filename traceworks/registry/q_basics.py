"""Single operators: aggregates, windows, scalars, projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from traceworks import fixtures as fx
from traceworks.functions.times import day, millis_between, minutes_between, parse_ts
from traceworks.functions.redact import redact_label
from traceworks.operators import aggregates as agg
from traceworks.operators import clean, dedup, profile
from traceworks.plans import ledger, marts, summary
from traceworks.operators.sliced import sequence_in_group, with_texts
from traceworks.registry.base import query, table
from traceworks.registry.q_audit import RUNS, runs
from traceworks.registry.q_ledger import DIM_USERS, SESSION_SQL, TIMELINE_SQL, VIOLATIONS_SQL, staged
from traceworks.registry.sql import any_if, dlist, n_if, olist, over_staged, pct
from traceworks.sources import files


@query("a01_group_by_keys", """select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as qty
from lineitem group by 1, 2""")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("a02_conditional_counts", over_staged(f"select tenant_id, {n_if('is_error', 'errors')}, {n_if('pii_detected', 'pii')} from staged group by 1"))
def _(spark, sf):
    return staged(spark, sf).groupBy("tenant_id").agg(*agg.tally(errors="is_error", pii="pii_detected"))


@query("a03_distinct_counts", over_staged("""select tenant_id, count(distinct session_id) as sessions,
  count(distinct model_name) as models from staged group by 1"""))
def _(spark, sf):
    return staged(spark, sf).groupBy("tenant_id").agg(*agg.distinct_counts(sessions="session_id", models="model_name"))


@query("a04_distinct_lists", over_staged(f"""select tenant_id, workspace_id, {dlist('datasource_name')} as datasources,
  {dlist('agent_name', '|')} as agents from staged group by 1, 2"""))
def _(spark, sf):
    return staged(spark, sf).groupBy("tenant_id", "workspace_id").agg(
        agg.distinct_list("datasource_name").alias("datasources"), agg.distinct_list("agent_name", "|").alias("agents"))


@query("a05_ordered_lists", over_staged(f"""select session_id, {olist('ai_action_summary', 'is_agent_event', ' | ')} as actions
  from staged group by 1"""))
def _(spark, sf):
    rows = staged(spark, sf)
    texts = ledger.in_event_order(rows, ["session_id"], actions=ledger.AGENT_ACTIONS)
    return with_texts(rows.select("session_id").distinct(), ["session_id"], texts, ["actions"])


@query("a06_conditional_max", over_staged("""select request_id, max(question_text) filter (where event_type = 'request_received') as question,
  max(sql_text) filter (where event_type = 'sql_executed') as executed from staged group by 1"""))
def _(spark, sf):
    def pick(event: str, col: str) -> Column:
        return F.max(F.when(ledger.kind(event), F.col(col)))

    return staged(spark, sf).groupBy("request_id").agg(
        pick("request_received", "question_text").alias("question"), pick("sql_executed", "sql_text").alias("executed"))


@query("a07_zero_guarded_rates", over_staged(f"""select workspace_id, model_name, {pct("count(*) filter (where event_type = 'sql_blocked')",
  "count(*) filter (where event_type = 'sql_generated')")} as block_rate from staged group by 1, 2"""))
def _(spark, sf):
    return staged(spark, sf).groupBy("workspace_id", "model_name").agg(agg.rate_pct(
        F.count_if(ledger.kind("sql_blocked")), F.count_if(ledger.kind("sql_generated"))).alias("block_rate"))


@query("a08_risk_tiers", over_staged(f"""select user_id, case when {any_if('is_boundary_violation')} then 'CRITICAL'
  when {any_if("event_type = 'sql_blocked'")} then 'HIGH' when {any_if('is_policy_blocked')} then 'MEDIUM' else 'LOW' end as tier
  from staged group by 1"""))
def _(spark, sf):
    return staged(spark, sf).groupBy("user_id").agg(agg.first_match([
        (agg.some("is_boundary_violation"), "CRITICAL"), (agg.some(ledger.kind("sql_blocked")), "HIGH"),
        (agg.some("is_policy_blocked"), "MEDIUM")], "LOW").alias("tier"))


@query("a09_most_severe_level", over_staged(f"select tenant_id, workspace_id, user_id, highest_sensitivity_seen as level from ({DIM_USERS})"))
def _(spark, sf):
    return staged(spark, sf).groupBy("tenant_id", "workspace_id", "user_id").agg(
        agg.most_severe("sensitivity_level").alias("level"))


@query("a11_first_error", """select l_linenumber, min_by('err-' || l_linestatus, {'a': l_shipdate, 'b': l_orderkey, 'c': l_linestatus}) as first_error
from lineitem where l_returnflag = 'R' group by 1""")
def _(spark, sf):
    failed = table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    return failed.groupBy("l_linenumber").agg(F.min_by(
        F.concat(F.lit("err-"), F.col("l_linestatus")),
        F.struct("l_shipdate", "l_orderkey", "l_linestatus")).alias("first_error"))


@query("a13_whole_row_duplicates", """select count(*) as row_count, u as unique_rows, count(*) - u as duplicate_rows from
  (select l_shipdate, l_quantity, l_discount from lineitem), (select count(*) as u from
  (select distinct l_shipdate, l_quantity, l_discount from lineitem)) group by u""")
def _(spark, sf):
    return profile.duplicate_rows(table(spark, sf, "lineitem").select("l_shipdate", "l_quantity", "l_discount"))


# Windows over requests ----------------------------------------------------------
for _name, _cols in {
    "w01_event_sequence": ["trace_id", "event_sequence"],
    "w02_request_bounds": ["trace_id", "request_started_at", "request_ended_at"],
    "w03_request_timing": ["trace_id", "ms_since_request_start", "total_request_ms"],
}.items():
    query(_name, over_staged(f"select {', '.join(_cols)} from t", f"t as ({TIMELINE_SQL})"))(
        lambda spark, sf, c=_cols: ledger.request_timeline(staged(spark, sf)).select(*c))


_HOT_SEQUENCE = over_staged("""select trace_id, row_number() over (partition by tenant_id
  order by event_timestamp nulls last, trace_id) as event_sequence from staged""")


@query("w01_sequence_of_hot_group", _HOT_SEQUENCE)
def _(spark, sf):
    """Four groups hold all rows: what goes beyond the bound is cut into pieces."""
    return sequence_in_group(staged(spark, sf), ["tenant_id"], "event_timestamp", "trace_id").select(
        "trace_id", "event_sequence")


@query("w01_sequence_of_cut_groups", _HOT_SEQUENCE)
def _(spark, sf):
    """The same with a bound that the four groups exceed on small data too."""
    return sequence_in_group(staged(spark, sf), ["tenant_id"], "event_timestamp", "trace_id", 200).select(
        "trace_id", "event_sequence")


@query("o01_report_order", over_staged(f"""select session_id, session_started_at, total_events from ({SESSION_SQL})
  order by session_started_at desc"""))
def _(spark, sf):
    return ledger.session_overview(staged(spark, sf)).select(
        "session_id", "session_started_at", "total_events").orderBy(F.desc("session_started_at"))


# Scalars ------------------------------------------------------------------------
@query("f01_parsed_times", f"select trace_id, try_cast(event_timestamp as timestamp) as ts from ({fx.TRACE_EVENTS_SQL})")
def _(spark, sf):
    return fx.trace_events(spark, sf).select("trace_id", parse_ts("event_timestamp").alias("ts"))


@query("p01_typed_projection", f"select trace_id, tenant_id, try_cast(event_timestamp as timestamp) as event_timestamp, status from ({fx.TRACE_EVENTS_SQL})")
def _(spark, sf):
    return fx.trace_events(spark, sf).select(
        "trace_id", "tenant_id", parse_ts("event_timestamp").alias("event_timestamp"), "status")


@query("f02_day_of_time", "select event_id, date_trunc('day', ts)::timestamp as day from events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", day("ts").alias("day"))


@query("f03_minutes_between", "select o_orderkey, date_diff('minute', a, b) as minutes from (select o_orderkey, "
       "o_orderdate + to_seconds(o_orderkey % 61) as a, o_orderdate + to_seconds(o_orderkey % 61 + o_custkey % 200) as b from orders)")
def _(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "timestampadd(SECOND, o_orderkey % 61, o_orderdate) as a",
        "timestampadd(SECOND, o_orderkey % 61 + o_custkey % 200, o_orderdate) as b")
    return rows.select("o_orderkey", minutes_between(F.col("a"), F.col("b")).alias("minutes"))


@query("f12_millis_between", "select event_id, date_diff('millisecond', date_trunc('hour', ts), ts) as ms from events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", millis_between(F.date_trunc("hour", "ts"), F.col("ts")).alias("ms"))


_RAW = f"({fx.RAW_ORDERS_SQL})"


@query("f04_iso_dates", f"select position, strftime(try_cast(ordered_on as timestamp), '%Y-%m-%dT%H:%M:%S') as ordered_on from {_RAW}")
def _(spark, sf):
    return fx.raw_orders(spark, sf).select("position", clean.iso_text(F.col("ordered_on")).alias("ordered_on"))


@query("f05_numbers", f"select position, try_cast(amount as double) as amount from {_RAW}")
def _(spark, sf):
    return fx.raw_orders(spark, sf).select("position", clean.number_or_null(F.col("amount")).alias("amount"))


@query("f09_redact_labels", """select c_custkey, '***REDACTED***' as high, '***FINANCIAL***' as financial, '***PII***' as medium,
  '***PII***' as low, '***' as other from customer""")
def _(spark, sf):
    levels = {"high": "PII_HIGH", "financial": "FINANCIAL", "medium": "PII_MEDIUM", "low": "PII_LOW", "other": "X"}
    return table(spark, sf, "customer").select(
        "c_custkey", *[F.lit(redact_label(level)).alias(name) for name, level in levels.items()])


# Projections ----------------------------------------------------------------------
@query("p06_violation_filter", over_staged(f"select trace_id, violation_type from ({VIOLATIONS_SQL})"))
def _(spark, sf):
    return ledger.policy_violations(staged(spark, sf)).select("trace_id", "violation_type")


@query("p11_identifier_names", "select c_custkey as cust_key, c_name as customer_full_name, c_acctbal as acct_bal from customer")
def _(spark, sf):
    raw = table(spark, sf, "customer").selectExpr(
        "c_custkey as `custKey`", "c_name as `Customer  Full-Name`", "c_acctbal as `acct.Bal`")
    return files.staging_projection(raw)


@query("p17_chartable", "select count(*) > 1 as chartable from lineitem")
def _(spark, sf):
    return summary.chartable(table(spark, sf, "lineitem"))


# Sets ---------------------------------------------------------------------------
@query("u05_merged_tests", """select distinct kind, lower(p_brand) as column_name, "values" from (
  select case when p_partkey % 3 = 0 then 'unique' else 'accepted_values' end as kind, replace(p_brand, '#', '_') as p_brand,
    case when p_partkey % 3 = 0 then '' else p_type end as "values" from part)""")
def _(spark, sf):
    tests = table(spark, sf, "part").selectExpr(
        "if(p_partkey % 3 = 0, 'unique', 'accepted_values') as kind", "p_brand as column_name",
        "if(p_partkey % 3 = 0, array(), array(p_type)) as values")
    merged = summary.merged_tests(tests.where("kind = 'unique'"), tests.where("kind <> 'unique'"))
    return merged.withColumn("values", F.array_join("values", ","))


@query("u06_allowed_actions", """select s_suppkey, array_to_string(list_filter(['query', 'export', 'explain'],
  lambda a: not list_contains(case when s_suppkey % 2 = 0 then ['export'] else [] end, a)), ',') as actions from supplier""")
def _(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.array_join(F.array_except(
        F.array(F.lit("query"), F.lit("export"), F.lit("explain")),
        F.expr("if(s_suppkey % 2 = 0, array('export'), array())")), ",").alias("actions"))


@query("c08_run_summary", f"""select run_id, '[INGEST]  ' || table_name || ' (' || format('{{:,}}', row_count) || ' rows)' as ingest_line,
  case when failed_steps = 0 then '[QUALITY] CLEAN' else '[QUALITY] ' || failed_steps || ' issue(s)' end as quality_line,
  case when total_steps > 0 then '[DBT]     ' || total_steps || ' artifact(s) generated' else '[DBT]     Not run' end as artifact_line
from ({RUNS})""")
def _(spark, sf):
    return summary.run_summary(runs(spark, sf).withColumnsRenamed({"failed_steps": "issues", "total_steps": "artifacts"}))


@query("w08_last_row_per_key", """select * exclude (rn) from (select *, row_number() over (partition by o_custkey
  order by o_orderdate desc, o_orderkey desc) as rn from orders) where rn = 1""")
def _(spark, sf):
    return dedup.keep_last(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("x04_ledger_sink_noop", f"select count(*) as n from ({fx.TRACE_EVENTS_SQL})")
def _(spark, sf):
    from traceworks.sources.sinks import NoopSink

    raw = fx.trace_events(spark, sf)
    NoopSink().append(raw)
    return raw.agg(F.count("*").alias("n"))


@query("x05_audited_step", f"""select unnest(['run-a', 'run-b']) as run_id, 'quality_agent' as agent_name, 'count_rows' as tool_name,
  (select count(*) from ({fx.TRACE_EVENTS_SQL}))::varchar as result_preview, true as success""")
def _(spark, sf):
    """Step rows written by two audited calls over the whole ledger."""
    from traceworks.sources import sinks

    path = sinks.scratch_path(spark, "steps")

    @sinks.audited("quality_agent", path)
    def count_rows(spark, run_id):
        return fx.trace_events(spark, sf).count()

    count_rows(spark, "run-a")
    count_rows(spark, "run-b")
    return spark.read.parquet(path).select("run_id", "agent_name", "tool_name", "result_preview", "success")


@query("m09_users_all_workspaces", over_staged("""select tenant_id, user_id, count(distinct workspace_id) as workspaces,
  count(*) as total_events from staged group by 1, 2"""))
def _(spark, sf):
    return marts.dim_users(staged(spark, sf)).groupBy("tenant_id", "user_id").agg(
        F.count("*").alias("workspaces"), F.sum("total_events").alias("total_events"))
