"""Loads, sinks, catalog metadata, event construction and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceworks import fixtures as fx
from traceworks.functions import redact, register as sql_functions, tablefuncs
from traceworks.plans import emit, metrics, policy, replay
from traceworks.plans.ledger import complete_rows, with_flags
from traceworks.registry.base import ORACLES, query, table
from traceworks.registry.q_audit import RUNS, runs
from traceworks.registry.q_ledger import REQUEST_CTES, staged
from traceworks.registry.q_policy import MODELS_SQL, MODEL_META, _NODE, _SCALARS
from traceworks.registry.q_quality import CLEAN_CONFIG, CLEAN_SQL, _mask_sql, _summarise_sql
from traceworks.registry.sql import over_staged, pct
from traceworks.operators.clean import clean
from traceworks.sources import bars_source, files, sinks, warehouse
from traceworks.sources.file_table import FileTable


def _written(spark, df, name, fmt, **options):
    path = sinks.scratch_path(spark, name) + "." + fmt
    writer = df.write.options(**options)
    {"csv": writer.csv, "json": writer.json, "parquet": writer.parquet, "txt": writer.csv}[fmt](path)
    return path


@query("s01_csv_load", "select * from customer")
def _(spark, sf):
    path = _written(spark, table(spark, sf, "customer"), "customer", "csv", header=True)
    return files.read_file(spark, path)


@query("s02_parquet_load", "select * from orders")
def _(spark, sf):
    path = _written(spark, table(spark, sf, "orders"), "orders", "parquet")
    return files.read_file(spark, path)


@query("s02_named_table_replaced_then_appended", "select * from nation union all select * from nation")
def _(spark, sf):
    """The first load replaces what an earlier run left in the table, the second one adds to it."""
    path = _written(spark, table(spark, sf, "nation"), "nation", "parquet")
    place = sinks.scratch_path(spark, "nation_table")
    name = files.load_table(spark, path, "traceworks_nation_load", location=place)
    return spark.table(files.load_table(spark, path, name, mode="append", location=place))


@query("s04_json_lines_load", "select p_partkey, p_name, p_size, p_retailprice from part")
def _(spark, sf):
    path = _written(spark, table(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"),
                    "part", "json")
    return files.read_file(spark, path)


@query("s05_headerless_tsv_load", "select s_suppkey as _c0, s_name as _c1, s_acctbal as _c2 from supplier")
def _(spark, sf):
    path = _written(spark, table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal"), "supplier",
                    "txt", sep="\t")
    return files.read_file(spark, path)


@query("s07_mixed_encodings", "select doc_id, text from documents")
def _(spark, sf):
    encoded = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8"))
                                                   .otherwise(F.encode("text", "UTF-16")).alias("content"))
    return encoded.select("doc_id", files.decoded(F.col("content")).alias("text"))


_PATHS = """concat('/data/In Box/', case o_orderkey % 9 when 0 then 'Sales-Q4 2024.csv' when 1 then 'a.b.JSON'
  when 2 then 'notes.md' when 3 then 'Report.PDF' when 4 then 'page.html' when 5 then 'blob' when 6 then 'x.parquet'
  when 7 then 'deck.pptx' else concat('part ', cast(o_custkey as varchar(20)), '.txt') end)"""


@query("s08_table_names", f"""select o_orderkey, lower(regexp_replace(regexp_replace(regexp_extract({_PATHS}, '([^/]+)$', 1),
  '(.)\\.[^.]*$', '\\1'), '[- ]', '_', 'g')) as table_name from orders""")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", files.table_name_of(F.expr(_PATHS)).alias("table_name"))


@query("s10_file_kinds", f"""select o_orderkey, case when e in ('csv', 'json', 'txt', 'parquet', 'html') then 'structured'
  else 'unstructured' end as kind, case when e in ('csv', 'json', 'txt', 'parquet', 'md', 'pdf', 'pptx') then e
  else 'unknown' end as format from (select o_orderkey, lower(regexp_extract({_PATHS}, '\\.([^./]+)$', 1)) as e from orders)""")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", files.file_kind(F.expr(_PATHS)).alias("k")).select(
        "o_orderkey", "k.kind", "k.format")


@query("s09_loaded_summary", """select count(*) as row_count, 's_suppkey:bigint, s_name:string, s_nationkey:int, s_acctbal:double'
  as schema from supplier""")
def _(spark, sf):
    return files.loaded_summary(table(spark, sf, "supplier"))


_STATUS = [
    ("file_id", "concat('tbl_', cast(o_custkey % 50 as varchar(20)), '#/raw/', cast(o_custkey as varchar(20)), '.csv')"),
    ("status", "case o_orderkey % 3 when 0 then 'processed' when 1 then 'failed' else 'processing' end"),
    ("updated_at", "cast(o_orderdate as varchar(40))"),
]
_STATUS_SQL = "select " + ", ".join(f"{e} as {c}" for c, e in _STATUS) + " from orders"
_LATEST = f"""select file_id, max_by(status, {{'a': updated_at, 'b': status}}) as status, max(updated_at) as updated_at
  from ({_STATUS_SQL}) group by 1"""
_LISTING = "concat('tbl_', cast(c_custkey % 50 as varchar(20)), '#/raw/', cast(c_custkey as varchar(20)), '.csv')"


def _history(spark, sf):
    return table(spark, sf, "orders").selectExpr(*[f"{e} as {c}" for c, e in _STATUS])


@query("s11_file_status", _LATEST)
def _(spark, sf):
    return files.latest_status(_history(spark, sf))


@query("s11_files_to_process", f"""select file_id from (select {_LISTING} as file_id from customer)
  where file_id not in (select file_id from ({_LATEST}) where status = 'processed')""")
def _(spark, sf):
    listing = table(spark, sf, "customer").selectExpr(f"{_LISTING} as file_id")
    return files.files_to_process(listing, _history(spark, sf))


@query("s12_cleaned_parquet", CLEAN_SQL)
def _(spark, sf):
    cleaned = clean(fx.raw_orders(spark, sf), CLEAN_CONFIG, ["position"])
    path = sinks.write_cleaned(cleaned, sinks.scratch_path(spark, "lake"), "orders")
    return spark.read.parquet(path)


@query("s14_copy_as_text", "select " + ", ".join(f"cast({c} as varchar) as {c}" for c in (
    "s_suppkey", "s_name", "s_nationkey", "s_acctbal")) + " from supplier")
def _(spark, sf):
    path = _written(spark, warehouse.all_text(table(spark, sf, "supplier")), "copy", "parquet")
    return spark.read.parquet(path)


@query("s15_quotes_stripped", """select cast(c_custkey as varchar) as c_custkey, replace(c_name || '''s', '''', '') as c_name,
  case when c_custkey % 5 = 0 then null else c_mktsegment end as c_mktsegment from customer""")
def _(spark, sf):
    raw = table(spark, sf, "customer").selectExpr(
        "c_custkey", "c_name || '\\'s' as c_name", "if(c_custkey % 5 = 0, null, c_mktsegment) as c_mktsegment")
    return warehouse.without_quotes(raw)


@query("s16_append_then_read", "select n_nationkey, n_name from nation union all select s_suppkey, s_name from supplier")
def _(spark, sf):
    loaded = FileTable(spark, sinks.scratch_path(spark, "load"))
    loaded.sync(table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name"), "append")
    loaded.sync(table(spark, sf, "supplier").selectExpr("cast(s_suppkey as bigint) as n_nationkey", "s_name as n_name"), "append")
    return loaded.read()


@query("s16_truncate_then_load", "select s_suppkey, s_name from supplier")
def _(spark, sf):
    """A full load over an earlier one: the earlier rows are gone."""
    loaded = FileTable(spark, sinks.scratch_path(spark, "load"))
    loaded.sync(table(spark, sf, "nation").selectExpr("cast(n_nationkey as bigint) as s_suppkey", "n_name as s_name"), "append")
    loaded.sync(table(spark, sf, "supplier").selectExpr("cast(s_suppkey as bigint) as s_suppkey", "s_name"), "truncate")
    return loaded.read()


@query("s19_upsert_persisted", """select o_orderkey, case when o_orderkey % 5 = 0 then 'changed' else o_orderstatus end as status,
  case when o_orderkey % 5 = 0 then 1 else 0 end as version from orders
union all select -o_orderkey - 1, 'new', 1 from orders where o_orderkey % 50 = 0""")
def _(spark, sf):
    """Stored orders, then changes of every fifth and some new ones, merged on the key and read back."""
    orders = table(spark, sf, "orders")
    stored = FileTable(spark, sinks.scratch_path(spark, "orders"))
    stored.append(orders.selectExpr("o_orderkey", "o_orderstatus as status", "0 as version"))
    stored.upsert(orders.where("o_orderkey % 5 = 0").selectExpr("o_orderkey", "'changed' as status", "1 as version").unionByName(
        orders.where("o_orderkey % 50 = 0").selectExpr("-o_orderkey - 1 as o_orderkey", "'new' as status", "1 as version")),
        ["o_orderkey"], ["version"])
    return stored.read()


@query("s17_external_table", "select c_mktsegment, count(*) as customers from customer group by 1")
def _(spark, sf):
    files.register_external(spark, "traceworks_customer_ext", f"{sf}/customer.parquet")
    return spark.table("traceworks_customer_ext").groupBy("c_mktsegment").agg(F.count("*").alias("customers"))


@query("s21_jsonl_backup", f"select 'pipeline_run' as type, run_id, status, row_count from ({RUNS})")
def _(spark, sf):
    path = sinks.scratch_path(spark, "audit-jsonl")
    sinks.append_jsonl(runs(spark, sf).select("run_id", "status", "row_count"), "pipeline_run", path)
    return spark.read.schema("type string, run_id string, status string, row_count bigint").json(path)


@query("s22_audit_rows", f"""select step_id, run_id, sequence_num, agent_name, tool_name, result_preview[:500] as result_preview,
  success, duration_ms from (select *, repeat(step_id, 30) as result_preview from ({fx.audit_sql('steps')}))""")
def _(spark, sf):
    path = sinks.scratch_path(spark, "steps")
    rows = fx.audit_table(spark, sf, "steps").withColumn("result_preview", F.repeat("step_id", F.lit(30)))
    sinks.append_audit(rows, "etl_agent_steps", path)
    return spark.read.parquet(path).select("step_id", "run_id", "sequence_num", "agent_name", "tool_name",
                                           "result_preview", "success", "duration_ms")


@query("s20_parquet_ledger", over_staged("select trace_id, question_text, status from (" + fx.TRACE_EVENTS_SQL + ")"))
def _(spark, sf):
    """Two appends of the same ids: the second adds nothing."""
    ledger = sinks.ParquetLedger(spark, sinks.scratch_path(spark, "ledger"))
    raw = fx.trace_events(spark, sf)
    ledger.append(raw)
    ledger.append(raw.withColumn("question_text", F.lit("TAMPERED")))
    return ledger.read().select("trace_id", "question_text", "status")


# Catalog properties, one table per supplier.
_PROPS = """case s_suppkey % 9 when 0 then map('table_type', 'ICEBERG') when 1 then map('classification', 'Parquet')
  when 2 then map('Classification', 'textfile') when 3 then map('note', 'made by iceberg job') else map('a', 'b') end"""
_INPUT = "case s_suppkey % 9 when 4 then 'org.apache.hadoop.mapred.TextInputFormat' when 5 then 'OrcInputFormat' end"
_SERDE = "case s_suppkey % 9 when 6 then 'LazySimpleSerDe' when 7 then 'OpenCSVSerde' end"


@query("s27_table_formats", """select s_suppkey, case s_suppkey % 9 when 0 then 'iceberg' when 1 then 'parquet' when 2 then 'csv'
  when 3 then 'iceberg' when 4 then 'csv' when 5 then 'orc' when 6 then 'csv' when 7 then 'csv' else 'unknown' end as format
from supplier""")
def _(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", files.table_format(
        F.expr(_PROPS), F.lit("EXTERNAL_TABLE"), F.expr(_INPUT), F.expr(_SERDE)).alias("format"))


_ENTRY = [("database", "p_brand"), ("table_name", "p_type"), ("position", "cast(p_size as bigint)"),
          ("column_name", "concat('col_', cast(p_partkey as varchar(20)))")]


@query("s26_capped_listing", f"""select database, table_name, position, column_name from (select *,
  dense_rank() over (partition by database order by table_name) as t,
  row_number() over (partition by database, table_name order by position, column_name) as c
from (select {', '.join(f'{e} as {c}' for c, e in _ENTRY)} from part)) where t <= 3 and c <= 5""")
def _(spark, sf):
    return files.capped_listing(table(spark, sf, "part").selectExpr(*[f"{e} as {c}" for c, e in _ENTRY]), 3, 5)


@query("s28_manifest_models", f"with {MODELS_SQL} select {', '.join(_SCALARS)} from models")
def _(spark, sf):
    """One manifest object per line, read back and compiled."""
    pairs = ", ".join(f"'{k}', {e}" for k, e in MODEL_META)
    lines = table(spark, sf, "supplier").selectExpr(
        *[f"{e} as {c}" for c, e in _NODE], f"map_filter(map({pairs}), (k, v) -> v is not null) as meta")
    manifest = lines.selectExpr(
        "map(concat('model.demo.', model_name), named_struct('name', model_name, 'unique_id', concat('model.demo.', model_name), "
        "'resource_type', 'model', 'description', description, 'access', access, 'meta', meta)) as nodes")
    path = _written(spark, manifest, "manifest", "json")
    nodes = policy.manifest_nodes(spark.read.schema(policy.MANIFEST_SCHEMA).json(path))
    return policy.compile_models(nodes).select(*_SCALARS)


# Search and scoped reads ----------------------------------------------------------
RAW = f"({fx.TRACE_EVENTS_SQL})"


@query("s30_by_trace", f"select * from {RAW} where trace_id = 'ev-42'")
def _(spark, sf):
    return replay.by_trace(fx.trace_events(spark, sf), "ev-42")


@query("s30_by_session", f"""select * from {RAW} where tenant_id = 'tenant_0' and session_id = 's8-2024-01-01'
  order by event_timestamp, trace_id limit 200""")
def _(spark, sf):
    return replay.by_session(fx.trace_events(spark, sf), "tenant_0", "s8-2024-01-01")


@query("s30_by_request", f"select * from {RAW} where tenant_id = 'tenant_0' and request_id = 'r8-2024-01-01-am'")
def _(spark, sf):
    return replay.by_request(fx.trace_events(spark, sf), "tenant_0", "r8-2024-01-01-am")


@query("p04_ledger_search", f"""select * from {RAW} where tenant_id = 'tenant_1' and status = 'ok' and pii_detected = false
  and event_timestamp >= '2024-01-03' and event_timestamp <= '2024-01-20' order by event_timestamp desc, trace_id limit 50 offset 10""")
def _(spark, sf):
    return replay.search(fx.trace_events(spark, sf), "tenant_1", status="ok", pii_detected=False,
                         from_ts="2024-01-03", to_ts="2024-01-20", limit=50, offset=10)


@query("o02_newest_events", f"select * from {RAW} where tenant_id = 'tenant_2' order by event_timestamp desc, trace_id limit 100")
def _(spark, sf):
    return replay.search(fx.trace_events(spark, sf), "tenant_2")


@query("p05_tenant_count", f"select count(*) as n from {RAW} where tenant_id = 'tenant_3'")
def _(spark, sf):
    return replay.tenant_count(fx.trace_events(spark, sf), "tenant_3")


@query("p10_tenant_isolation", f"select tenant_id, trace_id, user_id from {RAW} where tenant_id = 'tenant_1'")
def _(spark, sf):
    return fx.trace_events(spark, sf).where("tenant_id = 'tenant_1'").select("tenant_id", "trace_id", "user_id")


@query("p02_quality_filter", f"""select trace_id, tenant_id from {RAW} where trace_id is not null and tenant_id is not null
  and user_id is not null and event_type is not null""")
def _(spark, sf):
    return complete_rows(fx.trace_events(spark, sf)).select("trace_id", "tenant_id")


_FLAGS = ["is_sql_event", "is_agent_event", "is_error", "is_policy_blocked", "is_boundary_violation",
          "is_high_sensitivity", "is_human_correction"]


@query("p03_derived_flags", over_staged(f"select trace_id, {', '.join(_FLAGS)} from staged"))
def _(spark, sf):
    return with_flags(complete_rows(fx.trace_events(spark, sf))).select("trace_id", *_FLAGS)


@query("p16_capped_result", f"""select trace_id, event_timestamp, (select count(*) from {RAW}) as true_count, 100 as shown_count
  from {RAW} order by event_timestamp desc, trace_id limit 100""")
def _(spark, sf):
    raw = fx.trace_events(spark, sf)
    return raw.orderBy(F.desc("event_timestamp"), "trace_id").limit(100).select(
        "trace_id", "event_timestamp", raw.agg(F.count("*")).scalar().alias("true_count"),
        F.lit(100).alias("shown_count"))


# Replay ---------------------------------------------------------------------------
REPLAY_CTE = f"""replayed as (select *, row_number() over w as event_sequence,
  date_diff('millisecond', lag(ts) over w, ts) as duration_ms, event_type like 'sql\\_%' escape '\\' as is_sql,
  status in ('failed', 'blocked') as is_error, '' as summary,
  (select string_agg(upper(p[1]) || p[2:], ' ') from (select unnest(string_split(event_type, '_')) as p))
    || case when tool_name <> '' then ' (' || tool_name || ')' when model_name <> '' then ' — ' || model_name else '' end as label
from (select *, try_cast(event_timestamp as timestamp) as ts from {RAW})
window w as (partition by tenant_id, request_id order by ts nulls last, trace_id))"""
_CARDS = """tenant_id, request_id, event_sequence, label, event_type, status, actor_id as actor,
  event_timestamp as timestamp, summary, sql_hash, error_message as error, duration_ms, is_sql, is_error,
  policy_result as policy"""


def replayed(spark, sf):
    return replay.replay(fx.trace_events(spark, sf))


@query("m20_request_replay", f"with {REPLAY_CTE} select {_CARDS} from replayed")
def _(spark, sf):
    return replay.cards(replayed(spark, sf))


@query("m20_timeline_lines", f"""with {REPLAY_CTE} select tenant_id, request_id, event_sequence,
  printf('%3d. %s  %-30s  %-20s  %-10s%10s  %s', event_sequence, event_timestamp[:19], event_type, actor_id,
    '[' || case when is_error then upper(status) else status end || ']',
    case when duration_ms > 0 then ' +' || duration_ms || 'ms' else '' end, summary)
  || case when is_error and error_message <> '' then chr(10) || '      ERROR: ' || error_message[:120] else '' end as line
from replayed""")
def _(spark, sf):
    return replay.timeline_lines(replayed(spark, sf))


@query("w04_event_gaps", f"with {REPLAY_CTE} select trace_id, event_sequence, duration_ms from replayed")
def _(spark, sf):
    return replayed(spark, sf).select("trace_id", "event_sequence", "duration_ms")


_VIEWS = {"sql_chain": "is_sql", "tool_chain": "event_type in ('model_invoked', 'tool_invoked')",
          "policy_decisions": "event_type like 'policy_check_%'",
          "human_corrections": "event_type = 'human_feedback_received'"}
for _name, _cond in _VIEWS.items():
    query(f"p07_{_name}", f"with {REPLAY_CTE} select {_CARDS} from replayed where {_cond}")(
        lambda spark, sf, n=_name: replay.cards(replay.view(replayed(spark, sf), n)))

CORRECTIONS_SQL = f"""with e as (select *, try_cast(event_timestamp as timestamp) as ts from {RAW}),
f as (select tenant_id, request_id, min_by(sql_hash, {{'a': ts, 'b': trace_id}}) filter (where event_type = 'sql_generated' and ts is not null) as first_sql_hash,
  min(ts) filter (where event_type = 'human_feedback_received') as feedback_at,
  count(*) filter (where event_type = 'human_feedback_received') as feedback_events,
  count(*) filter (where event_type like 'sql\\_%' escape '\\') as n from e group by 1, 2),
l as (select e.tenant_id, e.request_id, min_by(sql_hash, {{'a': ts, 'b': trace_id}}) as corrected_sql_hash from e join f
  on e.tenant_id is not distinct from f.tenant_id and e.request_id = f.request_id
  where event_type = 'sql_generated' and ts > feedback_at and n > 1 group by 1, 2)
select f.tenant_id, f.request_id, first_sql_hash, corrected_sql_hash, corrected_sql_hash is not null as has_correction, feedback_events
from f left join l on f.tenant_id is not distinct from l.tenant_id and f.request_id = l.request_id"""


@query("m21_first_vs_corrected", CORRECTIONS_SQL)
def _(spark, sf):
    return replay.corrections(fx.trace_events(spark, sf))


@query("j08_sql_after_feedback", f"select tenant_id, request_id, corrected_sql_hash from ({CORRECTIONS_SQL}) where has_correction")
def _(spark, sf):
    return replay.corrections(fx.trace_events(spark, sf)).where("has_correction").select(
        "tenant_id", "request_id", "corrected_sql_hash")


@query("w11_first_events", f"select tenant_id, request_id, first_sql_hash, feedback_events from ({CORRECTIONS_SQL})")
def _(spark, sf):
    return replay.corrections(fx.trace_events(spark, sf)).select(
        "tenant_id", "request_id", "first_sql_hash", "feedback_events")


@query("f38_json_list_counts", over_staged("""select tenant_id, item, count(*) as events from
  (select tenant_id, unnest(from_json(pii_fields, '["varchar"]')) as item from staged where pii_fields is not null) group by 1, 2"""))
def _(spark, sf):
    return replay.flag_counts(staged(spark, sf), "pii_fields")


@query("f38_risk_flag_counts", over_staged("""select tenant_id, item, count(*) as events from
  (select tenant_id, unnest(from_json(risk_flags, '["varchar"]')) as item from staged where risk_flags is not null) group by 1, 2"""))
def _(spark, sf):
    return replay.flag_counts(staged(spark, sf), "risk_flags")


@query("f39_labels", f"with {REPLAY_CTE} select trace_id, label from replayed")
def _(spark, sf):
    return fx.trace_events(spark, sf).select("trace_id", replay.label().alias("label"))


# Metric layer -----------------------------------------------------------------------
@query("m22_request_metrics", over_staged(
    """select tenant_id, risk_level, round(avg(total_request_ms), 4) as avg_request_latency_ms,
  round(avg(agent_event_count), 6) as avg_agent_events_per_request,
  count(distinct case when boundary_violated = 1 then request_id end) as requests_with_boundary_violation,
  sum(sql_generated_count)::bigint as total_sql_generated, sum(error_count)::bigint as total_errors
from requests group by 1, 2""", *REQUEST_CTES))
def _(spark, sf):
    out = metrics.metrics(staged(spark, sf), [
        "avg_request_latency_ms", "avg_agent_events_per_request", "requests_with_boundary_violation",
        "total_sql_generated", "total_errors"], ["tenant_id", "risk_level"])
    return out.withColumns({"avg_request_latency_ms": F.round("avg_request_latency_ms", 4),
                            "avg_agent_events_per_request": F.round("avg_agent_events_per_request", 6)})


@query("a15_conditional_distinct_metrics", over_staged(
    """select datasource_name, count(distinct case when pii_detected then trace_id end) as pii_sql_generations
from staged where event_type = 'sql_generated' group by 1"""))
def _(spark, sf):
    return metrics.metrics(staged(spark, sf), ["pii_sql_generations"], ["datasource_name"])


@query("m22_block_rate", over_staged(f"""select tenant_id, round(avg(r), 4) as avg_block_rate from (
  select tenant_id, {pct("count(*) filter (where event_type = 'sql_blocked')", "count(*) filter (where event_type = 'sql_generated')")} as r
  from staged where is_sql_event group by tenant_id, workspace_id, user_id, datasource_type, datasource_name,
    date_trunc('day', event_timestamp)) group by 1"""))
def _(spark, sf):
    out = metrics.metrics(staged(spark, sf), ["avg_block_rate"], ["tenant_id"])
    return out.withColumn("avg_block_rate", F.round("avg_block_rate", 4))


def _all_metrics_sql() -> str:
    """Every metric over the check SQL of its mart."""
    marts_sql = {
        "users": "m09_dim_ai_users", "workspaces": "m10_dim_ai_workspaces", "datasources": "m11_dim_ai_datasources",
        "models": "m12_dim_ai_models", "requests": "m13_fct_ai_requests", "sql_generations": "m14_fct_ai_sql_generations",
        "sql_executions": "m15_fct_ai_sql_executions", "policy_checks": "m16_fct_ai_policy_checks",
        "tool_calls": "m17_fct_ai_tool_calls", "rag_retrievals": "m18_fct_ai_rag_retrievals",
        "sql_risk": "m06_rpt_sql_risk_summary", "model_usage": "m07_rpt_model_usage",
        "request_report": "m04_rpt_request_summary", "session_report": "m08_rpt_session_overview"}
    forms = {"sum": "sum({})", "average": "avg({})", "count_distinct": "count(distinct {})"}
    ctes, rows = [], []
    for mart, name in marts_sql.items():
        own = {n: m for n, m in metrics.METRICS.items() if m.mart == mart}
        values = ", ".join(f"{forms[m.kind].format(m.expr)}::double as {n}" for n, m in own.items())
        ctes.append(f"""a_{mart} as materialized (select grouping(tenant_id, workspace_id)::bigint as grain, tenant_id,
  workspace_id, {values} from ({ORACLES[name]}) group by grouping sets ((tenant_id, workspace_id), (tenant_id), ()))""")
        rows += [f"select grain, tenant_id, workspace_id, '{n}' as metric, round({n}, 4) as value from a_{mart}" for n in own]
    return "with " + ",\n".join(ctes) + "\n" + "\nunion all ".join(rows)


@query("m22_all_metrics", _all_metrics_sql())
def _(spark, sf):
    out = metrics.metric_report(staged(spark, sf), list(metrics.METRICS), ["tenant_id", "workspace_id"],
                                [["tenant_id", "workspace_id"], ["tenant_id"], []])
    return out.withColumn("value", F.round("value", 4))


# Event construction -----------------------------------------------------------------
_MASK = lambda c: _mask_sql(c, redact.CREDENTIAL_PATTERNS)


@query("s31_sql_validation_events", f"""select trace_id, case when status = 'ok' then 'sql_validated' else 'sql_blocked' end as event_type,
  'system' as actor_type, 'sql_validator' as actor_id, 'SQL validation: ' || policy_result as ai_action_summary, status,
  {_MASK('q')} as question_text, {_MASK('s')} as sql_text, sha256({_MASK('s')}) as sql_hash,
  {_summarise_sql("error_message", 500)} as error_message
from (select *, question_text as q, sql_text || ' -- token=abcdefgh12' as s from {RAW})""")
def _(spark, sf):
    raw = fx.trace_events(spark, sf).withColumn("sql_text", F.expr("sql_text || ' -- token=abcdefgh12'"))
    return emit.to_trace_events(raw, "sql_validated").select(
        "trace_id", "event_type", "actor_type", "actor_id", "ai_action_summary", "status", "question_text",
        "sql_text", "sql_hash", "error_message")


@query("s31_boundary_events", f"""select trace_id, 'agent_boundary_violation' as event_type, 'agent' as actor_type,
  agent_name as actor_id, true as boundary_violated, 'violation' as status,
  coalesce(risk_flags, '["BOUNDARY_VIOLATION"]') as risk_flags from {RAW}""")
def _(spark, sf):
    return emit.to_trace_events(fx.trace_events(spark, sf), "agent_boundary_violation").select(
        "trace_id", "event_type", "actor_type", "actor_id", "boundary_violated", "status", "risk_flags")


@query("s32_mirrored_runs", f"""select 'req-' || run_id || '-' || i as trace_id, case when i > 0 then 'req-' || run_id || '-0' end as parent_trace_id,
  ['request_received', 'tool_invoked', 'sql_generated', 'response_returned'][i + 1] as event_type,
  ['u1', 'run_etl_pipeline', llm_model, 'etl_pipeline'][i + 1] as actor_id,
  case when i in (1, 3) then case when status = 'completed' then 'ok' else 'failed' end else 'ok' end as status,
  [null, 'compliance=' || compliance_status || ' status=' || status, 'Generated SQL for duckdb_etl', compliance_status][i + 1] as ai_action_summary,
  case when i > 0 then run_id end as etl_run_id
from (select *, unnest([0, 1, 2, 3]) as i from ({RUNS})) where i <> 2 or row_count % 2 = 0""")
def _(spark, sf):
    rows = runs(spark, sf).selectExpr(
        "'t1' as tenant_id", "'w1' as workspace_id", "'u1' as user_id", "'s1' as session_id", "run_id", "started_at",
        "source_file as request", "status", "compliance_status", "llm_model",
        "case when row_count % 2 = 0 then 'select 1 from t' end as generated_sql")
    return emit.mirrored_runs(rows).select(
        "trace_id", "parent_trace_id", "event_type", "actor_id", "status", "ai_action_summary", "etl_run_id")


# Extension points -------------------------------------------------------------------
@query("x01_sql_functions", f"""select trace_id, {_mask_sql('question_text', redact.CREDENTIAL_PATTERNS)} as question_text,
  'H:' || substr(sha256(user_id), 1, 16) as user_token, sha256(nullif(sql_text, '')) as sql_id from {RAW}""")
def _(spark, sf):
    sql_functions.register(spark)
    return fx.trace_events(spark, sf).selectExpr(
        "trace_id", "mask_credentials(question_text) as question_text", "mask_hash(user_id) as user_token",
        "text_hash(sql_text) as sql_id")


@query("x02_bar_provider", f"select ticker, tf, ts, open, high, low, close, volume from ({fx.DAILY_BARS_SQL})")
def _(spark, sf):
    path = sinks.scratch_path(spark, "bars")
    fx.daily_bars(spark, sf).write.parquet(path)
    bars_source.register(spark)
    return spark.read.format("bars").option("provider", "parquet").load(path)


@query("x02_bar_filter", f"""select ticker, ts, close from ({fx.DAILY_BARS_SQL})
  where ticker >= (select max(ticker) from ({fx.DAILY_BARS_SQL})) and close > 0""")
def _(spark, sf):
    """A folder given as a URI; the filter on the ticker skips row groups."""
    path = sinks.scratch_path(spark, "bars")
    bars = fx.daily_bars(spark, sf)
    bars.sortWithinPartitions("ticker", "ts").write.parquet(path)
    bars_source.register(spark)
    uri = path if "://" in path else f"file://{path}"
    last = bars.agg(F.max("ticker")).first()[0]
    return spark.read.format("bars").load(uri).where((F.col("ticker") >= last) & (F.col("close") > 0)).select(
        "ticker", "ts", "close")


@query("x06_violation_rows", over_staged("""select trace_id, unnest(list_filter([case when is_error then 'error' end,
  case when is_policy_blocked then 'policy_blocked' end, case when is_boundary_violation then 'boundary' end],
  lambda x: x is not null)) as violation from staged"""))
def _(spark, sf):
    tablefuncs.register(spark)
    staged(spark, sf).createOrReplaceTempView("traceworks_staged")
    return spark.sql("""select trace_id, violation from traceworks_staged, lateral violation_rows(
        error => is_error, policy_blocked => is_policy_blocked, boundary => is_boundary_violation)""")


_PROFILED = ["c_custkey", "c_name", "c_mktsegment", "note"]
_NOTED = "select c_custkey, c_name, c_mktsegment, case when c_custkey % 3 = 0 then c_name end as note from customer"


@query("x06_profile_rows", " union all ".join(
    f"""select '{c}' as column_name, count(*) as rows, count(*) - count({c}) as nulls,
  max(length(cast({c} as varchar)))::bigint as longest from ({_NOTED})""" for c in _PROFILED))
def _(spark, sf):
    """Every task profiles its rows of the table; the parts are added up."""
    tablefuncs.register(spark)
    table(spark, sf, "customer").selectExpr(
        "c_custkey", "c_name", "c_mktsegment", "if(c_custkey % 3 = 0, c_name, null) as note").createOrReplaceTempView("traceworks_noted")
    return spark.sql("""select column_name, sum(rows) as rows, sum(nulls) as nulls, max(longest) as longest
        from column_counts(table(traceworks_noted)) group by column_name""")
