"""Streams run over the given tables to the end, read back as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceworks import fixtures as fx
from traceworks.operators.clean import TableConfig
from traceworks.registry.base import query, table
from traceworks.registry.q_audit import CONTROLLED, usd_sql
from traceworks.registry.q_ledger import SESSION_SQL
from traceworks.registry.q_quality import _mask_sql
from traceworks.registry.sql import over_staged, pct
from traceworks.functions.redact import CREDENTIAL_PATTERNS
from traceworks.plans.cost import Budget
from traceworks.sources.sinks import scratch_path
from traceworks.streaming import budget_stream, files_stream, ledger_stream


def stream(spark, sf, name):
    schema = table(spark, sf, name).schema
    # As a pattern, the path may be one file or a folder of files.
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def ledger_rows(spark, sf):
    """The ledger as a stream."""
    columns = fx.TRACE_EVENT_COLUMNS + [("event_id", "event_id")]
    raw = stream(spark, sf, "events").selectExpr(*[f"{e} as {c}" for c, e in columns])
    return raw.selectExpr("* except (event_id)", "sha2(sql_text, 256) as sql_hash")


def _finish(q):
    q.awaitTermination()
    if q.exception():
        raise q.exception()


RAW = f"({fx.TRACE_EVENTS_SQL})"


@query("t01_ledger_ingest", f"""select trace_id, {_mask_sql('question_text', CREDENTIAL_PATTERNS)} as question_text, status from {RAW}""")
def _(spark, sf):
    """Every event arrives twice, the second time altered: the first one stays."""
    twice = ledger_rows(spark, sf).withColumn("ingest_seq", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "question_text", F.when(F.col("ingest_seq") == 1, "TAMPERED").otherwise(F.col("question_text")))
    path, mark = scratch_path(spark, "ledger"), scratch_path(spark, "ckpt")
    _finish(ledger_stream.ingest(twice, path, mark))
    return spark.read.parquet(path).select("trace_id", "question_text", "status")


@query("t01_dedup_in_watermark", f"select trace_id, event_type from {RAW}")
def _(spark, sf):
    twice = ledger_rows(spark, sf).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    path, mark = scratch_path(spark, "dedup"), scratch_path(spark, "ckpt")
    out = ledger_stream.deduplicated(twice).select("trace_id", "event_type")
    _finish(out.writeStream.format("parquet").option("path", path).option("checkpointLocation", mark)
            .trigger(availableNow=True).start())
    return spark.read.parquet(path)


TIGHT = Budget(per_run=0.05, per_day=0.05, per_month=0.8)
_SPENT = f"""select 'per_run' as limit_type, run_id as period, 0.05 as lim, {usd_sql('sum(nanos)')} as spent from {CONTROLLED} group by 2
  union all select 'per_day', call_ts[:10], 0.05, {usd_sql('sum(nanos)')} from {CONTROLLED} group by 2
  union all select 'per_month', call_ts[:7], 0.8, {usd_sql('sum(nanos)')} from {CONTROLLED} group by 2"""


@query("t02_budget_alerts", f"""select limit_type, period, 'WARN' as level from ({_SPENT}) where spent / lim * 100 >= 80
union all select limit_type, period, 'STOP' from ({_SPENT}) where spent / lim * 100 >= 100""")
def _(spark, sf):
    source, columns = fx._AUDIT["llm_calls"]
    calls = stream(spark, sf, source).selectExpr(*[f"{e} as {c}" for c, e in columns])
    path, mark = scratch_path(spark, "alerts"), scratch_path(spark, "ckpt")
    _finish(budget_stream.alerts(calls, path, mark, TIGHT))
    return budget_stream.reported(spark, path).select("limit_type", "period", "level")


@query("t03_incremental_files", f"""select order_id, position, strftime(try_cast(ordered_on as timestamp), '%Y-%m-%dT%H:%M:%S') as ordered_on,
  try_cast(amount as double) as amount, customer from ({fx.RAW_ORDERS_SQL})""")
def _(spark, sf):
    """The folder is read twice by the same checkpoint: no file counts twice."""
    raw = fx.raw_orders(spark, sf)
    inbox, out, mark = (scratch_path(spark, n) for n in ("inbox", "cleaned", "ckpt"))
    raw.write.option("header", True).csv(inbox)
    config = TableConfig(date_columns=["ordered_on"], numeric_columns=["amount"])
    for _ in range(2):
        files = files_stream.incoming_files(spark, inbox, raw.schema, "csv", header=True)
        _finish(files_stream.ingest_files(files, config, out, mark))
    return spark.read.parquet(out).drop("source_path")


@query("t04_live_risk", over_staged(f"""select tenant_id, date_trunc('day', event_timestamp)::timestamp as event_date,
  count(*) as total_sql_events, count(*) filter (where event_type = 'sql_generated') as sql_generated,
  count(*) filter (where event_type = 'sql_blocked') as sql_blocked, count(*) filter (where is_error) as errors,
  {pct("count(*) filter (where event_type = 'sql_blocked')", "count(*) filter (where event_type = 'sql_generated')")} as block_rate
from staged where is_sql_event and event_timestamp is not null group by 1, 2"""))
def _(spark, sf):
    path, mark = scratch_path(spark, "risk"), scratch_path(spark, "ckpt")

    def store(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    _finish(ledger_stream.live_risk(ledger_rows(spark, sf)).writeStream.outputMode("update").foreachBatch(store)
            .option("checkpointLocation", mark).trigger(availableNow=True).start())
    seen = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    from traceworks.operators.dedup import keep_last

    return keep_last(seen, ["tenant_id", "event_date"], ["batch"]).drop("batch", "distinct_sql_approx")


@query("t05_session_roll_up", over_staged(SESSION_SQL))
def _(spark, sf):
    ledger, out, mark, seen = (scratch_path(spark, n) for n in ("ledger", "sessions", "ckpt", "seen"))
    _finish(ledger_stream.ingest(ledger_rows(spark, sf), ledger, mark))
    _finish(ledger_stream.roll_up_sessions(spark, ledger, out, seen))
    return ledger_stream.current_sessions(spark, out)


@query("t05_gap_sessions", f"""with e as (select tenant_id, user_id, try_cast(event_timestamp as timestamp) as t from {RAW}),
marked as (select *, case when t - lag(t) over w >= interval 6 hour or lag(t) over w is null then 1 else 0 end as opens
  from e where t is not null window w as (partition by tenant_id, user_id order by t)),
numbered as (select *, sum(opens) over (partition by tenant_id, user_id order by t rows unbounded preceding) as s from marked)
select tenant_id, user_id, min(t) as started, count(*) as events from numbered group by tenant_id, user_id, s
having max(t) + interval 6 hour <= (select date_trunc('millisecond', max(t)) - interval 1 day from e)""")
def _(spark, sf):
    path, mark = scratch_path(spark, "gaps"), scratch_path(spark, "ckpt")
    sessions = ledger_stream.gap_sessions(ledger_rows(spark, sf), "6 hours")
    _finish(sessions.select("tenant_id", "user_id", F.col("session_window.start").cast("timestamp_ntz").alias("started"), "events")
            .writeStream.format("parquet").option("path", path).option("checkpointLocation", mark)
            .trigger(availableNow=True).start())
    return spark.read.schema("tenant_id string, user_id string, started timestamp_ntz, events bigint").parquet(path)


@query("t06_late_events_rebuild", f"""select tenant_id, left(event_timestamp, 10) as event_day, count(*) as events,
  count(*) filter (where status = 'TAMPERED') as altered from {RAW} group by 1, 2""")
def _(spark, sf):
    """The newest day arrives first; the earlier days, and altered copies of the newest, come with the second batch."""
    events = fx.trace_events(spark, sf).drop("ingest_seq")
    newest = events.agg(F.max(F.left("event_timestamp", F.lit(10)))).scalar()
    day = F.left("event_timestamp", F.lit(10))
    inbox, path, mark = (scratch_path(spark, n) for n in ("late", "ledger", "ckpt"))
    on_time = F.coalesce(day == newest, F.lit(False))
    for part in (events.where(on_time), events.where(~on_time).union(
            events.where(on_time).withColumn("status", F.lit("TAMPERED")))):
        part.write.mode("append").parquet(inbox)
        _finish(ledger_stream.ingest(spark.readStream.schema(events.schema).parquet(inbox), path, mark))
    return spark.read.parquet(path).groupBy("tenant_id", day.alias("event_day")).agg(
        F.count("*").alias("events"), F.count_if(F.col("status") == "TAMPERED").alias("altered"))
