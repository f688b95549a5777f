"""Ledger ingest, live risk metrics and session roll-up as streams."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from traceworks.functions.redact import mask_credentials
from traceworks.functions.times import parse_ts
from traceworks.operators.aggregates import rate_pct, tally
from traceworks.operators.dedup import keep_last
from traceworks.plans.ledger import SESSION_KEYS, kind, staged_events
from traceworks.sources.ledger_store import CELL, ParquetLedger
from traceworks.streaming import session_state
from traceworks.streaming.session_state import IDLE
from traceworks.streaming.state import into_batches, rocksdb

ALL_AT_HAND = {"availableNow": True}


def masked_events(raw: DataFrame) -> DataFrame:
    """Ledger rows with typed credentials hidden; stateless, so it streams."""
    return raw.withColumns({c: mask_credentials(F.col(c)) for c in ("question_text", "sql_text")})


def deduplicated(raw: DataFrame, delay: str = "1 day") -> DataFrame:
    """One row per trace id among rows that arrive within the watermark delay.

    State is kept per id for the delay only. Rows older than the watermark, late
    first copies too, are dropped, and which copy inside the delay is kept is not defined: where the first
    write must win for all time use :func:`ingest`.
    """
    timed = masked_events(raw).withColumn("event_time", parse_ts("event_timestamp").cast("timestamp"))
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["trace_id"])


def ingest(raw: DataFrame, ledger_path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Stream into the append-only ledger; the first write of an id wins.

    A batch that is run again after a failure finds its own rows in the
    ledger and adds nothing.
    """

    def append(batch: DataFrame, _: int) -> None:
        ParquetLedger(batch.sparkSession, ledger_path).append(batch)

    return (masked_events(raw).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or ALL_AT_HAND)).start())


def live_risk(raw: DataFrame, delay: str = "1 day") -> DataFrame:
    """SQL risk per tenant and event day while events arrive.

    Distinct counts are approximate, since streams cannot count exactly;
    the batch report has the exact ones. Rows later than ``delay`` are
    dropped here and included by the batch rebuild.
    """
    typed = staged_events(raw).withColumn("event_time", F.col("event_timestamp").cast("timestamp"))
    sql = typed.where("is_sql_event and event_time is not null").withWatermark("event_time", delay)
    return sql.groupBy("tenant_id", F.window("event_time", "1 day")).agg(
        F.count("*").alias("total_sql_events"),
        *tally(sql_generated=kind("sql_generated"), sql_blocked=kind("sql_blocked"), errors="is_error"),
        F.approx_count_distinct("sql_hash").alias("distinct_sql_approx"),
    ).select("tenant_id", F.col("window.start").cast("timestamp_ntz").alias("event_date"),
             "total_sql_events", "sql_generated", "sql_blocked", "errors",
             rate_pct(F.col("sql_blocked"), F.col("sql_generated")).alias("block_rate"), "distinct_sql_approx")


def roll_up_sessions(spark: SparkSession, ledger_path: str, out_path: str, checkpoint: str, trigger: dict | None = None,
                     idle: timedelta = IDLE) -> StreamingQuery:
    """Session rows kept up to date from what :func:`ingest` appends to the ledger.

    The ledger's files are the stream, so an id counts once and each file is read once. A batch adds its events to the
    partial sums, sets and texts that the state holds per session; no earlier event is read again. Results are appended
    with their batch number and read back newest-first; a repeated batch overwrites its own folder. A session's state
    ends with the first batch after ``idle`` without an event of it; events that come later still start it anew.
    """
    stored = spark.read.parquet(ledger_path).drop(*CELL).schema
    events = staged_events(spark.readStream.schema(stored).option("recursiveFileLookup", True).parquet(ledger_path))
    rows = session_state.sessions(events, idle)
    with rocksdb(spark):
        return (rows.writeStream.outputMode("update").foreachBatch(into_batches(out_path))
                .option("checkpointLocation", checkpoint).trigger(**(trigger or ALL_AT_HAND)).start())


def current_sessions(spark: SparkSession, out_path: str) -> DataFrame:
    rows = spark.read.option("basePath", out_path).parquet(f"{out_path}/batch=*")
    return keep_last(rows, SESSION_KEYS, ["batch"]).drop("batch")


def gap_sessions(raw: DataFrame, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """Sessions by inactivity instead of by session id."""
    timed = raw.withColumn("event_time", parse_ts("event_timestamp").cast("timestamp")).where(
        F.col("event_time").isNotNull()).withWatermark("event_time", delay)
    return timed.groupBy("tenant_id", "user_id", F.session_window("event_time", gap)).agg(
        F.count("*").alias("events"))
