"""Where results go: typed tables, JSON lines, ledger and vector tables."""

from __future__ import annotations

import functools
import time
import uuid
from typing import Protocol

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from traceworks.operators.dedup import append_new
from traceworks.session import checkpoint_dir
from traceworks.sources.ledger_store import ParquetLedger  # noqa: F401  (one of the sinks)

# Columns of the audit tables.
AUDIT_SCHEMAS = {
    "etl_pipeline_runs": """run_id string, started_at string, completed_at string, duration_ms bigint, status string,
      source_file string, table_name string, row_count bigint, llm_provider string, llm_model string,
      compliance_status string, pii_columns_count int, masked_columns_count int, total_steps int, failed_steps int,
      total_tokens int, estimated_cost_usd double, environment string""",
    "etl_agent_steps": """step_id string, run_id string, sequence_num int, agent_name string, tool_name string,
      tool_args_json string, result_preview string, success boolean, error_message string, duration_ms bigint,
      started_at string, completed_at string""",
    "etl_data_mutations": """mutation_id string, run_id string, step_id string, table_name string, operation string,
      rows_before bigint, rows_after bigint, rows_affected bigint, schema_changed boolean, agent_name string,
      tool_name string, timestamp string""",
    "etl_llm_calls": """call_id string, run_id string, agent_name string, provider string, model string,
      prompt_tokens int, completion_tokens int, total_tokens int, estimated_cost_usd double, latency_ms bigint,
      guardrail_l1_applied boolean, guardrail_l2_action string, guardrail_l3_findings string, timestamp string""",
    "etl_compliance_events": """event_id string, run_id string, event_type string, column_name string,
      sensitivity string, pii_type string, action_taken string, details_json string, timestamp string""",
    "etl_audit_log": """run_id string, timestamp string, source_file string, table_name string, row_count bigint,
      pii_columns string, high_risk_columns string, masked_columns string, quality_issues string,
      compliance_status string, pipeline_status string, environment string, dbt_artifacts string""",
}
# Longest stored text per audit column.
STORED_LENGTHS = {"tool_args_json": 200, "result_preview": 500, "error_message": 500}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for one written table, in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def conformed(df: DataFrame, table: str) -> DataFrame:
    """Rows in the column order and types of an audit table; long texts cut,
    missing columns NULL."""
    spark = df.sparkSession
    schema = spark.createDataFrame([], AUDIT_SCHEMAS[table]).schema
    out = []
    for f in schema.fields:
        col = F.col(f.name) if f.name in df.columns else F.lit(None)
        if f.name in STORED_LENGTHS and f.name in df.columns:
            col = F.left(col.cast("string"), F.lit(STORED_LENGTHS[f.name]))
        out.append(col.cast(f.dataType).alias(f.name))
    return df.select(*out)


def append_audit(df: DataFrame, table: str, path: str) -> None:
    conformed(df, table).write.mode("append").parquet(path)


def append_jsonl(df: DataFrame, record_type: str, path: str) -> None:
    """JSON lines backup, each tagged with its record type."""
    df.select(F.lit(record_type).alias("type"), "*").write.mode("append").json(path)


def write_counted(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Write Parquet and return the row count of the same pass."""
    seen = Observation(f"rows-{uuid.uuid4().hex}")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).parquet(path)
    return seen.get["n"]


def write_cleaned(df: DataFrame, root: str, table: str, partition_spec: list[str] | None = None) -> str:
    """Cleaned table as Parquet under ``cleaned/<table>``."""
    path = f"{root.rstrip('/')}/cleaned/{table}"
    writer = df.write.mode("overwrite")
    if partition_spec:
        writer = writer.partitionBy(*partition_spec)
    writer.parquet(path)
    return path


def append_collection(records: DataFrame, path: str) -> None:
    """Vector records, one folder per collection."""
    records.write.mode("append").partitionBy("collection").parquet(path)


class Sink(Protocol):
    """Something ledger rows can be appended to."""

    def append(self, events: DataFrame) -> None: ...


class NoopSink:
    def append(self, events: DataFrame) -> None:
        events.write.format("noop").mode("append").save()


class JdbcLedger:
    """Ledger rows into a warehouse table."""

    def __init__(self, connection, table: str):
        self.connection, self.table = connection, table

    def append(self, events: DataFrame) -> None:
        """Rows whose id the table does not hold yet; the first write of an id wins, so a repeated call adds nothing."""
        from traceworks.sources.warehouse import read_table, write_table

        stored = read_table(events.sparkSession, self.connection, self.table)
        order = ["ingest_seq"] if "ingest_seq" in events.columns else ["event_timestamp"]
        write_table(append_new(stored, events, "trace_id", order), self.connection, self.table, "append")


def audited(agent: str, path: str):
    """Decorator for job steps ``fn(spark, run_id, ...)``: one step row per call
    with its time, success and error text; the error is raised on."""

    def wrap(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, run_id: str, *args, **kwargs):
            started, t0, error, result = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), time.time(), None, None
            try:
                result = fn(spark, run_id, *args, **kwargs)
                return result
            except Exception as exc:
                error = f"{type(exc).__name__}: {exc}"
                raise
            finally:
                row = [(f"{run_id}:{uuid.uuid4().hex}", run_id, agent, fn.__name__, str(kwargs), str(result),
                        error is None, error, int((time.time() - t0) * 1000), started,
                        time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()))]
                step = spark.createDataFrame(
                    row, "step_id string, run_id string, agent_name string, tool_name string, tool_args_json string, "
                         "result_preview string, success boolean, error_message string, duration_ms bigint, "
                         "started_at string, completed_at string")
                append_audit(step, "etl_agent_steps", path)

        return run

    return wrap
