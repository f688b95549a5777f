"""Monitoring reports over the pipeline audit tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceworks.functions.prices import AUDIT_DEFAULT, AUDIT_PRICES, cost_nanos, exact_rate, usd
from traceworks.operators.aggregates import rate_pct, tally
from traceworks.operators.quantiles import exact_percentiles

# What to do when a tool fails.
FIX_HINTS = {
    "ingest_file": "Verify file path, format (.csv/.xlsx/.parquet), and DuckDB write permissions.",
    "profile_table": "Ensure table was loaded before profiling. Check DuckDB connection.",
    "check_primary_key": "Column may not exist — verify schema after ingest_file succeeds.",
    "scan_pii": "Table may be empty or DuckDB connection failed. Run ingest_file first.",
    "mask_pii_columns": "DuckDB write permission error or column type mismatch.",
    "generate_compliance_report": "Missing pii_scan context — ensure scan_pii ran first.",
    "write_audit_log": "Check write permissions for audit JSONL file and DuckDB.",
    "generate_staging_sql": "Missing table_name or schema — ensure ingest_file completed.",
    "generate_schema_yaml": "Missing schema or model_name context — run generate_staging_sql first.",
    "save_dbt_artifacts": "dbt project directory may not exist or not be writable.",
    "get_pipeline_summary": "Context variables incomplete — check earlier pipeline steps.",
}
DEFAULT_HINT = "Review tool logs and DuckDB connection."


def lookup(key: Column, table: dict[str, str], default: str | None = None) -> Column:
    """Value of a fixed small table, or the default."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def priced_calls(calls: DataFrame, prices: dict = AUDIT_PRICES, default=AUDIT_DEFAULT) -> DataFrame:
    """Model calls with total tokens and cost, priced by exact model name."""
    rate = exact_rate(F.col("model"), prices, default)
    nanos = cost_nanos(rate, F.col("prompt_tokens"), F.col("completion_tokens"))
    return calls.withColumns({
        "total_tokens": F.col("prompt_tokens") + F.col("completion_tokens"), "cost_nanos": nanos})


def recent_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    columns = ["run_id", "started_at", "duration_ms", "status", "table_name", "row_count", "llm_provider",
               "llm_model", "compliance_status", "total_steps", "failed_steps", "total_tokens"]
    newest = runs.orderBy(F.desc("started_at"), "run_id").limit(n)
    return newest.select(*columns, F.round("estimated_cost_usd", 6).alias("estimated_cost_usd"))


def tool_performance(steps: DataFrame) -> DataFrame:
    """Calls, success rate and exact latency percentiles per tool."""
    base = steps.groupBy("tool_name").agg(
        F.count("*").alias("total_calls"),
        rate_pct(F.count_if("success"), F.count("success")).alias("success_rate_pct"),
        F.round(F.avg("duration_ms")).alias("avg_ms"),
    )
    spread = exact_percentiles(steps, ["tool_name"], "duration_ms", {"p50_ms": 0.5, "p95_ms": 0.95})
    joined = base.join(spread.withColumnRenamed("tool_name", "t"), F.expr("tool_name <=> t"), "left").drop("t")
    return joined.withColumns({"p50_ms": F.round("p50_ms"), "p95_ms": F.round("p95_ms")})


def mutation_history(mutations: DataFrame, run_id: str | None = None, n: int = 100) -> DataFrame:
    """Table changes: one run in full, or the newest ``n`` of all runs."""
    changed = mutations.withColumn("rows_affected", F.abs(F.col("rows_after") - F.col("rows_before")))
    if run_id:
        return changed.where(F.col("run_id") == run_id)
    return changed.orderBy(F.desc("mutated_at"), "mutation_id").limit(n)


def model_costs(calls: DataFrame) -> DataFrame:
    total, n = F.sum("cost_nanos"), F.count("*")
    return priced_calls(calls).groupBy("provider", "model").agg(
        n.alias("total_calls"),
        F.sum("total_tokens").alias("total_tokens"),
        usd(total).alias("total_cost_usd"),
        usd(F.floor(total / n)).alias("avg_cost_per_call_usd"),
    )


def compliance_events(events: DataFrame, run_id: str | None = None, event_type: str | None = None,
                      n: int = 200) -> DataFrame:
    if run_id:
        events = events.where(F.col("run_id") == run_id)
    if event_type:
        events = events.where(F.col("event_type") == event_type)
    return events.orderBy(F.desc("event_ts"), "event_id").limit(n)


def pii_trends(events: DataFrame) -> DataFrame:
    """How often each column was found and masked."""
    kinds = events.where(F.col("event_type").isin("PII_DETECTED", "MASKING_APPLIED") & (F.col("column_name") != ""))
    counts = kinds.groupBy("column_name", "pii_type", "sensitivity").agg(*tally(
        detection_count="event_type = 'PII_DETECTED'", masked_count="event_type = 'MASKING_APPLIED'"))
    return counts.withColumn("mask_rate_pct", rate_pct(F.col("masked_count"), F.col("detection_count")))


def failure_analysis(steps: DataFrame) -> DataFrame:
    """Failures per tool with the earliest error text and a fix hint."""
    failed = steps.where(~F.col("success") & F.col("error_message").isNotNull())
    return failed.groupBy("tool_name").agg(
        F.count("*").alias("failure_count"),
        F.max("started_at").alias("last_seen"),
        F.min_by("error_message", F.struct("started_at", "step_id", "error_message")).alias("sample_error"),
    ).withColumn("suggested_fix", lookup(F.col("tool_name"), FIX_HINTS, DEFAULT_HINT))


def run_costs(calls: DataFrame) -> DataFrame:
    return priced_calls(calls).groupBy("run_id").agg(
        F.sum("total_tokens").alias("total_tokens"), F.sum("cost_nanos").alias("cost_nanos"))


def finalised_runs(steps: DataFrame, calls: DataFrame) -> DataFrame:
    """Run rows: duration, step counts, tokens and cost."""
    per_run = steps.groupBy("run_id").agg(
        F.min("started_at").alias("started_at"), F.max("started_at").alias("completed_at"),
        F.sum("duration_ms").alias("duration_ms"),
        F.count("*").alias("total_steps"),
        F.count_if(~F.col("success")).alias("failed_steps"))
    spend = run_costs(calls)
    return per_run.join(spend, "run_id", "left").select(
        *per_run.columns,
        F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"),
        usd(F.coalesce("cost_nanos", F.lit(0))).alias("estimated_cost_usd"))


def cost_outliers(runs: DataFrame, newest: int = 100, factor: float = 2.0) -> DataFrame:
    """Runs among the newest ones that cost more than twice their median."""
    recent = recent_runs(runs, newest)
    median = recent.agg(
        F.expr("percentile_cont(0.5) within group (order by estimated_cost_usd)").alias("median_cost")).scalar()
    return recent.withColumn("median_cost", median).where(
        F.col("estimated_cost_usd") > F.col("median_cost") * factor).select(
        "run_id", "table_name", "total_steps", "estimated_cost_usd", "median_cost")


def refinement_report(steps: DataFrame, runs: DataFrame, events: DataFrame) -> DataFrame:
    """Findings as rows (section, item, detail)."""
    perf = tool_performance(steps)

    def rows(df: DataFrame, section: str, item: str, detail: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), F.col(item).alias("item"), detail.alias("detail"))

    def text(fmt: str, *cols: str) -> Column:
        return F.format_string(fmt, *[F.col(c).cast("string") for c in cols])

    top_failures = failure_analysis(steps).orderBy(F.desc("failure_count"), "tool_name").limit(5)
    violations = compliance_events(events, event_type="POLICY_VIOLATION").orderBy(
        F.desc("event_ts"), "event_id").limit(10)
    weak_masking = pii_trends(events).where(F.coalesce("mask_rate_pct", F.lit(0.0)) < 50)
    parts = [
        rows(perf.where("success_rate_pct < 95"), "reliability", "tool_name",
             F.concat(text("%s%% success (%s calls): ", "success_rate_pct", "total_calls"),
                      lookup(F.col("tool_name"), FIX_HINTS, "Review logs."))),
        rows(perf.where("p95_ms > 10000"), "performance", "tool_name",
             text("p95=%sms avg=%sms", "p95_ms", "avg_ms")),
        rows(cost_outliers(runs).orderBy(F.desc("estimated_cost_usd"), "run_id").limit(5), "cost", "run_id",
             text("$%s table=%s steps=%s", "estimated_cost_usd", "table_name", "total_steps")),
        rows(violations, "compliance_gap", "column_name", text("sensitivity=%s run=%s", "sensitivity", "run_id")),
        rows(weak_masking, "masking_gap", "column_name",
             text("type=%s detected=%s masked=%s", "pii_type", "detection_count", "masked_count")),
        rows(top_failures, "failure", "tool_name",
             F.concat(text("x%s last=%s: ", "failure_count", "last_seen"), F.left("sample_error", F.lit(100)))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def with_run_status(staged: DataFrame, runs: DataFrame) -> DataFrame:
    """Ledger events beside the pipeline run they belong to.

    Run ids are unique on the run side. The event side is counted per run and
    kind first, so a run that owns very many events joins as a few rows.
    """
    per_run = staged.groupBy("etl_run_id", "event_type").agg(F.count("*").alias("events"))
    run = runs.select(F.col("run_id").alias("etl_run_id"), F.col("status").alias("run_status"),
                      "compliance_status")
    return per_run.join(run, "etl_run_id", "left")
