"""Spend, budgets, dashboard, pre-run estimates and downgrade advice."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceworks.functions.prices import (
    CONTROL_DEFAULT, CONTROL_PRICES, cost_nanos, exact_rate, fallback_model, half_up, prefix_rate, usd,
)
from traceworks.operators.aggregates import first_match
from traceworks.plans.audit import priced_calls


@dataclass(frozen=True)
class Budget:
    """Limits in USD and thresholds in percent."""

    per_run: float = 1.0
    per_day: float = 10.0
    per_month: float = 50.0
    warn_pct: float = 80.0
    stop_pct: float = 100.0
    daily_guard: float = 5.0


def merged_row(*frames: DataFrame) -> DataFrame:
    """Several one-row frames as one row, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def day_of(ts: str) -> Column:
    return F.left(F.col(ts), F.lit(10))


def month_of(ts: str) -> Column:
    return F.left(F.col(ts), F.lit(7))


def _controlled(calls: DataFrame) -> DataFrame:
    return priced_calls(calls, CONTROL_PRICES, CONTROL_DEFAULT)


def spend_by(calls: DataFrame, *keys: Column | str) -> DataFrame:
    """Calls, tokens and cost per key."""
    return _controlled(calls).groupBy(*keys).agg(
        F.count("*").alias("llm_calls"), F.sum("total_tokens").alias("total_tokens"),
        F.sum("cost_nanos").alias("cost_nanos"))


def spend_summary(calls: DataFrame, as_of: str, run_id: str) -> DataFrame:
    """Spend of one run, one day and one month in a single pass."""
    ts, cost = F.col("call_ts"), F.col("cost_nanos")

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, cost)), F.lit(0))

    in_run = F.col("run_id") == run_id
    return _controlled(calls).where(ts.startswith(as_of[:7]) | in_run).agg(
        usd(total(in_run)).alias("run_usd"),
        usd(total(ts.startswith(as_of))).alias("day_usd"),
        usd(total(ts.startswith(as_of[:7]))).alias("month_usd"),
        F.coalesce(F.sum(F.when(in_run, F.col("total_tokens"))), F.lit(0)).alias("run_tokens"))


def budget_state(pct: Column, budget: Budget) -> Column:
    return F.when(pct >= budget.stop_pct, "STOP").when(pct >= budget.warn_pct, "WARN").otherwise("OK")


def budget_check(calls: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """State of every run, day and month against its limit."""
    scopes = [("per_run", F.col("run_id"), budget.per_run), ("per_day", day_of("call_ts"), budget.per_day),
              ("per_month", month_of("call_ts"), budget.per_month)]
    scope = F.explode(F.array(*[
        F.struct(F.lit(name).alias("limit_type"), key.alias("period"), F.lit(limit).alias("limit_usd"))
        for name, key, limit in scopes])).alias("s")
    spent = _controlled(calls).select("cost_nanos", scope).groupBy(
        "s.limit_type", "s.period", "s.limit_usd").agg(usd(F.sum("cost_nanos")).alias("spent_usd"))
    pct = F.col("spent_usd") / F.col("limit_usd") * 100
    return spent.select(
        "limit_type", "period", "spent_usd", half_up(pct, 1).alias("pct"),
        budget_state(pct, budget).alias("state"),
        F.greatest(F.lit(0.0), F.round(F.col("limit_usd") - F.col("spent_usd"), 6)).alias("remaining_usd"))


def dashboard(calls: DataFrame, runs: DataFrame, as_of: str, budget: Budget = Budget()) -> DataFrame:
    """One row: spend and limits, run count, top model and costliest run."""
    ts = F.col("call_ts")
    by_model = _controlled(calls).groupBy("model").agg(
        F.sum("cost_nanos").alias("all_time"),
        F.sum(F.when(ts.startswith(as_of), F.col("cost_nanos"))).alias("day"),
        F.sum(F.when(ts.startswith(as_of[:7]), F.col("cost_nanos"))).alias("month"))
    spend = by_model.agg(
        F.coalesce(F.sum("day"), F.lit(0)).alias("day"), F.coalesce(F.sum("month"), F.lit(0)).alias("month"),
        F.max_by("model", F.struct("all_time", "model")).alias("top_cost_model"))
    run_facts = runs.agg(
        F.count_distinct(F.when(F.col("started_at").startswith(as_of), F.col("run_id"))).alias("runs_today"),
        F.max_by("run_id", F.struct("estimated_cost_usd", "run_id")).alias("most_expensive_run"),
        F.max("estimated_cost_usd").alias("most_expensive_usd"))
    both = merged_row(spend, run_facts).withColumns({
        "today_usd": usd(F.col("day"), 4), "month_usd": usd(F.col("month"), 4)})
    day_pct, month_pct = F.col("today_usd") / budget.per_day * 100, F.col("month_usd") / budget.per_month * 100
    worst = F.greatest(day_pct, month_pct)
    return both.select(
        "today_usd", "month_usd",
        F.greatest(F.lit(0.0), F.round(F.lit(budget.per_day) - F.col("today_usd"), 4)).alias("today_remaining_usd"),
        F.greatest(F.lit(0.0), F.round(F.lit(budget.per_month) - F.col("month_usd"), 4)).alias("month_remaining_usd"),
        half_up(day_pct, 1).alias("today_pct"), half_up(month_pct, 1).alias("month_pct"),
        first_match([(worst >= budget.stop_pct, "EXCEEDED"), (worst >= budget.warn_pct, "WARNING"),
                     (worst >= budget.warn_pct * 0.6, "WATCH")], "OK").alias("status"),
        "runs_today",
        F.when(F.col("runs_today") > 0, F.round(F.col("today_usd") / F.col("runs_today"), 4)).otherwise(0.0)
        .alias("avg_cost_per_run_usd"),
        "top_cost_model", "most_expensive_run", "most_expensive_usd")


# Tokens per stage of a run, and what columns and rows add.
STAGE_TOKENS = {
    "orchestrator_overhead": 1_500,
    "ingest_agent": 1_200,
    "compliance_agent": 3_500,
    "quality_agent": 2_000,
    "transform_agent": 3_000,
    "handoff_messages": 1_000,
}
PER_COLUMN_TOKENS = 80
PER_1K_ROWS_TOKENS = 20


def estimate_runs(planned: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """Token and cost estimate per planned run (column_count, row_count, model)."""
    columns, rows = F.col("column_count"), F.col("row_count")
    scaling_stages = 3  # compliance, quality and transform grow with the columns
    tokens = (F.lit(sum(STAGE_TOKENS.values())) + columns * PER_COLUMN_TOKENS * scaling_stages
              + F.floor(rows / 1000 * PER_1K_ROWS_TOKENS))
    sized = planned.withColumn("token_estimate", tokens.cast("bigint"))
    sized = sized.withColumns({
        "input_tokens": F.floor(F.col("token_estimate") * 0.60).cast("bigint"),
        "output_tokens": F.floor(F.col("token_estimate") * 0.40).cast("bigint")})
    rate = exact_rate(F.col("model"), CONTROL_PRICES, CONTROL_DEFAULT)
    nanos = cost_nanos(rate, F.col("input_tokens"), F.col("output_tokens"))
    usd_now = nanos / F.lit(1e9)
    pct = usd_now / budget.per_run * 100
    return sized.withColumns({
        "cost_estimate_usd": usd(nanos),
        "cost_low_usd": usd(F.floor(nanos * 6 / 10)),
        "cost_high_usd": usd(F.floor(nanos * 14 / 10)),
        "advice": first_match([(usd_now >= budget.per_run, "exceeds run budget"),
                               (pct >= budget.warn_pct, "watch spend")], "within budget")})


def daily_guard(calls: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """Spend, calls and what is left per day, priced by model-name prefix."""
    nanos = cost_nanos(prefix_rate(F.col("model")), F.col("prompt_tokens"), F.col("completion_tokens"))
    per_day = calls.groupBy(day_of("call_ts").alias("date")).agg(
        usd(F.sum(nanos)).alias("spent_usd"), F.count("*").alias("calls"))
    limit = budget.daily_guard
    return per_day.withColumns({
        "remaining_usd": F.greatest(F.lit(0.0), F.round(F.lit(limit) - F.col("spent_usd"), 6)),
        "pct_used": half_up(F.col("spent_usd") * 100 / limit, 1),
        "exhausted": F.col("spent_usd") >= limit})


LOCAL_MODEL = "llama3.1"


def downgrade(usage: DataFrame, warn_pct: float = 80.0, local: bool = True) -> DataFrame:
    """The model to go on with, from ``model`` and ``budget_pct``."""
    pct, cheaper = F.col("budget_pct"), fallback_model(F.col("model"))
    arms = F.when(pct < warn_pct, F.col("model")).when((pct < 95) & cheaper.isNotNull(), cheaper)
    if local:
        arms = arms.when(pct >= 95, F.lit(LOCAL_MODEL))
    return usage.withColumn("next_model", F.coalesce(arms.otherwise(cheaper), F.col("model")))


