"""Running spend against limits, each threshold reported once."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from traceworks.functions.prices import CONTROL_DEFAULT, CONTROL_PRICES
from traceworks.plans.audit import priced_calls
from traceworks.plans.cost import Budget, day_of, month_of
from traceworks.sources.ledger_store import exists
from traceworks.streaming.ledger_stream import ALL_AT_HAND
from traceworks.streaming.state import combined, into_batches, rocksdb

SCOPE = ["limit_type", "period", "limit_usd"]
#: How long a total is kept after its last call.
KEPT = {"per_run": timedelta(days=7), "per_day": timedelta(days=3), "per_month": timedelta(days=40)}


def spend_parts(calls: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """(limit_type, period, limit_usd, cost_nanos_sum) of a stream of calls, combined in every task."""
    scopes = F.explode(F.array(
        F.struct(F.lit("per_run").alias("limit_type"), F.col("run_id").alias("period"), F.lit(budget.per_run).alias("limit_usd")),
        F.struct(F.lit("per_day").alias("limit_type"), day_of("call_ts").alias("period"), F.lit(budget.per_day).alias("limit_usd")),
        F.struct(F.lit("per_month").alias("limit_type"), month_of("call_ts").alias("period"),
                 F.lit(budget.per_month).alias("limit_usd")))).alias("s")
    priced = priced_calls(calls, CONTROL_PRICES, CONTROL_DEFAULT)
    rows = priced.select(scopes, F.col("cost_nanos").cast("long").alias("cost_nanos")).select("s.*", "cost_nanos")
    return combined(rows, SCOPE, [("cost_nanos", "sum")],
                    "limit_type string, period string, limit_usd double, cost_nanos_sum long")


class Spend(StatefulProcessor):
    """The total of one limit and period, and which levels it has crossed. Both end some time after the last call."""

    def __init__(self, budget: Budget, kept: dict[str, timedelta]):
        self.levels = [("WARN", budget.warn_pct), ("STOP", budget.stop_pct)]
        self.kept = {limit: max(1, int(d.total_seconds() * 1000)) for limit, d in kept.items()}

    def init(self, handle) -> None:
        kind = "nanos long, crossed array<string>"
        self.totals = {limit: handle.getValueState(limit, kind, ms) for limit, ms in self.kept.items()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        limit, period, usd = key
        total = self.totals[limit]
        before = total.get()
        nanos, crossed = before if before is not None else (0, [])
        nanos += sum(r.cost_nanos_sum or 0 for r in rows)
        spent = (nanos + 500) // 1000 / 1e6  # dollars rounded half up to six digits
        new = [level for level, pct in self.levels if usd and level not in crossed and spent / usd * 100 >= pct]
        total.update((nanos, [*crossed, *new]))
        for level in new:
            yield Row(limit_type=limit, period=period, level=level)

    def close(self) -> None:
        pass


def alerts(calls: DataFrame, log_path: str, checkpoint: str, budget: Budget = Budget(),
           trigger: dict | None = None, kept: dict[str, timedelta] = KEPT) -> StreamingQuery:
    """WARN and STOP rows in ``log_path``, one each per limit and period.

    The state holds the totals and what was reported, so neither the log nor earlier calls are read again. A total that
    had no call for the time in ``kept`` is dropped; calls that come later still start a new one.
    """
    parts = spend_parts(calls, budget)
    crossed = parts.groupBy(*SCOPE).transformWithState(
        Spend(budget, kept), "limit_type string, period string, level string", "update", "processingTime")
    with rocksdb(calls.sparkSession):
        return (crossed.writeStream.outputMode("update").foreachBatch(into_batches(log_path))
                .option("checkpointLocation", checkpoint).trigger(**(trigger or ALL_AT_HAND)).start())


def reported(spark: SparkSession, log_path: str) -> DataFrame | None:
    return spark.read.parquet(f"{log_path}/batch=*") if exists(spark, log_path) else None
