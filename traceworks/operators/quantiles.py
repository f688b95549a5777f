"""Exact percentiles per group without collecting a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Value ranges per key.
RANGES = 256


def ranged(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """(_g, _v, _n, _gb): how often each value occurs per key, and the value range of the key it lies in."""
    rows = df.select(F.struct(*keys).alias("_g"), value.alias("_v")).where(F.col("_v").isNotNull())
    cuts = rows.groupBy("_g").agg(F.array_distinct(F.percentile_approx(
        "_v", [k / RANGES for k in range(1, RANGES)], 20 * RANGES)).alias("_cuts"))
    counts = rows.groupBy("_g", "_v").agg(F.count("*").alias("_n"))
    below = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    return counts.join(cuts, "_g").withColumn("_gb", F.struct("_g", below.alias("b"))).drop("_cuts")


def exact_percentiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Interpolated percentiles of ``value`` per key.

    Equal values are counted before the shuffle. The counts are cut into
    value ranges at approximate quantiles, ``RANGES`` of about equally many rows per
    key however close its values lie; running totals over the ranges say which
    of them hold the wanted ranks, and only those ranges are ordered value by value.
    """
    v = F.col(value).cast("double")
    counts = ranged(df, keys, v)
    group = Window.partitionBy("_gb._g")
    ranges = (
        counts.groupBy("_gb").agg(F.sum("_n").alias("_rn"))
        .select(
            "_gb", "_rn",
            F.sum("_rn").over(group).alias("_total"),
            F.coalesce(F.sum("_rn").over(group.orderBy("_gb.b").rowsBetween(Window.unboundedPreceding, -1)),
                       F.lit(0)).alias("_before"))
    )

    def ranks(p: float):
        exact = (F.col("_total") - 1) * F.lit(p)
        return exact, F.floor(exact), F.ceil(exact)

    wanted = F.lit(False)
    for p in points.values():
        _, lo, hi = ranks(p)
        wanted = wanted | ((F.col("_before") <= hi) & (F.col("_before") + F.col("_rn") > lo))

    inside = Window.partitionBy("_gb").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.join(ranges.where(wanted), "_gb").withColumn(
        "_from", F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))

    picks = []
    for name, p in points.items():
        exact, lo, hi = ranks(p)

        def at(rank):
            return F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_from") + F.col("_n")), F.col("_v")))

        low, high, part = at(lo), at(hi), F.max(exact - lo)
        picks.append((low + (high - low) * part).alias(name))
    return placed.groupBy("_g").agg(*picks).select("_g.*", *points)
