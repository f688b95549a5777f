"""Column profiles, duplicate counts and key checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def long_form(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One narrow row per cell: (column_name, value as text)."""
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
             for c in columns or df.columns]
    return df.select(F.inline(F.array(*cells)))


def column_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Nulls, distinct values and a low-cardinality flag for every column.

    One scan. Cells are counted per (column, digest of the value) before the
    shuffle, so a dominant value or column costs one row per task and no text
    travels; the second step only sees per-column sums. ``approx`` skips the
    value shuffle altogether.
    """
    types = F.create_map(*[F.lit(x) for name, t in df.dtypes for x in (name, t)])
    cells = long_form(df)
    if approx:
        stats = cells.groupBy("column_name").agg(
            F.count("*").alias("row_count"),
            F.count_if(F.col("value").isNull()).alias("null_count"),
            F.approx_count_distinct("value").alias("distinct_count"),
        )
    else:
        # 96 bits stand for a value; null has none.
        has = F.col("value").isNotNull()
        digests = cells.select("column_name", F.when(has, F.xxhash64("value")).alias("a"), F.when(has, F.hash("value")).alias("b"))
        stats = (
            digests.groupBy("column_name", "a", "b").agg(F.count("*").alias("n"))
            .groupBy("column_name").agg(
                F.sum("n").alias("row_count"),
                F.sum(F.when(F.col("a").isNull(), F.col("n")).otherwise(0)).alias("null_count"),
                F.count("a").alias("distinct_count"),
            )
        )
    return _reported(stats.withColumn("type", types[F.col("column_name")]))


def _reported(stats: DataFrame) -> DataFrame:
    """Profile rows from (column_name, type, row_count, null_count, distinct_count)."""
    n = F.col("row_count")
    return stats.select(
        "column_name",
        "type",
        "row_count",
        "null_count",
        F.round(F.col("null_count") / F.greatest(n, F.lit(1)) * 100, 1).alias("null_pct"),
        "distinct_count",
        ((n > 1) & (F.col("distinct_count") < F.greatest(n * 0.01, F.lit(2.0)))).alias("low_cardinality"),
    )


def profile_partial(df: DataFrame, part: str) -> DataFrame:
    """What a part of a table (a day, a load) adds to the table's profile: one mergeable row per column.

    Counts, and a sketch of the distinct values; to be stored beside the part, named ``part``.
    """
    types = F.create_map(*[F.lit(x) for name, t in df.dtypes for x in (name, t)])
    return long_form(df).groupBy("column_name").agg(
        F.count("*").alias("row_count"),
        F.count_if(F.col("value").isNull()).alias("null_count"),
        F.hll_sketch_agg("value", 14).alias("values"),
    ).select(F.lit(part).alias("part"), "column_name", types[F.col("column_name")].alias("type"), "row_count", "null_count", "values")


def merged_profile(partials: DataFrame) -> DataFrame:
    """The profile of a table from its parts' rows, without its cells; distinct counts are the sketches' estimates.

    A part that was stored twice counts once.
    """
    once = partials.dropDuplicates(["part", "column_name"])
    return _reported(once.groupBy("column_name").agg(
        F.max("type").alias("type"), F.sum("row_count").alias("row_count"), F.sum("null_count").alias("null_count"),
        F.hll_sketch_estimate(F.hll_union_agg("values")).alias("distinct_count")))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and the difference, over whole rows."""
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("n"))
    return counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.count("*").alias("unique_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def quality_issues(df: DataFrame) -> DataFrame:
    """Issue texts: columns with nulls, and fully duplicate rows."""
    nulls = column_profile(df, approx=True).where("null_pct > 0").select(
        F.format_string("'%s': %s%% nulls (%s rows)", "column_name",
                        F.col("null_pct").cast("string"),
                        F.format_number("null_count", 0)).alias("issue"))
    dups = duplicate_rows(df).where("duplicate_rows > 0").select(
        F.concat(F.format_number("duplicate_rows", 0), F.lit(" fully duplicate rows detected")).alias("issue"))
    return nulls.unionByName(dups)


def key_check(df: DataFrame, column: str) -> DataFrame:
    """Whether a column is unique and never NULL; hot values combine map-side."""
    counted = df.groupBy(F.col(column).alias("k")).agg(F.count("*").alias("n"))
    return counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.count("k").alias("unique_values"),
        F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
    ).select(
        F.lit(column).alias("column_name"), "*",
        ((F.col("unique_values") == F.col("total_rows")) & (F.col("null_count") == 0)).alias("is_key"),
    )


def validate_table(df: DataFrame, primary_keys: list[str], min_rows: int = 1) -> DataFrame:
    """Row-count and key checks of a cleaned table: status, row_count, issues."""
    present = [c for c in primary_keys if c in df.columns]
    checks = [F.when(F.col("row_count") < min_rows,
                     F.format_string(f"Row count %d < min_rows {min_rows}", "row_count"))]
    for c in primary_keys:
        if c in present:
            checks.append(F.when(F.col(f"nulls_{c}") > 0,
                                 F.format_string(f"PK column '{c}' has %d null values", f"nulls_{c}")))
        else:
            checks.append(F.lit(f"PK column '{c}' missing from data"))
    counts = df.agg(F.count("*").alias("row_count"),
                    *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in present])
    issues = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return counts.select(
        F.when(F.size(issues) == 0, "passed").otherwise("failed").alias("status"),
        "row_count", F.array_join(issues, "; ").alias("issues"))
