"""Small summaries: chart check, merged test lists, run summary lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T



def chartable(df: DataFrame) -> DataFrame:
    """True for more than one row and at least one numeric column; reads two rows."""
    numeric = any(isinstance(f.dataType, T.NumericType) for f in df.schema.fields)
    return df.limit(2).agg((F.count("*") > 1).alias("many")).select((F.col("many") & F.lit(numeric)).alias("chartable"))


def merged_tests(*lists: DataFrame) -> DataFrame:
    """Test lists (kind, column_name, values) as one, each test once.

    Column names are compared in identifier form; only accepted_values keeps
    its values.
    """
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more)
    name = F.regexp_replace(F.trim("column_name"), "[^0-9a-zA-Z_]+", "_")
    name = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")
    name = F.lower(F.regexp_replace(F.regexp_replace(name, "_+", "_"), "^_|_$", ""))
    normal = out.select(
        "kind", name.alias("column_name"),
        F.when(F.col("kind") == "accepted_values", F.col("values")).otherwise(F.array().cast("array<string>")).alias("values"))
    return normal.where((F.col("kind") != "") & (F.col("column_name") != "")).distinct()


def run_summary(runs: DataFrame) -> DataFrame:
    """Ingest, quality and artifact lines per run."""
    return runs.select(
        "run_id",
        F.concat(F.lit("[INGEST]  "), F.col("table_name"), F.lit(" ("), F.format_number("row_count", 0),
                 F.lit(" rows)")).alias("ingest_line"),
        F.when(F.col("issues") == 0, "[QUALITY] CLEAN").otherwise(
            F.concat(F.lit("[QUALITY] "), F.col("issues").cast("string"), F.lit(" issue(s)"))).alias("quality_line"),
        F.when(F.col("artifacts") > 0, F.concat(F.lit("[DBT]     "), F.col("artifacts").cast("string"),
                                               F.lit(" artifact(s) generated")))
        .otherwise("[DBT]     Not run").alias("artifact_line"))


