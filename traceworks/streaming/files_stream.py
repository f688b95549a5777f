"""Incremental file ingest: every file is read once, whatever the restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from traceworks.operators.clean import TableConfig, iso_text, number_or_null
from traceworks.streaming.ledger_stream import ALL_AT_HAND


def incoming_files(spark: SparkSession, path: str, schema, source: str = "csv", **options) -> DataFrame:
    """New files of a folder with the path each row came from."""
    reader = spark.readStream.format(source).schema(schema).options(**options)
    return reader.load(path).withColumn("source_path", F.col("_metadata.file_path"))


def ingest_files(files: DataFrame, config: TableConfig, out_path: str, checkpoint: str,
                 trigger: dict | None = None) -> StreamingQuery:
    """Dates and numbers normalised per row, appended as Parquet.

    The checkpoint remembers the files that were read; keys are made unique
    when the table is built from these rows.
    """
    fixes = {c: iso_text(F.col(c)) for c in config.date_columns if c in files.columns}
    fixes |= {c: number_or_null(F.col(c)) for c in config.numeric_columns if c in files.columns}
    cleaned = files.withColumns(fixes) if fixes else files
    return (cleaned.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or ALL_AT_HAND)).start())
