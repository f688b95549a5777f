"""Config-driven cleaning of an ingested table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceworks.operators.dedup import dedup_table


@dataclass
class TableConfig:
    primary_keys: list[str] = field(default_factory=list)
    date_columns: list[str] = field(default_factory=list)
    numeric_columns: list[str] = field(default_factory=list)
    partition_spec: list[str] = field(default_factory=list)
    load_mode: str = "full"


def iso_text(value: Column) -> Column:
    """Date text in one format; NULL where it is not a date."""
    return F.date_format(F.try_to_timestamp(value.cast("string")), "yyyy-MM-dd'T'HH:mm:ss")


def number_or_null(value: Column) -> Column:
    return value.cast("string").try_cast("double")


def clean(df: DataFrame, config: TableConfig, order: list[Column | str]) -> DataFrame:
    """Dedup, then dates and numbers; cells that do not parse become NULL."""
    out = dedup_table(df, config.primary_keys, order)
    fixes = {c: iso_text(F.col(c)) for c in config.date_columns if c in df.columns}
    fixes |= {c: number_or_null(F.col(c)) for c in config.numeric_columns if c in df.columns}
    return out.withColumns(fixes) if fixes else out
