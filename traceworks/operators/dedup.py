"""First-row and last-row dedup, idempotent appends and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row per key in ``order``.

    ``row_number = 1`` lets the planner drop all but one row per key in every
    task before the shuffle, so a key with very many copies is not collected.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def keep_last(df: DataFrame, keys: list[str], cursor: list[str]) -> DataFrame:
    return keep_first(df, keys, [F.col(c).desc_nulls_last() for c in cursor])


def dedup_table(df: DataFrame, primary_keys: list[str], order: list[Column | str]) -> DataFrame:
    """First row per key when every key column exists, else distinct rows."""
    if primary_keys and all(k in df.columns for k in primary_keys):
        return keep_first(df, primary_keys, order)
    return df.distinct()


def ingest_position(df: DataFrame) -> DataFrame:
    """Parquet rows with the place they hold in their files."""
    return df.withColumns({
        "_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})


def append_new(existing: DataFrame, incoming: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """Rows of ``incoming`` to append: new keys only, first write wins."""
    return keep_first(incoming, [key], order).join(existing.select(key), key, "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], cursor: list[str]) -> DataFrame:
    """Both sides merged on ``keys``; the newest row by ``cursor`` wins, and at
    equal cursor the incoming one."""
    tagged = existing.withColumn("_new", F.lit(0)).unionByName(
        incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return keep_last(tagged, keys, [*cursor, "_new"]).drop("_new")


def sync(existing: DataFrame, incoming: DataFrame, mode: str, keys: list[str] | None = None,
         cursor: list[str] | None = None) -> DataFrame:
    """Table content after a sync: overwrite, append, or append with dedup."""
    if mode in ("full_refresh", "overwrite"):
        return incoming
    if mode == "append":
        return existing.unionByName(incoming, allowMissingColumns=True)
    if mode in ("incremental", "upsert"):
        if not keys:
            raise ValueError(f"mode {mode} needs key columns")
        return upsert(existing, incoming, keys, cursor or [])
    raise ValueError(f"unknown sync mode {mode}")
