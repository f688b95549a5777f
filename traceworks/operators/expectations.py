"""Declarative data tests: unique, not_null, accepted_values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Expectation:
    kind: str  # not_null | accepted_values | unique
    column: str
    values: tuple = ()

    @property
    def name(self) -> str:
        return f"{self.kind}_{self.column}"


def _fails(e: Expectation):
    col = F.col(e.column)
    if e.kind == "not_null":
        return col.isNull()
    return col.isNotNull() & ~col.isin(*e.values)


def run_expectations(df: DataFrame, tests: list[Expectation]) -> DataFrame:
    """(test, column_name, failures) per test. All row tests share one pass;
    a unique test counts the values that occur more than once."""
    row_tests = [t for t in tests if t.kind != "unique"]
    out = None
    if row_tests:
        counted = df.agg(*[F.count_if(_fails(t)).alias(t.name) for t in row_tests])
        out = counted.select(F.inline(F.array(*[
            F.struct(F.lit(t.name).alias("test"), F.lit(t.column).alias("column_name"),
                     F.col(t.name).alias("failures")) for t in row_tests])))
    for t in (t for t in tests if t.kind == "unique"):
        repeated = (
            df.where(F.col(t.column).isNotNull()).groupBy(t.column).count().where("count > 1")
            .agg(F.count("*").alias("failures"))
            .select(F.lit(t.name).alias("test"), F.lit(t.column).alias("column_name"), "failures"))
        out = repeated if out is None else out.unionByName(repeated)
    return out


def failing_rows(df: DataFrame, test: Expectation, cap: int | None = None) -> DataFrame:
    """The rows (or repeated values) a test rejects; with ``cap`` the first so many by the tested column."""
    if test.kind == "unique":
        bad = df.where(F.col(test.column).isNotNull()).groupBy(test.column).count().where("count > 1")
    else:
        bad = df.where(_fails(test))
    return bad.orderBy(test.column).limit(cap) if cap else bad
