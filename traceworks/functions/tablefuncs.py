"""Table functions for SQL: rows per violated condition, and partial column profiles of any table."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import BooleanType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


class ViolationRows:
    """``violation_rows(name => condition, ..)``: one row with its name per condition that holds.

    The conditions are whatever boolean arguments the call names, in their order; null counts as not met.
    """

    @staticmethod
    def analyze(**conditions: AnalyzeArgument) -> AnalyzeResult:
        if not conditions:
            raise ValueError("violation_rows needs a named condition")
        for name, given in conditions.items():
            if given.isTable or not isinstance(given.dataType, BooleanType):
                raise ValueError(f"{name} is not a boolean")
        return AnalyzeResult(StructType().add("violation", StringType()))

    def eval(self, **conditions):
        for name, met in conditions.items():
            if met:
                yield (name,)


class ColumnCounts:
    """``column_counts(TABLE(t))``: per column of any table the rows, nulls and longest text of one part of it.

    Every task profiles the rows it has; parts are put together by sums and maxima. With ``PARTITION BY`` a part is a
    group, whose keys come first in each row, in the order of the columns named in ``keys``.
    """

    def __init__(self, analyzed=None):
        self.rows, self.nulls, self.longest = 0, None, None

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("column_counts needs a TABLE argument")
        schema = StructType().add("column_name", StringType()).add("rows", LongType()).add("nulls", LongType())
        return AnalyzeResult(schema.add("longest", LongType()))

    def eval(self, row):
        if self.nulls is None:
            self.names = list(row.__fields__)
            self.nulls, self.longest = [0] * len(row), [0] * len(row)
        self.rows += 1
        for k, value in enumerate(row):
            if value is None:
                self.nulls[k] += 1
            else:
                self.longest[k] = max(self.longest[k], len(str(value)))

    def terminate(self):
        if self.nulls is not None:
            for name, n, size in zip(self.names, self.nulls, self.longest):
                yield name, self.rows, n, size


def register(spark: SparkSession) -> list[str]:
    """Make the table functions callable from SQL text.

    Both take one row a call, and as an Arrow function each call would make a record batch of its own.
    """
    from pyspark.sql.functions import udtf

    for name, handler in (("violation_rows", ViolationRows), ("column_counts", ColumnCounts)):
        spark.udtf.register(name, udtf(handler, useArrow=False))
    return ["violation_rows", "column_counts"]
