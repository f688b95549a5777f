"""Aggregate expressions shared by the ledger, audit and mart jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sensitivity levels, least to most severe.
SENSITIVITY_LEVELS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


Cond = Column | str


def cond_of(cond: Cond) -> Column:
    """A Column as it is, text as a SQL expression."""
    return F.expr(cond) if isinstance(cond, str) else cond


def safe(cond: Cond) -> Column:
    """A predicate that is never NULL."""
    return F.coalesce(cond_of(cond), F.lit(False))


def first_match(arms: list[tuple[Cond, str]], default: str | None) -> Column:
    """The label of the first true condition."""
    chain = reduce(lambda acc, arm: acc.when(cond_of(arm[0]), arm[1]), arms, F)
    return chain.otherwise(F.lit(default))


def some(cond: Cond) -> Column:
    """True when at least one row of the group meets ``cond``."""
    return F.coalesce(F.bool_or(cond_of(cond)), F.lit(False))


def tally(**conditions: Cond) -> list[Column]:
    """One ``count_if`` column per named condition."""
    return [F.count_if(safe(cond)).alias(name) for name, cond in conditions.items()]


def distinct_counts(**columns: str) -> list[Column]:
    return [F.count_distinct(F.col(col)).alias(name) for name, col in columns.items()]


def vocabulary_size(col: str) -> Column:
    """Distinct values of a column with a small vocabulary (models, datasources).

    Shares its set with :func:`distinct_list`, where a distinct count would
    make the planner expand every row once more.
    """
    return F.size(F.collect_set(col)).cast("bigint")


def distinct_list(col: str | Column, sep: str = ", ") -> Column:
    """Distinct values in order, joined; '' when there is none."""
    return F.array_join(F.sort_array(F.collect_set(col)), sep)


def rate_pct(part: Column, whole: Column, digits: int = 1) -> Column:
    """``part`` per hundred of ``whole``, NULL when ``whole`` is zero."""
    whole = whole.cast("double")
    return F.round(part.cast("double") * 100 / F.when(whole != 0, whole), digits)


def severity_rank(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SENSITIVITY_LEVELS)), level)


def most_severe(level: str) -> Column:
    """The most severe level of the group, NULL when no row carries one."""
    rank = F.max(F.nullif(severity_rank(F.col(level)), F.lit(0)))
    return F.try_element_at(F.array(*map(F.lit, SENSITIVITY_LEVELS)), rank.cast("int"))
