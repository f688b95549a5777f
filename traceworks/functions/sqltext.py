"""What a SQL text refers to, read with patterns over a text column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Statement verbs that are never allowed.
DANGEROUS_VERBS = ["DROP", "TRUNCATE", "DELETE", "UPDATE", "INSERT", "MERGE", "CREATE", "ALTER", "GRANT",
                   "REVOKE", "EXEC", "EXECUTE"]

DANGEROUS_PATTERN = r"(?i)\b(" + "|".join(DANGEROUS_VERBS) + r")\b"
SOURCE_PATTERN = r"(?i)\b(?:FROM|JOIN|INTO)\b\s+([\w.`\[\]\"]+)"
SELECT_LIST_PATTERN = r"(?is)\bSELECT\b(.*?)\bFROM\b"
BARE_STAR_PATTERN = r"(?<!\()\*(?!\))"
QUOTES_PATTERN = r'^[`"\[\]\s]+|[`"\[\]\s]+$'
AS_PATTERN = r"(?i)\bAS\b"


def _unquoted(text: Column) -> Column:
    return F.regexp_replace(text, QUOTES_PATTERN, "")


def _last_part(text: Column) -> Column:
    return F.lower(F.element_at(F.split(text, r"\."), -1))


def dangerous_verbs(sql: Column) -> Column:
    """Forbidden verbs in the text, upper-cased, in order, repeats kept."""
    return F.transform(F.regexp_extract_all(sql, F.lit(DANGEROUS_PATTERN), F.lit(1)), F.upper)


def referenced_tables(sql: Column) -> Column:
    """Distinct table names after FROM, JOIN or INTO, without schema, lower-cased, sorted."""
    raw = F.regexp_extract_all(sql, F.lit(SOURCE_PATTERN), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(raw, lambda t: _last_part(_unquoted(t)))))


def selected_columns(sql: Column) -> Column:
    """Output names of the first SELECT list; ``*`` alone when it has a bare star.

    An alias stands for its expression, and every comma splits, so a
    function call with two arguments counts as two entries.
    """
    text = F.regexp_extract(sql, SELECT_LIST_PATTERN, 1)

    def name(part: Column) -> Column:
        alias = _unquoted(F.element_at(F.split(part, AS_PATTERN), -1))
        return F.when(part.rlike(AS_PATTERN), alias).otherwise(_last_part(_unquoted(part)))

    names = F.filter(F.transform(F.split(text, ","), name), lambda c: c != "")
    return (
        F.when(text == "", F.array().cast("array<string>"))
        .when(text.rlike(BARE_STAR_PATTERN), F.array(F.lit("*")))
        .otherwise(F.array_sort(F.array_distinct(names))))


def selected_expressions(sql: Column) -> Column:
    """Raw entries of the SELECT list, for checks that look behind aliases."""
    text = F.regexp_extract(sql, SELECT_LIST_PATTERN, 1)
    return F.transform(F.split(text, ","), lambda p: F.lower(F.trim(p)))
