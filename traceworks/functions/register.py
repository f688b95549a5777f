"""The column functions as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from traceworks.functions import pii, redact, sqltext


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: A number standing alone in a statement.
NUMBER = r"\b\d+(\.\d+)?\b"


def _masking(patterns: list[str], body: str = "t") -> str:
    for p in patterns:
        body = f"regexp_replace({body}, {quoted(p)}, {quoted(redact.REDACTED)})"
    return body


def _redacting() -> str:
    body = "t"
    for pattern, label in redact.TEXT_PII:
        body = f"regexp_replace({body}, {quoted(redact.unicode_pattern(pattern))}, {quoted(label)})"
    return body


def _summary(body: str, limit: int) -> str:
    flat = f"trim(regexp_replace({body}, {quoted('(?U)' + chr(92) + 's+')}, ' '))"
    return f"if(length({flat}) > {limit}, concat(left({flat}, {limit}), '…'), {flat})"


def _fingerprint() -> str:
    literals = f"regexp_replace(nullif(t, ''), {quoted(chr(39) + '[^' + chr(39) + ']*' + chr(39))}, {quoted(chr(39) + '?' + chr(39))})"
    numbers = f"regexp_replace({literals}, {quoted(redact.unicode_pattern(NUMBER))}, '?')"
    return _summary(_masking(redact.SECRET_PATTERNS, numbers), 300)


def _name_class() -> str:
    cases = " ".join(f"when rlike(t, {quoted('(?iU)' + pattern)}) then {quoted(kind)}"
                     for pattern, kind, _ in pii.NAME_PATTERNS)
    return f"case {cases} end"


def definitions() -> dict[str, str]:
    """Body of every function, over its one argument ``t``."""
    return {
        "mask_secrets": _masking(redact.SECRET_PATTERNS),
        "mask_credentials": _masking(redact.CREDENTIAL_PATTERNS),
        "mask_hash": "if(trim(t) = '', t, concat('H:', substring(sha2(t, 256), 1, 16)))",
        "text_hash": "sha2(nullif(t, ''), 256)",
        "dangerous_verbs":
            f"array_join(transform(regexp_extract_all(t, {quoted(sqltext.DANGEROUS_PATTERN)}, 1), v -> upper(v)), ',')",
        "sql_tables":
            f"array_join(array_sort(array_distinct(transform(regexp_extract_all(t, {quoted(sqltext.SOURCE_PATTERN)}, 1), "
            f"x -> lower(element_at(split(regexp_replace(x, {quoted(sqltext.QUOTES_PATTERN)}, ''), '[.]'), -1))))), ',')",
        "redact_pii": _redacting(),
        "summarise": _summary(_masking(redact.SECRET_PATTERNS), 500),
        "sql_fingerprint": _fingerprint(),
        "pii_class": _name_class(),
    }


def register(spark: SparkSession) -> list[str]:
    """Make the functions callable from SQL text; they stay inside the JVM."""
    for name, body in definitions().items():
        spark.sql(f"create or replace temporary function {name}(t string) returns string return {body}")
    return list(definitions())
