"""Masking of secrets and personal data inside text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REDACTED = "[REDACTED]"

# Secret patterns, applied in this order.
SECRET_PATTERNS = [
    r"""(?i)(api[_\-]?key|apikey|secret|token|password|passwd|pwd|bearer|auth)["\s:=]+[A-Za-z0-9+/=_\-]{8,}""",
    r"""(?i)(AKIA[0-9A-Z]{16})""",
    r"""(?i)(aws[_\-]?secret[_\-]?access[_\-]?key)["\s:=]+[A-Za-z0-9+/]{40}""",
    r"""(?i)(snowflake://[^\s"']+)""",
    r"""(?i)(postgresql://[^\s"']+)""",
    r"""(?i)(mysql://[^\s"']+)""",
    r"""eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+""",
    r"""(?i)Bearer\s+[A-Za-z0-9\-._~+/]+=*""",
    r"""-----BEGIN [A-Z ]+-----[\s\S]*?-----END [A-Z ]+-----""",
]

# The narrower set that leaves business text alone, in order.
CREDENTIAL_PATTERNS = [
    r"""(?i)(api[_\-]?key|apikey|secret|token|password|passwd|pwd|bearer)["\s:=]+[A-Za-z0-9+/=_\-]{8,}""",
    r"""(?i)(AKIA[0-9A-Z]{16})""",
    r"""eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+""",
    r"""(?i)Bearer\s+[A-Za-z0-9\-._~+/]+=*""",
    r"""-----BEGIN [A-Z ]+-----[\s\S]*?-----END [A-Z ]+-----""",
    r"""(?i)(snowflake|postgresql|mysql|redshift)://[^\s"']+""",
]

# Field names whose content is always hidden.
SENSITIVE_FIELDS = [
    "ssn", "social_security", "tax_id", "passport", "driver_license",
    "credit_card", "card_number", "cvv", "pin",
    "date_of_birth", "dob", "birth_date",
    "phone", "mobile", "fax",
    "email", "email_address",
    "address", "street", "postcode", "zip_code",
    "name", "first_name", "last_name", "full_name",
    "ip_address", "mac_address",
    "bank_account", "account_number", "routing_number", "iban",
    "medical_record", "diagnosis", "prescription",
]

# Personal-data patterns in text with their placeholders, in order.
TEXT_PII = [
    (r"\b\d{3}[- ]\d{2}[- ]\d{4}\b", "[SSN]"),
    (r"\b(?:\d{4}[\s\-]?){3}\d{4}\b", "[CARD_NUMBER]"),
    (r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "[EMAIL]"),
    (r"\b(\+?1[\s.\-]?)?\(?\d{3}\)?[\s.\-]?\d{3}[\s.\-]?\d{4}\b", "[PHONE]"),
    (r"\b[A-Z]{2}\d{2}[A-Z0-9]{4,30}\b", "[IBAN]"),
]


def unicode_pattern(pattern: str) -> str:
    """Word boundaries and classes that know accented letters on every JDK."""
    return "(?U)" + pattern


# A text without any of these words, in any case, matches no secret pattern. The
# plain search is far cheaper than the patterns, which then run on few texts.
_SECRET_WORDS = ["key", "secret", "token", "passw", "pwd", "bearer", "auth", "akia", "://", "eyj", "-----begin"]


def _any_word(text: Column, words: list[str]) -> Column:
    lowered = F.lower(text)
    hit = lowered.contains(words[0])
    for word in words[1:]:
        hit = hit | lowered.contains(word)
    return hit


def _mask_all(text: Column, patterns: list[str]) -> Column:
    masked = text
    for pattern in patterns:
        masked = F.regexp_replace(masked, pattern, REDACTED)
    return F.when(_any_word(text, _SECRET_WORDS), masked).otherwise(text)


def mask_secrets(text: Column) -> Column:
    return _mask_all(text, SECRET_PATTERNS)


def mask_credentials(text: Column) -> Column:
    """Hide typed-in credentials only; the rest of the text stays verbatim."""
    return _mask_all(text, CREDENTIAL_PATTERNS)


#: What stands in place of a stripped context entry.
STRIPPED = "[stripped]"


def cut(text: Column, limit: int, mark: str = "…") -> Column:
    """At most ``limit`` characters, with ``mark`` where something was cut."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(mark))).otherwise(text)


def summarise(text: Column, limit: int = 500) -> Column:
    """Secrets hidden, whitespace collapsed, length limited."""
    flat = F.trim(F.regexp_replace(mask_secrets(text), r"(?U)\s+", " "))
    return cut(flat, limit)


def sql_fingerprint(sql: Column) -> Column:
    """Statement shape without its literal values."""
    shape = F.regexp_replace(F.nullif(sql, F.lit("")), r"'[^']*'", "'?'")
    shape = F.regexp_replace(shape, r"(?U)\b\d+(\.\d+)?\b", "?")
    return summarise(shape, 300)


def text_hash(text: Column) -> Column:
    """SHA-256 in hex; NULL for NULL and empty text."""
    return F.sha2(F.nullif(text, F.lit("")), 256)


def _may_hold_pii(text: Column) -> Column:
    """False only where no pattern can match; cheap to test."""
    return text.contains("@") | text.rlike(r"\p{Nd}{2}")


def redact_pii(text: Column) -> tuple[Column, dict[str, Column]]:
    """Text with personal data replaced, and how often each pattern was hit.

    The patterns run in order and each count is taken on the text as the
    patterns before it left it.
    """
    possible = _may_hold_pii(text)
    counts, out = {}, text
    for pattern, label in TEXT_PII:
        hits = F.regexp_count(out, F.lit(unicode_pattern(pattern)))
        counts[label] = F.when(possible, hits).when(text.isNotNull(), 0)
        out = F.regexp_replace(out, unicode_pattern(pattern), label)
    return F.when(possible, out).otherwise(text), counts


def sanitised(df: DataFrame, strip: list[str], limit: int = 500) -> DataFrame:
    """Context rows fit to be sent on: columns named in ``strip`` hold a mark, longer texts lose personal data."""
    out = []
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if field.name in strip:
            value = F.lit(STRIPPED)
        elif isinstance(field.dataType, T.StringType):
            value = F.when(F.length(value) > limit, redact_pii(value)[0]).otherwise(value)
        out.append(value.alias(field.name))
    return df.select(*out)


def pii_findings(text: Column) -> dict[str, Column]:
    """Hits of each pattern on the unmodified text."""
    possible = _may_hold_pii(text)
    return {label: F.when(possible, F.regexp_count(text, F.lit(unicode_pattern(p)))).when(text.isNotNull(), 0)
            for p, label in TEXT_PII}


def _redact_value(value: Column, dtype: T.DataType, extra: list[str] | None) -> Column:
    """Any value below a key that is not sensitive."""
    if isinstance(dtype, T.StringType):
        return mask_secrets(value)
    if isinstance(dtype, T.MapType):
        return redact_map(value, dtype, extra)
    if isinstance(dtype, T.StructType):
        return redact_struct(value, dtype, extra)
    if isinstance(dtype, T.ArrayType) and not isinstance(dtype.elementType, T.AtomicType | T.NullType):
        return F.transform(value, lambda x: _redact_value(x, dtype.elementType, extra))
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StringType):
        return F.transform(value, mask_secrets)
    return value


def redact_map(values: Column, dtype: T.MapType, extra: list[str] | None = None) -> Column:
    """A map with sensitive keys hidden and secrets masked in its texts, at any depth.

    The key decides first, whatever the value is: text becomes the label, and a value of a type that cannot hold the
    label becomes NULL.
    """
    fields = SENSITIVE_FIELDS + [f.lower() for f in extra or []]
    hidden = F.lit(REDACTED) if isinstance(dtype.valueType, T.StringType) else F.lit(None).cast(dtype.valueType)

    def hide(key: Column, value: Column) -> Column:
        return F.when(F.lower(key).isin(fields), hidden).otherwise(_redact_value(value, dtype.valueType, extra))

    return F.transform_values(values, hide)


def redact_struct(value: Column, dtype: T.StructType, extra: list[str] | None = None) -> Column:
    """A struct with sensitive fields hidden, of any type, and secrets masked, walking its schema."""
    fields = set(SENSITIVE_FIELDS) | {f.lower() for f in extra or []}
    out = []
    for field in dtype.fields:
        inner = value.getField(field.name)
        inner = F.lit(REDACTED) if field.name.lower() in fields else _redact_value(inner, field.dataType, extra)
        out.append(inner.alias(field.name))
    return F.when(value.isNotNull(), F.struct(*out))


# Replacement label per sensitivity class.
REDACT_LABELS = {
    "PII_HIGH": "***REDACTED***",
    "FINANCIAL": "***FINANCIAL***",
    "PII_MEDIUM": "***PII***",
    "PII_LOW": "***PII***",
}


def mask_hash(value: Column) -> Column:
    """One-way token that keeps equality; NULL and blank pass through."""
    text = value.cast("string")
    return F.when(F.trim(text) == "", text).otherwise(
        F.concat(F.lit("H:"), F.substring(F.sha2(text, 256), 1, 16)))


def redact_label(sensitivity: str) -> str:
    return REDACT_LABELS.get(sensitivity, "***")


def partial_mask(value: Column, keep: int = 2) -> Column:
    """First characters kept, the rest starred; the host part of an e-mail stays."""
    text = value.cast("string")
    local = F.substring_index(text, "@", 1)
    host = F.substring(text, F.length(local) + 1, F.length(text))
    return F.concat(F.left(local, F.lit(keep)), F.lit("***"), host)
