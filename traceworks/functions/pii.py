"""Column-name and value heuristics for personal and financial data."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sensitivity classes, least to most sensitive.
SENSITIVITY_RANK = {"PUBLIC": 0, "PII_LOW": 1, "PII_MEDIUM": 2, "FINANCIAL": 3, "PII_HIGH": 4}

# Value patterns (type, pattern, class), in order.
VALUE_PATTERNS = [
    ("email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "PII_MEDIUM"),
    ("us_phone", r"\b(\+?1[\s.\-]?)?\(?\d{3}\)?[\s.\-]?\d{3}[\s.\-]?\d{4}\b", "PII_MEDIUM"),
    ("ssn", r"\b\d{3}[- ]\d{2}[- ]\d{4}\b", "PII_HIGH"),
    ("credit_card", r"\b(?:\d{4}[\s\-]?){3}\d{4}\b", "PII_HIGH"),
    ("iban", r"\b[A-Z]{2}\d{2}[A-Z0-9]{4,30}\b", "FINANCIAL"),
    ("ip_address", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "PII_LOW"),
    ("passport", r"\b[A-Z]{1,2}\d{6,9}\b", "PII_HIGH"),
]

# Column-name patterns (pattern, type, class), first hit wins.
NAME_PATTERNS = [
    (r"\b(password|passwd|secret|token|api.?key|private.?key|auth.?key)\b", "credential", "PII_HIGH"),
    (r"\b(ssn|social.?security|national.?id|sin|fiscal.?id|tax.?id|ein|itin)\b", "ssn", "PII_HIGH"),
    (r"\b(passport|drivers?.?licen[sc]e|dl.?num|gov.?id)\b", "gov_id", "PII_HIGH"),
    (r"\b(credit.?card|card.?num(?:ber)?|pan|cvv|cvc|card.?holder|expiry|exp.?date)\b", "credit_card",
     "PII_HIGH"),
    (r"\b(account.?num(?:ber)?|acct.?num|routing|iban|swift|bic|bank.?account|sort.?code)\b",
     "bank_account", "FINANCIAL"),
    (r"\b(salary|income|wage|compensation|bonus|revenue|profit|balance|net.?worth)\b", "financial_data",
     "FINANCIAL"),
    (r"\b(medical|diagnosis|diagnos[ei]s|icd.?\d|health|prescription|patient|clinical|mrn|npi|nhs)\b",
     "health", "PII_HIGH"),
    (r"\b(email|e.?mail|email.?address)\b", "email", "PII_MEDIUM"),
    (r"\b(phone|mobile|cell|telephone|tel|fax)\b", "phone", "PII_MEDIUM"),
    (r"\b(first.?name|last.?name|full.?name|given.?name|surname|maiden|middle.?name)\b", "name",
     "PII_MEDIUM"),
    (r"\b(dob|birth.?date|date.?of.?birth|birthday|age|gender|sex|race|ethnicity|nationality)\b",
     "demographics", "PII_MEDIUM"),
    (r"\b(street|address|addr|city|state|zip|postal|postcode|country|province|region)\b", "address",
     "PII_LOW"),
    (r"\b(ip.?addr(?:ess)?|ipv4|ipv6|mac.?addr)\b", "ip_address", "PII_LOW"),
    (r"\b(latitude|longitude|lat|lon|geo|location|coordinates)\b", "geo_data", "PII_LOW"),
]

# A column is flagged when at least this share of its values matches.
HIT_RATE = 0.10


def name_class(column: str) -> tuple[str, str] | None:
    """(type, class) of one known column name, decided while planning."""
    for pattern, kind, level in NAME_PATTERNS:
        if re.search(pattern, column, re.I):
            return kind, level
    return None


def name_class_column(name: Column) -> Column:
    """The same decision over a column of names: struct(pii_type, sensitivity)."""
    chain = F
    for pattern, kind, level in NAME_PATTERNS:
        chain = chain.when(
            name.rlike("(?iU)" + pattern),
            F.struct(F.lit(kind).alias("pii_type"), F.lit(level).alias("sensitivity")))
    return chain


# What a value must hold for a pattern to match at all; cheap to test.
_NEEDED = {
    "email": "@", "us_phone": r"\p{Nd}{3}", "ssn": r"\p{Nd}{3}", "credit_card": r"\p{Nd}{4}",
    "iban": r"[A-Z]{2}\p{Nd}{2}", "ip_address": r"\p{Nd}\.\p{Nd}", "passport": r"[A-Z]\p{Nd}{6}",
}


def value_hits(text: Column) -> dict[str, Column]:
    def hit(kind: str, pattern: str) -> Column:
        need = _NEEDED[kind]
        possible = text.contains(need) if need == "@" else text.rlike(need)
        return possible & text.rlike("(?U)" + pattern)

    return {kind: hit(kind, pattern) for kind, pattern, _ in VALUE_PATTERNS}
