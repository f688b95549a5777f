"""PII scan, masking, compliance status, report rows and governance catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceworks.functions import pii
from traceworks.functions.redact import mask_hash, redact_label
from traceworks.operators.profile import long_form

HIGH_RISK = [level for level, rank in pii.SENSITIVITY_RANK.items() if rank >= pii.SENSITIVITY_RANK["FINANCIAL"]]


def _finding(kind: Column, level: Column, method: Column) -> Column:
    return F.struct(kind.alias("pii_type"), level.alias("sensitivity"), method.alias("detection_method"))


def scan_pii(df: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """(column_name, pii_type, sensitivity, detection_method) for every column.

    Names are judged while planning. The values of the remaining columns are
    read once: cells in long form, hit counts per column combined map-side.
    All rows are read unless ``sample_rows`` asks for a sample.
    """
    named = {c: pii.name_class(c) for c in df.columns}
    by_value = [c for c, hit in named.items() if hit is None]
    rows = df.orderBy(F.rand(7)).limit(sample_rows) if sample_rows else df

    # With every column judged by name, no value is read.
    cells = long_form(rows if by_value else df.limit(0), by_value or df.columns).where(F.trim("value") != "")
    rates = cells.groupBy("column_name").agg(*[
        F.avg(hit.cast("int")).alias(f"r_{kind}") for kind, hit in pii.value_hits(F.col("value")).items()])
    verdict: Column = F
    for kind, _, level in pii.VALUE_PATTERNS:
        verdict = verdict.when(F.col(f"r_{kind}") >= pii.HIT_RATE,
                               _finding(F.lit(kind), F.lit(level), F.lit("value_regex")))
    rates = rates.select("column_name", verdict.alias("by_value"))

    listed = [
        F.struct(
            F.lit(c).alias("column_name"),
            (_finding(F.lit(hit[0]), F.lit(hit[1]), F.lit("column_name")) if hit
             else F.lit(None).cast("struct<pii_type:string,sensitivity:string,detection_method:string>")
             ).alias("by_name"))
        for c, hit in named.items()]
    columns = df.sparkSession.range(1).select(F.inline(F.array(*listed)))
    none = _finding(F.lit("none"), F.lit("PUBLIC"), F.lit("none"))
    return columns.join(rates, "column_name", "left").select(
        "column_name", F.coalesce("by_name", "by_value", none).alias("f")).select("column_name", "f.*")


def risk_columns(scan: DataFrame) -> DataFrame:
    """Lists of flagged and high-risk columns of one scan; one row."""
    name = F.col("column_name")
    high = F.col("sensitivity").isin(HIGH_RISK)
    return scan.agg(
        F.sort_array(F.collect_list(F.when(F.col("sensitivity") != "PUBLIC", name))).alias("pii_columns"),
        F.sort_array(F.collect_list(F.when(high, name))).alias("high_risk_columns"))


def mask_columns(df: DataFrame, sensitivity: dict[str, str], strategy: str = "hash",
                 columns: list[str] | None = None) -> DataFrame:
    """Hash or redact columns; by default the high-risk ones of the scan.

    Redaction also replaces NULL cells, hashing keeps them.
    """
    if columns is None:
        columns = [c for c, level in sensitivity.items() if level in HIGH_RISK]
    fixes = {}
    for c in columns:
        if c not in df.columns:
            continue
        if strategy == "hash":
            fixes[c] = mask_hash(F.col(c))
        else:
            fixes[c] = F.lit(redact_label(sensitivity.get(c, "PII_HIGH")))
    return df.withColumns(fixes) if fixes else df


def mask_stored(spark: SparkSession, path: str, sensitivity: dict[str, str], strategy: str = "hash",
                columns: list[str] | None = None) -> str:
    """Mask a stored Parquet table in place; what it held before goes to ``<path>__pre_mask``, whose path is returned.

    The backup is written first and masked from, so a job that stops half way loses nothing. An existing backup is
    never overwritten.
    """
    backup = f"{path.rstrip('/')}__pre_mask"
    spark.read.parquet(path).write.mode("error").parquet(backup)
    mask_columns(spark.read.parquet(backup), sensitivity, strategy, columns).write.mode("overwrite").parquet(path)
    return backup


def compliance_status(runs: DataFrame) -> DataFrame:
    """Status per run from its arrays ``pii_columns``, ``high_risk_columns``, ``masked_columns``."""
    open_high = F.array_except("high_risk_columns", "masked_columns")
    open_medium = F.array_except(F.array_except("pii_columns", "masked_columns"), "high_risk_columns")
    return runs.withColumns({"unmasked_high": open_high, "unmasked_medium": open_medium}).withColumn(
        "compliance_status",
        F.when(F.size("unmasked_high") > 0, "NON_COMPLIANT")
        .when(F.size("unmasked_medium") > 0, "NEEDS_REVIEW")
        .otherwise("COMPLIANT"))


# Report lines per regulation.
REGULATIONS = [
    ("personal", "GDPR / CCPA", "personal data processing"),
    ("financial", "SOX", "financial data integrity"),
    ("payment", "PCI-DSS", "cardholder data"),
    ("health", "HIPAA", "health information"),
]


def compliance_report(scan: DataFrame, masked: list[str], quality_issues: DataFrame) -> DataFrame:
    """Report as rows (section, item, detail). ``scan`` has one row per table
    column and ``quality_issues`` a few lines, so the pieces are schema-sized."""
    is_masked = F.col("column_name").isin(masked) if masked else F.lit(False)
    scan = scan.withColumn("masked", is_masked)
    public = F.col("sensitivity") == "PUBLIC"
    high = F.col("sensitivity").isin(HIGH_RISK)

    classes = scan.select(
        F.lit("classification").alias("section"), F.col("column_name").alias("item"),
        F.concat_ws(" | ", "sensitivity", "pii_type",
                    F.when(F.col("masked"), "YES").when(public, "-").otherwise("NO")).alias("detail"))
    masking = scan.where("masked").select(
        F.lit("masking").alias("section"), F.col("column_name").alias("item"),
        F.col("sensitivity").alias("detail"))
    quality = quality_issues.select(
        F.lit("quality").alias("section"), F.lit("issue").alias("item"), F.col("issue").alias("detail"))

    marks = scan.select(
        high.alias("high"), public.alias("public"), "masked", "sensitivity", "pii_type", "column_name",
        F.lit(0).alias("issue"),
    ).unionByName(quality_issues.select(F.lit(1).alias("issue")), allowMissingColumns=True)

    def seen(cond: str) -> Column:
        return F.coalesce(F.bool_or(F.expr(cond)), F.lit(False))

    facts = marks.agg(
        seen("high").alias("personal"),
        seen("sensitivity = 'FINANCIAL'").alias("financial"),
        seen("pii_type = 'credit_card'").alias("payment"),
        seen("pii_type = 'health'").alias("health"),
        F.array_join(F.sort_array(F.collect_list(F.expr("case when high and not masked then column_name end"))),
                     ", ").alias("open_high"),
        F.count_if(F.expr("not public and not high and not masked")).alias("open_medium"),
        F.sum("issue").alias("issues"))

    def line(section: str, item: str, detail: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(section).alias("section"), F.lit(item).alias("item"),
                                     detail.alias("detail")))

    lines = [line("regulation", name, F.lit(why), F.col(flag)) for flag, name, why in REGULATIONS]
    open_high, issues = F.col("open_high") != "", F.col("issues") > 0
    lines += [
        line("action", "CRITICAL", F.concat(
            F.lit("Mask or remove high-risk columns before sharing: "), F.col("open_high")), open_high),
        line("action", "HIGH", F.lit("Resolve data quality issues before production load."), issues),
        line("action", "MEDIUM", F.lit("Document a lawful basis for processing personal data."),
             F.col("personal")),
        line("action", "CRITICAL", F.lit("Confirm PCI-DSS scope and tokenize card data at source."),
             F.col("payment")),
        line("action", "NONE", F.lit("No critical actions required."), ~open_high & ~issues),
        line("verdict", "status",
             F.when(open_high, "NON_COMPLIANT").when(F.col("open_medium") > 0, "NEEDS_REVIEW")
             .otherwise("COMPLIANT"), F.lit(True)),
    ]
    tail = facts.select(F.inline(F.filter(F.array(*lines), lambda x: x.isNotNull())))
    return classes.unionByName(masking).unionByName(quality).unionByName(tail)


# Regulations and tags in the column catalog.
REGULATION_MAP = {
    "ssn": ["GDPR", "CCPA"],
    "credit_card": ["PCI-DSS", "GDPR"],
    "gov_id": ["GDPR", "CCPA"],
    "credential": ["GDPR"],
    "bank_account": ["SOX", "GDPR"],
    "financial_data": ["SOX"],
    "health": ["HIPAA", "GDPR"],
    "email": ["GDPR", "CCPA"],
    "phone": ["GDPR", "CCPA"],
    "name": ["GDPR", "CCPA"],
    "demographics": ["GDPR", "CCPA"],
    "address": ["GDPR", "CCPA"],
    "ip_address": ["GDPR"],
    "geo_data": ["GDPR"],
}
SENSITIVITY_TAGS = {
    "PII_HIGH": ["pii_high", "masked"],
    "FINANCIAL": ["financial", "sox"],
    "PII_MEDIUM": ["pii_medium"],
    "PII_LOW": ["pii_low"],
}


def _lookup(key: Column, table: dict[str, list[str]]) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(",".join(v)))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(""))


def governance_catalog(scan: DataFrame, profile: DataFrame, masked: dict[str, str],
                       primary_key: str | None = None) -> DataFrame:
    """One governance row per column: regulations, tags, review state, tests."""
    name, level, kind = F.col("column_name"), F.col("sensitivity"), F.col("pii_type")
    strategy = F.lit(None).cast("string")
    if masked:
        strategy = F.try_element_at(F.create_map(*[F.lit(x) for kv in masked.items() for x in kv]), name)
    sensitive = level != "PUBLIC"
    label = F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
    status = F.concat(label, F.lit(" — "), level, F.lit(": "), kind, F.lit(". "))
    extra_tag = F.when((kind != "none") & ~F.array_contains(F.split(_lookup(level, SENSITIVITY_TAGS), ","), kind),
                       F.replace(kind, F.lit("_"), F.lit("")))
    rows = scan.join(profile.select("column_name", "null_pct"), "column_name").withColumn("strategy", strategy)
    return rows.select(
        "column_name", "sensitivity", "pii_type",
        F.when(F.col("strategy").isNotNull(),
               F.concat(status, F.lit("Masked by ETL pipeline ("), F.col("strategy"), F.lit(").")))
        .when(sensitive, F.concat(status, F.lit("UNMASKED — review required before production.")))
        .otherwise(label).alias("description"),
        F.coalesce(F.concat(F.lit("masked_"), F.col("strategy")), F.lit("unmasked")).alias("masking_status"),
        _lookup(kind, REGULATION_MAP).alias("regulations"),
        F.concat_ws(",", extra_tag, F.nullif(_lookup(level, SENSITIVITY_TAGS), F.lit(""))).alias("tags"),
        sensitive.alias("review_required"),
        F.when(sensitive & F.col("strategy").isNotNull(), "APPROVED — masking applied")
        .when(sensitive, "PENDING — decide: mask | pseudonymize | document lawful basis")
        .alias("review_action"),
        (F.when(name == primary_key, "unique,not_null") if primary_key else F.when(F.lit(False), ""))
        .when(F.col("null_pct") == 0, "not_null").otherwise("").alias("tests"),
    )
