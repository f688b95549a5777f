"""Access-policy catalog: compiled from model metadata, then applied to SQL
text, requests, schemas and tables.

Two inputs: ``nodes`` (one row per model, metadata as map<string,string>) and
``node_columns`` (one row per model column, likewise). Joins against the
catalog carry no broadcast hint: the planner broadcasts it while it measures
small, and adaptive skew handling splits a model that most rows refer to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceworks.functions import sqltext
from traceworks.functions.redact import mask_hash, partial_mask
from traceworks.operators.textmatch import names_in_texts

# The words each setting accepts, with what stands in for others.
MODEL_ENUMS = {
    "ai_access_level": (["deny", "internal", "restricted", "approved"], "deny"),
    "sensitivity_level": (["public", "internal", "confidential", "restricted"], "confidential"),
    "risk_tier": (["low", "medium", "high", "critical"], "high"),
    "default_answer_mode": (["full", "masked", "aggregate_only", "deny", "metadata_only"], "deny"),
    "export_policy": (["allow", "deny", "approval_required"], "deny"),
    "retrieval_policy": (["allow", "limited", "deny"], "deny"),
    "summarization_policy": (["allow", "masked_only", "aggregate_only", "deny"], "deny"),
    "explanation_policy": (["allow", "safe_only", "deny"], "safe_only"),
    "rag_exposure": (["allow", "metadata_only", "deny"], "deny"),
    "agent_action_policy": (["allow", "approval_required", "deny"], "deny"),
}
COLUMN_ENUMS = {
    "pii": (["none", "direct", "indirect", "quasi_identifier"], "none"),
    "security_class": (["public", "internal", "confidential", "restricted"], "internal"),
    "masking_rule": (["none", "redact", "partial_mask", "hash", "tokenise"], "none"),
    "answer_mode": (["full", "masked", "aggregate_only", "deny", "metadata_only"], "deny"),
}
MODEL_LISTS = ["allowed_actions", "disallowed_actions", "approved_personas", "approved_workspaces",
               "approved_tenants", "allowed_join_domains", "blocked_join_domains",
               "allowed_datasource_modes", "approved_ai_use_cases", "blocked_ai_use_cases"]
MODEL_TEXTS = ["compliance_domain", "owner_team", "business_owner", "steward", "retention_class"]

# Description words that mark personal data, in order.
DIRECT_SIGNALS = ["pii", "personally identifiable", "email", "ssn", "passport", "phone", "credit card",
                  "social security", "date of birth"]
INDIRECT_SIGNALS = ["dob", "postcode", "zip", "ip address", "location"]


# Lenient reading of metadata values -----------------------------------------
def setting(key: str, meta: str = "meta") -> Column:
    return F.try_element_at(F.col(meta), F.lit(key))


def coerced(value: Column, allowed: list[str], default: Column | str) -> Column:
    """Lower-cased value when it is an accepted word, else the default."""
    word = F.lower(value)
    fallback = F.lit(default) if isinstance(default, str) else default
    return F.when(word.isin(allowed), word).otherwise(fallback)


def as_flag(value: Column, default: Column | bool) -> Column:
    fallback = F.lit(default) if isinstance(default, bool) else default
    return F.when(value.isNull(), fallback).otherwise(F.lower(value).isin("true", "yes", "1"))


def as_list(value: Column) -> Column:
    """JSON array text or one bare word as a list; NULL and '' as an empty one."""
    return (
        F.when(F.coalesce(value, F.lit("")) == "", F.array().cast("array<string>"))
        .when(value.startswith("["), F.from_json(value, "array<string>"))
        .otherwise(F.array(value)))


def as_text(value: Column, default: str = "") -> Column:
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(default))


def merged_meta(meta: Column, namespace: str = "governance") -> Column:
    """Settings of the namespaced block, with flat keys where it is silent."""
    block = F.coalesce(F.from_json(F.try_element_at(meta, F.lit(namespace)), "map<string,string>"),
                       F.create_map().cast("map<string,string>"))
    flat = F.map_filter(F.coalesce(meta, F.create_map().cast("map<string,string>")),
                        lambda k, _: (k != namespace) & ~F.map_contains_key(block, k))
    return F.map_concat(block, flat)


def pii_class_of(description: Column) -> Column:
    text = F.lower(description)

    def mentions(words: list[str]) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        return hit

    return (F.when(mentions(DIRECT_SIGNALS), "direct").when(mentions(INDIRECT_SIGNALS), "indirect")
            .otherwise("none"))


# Manifest -------------------------------------------------------------------
MANIFEST_SCHEMA = """nodes map<string, struct<name: string, unique_id: string, resource_type: string,
  `schema`: string, `database`: string, description: string, `access`: string, tags: array<string>,
  `group`: string, meta: map<string, string>,
  columns: map<string, struct<description: string, meta: map<string, string>>>>>"""


def manifest_nodes(manifest: DataFrame) -> DataFrame:
    """One row per model of a manifest read with ``MANIFEST_SCHEMA``."""
    return manifest.select(F.explode("nodes").alias("id", "n")).where("n.name <> ''").select(
        F.col("n.name").alias("model_name"), "n.unique_id", "n.resource_type", "n.schema", "n.database",
        "n.description", "n.access", "n.tags", "n.group", "n.meta", "n.columns")


def manifest_columns(nodes: DataFrame) -> DataFrame:
    return nodes.select("model_name", F.explode("columns").alias("column_name", "c")).select(
        "model_name", "column_name", "c.description", "c.meta")


def compile_models(nodes: DataFrame, version: str = "") -> DataFrame:
    """Model policies with inherited and safe default settings."""
    meta_in = nodes.withColumn("meta", merged_meta(F.col("meta")))
    text = F.lower(F.coalesce("description", F.lit("")))
    private = F.coalesce(F.col("access") == "private", F.lit(False))
    level = coerced(setting("ai_access_level"), *MODEL_ENUMS["ai_access_level"])
    base = meta_in.withColumns({
        "access": as_text(F.col("access")),
        "description": as_text(F.col("description")),
        "ai_access_level": F.when(private, "deny").otherwise(level),
        "ai_enabled": ~private & (as_flag(setting("ai_enabled"), False) | (level != "deny")),
        "certified_for_ai": as_flag(setting("certified_for_ai"), False),
        "contains_pii": as_flag(setting("contains_pii"), text.contains("pii")),
        "contains_phi": as_flag(setting("contains_phi"),
                                text.contains("phi") | text.contains("protected health")),
        **{name: as_list(setting(name)) for name in MODEL_LISTS},
        **{name: as_text(setting(name)) for name in MODEL_TEXTS},
        "tool_use_policy": as_text(setting("tool_use_policy"), "deny"),
        "policy_version": F.lit(version),
    })
    on, sensitive = F.col("ai_enabled"), F.col("contains_pii") | F.col("contains_phi")
    defaults = {
        "retrieval_policy": F.when(~on, "deny").when(sensitive, "limited").otherwise("allow"),
        "summarization_policy": F.when(~on, "deny").when(sensitive, "masked_only").otherwise("allow"),
    }
    enums = {
        name: coerced(setting(name), words, defaults.get(name, default))
        for name, (words, default) in MODEL_ENUMS.items()
        if name not in ("ai_access_level", "default_answer_mode")}
    answer = coerced(setting("default_answer_mode"), MODEL_ENUMS["default_answer_mode"][0],
                     F.when(F.col("contains_pii"), "masked").otherwise("full"))
    return base.withColumns({
        **enums,
        "default_answer_mode": F.when(~on | (F.col("ai_access_level") == "deny"), "deny").otherwise(answer),
        "safe_description": F.coalesce(F.nullif(as_text(setting("safe_description")), F.lit("")),
                                       F.col("description")),
        "eligible": on & (F.col("ai_access_level") != "deny") & (F.col("access") != "private"),
    }).drop("meta", "columns")


OPEN_FLAGS = ["ai_filterable", "ai_groupable", "ai_sortable", "allowed_in_where", "allowed_in_group_by",
              "allowed_in_order_by", "allowed_in_explanation"]


def compile_columns(node_columns: DataFrame, models: DataFrame) -> DataFrame:
    """Column policies; columns of an ineligible model are closed."""
    parent = models.select(
        "model_name", F.col("eligible").alias("_open"), F.col("ai_access_level").alias("_level"),
        F.col("sensitivity_level").alias("_sensitivity"))
    c = node_columns.join(parent, "model_name").withColumn("meta", merged_meta(F.col("meta")))
    is_open = F.col("_open")
    c = c.withColumns({
        "description": as_text(F.col("description")),
        "pii": F.when(~is_open, "none").when(
            setting("pii").isNotNull(), coerced(setting("pii"), *COLUMN_ENUMS["pii"])
        ).otherwise(pii_class_of(F.coalesce("description", F.lit("")))),
        "phi": is_open & as_flag(setting("phi"), False),
    })
    pii, phi = F.col("pii"), F.col("phi")
    c = c.withColumn("ai_exposed", is_open & as_flag(
        setting("ai_exposed"), (F.col("_level") == "approved") & (pii == "none") & ~phi))
    exposed = F.col("ai_exposed")
    inherited = F.when(F.col("_sensitivity").isin("public", "internal"), F.col("_sensitivity")).otherwise("confidential")
    c = c.withColumns({
        "ai_selectable": is_open & as_flag(setting("ai_selectable"), exposed),
        "security_class": F.when(~is_open, "internal").otherwise(
            coerced(setting("security_class"), COLUMN_ENUMS["security_class"][0], inherited)),
        "masking_rule": F.when(~is_open, "none").otherwise(coerced(
            setting("masking_rule"), COLUMN_ENUMS["masking_rule"][0],
            F.when(pii.isin("direct", "indirect") | phi, "redact").otherwise("none"))),
        **{f: ~is_open | as_flag(setting(f), True) for f in OPEN_FLAGS},
        "allowed_in_retrieval": is_open & as_flag(setting("allowed_in_retrieval"), exposed),
        "allowed_in_summary": is_open & as_flag(setting("allowed_in_summary"), exposed & (pii == "none")),
        "allowed_in_export": is_open & as_flag(setting("allowed_in_export"), False),
        "export_allowed": is_open & as_flag(setting("export_allowed"), False),
        "semantic_aliases": F.when(is_open, as_list(setting("semantic_aliases")))
        .otherwise(F.array().cast("array<string>")),
        "business_term": F.when(is_open, as_text(setting("business_term"))).otherwise(""),
        "notes_for_ai": F.when(is_open, as_text(setting("notes_for_ai"))).otherwise(""),
        "join_sensitivity": F.when(is_open, as_text(setting("join_sensitivity"), "medium")).otherwise("medium"),
    })
    selectable, rule = F.col("ai_selectable"), F.col("masking_rule")
    strict = phi | (pii == "direct")
    answer_default = (F.when(strict, F.when(rule != "none", "masked").otherwise("deny"))
                      .when(~exposed, "deny").otherwise("full"))
    c = c.withColumns({
        "answer_mode": F.when(~is_open, "deny").otherwise(
            coerced(setting("answer_mode"), COLUMN_ENUMS["answer_mode"][0], answer_default)),
        "allowed_in_output": is_open & as_flag(
            setting("allowed_in_output"), exposed & selectable & (pii == "none") & ~phi),
    })
    in_output = F.col("allowed_in_output")
    return c.withColumn(
        "output_safe",
        F.when(phi, False).when(pii.isin("direct", "indirect"), (rule != "none") & in_output)
        .otherwise(exposed & selectable & in_output),
    ).drop("meta", "_open", "_level", "_sensitivity")


# Eligibility ----------------------------------------------------------------
def _unrestricted_or_has(col: str, value: str) -> Column:
    return (F.size(col) == 0) | F.array_contains(col, value)


def eligible_models(models: DataFrame, use_case: str = "", workspace: str = "", tenant: str = "") -> DataFrame:
    out = models.where("eligible")
    if workspace:
        out = out.where(_unrestricted_or_has("approved_workspaces", workspace))
    if tenant:
        out = out.where(_unrestricted_or_has("approved_tenants", tenant))
    if use_case:
        out = out.where(~F.array_contains("blocked_ai_use_cases", use_case))
    return out


def eligible_columns(columns: DataFrame, models: DataFrame, output_only: bool = False) -> DataFrame:
    """Exposed columns of eligible models, or the output-safe ones among them."""
    out = columns.where("ai_exposed").join(models.where("eligible").select("model_name"), "model_name", "left_semi")
    return out.where("output_safe") if output_only else out


def allowed_actions(models: DataFrame) -> DataFrame:
    return models.where("eligible").select(
        "model_name", F.array_except("allowed_actions", "disallowed_actions").alias("actions"))


def blocked_models(models: DataFrame) -> DataFrame:
    return models.where(~F.col("eligible")).select(
        "model_name", "ai_enabled", "ai_access_level",
        F.when(F.col("access") == "private", "access=private").when(~F.col("ai_enabled"), "ai_enabled=false")
        .otherwise(F.concat(F.lit("ai_access_level="), F.col("ai_access_level"))).alias("reason"))


def restricted_columns(columns: DataFrame) -> DataFrame:
    hit = (F.col("pii") != "none") | F.col("phi") | ~F.col("output_safe")
    return columns.where(hit).select("model_name", "column_name", "pii", "phi", "masking_rule", "answer_mode")


def catalog_summary(models: DataFrame, columns: DataFrame) -> DataFrame:
    """Counts over both tables in one row, without a join."""
    tagged = models.select("eligible", "certified_for_ai", F.lit(True).alias("m")).unionByName(
        columns.select(((F.col("pii") != "none") | F.col("phi")).alias("personal"), "output_safe",
                       F.lit(False).alias("m")), allowMissingColumns=True)
    return tagged.agg(
        F.count_if("m").alias("total_models"),
        F.count_if("eligible").alias("ai_eligible_models"),
        F.count_if(F.expr("eligible and certified_for_ai")).alias("certified_models"),
        F.count_if(F.expr("m and not eligible")).alias("denied_models"),
        F.count_if(F.expr("not m")).alias("total_columns"),
        F.count_if("personal").alias("pii_or_phi_columns"),
        F.count_if("output_safe").alias("output_safe_columns"),
        F.count_if(F.expr("not output_safe")).alias("blocked_columns"))


def _reasons(*arms: Column) -> Column:
    return F.filter(F.array(*arms), lambda r: r.isNotNull())


def explain_models(models: DataFrame, use_case: str = "") -> DataFrame:
    """Why each model is allowed or not, and the answer mode it ends up with."""
    blocked = F.array_contains("blocked_ai_use_cases", use_case) if use_case else F.lit(False)
    why = _reasons(
        F.when(~F.col("ai_enabled"), "ai_enabled is false — model excluded from AI context"),
        F.when(F.col("ai_access_level") == "deny", "ai_access_level is deny"),
        F.when(F.col("access") == "private", "dbt access is private — hard deny"),
        F.when(blocked, f"use case '{use_case}' is in blocked_ai_use_cases"))
    fine = F.array(F.concat(F.lit("Model is AI-eligible (access_level="), F.col("ai_access_level"), F.lit(")")))
    return models.select(
        "model_name", F.col("eligible").alias("allowed"),
        F.when(~F.col("eligible") | blocked, "deny").otherwise(F.col("default_answer_mode")).alias("answer_mode"),
        (F.col("certified_for_ai") & F.col("eligible")).alias("certified"),
        F.when((F.size(why) == 0) & F.col("eligible"), fine).otherwise(why).alias("reasons"))


def explain_columns(columns: DataFrame, models: DataFrame) -> DataFrame:
    parent = models.select("model_name", F.col("eligible").alias("_open"))
    c = columns.join(parent, "model_name")
    why = _reasons(
        F.when(~F.col("_open"), "Parent model is not AI-eligible"),
        F.when(F.col("phi"), "Column contains PHI — restricted by default"),
        F.when(F.col("pii") != "none", F.concat(F.lit("Column PII class: "), F.col("pii"))),
        F.when(~F.col("ai_exposed"), "ai_exposed is false"),
        F.when(~F.col("allowed_in_output"), "allowed_in_output is false"),
        F.when(F.col("masking_rule") != "none",
               F.concat(F.lit("Masking rule applied: "), F.col("masking_rule"))))
    strict_open = (F.col("phi") | (F.col("pii") == "direct")) & (F.col("masking_rule") == "none")
    return c.select(
        "model_name", "column_name", F.col("output_safe").alias("allowed"),
        F.when(strict_open | ~F.col("ai_exposed") | ~F.col("ai_selectable"), "deny")
        .otherwise(F.col("answer_mode")).alias("answer_mode"),
        F.when(F.size(why) == 0, F.array(F.lit("Column is AI-output-safe"))).otherwise(why).alias("reasons"))


# Checks ---------------------------------------------------------------------
def access_code(use_case: str = "use_case", workspace: str = "workspace_id", tenant: str = "tenant_id") -> Column:
    """First rule a joined model row breaks for the request beside it, or NULL."""
    def outside(allowed: str, value: str) -> Column:
        given = F.coalesce(F.col(value), F.lit("")) != ""
        return given & (F.size(allowed) > 0) & ~F.array_contains(F.col(allowed), F.col(value))

    return (
        F.when(~F.col("eligible"), "MODEL_DENIED")
        .when(outside("approved_workspaces", workspace), "WORKSPACE_DENIED")
        .when(outside("approved_tenants", tenant), "TENANT_DENIED")
        .when(F.array_contains(F.col("blocked_ai_use_cases"), F.col(use_case)), "USE_CASE_DENIED"))


_RULES = ["eligible", "approved_workspaces", "approved_tenants", "blocked_ai_use_cases"]


def column_code() -> Column:
    """Output rule a joined column row breaks, or NULL."""
    return (F.when(F.col("phi"), "PHI_OUTPUT_DENIED")
            .when((F.col("pii") == "direct") & ~F.col("output_safe"), "PII_OUTPUT_DENIED")
            .when(~F.col("allowed_in_output"), "COLUMN_OUTPUT_DENIED"))


def _keyed(models: DataFrame, *columns: str) -> DataFrame:
    return models.select(F.lower("model_name").alias("table_name"), *columns)


def audit_sql(statements: DataFrame, models: DataFrame, columns: DataFrame, strict: bool = False) -> DataFrame:
    """Verdict per statement: allowed, violations, blocked models and columns, answer mode.

    ``statements`` has a unique ``statement_id``, ``sql_text``, ``use_case``,
    ``workspace_id`` and ``tenant_id``. Parsing happens once per statement;
    the rows exploded from a statement are its tables and columns, folded back
    under the same key, so both steps share one shuffle of the statements.
    ``strict`` also looks for closed columns behind aliases.
    """
    sql = F.col("sql_text")
    names = sqltext.selected_expressions(sql) if strict else sqltext.selected_columns(sql)
    parsed = statements.select(
        "statement_id", "use_case", "workspace_id", "tenant_id",
        sqltext.dangerous_verbs(sql).alias("verbs"), sqltext.referenced_tables(sql).alias("tables"),
        F.array_contains(sqltext.selected_columns(sql), "*").alias("star"), names.alias("outputs"))

    # One row per (statement, table) with its model, folded back per statement.
    touched = parsed.withColumn(
        "table_name", F.explode_outer(F.when(F.size("verbs") == 0, F.col("tables")))).drop("tables")
    judged = touched.join(_keyed(models, "default_answer_mode", *_RULES), "table_name", "left").withColumns({
        "rule": F.when(F.col("table_name").isNull(), None).when(F.col("eligible").isNull(), "UNKNOWN_MODEL")
        .otherwise(access_code()),
        "agg": F.coalesce(F.col("default_answer_mode") == "aggregate_only", F.lit(False))})
    open_agg = F.col("agg") & F.col("rule").isNull()

    def listed(when: Column, value: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(when, value)))

    name, rule = F.col("table_name"), F.col("rule")
    folded = judged.groupBy("statement_id").agg(
        *[F.any_value(c).alias(c) for c in ("verbs", "outputs", "star")],
        listed(rule.isNotNull(), F.concat_ws(":", "rule", "table_name")).alias("model_findings"),
        listed(rule != "UNKNOWN_MODEL", name).alias("blocked_models"),
        listed(open_agg & F.col("star"), F.concat(F.lit("AGGREGATE_ONLY_VIOLATION:"), name)).alias("star_findings"),
        listed(F.col("eligible"), name).alias("known"),
        F.bool_or(open_agg).alias("agg"))

    # One row per (known table, output column) of statements still to be judged.
    outputs = F.col("outputs")
    if strict:
        words = F.transform(outputs, lambda o: F.regexp_extract_all(o, F.lit(r"(\w+)"), F.lit(1)))
        outputs = F.array_distinct(F.flatten(words))
    pairs = F.flatten(F.transform("known", lambda t: F.transform(
        outputs, lambda o: F.struct(t.alias("table_name"), o.alias("column_name")))))
    undecided = (F.size("blocked_models") == 0) & ~F.col("star")
    columns_hit = (
        folded.withColumn("p", F.explode_outer(F.when(undecided, pairs)))
        .select("*", "p.table_name", "p.column_name").drop("p", "known", "outputs", "star")
        .join(_keyed(columns, "column_name", "phi", "pii", "output_safe", "allowed_in_output"),
              ["table_name", "column_name"], "left")
        .withColumn("rule", column_code()))
    full_name = F.concat_ws(".", "table_name", "column_name")
    kept = ["verbs", "model_findings", "blocked_models", "star_findings", "agg"]
    verdict = columns_hit.groupBy("statement_id").agg(
        *[F.any_value(c).alias(c) for c in kept],
        listed(rule.isNotNull(), F.concat(rule, F.lit(":"), full_name)).alias("column_findings"),
        listed(rule.isNotNull(), full_name).alias("blocked_columns"))

    none = F.array().cast("array<string>")
    verb_findings = F.transform("verbs", lambda v: F.concat(F.lit("DANGEROUS_SQL:"), v))
    star_findings = F.when(F.size("blocked_models") > 0, none).otherwise(F.col("star_findings"))
    early = (F.size("verbs") > 0) | (F.size("blocked_models") > 0)
    denied = early | (F.size(star_findings) > 0) | (F.size("column_findings") > 0)
    return verdict.select(
        "statement_id", (~denied).alias("allowed"),
        F.concat(verb_findings, "model_findings", star_findings, "column_findings").alias("violations"),
        "blocked_models", "blocked_columns",
        F.when(early, "full").when(denied, "deny").when(F.col("agg"), "aggregate_only").otherwise("full")
        .alias("answer_mode"))


EXPORT_WORDS = ["export", "download", "write", "send"]

# Which check a use case goes through.
CHECK_OF_USE_CASE = {
    "summarization": "summary", "summary": "summary", "narrative_insight": "summary",
    "rag": "retrieval", "retrieval": "retrieval", "rag_retrieval": "retrieval",
    "export": "export", "explanation": "explain", "explain": "explain", "agent_tool": "tool",
}


def check_requests(requests: DataFrame, models: DataFrame) -> DataFrame:
    """Verdict per request: ``request_id`` (unique), ``use_case``, ``workspace_id``,
    ``tenant_id``, ``tool_name`` and ``model_names`` (the models it touches)."""
    pairs = [F.lit(x) for kv in CHECK_OF_USE_CASE.items() for x in kv]
    check = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("use_case")), F.lit("generic"))
    # Retrieval is judged on its first model only.
    touched = F.when(F.col("check") == "retrieval", F.slice("model_names", 1, 1)).otherwise(F.col("model_names"))
    rows = requests.withColumn("check", check).withColumn("name", F.explode_outer(touched)).withColumn(
        "table_name", F.lower("name"))
    rows = rows.join(_keyed(models, "summarization_policy", "retrieval_policy", "rag_exposure",
                            "explanation_policy", "agent_action_policy", "export_policy", *_RULES),
                     "table_name", "left")

    def on(name: str) -> Column:
        return F.col("check") == name

    exporting = F.lit(False)
    for word in EXPORT_WORDS:
        exporting = exporting | F.lower(F.coalesce("tool_name", F.lit(""))).contains(word)
    export_denied = F.col("export_policy") == "deny"
    rule = F.coalesce(
        access_code(),
        F.when(on("summary") & (F.col("summarization_policy") == "deny"), "SUMMARIZATION_DENIED")
        .when(on("retrieval") & (F.col("rag_exposure") == "deny"), "RAG_DENIED")
        .when(on("retrieval") & (F.col("retrieval_policy") == "deny"), "RETRIEVAL_DENIED")
        .when(on("explain") & (F.col("explanation_policy") == "deny"), "EXPLANATION_DENIED")
        .when(on("export") & export_denied, "EXPORT_DENIED")
        .when(on("tool") & (F.col("agent_action_policy") == "deny"), "AGENT_ACTION_DENIED")
        .when(on("tool") & (F.col("agent_action_policy") == "approval_required"), "AGENT_ACTION_APPROVAL_REQUIRED"))
    extra = F.when(on("tool") & exporting & export_denied & access_code().isNull(), "EXPORT_DENIED")
    mode = (
        F.when(on("summary") & (F.col("summarization_policy") == "aggregate_only"), 2)
        .when(on("summary") & (F.col("summarization_policy") == "masked_only"), 1)
        .when(on("retrieval") & (F.col("rag_exposure") == "metadata_only"), 3).otherwise(0))
    known = F.col("eligible").isNotNull()
    judged = rows.select(
        "request_id", "name",
        F.when(known, rule).alias("rule"), F.when(known, extra).alias("extra"),
        F.when(known & access_code().isNull(), mode).otherwise(0).alias("mode"),
        (~known & F.col("name").isNotNull() & on("retrieval")).alias("unknown_source"))

    def finding(code: str) -> Column:
        return F.collect_list(F.when(F.col(code).isNotNull(), F.concat_ws(":", code, "name")))

    grouped = judged.groupBy("request_id").agg(
        F.sort_array(F.concat(finding("rule"), finding("extra"))).alias("violations"),
        F.sort_array(F.collect_list(F.when(F.col("unknown_source"), F.concat(F.lit("UNKNOWN_SOURCE:"), F.col("name")))))
        .alias("notes"),
        F.max("mode").alias("mode"))
    modes = F.array(*map(F.lit, ["full", "masked", "aggregate_only", "metadata_only"]))
    allowed = F.size("violations") == 0
    return grouped.select(
        "request_id", allowed.alias("allowed"), F.concat("violations", "notes").alias("violations"),
        F.when(~allowed, "deny").otherwise(F.element_at(modes, F.col("mode") + 1)).alias("answer_mode"))


def user_message(allowed: Column, answer_mode: Column, violations: Column) -> Column:
    """What the caller is told; at most the first three reasons."""
    return (
        F.when(allowed & (answer_mode == "aggregate_only"),
               "I can answer this, but only in aggregate form due to data governance policy.")
        .when(allowed & (answer_mode == "masked"),
              "I can answer this, but some sensitive fields will be masked.")
        .when(allowed, "Request is allowed by data governance policy.")
        .when(F.size(violations) == 0, "This request was blocked by data governance policy.")
        .otherwise(F.concat(F.lit("This request was blocked by data governance policy. Reason: "),
                            F.array_join(F.slice(violations, 1, 3), "; "))))


def models_in_text(requests: DataFrame, text: str, models: DataFrame) -> DataFrame:
    """(request_id, model_name) for every model whose name occurs in the text."""
    kind = requests.schema["request_id"].dataType
    hits = names_in_texts(requests, "request_id", text, models, "model_name")
    return hits.select(F.col("text_id").cast(kind).alias("request_id"), F.col("name").alias("model_name"))


def safe_schema(schema: DataFrame, models: DataFrame, columns: DataFrame, use_case: str = "",
                workspace: str = "", tenant: str = "") -> DataFrame:
    """Schema rows (table_name, column_name, type, description) a caller may see, with notes.

    Ineligible tables and unexposed columns are left out; unknown tables stay
    as one row without columns.
    """
    model = models.select(
        F.col("model_name").alias("table_name"), "eligible", "default_answer_mode", "contains_pii",
        "certified_for_ai", F.coalesce(F.nullif("safe_description", F.lit("")), F.col("description")).alias("about"),
        *_RULES[1:])
    col = columns.select(
        F.col("model_name").alias("table_name"), "column_name", "ai_exposed", "pii", "phi", "masking_rule",
        "allowed_in_output", F.col("description").alias("column_about"))
    rows = schema.join(model, "table_name", "left")
    unknown = F.col("eligible").isNull()
    allowed = F.col("eligible")
    if workspace:
        allowed = allowed & _unrestricted_or_has("approved_workspaces", workspace)
    if tenant:
        allowed = allowed & _unrestricted_or_has("approved_tenants", tenant)
    if use_case:
        allowed = allowed & ~F.array_contains("blocked_ai_use_cases", use_case)
    rows = rows.where(unknown | allowed).join(col, ["table_name", "column_name"], "left")

    note = (F.when(F.col("phi"), "[PHI field — must not appear in output]")
            .when((F.col("pii") != "none") & (F.col("masking_rule") != "none"),
                  F.concat(F.lit("[PII field — masking rule: "), F.col("masking_rule"),
                           F.lit(". Do not expose raw values in output]")))
            .when(F.col("pii") != "none",
                  "[PII field — use in filters/grouping only, do not select for output]"))
    if use_case in ("text2sql", "sql_generation"):
        note = F.coalesce(note, F.when(~F.col("allowed_in_output"), F.concat(
            F.lit("[Allowed in WHERE/GROUP BY only — do not SELECT '"), F.col("column_name"), F.lit("' in output]"))))
    table_note = (F.when(unknown, "[Not in AI policy catalog — warehouse access controls apply]")
                  .when(F.col("default_answer_mode") == "aggregate_only",
                        "[Aggregate-only: do not generate row-level output from this table]")
                  .when(F.col("contains_pii"), "[Contains PII: sensitive fields have been masked or excluded]"))
    shown = rows.where(unknown | F.col("ai_exposed").isNull() | F.col("ai_exposed"))
    listed = shown.where(~unknown).select(
        "table_name", "column_name", "type",
        F.coalesce(F.nullif("column_about", F.lit("")), F.col("description")).alias("description"),
        F.when(F.col("ai_exposed").isNull(), "[Not in column policy catalog]").otherwise(note).alias("ai_note"),
        table_note.alias("table_note"))
    bare = shown.where(unknown).select(
        "table_name", F.lit(None).cast("string").alias("column_name"), F.lit(None).cast("string").alias("type"),
        F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("ai_note"),
        table_note.alias("table_note")).distinct()
    directive = listed.where(F.col("table_note").startswith("[Aggregate-only")).select("table_name", "table_note").distinct().select(
        "table_name", F.lit("__aggregate_only__").alias("column_name"), F.lit("directive").alias("type"),
        F.lit("This table may only be queried with aggregate functions (COUNT, SUM, AVG, MIN, MAX). "
              "Do not generate row-level SELECT queries.").alias("description"),
        F.lit(None).cast("string").alias("ai_note"), "table_note")
    return listed.unionByName(bare).unionByName(directive)


def schema_summary(safe: DataFrame) -> DataFrame:
    return safe.agg(
        F.count_distinct("table_name").alias("model_count"),
        F.count_if(F.col("column_name").isNotNull() & ~F.col("column_name").startswith("__")).alias("column_count"),
        F.count_if(F.col("column_name") == "__aggregate_only__").alias("aggregate_only_models"),
        F.count_if(F.coalesce(F.col("ai_note").startswith("[PII"), F.lit(False))).alias("pii_annotated_columns"))


# Governed reads -------------------------------------------------------------
class PolicyDenied(Exception):
    """The policy gives no access to this table."""


def masked_value(col: str, rule: str) -> Column:
    value = F.col(col)
    if rule == "redact":
        return F.lit("[REDACTED]")
    if rule == "hash":
        return mask_hash(value)
    if rule == "partial_mask":
        return partial_mask(value)
    return value


def governed_read(df: DataFrame, answer_mode: str, column_policies: list[dict]) -> DataFrame:
    """A table as its policy lets it be seen.

    ``column_policies`` are the policy rows of this one table, so the list is
    as long as its column list. Closed columns are dropped, masked ones
    masked; tokens come from :func:`tokenise`.
    """
    if answer_mode in ("deny", "aggregate_only"):
        raise PolicyDenied(f"answer mode is {answer_mode}")
    if answer_mode == "metadata_only":
        return df.limit(0)
    shown = [p for p in column_policies if p["output_safe"] and p["column_name"] in df.columns]
    return df.select(*[masked_value(p["column_name"], p["masking_rule"]).alias(p["column_name"]) for p in shown])


def governed_aggregate(df: DataFrame, keys: list[str], aggregates: list[Column],
                       column_policies: list[dict]) -> DataFrame:
    """The only way into an aggregate_only table: grouped results over open keys."""
    open_keys = {p["column_name"] for p in column_policies if p["ai_groupable"]}
    closed = [k for k in keys if k not in open_keys]
    if closed or not aggregates:
        raise PolicyDenied(f"not groupable: {closed}")
    return df.groupBy(*keys).agg(*aggregates)


def tokenise(df: DataFrame, column: str, tokens: DataFrame) -> DataFrame:
    """Values replaced by their tokens; ``tokens`` maps each distinct value once."""
    keyed = tokens.select(F.col("value").alias(column), "token")
    return df.join(keyed, column, "left").drop(column).withColumnRenamed("token", column)
