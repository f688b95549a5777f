"""Ledger, audit-log, price-bar and knowledge-base inputs derived from the
given star-schema tables.

Each derivation is a list of ``(column, expression)`` whose text runs
unchanged in Spark SQL and in the check engine, so the two sides read the
same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from traceworks.sources.tables import table

EVENT_TYPES = [
    "request_received", "session_started", "memory_retrieved", "rag_retrieved",
    "policy_check_started", "policy_check_passed", "policy_check_failed",
    "model_invoked", "tool_invoked", "agent_action", "agent_boundary_violation",
    "sql_generated", "sql_validated", "sql_blocked", "sql_executed",
    "document_extracted", "response_returned", "human_feedback_received",
    "action_replayed",
]


def _pick(selector: str, values: list[str | None]) -> str:
    """CASE over 0..n-1; ``None`` gives NULL."""
    arms = " ".join(
        f"when {i} then '{v}'" for i, v in enumerate(values) if v is not None
    )
    return f"case {selector} {arms} else null end"


def _id(prefix: str, expr: str) -> str:
    return f"concat('{prefix}', cast({expr} as varchar(20)))"


_DAY = "cast(cast(ts as date) as varchar(10))"

TRACE_EVENT_COLUMNS: list[tuple[str, str]] = [
    ("trace_id", _id("ev-", "event_id")),
    ("parent_trace_id",
     f"case when event_id % 5 = 0 then null else {_id('ev-', 'event_id - (event_id % 5)')} end"),
    ("tenant_id", f"case when event_id % 997 = 996 then null else {_id('tenant_', 'user_id % 4')} end"),
    ("workspace_id", _id("ws_", "user_id % 7")),
    ("user_id", _id("u", "user_id")),
    ("session_id", f"concat('s', cast(user_id as varchar(20)), '-', {_DAY})"),
    ("request_id",
     f"concat('r', cast(user_id as varchar(20)), '-', {_DAY}, '-', "
     "case when extract(hour from ts) < 12 then 'am' else 'pm' end)"),
    ("event_type", _pick("event_id % 19", EVENT_TYPES)),
    ("event_timestamp",
     "case when event_id % 499 = 498 then 'not-a-timestamp' else cast(ts as varchar(40)) end"),
    ("actor_type", _pick("event_id % 5", ["user", "assistant", "system", "tool", "agent"])),
    ("actor_id", _id("actor_", "event_id % 11")),
    ("datasource_type", _pick("event_id % 3", ["snowflake", "duckdb", None])),
    ("datasource_name", _pick("event_id % 3", ["warehouse_prod", "duckdb_etl", None])),
    ("model_name", _pick("event_id % 4", ["model_a", "model_b", "model_c", None])),
    ("tool_name", f"case when event_id % 19 = 8 then {_id('tool_', 'event_id % 6')} else null end"),
    ("agent_name",
     f"case when event_id % 19 in (9, 10) then {_id('agent_', 'event_id % 3')} else null end"),
    ("policy_result",
     "case event_id % 19 when 5 then 'PASSED' when 6 then 'BLOCKED' when 13 then 'BLOCKED' else null end"),
    ("question_text",
     "case when event_id % 19 = 0 then concat('question ', cast(event_id as varchar(20)), "
     "' password=hunter2abc', cast(event_id as varchar(20))) else null end"),
    ("sql_text",
     "case when event_id % 19 in (11, 12, 13, 14) then concat('SELECT o_custkey, sum(o_totalprice) "
     "AS total FROM orders WHERE o_custkey > ', cast(event_id % 17 as varchar(20)), ' GROUP BY 1') "
     "else null end"),
    ("sensitivity_level",
     "case event_id % 11 when 0 then 'CRITICAL' when 1 then 'HIGH' when 2 then 'MEDIUM' "
     "when 3 then 'MEDIUM' when 4 then null else 'LOW' end"),
    ("pii_detected", "case when event_id % 13 = 0 then true when event_id % 13 = 1 then null else false end"),
    ("pii_fields",
     "case when event_id % 13 = 0 then case when event_id % 2 = 0 then '[\"email\",\"ssn\"]' "
     "else '[\"phone\"]' end else null end"),
    ("ai_action_summary",
     f"case when event_id % 19 in (8, 9, 10) then {_id('action ', 'event_id')} else null end"),
    ("boundary_violated", "case when event_id % 19 = 10 then true else null end"),
    ("risk_flags",
     "case when event_id % 19 = 10 then '[\"DDL_ATTEMPT\",\"PII_SCHEMA_ACCESS\"]' else null end"),
    ("prompt_hash", "cast(null as varchar(64))"),
    ("context_refs",
     "case when event_id % 19 in (2, 3) then concat('[\"chunk_', cast(event_id % 50 as varchar(20)), "
     "'\",\"chunk_', cast(event_id % 31 as varchar(20)), '\"]') else null end"),
    ("status",
     "case event_id % 19 when 6 then 'blocked' when 13 then 'blocked' when 10 then 'violation' "
     "else case when event_id % 23 = 0 then 'failed' else 'ok' end end"),
    ("error_code", "case when event_id % 23 = 0 then 'E500' else null end"),
    ("error_message",
     "case event_id % 19 when 13 then 'DDL statements not allowed' when 6 then 'User does not have "
     "access to PII schema' else case when event_id % 23 = 0 then "
     "concat('failure class ', cast(event_id % 4 as varchar(20))) else null end end"),
    ("etl_run_id", f"case when event_id % 7 = 0 then {_id('run-', 'user_id % 9')} else null end"),
    ("input_summary", "cast(null as varchar(40))"),
    ("output_summary", "cast(null as varchar(40))"),
]


def _select(columns, source: str) -> str:
    body = ",\n  ".join(f"{expr} as {name}" for name, expr in columns)
    return f"select {body}\nfrom {source}"


def _derive(df: DataFrame, columns) -> DataFrame:
    return df.selectExpr(*[f"{expr} as {name}" for name, expr in columns])


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw ledger: strings everywhere but two flags, timestamps as text."""
    columns = TRACE_EVENT_COLUMNS + [("event_id", "event_id")]
    raw = _derive(table(spark, sf_dir, "events"), columns)
    return raw.selectExpr("* except (event_id)", "sha2(sql_text, 256) as sql_hash")


TRACE_EVENTS_SQL = (
    "select *, sha256(sql_text) as sql_hash from (\n" + _select(TRACE_EVENT_COLUMNS, "events") + ")"
)


# Audit tables -------------------------------------------------------------
# The tool names a pipeline step may carry.
TOOL_NAMES = [
    "ingest_file", "profile_table", "scan_pii", "mask_pii_columns", "write_audit_log",
    "generate_staging_sql", "tool_without_hint",
]

_RUN = _id("run-", "{} % 200")

STEP_COLUMNS = [
    ("step_id", "concat('st-', cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20)), "
                "'-', cast(l_partkey as varchar(20)), '-', cast(l_suppkey as varchar(20)), '-', "
                "cast(cast(floor(l_extendedprice * 100) as bigint) as varchar(20)))"),
    ("run_id", _RUN.format("l_orderkey")),
    ("sequence_num", "l_linenumber"),
    ("agent_name", _pick("l_linenumber % 3", ["ingest_agent", "compliance_agent", "quality_agent"])),
    ("tool_name", _pick("l_linenumber % 7", TOOL_NAMES)),
    ("success", "l_returnflag <> 'R'"),
    ("error_message", "case when l_returnflag = 'R' then concat('err-', l_linestatus) else null end"),
    ("duration_ms", "cast(l_quantity as bigint) * 250"),
    ("started_at", "cast(l_shipdate as varchar(40))"),
]

# One unknown model name on purpose: it must fall back to the default price.
LLM_MODELS = ["gpt-4-turbo", "gpt-4o", "gpt-4o-mini", "claude-3-haiku-20240307", "unpriced-model"]

LLM_CALL_COLUMNS = [
    ("call_id", _id("call-", "o_orderkey")),
    ("run_id", _RUN.format("o_orderkey")),
    ("agent_name", _pick("o_orderkey % 3", ["ingest_agent", "compliance_agent", "quality_agent"])),
    ("provider", "case when substring(o_orderpriority, 1, 1) = '4' then 'anthropic' else 'openai' end"),
    ("model", "case substring(o_orderpriority, 1, 1) "
              + " ".join(f"when '{i + 1}' then '{m}'" for i, m in enumerate(LLM_MODELS)) + " end"),
    ("prompt_tokens", "cast(o_custkey as int) + 100"),
    ("completion_tokens", "cast(o_custkey % 300 as int)"),
    ("latency_ms", "cast(floor(o_totalprice) as bigint) % 9000"),
    ("call_ts", "cast(o_orderdate as varchar(40))"),
]

RUN_COLUMNS = [
    ("run_id", _id("run-", "o_orderkey")),
    ("started_at", "cast(o_orderdate as varchar(40))"),
    ("duration_ms", "cast(floor(o_totalprice) as bigint)"),
    ("status", "case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'failed' end"),
    ("source_file", "concat('/raw/order-', cast(o_custkey as varchar(20)), '.csv')"),
    ("table_name", "concat('tbl_', cast(o_custkey % 50 as varchar(20)))"),
    ("row_count", "o_custkey"),
    ("llm_provider", "case when substring(o_orderpriority, 1, 1) = '4' then 'anthropic' else 'openai' end"),
    ("llm_model", "case substring(o_orderpriority, 1, 1) "
                  + " ".join(f"when '{i + 1}' then '{m}'" for i, m in enumerate(LLM_MODELS)) + " end"),
    ("compliance_status",
     _pick("o_custkey % 3", ["COMPLIANT", "NEEDS_REVIEW", "NON_COMPLIANT"])),
    ("pii_columns_count", "cast(o_custkey % 7 as int)"),
    ("masked_columns_count", "cast(o_custkey % 4 as int)"),
    ("total_steps", "cast(o_custkey % 12 as int)"),
    ("failed_steps", "cast(o_custkey % 2 as int)"),
    ("total_tokens", "cast(o_custkey as int) * 3"),
    ("estimated_cost_usd", "cast(o_custkey % 1000 as double) / 1000"),
    ("environment", _pick("o_custkey % 2", ["dev", "prod"])),
]

MUTATION_COLUMNS = [
    ("mutation_id", _id("mut-", "o_orderkey")),
    ("run_id", _RUN.format("o_orderkey")),
    ("table_name", "concat('tbl_', cast(o_custkey % 50 as varchar(20)))"),
    ("operation", _pick("o_orderkey % 3", ["CREATE", "MASK", "TRANSFORM"])),
    ("rows_before", "case when o_orderkey % 10 = 0 then null else o_custkey end"),
    ("rows_after", "o_custkey + (o_orderkey % 21) - 10"),
    ("agent_name", _pick("o_orderkey % 3", ["ingest_agent", "compliance_agent", "quality_agent"])),
    ("mutated_at", "cast(o_orderdate as varchar(40))"),
]

COMPLIANCE_EVENT_COLUMNS = [
    ("event_id", _id("ce-", "o_orderkey")),
    ("run_id", _RUN.format("o_orderkey")),
    ("event_type",
     _pick("o_orderkey % 5", ["PII_DETECTED", "PII_DETECTED", "MASKING_APPLIED",
                              "POLICY_VIOLATION", "PII_DETECTED"])),
    ("column_name", "concat('col_', cast(o_custkey % 23 as varchar(20)))"),
    ("sensitivity", _pick("o_custkey % 4", ["CONFIDENTIAL", "PII", "FINANCIAL", "INTERNAL"])),
    ("pii_type", _pick("o_custkey % 5", ["EMAIL", "SSN", "PHONE", "CREDIT_CARD", None])),
    ("action_taken", _pick("o_orderkey % 2", ["hash", "redact"])),
    ("event_ts", "cast(o_orderdate as varchar(40))"),
]

_AUDIT = {
    "steps": ("lineitem", STEP_COLUMNS),
    "llm_calls": ("orders", LLM_CALL_COLUMNS),
    "runs": ("orders", RUN_COLUMNS),
    "mutations": ("orders", MUTATION_COLUMNS),
    "compliance_events": ("orders", COMPLIANCE_EVENT_COLUMNS),
}


def audit_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = _AUDIT[name]
    return _derive(table(spark, sf_dir, source), columns)


def audit_sql(name: str) -> str:
    source, columns = _AUDIT[name]
    return _select(columns, source)


# Profiling input ------------------------------------------------------------
def _some_share(percent: int, value: str) -> str:
    """``value`` in exactly ``percent`` of every hundred rows."""
    return f"case when c_custkey % 100 < {percent} then {value} else 'plain text' end"


_N = "cast(c_custkey as varchar(20))"
_PAD4 = "lpad(cast(c_custkey % 10000 as varchar(20)), 4, '0')"

PEOPLE_COLUMNS = [
    ("c_custkey", "c_custkey"),
    ("c_name", "c_name"),
    ("email", f"concat('user', {_N}, '@mail.example.com')"),
    ("ssn", f"case when c_custkey % 50 = 0 then null else concat('123-45-', {_PAD4}) end"),
    ("card_number", f"concat('4111-1111-1111-', {_PAD4})"),
    ("salary", "c_acctbal"),
    ("zip", "concat('zip ', cast(c_nationkey as varchar(20)))"),
    ("notes", "case when c_custkey % 3 = 0 then null when c_custkey % 3 = 1 then '  ' else 'ok' end"),
    ("v_email", _some_share(10, f"concat('mail to u', {_N}, '@example.com now')")),
    ("v_email_low", _some_share(9, f"concat('mail to u', {_N}, '@example.com now')")),
    ("v_phone", _some_share(11, f"concat('call 555-123-', {_PAD4})")),
    ("v_ssn", _some_share(10, f"concat('id 123 45 ', {_PAD4})")),
    ("v_card", _some_share(10, f"concat('card 4111 1111 1111 ', {_PAD4})")),
    ("v_iban", _some_share(10, f"concat('DE44', {_PAD4}, 'ABCD')")),
    ("v_ip", _some_share(10, "concat('10.0.0.', cast(c_custkey % 250 as varchar(20)))")),
    ("v_passport", _some_share(10, f"concat('pass A12345', {_PAD4})")),
    ("segment", "c_mktsegment"),
]


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(table(spark, sf_dir, "customer"), PEOPLE_COLUMNS)


PEOPLE_SQL = _select(PEOPLE_COLUMNS, "customer")

# Cleaning input: repeated keys, bad dates and bad numbers.
RAW_ORDER_COLUMNS = [
    ("order_id", "o_orderkey - (o_orderkey % 3)"),
    ("position", "o_orderkey"),
    ("ordered_on", "case when o_orderkey % 41 = 0 then 'someday' else cast(o_orderdate as varchar(40)) end"),
    ("amount", "case when o_orderkey % 37 = 0 then 'n/a' else cast(o_custkey as varchar(40)) end"),
    ("customer", "case when o_orderkey % 29 = 0 then null else o_custkey end"),
]


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(table(spark, sf_dir, "orders"), RAW_ORDER_COLUMNS)


RAW_ORDERS_SQL = _select(RAW_ORDER_COLUMNS, "orders")


# Price bars ---------------------------------------------------------------

def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    return (
        table(spark, sf_dir, "orders")
        .groupBy(
            F.expr("concat('T', cast(o_custkey % 20 as varchar(20)))").alias("ticker"),
            F.expr("cast(o_orderdate as date)").alias("ts"),
        )
        .agg(
            F.min_by("o_totalprice", "o_orderkey").alias("open"),
            F.max("o_totalprice").alias("high"),
            F.min("o_totalprice").alias("low"),
            F.max_by("o_totalprice", "o_orderkey").alias("close"),
            F.sum("o_custkey").alias("volume"),
        )
        .select("ticker", F.lit("1d").alias("tf"), F.col("ts").cast("timestamp_ntz").alias("ts"),
                "open", "high", "low", "close", "volume")
    )


DAILY_BARS_SQL = """select concat('T', cast(o_custkey % 20 as varchar(20))) as ticker, '1d' as tf,
  cast(cast(o_orderdate as date) as timestamp) as ts,
  min_by(o_totalprice, o_orderkey) as open, max(o_totalprice) as high, min(o_totalprice) as low,
  max_by(o_totalprice, o_orderkey) as close, cast(sum(o_custkey) as bigint) as volume
from orders group by 1, 2, 3"""

INTRADAY = {"5m": 5, "30m": 30, "1h": 60}


def intraday_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5, 30 and 60 minute bars of ``events.value`` per event type, one scan."""
    from pyspark.sql import functions as F

    frames = F.explode(F.array(*[
        F.struct(F.lit(tf).alias("tf"), F.lit(m).alias("m")) for tf, m in INTRADAY.items()
    ])).alias("f")
    return (
        table(spark, sf_dir, "events")
        .select(F.col("event_type").alias("ticker"), "ts", "value", "event_id", frames)
        .withColumn("tf", F.col("f.tf"))
        .withColumn("ts", F.expr(
            "cast(timestamp_seconds(floor(unix_seconds(cast(ts as timestamp)) / (f.m * 60)) * f.m * 60)"
            " as timestamp_ntz)"))
        .groupBy("ticker", "tf", "ts")
        .agg(
            F.min_by("value", "event_id").alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", "event_id").alias("close"),
            F.count("*").alias("volume"),
        )
    )


INTRADAY_BARS_SQL = "\nunion all\n".join(
    f"""select event_type as ticker, '{tf}' as tf,
  make_timestamp(cast(floor(epoch(ts) / {m * 60}) * {m * 60} as bigint) * 1000000) as ts,
  min_by(value, event_id) as open, max(value) as high, min(value) as low,
  max_by(value, event_id) as close, count(*) as volume
from events group by 1, 2, 3""" for tf, m in INTRADAY.items())


# Knowledge base -------------------------------------------------------------
COLLECTIONS = ["documents", "pdfs", "images", "asx_announcements"]

KB_COLUMNS = [
    ("doc_id", "doc_id"),
    ("collection", _pick("doc_id % 4", COLLECTIONS)),
    ("filename", "concat('doc_', cast(doc_id as varchar(20)), '.txt')"),
    ("source_uri", "concat('s3://bucket/raw_data/doc_', cast(doc_id as varchar(20)), '.txt')"),
    ("text", "text"),
    ("vector", "embedding"),
]


def knowledge_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").join(
        table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id"
    )
    return _derive(joined, KB_COLUMNS)


KB_SQL = _select(KB_COLUMNS, "documents join embeddings on doc_id = vec_id")
