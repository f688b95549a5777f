"""Policy catalog, SQL audit, request checks, safe schemas, governed reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceworks.functions import sqltext
from traceworks.plans import policy
from traceworks.registry.base import query, table
from traceworks.registry.q_quality import hash_sql, lit
from traceworks.sources.sinks import scratch_path

# Catalog input: a model per supplier, a column per part. --------------------
_S = "s_suppkey"
MODEL_META = [
    ("ai_access_level", f"case {_S} % 6 when 0 then 'approved' when 1 then 'APPROVED' when 2 then 'restricted' "
                        "when 3 then 'internal' when 4 then 'deny' end"),
    ("ai_enabled", f"case {_S} % 5 when 0 then 'true' when 1 then 'no' end"),
    ("certified_for_ai", f"case when {_S} % 3 = 0 then 'yes' end"),
    ("default_answer_mode", f"case {_S} % 9 when 0 then 'aggregate_only' when 1 then 'bogus' when 2 then 'masked' end"),
    ("sensitivity_level", f"case {_S} % 4 when 0 then 'public' when 1 then 'internal' when 2 then 'weird' end"),
    ("contains_pii", f"case {_S} % 14 when 3 then 'true' when 7 then 'false' end"),
    ("approved_workspaces", f"case when {_S} % 8 = 0 then '[\"ws_1\",\"ws_2\"]' end"),
    ("approved_tenants", f"case when {_S} % 10 = 3 then 'tenant_1' end"),
    ("blocked_ai_use_cases", f"case when {_S} % 12 = 5 then '[\"text2sql\",\"rag\"]' end"),
    ("allowed_actions", "'[\"query\",\"export\",\"explain\"]'"),
    ("disallowed_actions", f"case when {_S} % 2 = 0 then '[\"export\"]' end"),
    ("summarization_policy", f"case {_S} % 7 when 2 then 'deny' when 3 then 'aggregate_only' when 4 then 'masked_only' end"),
    ("rag_exposure", f"case {_S} % 5 when 2 then 'allow' when 3 then 'metadata_only' when 4 then 'allow' end"),
    ("agent_action_policy", f"case {_S} % 4 when 1 then 'allow' when 2 then 'approval_required' end"),
    ("export_policy", f"case when {_S} % 6 = 2 then 'allow' end"),
    ("explanation_policy", f"case when {_S} % 9 = 4 then 'deny' end"),
]
_NODE = [
    ("model_name", f"concat('model_', cast({_S} as varchar(20)))"),
    ("access", f"case when {_S} % 11 = 0 then 'private' else 'protected' end"),
    ("description", f"case {_S} % 7 when 0 then 'Supplier PII data' when 1 then 'phi extract' else 'Orders by nation' end"),
]
_P = "p_partkey"
COLUMN_META = [
    ("pii", f"case {_P} % 17 when 0 then 'direct' when 1 then 'INDIRECT' when 2 then 'none' when 3 then 'odd' end"),
    ("phi", f"case when {_P} % 23 = 0 then 'true' end"),
    ("ai_exposed", f"case {_P} % 6 when 0 then 'true' when 1 then 'false' end"),
    ("masking_rule", f"case {_P} % 9 when 0 then 'hash' when 1 then 'none' end"),
    ("allowed_in_output", f"case {_P} % 8 when 0 then 'true' when 1 then 'false' end"),
    ("answer_mode", f"case when {_P} % 15 = 0 then 'masked' end"),
    ("security_class", f"case when {_P} % 16 = 0 then 'restricted' end"),
    ("ai_groupable", f"case when {_P} % 10 = 0 then 'false' end"),
]
_COLUMN = [
    ("model_name", f"concat('model_', cast({_P} % 100 as varchar(20)))"),
    ("column_name", f"concat('col_', cast({_P} as varchar(20)))"),
    ("description", f"case {_P} % 13 when 0 then 'customer email' when 1 then 'zip code' when 2 then 'IP address' "
                    "when 3 then 'Phone number' else p_type end"),
]


def _nodes(df, fields, meta):
    pairs = ", ".join(f"'{k}', {e}" for k, e in meta)
    return df.selectExpr(*[f"{e} as {c}" for c, e in fields],
                         f"map_filter(map({pairs}), (k, v) -> v is not null) as meta")


def nodes(spark, sf):
    return _nodes(table(spark, sf, "supplier"), _NODE, MODEL_META)


def models(spark, sf):
    return policy.compile_models(nodes(spark, sf))


def columns(spark, sf):
    return policy.compile_columns(_nodes(table(spark, sf, "part"), _COLUMN, COLUMN_META), models(spark, sf))


def catalog(spark, sf):
    """The compiled catalog as written tables: short plans for what reads it,
    and a known size for the planner to choose joins by."""
    paths = [scratch_path(spark, name) for name in ("models", "columns")]
    models(spark, sf).write.parquet(paths[0])
    known = spark.read.parquet(paths[0])
    node_columns = _nodes(table(spark, sf, "part"), _COLUMN, COLUMN_META)
    policy.compile_columns(node_columns, known).write.parquet(paths[1])
    return known, spark.read.parquet(paths[1])


# Check SQL for the compiled catalog -----------------------------------------
def word(v: str, words: list[str], default: str) -> str:
    return f"(case when lower({v}) in ({', '.join(map(lit, words))}) then lower({v}) else {default} end)"


def flag(v: str, default: str) -> str:
    return f"(case when {v} is null then {default} else lower({v}) in ('true', 'yes', '1') end)"


def words(v: str) -> str:
    return (f"(case when coalesce({v}, '') = '' then []::varchar[] when starts_with({v}, '[') "
            f"then from_json({v}, '[\"varchar\"]') else [{v}] end)")


def _m(name: str, default: str | None = None) -> str:
    accepted, fallback = policy.MODEL_ENUMS[name]
    return word(f"m_{name}", accepted, default or lit(fallback))


MODELS_SQL = f"""models as (
select *, ai_enabled and ai_access_level <> 'deny' and access <> 'private' as eligible,
  {word('m_retrieval_policy', ['allow', 'limited', 'deny'],
        "case when not ai_enabled then 'deny' when contains_pii or contains_phi then 'limited' else 'allow' end")}
    as retrieval_policy,
  {_m('summarization_policy', "case when not ai_enabled then 'deny' when contains_pii or contains_phi then 'masked_only' else 'allow' end")}
    as summarization_policy,
  case when not ai_enabled or ai_access_level = 'deny' then 'deny' else
    {_m('default_answer_mode', "case when contains_pii then 'masked' else 'full' end")} end as default_answer_mode
from (select model_name, access, description, m_summarization_policy, m_default_answer_mode, m_retrieval_policy,
  case when access = 'private' then 'deny' else {_m('ai_access_level')} end as ai_access_level,
  access <> 'private' and ({flag('m_ai_enabled', 'false')} or {_m('ai_access_level')} <> 'deny') as ai_enabled,
  {flag('m_certified_for_ai', 'false')} as certified_for_ai,
  {flag('m_contains_pii', "contains(lower(description), 'pii')")} as contains_pii,
  contains(lower(description), 'phi') as contains_phi,
  {', '.join(f'{_m(n)} as {n}' for n in ('sensitivity_level', 'rag_exposure', 'agent_action_policy', 'export_policy', 'explanation_policy'))},
  'high' as risk_tier,
  {', '.join(f'{words("m_" + n)} as {n}' for n in ('approved_workspaces', 'approved_tenants', 'blocked_ai_use_cases', 'allowed_actions', 'disallowed_actions'))}
  from (select null::varchar as m_retrieval_policy, {', '.join(f'{e} as {c}' for c, e in _NODE)},
    {', '.join(f'{e} as m_{k}' for k, e in MODEL_META)} from supplier)))"""

_PII_TEXT = ("case when " + " or ".join(f"contains(lower(description), {lit(w)})" for w in policy.DIRECT_SIGNALS)
             + " then 'direct' when " + " or ".join(f"contains(lower(description), {lit(w)})" for w in policy.INDIRECT_SIGNALS)
             + " then 'indirect' else 'none' end")


def _c(name: str, default: str) -> str:
    return word(f"m_{name}", policy.COLUMN_ENUMS[name][0], default)


COLUMNS_SQL = f"""cols as (
select *, case when phi then false when pii in ('direct', 'indirect') then masking_rule <> 'none' and allowed_in_output
    else ai_exposed and ai_selectable and allowed_in_output end as output_safe
from (select *, open and {flag('m_allowed_in_output', "ai_exposed and ai_selectable and pii = 'none' and not phi")} as allowed_in_output,
  case when not open then 'deny' else {_c('answer_mode', "case when phi or pii = 'direct' then case when masking_rule <> 'none' then 'masked' else 'deny' end when not ai_exposed then 'deny' else 'full' end")} end as answer_mode
from (select *, ai_exposed as ai_selectable,
  case when not open then 'none' else {_c('masking_rule', "case when pii in ('direct', 'indirect') or phi then 'redact' else 'none' end")} end as masking_rule,
  case when not open then 'internal' else {_c('security_class', "case when sens in ('public', 'internal') then sens else 'confidential' end")} end as security_class,
  not open or {flag('m_ai_groupable', 'true')} as ai_groupable
from (select *, open and {flag('m_ai_exposed', "lvl = 'approved' and pii = 'none' and not phi")} as ai_exposed
from (select c.*, m.eligible as open, m.ai_access_level as lvl, m.sensitivity_level as sens,
    case when not m.eligible then 'none' when m_pii is not null then {_c('pii', "'none'")} else {_PII_TEXT.replace('description', 'c.description')} end as pii,
    m.eligible and {flag('m_phi', 'false')} as phi
  from (select {', '.join(f'{e} as {n}' for n, e in _COLUMN)}, {', '.join(f'{e} as m_{k}' for k, e in COLUMN_META)} from part) c
  join models m using (model_name))))))"""


def over_catalog(body: str, *ctes: str) -> str:
    return "with " + ",\n".join([MODELS_SQL, COLUMNS_SQL, *ctes]) + "\n" + body


def joined(col: str) -> str:
    return f"array_to_string({col}, ',') as {col}"


_SCALARS = ["model_name", "ai_access_level", "ai_enabled", "certified_for_ai", "contains_pii", "contains_phi",
            "sensitivity_level", "rag_exposure", "agent_action_policy", "export_policy", "explanation_policy",
            "risk_tier", "retrieval_policy", "summarization_policy", "default_answer_mode", "eligible"]
_LISTS = ["approved_workspaces", "approved_tenants", "blocked_ai_use_cases", "allowed_actions", "disallowed_actions"]


@query("g01_compile_models", over_catalog(f"select {', '.join(_SCALARS + [joined(c) for c in _LISTS])} from models"))
def _(spark, sf):
    return models(spark, sf).select(*_SCALARS, *[F.array_join(c, ",").alias(c) for c in _LISTS])


_COLUMN_FIELDS = ["model_name", "column_name", "pii", "phi", "ai_exposed", "ai_selectable", "masking_rule",
                  "security_class", "answer_mode", "allowed_in_output", "ai_groupable", "output_safe"]


@query("g02_compile_columns", over_catalog(f"select {', '.join(_COLUMN_FIELDS)} from cols"))
def _(spark, sf):
    return columns(spark, sf).select(*_COLUMN_FIELDS)


@query("g03_eligible_models", over_catalog("""select model_name from models where eligible
  and (len(approved_workspaces) = 0 or list_contains(approved_workspaces, 'ws_1'))
  and (len(approved_tenants) = 0 or list_contains(approved_tenants, 'tenant_2'))
  and not list_contains(blocked_ai_use_cases, 'text2sql')"""))
def _(spark, sf):
    return policy.eligible_models(models(spark, sf), "text2sql", "ws_1", "tenant_2").select("model_name")


@query("g04_output_safe_columns", over_catalog("""select model_name, column_name, masking_rule from cols
  where ai_exposed and output_safe and model_name in (select model_name from models where eligible)"""))
def _(spark, sf):
    return policy.eligible_columns(columns(spark, sf), models(spark, sf), output_only=True).select(
        "model_name", "column_name", "masking_rule")


@query("g10_allowed_actions", over_catalog("""select model_name, array_to_string(list_filter(allowed_actions,
  lambda a: not list_contains(disallowed_actions, a)), ',') as actions from models where eligible"""))
def _(spark, sf):
    return policy.allowed_actions(models(spark, sf)).select("model_name", F.array_join("actions", ",").alias("actions"))


@query("g10_blocked_models", over_catalog("""select model_name, ai_enabled, ai_access_level,
  case when access = 'private' then 'access=private' when not ai_enabled then 'ai_enabled=false'
    else 'ai_access_level=' || ai_access_level end as reason from models where not eligible"""))
def _(spark, sf):
    return policy.blocked_models(models(spark, sf))


@query("g10_restricted_columns", over_catalog("""select model_name, column_name, pii, phi, masking_rule, answer_mode
from cols where pii <> 'none' or phi or not output_safe"""))
def _(spark, sf):
    return policy.restricted_columns(columns(spark, sf))


@query("a18_catalog_summary", over_catalog("""select m.*, c.* from (select count(*) as total_models,
  count(*) filter (where eligible) as ai_eligible_models,
  count(*) filter (where eligible and certified_for_ai) as certified_models,
  count(*) filter (where not eligible) as denied_models from models) m,
(select count(*) as total_columns, count(*) filter (where pii <> 'none' or phi) as pii_or_phi_columns,
  count(*) filter (where output_safe) as output_safe_columns,
  count(*) filter (where not output_safe) as blocked_columns from cols) c"""))
def _(spark, sf):
    return policy.catalog_summary(*catalog(spark, sf))


@query("g09_explain_models", over_catalog("""select model_name, allowed, answer_mode, certified,
  case when r = '' and allowed then 'Model is AI-eligible (access_level=' || ai_access_level || ')' else r end as reasons
from (select model_name, eligible as allowed, ai_access_level, certified_for_ai and eligible as certified,
  case when not eligible or list_contains(blocked_ai_use_cases, 'rag') then 'deny' else default_answer_mode end as answer_mode,
  concat_ws('; ', case when not ai_enabled then 'ai_enabled is false — model excluded from AI context' end,
    case when ai_access_level = 'deny' then 'ai_access_level is deny' end,
    case when access = 'private' then 'dbt access is private — hard deny' end,
    case when list_contains(blocked_ai_use_cases, 'rag') then 'use case ''rag'' is in blocked_ai_use_cases' end) as r
  from models)"""))
def _(spark, sf):
    return policy.explain_models(models(spark, sf), "rag").withColumn("reasons", F.array_join("reasons", "; "))


@query("g09_explain_columns", over_catalog("""select model_name, column_name, output_safe as allowed,
  case when ((phi or pii = 'direct') and masking_rule = 'none') or not ai_exposed or not ai_selectable then 'deny'
    else answer_mode end as answer_mode,
  coalesce(nullif(concat_ws('; ', case when not open then 'Parent model is not AI-eligible' end,
    case when phi then 'Column contains PHI — restricted by default' end,
    case when pii <> 'none' then 'Column PII class: ' || pii end,
    case when not ai_exposed then 'ai_exposed is false' end,
    case when not allowed_in_output then 'allowed_in_output is false' end,
    case when masking_rule <> 'none' then 'Masking rule applied: ' || masking_rule end), ''),
    'Column is AI-output-safe') as reasons from cols"""))
def _(spark, sf):
    return policy.explain_columns(columns(spark, sf), models(spark, sf)).withColumn(
        "reasons", F.array_join("reasons", "; "))


@query("f43_lenient_settings", "select " + f"""s_suppkey, {word('v', ['deny', 'internal', 'restricted', 'approved'], "'deny'")} as access_level,
  {flag('v', 'true')} as flag, array_to_string({words('v')}, '|') as items
from (select s_suppkey, case s_suppkey % 7 when 0 then 'APPROVED' when 1 then 'Yes' when 2 then '' when 3 then '["a","b"]'
  when 4 then '1' when 5 then 'restricted' end as v from supplier)""")
def _(spark, sf):
    v = F.expr("case s_suppkey % 7 when 0 then 'APPROVED' when 1 then 'Yes' when 2 then '' when 3 then '[\"a\",\"b\"]' "
               "when 4 then '1' when 5 then 'restricted' end")
    return table(spark, sf, "supplier").select(
        "s_suppkey", policy.coerced(v, *policy.MODEL_ENUMS["ai_access_level"]).alias("access_level"),
        policy.as_flag(v, True).alias("flag"), F.array_join(policy.as_list(v), "|").alias("items"))


@query("f44_pii_from_description", f"select p_partkey, {_PII_TEXT} as pii from "
       f"(select p_partkey, {_COLUMN[2][1]} as description from part)")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", policy.pii_class_of(F.expr(_COLUMN[2][1])).alias("pii"))


# Statements, one per event ----------------------------------------------------
_E = "cast(event_id % 110 as varchar(20))"
_E1 = "cast(event_id % 110 + 1 as varchar(20))"
_C2 = "cast(event_id % 110 + 100 as varchar(20))"
STATEMENT_FIELDS = [
    ("statement_id", "concat('st-', cast(event_id as varchar(20)))"),
    ("use_case", "case when event_id % 5 = 0 then 'bi_metric_explanation' else 'text2sql' end"),
    ("workspace_id", "concat('ws_', cast(event_id % 4 as varchar(20)))"),
    ("tenant_id", "case when event_id % 9 = 0 then '' else concat('tenant_', cast(event_id % 3 as varchar(20))) end"),
    ("sql_text", f"""case event_id % 8
      when 0 then concat('SELECT col_', {_E}, ', col_', {_C2}, ' FROM model_', {_E})
      when 1 then concat('SELECT * FROM model_', {_E})
      when 2 then concat('select t.COL_', {_E}, ' AS col_', {_C2}, ' from db.MODEL_', {_E}, ' t join model_', {_E1}, ' u on 1 = 1')
      when 3 then concat('DROP TABLE model_', {_E}, '; delete from x')
      when 4 then concat('SELECT COUNT(*), SUM(col_', {_E}, ') FROM model_', {_E})
      when 5 then concat('WITH x AS (SELECT col_', {_E}, ' FROM "model_', {_E}, '") SELECT u.* FROM x')
      when 6 then concat('SELECT col_', {_E}, ' FROM model_', {_E}, ' WHERE note = ', 'updated')
      else concat('SELECT s.col_', {_C2}, ' FROM schema1.model_', {_E}, ' s') end"""),
]


def statements(spark, sf):
    return table(spark, sf, "events").selectExpr(*[f"{e} as {n}" for n, e in STATEMENT_FIELDS])


STATEMENTS_SQL = "statements as (select " + ", ".join(f"{e} as {n}" for n, e in STATEMENT_FIELDS) + " from events)"
_STRIP = lit(sqltext.QUOTES_PATTERN)


def _bare(v: str) -> str:
    return f"regexp_replace({v}, {_STRIP}, '', 'g')"


TABLES_SQL = (f"list_sort(list_distinct(list_transform(regexp_extract_all(sql_text, {lit(sqltext.SOURCE_PATTERN)}, 1), "
              f"lambda t: lower(string_split({_bare('t')}, '.')[-1]))))")
VERBS_SQL = f"list_transform(regexp_extract_all(sql_text, {lit(sqltext.DANGEROUS_PATTERN)}, 1), lambda v: upper(v))"
_PARTS = f"""list_filter(list_transform(string_split(sel, ','), lambda p: case when regexp_matches(p, {lit(sqltext.AS_PATTERN)})
    then {_bare(f"regexp_split_to_array(p, {lit(sqltext.AS_PATTERN)})[-1]")}
    else lower(string_split({_bare('p')}, '.')[-1]) end), lambda c: c <> '')"""
OUTPUTS_SQL = f"""case when sel = '' then []::varchar[] when regexp_matches(sel, '(^|[^(])\\*([^)]|$)') then ['*']
  else list_sort(list_distinct({_PARTS})) end"""
PARSED_SQL = f"""parsed as (select *, {OUTPUTS_SQL} as outputs, list_distinct(flatten(list_transform(string_split(sel, ','),
  lambda p: regexp_extract_all(lower(p), '(\\w+)', 1)))) as words from (select *, {VERBS_SQL} as verbs, {TABLES_SQL} as tables,
  regexp_extract(sql_text, {lit(sqltext.SELECT_LIST_PATTERN)}, 1) as sel from statements))"""


@query("f40_sql_tables", f"with {STATEMENTS_SQL}, {PARSED_SQL} select statement_id, array_to_string(tables, ',') as tables from parsed")
def _(spark, sf):
    return statements(spark, sf).select(
        "statement_id", F.array_join(sqltext.referenced_tables(F.col("sql_text")), ",").alias("tables"))


@query("f41_select_list", f"with {STATEMENTS_SQL}, {PARSED_SQL} select statement_id, array_to_string(outputs, ',') as outputs from parsed")
def _(spark, sf):
    return statements(spark, sf).select(
        "statement_id", F.array_join(sqltext.selected_columns(F.col("sql_text")), ",").alias("outputs"))


@query("f42_dangerous_verbs", f"with {STATEMENTS_SQL}, {PARSED_SQL} select statement_id, array_to_string(verbs, ',') as verbs from parsed")
def _(spark, sf):
    return statements(spark, sf).select(
        "statement_id", F.array_join(sqltext.dangerous_verbs(F.col("sql_text")), ",").alias("verbs"))


_ACCESS_SQL = """case when not eligible then 'MODEL_DENIED'
  when workspace_id <> '' and len(approved_workspaces) > 0 and not list_contains(approved_workspaces, workspace_id) then 'WORKSPACE_DENIED'
  when tenant_id <> '' and len(approved_tenants) > 0 and not list_contains(approved_tenants, tenant_id) then 'TENANT_DENIED'
  when list_contains(blocked_ai_use_cases, use_case) then 'USE_CASE_DENIED' end"""

AUDIT_CTES = (
    STATEMENTS_SQL, PARSED_SQL,
    f"""hits as (select statement_id, t, outputs, words, list_contains(outputs, '*') as star, default_answer_mode = 'aggregate_only' as agg,
  eligible, case when model_name is null then 'UNKNOWN_MODEL' else {_ACCESS_SQL} end as rule
from (select *, unnest(tables) as t from parsed where len(verbs) = 0) left join models on lower(model_name) = t)""",
    """per_table as (select statement_id,
  list_sort(coalesce(list(rule || ':' || t) filter (where rule is not null), [])) as mf,
  list_sort(coalesce(list(t) filter (where rule <> 'UNKNOWN_MODEL'), [])) as bm,
  list_sort(coalesce(list('AGGREGATE_ONLY_VIOLATION:' || t) filter (where star and agg and rule is null), [])) as sf,
  coalesce(bool_or(agg and rule is null), false) as agg from hits group by 1)""",
    """per_column as (select statement_id, list_sort(list(rule || ':' || t || '.' || o)) as cf, list_sort(list(t || '.' || o)) as bc
from (select statement_id, t, o, case when phi then 'PHI_OUTPUT_DENIED'
    when pii = 'direct' and not output_safe then 'PII_OUTPUT_DENIED'
    when not allowed_in_output then 'COLUMN_OUTPUT_DENIED' end as rule
  from (select *, unnest(outputs) as o from hits where eligible and not star) h
  join cols on lower(cols.model_name) = h.t and cols.column_name = h.o) where rule is not null group by 1)""",
    """verdicts as (select statement_id, list_transform(verbs, lambda v: 'DANGEROUS_SQL:' || v) as vf, coalesce(mf, []) as mf,
  coalesce(bm, []) as bm, case when len(bm) > 0 then [] else coalesce(sf, []) end as sf,
  case when len(bm) > 0 then [] else coalesce(cf, []) end as cf,
  case when len(bm) > 0 then [] else coalesce(bc, []) end as bc, coalesce(agg, false) as agg
from parsed left join per_table using (statement_id) left join per_column using (statement_id))""",
)


_AUDIT_BODY = """select statement_id, len(vf) + len(bm) + len(sf) + len(cf) = 0 as allowed,
  array_to_string(vf || mf || sf || cf, ',') as violations, array_to_string(bm, ',') as blocked_models,
  array_to_string(bc, ',') as blocked_columns,
  case when len(vf) + len(bm) > 0 then 'full' when len(sf) + len(cf) > 0 then 'deny'
    when agg then 'aggregate_only' else 'full' end as answer_mode from verdicts"""


@query("g05_sql_audit", over_catalog(_AUDIT_BODY, *AUDIT_CTES))
def _(spark, sf):
    out = policy.audit_sql(statements(spark, sf), *catalog(spark, sf))
    return out.withColumns({c: F.array_join(c, ",") for c in ("violations", "blocked_models", "blocked_columns")})


_STRICT_CTES = tuple(c.replace("unnest(outputs)", "unnest(words)") for c in AUDIT_CTES)


@query("g05_sql_audit_strict", over_catalog(_AUDIT_BODY, *_STRICT_CTES))
def _(spark, sf):
    out = policy.audit_sql(statements(spark, sf), *catalog(spark, sf), strict=True)
    return out.withColumns({c: F.array_join(c, ",") for c in ("violations", "blocked_models", "blocked_columns")})


@query("o05_first_three_reasons", over_catalog("""select statement_id,
  array_to_string((vf || mf || sf || cf)[1:3], '; ') as reasons from verdicts""", *AUDIT_CTES))
def _(spark, sf):
    out = policy.audit_sql(statements(spark, sf), *catalog(spark, sf))
    return out.select("statement_id", F.array_join(F.slice("violations", 1, 3), "; ").alias("reasons"))


@query("j10_policy_lookup", over_catalog(f"""select statement_id, t as table_name, rule from hits""", *AUDIT_CTES[:3]))
def _(spark, sf):
    parsed = statements(spark, sf).withColumns({
        "verbs": sqltext.dangerous_verbs(F.col("sql_text")), "tables": sqltext.referenced_tables(F.col("sql_text"))})
    rows = parsed.where(F.size("verbs") == 0).withColumn("table_name", F.explode("tables")).join(
        policy._keyed(models(spark, sf), *policy._RULES), "table_name", "left")
    return rows.select("statement_id", "table_name", F.when(F.col("eligible").isNull(), "UNKNOWN_MODEL").otherwise(
        policy.access_code()).alias("rule"))


# Requests, one per order ------------------------------------------------------
_O1, _O2 = "cast(o_custkey % 110 as varchar(20))", "cast((o_custkey + 37) % 110 as varchar(20))"
REQUEST_FIELDS = [
    ("request_id", "concat('rq-', cast(o_orderkey as varchar(20)))"),
    ("use_case", "case o_orderkey % 6 when 0 then 'summarization' when 1 then 'rag' when 2 then 'export' "
                 "when 3 then 'explanation' when 4 then 'agent_tool' else 'generic' end"),
    ("workspace_id", "concat('ws_', cast(o_orderkey % 4 as varchar(20)))"),
    ("tenant_id", "concat('tenant_', cast(o_orderkey % 3 as varchar(20)))"),
    ("tool_name", "case when o_orderkey % 12 = 4 then 'send_email' else 'run_query' end"),
    ("args", f"concat('load Model_', {_O1}, ' then model_', {_O2}, ';')"),
]


def requests(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        *[f"{e} as {n}" for n, e in REQUEST_FIELDS],
        f"array_distinct(array(concat('model_', {_O1}), concat('model_', {_O2}))) as model_names")


REQUESTS_SQL = ("requests as (select " + ", ".join(f"{e} as {n}" for n, e in REQUEST_FIELDS)
                + f", case when {_O1} = {_O2} then ['model_' || {_O1}] else ['model_' || {_O1}, 'model_' || {_O2}] end as model_names from orders)")
CHECKS_SQL = (
    REQUESTS_SQL,
    f"""judged as (select request_id, t, model_name is not null as known, use_case,
  {_ACCESS_SQL} as acc, case
    when use_case = 'summarization' and summarization_policy = 'deny' then 'SUMMARIZATION_DENIED'
    when use_case = 'rag' and rag_exposure = 'deny' then 'RAG_DENIED'
    when use_case = 'rag' and retrieval_policy = 'deny' then 'RETRIEVAL_DENIED'
    when use_case = 'explanation' and explanation_policy = 'deny' then 'EXPLANATION_DENIED'
    when use_case = 'export' and export_policy = 'deny' then 'EXPORT_DENIED'
    when use_case = 'agent_tool' and agent_action_policy = 'deny' then 'AGENT_ACTION_DENIED'
    when use_case = 'agent_tool' and agent_action_policy = 'approval_required' then 'AGENT_ACTION_APPROVAL_REQUIRED' end as own,
  case when use_case = 'agent_tool' and contains(tool_name, 'send') and export_policy = 'deny' then 'EXPORT_DENIED' end as extra,
  case when use_case = 'summarization' and summarization_policy = 'aggregate_only' then 2
    when use_case = 'summarization' and summarization_policy = 'masked_only' then 1
    when use_case = 'rag' and rag_exposure = 'metadata_only' then 3 else 0 end as m
from (select *, unnest(case when use_case = 'rag' then model_names[1:1] else model_names end) as t from requests)
left join models on lower(model_name) = t)""",
    """checked as (select request_id, list_sort(coalesce(list(v) filter (where v is not null), [])) as v,
  list_sort(coalesce(list(distinct u) filter (where u is not null), [])) as u, max(md) as md
from (select request_id, unnest([case when known then coalesce(acc, own) || ':' || t end,
    case when known and acc is null then extra || ':' || t end]) as v,
  case when not known and use_case = 'rag' then 'UNKNOWN_SOURCE:' || t end as u,
  case when known and acc is null then m else 0 end as md from judged) group by 1)""",
    """answers as (select request_id, len(v) = 0 as allowed, v || u as vs, case when len(v) > 0 then 'deny'
  else ['full', 'masked', 'aggregate_only', 'metadata_only'][md + 1] end as answer_mode from checked)""",
)


@query("g06_request_checks", over_catalog(
    "select request_id, allowed, array_to_string(vs, ',') as violations, answer_mode from answers", *CHECKS_SQL))
def _(spark, sf):
    return policy.check_requests(requests(spark, sf), models(spark, sf)).withColumn(
        "violations", F.array_join("violations", ","))


@query("g06_user_messages", over_catalog("""select request_id, case
  when allowed and answer_mode = 'aggregate_only' then 'I can answer this, but only in aggregate form due to data governance policy.'
  when allowed and answer_mode = 'masked' then 'I can answer this, but some sensitive fields will be masked.'
  when allowed then 'Request is allowed by data governance policy.'
  else 'This request was blocked by data governance policy. Reason: ' || array_to_string(vs[1:3], '; ') end as message
from answers""", *CHECKS_SQL))
def _(spark, sf):
    checked = policy.check_requests(requests(spark, sf), models(spark, sf))
    return checked.select("request_id", policy.user_message(
        F.col("allowed"), F.col("answer_mode"), F.col("violations")).alias("message"))


@query("g06_models_in_arguments", over_catalog(
    "select request_id, model_name from requests join models on contains(lower(args), lower(model_name))", REQUESTS_SQL))
def _(spark, sf):
    return policy.models_in_text(requests(spark, sf), "args", models(spark, sf))


# Schema rows: every part column, plus columns and tables the catalog lacks.
SCHEMA_SQL = """schema_rows as (select 'model_' || (p_partkey % 110) as table_name, 'col_' || p_partkey as column_name,
  lower(p_type) as type, p_name as description from part)"""


def _seen_sql(scope: str) -> str:
    return f"""seen as (select s.*, m.model_name is null as unknown, m.default_answer_mode, c.ai_exposed, c.allowed_in_output, c.description as cd,
  case when phi then '[PHI field — must not appear in output]'
    when pii <> 'none' and masking_rule <> 'none' then '[PII field — masking rule: ' || masking_rule || '. Do not expose raw values in output]'
    when pii <> 'none' then '[PII field — use in filters/grouping only, do not select for output]' end as note,
  case when m.model_name is null then '[Not in AI policy catalog — warehouse access controls apply]'
    when default_answer_mode = 'aggregate_only' then '[Aggregate-only: do not generate row-level output from this table]'
    when contains_pii then '[Contains PII: sensitive fields have been masked or excluded]' end as table_note
from schema_rows s left join models m on m.model_name = s.table_name
left join cols c on c.model_name = s.table_name and c.column_name = s.column_name
where (m.model_name is null or (eligible{scope})) and (m.model_name is null or c.ai_exposed is null or c.ai_exposed))"""


def _safe_sql(use_note: str) -> str:
    return f"""select * from (select table_name, column_name, type,
  case when cd is not null and cd <> '' then cd else description end as description,
  case when ai_exposed is null then '[Not in column policy catalog]' else coalesce(note, {use_note}) end as ai_note,
  table_note from seen where not unknown)
union all select distinct table_name, null, null, null, null, table_note from seen where unknown
union all select distinct table_name, '__aggregate_only__', 'directive', 'This table may only be queried with aggregate functions (COUNT, SUM, AVG, MIN, MAX). Do not generate row-level SELECT queries.', null, table_note
  from seen where not unknown and default_answer_mode = 'aggregate_only'"""


_IN_WS_1 = """ and (len(approved_workspaces) = 0 or list_contains(approved_workspaces, 'ws_1'))
    and not list_contains(blocked_ai_use_cases, 'text2sql')"""
_OUTPUT_NOTE = """case when not allowed_in_output then '[Allowed in WHERE/GROUP BY only — do not SELECT ' || chr(39)
    || column_name || chr(39) || ' in output]' end"""


def _schema_rows(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "concat('model_', p_partkey % 110) as table_name", "concat('col_', p_partkey) as column_name",
        "lower(p_type) as type", "p_name as description")


@query("g07_safe_schema", over_catalog(_safe_sql(_OUTPUT_NOTE), SCHEMA_SQL, _seen_sql(_IN_WS_1)))
def _(spark, sf):
    return policy.safe_schema(_schema_rows(spark, sf), *catalog(spark, sf), "text2sql", "ws_1")


@query("g07_schema_summary", over_catalog(f"""select count(distinct table_name) as model_count,
  count(*) filter (where column_name is not null and not starts_with(column_name, '__')) as column_count,
  count(*) filter (where column_name = '__aggregate_only__') as aggregate_only_models,
  count(*) filter (where coalesce(starts_with(ai_note, '[PII'), false)) as pii_annotated_columns
from ({_safe_sql('null')})""", SCHEMA_SQL, _seen_sql("")))
def _(spark, sf):
    return policy.schema_summary(policy.safe_schema(_schema_rows(spark, sf), *catalog(spark, sf)))


# Policy of one table, as rows of its column policies.
CUSTOMER_POLICY = [
    {"column_name": "c_custkey", "output_safe": True, "masking_rule": "none", "ai_groupable": True},
    {"column_name": "c_name", "output_safe": True, "masking_rule": "hash", "ai_groupable": False},
    {"column_name": "c_acctbal", "output_safe": False, "masking_rule": "none", "ai_groupable": False},
    {"column_name": "c_mktsegment", "output_safe": True, "masking_rule": "redact", "ai_groupable": True},
]


@query("g08_governed_read", f"select c_custkey, {hash_sql('c_name')} as c_name, '[REDACTED]' as c_mktsegment from customer")
def _(spark, sf):
    return policy.governed_read(table(spark, sf, "customer"), "masked", CUSTOMER_POLICY)


@query("p12_policy_projection", f"select c_custkey, {hash_sql('c_name')} as c_name from customer")
def _(spark, sf):
    return policy.governed_read(table(spark, sf, "customer"), "full", CUSTOMER_POLICY[:3])


@query("g08_governed_aggregate", """select c_mktsegment, count(*) as customers, round(avg(c_acctbal), 4) as avg_balance
from customer group by 1""")
def _(spark, sf):
    return policy.governed_aggregate(
        table(spark, sf, "customer"), ["c_mktsegment"],
        [F.count("*").alias("customers"), F.round(F.avg("c_acctbal"), 4).alias("avg_balance")], CUSTOMER_POLICY)


@query("f47_tokenise", """select o_orderkey, 'tok_' || substr(sha256('key1' || o_orderpriority), 1, 12) as o_orderpriority
from orders""")
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    values = orders.select(F.col("o_orderpriority").alias("value")).distinct()
    tokens = values.withColumn("token", F.concat(
        F.lit("tok_"), F.substring(F.sha2(F.concat(F.lit("key1"), F.col("value")), 256), 1, 12)))
    return policy.tokenise(orders, "o_orderpriority", tokens)
