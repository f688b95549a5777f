import json

import pytest
from pyspark.sql import functions as F

from traceworks.operators import textmatch
from traceworks.plans import policy

NODES = [
    ("products", "", "Catalog", {"ai_access_level": "approved", "default_answer_mode": "full", "certified_for_ai": "true"}),
    ("customers", "", "People", {"ai_access_level": "approved", "default_answer_mode": "masked"}),
    ("orders", "", "Orders", {"ai_access_level": "approved", "default_answer_mode": "aggregate_only"}),
    ("secret_table", "", "Secret", {"ai_access_level": "deny"}),
    ("raw_users", "private", "Raw", {"ai_access_level": "approved"}),
]
COLUMNS = [
    ("products", "name", "", {}), ("customers", "customer_id", "", {}),
    ("customers", "email", "", {"pii": "direct", "ai_exposed": "true", "masking_rule": "redact"}),
    ("customers", "dob", "date of birth", {}), ("customers", "chart", "", {"phi": "true"}),
    ("orders", "amount", "", {}), ("secret_table", "x", "", {}),
]


@pytest.fixture(scope="module")
def catalog(spark):
    nodes = spark.createDataFrame(NODES, "model_name string, access string, description string, meta map<string,string>")
    columns = spark.createDataFrame(COLUMNS, "model_name string, column_name string, description string, meta map<string,string>")
    models = policy.compile_models(nodes).cache()
    return models, policy.compile_columns(columns, models).cache()


STATEMENTS = [
    ("SELECT name FROM products", True, [], "full"),
    ("DROP TABLE customers", False, ["DANGEROUS_SQL:DROP"], "full"),
    ("DELETE FROM customers WHERE customer_id = 1", False, ["DANGEROUS_SQL:DELETE"], "full"),
    ("SELECT * FROM secret_table", False, ["MODEL_DENIED:secret_table"], "full"),
    ("SELECT id FROM raw_users", False, ["MODEL_DENIED:raw_users"], "full"),
    ("SELECT customer_id, email FROM customers", False, ["PII_OUTPUT_DENIED:customers.email"], "deny"),
    ("SELECT chart FROM customers", False, ["PHI_OUTPUT_DENIED:customers.chart"], "deny"),
    ("SELECT * FROM orders", False, ["AGGREGATE_ONLY_VIOLATION:orders"], "deny"),
    ("SELECT COUNT(*), SUM(amount) FROM orders", True, [], "aggregate_only"),
    ("SELECT x FROM unknown_model", True, ["UNKNOWN_MODEL:unknown_model"], "full"),
    ("SELECT email AS e FROM customers", True, [], "full"),
]


def statements(spark, rows, **extra):
    data = [(str(i), r[0], extra.get("use_case", "text2sql"), extra.get("workspace", ""), extra.get("tenant", ""))
            for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "statement_id string, sql_text string, use_case string, workspace_id string, tenant_id string")


def test_sql_audit_golden(spark, catalog):
    got = {r["statement_id"]: r for r in policy.audit_sql(statements(spark, STATEMENTS), *catalog).collect()}
    for i, (sql, allowed, violations, mode) in enumerate(STATEMENTS):
        r = got[str(i)]
        assert (r["allowed"], r["violations"], r["answer_mode"]) == (allowed, violations, mode), sql


def test_strict_audit_looks_behind_aliases(spark, catalog):
    got = policy.audit_sql(statements(spark, [("SELECT upper(email) AS e FROM customers",)]), *catalog, strict=True).first()
    assert not got["allowed"] and got["blocked_columns"] == ["customers.email"]


def test_safe_defaults(catalog):
    models, columns = catalog
    m = {r["model_name"]: r for r in models.collect()}
    assert m["products"]["eligible"] and m["products"]["retrieval_policy"] == "allow"
    assert m["raw_users"]["ai_access_level"] == "deny" and m["raw_users"]["default_answer_mode"] == "deny"
    assert m["secret_table"]["summarization_policy"] == "deny" and m["products"]["rag_exposure"] == "deny"
    c = {(r["model_name"], r["column_name"]): r for r in columns.collect()}
    assert c["products", "name"]["output_safe"]
    assert c["customers", "dob"]["pii"] == "direct" and c["customers", "dob"]["masking_rule"] == "redact"
    assert not c["customers", "email"]["output_safe"]
    assert not c["secret_table", "x"]["ai_exposed"] and c["secret_table", "x"]["allowed_in_where"]


def test_workspace_tenant_and_use_case_rules(spark):
    nodes = spark.createDataFrame([("m", "", "", {
        "ai_access_level": "approved", "approved_workspaces": '["ws_1"]', "approved_tenants": "t1",
        "blocked_ai_use_cases": '["rag"]'})], "model_name string, access string, description string, meta map<string,string>")
    models = policy.compile_models(nodes)
    assert policy.eligible_models(models, "text2sql", "ws_1", "t1").count() == 1
    assert policy.eligible_models(models, workspace="ws_2").count() == 0
    assert policy.eligible_models(models, tenant="t2").count() == 0
    assert policy.eligible_models(models, use_case="rag").count() == 0
    none = spark.createDataFrame([], "model_name string, column_name string, description string, meta map<string,string>")
    columns = policy.compile_columns(none, models)
    for extra, code in (({"workspace": "ws_2"}, "WORKSPACE_DENIED:m"), ({"tenant": "t9"}, "TENANT_DENIED:m"),
                        ({"use_case": "rag"}, "USE_CASE_DENIED:m")):
        assert policy.audit_sql(statements(spark, [("select a from m",)], **extra), models, columns).first()["violations"] == [code]


def test_namespaced_metadata_wins_over_flat_keys(spark):
    meta = {"governance": json.dumps({"ai_access_level": "approved", "risk_tier": "low"}), "ai_access_level": "deny",
            "owner_team": "data"}
    nodes = spark.createDataFrame([("m", "", "contains PII", meta)],
                                  "model_name string, access string, description string, meta map<string,string>")
    r = policy.compile_models(nodes).first()
    assert (r["ai_access_level"], r["risk_tier"], r["owner_team"], r["default_answer_mode"]) == (
        "approved", "low", "data", "masked")


def test_manifest_file(spark, tmp_path):
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps({"nodes": {"model.demo.a": {
        "name": "a", "unique_id": "model.demo.a", "resource_type": "model", "schema": "public", "database": "demo",
        "description": "", "access": "", "tags": ["x"], "meta": {"ai_enabled": True, "allowed_actions": ["q", "e"]},
        "columns": {"email": {"description": "user email", "meta": {}}}}}, "sources": {}}, indent=1))
    nodes = policy.manifest_nodes(spark.read.schema(policy.MANIFEST_SCHEMA).option("multiLine", True).json(str(path)))
    models = policy.compile_models(nodes)
    r = models.first()
    assert (r["model_name"], r["ai_enabled"], r["allowed_actions"], r["eligible"]) == ("a", True, ["q", "e"], False)
    c = policy.compile_columns(policy.manifest_columns(nodes), models).first()
    assert (c["column_name"], c["ai_exposed"]) == ("email", False)


def test_requests_and_messages(spark, catalog):
    rows = [("r1", "rag", ["products"]), ("r2", "summarization", ["customers", "secret_table"]), ("r3", "rag", ["nope"]),
            ("r4", "agent_tool", ["products"]), ("r5", "generic", ["orders"])]
    req = spark.createDataFrame([(i, u, "", "", "export_rows", m) for i, u, m in rows],
                                "request_id string, use_case string, workspace_id string, tenant_id string, tool_name string, model_names array<string>")
    out = policy.check_requests(req, catalog[0])
    got = {r["request_id"]: r for r in out.collect()}
    assert got["r1"]["violations"] == ["RAG_DENIED:products"] and got["r1"]["answer_mode"] == "deny"
    assert got["r2"]["violations"] == ["MODEL_DENIED:secret_table"]
    assert got["r3"]["allowed"] and got["r3"]["violations"] == ["UNKNOWN_SOURCE:nope"]
    assert got["r4"]["violations"] == ["AGENT_ACTION_DENIED:products", "EXPORT_DENIED:products"]
    assert got["r5"]["allowed"] and got["r5"]["answer_mode"] == "full"
    text = out.select(policy.user_message(F.col("allowed"), F.col("answer_mode"), F.col("violations")).alias("m"))
    assert any("Reason: RAG_DENIED:products" in r["m"] for r in text.collect())


def test_models_in_text_matches_brute_force(spark, catalog):
    texts = ["load PRODUCTS and orders", "reorders", "nothing", "raw_users;secret_table"]
    req = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "request_id string, args string")
    got = {(r["request_id"], r["model_name"]) for r in policy.models_in_text(req, "args", catalog[0]).collect()}
    assert got == {(str(i), n[0]) for i, t in enumerate(texts) for n in NODES if n[0] in t.lower()}


def test_governed_reads(spark):
    df = spark.createDataFrame([(1, "a@b.co", 5.0)], "id int, email string, salary double")
    rules = [{"column_name": "id", "output_safe": True, "masking_rule": "none", "ai_groupable": True},
             {"column_name": "email", "output_safe": True, "masking_rule": "partial_mask", "ai_groupable": False},
             {"column_name": "salary", "output_safe": False, "masking_rule": "none", "ai_groupable": False}]
    assert policy.governed_read(df, "masked", rules).first().asDict() == {"id": 1, "email": "a***@b.co"}
    assert policy.governed_read(df, "metadata_only", rules).count() == 0
    for mode in ("deny", "aggregate_only"):
        with pytest.raises(policy.PolicyDenied):
            policy.governed_read(df, mode, rules)
    with pytest.raises(policy.PolicyDenied):
        policy.governed_aggregate(df, ["email"], [F.count("*")], rules)
    assert policy.governed_aggregate(df, ["id"], [F.sum("salary").alias("s")], rules).first()["s"] == 5.0


@pytest.mark.parametrize("block, characters", [(20_000, 4_000_000), (3, 40)])
def test_names_in_long_texts(spark, block, characters):
    names = [f"model_{i}" for i in range(60)] + ["Model_7", "é", "odel_1", None, "model_99"]
    texts = [" ".join(f"word{k % 977}" for k in range(20_000)) + " MODEL_12 x", "É model_7model_8", "", None, "model_5"] + ["same"] * 50
    left = spark.createDataFrame(list(enumerate(texts)), "id int, body string").repartition(3)
    right = spark.createDataFrame([(n,) for n in names], "n string")
    out = textmatch.names_in_texts(left, "id", "body", right, "n", block, characters)
    got = sorted((int(r.text_id), r.name) for r in out.collect())
    assert got == sorted({(i, n) for i, t in enumerate(texts) if t for n in names if n and n.lower() in t.lower()})
    assert max(r[0] for r in got) == 4 and (0, "model_12") in got
