import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from traceworks.operators.dedup import append_new, sync
from traceworks.operators.quantiles import exact_percentiles
from traceworks.operators.sliced import _split, ordered_texts, sequence_in_group
from traceworks.plans import emit, ledger, metrics, replay
from traceworks.plans.emit import LEDGER_COLUMNS
from traceworks.sources.sinks import ParquetLedger

SCHEMA = ", ".join(f"{c} {'boolean' if c in emit.BOOLEANS else 'string'}" for c in LEDGER_COLUMNS)
BASE = {"tenant_id": "acme", "workspace_id": "w", "user_id": "alice", "session_id": "sess-alice-001",
        "request_id": "req-1", "actor_type": "user", "actor_id": "alice", "status": "ok"}


def events(spark, *rows):
    full = []
    for i, r in enumerate(rows):
        row = {**dict.fromkeys(LEDGER_COLUMNS), **BASE, "trace_id": f"t{i}",
               "event_timestamp": f"2024-03-01T10:00:{i:02d}+00:00", **r}
        full.append(tuple(row[c] for c in LEDGER_COLUMNS))
    return spark.createDataFrame(full, SCHEMA)


def with_legacy(df):
    return df.withColumns({"input_summary": F.lit(None).cast("string"), "output_summary": F.lit(None).cast("string")})


def test_five_event_chain_is_ordered_and_timed(spark):
    chain = ["request_received", "sql_generated", "sql_validated", "sql_executed", "response_returned"]
    raw = with_legacy(events(spark, *[{"event_type": t} for t in chain]))
    got = replay.replay(raw).orderBy("event_sequence").collect()
    assert [r["event_type"] for r in got] == chain
    assert [r["duration_ms"] for r in got] == [None, 1000, 1000, 1000, 1000]
    assert replay.view(replay.replay(raw), "sql_chain").count() == 3
    assert got[0]["label"] == "Request Received"


def test_tenants_do_not_see_each_other_in_a_shared_session(spark):
    raw = events(spark, {"event_type": "request_received"},
                 {"event_type": "request_received", "tenant_id": "rival-corp", "user_id": "bob"})
    assert [r["trace_id"] for r in replay.by_session(raw, "acme", "sess-alice-001").collect()] == ["t0"]
    assert [r["trace_id"] for r in replay.search(raw, "rival-corp").collect()] == ["t1"]


def test_first_write_wins_in_batch_and_across_batches(spark, tmp_path):
    store = ParquetLedger(spark, str(tmp_path / "ledger"))
    first = events(spark, {"event_type": "request_received", "question_text": "original"}).withColumn("ingest_seq", F.lit(0))
    tampered = first.withColumns({"question_text": F.lit("TAMPERED"), "ingest_seq": F.lit(1)})
    store.append(tampered.unionByName(first))
    store.append(tampered)
    assert [r["question_text"] for r in store.read().collect()] == ["original"]
    assert append_new(store.read(), first, "trace_id", ["ingest_seq"]).count() == 0


def test_first_versus_corrected_sql(spark):
    raw = events(
        spark, {"event_type": "sql_generated", "sql_hash": "h1"}, {"event_type": "human_feedback_received"},
        {"event_type": "sql_generated", "sql_hash": "h2"}, {"event_type": "sql_generated", "sql_hash": "h3"},
        {"event_type": "sql_generated", "sql_hash": "h9", "request_id": "req-2"})
    got = {r["request_id"]: r for r in replay.corrections(raw).collect()}
    assert (got["req-1"]["first_sql_hash"], got["req-1"]["corrected_sql_hash"]) == ("h1", "h2")
    assert got["req-1"]["has_correction"] and not got["req-2"]["has_correction"]


def test_rows_without_a_request_id_share_their_tenants_span(spark):
    raw = events(
        spark, {"event_type": "request_received", "request_id": None, "session_id": "s1"},
        {"event_type": "request_received", "request_id": None, "session_id": "s2", "tenant_id": "rival"},
        {"event_type": "response_returned", "request_id": None, "session_id": "s3"},
        {"event_type": "response_returned"}, {"event_type": "response_returned"},
        {"event_type": "response_returned", "request_id": None, "session_id": "s2", "tenant_id": "rival"})
    got = ledger.request_summary(ledger.staged_events(raw)).collect()
    assert sorted((r["tenant_id"], r["session_id"], r["total_request_ms"]) for r in got) == [
        ("acme", "s1", 2000), ("acme", "s3", 2000), ("acme", "sess-alice-001", 1000), ("rival", "s2", 4000)]


def test_request_risk_and_status(spark):
    raw = events(
        spark, {"event_type": "agent_boundary_violation", "boundary_violated": True, "status": "violation",
                "risk_flags": '["DDL_ATTEMPT"]', "ai_action_summary": "tried"},
        {"event_type": "sql_blocked", "status": "blocked", "request_id": "req-2", "error_message": "no DDL"},
        {"event_type": "request_received", "request_id": "req-3", "sensitivity_level": "CRITICAL"},
        {"event_type": "model_invoked", "request_id": "req-3", "sensitivity_level": "MEDIUM"},
        {"event_type": "model_invoked", "request_id": "req-4", "status": "failed"})
    got = {r["request_id"]: r for r in ledger.request_summary(ledger.staged_events(raw)).collect()}
    assert (got["req-1"]["risk_level"], got["req-1"]["request_status"]) == ("CRITICAL", "violation")
    assert got["req-1"]["boundary_violation_risks"] == '["DDL_ATTEMPT"]'
    assert (got["req-2"]["risk_level"], got["req-2"]["request_status"]) == ("HIGH", "blocked")
    assert got["req-3"]["highest_sensitivity_level"] == "CRITICAL"
    assert (got["req-4"]["risk_level"], got["req-4"]["request_status"]) == ("LOW", "failed")


def test_one_row_per_request_folds_run_ids(spark):
    raw = events(spark, {"event_type": "request_received"}, {"event_type": "tool_invoked", "etl_run_id": "run-1"})
    staged = ledger.staged_events(raw)
    assert ledger.request_summary(staged).count() == 2
    folded = ledger.request_summary(staged, one_row_per_request=True).collect()
    assert [(r["etl_run_id"], r["total_request_ms"]) for r in folded] == [("run-1", 1000)]


@pytest.mark.parametrize("bound", [40, 100_000])
def test_sequence_matches_plain_ranking_with_a_hot_group_and_missing_times(spark, bound):
    data = []
    start = dt.datetime(2024, 1, 1)
    for i in range(600):
        group = "hot" if i % 3 == 0 else f"g{i % 11}"
        # Spread times, a burst at one instant, and missing ones, so that pieces are cut by time and by id.
        ts = None if i % 7 == 0 else start if i % 5 == 0 else start + dt.timedelta(seconds=(i * 7919) % 5000 // 3)
        data.append((None if i % 29 == 0 else group, ts, f"event-id-{i:04d}"))
    data += [("same", start, "x")] * 20 + [("no id", start, None)] * 20
    df = spark.createDataFrame(data, "g string, ts timestamp_ntz, id string")
    got = sequence_in_group(df, ["g"], "ts", "id", bound).toPandas()
    assert len(got) == len(data) and set(got.columns) == {"g", "ts", "id", "event_sequence", "group_start", "group_end", "prev_ts"}
    got = got[["g", "id", "event_sequence", "prev_ts", "group_start", "group_end"]].fillna({"g": "-", "id": "-"})
    pdf = pd.DataFrame(data, columns=["g", "ts", "id"]).fillna({"g": "-", "id": "-"})
    pdf = pdf.sort_values(["g", "ts", "id"], na_position="last")
    pdf["event_sequence"] = pdf.groupby("g").cumcount() + 1
    pdf["prev_ts"] = pdf.groupby("g")["ts"].shift()
    pdf["group_start"], pdf["group_end"] = (pdf.groupby("g")["ts"].transform(f) for f in ("min", "max"))
    order = ["g", "event_sequence", "id"]
    pd.testing.assert_frame_equal(
        got.sort_values(order).reset_index(drop=True).astype(str),
        pdf[got.columns].sort_values(order).reset_index(drop=True).astype(str))


def test_only_large_groups_are_cut_and_into_few_pieces(spark):
    start = dt.datetime(2024, 1, 1)
    rows = spark.range(6000).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 997).cast("string"))).alias("g"),
        # Half of the hot group lies in one second of a year, a quarter has no time.
        F.when(F.col("id") % 8 == 0, None).when(F.col("id") % 4 == 0, F.lit(start)).otherwise(
            F.timestamp_add("SECOND", F.col("id").cast("int") * 5000, F.lit(start))).cast("timestamp_ntz").alias("ts"),
        F.format_string("event-%08d", "id").alias("e"))
    keyed = rows.withColumn("_g", F.struct("g")).withColumn("_k", F.struct("_g"))
    cut, any_cut = _split(keyed, "ts", "e", 100)
    sizes = [r["n"] for r in cut.groupBy("_g", "_k").agg(F.count("*").alias("n")).where("_g.g = 'hot'").collect()]
    assert any_cut and sum(sizes) == 3000 and max(sizes) <= 100 and len(sizes) <= 300
    assert cut.where("_g.g <> 'hot'").select("_k").distinct().count() == rows.where("g <> 'hot'").select("g").distinct().count()
    assert not _split(keyed, "ts", "e", 3000)[1]


def test_texts_are_joined_in_time_order_over_slices(spark):
    start = dt.datetime(2024, 1, 1)
    data = [("hot" if i % 3 else None, None if i % 13 == 0 else start + dt.timedelta(minutes=(i * 577) % 900),
             f"id{i:04d}", None if i % 5 == 0 else ("" if i % 7 == 0 else f"v{i}"), i % 2 == 0) for i in range(300)]
    df = spark.createDataFrame(data, "g string, ts timestamp_ntz, id string, v string, ok boolean")
    got = {r["_g"]["g"]: r["x"] for r in ordered_texts(df, ["g"], "ts", "id", {"x": ("v", "ok", "|")}).collect()}
    for g in ("hot", None):
        rows = sorted((r for r in data if r[0] == g and r[4] and r[3] is not None),
                      key=lambda r: (r[1] is None, r[1] or start, r[2]))
        assert got[g] == "|".join(r[3] for r in rows)


@pytest.mark.parametrize("p", [0.0, 0.5, 0.95, 1.0])
def test_percentiles_match_pandas_on_skewed_values(spark, p):
    values = [("a", float((i * i) % 977)) for i in range(500)] + [("a", 3.0)] * 400 + [("b", 7.0)] + [(None, float(i)) for i in range(10)]
    df = spark.createDataFrame(values, "k string, v double")
    got = {r["k"]: r["x"] for r in exact_percentiles(df, ["k"], "v", {"x": p}).collect()}
    pdf = pd.DataFrame(values, columns=["k", "v"])
    assert got["a"] == pytest.approx(pdf[pdf.k == "a"].v.quantile(p))
    assert got["b"] == 7.0
    assert got[None] == pytest.approx(pdf[pdf.k.isna()].v.quantile(p))


def test_emitted_events_mask_credentials_before_hashing(spark):
    rows = events(spark, {"sql_text": "select 1 -- password=abcdefgh1", "policy_result": "PASSED"})
    got = emit.to_trace_events(rows.drop("trace_id", "event_timestamp"), "sql_validated").first()
    assert got["sql_text"] == "select 1 -- [REDACTED]"
    assert got["event_type"] == "sql_validated" and got["trace_id"] and got["event_timestamp"].endswith("Z") or "+" in got["event_timestamp"]
    assert got["ai_action_summary"] == "SQL validation: PASSED"
    denied = emit.to_trace_events(rows.withColumn("passed", F.lit(False)), "policy_check").first()
    assert (denied["event_type"], denied["status"]) == ("policy_check_failed", "blocked")


def test_sync_modes(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, at int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 1)], "id int, v string, at int")
    up = {r["id"]: r["v"] for r in sync(old, new, "incremental", ["id"], ["at"]).collect()}
    assert up == {1: "a", 2: "c", 3: "d"}
    assert sync(old, new, "append").count() == 4
    assert sync(old, new, "full_refresh").count() == 2
    with pytest.raises(ValueError):
        sync(old, new, "upsert")


def test_metric_report_builds_each_mart_once(spark):
    raw = with_legacy(events(spark, *[
        {"event_type": t, "tenant_id": ten, "workspace_id": w, "request_id": f"r{i % 3}", "pii_detected": i % 2 == 0,
         "model_name": "m", "datasource_name": "d"}
        for i, (t, ten, w) in enumerate([("request_received", "acme", "w"), ("sql_generated", "acme", "w"),
                                         ("sql_blocked", "acme", None), ("sql_generated", "zeta", "w"),
                                         ("sql_executed", "zeta", "v"), ("model_invoked", "zeta", "v")])]))
    staged = ledger.staged_events(raw)
    names = ["total_user_requests", "total_sql_blocked_by_user", "pii_sql_generations", "avg_model_error_rate"]
    out = metrics.metric_report(staged, names, ["tenant_id", "workspace_id"], [["tenant_id", "workspace_id"], ["tenant_id"], []])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # One aggregation over grouping sets per mart: users, generations, models.
    assert sum("Aggregate [" in x and "spark_grouping_id" in x for x in plan.splitlines()) == 3
    rows = {(r.grain, r.tenant_id, r.workspace_id, r.metric): r.value for r in out.collect()}
    for grain, by in ((0, ["tenant_id", "workspace_id"]), (1, ["tenant_id"]), (3, [])):
        for name in names:
            for r in metrics.metrics(staged, [name], by).collect():
                key = (grain, r["tenant_id"] if grain < 3 else None, r["workspace_id"] if grain < 1 else None, name)
                want = r[name]
                assert rows.pop(key) == (None if want is None else pytest.approx(float(want)))
    assert not rows
    with pytest.raises(KeyError):
        metrics.metric_report(staged, ["no_such_metric"], ["tenant_id"], [[]])
