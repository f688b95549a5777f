"""Profiles that merge, the metadata index that is built when its content changes, and ids made from rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from traceworks.operators import profile
from traceworks.plans import emit, retrieval


def test_adding_a_day_merges_one_partial(spark, tmp_path):
    days = [spark.range(1000 * d, 1000 * d + 1500).select(
        F.col("id"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("v"), F.col("id") % 40)).alias("word")) for d in range(3)]
    path = str(tmp_path / "partials")
    for d, rows in enumerate(days):
        profile.profile_partial(rows, f"day {d}").write.mode("append").parquet(path)
    profile.profile_partial(days[2], "day 2").write.mode("append").parquet(path)
    got = {r.column_name: r for r in profile.merged_profile(spark.read.parquet(path)).collect()}
    want = {r.column_name: r for r in profile.column_profile(days[0].union(days[1]).union(days[2])).collect()}
    for name, w in want.items():
        g = got[name]
        assert (g.type, g.row_count, g.null_count, g.null_pct, g.low_cardinality) == (
            w.type, w.row_count, w.null_count, w.null_pct, w.low_cardinality)
        assert g.distinct_count == pytest.approx(w.distinct_count, rel=0.03)
    assert got["word"].distinct_count == 30


def test_no_cell_text_is_shuffled(spark):
    rows = spark.range(10).select(F.repeat(F.lit("long text "), 100).alias("t"))
    plan = profile.column_profile(rows)._jdf.queryExecution().executedPlan().toString()
    exchange = next(line for line in plan.splitlines() if "Exchange hashpartitioning(column_name" in line)
    assert "value" not in exchange and profile.column_profile(rows).first()["distinct_count"] == 1


def test_the_index_is_built_for_new_content_only(spark, tmp_path):
    index = retrieval.MetadataIndex(spark, str(tmp_path / "index"))
    embed = retrieval.hash_embedder(8)
    texts = spark.createDataFrame([(1, "orders by day"), (2, "customers"), (3, "parts")], "doc_id long, text string")
    assert index.refresh(texts.repartition(3), embed) and index.stored.version() == 1
    assert not index.refresh(texts.orderBy("text"), embed) and index.stored.version() == 1
    asked = spark.createDataFrame([(7, embed(["customers"])[0])], "query_id long, query_vector array<float>")
    assert [r.doc_id for r in index.search(asked, 1).collect()] == [2]
    changed = texts.withColumn("text", F.when(F.col("doc_id") == 3, "customers all").otherwise(F.col("text")))
    assert index.refresh(changed, embed) and index.stored.version() == 2
    assert not index.refresh(changed, embed, index.content_of(changed)) and index.refresh(changed, embed, "hash of a manifest")
    assert len(index.read().collect()) == 3


def test_ids_come_from_the_row(spark):
    rows = spark.createDataFrame([("t", "u", "what?"), ("t", "u", "why?"), ("t", "v", "what?")],
                                 "tenant_id string, user_id string, question_text string")
    one, two = ({r.question_text + r.user_id: (r.trace_id, r.request_id) for r in emit.to_trace_events(
        d, "model_invoked").collect()} for d in (rows, rows.repartition(3)))
    assert one == two and len({i for pair in one.values() for i in pair}) == 6
    assert all(len(i) == 36 and i.count("-") == 4 for pair in one.values() for i in pair)


def test_kinds_are_made_together_as_one_by_one(spark, tmp_path):
    spark.createDataFrame(
        [("t1", "r1", "ok", "token=abcdefgh12", None), (None, "r2", None, "select 1", "bad  row"), ("t3", "", "failed", None, ""),
         ("t4", None, "ok", "", None), (None, None, None, None, None), ("t1", "r1", "ok", "token=abcdefgh12", None)],
        "trace_id string, request_id string, status string, sql_text string, error_message string").withColumn(
        "event_timestamp", F.lit("2024-01-01T00:00:00")).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    kinds = ["sql_validated", "agent_boundary_violation"]
    got = emit.events_of_kinds(rows, kinds)
    want = None
    for kind in kinds:
        one = emit.to_trace_events(rows, kind).select(F.lit(kind).alias("kind"), "*")
        want = one if want is None else want.unionByName(one)
    made, one_by_one = (sorted(map(repr, df.collect())) for df in (got, want))
    assert got.columns == want.columns and made == one_by_one and len(made) == 12
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2
