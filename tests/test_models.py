import datetime as dt

import pytest
from pyspark.sql import functions as F

from test_ledger import events
from traceworks.plans import data_tests, ledger
from traceworks.sources import bar_rows


def test_failing_data_tests_store_the_rows_they_reject(spark, tmp_path):
    raw = events(spark, {"event_type": "request_received"}, {"event_type": "request_received", "status": "lost"},
                 {"event_type": "request_received", "trace_id": "t0", "request_id": None})
    staged = ledger.staged_events(raw)
    models = ["stg_trace_events", "int_request_timeline", "rpt_model_usage"]
    got = {(r["model"], r["test"]): r["failures"] for r in data_tests.model_results(staged, models).collect()}
    assert len(got) == sum(len(data_tests.MODEL_TESTS[m]) for m in models)
    bad = {k for k, n in got.items() if n}
    assert bad == {("stg_trace_events", "accepted_values_status"), ("stg_trace_events", "unique_trace_id"),
                   ("int_request_timeline", "unique_trace_id"), ("int_request_timeline", "not_null_request_id")}
    folders = data_tests.store_failures(staged, str(tmp_path), models)
    assert set(folders) == {".".join(k) for k in bad}
    rows = spark.read.parquet(folders["stg_trace_events.accepted_values_status"]).collect()
    assert [r["status"] for r in rows] == ["lost"]
    source = {r["test"]: r["failures"] for r in data_tests.source_results(raw).collect()}
    assert source["not_null_request_id"] == 1 and source["unique_trace_id"] == 1 and source["accepted_values_status"] == 1


def test_every_model_has_tests_and_tests_only_name_its_columns(spark):
    staged = ledger.staged_events(events(spark, {"event_type": "request_received"}))
    assert set(data_tests.MODELS) == set(data_tests.MODEL_TESTS) and len(data_tests.MODELS) == 18
    for name, tests in data_tests.MODEL_TESTS.items():
        assert {t.column for t in tests} <= set(data_tests.MODELS[name](staged).columns)


def test_daily_rows_close_at_the_adjusted_price(spark):
    rows = spark.createDataFrame(
        [("A", "2024-01-02", 10.0, 4.0), ("A", "2024-01-03", 11.0, None), ("A", "no date", 1.0, 1.0)],
        "ticker string, date string, close double, adjusted_close double").withColumns(
        {"open": F.lit(1.0), "high": F.lit(2.0), "low": F.lit(0.5), "volume": F.lit(7)})
    assert [(r["ts"], r["close"], r["tf"]) for r in bar_rows.dated_bars(rows).collect()] == [
        (dt.datetime(2024, 1, 2), 4.0, "1d")]
    plain = bar_rows.dated_bars(rows.drop("adjusted_close")).orderBy("ts").collect()
    assert [r["close"] for r in plain] == [10.0, 11.0]
    minutes = bar_rows.dated_bars(rows.withColumn("datetime", F.lit("2024-01-02 10:05:00")), "5m").collect()
    assert [r["close"] for r in minutes] == [10.0, 11.0, 1.0] and minutes[0]["ts"] == dt.datetime(2024, 1, 2, 10, 5)
    with pytest.raises(ValueError, match="volume"):
        bar_rows.dated_bars(rows.drop("volume"))


def test_epoch_milliseconds_become_utc_times(spark):
    rows = spark.createDataFrame([("A", 1704189600250, 1.0, 2.0, 0.5, 1.5, 9), ("A", None, 1.0, 2.0, 0.5, 1.5, 9),
                                  ("A", 1704189600000, 1.0, 2.0, 0.5, None, 9)],
                                 "ticker string, t long, o double, h double, l double, c double, v long")
    got = bar_rows.epoch_bars(rows, "5m").collect()
    assert [(r["ts"], r["close"], r["volume"]) for r in got] == [(dt.datetime(2024, 1, 2, 10, 0, 0, 250000), 1.5, 9)]
