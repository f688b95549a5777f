"""Tables changed file by file, the price-bar source, and table functions."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from traceworks.functions import tablefuncs
from traceworks.sources import bars_source
from traceworks.sources.file_table import Conflict, FileTable


@pytest.fixture
def ten(spark, tmp_path):
    """A table of ten files with ten rows each."""
    table = FileTable(spark, str(tmp_path / "t"))
    for k in range(10):
        table.append(spark.range(10 * k, 10 * k + 10, 1, 1).withColumn("v", F.lit(0)))
    return table


def ids(table, version=None):
    return sorted(r.id for r in table.read(version).collect())


def test_a_delete_rewrites_only_the_files_it_touches(ten):
    before = set(ten.files())
    assert len(before) == 10
    ten.delete(F.col("id").isin(13, 57))
    after = set(ten.files())
    assert len(before - after) == 2 and len(before & after) == 8
    assert ids(ten) == [i for i in range(100) if i not in (13, 57)]
    assert ids(ten, 10) == list(range(100))
    version = ten.version()
    assert ten.delete(F.col("id") == 1000) == version and ten.delete(F.lit(None).cast("boolean")) == version


def test_an_upsert_rewrites_the_files_of_its_keys(spark, ten):
    before = set(ten.files())
    ten.upsert(spark.createDataFrame([(5, 1), (6, 2), (200, 3)], "id long, v int"), ["id"], ["v"])
    assert len(before & set(ten.files())) == 9
    got = {r.id: r.v for r in ten.read().collect()}
    assert got == {i: 0 for i in range(100)} | {5: 1, 6: 2, 200: 3}
    ten.sync(spark.createDataFrame([(5, 0)], "id long, v int"), "upsert", ["id"], ["v"])
    assert {r.id: r.v for r in ten.read().collect()}[5] == 1


def test_truncate_and_load(spark, ten):
    ten.sync(spark.range(3).withColumn("v", F.lit(9)), "truncate")
    assert ids(ten) == [0, 1, 2] and ten.clean() == 10 and ids(ten) == [0, 1, 2]
    with pytest.raises(ValueError):
        ten.sync(spark.range(1), "other")


def test_a_job_that_stops_half_way_loses_nothing(ten, monkeypatch):
    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(ten, "_publish", stop)
        with pytest.raises(RuntimeError):
            ten.delete(F.col("id") < 50)
    assert ids(ten) == list(range(100))
    ten.delete(F.col("id") < 50)
    assert ids(ten) == list(range(50, 100))


def test_the_slower_of_two_writers_is_told(spark, ten):
    names, version = ten.files(), ten.version()
    ten.append(spark.range(0, 1, 1, 1).withColumn("v", F.lit(0)))
    with pytest.raises(Conflict):
        ten._publish(names, version)
    assert len(ten.files()) == 11
    assert FileTable(spark, ten.path + "-none").read() is None


@pytest.fixture
def bars(spark, tmp_path):
    """Two files: one of four row groups, a ticker each, and one more."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder = str(tmp_path / "bars")
    os.makedirs(folder)
    for name, tickers in (("a", "ABCD"), ("b", "E")):
        n = 50 * len(tickers)
        rows = pa.table({
            "ticker": [t for t in tickers for _ in range(50)], "tf": ["1d"] * n,
            "ts": pa.array([dt.datetime(2024, 1, 1) + dt.timedelta(days=i % 50) for i in range(n)], pa.timestamp("us")),
            **{c: pa.array([float(i) for i in range(n)]) for c in ("open", "high", "low", "close")}, "volume": list(range(n))})
        pq.write_table(rows, f"{folder}/{name}.parquet", row_group_size=50)
    bars_source.register(spark)
    return folder


def test_bars_of_a_uri_are_read_range_by_range(spark, bars):
    want = sorted(tuple(r) for r in spark.read.parquet(bars).select("ticker", "ts", "close", "volume").collect())
    for path, size in ((bars, 1 << 26), (f"file://{bars}", 700)):
        df = spark.read.format("bars").option("rangeBytes", size).load(path)
        assert sorted(tuple(r) for r in df.select("ticker", "ts", "close", "volume").collect()) == want
    assert spark.read.format("bars").option("rangeBytes", 700).load(bars).rdd.getNumPartitions() > 4


def test_a_ticker_filter_skips_row_groups(spark, bars):
    import pyarrow.parquet as pq

    file = pq.ParquetFile(f"{bars}/a.parquet")
    assert bars_source.row_groups(file, 0, 1 << 62, []) == [0, 1, 2, 3]
    assert bars_source.row_groups(file, 0, 1 << 62, [("=", "ticker", "C")]) == [2]
    assert bars_source.row_groups(file, 0, 1 << 62, [("in", "ticker", ["A", "D"]), (">", "close", 100.0)]) == [3]
    halves = [bars_source.row_groups(file, *r, []) for r in ((0, 3000), (3000, 1 << 62))]
    assert sorted(sum(halves, [])) == [0, 1, 2, 3]
    reader = bars_source._BarReader({"path": bars}, ["ticker", "close"])
    left = list(reader.pushFilters([bars_source.EqualTo(("ticker",), "C"), bars_source.GreaterThan(("close",), 120.0)]))
    assert len(left) == 2 and reader.tests == [("=", "ticker", "C"), (">", "close", 120.0)]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 50
    got = spark.read.format("bars").load(bars).where("ticker = 'C' and close > 120")
    assert got.count() == spark.read.parquet(bars).where("ticker = 'C' and close > 120").count() > 0


def test_bars_as_a_stream_read_each_file_once(spark, bars, tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "ck")
    counts = []
    for k in range(3):
        if k == 1:
            spark.read.parquet(f"{bars}/b.parquet").coalesce(1).write.parquet(f"{bars}/more")
        q = spark.readStream.format("bars").load(bars).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", mark).trigger(once=True).start()
        q.awaitTermination()
        assert q.exception() is None
        counts.append(spark.read.parquet(out).count())
    assert counts == [250, 300, 300]


def test_violation_rows_take_any_conditions(spark):
    tablefuncs.register(spark)
    spark.createDataFrame([(1, True, None), (2, False, True), (3, True, True)], "id int, a boolean, b boolean").createOrReplaceTempView("given")
    got = spark.sql("select id, violation from given, lateral violation_rows(late => a, `too big` => b, never => false)")
    assert sorted(map(tuple, got.collect())) == [(1, "late"), (2, "too big"), (3, "late"), (3, "too big")]
    for bad in ("violation_rows()", "violation_rows(x => 1)"):
        with pytest.raises(Exception):
            spark.sql(f"select * from {bad}").collect()


def test_column_counts_of_any_table(spark):
    tablefuncs.register(spark)
    spark.createDataFrame([(1, "a"), (None, "abc"), (3, None), (44, None)], "x int, y string").repartition(3).createOrReplaceTempView("cells")
    got = spark.sql("select column_name, sum(rows) as n, sum(nulls) as nulls, max(longest) as longest "
                    "from column_counts(table(cells)) group by 1")
    assert sorted(map(tuple, got.collect())) == [("x", 4, 1, 2), ("y", 4, 2, 3)]
    by = spark.sql("select * from column_counts(table(select * from cells) partition by y)").where("column_name = 'y'")
    assert sorted((r.rows, r.nulls) for r in by.collect()) == [(1, 0), (1, 0), (2, 2)]


def test_no_record_batch_is_made_per_row(spark):
    tablefuncs.register(spark)
    spark.range(5).selectExpr("id", "id > 2 as late").createOrReplaceTempView("many")
    for call in ("column_counts(table(many))", "many, lateral violation_rows(late => late)"):
        plan = spark.sql(f"select * from {call}")._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPythonUDTF" in plan and "ArrowEvalPythonUDTF" not in plan
