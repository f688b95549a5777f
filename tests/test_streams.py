"""Stateful streams over restarts, state that ends, and the ledger's id filters."""

from __future__ import annotations

import time
from datetime import timedelta
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from traceworks import fixtures as fx
from traceworks.plans import cost
from traceworks.plans.ledger import SESSION_KEYS, session_summary, staged_events
from traceworks.sources.ledger_store import BITS, ParquetLedger, _bit, _is_set, _words
from traceworks.streaming import budget_stream, ledger_stream, session_state

SF = "/root/testdata/sf0.001"
CALL = "run_id string, model string, prompt_tokens int, completion_tokens int, call_ts string"


def finished(q):
    q.awaitTermination()
    assert q.exception() is None
    return q


def numbers(q):
    return [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]


@pytest.fixture(scope="module")
def raw(spark):
    return fx.trace_events(spark, SF)


def test_filters_open_only_the_cells_that_may_hold_an_id(spark, tmp_path):
    ledger = ParquetLedger(spark, str(tmp_path / "l"))
    rows = spark.range(3000).select(
        F.concat(F.lit("e"), "id").alias("trace_id"),
        F.date_format(F.timestamp_seconds(F.col("id") % 10 * 86_400), "yyyy-MM-dd'T'HH:mm:ss").alias("event_timestamp"),
        F.lit(0).alias("ingest_seq"))
    ledger.append(rows)
    known = rows.where("trace_id = 'e7'")
    cells = ledger.cells_hit(known)
    assert ("1970-01-08", ledger.placed(known).first()["id_bucket"]) in cells and len(cells) <= 2
    opened = ledger.stored_ids(known)
    plan = opened._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "event_date" in pruned and "id_bucket" in pruned and "ReadSchema: struct<trace_id:string>" in plan
    files = opened.select(F.input_file_name().alias("f")).distinct().collect()
    assert 1 <= len(files) <= 2 < spark.read.parquet(ledger.path).select(F.input_file_name()).distinct().count()
    new = spark.createDataFrame([(f"new{i}", "1970-01-03T00:00:00", 0) for i in range(50)], rows.schema)
    assert len(ledger.cells_hit(new)) <= 4


def test_copies_under_another_day_lose(spark, tmp_path):
    ledger = ParquetLedger(spark, str(tmp_path / "l"))
    kind = "trace_id string, event_timestamp string, question_text string, ingest_seq int"

    def rows(*given):
        return spark.createDataFrame([(*g, 0) for g in given], kind)

    ledger.append(rows(("a", "2024-01-01T00:00:00", "first"), ("b", None, "no day")))
    ledger.append(rows(("a", "2024-02-09T00:00:00", "TAMPERED"), ("b", "2024-01-01T00:00:00", "TAMPERED"), ("c", "x", "bad day")))
    ledger.merge_filters()
    ledger.append(rows(("c", "2024-02-09T00:00:00", "TAMPERED"), ("d", "2024-02-09T00:00:00", "new")))
    assert sorted((r.trace_id, r.question_text) for r in ledger.read().collect()) == [
        ("a", "first"), ("b", "no day"), ("c", "bad day"), ("d", "new")]
    with pytest.raises(ValueError):
        ParquetLedger(spark, ledger.path, buckets=8).append(rows(("a", None, "x")))


def test_bits_are_read_as_they_were_set(spark):
    positions = [0, 1, 7, 8, 4095, BITS - 1]
    bits = spark.createDataFrame([(p,) for p in positions], "p int").agg(F.bitmap_construct_agg("p").alias("bits"))
    got = bits.select(*[_is_set(F.col("bits"), F.lit(p)).alias(str(p)) for p in [*positions, 2, 9, 4096]]).first()
    assert list(got) == [True] * 6 + [False] * 3


def test_totals_end_when_nothing_was_spent_for_a_while(spark, tmp_path):
    inbox, log, mark = (str(tmp_path / n) for n in ("in", "log", "ck"))
    kept = dict.fromkeys(budget_stream.KEPT, timedelta(days=1)) | {"per_run": timedelta(seconds=1)}
    for wait in (0, 3):
        time.sleep(wait)
        spark.createDataFrame([("r1", "gpt-4o", 100_000, 20_000, "2024-01-01T00:00:00")], CALL).write.mode("append").parquet(inbox)
        finished(budget_stream.alerts(spark.readStream.schema(CALL).parquet(inbox), log, mark,
                                      cost.Budget(per_run=1.0, per_day=1.0), kept=kept))
    rows = budget_stream.reported(spark, log).collect()
    # The run's first 0.8 USD were forgotten, so it never gets to STOP; the day's were not.
    assert sorted((r.limit_type, r.level) for r in rows if r.limit_type != "per_month") == [
        ("per_day", "STOP"), ("per_day", "WARN"), ("per_run", "WARN"), ("per_run", "WARN")]


def test_sessions_grow_over_restarts_without_reading_old_events(spark, raw, tmp_path):
    inbox, ledger, out, mark, seen = (str(tmp_path / n) for n in ("in", "ledger", "out", "ck", "seen"))
    third = F.pmod(F.xxhash64("trace_id"), F.lit(3))
    read = []
    for k in range(3):
        part = raw.where(third == k)
        if k:  # copies of the part before, altered, arrive again
            part = part.unionByName(raw.where(third == k - 1).withColumn("model_name", F.lit("TAMPERED")))
        part.write.mode("append").parquet(inbox)
        finished(ledger_stream.ingest(spark.readStream.schema(raw.schema).parquet(inbox), ledger, mark))
        read += numbers(finished(ledger_stream.roll_up_sessions(spark, ledger, out, seen)))
    assert sum(read) == raw.count() and len(read) == 3
    got = ledger_stream.current_sessions(spark, out)
    want = session_summary(staged_events(raw)).select(got.columns)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() > 100


def test_idle_sessions_leave_the_state(spark, raw, tmp_path):
    ledger, out, seen = (str(tmp_path / n) for n in ("ledger", "out", "seen"))
    one = raw.where("user_id is not null and tenant_id is not null").orderBy("trace_id").limit(1).drop("ingest_seq")
    for k, (session, wait) in enumerate([("a", 0), ("a", 0), ("b", 4), ("a", 0)]):
        time.sleep(wait)
        ParquetLedger(spark, ledger).append(one.withColumns({"trace_id": F.lit(f"t{k}"), "session_id": F.lit(session)}))
        finished(ledger_stream.roll_up_sessions(spark, ledger, out, seen, idle=timedelta(seconds=3)))
    rows = spark.read.option("basePath", out).parquet(f"{out}/batch=*").orderBy("batch").collect()
    # The third batch ends the first session's state; what comes after starts it anew.
    assert [(r.session_id, r.total_events) for r in rows][2:] == [("b", 1), ("a", 1)] and rows[0].total_events == 1


class Calls:
    """State of one session in memory that counts what is asked of it."""

    def __init__(self):
        self.n, self.total, self.ids, self.texts = 0, None, {}, []

    def call(self, result=None):
        self.n += 1
        return result

    def getValueState(self, name, schema):
        return SimpleNamespace(get=lambda: self.call(self.total), update=lambda row: self.call(setattr(self, "total", row)))

    def getMapState(self, name, key, value):
        return SimpleNamespace(containsKey=lambda k: self.call(k in self.ids), updateValue=lambda k, v: self.call(self.ids.update({k: v})))

    def getListState(self, name, schema):
        return SimpleNamespace(get=lambda: self.call(iter(self.texts)), appendList=lambda rows: self.call(self.texts.extend(rows)))

    def registerTimer(self, at):
        self.call()

    deleteTimer = registerTimer
    getCurrentProcessingTimeInMs = staticmethod(lambda: 0)


def test_an_ordinary_session_asks_little_of_the_state():
    state, session = Calls(), session_state.Session(timedelta(days=1))
    session.init(state)

    def add(*ids):
        before = state.n
        row = SimpleNamespace(at_min="a", at_max="b", request_id_distinct=[*ids, None], model_name_distinct=[], datasource_name_distinct=[],
                              risk_list=[])
        sums = {f"{t}_sum": 1 for t in ["total_events", *session_state.TALLIES]}
        row = type("Part", (SimpleNamespace,), {"__getitem__": lambda _, k: sums[k]})(**vars(row))
        (out,) = session.handleInputRows(("t", "w", "u", "s"), [row, row], state)
        return state.n - before, out.total_requests

    assert add("r1", "r2", "r3") == (3, 3)
    assert add("r1", "r4") == (4, 4)
    _, requests = add(*[f"r{k}" for k in range(60)])
    assert requests == 60 and len(state.ids) == 60 - session_state.INLINE
    assert add(*[f"r{k}" for k in range(60)])[1] == 60 and len(state.ids) == 60 - session_state.INLINE


def test_texts_beyond_the_first_are_kept_in_order():
    state, session = Calls(), session_state.Session(timedelta(days=1))
    session.init(state)
    for first in (0, 50):
        row = dict(at_min=None, at_max=None, request_id_distinct=[], model_name_distinct=["m"], datasource_name_distinct=[],
                   risk_list=[f"0\x01{k:03}\x01id\x01x{k}" for k in reversed(range(first, first + 50))])
        sums = {f"{t}_sum": 1 for t in ["total_events", *session_state.TALLIES]}
        part = type("Part", (SimpleNamespace,), {"__getitem__": lambda _, k: sums[k]})(**row)
        (out,) = session.handleInputRows(("t", "w", "u", "s"), [part], state)
    assert out.boundary_violation_risks == ", ".join(f"x{k}" for k in range(100))
    assert len(state.texts) == 100 - session_state.INLINE


class Held:
    """State of one shelf in memory."""

    def __init__(self):
        self.now, self.timers, self.maps = 0, set(), {}

    def getValueState(self, name, schema):
        kept = [None]
        return SimpleNamespace(get=lambda: kept[0], update=lambda row: kept.__setitem__(0, row), clear=lambda: kept.__setitem__(0, None))

    def getMapState(self, name, key, value):
        entries = self.maps[name] = {}
        return SimpleNamespace(containsKey=entries.__contains__, getValue=entries.get, updateValue=entries.__setitem__,
                               removeKey=entries.pop, keys=lambda: iter(list(entries)))

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def getCurrentProcessingTimeInMs(self):
        return self.now


def shelf_of(state, idle_ms):
    shelf = session_state.Shelf(timedelta(milliseconds=idle_ms))
    shelf.init(state)

    def add(at, *given):
        state.now = at
        sums = [[1 for _ in given] for _ in session_state.SUMS]
        texts = [[f"0\x01{k:03}\x01id\x01x{k}" for k in range(n)] for _, _, n in given]
        columns = [[0 for _ in given], *([v for _ in given] for v in ("t", None, "u\t\n\"é")), [s for s, _, _ in given], *sums,
                   [None for _ in given], [None for _ in given], [ids for _, ids, _ in given], [["m"] for _ in given], [[None] for _ in given], texts]
        packed = session_state.shelved(pa.table(columns, ["shelf", *SESSION_KEYS, *session_state.PART])).to_pylist()
        assert len(packed) == 1
        (out,) = shelf.handleInputRows((0,), [SimpleNamespace(**r) for r in packed], state)
        (rows,) = session_state.unpacked([pa.record_batch([[out.rows]], ["rows"])])
        return {r["session_id"]: r for r in rows.to_pylist()}

    def wake(at):
        state.now = at
        for timer in [t for t in state.timers if t < at]:
            assert list(shelf.handleExpiredTimer((0,), state, None)) == []
            state.timers.discard(timer)

    return add, wake


def test_sessions_of_a_shelf_end_one_by_one():
    state = Held()
    add, wake = shelf_of(state, 10)
    ids = [f"r{k}" for k in range(50)]
    assert add(0, ("a", ids, 0), ("b", ["r"], 40))["a"]["total_requests"] == 50
    got = add(5, ("b", ["r", "s"], 10))["b"]
    assert (got["total_events"], got["total_requests"], got["boundary_violation_risks"].count("x")) == (2, 2, 50)
    assert state.timers == {10} and len(state.maps["requests"]) == 50 - session_state.INLINE and len(state.maps["risks"]) == 2
    wake(11)
    assert state.timers == {15} and not state.maps["requests"] and len(state.maps["risks"]) == 2
    assert add(12, ("a", ["r1"], 0))["a"]["total_events"] == 1
    # An event in the first batch after its end still finds the session; the other one ends.
    assert add(40, ("a", ["r2"], 0))["a"]["total_requests"] == 2
    assert state.timers == {50} and not state.maps["risks"]
    wake(51)
    assert state.timers == set() and add(60, ("b", [None], 0))["b"]["total_events"] == 1


def test_partial_results_are_added_in_pieces(monkeypatch):
    monkeypatch.setattr(session_state, "AT_ONCE", 3)
    add, _ = shelf_of(Held(), 10)
    got = add(0, *[(s, [f"r{k}", f"r{k + 1}"], k) for k in range(60) for s in "ab"])
    assert got["a"] == got["b"] | {"session_id": "a"}
    assert (got["a"]["total_events"], got["a"]["total_requests"], got["a"]["models_used"]) == (60, 61, "m")
    assert got["a"]["boundary_violation_risks"].count("x") == sum(range(60))


def test_many_sessions_are_few_entries_of_the_state(spark, raw, tmp_path):
    ledger, out, seen = (str(tmp_path / n) for n in ("ledger", "out", "seen"))
    n = 3 * session_state.SHELVES
    one = raw.where("user_id is not null and tenant_id is not null").orderBy("trace_id").limit(1).drop("trace_id", "session_id").collect()
    rows = spark.createDataFrame(one, raw.drop("trace_id", "session_id").schema).crossJoin(
        spark.range(n).select(F.concat(F.lit("t"), "id").alias("trace_id"), F.concat(F.lit("s"), "id").alias("session_id")))
    ParquetLedger(spark, ledger).append(rows)
    q = finished(ledger_stream.roll_up_sessions(spark, ledger, out, seen))
    updated = sum(o["numRowsUpdated"] for p in q.recentProgress for o in p["stateOperators"])
    assert 0 < updated <= session_state.SHELVES
    got = ledger_stream.current_sessions(spark, out)
    want = session_summary(staged_events(rows)).select(got.columns)
    assert got.count() == n and got.exceptAll(want).count() == 0


def test_long_sessions_over_restarts_and_after_their_end(spark, raw, tmp_path):
    ledger, out, seen = (str(tmp_path / n) for n in ("ledger", "out", "seen"))
    known = raw.where("user_id is not null and tenant_id is not null").orderBy("trace_id").limit(1).drop("ingest_seq").collect()
    one = spark.createDataFrame(known, raw.drop("ingest_seq").schema)

    def add(k, session, first, last):
        at = F.concat(F.lit(f"{k}-"), F.col("id").cast("string"))
        rows = one.drop("trace_id", "session_id", "workspace_id", "request_id", "boundary_violated", "risk_flags").crossJoin(
            spark.range(first, last).select(
                at.alias("trace_id"), F.lit(session).alias("session_id"), F.lit(None).cast("string").alias("workspace_id"),
                F.concat(F.lit("r"), "id").alias("request_id"), F.lit(True).alias("boundary_violated"),
                F.concat(F.lit("risk\t\n"), "id").alias("risk_flags")))
        ParquetLedger(spark, ledger).append(rows)
        finished(ledger_stream.roll_up_sessions(spark, ledger, out, seen, idle=timedelta(seconds=8)))
        (got,) = [r for r in ledger_stream.current_sessions(spark, out).collect() if r.session_id == session]
        want = session_summary(staged_events(spark.read.parquet(ledger).where(F.col("session_id") == session)))
        return got, want

    long = "a\t\n\"é"
    add(0, long, 0, 50)
    got, want = add(1, long, 40, 100)
    assert got == want.select(*got.asDict()).first() and (got.total_requests, got.boundary_violations) == (100, 110)
    time.sleep(9)
    add(2, "b", 0, 1)
    assert add(3, long, 0, 40)[0].total_requests == 40
    got, _ = add(4, long, 40, 100)
    assert (got.total_requests, got.total_events, got.boundary_violation_risks.count("risk")) == (100, 100, 100)


def test_words_hold_the_bits_of_a_bitmap(spark, tmp_path):
    positions = [*range(0, 130, 3), 63, 64, BITS - 64, BITS - 1]
    bits = spark.createDataFrame([(p,) for p in positions], "p int").agg(F.bitmap_construct_agg("p").alias("bits"))
    words = bits.select(_words(F.col("bits")).alias("words"))
    got = words.crossJoin(spark.range(BITS).select(F.col("id").cast("int").alias("p"))).where(_bit(F.col("words"), F.col("p")))
    assert sorted(r.p for r in got.select("p").collect()) == sorted(set(positions))
