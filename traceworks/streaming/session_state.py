"""Session rows from partial results that the state store holds; no event is read twice."""

from __future__ import annotations

import json
import pickle
import zlib
from collections import defaultdict
from collections.abc import Iterator
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from traceworks.functions.times import minutes_between
from traceworks.operators.aggregates import first_match, safe
from traceworks.plans.ledger import PII, SESSION_KEYS
from traceworks.streaming.state import combined

#: A session's state ends when it had no event for so long.
IDLE = timedelta(days=7)
#: Counted conditions, as in the batch report.
TALLIES = {
    "sql_events": "is_sql_event", "sql_generated_count": "event_type = 'sql_generated'",
    "sql_executed_count": "event_type = 'sql_executed'", "sql_blocked_count": "event_type = 'sql_blocked'", "policy_blocks": "is_policy_blocked", "error_events": "is_error",
    "human_corrections": "is_human_correction", "agent_events": "is_agent_event",
    "boundary_violations": "is_boundary_violation", "high_sensitivity_events": "is_high_sensitivity", "pii_events": PII}
SETS = ["request_id", "model_name", "datasource_name"]
KEY_TYPES = ", ".join(f"{k} string" for k in SESSION_KEYS)
STATE = (f"{KEY_TYPES}, started string, ended string, total_requests long, models_used string, datasources_accessed string, "
         f"distinct_models_used long, total_events long, {', '.join(f'{t} long' for t in TALLIES)}, boundary_violation_risks string")
OUT = Row(*[c.split()[0] for c in STATE.split(", ")])
#: So many request ids and violation texts of a session stand in its totals; the others are entries of their own.
INLINE = 32
#: Between the parts of a text that sorts by time, then id.
BREAK = "\x01"
#: Sessions share so many entries of the state, dealt by hash. Fixed for the life of a checkpoint.
SHELVES = 4096
#: Partial results of a shelf are added to its sessions once they hold so many rows, ids and texts.
AT_ONCE = 50_000
ARROW = pa.schema([(name, {"string": pa.string(), "long": pa.int64()}[kind])
                   for name, kind in (c.split() for c in STATE.split(", "))])
SUMS = ["total_events", *TALLIES]
PART = [*[f"{c}_sum" for c in SUMS], "at_min", "at_max", *[f"{c}_distinct" for c in SETS], "risk_list"]


def shelved(table: pa.Table) -> pa.Table:
    """One row per shelf for the partial results of its sessions."""
    rows = defaultdict(list)
    for shelf, *row in zip(*(c.to_pylist() for c in table.columns)):
        rows[shelf].append(row)
    return pa.table({"shelf": pa.array(rows.keys(), pa.int32()),
                     "parts": pa.array([pickle.dumps(r, 5) for r in rows.values()], pa.binary())})


def parts(staged: DataFrame, shelves: int = SHELVES) -> DataFrame:
    """Staged events of a stream, combined to a few partial results per session in every task, as rows of shelves.

    Times become texts of fixed width, which sort as the times do; a violation's text carries its time and id in front.
    """
    at = F.date_format("event_timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    violation = F.when(F.col("is_boundary_violation") & F.col("risk_flags").isNotNull(), F.concat_ws(
        BREAK, F.when(at.isNull(), "1").otherwise("0"), F.coalesce(at, F.lit("")), "trace_id", "risk_flags"))
    counted: list[Column] = [safe(c).cast("long").alias(t) for t, c in TALLIES.items()]
    shelf = F.pmod(F.xxhash64(*SESSION_KEYS), F.lit(shelves)).cast("int").alias("shelf")
    rows = staged.select(shelf, *SESSION_KEYS, F.lit(1).cast("long").alias("total_events"), *counted, at.alias("at"),
                         *SETS, violation.alias("risk"))
    how = [*[(c, "sum") for c in SUMS], ("at", "min"), ("at", "max"), *[(c, "distinct") for c in SETS], ("risk", "list")]
    return combined(rows, ["shelf", *SESSION_KEYS], how, "shelf int, parts binary", shelved)


class Session:
    """Sums, times, small vocabularies, request ids and violation texts of one session.

    A session's first ids and texts are kept with its sums: an ordinary one is read and written with one call each.
    Further request ids are entries of a map and texts of a list, so that a long session is added to without being
    rewritten.
    """

    def __init__(self, idle: timedelta):
        self.idle = max(1, int(idle.total_seconds() * 1000))

    def init(self, handle) -> None:
        self.handle = handle
        sums = ", ".join(f"{t} long" for t in ["total_events", *TALLIES])
        self.totals = handle.getValueState(
            "totals", f"{sums}, started string, ended string, requests long, models array<string>, sources array<string>, "
                      "ends long, ids array<string>, risks array<string>, more_risks boolean")
        self.requests = handle.getMapState("requests", "request_id string", "seen int")
        self.risks = handle.getListState("risks", "text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names = ["total_events", *TALLIES]
        before = self.totals.get()
        n, ends = len(names), 0
        sums, started, ended, requests, models, sources, known, risks, more = [0] * n, None, None, 0, set(), set(), [], [], False
        if before is not None:
            sums, (started, ended, requests, models, sources, ends, known, risks, more) = list(before[:n]), before[n:]
            models, sources = set(models), set(sources)
        texts, ids = [], set()
        for r in rows:
            sums = [a + (r[f"{name}_sum"] or 0) for a, name in zip(sums, names)]
            started = min((t for t in (started, r.at_min) if t is not None), default=None)
            ended = max((t for t in (ended, r.at_max) if t is not None), default=None)
            ids |= set(r.request_id_distinct)
            models |= set(r.model_name_distinct)
            sources |= set(r.datasource_name_distinct)
            texts += [t for t in r.risk_list if t is not None]
        ids -= {None, *known}
        if requests > len(known):
            ids = {i for i in ids if not self.requests.containsKey((i,))}
        requests += len(ids)
        new = sorted(ids)
        room = INLINE - len(known)
        known = [*known, *new[:room]]
        for i in new[room:]:
            self.requests.updateValue((i,), (1,))
        models, sources = sorted(models - {None}), sorted(sources - {None})
        room = INLINE - len(risks)
        risks = [*risks, *texts[:room]]
        if texts[room:]:
            self.risks.appendList([(t,) for t in texts[room:]])
            more = True
        if ends:
            self.handle.deleteTimer(ends)
        ends = timerValues.getCurrentProcessingTimeInMs() + self.idle
        self.handle.registerTimer(ends)
        self.totals.update((*sums, started, ended, requests, models, sources, ends, known, risks, more))
        shown = sorted([*risks, *(t[0] for t in self.risks.get())] if more else risks) if sums[names.index("boundary_violations")] else []
        joined = ", ".join(t.split(BREAK, 3)[3] for t in shown)
        yield OUT(*key, started, ended, requests, ", ".join(models), ", ".join(sources), len(models), *sums, joined)


class Part(dict):
    """A partial result, by name."""

    __getattr__ = dict.__getitem__


class Place:
    """The state of one session after the other, out of the shelf that holds it."""

    def __init__(self, ids, texts):
        self.more = {"ids": ids, "texts": texts}
        self.take("[]", [None, 0, 0])

    def take(self, at: str, kept: list) -> None:
        self.at, (self.totals, self.ids, self.lists) = at, kept

    def kept(self) -> list:
        """Totals, and the numbers of ids and lists of texts besides them."""
        return [self.totals, self.ids, self.lists]

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.totals

    def update(self, totals) -> None:
        self.totals = totals

    def getMapState(self, name, key, value):
        return MoreIds(self)

    def getListState(self, name, schema):
        return MoreTexts(self)

    def registerTimer(self, at) -> None:
        self.ends = at

    def deleteTimer(self, at) -> None:
        """Timers are the shelf's."""


class MoreIds:
    """The request ids of the session in its place, besides those in its totals."""

    def __init__(self, place: Place):
        self.place = place

    def containsKey(self, key) -> bool:
        return self.place.more["ids"].containsKey((self.place.at, *key))

    def updateValue(self, key, value) -> None:
        self.place.more["ids"].updateValue((self.place.at, *key), value)
        self.place.ids += 1


class MoreTexts:
    """The violation texts of the session in its place, besides those in its totals; an entry for every list added."""

    def __init__(self, place: Place):
        self.place = place

    def get(self) -> Iterator[tuple[str]]:
        for k in range(self.place.lists):
            for text in self.place.more["texts"].getValue((self.place.at, k))[0]:
                yield (text,)

    def appendList(self, rows) -> None:
        self.place.more["texts"].updateValue((self.place.at, self.place.lists), ([text for text, in rows],))
        self.place.lists += 1


class Shelf(StatefulProcessor):
    """The sessions of one hash value, kept as one text that is read and written with one call each per batch.

    Every call to the state, every key and every row that goes to or comes from a processor costs far more than a session's
    sums, so that sessions share them. A line of the text is a session's end, its key, and the rest; the lines
    of sessions that get nothing are not taken apart. Rows go out as Arrow streams.
    """

    def __init__(self, idle: timedelta):
        self.session = Session(idle)

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "wakes long, lines binary")
        self.ids = handle.getMapState("requests", "session string, request_id string", "seen int")
        self.texts = handle.getMapState("risks", "session string, part int", "texts array<string>")
        self.place = Place(self.ids, self.texts)
        self.session.init(self.place)

    def opened(self) -> tuple[int, dict[str, tuple[int, str]]]:
        """The time of the shelf's timer (0: none), and (end, rest) of its sessions."""
        held = self.held.get()
        if held is None:
            return 0, {}
        lines = (line.split("\t", 2) for line in zlib.decompress(held[1]).decode().split("\n"))
        return held[0], {key: (int(ends), rest) for ends, key, rest in lines}

    def add(self, book: dict, given: dict[tuple, list[Part]], timerValues) -> Iterator[Row]:
        place = self.place
        for key, rows in given.items():
            at = json.dumps(key, ensure_ascii=False)
            place.take(at, json.loads(book[at][1]) if at in book else [None, 0, 0])
            yield from self.session.handleInputRows(key, rows, timerValues)
            book[at] = place.ends, json.dumps(place.kept(), ensure_ascii=False)

    def close_up(self, book: dict, wakes: int, timerValues) -> None:
        """Leave out the sessions that have ended, and be woken when the next one does."""
        now = timerValues.getCurrentProcessingTimeInMs()
        ended = {key: json.loads(rest) for key, (ends, rest) in book.items() if ends < now}
        for key, (_, _, lists) in ended.items():
            del book[key]
            for k in range(lists):
                self.texts.removeKey((key, k))
        if any(ids for _, ids, _ in ended.values()):
            for entry in [k for k in self.ids.keys() if k[0] in ended]:
                self.ids.removeKey(entry)
        next_end = min((ends for ends, _ in book.values()), default=0)
        if wakes and wakes != next_end:
            self.handle.deleteTimer(wakes)
        if next_end and wakes != next_end:
            self.handle.registerTimer(next_end)
        if book:
            lines = "\n".join(f"{ends}\t{key}\t{rest}" for key, (ends, rest) in book.items())
            self.held.update((next_end, zlib.compress(lines.encode(), 1)))
        else:
            self.held.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        wakes, book = self.opened()
        given, n, out = defaultdict(list), 0, {}
        for r in rows:
            for row in pickle.loads(r.parts):
                part = Part(zip(PART, row[len(SESSION_KEYS):]))
                given[tuple(row[:len(SESSION_KEYS)])].append(part)
                n += 1 + len(part.request_id_distinct) + len(part.risk_list)
            if n >= AT_ONCE:
                out.update((o[:len(SESSION_KEYS)], o) for o in self.add(book, given, timerValues))
                given, n = defaultdict(list), 0
        out.update((o[:len(SESSION_KEYS)], o) for o in self.add(book, given, timerValues))
        self.close_up(book, wakes, timerValues)
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out.values()), ARROW)], schema=ARROW)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, ARROW) as stream:
            stream.write_batch(batch)
        yield Row(rows=sink.getvalue().to_pybytes())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, book = self.opened()
        # The timer that has run out is deleted by Spark.
        self.close_up(book, 0, timerValues)
        return iter(())

    def close(self) -> None:
        pass


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the streams that shelves give."""
    for batch in batches:
        for stream in batch.column(0):
            yield from pa.ipc.open_stream(stream.as_buffer())


def sessions(staged: DataFrame, idle: timedelta = IDLE, shelves: int = SHELVES) -> DataFrame:
    """The rows of :func:`traceworks.plans.ledger.session_summary` for the sessions that a batch adds to."""
    packed = parts(staged, shelves).groupBy("shelf").transformWithState(Shelf(idle), "rows binary", "update", "processingTime")
    rows = packed.mapInArrow(unpacked, STATE)
    started, ended = (F.col(c).cast("timestamp_ntz") for c in ("started", "ended"))
    level = first_match([
        (F.col("boundary_violations") > 0, "CRITICAL"),
        (F.col("sql_blocked_count") > 0, "HIGH"),
        ((F.col("policy_blocks") > 0) | (F.col("high_sensitivity_events") > 0) | (F.col("pii_events") > 0), "MEDIUM"),
        (F.col("error_events") > 0, "LOW"),
    ], "NONE")
    return rows.withColumns({
        "session_started_at": started, "session_last_activity_at": ended,
        "session_duration_minutes": minutes_between(started, ended), "session_risk_level": level}).drop("started", "ended")
