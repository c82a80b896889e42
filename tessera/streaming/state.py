"""Keyed stream state with event-time timers: rows are taken in order of time, and state expires."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.numbering import number_rows, running_sums
from tessera.streaming.events import timed

#: The state store that keyed state with timers needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def with_state_store(spark) -> None:
    """Let streams of this session keep their state where timers are possible."""
    spark.conf.set(*STORE)


class InOrder(StatefulProcessor):
    """Rows of a key in order of ``at`` (milliseconds) and ``id``, each once the watermark has passed it.

    Rows wait in a list state, so the order of arrival does not matter; rows later than the
    watermark are dropped by Spark before. A subclass folds rows one by one in :meth:`take` and
    says in :meth:`expiry` when its state is over; :meth:`expire` then clears it.
    """

    waiting_schema = "at long, id long, value string"
    state_schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_schema)
        self.state = handle.getValueState("state", self.state_schema)

    def take(self, key: tuple, state: tuple | None, row: tuple) -> tuple[tuple, list[Row]]:
        raise NotImplementedError

    def expiry(self, state: tuple) -> int:
        raise NotImplementedError

    def expire(self, key: tuple, state: tuple) -> list[Row]:
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r["at"], r["id"], r["value"]) for r in rows]
        if new:
            self.waiting.appendList(new)
            # A timer goes off when the watermark has passed it; one for each time that is waited for.
            for at in {row[0] for row in new}:
                self.handle.registerTimer(at)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        upto = timerValues.getCurrentWatermarkInMs()
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], r[1])) if self.waiting.exists() else []
        due, later = [r for r in rows if r[0] <= upto], [r for r in rows if r[0] > upto]
        state = tuple(self.state.get()) if self.state.exists() else None
        changed = bool(due)
        for row in due:
            if state is not None and row[0] >= self.expiry(state):
                yield from self.expire(key, state)
                state = None
            state, out = self.take(key, state, row)
            yield from out
        if state is not None and self.expiry(state) <= upto:
            yield from self.expire(key, state)
            state, changed = None, True
        if due:
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        if changed:
            if state is None:
                self.state.clear()
            else:
                self.state.update(state)
                self.handle.registerTimer(self.expiry(state))

    def close(self) -> None:
        pass


class Progress(InOrder):
    """Running counts of a key's session: its rows, and those whose value is ``error``."""

    state_schema = "first long, last long, seen long, errors long"

    def __init__(self, idle_ms: int) -> None:
        self.idle = idle_ms

    def take(self, key, state, row):
        first, _, seen, errors = state or (row[0], row[0], 0, 0)
        state = first, row[0], seen + 1, errors + (row[2] == "error")
        return state, [Row(kind="seen", key=key[0], event_id=row[1], at=row[0], seen=state[2], errors=state[3])]

    def expiry(self, state):
        return state[1] + self.idle

    def expire(self, key, state):
        return [Row(kind="closed", key=key[0], event_id=None, at=state[1], seen=state[2], errors=state[3])]


class Cached(InOrder):
    """Answers of a key that stay good for a while: a request is a hit while the last computed value is fresh."""

    state_schema = "computed_at long, value string"

    def __init__(self, ttl_ms: int) -> None:
        self.ttl = ttl_ms

    def take(self, key, state, row):
        hit = state is not None
        state = state or (row[0], row[2])
        return state, [Row(key=key[0], event_id=row[1], at=row[0], hit=hit, computed_at=state[0], value=state[1])]

    def expiry(self, state):
        return state[0] + self.ttl

    def expire(self, key, state):
        return []


def _rows(events: DataFrame, key: str, value: str, late: str) -> DataFrame:
    rows = timed(events).withWatermark("ts", late)
    return rows.select(F.col(key).alias("key"), F.unix_millis("ts").alias("at"), F.col("event_id").cast("long").alias("id"), F.col(value).cast("string").alias("value"), "ts").groupBy("key")


def live_progress(events: DataFrame, idle_seconds: int = 1800, late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """A stream of ``kind, key, event_id, at, seen, errors``: running counts within each key's session.

    A row of kind ``seen`` follows each event, in order of time and id whatever the order of
    arrival; one of kind ``closed`` sums up a session once ``idle_seconds`` have passed without
    an event, and its state is dropped then. Events behind the watermark (``late``) are dropped.
    The values are those of :func:`session_progress` over the same events. Null keys are a key.
    """
    kind = events.schema[key].dataType.simpleString()
    return _rows(events, key, "event_type", late).transformWithState(Progress(idle_seconds * 1000), f"kind string, key {kind}, event_id long, at long, seen long, errors long", "Append", "EventTime")


def cached_answers(requests: DataFrame, ttl_seconds: int, late: str = "10 minutes", key: str = "user_id", value: str = "value") -> DataFrame:
    """A stream of ``key, event_id, at, hit, computed_at, value``: what a cache answers to each request.

    A request finds the value computed last for its key while that is under ``ttl_seconds`` old;
    else its own value is kept from then on. State goes when it is no longer good.
    """
    kind = requests.schema[key].dataType.simpleString()
    return _rows(requests, key, value, late).transformWithState(Cached(ttl_seconds * 1000), f"key {kind}, event_id long, at long, hit boolean, computed_at long, value string", "Append", "EventTime")


def session_progress(events: DataFrame, idle_seconds: int = 1800, key: str = "user_id") -> DataFrame:
    """The batch form of :func:`live_progress`: ``key, event_id, session, seen, errors``.

    A session starts where ``idle_seconds`` or more have passed since the key's event before.
    Rows are numbered by key and time and meet the row before by number, so a key of any size is
    spread over tasks.
    """
    rows = timed(events).select(F.col(key).alias("key"), F.unix_millis("ts").alias("at"), "event_id", "event_type")
    rows = number_rows(rows, "key", "at", "event_id", name="no")
    before = rows.select((F.col("no") + 1).alias("no"), F.col("key").alias("key_before"), F.col("at").alias("at_before"))
    fresh = F.coalesce(~F.col("key").eqNullSafe(F.col("key_before")) | (F.col("at") - F.col("at_before") >= idle_seconds * 1000), F.lit(True))
    started = rows.join(before, "no", "left").withColumn("start", fresh.cast("long"))
    sums = {"session": F.col("start"), "all_seen": F.lit(1).cast("long"), "all_errors": F.coalesce((F.col("event_type") == "error").cast("long"), F.lit(0))}
    run = running_sums(started.select("key", "at", "event_id", "event_type", "start"), "key", ["at", "event_id"], sums)
    # Counts before a session are those at its first row, less that row.
    error = F.coalesce((F.col("event_type") == "error").cast("long"), F.lit(0))
    first = run.where("start = 1").select(F.col("key").alias("first_key"), F.col("session").alias("first_session"), (F.col("all_seen") - 1).alias("seen_before"), (F.col("all_errors") - error).alias("errors_before"))
    done = run.join(first, F.col("key").eqNullSafe(F.col("first_key")) & (F.col("session") == F.col("first_session")))
    return done.select("key", "event_id", "session", (F.col("all_seen") - F.col("seen_before")).alias("seen"), (F.col("all_errors") - F.col("errors_before")).alias("errors"))
