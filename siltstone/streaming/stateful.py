"""Sessions without repeated events, by state that lives across batches: rows may come late and out of order.

Each key's state holds its open sessions and the ids of events that may still come again; a timer
closes a session once the watermark has passed its end. A batch costs one read and one write of
state for each key that it touches, whatever the number of its rows.
"""

from __future__ import annotations

import datetime as dt
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "starts array<long>, stops array<long>, counts array<long>, repeats array<long>, ids array<long>, times array<long>"

_BEGIN = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def _micros(t: dt.datetime) -> int:
    return int((t.replace(tzinfo=dt.timezone.utc) if t.tzinfo is None else t).timestamp()) * 1_000_000 + t.microsecond


class Open:
    """Open sessions of one key in microseconds: [start, end) from the first event to the gap after the last, events, repeats; and ids seen, with their times."""

    def __init__(self, gap: int, state: Row | tuple | None = None):
        self.gap = gap
        starts, stops, counts, repeats, ids, times = state or ((),) * 6
        self.sessions = [list(x) for x in zip(starts, stops, counts, repeats, strict=True)]
        self.seen = dict(zip(ids, times, strict=True))

    def add(self, ident: int, at: int) -> None:
        """One event: a repeat counts for the session that holds it; another opens a session or joins those within the gap."""
        again = ident in self.seen
        low, high, n, repeats, rest = at, at + self.gap, 1, 0, []
        if again:
            for s in self.sessions:
                s[3] += s[0] <= self.seen[ident] < s[1]
            return
        self.seen[ident] = at
        for s in self.sessions:
            if s[0] < at + self.gap and at < s[1]:
                low, high, n, repeats = min(low, s[0]), max(high, s[1]), n + s[2], repeats + s[3]
            else:
                rest.append(s)
        self.sessions = [*rest, [low, high, n, repeats]]

    def add_all(self, events: Iterable[tuple[int, int]]) -> None:
        """What :meth:`add` does to each event in turn, with one sweep over all sessions: cost by their number, not its square."""
        again = []
        for ident, at in events:
            if ident in self.seen:
                again.append(self.seen[ident])
            else:
                self.seen[ident] = at
                self.sessions.append([at, at + self.gap, 1, 0])
        joined: list[list[int]] = []
        for s in sorted(self.sessions):
            if joined and s[0] < joined[-1][1]:
                low, high, n, repeats = joined[-1]
                joined[-1] = [low, max(high, s[1]), n + s[2], repeats + s[3]]
            else:
                joined.append(s)
        self.sessions = joined
        starts = [s[0] for s in joined]
        for at in again:
            k = bisect_right(starts, at) - 1
            if k >= 0 and at < joined[k][1]:
                joined[k][3] += 1

    def close(self, watermark: int) -> list[list[int]]:
        """Take out the sessions that end before the watermark, and forget ids from before it: later rows that old are dropped."""
        done = sorted(s for s in self.sessions if s[1] <= watermark)
        self.sessions = [s for s in self.sessions if s[1] > watermark]
        first = min((s[0] for s in self.sessions), default=watermark)
        self.seen = {k: t for k, t in self.seen.items() if t >= min(watermark, first)}
        return done

    def due(self) -> int | None:
        """When the first session ends, in milliseconds."""
        return -(-min(s[1] for s in self.sessions) // 1000) if self.sessions else None

    def state(self) -> tuple:
        columns = [list(x) for x in zip(*self.sessions, strict=True)] or [[], [], [], []]
        return (*columns, list(self.seen), list(self.seen.values()))


class SessionProcessor(StatefulProcessor):
    """Rows of (id, ts) by key to closed sessions."""

    def __init__(self, gap_seconds: int):
        self.gap = gap_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _STATE)

    def _write(self, held: Open) -> None:
        if held.sessions or held.seen:
            self.open.update(held.state())
        else:
            self.open.clear()

    def _rows(self, key: tuple, done: list[list[int]]) -> Iterator[Row]:
        for start, stop, n, repeats in done:
            yield Row(key=key[0], start=_BEGIN + dt.timedelta(microseconds=start), stop=_BEGIN + dt.timedelta(microseconds=stop), n=n, repeats=repeats)

    def _timer(self, before: int | None, due: int | None) -> None:
        """One timer for each key: a stale one would bring a second visit."""
        if before != due:
            if before is not None:
                self.handle.deleteTimer(before)
            if due is not None:
                self.handle.registerTimer(due)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = Open(self.gap, self.open.get())
        before = held.due()
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        # Spark itself drops late rows by the watermark of one batch before
        held.add_all((r["id"], at) for r in rows if (at := _micros(r["ts"])) >= watermark)
        done = held.close(watermark)
        self._write(held)
        self._timer(before, held.due())
        return self._rows(key, done)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = Open(self.gap, self.open.get())
        done = held.close(timerValues.getCurrentWatermarkInMs() * 1000)
        if done:
            self._write(held)
        self._timer(None, held.due())
        return self._rows(key, done)


_MADE = StructType([StructField("key", LongType()), StructField("start", TimestampType()), StructField("stop", TimestampType()), StructField("n", LongType()), StructField("repeats", LongType())])


def sessions(events: DataFrame, key: str = "user_id", ident: str = "event_id", time: str = "ts", gap_seconds: int = 1800, late: str = "1 hour") -> DataFrame:
    """key, start, stop, n, repeats of each session, once it is over: events of a key without a longer gap, an id counted once.

    Rows later than ``late`` behind the newest one are dropped; those within it may come in any order. A stream needs state in
    RocksDB (:func:`with_rocks`). On a table: :func:`sessions_of_table`, which gives the same.
    """
    rows = events.select(F.col(key).cast("long").alias("key"), F.col(ident).cast("long").alias("id"), F.col(time).cast("timestamp").alias("ts")).filter("key is not null and id is not null and ts is not null")
    marked = rows.withWatermark("ts", late)
    return marked.groupBy("key").transformWithState(statefulProcessor=SessionProcessor(gap_seconds), outputStructType=_MADE, outputMode="Append", timeMode="EventTime")


def sessions_of_table(events: DataFrame, key: str = "user_id", ident: str = "event_id", time: str = "ts", gap_seconds: int = 1800) -> DataFrame:
    """What :func:`sessions` gives for rows that are all there: the first of an id by time counts, others are repeats of its session."""
    rows = events.select(F.col(key).cast("long").alias("key"), F.col(ident).cast("long").alias("id"), F.col(time).cast("timestamp").alias("ts")).filter("key is not null and id is not null and ts is not null")
    once = rows.groupBy("key", "id").agg(F.min("ts").alias("ts"), (F.count("*") - 1).alias("again"))
    w = F.session_window("ts", f"{gap_seconds} seconds")
    out = once.groupBy(w.alias("w"), "key").agg(F.count("*").alias("n"), F.sum("again").alias("repeats"))
    return out.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "repeats")


@contextmanager
def with_rocks(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB for the streams that start inside; other streams keep their setting."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def write(out: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed sessions to Parquet, each once; takes all that is there and stops."""
    with with_rocks(out.sparkSession):
        return out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
