"""Sessions by state across batches: out-of-order and repeated rows give the table's result; late rows are dropped; a restart goes on."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from siltstone.streaming import stateful

SCHEMA = "event_id long, user_id long, ts timestamp"
BEGIN = dt.datetime(2024, 1, 1)
END = (10**9, -1, BEGIN + dt.timedelta(days=60))  # moves the watermark over all others


def plain_sessions(events, gap):
    out = []
    for user in {u for _, u, _ in events}:
        first = {}
        for i, u, t in sorted(events, key=lambda e: e[2]):
            if u == user:
                first.setdefault(i, [t, -1])[1] += 1
        run = []
        for t, again in sorted(first.values()):
            if run and t < run[-1][1]:
                run[-1] = [run[-1][0], t + gap, run[-1][2] + 1, run[-1][3] + again]
            else:
                run.append([t, t + gap, 1, again])
        out += [(user, *x) for x in run]
    return sorted(out)


def some_events(n=400, seed=1):
    r = random.Random(seed)
    events = [(i, r.randint(1, 6), BEGIN + dt.timedelta(seconds=r.randint(0, 2 * 86400))) for i in range(n)]
    return events + [events[r.randrange(n)] for _ in range(60)]


def test_open_sessions_merge_in_any_order():
    r = random.Random(2)
    for _ in range(200):
        events = [(r.randint(0, 15), r.randint(0, 100)) for _ in range(r.randint(1, 20))]
        events = list({i: (i, t) for i, t in events}.values()) + [e for e in dict(events).items()][:3]
        held = stateful.Open(10)
        for cut, (i, t) in enumerate(r.sample(events, len(events))):
            held.add(i, t)
            held = stateful.Open(10, held.state())  # as if a batch ended
        want = plain_sessions([(i, 0, dt.timedelta(t)) for i, t in events], dt.timedelta(10))
        got = held.close(10**6)
        assert [tuple(x) for x in got] == [(s.days, e.days, n, k) for _, s, e, n, k in want]
        assert held.state() == ([], [], [], [], [], [])


def replay(spark, batches, folder, late="3 hours", start=0):
    """Each batch is a file that comes by itself."""
    for k, rows in enumerate(batches, start):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in/b{k:03d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(f"{folder}/in")
    stateful.write(stateful.sessions(stream, late=late), f"{folder}/out", f"{folder}/state").awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(f"{folder}/out").collect())


@pytest.mark.parametrize("restart", [False, True])
def test_out_of_order_replay_equals_the_table(spark, tmp_path, restart):
    events = some_events()
    r = random.Random(3)
    shuffled = sorted(events, key=lambda e: e[2] + dt.timedelta(seconds=r.randint(0, 3500)))  # out of order by up to an hour
    batches = [shuffled[k : k + 120] for k in range(0, len(shuffled), 120)] + [[END]]
    want = plain_sessions(events, dt.timedelta(minutes=30))
    if restart:
        half = len(batches) // 2
        replay(spark, batches[:half], tmp_path)
        got = replay(spark, batches[half:], tmp_path, start=half)
    else:
        got = replay(spark, batches, tmp_path)
    assert got == want
    table = stateful.sessions_of_table(spark.createDataFrame(events, SCHEMA))
    assert sorted(map(tuple, table.collect())) == want


def test_rows_later_than_allowed_are_dropped(spark, tmp_path):
    at = lambda m: BEGIN + dt.timedelta(minutes=m)
    got = replay(spark, [[(1, 1, at(0))], [(2, 1, at(600))], [(3, 1, at(10)), (4, 1, at(610)), (None, 1, at(0)), (5, None, at(0)), (6, 1, None)], [END]], tmp_path, late="1 hour")
    assert got == [(1, at(0), at(30), 1, 0), (1, at(600), at(640), 2, 0)]


def test_a_batch_at_once_is_its_events_in_turn():
    r = random.Random(5)
    for _ in range(300):
        one, all_ = stateful.Open(10), stateful.Open(10)
        for watermark in (0, 40, 90, 10**6):
            batch = [(r.randint(0, 25), r.randint(watermark, watermark + 60)) for _ in range(r.randint(0, 25))]
            for event in batch:
                one.add(*event)
            all_.add_all(batch)
            assert sorted(one.sessions) == all_.sessions and one.seen == all_.seen
            assert one.close(watermark) == all_.close(watermark)


class Held:
    """What the processor asks of Spark: one key's state and timers, with the number of calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def exists(self):
        self.calls += 1
        return self.value is not None

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def getCurrentWatermarkInMs(self):
        return self.watermark


def test_a_key_has_one_timer_and_a_batch_one_read():
    held = Held()
    processor = stateful.SessionProcessor(10)
    processor.init(held)
    got = []
    for k in range(5):
        held.watermark, held.calls = max(0, k * 100_000 - 1), 0
        rows = [{"id": 100 * k + i, "ts": dt.datetime(1970, 1, 1) + dt.timedelta(seconds=100 * k + 20 * i)} for i in (3, 1, 2, 4, 0)]
        got += processor.handleInputRows((7,), iter(rows), held)
        assert held.calls == 2 and len(held.timers) == 1 and min(held.timers) > held.watermark
    held.watermark = 10**9
    got += processor.handleExpiredTimer((7,), held, None)
    assert [(r["start"].timestamp(), r["n"], r["repeats"]) for r in got] == [(20.0 * i, 1, 0) for i in range(25)] and held.value is None
