"""The forming bar: rules of the fold, and the stream against the batch."""

import math
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quaymark.operators import bars as B
from quaymark.streaming import forming as W
from quaymark.streaming import live as L

MIN = B.MINUTE
WIDTH = 15 * MIN
START = 1_000 * WIDTH


def message(at, bucket=START, close=102.0, volume=10.0, trades=3, open_=100.0, high=None, low=None, name="x", n=[0]):
    n[0] += 1
    return (name, at, n[0], bucket, open_, max(open_, close, high or 0), low if low is not None else min(open_, close), close, volume, trades)


def folded(spark, rows, **more):
    out = W.fold_bars(spark.createDataFrame(rows, W.MESSAGE), 15, more.pop("stale_ns", 100 * WIDTH), **more).collect()
    return [(r["kind"], r["bucket"], r["close"], r["trades"]) for r in sorted(out, key=lambda r: (r["instrument"], r["at_ns"], r["sequence"] or 0, r["kind"]))]


def test_updates_form_until_rollover_and_never_go_back(spark):
    late = START + WIDTH
    rows = [
        message(START + 2 * MIN), message(START + 3 * MIN, close=103.0, volume=11.0, trades=4), message(START + 4 * MIN),
        message(START + 5 * MIN, bucket=START - WIDTH), message(late + 1, bucket=late, close=104.0, volume=1.0, trades=1), message(late + 2, bucket=late, close=104.0, volume=1.0, trades=1),
    ]
    seed = spark.createDataFrame([("x", START - WIDTH)], "instrument string, bucket long")
    assert folded(spark, rows, seed=seed) == [("forming", START, 102.0, 3), ("forming", START, 103.0, 4), ("closed", START, 103.0, 4), ("forming", late, 104.0, 1)]


def test_invalid_messages_are_refused_and_gaps_stay(spark):
    bad = [message(START + 1, close=0.0), message(START + 1, volume=-1.0), message(START + 1, bucket=START + WIDTH), message(START + 1, close=math.inf), message(START + 1, trades=None), message(START + 1, bucket=None)]
    bad.append(("x", START + 1, 999, START, 100.0, 90.0, 80.0, 95.0, 1.0, 1))
    later = START + 2 * WIDTH
    rows = [*bad, message(START + 2), message(later + 1, bucket=later)]
    assert folded(spark, rows) == [("forming", START, 102.0, 3), ("closed", START, 102.0, 3), ("forming", later, 102.0, 3)]


def test_an_interrupted_bar_is_not_closed_unless_it_is_seen_again(spark):
    later = START + WIDTH
    rows = [message(START + 1), message(later + 1, bucket=later)]
    assert folded(spark, rows, stale_ns=MIN) == [("forming", START, 102.0, 3), ("interrupted", START, 102.0, 3), ("forming", later, 102.0, 3)]
    less = [message(START + 1), message(START + 5 * MIN, volume=4.0, trades=2)]
    assert folded(spark, less, stale_ns=2 * MIN) == [("forming", START, 102.0, 3), ("interrupted", START, 102.0, 3), ("forming", START, 102.0, 2)]
    seen = [*less, message(START + 6 * MIN, volume=11.0, trades=8), message(later + 1, bucket=later)]
    assert [k for k, *_ in folded(spark, seen, stale_ns=9 * MIN + 2)] == ["forming", "forming", "closed", "forming"]


def test_a_message_after_its_bar_s_end_closes_it_at_once(spark):
    rows = [message(START + WIDTH + 5), message(START + WIDTH + 6, volume=20.0, trades=9)]
    assert folded(spark, rows) == [("closed", START, 102.0, 3)]


def test_silence_at_the_end_counts_up_to_the_given_time(spark):
    rows = [message(START + 1), message(START + 1, name="y"), message(START + 3 * MIN, name="y", volume=11.0)]
    got = folded(spark, rows, stale_ns=3 * MIN, until_ns=START + 4 * MIN)
    assert got == [("forming", START, 102.0, 3), ("interrupted", START, 102.0, 3), ("forming", START, 102.0, 3), ("forming", START, 102.0, 3)]
    assert folded(spark, []) == []


@pytest.mark.parametrize("files", [1, 3])
def test_stream_gives_the_rows_of_the_fold_on_shuffled_files(spark, tmp_path, files):
    t = B.ticks_from_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet")).filter(B.valid_tick())
    m = W.updates_of(t, 60, F.col("sequence") % 5 * (10 * MIN)).filter("instrument < 'd'")
    path = str(tmp_path / "m")
    m.repartition(files, F.xxhash64("sequence")).write.parquet(path)  # every file holds all times
    stale, late = 6 * 60 * MIN, 400 * 24 * 60 * MIN
    newest = m.agg(F.max("at_ns")).first()[0]
    end = spark.createDataFrame([("end", newest + late + 1_000_000, 10**9, None, None, None, None, None, None, None)], W.MESSAGE)
    seed = m.groupBy("instrument").agg(F.min("bucket").alias("bucket"))
    want = W.fold_bars(m, 60, stale, until_ns=newest, seed=seed)
    if files > 1:  # the last file moves the watermark past all others
        end.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1 if files > 1 else 10).parquet(path)
    with W.keyed_state(spark):
        got = L.run_to_table(W.stream_bars(stream, 60, stale, late="400 days" if files > 1 else "0 seconds", seed=seed), str(tmp_path))
    got = Counter(tuple(r) for r in got.collect())
    want = Counter(tuple(r) for r in want.collect())
    assert sum(want.values()) > 200 and got == want


def test_state_store_setting_comes_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    with W.keyed_state(spark):
        assert "RocksDB" in spark.conf.get(name)
    assert spark.conf.get(name, None) == before


class Kept:
    """A value and a list of the state store, counting the entries that pass."""

    def __init__(self):
        self.rows, self.moved, self.timers = [], 0, []

    def appendList(self, rows):
        self.rows += rows
        self.moved += len(rows)

    def put(self, rows):
        self.rows, self.moved = list(rows), self.moved + len(rows)

    def get(self):
        self.moved += len(self.rows)
        return iter(self.rows)

    def clear(self):
        self.rows = []

    def exists(self):
        return False

    def update(self, row):
        self.row = row

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return self.now


def test_messages_wait_in_batches(spark):
    rows = [message(START + k * 1_000_000_000, volume=1.0 + k, trades=1 + k) for k in range(700)] + [message(START + 5, bucket=None)]
    processor, store = W.FormingProcessor(15, 100 * WIDTH), Kept()
    processor.handle = processor.value = processor.waiting = store
    frame = pd.DataFrame(rows[::-1], columns=W.FIELDS)
    assert sum(len(f) for f in processor.handleInputRows(("x",), iter([frame[:300], frame[300:]]), None)) == 0
    store.now = (START + 400 * 1_000_000_000) // 1_000_000
    first = pd.concat(list(processor.handleExpiredTimer(("x",), store, None)))
    assert list(first["trades"]) == list(range(1, 402)) and len(store.rows) == 1
    assert store.moved < 10 and max(store.timers) >= (START + 401 * 1_000_000_000) // 1_000_000
