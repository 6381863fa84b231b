"""The bar that is still forming, from updates of a feed: a fold over messages and the same
fold as keyed state with timers.

A message (``instrument, at_ns, sequence, bucket, open, high, low, close, volume, trades``)
is what the feed says of a bar at ``at_ns``, the time it was received. Messages are taken in
order of (``at_ns``, ``sequence``):

- those that are no bar, begin more than a minute ahead of their receipt, or go back behind
  the newest or a closed bar are refused; so is one of the same bar that shows less volume or
  fewer trades than the last, or the same of both;
- a later bar closes the one before, if that one's time is over and it was not interrupted;
  an interrupted bar is never closed, because part of it was not seen, but a message of the
  same bar makes it whole again;
- a message of a bar whose time is over closes it at once;
- silence of more than ``stale_ns`` interrupts the bar.

Nothing is filled in: an interval without a message gives no bar.

Rows that come out have a ``kind``: ``forming`` (the open bar as now accepted), ``closed``
(once a bar), ``interrupted`` (once a silence, at the time it became one). ``seed`` gives
what is known before the first message: the newest closed bucket of each instrument.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..operators.bars import MINUTE, bucket

MESSAGE = "instrument string, at_ns long, sequence long, bucket long, open double, high double, low double, close double, volume double, trades long"
OUT = "instrument string, at_ns long, sequence long, kind string, bucket long, open double, high double, low double, close double, volume double, trades long"
STATE = "closed long, last long, bucket long, open double, high double, low double, close double, volume double, trades long, interrupted boolean"
#: Waiting messages, a batch an entry: a row an entry costs a round trip each.
WAITING = "first long, last long, rows binary"
ROWS = pa.schema([(c.split()[0], pa.float64() if c.endswith("double") else pa.int64()) for c in MESSAGE.split(", ")[1:]])
CHUNK = 50_000
STALE, AHEAD = 15_000_000_000, MINUTE
_names = lambda ddl: [c.split()[0] for c in ddl.split(", ")]
FIELDS, OUT_FIELDS = _names(MESSAGE), _names(OUT)


class Forming:
    """The state of one instrument."""

    def __init__(self, minutes: int, stale_ns: int = STALE, state: tuple | None = None):
        self.width, self.stale_ns = minutes * MINUTE, stale_ns
        closed, last, *bar, interrupted = state or (0, 0, *[None] * 7, False)
        self.closed, self.last = closed, last
        self.bar = None if bar[0] is None else tuple(bar)  # bucket, four prices, volume, trades
        self.interrupted = bool(interrupted)

    def state(self) -> tuple:
        return (self.closed, self.last, *(self.bar or [None] * 7), self.interrupted)

    def deadline(self) -> int | None:
        """When silence will interrupt the bar."""
        return self.last + self.stale_ns if self.bar and not self.interrupted else None

    def silence(self, now: int) -> list[tuple]:
        """The interruption that is due before ``now``."""
        due = self.deadline()
        if due is None or now <= due:
            return []
        self.interrupted = True
        return [(due, None, "interrupted", *self.bar)]

    def _close(self, at: int, sequence: int, bar: tuple) -> list[tuple]:
        if bar[0] <= self.closed:
            return []
        self.closed = bar[0]
        return [(at, sequence, "closed", *bar)]

    def step(self, at: int, sequence: int, bar: tuple) -> list[tuple]:
        out = self.silence(at)
        self.last = max(self.last, at)
        start, open_, high, low, close, volume, trades = bar
        prices = (open_, high, low, close)
        if start is None or start > at + AHEAD or any(p is None or not 0 < p < float("inf") for p in prices):
            return out
        if volume is None or not 0 <= volume < float("inf") or trades is None or trades < 0 or high < max(prices) or low > min(prices):
            return out
        before = self.bar
        if start <= self.closed or (before and start < before[0]):
            return out
        if before and start == before[0] and not self.interrupted:
            if volume < before[5] or trades < before[6] or (volume, trades) == before[5:]:
                return out
        if before and start > before[0] and not self.interrupted and before[0] + self.width <= at:
            out += self._close(at, sequence, before)
        self.interrupted = False
        if start + self.width <= at:
            self.bar = None
            return out + self._close(at, sequence, bar)
        self.bar = bar
        return [*out, (at, sequence, "forming", *bar)]


def _bars_of(frame: pd.DataFrame) -> Iterator[tuple]:
    none = lambda v: None if v is None or v != v else v
    for at, sequence, *bar in frame[FIELDS[1:]].itertuples(index=False):
        start, *prices, volume, trades = map(none, bar)
        yield int(at), int(sequence), (None if start is None else int(start), *prices, volume, None if trades is None else int(trades))


def _packed(rows: pa.Table) -> list[tuple]:
    """Entries of ``WAITING``."""
    out = []
    for k in range(0, len(rows), CHUNK):
        part, sink = rows.slice(k, CHUNK), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, ROWS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as file:
            file.write_table(part)
        at = pa.compute.min_max(part["at_ns"])
        out.append((at["min"].as_py(), at["max"].as_py(), sink.getvalue().to_pybytes()))
    return out


def _unpacked(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(rows)).read_all()


def _frame(name: str, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame([(name, *r) for r in rows], columns=OUT_FIELDS)
    return out.astype({"sequence": "Int64", "bucket": "Int64", "trades": "Int64"})


def fold_bars(messages: DataFrame, minutes: int, stale_ns: int = STALE, until_ns: Column | int | None = None, seed: DataFrame | None = None) -> DataFrame:
    """Batch form. Messages of an instrument are sorted in their partition and folded as
    they stream by, so a task holds one state and one batch, whatever the history's length.
    ``until_ns`` is the time up to which silence is judged (default: the newest message)."""
    if until_ns is None:
        until_ns = messages.agg(F.max("at_ns")).first()[0]
    rows = messages.select(*FIELDS, F.lit(0).cast("long").alias("closed"))
    if seed is not None:  # what was closed before comes first
        known = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in MESSAGE.split(", ")[3:]]
        rows = rows.unionByName(seed.select("instrument", F.lit(-1).cast("long").alias("at_ns"), F.lit(-1).cast("long").alias("sequence"), *known, F.col("bucket").cast("long").alias("closed")))
    rows = rows.withColumn("until", F.lit(until_ns).cast("long") if isinstance(until_ns, int) or until_ns is None else until_ns)
    rows = rows.repartition("instrument").sortWithinPartitions("instrument", "at_ns", "sequence")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, bar, until = None, None, None
        for frame in frames:
            frame = frame.astype({c: object for c in ("bucket", "trades")})
            for key, part in frame.groupby("instrument", sort=False, dropna=False):
                if bar is None or key != name:
                    if bar is not None:
                        yield _frame(name, bar.silence(until))
                    name, bar, until = key, Forming(minutes, stale_ns), int(part["until"].iloc[0])
                    if part["at_ns"].iloc[0] < 0:
                        bar.closed = int(part["closed"].iloc[0])
                        part = part.iloc[1:]
                out = []
                for at, sequence, values in _bars_of(part):
                    out += bar.step(at, sequence, values)
                yield _frame(name, out)
        if bar is not None:
            yield _frame(name, bar.silence(until))

    return rows.mapInPandas(fold, OUT)


class FormingProcessor(StatefulProcessor):
    """The fold as keyed state: the bar is a value, messages wait in a list until the
    watermark has passed them, and timers release them in order and report silence."""

    def __init__(self, minutes: int, stale_ns: int = STALE):
        self.minutes, self.stale_ns = minutes, stale_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("bar", STATE)
        self.waiting = handle.getListState("waiting", WAITING)

    def _load(self) -> Forming:
        return Forming(self.minutes, self.stale_ns, tuple(self.value.get()) if self.value.exists() else None)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        bar = self._load()
        bar.closed = int(initialState["bucket"].max())
        self.value.update(bar.state())

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for frame in rows:
            if len(frame):
                kept = _packed(pa.Table.from_pandas(frame[FIELDS[1:]], ROWS, preserve_index=False))
                self.waiting.appendList(kept)
                self.handle.registerTimer(min(r[0] for r in kept) // 1_000_000)  # it sets the next
        yield pd.DataFrame(columns=OUT_FIELDS)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now, bar = timerValues.getCurrentWatermarkInMs(), self._load()
        entries = [tuple(r) for r in self.waiting.get()]
        after = (now + 1) * 1_000_000  # the first that is not due
        if any(r[0] < after for r in entries):
            later = [r for r in entries if r[0] >= after]
            rows = pa.concat_tables([_unpacked(r[2]) for r in entries if r[0] < after])
            early = pa.compute.less(rows["at_ns"], after)
            later += _packed(rows.filter(pa.compute.invert(early)))
            self.waiting.clear()
            if later:
                self.waiting.put(later)
                self.handle.registerTimer(min(r[0] for r in later) // 1_000_000)
            due = rows.filter(early).sort_by([("at_ns", "ascending"), ("sequence", "ascending")])
            for k in range(0, len(due), CHUNK):
                out = []
                for at, sequence, values in _bars_of(due.slice(k, CHUNK).to_pandas(integer_object_nulls=True)):
                    out += bar.step(at, sequence, values)
                yield _frame(key[0], out)
        out, end = [], bar.deadline()
        if end is not None and end // 1_000_000 < now:
            out = bar.silence(now * 1_000_000)
        elif end is not None:
            self.handle.registerTimer(end // 1_000_000 + 1)
        self.value.update(bar.state())
        yield _frame(key[0], out)


def stream_bars(messages: DataFrame, minutes: int, stale_ns: int = STALE, late: str = "0 seconds", seed: DataFrame | None = None) -> DataFrame:
    """Streaming form: the same rows as ``fold_bars`` for messages that arrive at most
    ``late`` out of order, judged up to the watermark. Needs the RocksDB state store."""
    timed = messages.withColumn("__at", F.timestamp_millis(F.expr("at_ns div 1000000"))).withWatermark("__at", late)
    keyed = timed.groupBy("instrument")
    first = seed.select("instrument", F.col("bucket").cast("long").alias("bucket")).groupBy("instrument") if seed is not None else None
    return keyed.transformWithStateInPandas(FormingProcessor(minutes, stale_ns), OUT, "Append", "EventTime", initialState=first)


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which timers and lists need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def updates_of(ticks: DataFrame, minutes: int, delay_ns: Column | None = None) -> DataFrame:
    """The messages a feed would send of these trades: after each, its bar so far, received
    ``delay_ns`` after the trade."""
    w = Window.partitionBy("instrument", "bucket").orderBy("ns", "sequence").rowsBetween(Window.unboundedPreceding, 0)
    rows = ticks.withColumn("bucket", bucket(F.col("ns"), minutes))
    return rows.select(
        "instrument", (F.col("ns") + (delay_ns if delay_ns is not None else F.lit(0))).cast("long").alias("at_ns"), "sequence", "bucket",
        F.first("price").over(w).alias("open"), F.max("price").over(w).alias("high"), F.min("price").over(w).alias("low"), F.col("price").alias("close"),
        F.sum("volume").over(w).alias("volume"), F.count("*").over(w).alias("trades"),
    )
