"""Streams: bars from ticks with late-data rules, and keyed state for quotes, books and
followed signals. Every operator has a batch form that gives the same rows for the same
events; tests compare the two.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.bars import MINUTE, bucket

TICKS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def stream_table(spark: SparkSession, folder: str, name: str, schema: str, files: int | None = 1) -> DataFrame:
    """A folder's Parquet table (one file, several, or a folder of files) as a stream of
    ``files`` files a trigger; None: all there are."""
    stream = spark.readStream.schema(schema)
    return (stream.option("maxFilesPerTrigger", files) if files else stream).parquet(f"{folder}/{name}*.parquet")


def stream_ohlc(ticks: DataFrame, minutes: int, late: str = "0 seconds") -> DataFrame:
    """Bars of a tick stream (``instrument, ts, sequence, price, volume``). A bar comes out
    when the watermark passes its end, so the forming one never does; ticks later than
    ``late`` behind the newest are dropped."""
    order = F.struct("ts", "sequence")
    return (
        ticks.withWatermark("ts", late).groupBy("instrument", F.window("ts", f"{minutes} minutes").alias("w"))
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("trades"))
        .select("instrument", (F.unix_micros("w.start") * 1000).alias("bucket"), "open", "high", "low", "close", "volume", "trades")
    )


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all there is, into a table in ``folder``; its rows so far."""
    spark, path = stream.sparkSession, f"{folder}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{path}-state").option("path", path).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def upsert_batches(stream: DataFrame, keys: list[str], version: str, path: str, state: str):
    """Keyed sink: each micro-batch keeps the newest version of each key and is written as
    a new generation of the table (``path/generation=N``)."""

    def write(batch: DataFrame, n: int) -> None:
        cols = [c for c in batch.columns if c not in keys]
        batch.groupBy(*keys).agg(F.max_by(F.struct(*cols), version).alias("r")).select(*keys, "r.*").write.mode("overwrite").parquet(f"{path}/generation={n}")

    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()


def newest_of_generations(spark: SparkSession, path: str, keys: list[str], version: str) -> DataFrame:
    rows = spark.read.parquet(path).drop("generation")
    cols = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), version).alias("r")).select(*keys, "r.*")


# -- trades in order ------------------------------------------------------------------


def ordered_trades(trades: DataFrame, now_ns: Column | None = None, ahead_ns: int = 60_000_000_000) -> DataFrame:
    """Trades whose id and time both advance on all before them in the instrument, by order
    of arrival (``sequence``); those ahead of the clock by more than a minute are dropped."""
    if now_ns is not None:
        trades = trades.filter(F.col("ns") <= now_ns + ahead_ns)
    past = Window.partitionBy("instrument").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    top_id, top_ns = F.max("trade_id").over(past), F.max("ns").over(past)
    return trades.withColumns({"__i": top_id, "__t": top_ns}).filter("(__i IS NULL OR trade_id > __i) AND (__t IS NULL OR ns >= __t)").drop("__i", "__t")


def stream_ordered_trades(trades: DataFrame) -> DataFrame:
    """The same as keyed state: (last id, last time) of each instrument."""

    def keep(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last_id, last_ns = state.get if state.exists else (None, None)
        for f in frames:
            rows = []
            for row in f.sort_values("sequence").itertuples(index=False):
                if last_id is None or (row.trade_id > last_id and row.ns >= last_ns):
                    rows.append(row)
                last_id = row.trade_id if last_id is None else max(last_id, row.trade_id)
                last_ns = row.ns if last_ns is None else max(last_ns, row.ns)
            yield pd.DataFrame(rows, columns=f.columns)
        state.update((int(last_id), int(last_ns)))

    out = "instrument string, sequence long, trade_id long, ns long, price double"
    from pyspark.sql.streaming.state import GroupStateTimeout

    return trades.select("instrument", "sequence", "trade_id", "ns", "price").groupBy("instrument").applyInPandasWithState(keep, out, "last_id long, last_ns long", "append", GroupStateTimeout.NoTimeout)


# -- order books ----------------------------------------------------------------------


class Book:
    """Price levels of one symbol: exact lexemes, depth-trimmed, checked."""

    def __init__(self, depth: int = 10):
        self.depth, self.sides, self.ready = depth, {"bid": {}, "ask": {}}, False

    def best(self, side: str) -> list[tuple[float, str, str]]:
        levels = sorted(((float(p), p, q) for p, q in self.sides[side].items()), reverse=side == "bid")
        return levels[: self.depth]

    def checksum(self) -> int:
        """CRC-32 over the ten best asks then bids, points and leading zeros removed."""
        digits = lambda x: x.replace(".", "").lstrip("0")
        return zlib.crc32("".join(digits(p) + digits(q) for side in ("ask", "bid") for _, p, q in self.best(side)[:10]).encode())

    def apply(self, kind: str, levels: list[tuple[str, str, str]], checksum: int | None = None) -> str | None:
        """Levels are (side, price, quantity); quantity zero deletes. A crossed book or a
        wrong checksum resets it, and only a snapshot makes it ready again."""
        if kind == "snapshot":
            self.sides, self.ready = {"bid": {}, "ask": {}}, True
        if not self.ready:
            return "no-snapshot"
        for side, price, quantity in levels:
            if float(quantity) == 0:
                self.sides[side].pop(price, None)
            else:
                self.sides[side][price] = quantity
        for side in self.sides:
            self.sides[side] = {p: q for _, p, q in self.best(side)}
        bid, ask = self.best("bid")[:1], self.best("ask")[:1]
        reason = "crossed" if bid and ask and bid[0][0] >= ask[0][0] else "checksum" if checksum is not None and checksum != self.checksum() else None
        if reason:
            self.sides, self.ready = {"bid": {}, "ask": {}}, False
        return reason


def replay_books(messages: DataFrame, depth: int = 10) -> DataFrame:
    """Book after every message (``session, symbol, sequence, kind, side, price, quantity``,
    prices as text): best levels, checksum, fault. Sessions are never bridged: each
    (session, symbol) starts empty, so each is a group of its own."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        book, out = Book(depth), []
        for row in f.sort_values("sequence").itertuples(index=False):
            fault = book.apply(row.kind, [(row.side, row.price, row.quantity)])
            bid, ask = book.best("bid")[:1], book.best("ask")[:1]
            out.append((row.session, row.symbol, row.sequence, bid[0][0] if bid else None, ask[0][0] if ask else None, len(book.sides["bid"]), len(book.sides["ask"]), book.checksum(), fault))
        return pd.DataFrame(out, columns=["session", "symbol", "sequence", "bid", "ask", "bids", "asks", "checksum", "fault"])

    return messages.groupBy("session", "symbol").applyInPandas(run, "session string, symbol string, sequence long, bid double, ask double, bids int, asks int, checksum long, fault string")


def book_changes(books: DataFrame) -> DataFrame:
    """(session, symbol, sequence, price, old, new) of levels that differ from the message
    before; ``levels`` is a map price -> quantity."""
    w = Window.partitionBy("session", "symbol").orderBy("sequence")
    empty = F.create_map().cast("map<string,string>")
    both = books.withColumn("before", F.coalesce(F.lag("levels").over(w), empty))
    changed = F.map_filter(F.map_zip_with("before", "levels", lambda k, a, b: F.struct(a.alias("old"), b.alias("new"))), lambda k, v: ~v["old"].eqNullSafe(v["new"]))
    return both.select("session", "symbol", "sequence", F.explode(changed).alias("price", "c")).select("session", "symbol", "sequence", "price", "c.old", "c.new")


# -- quotes, latency, health ------------------------------------------------------------


def select_quote(quotes: DataFrame, now_ns: Column, fresh_s: int = 30) -> DataFrame:
    """Per symbol: a stream's quote younger than ``fresh_s`` wins, else the newest valid."""
    valid = (F.col("price") > 0) & (F.coalesce("bid", F.lit(0.0)) <= F.coalesce("ask", F.lit(float("inf"))))
    age = now_ns - F.col("ns")
    fresh = (F.col("transport") == "websocket") & (age < fresh_s * 1_000_000_000)
    best = F.max_by(F.struct("transport", "price", "ns"), F.struct(fresh.cast("int"), "ns"))
    return quotes.filter(valid).groupBy("symbol").agg(best.alias("q")).select("symbol", "q.*")


def market_health(quotes: DataFrame, now_ns: Column, stale_s: int = 30, snapshot_s: int = 120) -> DataFrame:
    """State of each quote: live, snapshot, stale; its age and spread in basis points. A stream's
    quote is stale from ``stale_s`` on, any other from ``snapshot_s`` on."""
    age = (now_ns - F.col("ns")) / 1e9
    state = F.when(age.isNull() | (age < -60), "invalid").when(age >= F.when(F.col("transport") == "websocket", stale_s).otherwise(snapshot_s), "stale").when(F.col("transport") == "websocket", "live").otherwise("snapshot")
    mid = (F.col("bid") + F.col("ask")) / 2
    return quotes.withColumns({"state": state, "age_s": age, "spread_bps": F.when((F.col("bid") > 0) & (F.col("ask") >= F.col("bid")), 10000 * (F.col("ask") - F.col("bid")) / mid)})


def latency_summary(messages: DataFrame, *keys: str) -> DataFrame:
    """Counts and quantiles of latency in milliseconds; negative is clock skew, beyond two
    minutes invalid."""
    fine = F.when(F.abs(F.col("latency_ms")) <= 120_000, F.col("latency_ms"))
    out = messages.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("latency_ms") < 0).alias("skewed"), F.count_if(F.abs(F.col("latency_ms")) > 120_000).alias("invalid"),
        *[F.percentile(F.when(fine >= 0, fine), p).alias(f"p{int(100 * p)}") for p in (0.5, 0.95, 0.99)],
    )
    return out


# -- followed signals, paper positions ----------------------------------------------------

FOLLOW = "id string, status string, at_ns long, price double"


def _touch(side: str, stop: float, target: float, price: float) -> str | None:
    way = 1 if side == "BUY" else -1
    return "stop" if way * (price - stop) <= 0 else "target" if way * (price - target) >= 0 else None


def follow_signals(signals: DataFrame, quotes: DataFrame) -> DataFrame:
    """First touch of each signal in real quotes of its symbol between its reference time
    and its horizon; the stop is asked first; none is ``expired`` when quotes go past the
    horizon, else ``watching``. Signals are matched by (symbol, hour), so a symbol with very
    many quotes is many join keys; one row per signal comes out of minima."""
    hour = 3_600_000_000_000
    watch = signals.withColumn("h", F.explode(F.sequence(F.expr(f"reference_ns div {hour}L"), F.expr(f"horizon_ns div {hour}L"))))
    q = quotes.select("symbol", F.col("ns").alias("q_ns"), F.col("price").alias("q_price"), F.col("sequence").alias("q_seq"), F.expr(f"ns div {hour}L").alias("h"))
    way = F.when(F.col("side") == "BUY", 1).otherwise(-1)
    touch = F.when(way * (F.col("q_price") - F.col("stop")) <= 0, "stop").when(way * (F.col("q_price") - F.col("target")) >= 0, "target")
    hits = watch.join(q, ["symbol", "h"]).filter("q_ns >= reference_ns AND q_ns < horizon_ns").withColumn("touch", touch).filter("touch IS NOT NULL")
    first = hits.groupBy("id").agg(F.min_by(F.struct("touch", "q_ns", "q_price"), F.struct("q_ns", "q_seq")).alias("t"))
    newest = quotes.groupBy("symbol").agg(F.max("ns").alias("newest"))
    out = signals.join(first, "id", "left").join(newest, "symbol", "left")
    status = F.coalesce(F.col("t.touch"), F.when(F.col("newest") >= F.col("horizon_ns"), "expired").otherwise("watching"))
    return out.select("id", status.alias("status"), F.coalesce(F.col("t.q_ns"), F.when(status == "expired", F.col("horizon_ns"))).alias("at_ns"), F.col("t.q_price").alias("price"))


def stream_follow(events: DataFrame) -> DataFrame:
    """Followed signals as keyed state over one stream of signals (``kind = 'signal'``) and
    quotes, by symbol: open signals are the state, closed ones come out."""
    import json

    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        open_now = json.loads(state.get[0]) if state.exists else {}
        for f in frames:
            done = []
            for r in f.sort_values(["ns", "sequence"]).itertuples(index=False):
                if r.kind == "signal":
                    open_now.setdefault(r.id, [r.side, r.stop, r.target, int(r.ns), int(r.horizon_ns)])
                    continue
                for id, (side, stop, target, start, end) in list(open_now.items()):
                    if r.ns >= end:
                        done.append((id, "expired", end, None))
                        del open_now[id]
                    elif r.ns >= start and (t := _touch(side, stop, target, r.price)):
                        done.append((id, t, int(r.ns), float(r.price)))
                        del open_now[id]
            yield pd.DataFrame(done, columns=["id", "status", "at_ns", "price"])
        state.update((json.dumps(open_now),))

    return events.groupBy("symbol").applyInPandasWithState(step, FOLLOW, "open string", "append", GroupStateTimeout.NoTimeout)


def paper_gaps(observations: DataFrame, gap_s: int = 30) -> DataFrame:
    """Observations of a position with ``censored``: a gap over ``gap_s`` or a change of
    session or stream generation before it makes its label void (its result still counts)."""
    w = Window.partitionBy("position").orderBy("ns")
    gap = F.col("ns") - F.lag("ns").over(w) > gap_s * 1_000_000_000
    moved = ~F.col("session").eqNullSafe(F.lag("session").over(w)) & F.lag("ns").over(w).isNotNull()
    broken = F.coalesce(gap, F.lit(False)) | F.coalesce(moved, F.lit(False))
    return observations.withColumn("censored", F.max(broken).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def signal_changes(decisions: DataFrame) -> DataFrame:
    """Decisions whose signature (rule, side) differs from the one before in the instrument."""
    w = Window.partitionBy("instrument").orderBy("bucket")
    signature = F.concat_ws("|", "rule", "side")
    return decisions.withColumn("signature", signature).withColumn("__b", F.lag("signature").over(w)).filter(~F.col("signature").eqNullSafe(F.col("__b"))).drop("__b")


def last_run(bars: DataFrame, minutes: int) -> DataFrame:
    """Per instrument: how many bars without a gap end at its newest bar."""
    from ..operators.bars import with_steps

    return with_steps(bars, minutes).groupBy("instrument").agg(F.max_by("run", "bucket").alias("run"), F.max("bucket").alias("bucket"))


def forming(ticks: DataFrame, minutes: int) -> DataFrame:
    """The bucket each instrument is in, from its newest tick."""
    return ticks.groupBy("instrument").agg(F.max("ns").alias("ns")).withColumn("bucket", bucket(F.col("ns"), minutes)).withColumn("ends_in_ns", F.col("bucket") + minutes * MINUTE - F.col("ns"))
