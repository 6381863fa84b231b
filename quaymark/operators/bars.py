"""From trade ticks to bars: time-bucket aggregation, coarser bars, validity and quality.

Times are whole nanoseconds since the epoch (``BIGINT``), never floats. Buckets are never
filled: a missing bucket stays a gap, and later operators see it. The aggregation of ticks
is partial before its only shuffle; what follows works on bars, whose number depends on the
time covered and not on the number of ticks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE = 60_000_000_000
WIDTHS = (1, 5, 15, 60, 240)


def ticks_from_events(events: DataFrame, instrument: Column | None = None) -> DataFrame:
    """The event stream read as trades: ``instrument, ns, ms, date, sequence, price, volume``."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return events.select(
        (F.col("event_type") if instrument is None else instrument).alias("instrument"),
        (micros * 1000).alias("ns"), F.floor(micros / 1000).alias("ms"), F.to_date("ts").alias("date"),
        F.col("event_id").alias("sequence"), F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"),
    )


def valid_tick() -> Column:
    """Finite positive price, finite volume that is not negative, a time."""
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return F.col("ns").isNotNull() & fine("price") & (F.col("price") > 0) & fine("volume") & (F.col("volume") >= 0)


def since(ticks: DataFrame, ns: int) -> DataFrame:
    """Ticks from ``ns`` on. The date bound beside it prunes partitions of a lake."""
    return ticks.filter((F.col("ns") >= ns) & (F.col("date") >= F.to_date(F.timestamp_seconds(F.lit(ns // 1_000_000_000)))))


def bucket(ns: Column, minutes: int) -> Column:
    width = F.lit(minutes * MINUTE)
    return ns - F.pmod(ns, width)


def ohlc(ticks: DataFrame, minutes: int, completed_only: bool = True) -> DataFrame:
    """Open, high, low, close, volume and count of each bucket; ties in time go by
    sequence. With ``completed_only`` buckets that end after the instrument's last trade
    are left out."""
    if minutes not in WIDTHS:
        raise ValueError(f"width of {minutes} minutes; known are {WIDTHS}")
    order = F.struct("ns", "sequence")
    bars = (
        ticks.filter(valid_tick()).groupBy("instrument", bucket(F.col("ns"), minutes).alias("bucket"))
        .agg(
            F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("trades"), F.max("ns").alias("last_ns"),
        )
    )
    if completed_only:
        newest = F.max("last_ns").over(Window.partitionBy("instrument"))
        bars = bars.withColumn("__newest", newest).filter(F.col("bucket") + minutes * MINUTE <= F.col("__newest")).drop("__newest")
    return bars.drop("last_ns")


def coarser(bars: DataFrame, minutes: int, step: int, closed: Column | None = None) -> DataFrame:
    """Bars of ``minutes`` from bars of ``step`` minutes. A group counts only if each of its
    slots is there exactly once; its volume is null if one of them has none."""
    slots = minutes // step
    rows = bars if closed is None else bars.filter(F.coalesce(closed, F.lit(True)))
    out = rows.groupBy("instrument", bucket(F.col("bucket"), minutes).alias("start")).agg(
        F.min_by("open", "bucket").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bucket").alias("close"),
        F.when(F.bool_and(F.col("volume").isNotNull()), F.sum("volume")).alias("volume"), F.sum("trades").alias("trades"),
        F.count("*").alias("n"), F.count_distinct("bucket").alias("slots"),
    )
    return out.filter((F.col("n") == slots) & (F.col("slots") == slots)).drop("n", "slots").withColumnRenamed("start", "bucket")


def by_time(*keys: str):
    return Window.partitionBy(*(keys or ("instrument",))).orderBy("bucket")


def with_steps(bars: DataFrame, minutes: int) -> DataFrame:
    """``step_ok`` (the bar follows its predecessor without a gap) and ``run`` (how many
    bars without a gap end here)."""
    w = by_time()
    step = F.col("bucket") - F.lag("bucket").over(w)
    bars = bars.withColumn("step_ok", F.coalesce(step == minutes * MINUTE, F.lit(False)))
    bars = bars.withColumn("__island", F.sum(F.when(F.col("step_ok"), 0).otherwise(1)).over(w))
    return bars.withColumn("run", F.row_number().over(by_time("instrument", "__island"))).drop("__island")


def valid_bar() -> Column:
    """Prices positive and consistent, volume null or not negative."""
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    positive = prices[0] > 0
    for p in prices[1:]:
        positive = positive & (p > 0)
    return positive & (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close")) & (F.coalesce(F.col("volume"), F.lit(0.0)) >= 0)


def quality(bars: DataFrame, minutes: int) -> DataFrame:
    """Per instrument: bars, invalid ones, repeated times, gaps, missing intervals, status."""
    w = by_time()
    step = F.col("bucket") - F.lag("bucket").over(w)
    width = minutes * MINUTE
    rows = bars.withColumn("step", step)
    out = rows.groupBy("instrument").agg(
        F.count("*").alias("bars"), F.count_if(~valid_bar()).alias("invalid"), F.count_if(F.col("step") == 0).alias("duplicates"),
        F.count_if(F.col("step") > width).alias("gaps"),
        F.coalesce(F.sum(F.when(F.col("step") > width, F.floor(F.col("step") / width) - 1)), F.lit(0)).cast("long").alias("missing"),
    )
    return out.withColumn("status", F.when(F.col("invalid") + F.col("duplicates") > 0, "invalid").when(F.col("gaps") > 0, "gaps").otherwise("complete"))


def merge_keep_last(history: DataFrame, incoming: DataFrame, keys: list[str], version: str, keep: int | None = None) -> DataFrame:
    """Union of both; of rows with equal keys the one with the highest version stays; then
    the newest ``keep`` of each instrument."""
    both = history.unionByName(incoming)
    rows = both.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in both.columns if c not in keys]), version).alias("__r")).select(*keys, "__r.*")
    if keep is None:
        return rows
    newest = Window.partitionBy("instrument").orderBy(F.desc("bucket"))
    return rows.withColumn("__n", F.row_number().over(newest)).filter(F.col("__n") <= keep).drop("__n")


def daily_levels(bars: DataFrame, minutes: int) -> DataFrame:
    """Per bar: yesterday's high and low (UTC; only of days without a missing bar) and the
    range of the first hour's bars of today, which is known from the second hour on and
    counts until the end of the fourth."""
    day = 24 * 60 * MINUTE
    slots = 24 * 60 // minutes
    first = max(1, 60 // minutes)
    tagged = bars.withColumn("day", F.expr(f"bucket div {day}L"))
    opening = F.col("bucket") < F.col("day") * day + first * minutes * MINUTE
    days = tagged.groupBy("instrument", "day").agg(
        F.count("*").alias("n"), F.max("high").alias("d_high"), F.min("low").alias("d_low"),
        F.max(F.when(opening, F.col("high"))).alias("o_high"), F.min(F.when(opening, F.col("low"))).alias("o_low"), F.count_if(opening).alias("o_n"),
    )
    before = days.filter(F.col("n") == slots).select("instrument", (F.col("day") + 1).alias("day"), F.col("d_high").alias("previous_day_high"), F.col("d_low").alias("previous_day_low"))
    today = days.filter(F.col("o_n") == first).select("instrument", "day", F.col("o_high").alias("opening_high"), F.col("o_low").alias("opening_low"))
    known = (F.col("bucket") >= F.col("day") * day + 60 * MINUTE) & (F.col("bucket") < F.col("day") * day + 4 * 60 * MINUTE)
    both = tagged.join(before, ["instrument", "day"], "left").join(today, ["instrument", "day"], "left")
    return both.withColumns({c: F.when(known, F.col(c)) for c in ("opening_high", "opening_low")})
