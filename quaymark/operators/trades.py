"""From signals to labelled trades: costs, plans, barrier labels, selection, splits.

The label of a trade is a look ahead over at most ``MAX_BARS`` bars. Bars carry their next
bars as one array (a window over the instrument's bars), so a plan finds its outcome
without a range join. One position at a time is a chain of links (``selection``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import MINUTE
from .selection import non_overlapping, nth_values

MAX_BARS = 16
COSTS = (1.0, 1.5, 2.0)
FEE_BPS, SLIPPAGE_BPS = 2.0, 2.0


def round_trip_fee(entry: Column, exit: Column, fee_bps: Column | float, per_unit: float = 0.0) -> Column:
    return (entry + exit) * fee_bps / 10000 + 2 * per_unit


def directional_cost(price: Column, fee_bps: float = FEE_BPS, slippage_bps: float = SLIPPAGE_BPS, per_unit: float = 0.0) -> Column:
    """Share of the price that a round trip costs."""
    return F.lit(2 * (fee_bps + slippage_bps) / 10000) + 2 * per_unit / price


def position_size(budget: Column, unit_risk: Column, capital: Column, entry: Column) -> Column:
    """Units that risk at most the budget and cost at most the capital."""
    return F.when((unit_risk > 0) & (entry > 0), F.least(budget / unit_risk, capital / entry))


def plans(signals: DataFrame, costs: tuple[float, ...] = COSTS, fee_bps: float = FEE_BPS, slippage_bps: float = SLIPPAGE_BPS, quote: str | None = None) -> DataFrame:
    """Each signal under each cost multiplier: entry after slippage, net risk and reward,
    and whether the plan is valid. ``quote`` names a column with the price to enter at
    (default: the signal's); a quote more than half an ATR away is not valid."""
    out = signals.withColumn("cost", F.explode(F.array(*[F.lit(c) for c in costs])))
    way, slip, fee = F.col("way"), F.col("cost") * slippage_bps / 10000, F.col("cost") * fee_bps
    base = F.col(quote) if quote else F.col("entry")
    out = out.withColumn("reference", F.col("entry")).withColumn("entry", base * (1 + way * slip))
    exit_stop, exit_target = F.col("stop") * (1 - way * slip), F.col("target") * (1 - way * slip)
    out = out.withColumn("net_risk", way * (F.col("entry") - exit_stop) + round_trip_fee(F.col("entry"), exit_stop, fee))
    out = out.withColumn("net_reward", way * (exit_target - F.col("entry")) - round_trip_fee(F.col("entry"), exit_target, fee))
    reason = (
        F.when((way * (F.col("reference") - F.col("stop")) <= 0) | (way * (F.col("target") - F.col("reference")) <= 0) | (F.col("stop") <= 0) | (F.col("target") <= 0), "structure")
        .when((way * (F.col("entry") - F.col("stop")) <= 0) | (way * (F.col("target") - F.col("entry")) <= 0), "levels")
        .when(F.abs(base - F.col("reference")) > 0.5 * F.col("atr"), "drift")
        .when(~((F.col("net_risk") > 0) & (F.col("net_reward") > 0)), "costs")
    )
    return out.withColumns({"reason": reason, "valid": reason.isNull(), "net_rr": F.when(F.col("net_risk") > 0, F.col("net_reward") / F.col("net_risk"))})


def with_future(bars: DataFrame, n: int = MAX_BARS) -> DataFrame:
    """(instrument, bucket, future): the next ``n`` bars of each bar."""
    ahead = Window.partitionBy("instrument").orderBy("bucket").rowsBetween(1, n)
    future = F.collect_list(F.struct("bucket", "open", "high", "low", "close")).over(ahead)
    return bars.select("instrument", "bucket", future.alias("future"))


def label(planned: DataFrame, bars: DataFrame, minutes: int, max_bars: int = MAX_BARS, end: Column | None = None) -> DataFrame:
    """First touch of the barriers, entering at the next bar's start. In one bar the stop
    counts before the target; a gap through the stop fills at the bar's open, the target
    fills at its level. A gap in time, or bars that end too soon (or reach past ``end``),
    censor the trade; no touch until the last bar is an expiry at its close, with y = 0."""
    width = minutes * MINUTE
    out = planned.join(with_future(bars, max_bars), ["instrument", "bucket"], "left")
    way = F.col("way")
    rows = F.transform(F.coalesce("future", F.array()), lambda b, i: F.struct(
        b["bucket"].alias("t"), (b["bucket"] == F.col("bucket") + (i + 1) * F.lit(width)).alias("next"),
        F.when(F.when(way == 1, b["low"] <= F.col("stop")).otherwise(b["high"] >= F.col("stop")), F.when(way == 1, F.least("stop", b["open"])).otherwise(F.greatest("stop", b["open"]))).alias("stopped"),
        F.when(way == 1, b["high"] >= F.col("target")).otherwise(b["low"] <= F.col("target")).alias("hit"), b["close"].alias("close"), i.alias("i")))
    if end is not None:
        rows = F.filter(rows, lambda r: r["t"] + F.lit(width) <= end)
    out = out.withColumn("path", rows)
    out = out.withColumn("event", F.try_element_at(F.filter("path", lambda r: ~r["next"] | r["stopped"].isNotNull() | r["hit"] | (r["i"] == max_bars - 1)), F.lit(1)))
    e = F.col("event")
    status = (
        F.when(~F.col("valid"), "censored").when(e.isNull() | ~e["next"], "censored").when(e["stopped"].isNotNull(), "stop").when(e["hit"], "target").otherwise("expired")
    )
    out = out.withColumn("status", status)
    gross = F.when(F.col("status") == "stop", e["stopped"]).when(F.col("status") == "target", F.col("target")).when(F.col("status") == "expired", e["close"])
    exit = gross * (1 - way * F.col("cost") * SLIPPAGE_BPS / 10000)
    net = way * (exit - F.col("entry")) - round_trip_fee(F.col("entry"), exit, F.col("cost") * FEE_BPS)
    return out.withColumns({
        "entry_ns": F.col("bucket") + F.lit(width), "label_end_ns": F.when(status != "censored", e["t"] + F.lit(width)), "exit": exit,
        "y": F.when(F.col("status") == "target", 1).when(F.col("status").isin("stop", "expired"), 0), "net_r": net / F.col("net_risk"),
        "ambiguous": F.coalesce((F.col("status") == "stop") & e["hit"], F.lit(False)),
    }).drop("path", "event", "future")


def label_join(planned: DataFrame, bars: DataFrame, minutes: int, max_bars: int = MAX_BARS) -> DataFrame:
    """The same first touch as a range join on the buckets ahead: (instrument, bucket,
    rule, cost, status). Slower; the other form is checked against it."""
    width = minutes * MINUTE
    ahead = planned.filter("valid").select("instrument", "bucket", "rule", "cost", "way", "stop", "target", F.explode(F.sequence(F.lit(1), F.lit(max_bars))).alias("k"))
    b = bars.select("instrument", F.col("bucket").alias("at"), "high", "low")
    seen = ahead.withColumn("at", F.col("bucket") + F.col("k") * F.lit(width)).join(b, ["instrument", "at"], "left")
    stopped = F.when(F.col("way") == 1, F.col("low") <= F.col("stop")).otherwise(F.col("high") >= F.col("stop"))
    hit = F.when(F.col("way") == 1, F.col("high") >= F.col("target")).otherwise(F.col("low") <= F.col("target"))
    kind = F.when(F.col("high").isNull(), "censored").when(stopped, "stop").when(hit, "target").when(F.col("k") == max_bars, "expired")
    return seen.withColumn("kind", kind).filter("kind IS NOT NULL").groupBy("instrument", "bucket", "rule", "cost").agg(F.min_by("kind", "k").alias("status"))


def one_position(trades: DataFrame, keys: list[str]) -> DataFrame:
    """One-position backtest: the next trade only after the last one's exit bar."""
    return non_overlapping(trades, keys, strict=False)


def split_times(trades: DataFrame, shares: tuple[float, ...] = (0.5, 0.75), time: str = "entry_ns") -> list[int]:
    """Entry times at the given shares of the distinct entry times, in order, by counts per
    range of times."""
    n = trades.select(time).distinct().count()
    return nth_values(trades, time, [int(n * s) for s in shares])


def purged_split(trades: DataFrame, minutes: int, shares: tuple[float, float] = (0.5, 0.75), embargo_bars: int = MAX_BARS) -> DataFrame:
    """``part``: train, validation or test in order of time. A trade whose label reaches
    past its part's end is purged; parts after the first start an embargo later."""
    first, second = split_times(trades, shares)
    gap = embargo_bars * minutes * MINUTE
    t, e = F.col("entry_ns"), F.col("label_end_ns")
    part = (
        F.when((t < first) & (e < first), "train").when((t >= first + gap) & (t < second) & (e < second), "validation").when(t >= second + gap, "test").otherwise("purged")
    )
    return trades.withColumn("part", part)


def walk_forward(trades: DataFrame, minutes: int, cuts: tuple[float, ...] = (0.4, 0.6, 0.8, 1.0), embargo_bars: int = MAX_BARS) -> DataFrame:
    """(fold, part, ...): trades of each fold's fit window and of its test window after an
    embargo; boundaries are floored to a bar."""
    low, high = trades.agg(F.min("entry_ns"), F.max("label_end_ns")).first()
    if low is None or high is None:
        return trades.withColumns({"fold": F.lit(0), "part": F.lit("fit")}).limit(0)
    width = minutes * MINUTE
    at = [low + int((high - low) * c) // width * width for c in cuts]
    out = []
    for k in range(len(cuts) - 1):
        t, e = F.col("entry_ns"), F.col("label_end_ns")
        fit = trades.filter((t < at[k]) & (e < at[k])).withColumn("part", F.lit("fit"))
        test = trades.filter((t >= at[k] + embargo_bars * width) & (t < at[k + 1]) & (e < at[k + 1] + (1 if k == len(cuts) - 2 else 0))).withColumn("part", F.lit("test"))
        out.append(fit.unionByName(test).withColumn("fold", F.lit(k)))
    both = out[0]
    for f in out[1:]:
        both = both.unionByName(f)
    return both


def class_label(bars: DataFrame, minutes: int, band: Column, ahead: int = 4) -> DataFrame:
    """UP, DOWN or FLAT from the return ``ahead`` bars later against a band; null unless
    all bars on the way are there."""
    w = Window.partitionBy("instrument").orderBy("bucket")
    width = minutes * MINUTE
    later, at = F.lead("close", ahead).over(w), F.lead("bucket", ahead).over(w)
    change = later / F.col("close") - 1
    out = bars.withColumn("change", F.when(at == F.col("bucket") + F.lit(ahead * width), change))
    return out.withColumn("class", F.when(F.col("change") > band, "UP").when(F.col("change") < -band, "DOWN").when(F.col("change").isNotNull(), "FLAT"))
