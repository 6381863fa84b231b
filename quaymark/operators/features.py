"""Readiness of the history and the feature vectors of bars and of planned trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import cycles
from .bars import MINUTE, by_time, valid_bar, with_steps
from .rules import FAMILIES, RULES

VOLUME_BARS = 60
MAX_BARS = 16

#: The features of a bar, in order (fixed values).
MARKET = (
    "return1_atr return4_atr return12_atr ema_fast_atr ema_slow_atr rsi_centered macd_histogram_atr atr_fraction band_position log_volume_ratio volume_available "
    "higher_direction higher_available efficiency choppiness regression_slope_atr regression_r2 candle_body_atr close_location"
).split()
#: Places in ``MARKET`` that change sign with the side of the trade (fixed values).
ALIGNED = (0, 1, 2, 3, 4, 5, 6, 8, 11, 15, 17, 18)


def requirements() -> list[tuple[int, bool]]:
    """(warm-up bars, real volume asked) of the catalogue, each once."""
    return sorted({(r.warmup, r.volume) for r in RULES})


def not_ready(warmup: Column, volume: Column) -> Column:
    """Why a rule may not be asked, over the columns of ``with_history``; null if it may:
    too few bars; a gap or an invalid bar among the last ``warmup``; volume missing in one
    of the last 60."""
    return (
        F.when(F.col("bar") < warmup, "insufficient-history")
        .when((F.col("run") < warmup) | (F.col("sound") < warmup), "non-contiguous-history")
        .when(volume & (F.col("traded") < F.least(F.col("bar"), F.lit(VOLUME_BARS))), "real-volume-required")
    )


def with_history(bars: DataFrame, minutes: int) -> DataFrame:
    """``bar`` (place in the instrument), ``run`` (bars without a gap that end here),
    ``sound`` and ``traded`` (bars since the last invalid one, since the last one without
    volume)."""
    w = by_time()
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = with_steps(bars, minutes).withColumn("bar", F.row_number().over(w))
    since = lambda broken: F.col("bar") - F.coalesce(F.max(F.when(broken, F.col("bar"))).over(so_far), F.lit(0))
    valid = F.coalesce(valid_bar(), F.lit(False))
    return out.withColumns({"sound": since(~valid), "traded": since(~F.coalesce(F.col("volume") > 0, F.lit(False)))})


def readiness(bars: DataFrame, minutes: int) -> DataFrame:
    """(instrument, bucket, warmup, volume, reason) for each bar and requirement of the catalogue."""
    asked = F.array(*[F.struct(F.lit(w).alias("warmup"), F.lit(v).alias("volume")) for w, v in requirements()])
    out = with_history(bars, minutes).withColumn("asked", F.explode(asked))
    return out.select("instrument", "bucket", "asked.warmup", "asked.volume", not_ready(F.col("asked.warmup"), F.col("asked.volume")).alias("reason"))


def ready_signals(signals: DataFrame, bars: DataFrame, minutes: int) -> DataFrame:
    """``signals`` with ``not_ready``: why the rule's history does not suffice, else null."""
    asked = F.create_map(*[x for r in RULES for x in (F.lit(r.id), F.struct(F.lit(r.warmup).alias("warmup"), F.lit(r.volume).alias("volume")))])
    history = with_history(bars, minutes).select("instrument", "bucket", "bar", "run", "sound", "traded")
    out = signals.join(history, ["instrument", "bucket"]).withColumn("__a", asked[F.col("rule")])
    return out.withColumn("not_ready", not_ready(F.col("__a.warmup"), F.col("__a.volume"))).drop("__a", "bar", "run", "sound", "traded")


def market_features(ctx: DataFrame, bars: DataFrame, higher: DataFrame, minutes: int) -> DataFrame:
    """The 19 features of each bar of ``ctx`` as columns; bars where the ATR is zero or a
    feature cannot be told are left out. ``bars`` are those that ``ctx`` was made of, ``higher``
    (instrument, at, direction) the coarser bars' directions by the time they are known."""
    past = bars.select("instrument", "bucket", *[F.lag("close", k).over(by_time()).alias(f"__c{k}") for k in (1, 4, 12)])
    told = with_direction(ctx.join(past, ["instrument", "bucket"]), higher, minutes)
    atr, close = F.col("atr"), F.col("close")
    has = F.coalesce(F.col("has_volume"), F.lit(False)) & F.col("volume_ratio").isNotNull()
    way = F.when(F.col("direction") == "UP", 1.0).when(F.col("direction") == "DOWN", -1.0).otherwise(0.0)
    value = dict(zip(MARKET, (
        (close - F.col("__c1")) / atr, (close - F.col("__c4")) / atr, (close - F.col("__c12")) / atr, (F.col("ema9") - F.col("ema21")) / atr, (F.col("ema21") - F.col("ema50")) / atr,
        (F.col("rsi") - 50) / 50, (F.col("macd") - F.col("macd_signal")) / atr, atr / close, (close - F.col("bb_mean")) / F.greatest(2 * F.col("bb_sd"), atr * 0.1),
        F.when(has, F.log1p("volume_ratio") - F.log(F.lit(2.0))).otherwise(0.0), has.cast("double"), way, F.col("direction").isNotNull().cast("double"),
        F.coalesce("efficiency", F.lit(0.0)), F.coalesce(F.col("chop") / 100, F.lit(0.0)), F.coalesce("ols_slope", F.lit(0.0)) / atr, F.coalesce("ols_r2", F.lit(0.0)), (close - F.col("open")) / atr,
        F.when(F.col("high") > F.col("low"), (2 * close - F.col("high") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0),
    ), strict=True))
    out = told.filter(atr > 0).select("instrument", "bucket", *[v.alias(n) for n, v in value.items()])
    return out.dropna(subset=MARKET)


def with_direction(bars: DataFrame, higher: DataFrame, minutes: int) -> DataFrame:
    """``bars`` with ``direction``: that of the last coarser bar that had ended with the bar,
    in one sorted pass over the union of both."""
    at = bars.withColumns({"__at": F.col("bucket") + minutes * MINUTE, "__kind": F.lit(1)})
    known = higher.select("instrument", F.col("at").alias("__at"), F.lit(0).alias("__kind"), "direction")
    w = Window.partitionBy("instrument").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    both = at.unionByName(known, allowMissingColumns=True).withColumn("direction", F.last("direction", ignorenulls=True).over(w))
    return both.filter("__kind = 1").drop("__at", "__kind")


def trade_features(planned: DataFrame, market: DataFrame, minutes: int, max_bars: int = MAX_BARS) -> DataFrame:
    """``planned`` trades with ``features``: those of their bar, side, net reward to risk, stop
    and target in ATR, bars to expiry and the rule's family (34); then those that change sign
    with the side, the cycles of the entry's time and the rule (116 in all)."""
    way = F.col("way").cast("double")
    one = lambda column, names: [(F.col(column) == n).cast("double") for n in names]
    base = [*[F.col(n) for n in MARKET], way, F.col("net_rr"), way * (F.col("entry") - F.col("stop")) / F.col("atr"), way * (F.col("target") - F.col("entry")) / F.col("atr"), F.lit(float(max_bars)), *one("family", FAMILIES)]
    hour_sin, hour_cos, week_sin, week_cos = cycles((F.col("bucket") + minutes * MINUTE) / 1_000_000)
    more = [*[F.col(MARKET[k]) * way for k in ALIGNED], hour_sin, hour_cos, week_sin, week_cos, *one("rule", [r.id for r in RULES])]
    joined = planned.join(market, ["instrument", "bucket"])
    return joined.withColumn("features", F.array(*base, *more)).drop(*MARKET)
