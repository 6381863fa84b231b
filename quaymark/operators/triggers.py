"""Where the next bar's close must go for a rule to fire: its crossing, solved for the close.

The next decision drops the oldest bar of its window before it seeds its means, so the state
is taken from the newest 159 bars. A mean moves as ``m + a (x - m)``, so "two means cross at
``x``" is one linear equation in ``x``; the same holds for a Wilder ratio, a band of the last
closes, and a rate of change. A level is necessary, never sufficient: the other checks of the
rule must hold too. Where highs, lows or volume still to come decide, there is no price, only
a reference. All of it is columns: one fold over each window, then arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import ADVANCED, RULES

WINDOW = 159
_RATES = {"e9": 9, "e12": 12, "e21": 21, "e26": 26, "e50": 50}
#: Rules whose bars to come decide, and the columns a buyer and a seller look at.
REFERENCES = {
    "vwap": ("vwap", "vwap"), "continuation": ("e9", "e9"), "keltner-reentry": ("e20 - 2 * atr", "e20 + 2 * atr"), "adx-continuation": ("high", "low"), "ichimoku": ("cloud_top", "cloud_bottom"),
    "parabolic-sar": ("sar", "sar"), "williams-recovery": ("high", "low"), "dema-reclaim": ("dema", "dema"), "chandelier": ("chandelier_short", "chandelier_long"), "kama-reclaim": ("kama", "kama"), "elder-ray": ("ema13", "ema13"),
} | {id: ("close", "close") for id in "stochastic cci-recovery aroon fisher-recovery trix tsi vortex ppo ultimate-recovery smi stoch-rsi demarker awesome".split()}
PATTERNS = ("engulfing-reclaim", "fractal-breakout", "failed-breakout")


def _state(closes: Column) -> Column:
    """Means, MACD signal and Wilder's gain and loss at the end of a window of closes."""
    first = F.element_at(closes, 1)
    start = F.struct(F.lit(0).alias("i"), first.alias("c"), *[first.alias(n) for n in _RATES], F.lit(0.0).alias("signal"), F.lit(0.0).alias("gain"), F.lit(0.0).alias("loss"))

    def step(s: Column, x: Column) -> Column:
        mean = {n: s[n] + F.lit(2 / (k + 1)) * (x - s[n]) for n, k in _RATES.items()}
        i = s["i"] + 1
        # the mean of the first 14 changes, then Wilder's smoothing
        smooth = lambda old, v: F.when(i <= 14, old + v / 14).otherwise((old * 13 + v) / 14)
        signal = s["signal"] + F.lit(0.2) * (mean["e12"] - mean["e26"] - s["signal"])
        return F.struct(i.alias("i"), x.alias("c"), *[mean[n].alias(n) for n in _RATES], signal.alias("signal"), smooth(s["gain"], F.greatest(x - s["c"], F.lit(0.0))).alias("gain"), smooth(s["loss"], F.greatest(s["c"] - x, F.lit(0.0))).alias("loss"))

    return F.aggregate(F.slice(closes, 2, WINDOW), start, step)


def trigger_state(bars: DataFrame) -> DataFrame:
    """``bars`` with at least 60 in their window, and the columns the levels are made of."""
    over = "PARTITION BY instrument ORDER BY bucket ROWS BETWEEN {} PRECEDING AND {}"
    rows = bars.withColumns({
        "closes": F.expr(f"collect_list(close) OVER ({over.format(WINDOW - 1, 'CURRENT ROW')})"),
        **{f"{kind}{n}": F.expr(f"{agg}({kind}) OVER ({over.format(n - 1, 'CURRENT ROW')})") for n in (20, 55) for kind, agg in (("high", "max"), ("low", "min"))},
        **{f"mean{n}": F.expr(f"avg(close) OVER ({over.format(n - 1, 'CURRENT ROW')})") for n in (19, 20)},
        **{f"sd{n}": F.expr(f"stddev_pop(close) OVER ({over.format(n - 1, 'CURRENT ROW')})") for n in (19, 20)},
        "base": F.expr("lag(close, 11) OVER (PARTITION BY instrument ORDER BY bucket)"),
        **{f"p{c}": F.expr(f"lag({c}) OVER (PARTITION BY instrument ORDER BY bucket)") for c in ("high", "low", "bucket")},
    }).filter(F.size("closes") >= 60)
    return rows.withColumn("s", _state(F.col("closes"))).select("*", *[F.col("s")[n].alias(n) for n in (*_RATES, "signal", "gain", "loss")]).drop("s", "closes")


def _levels(minutes: int) -> dict[str, tuple[str, str, str, str]]:
    """By rule: the mode of buying and of selling and the SQL of both levels."""
    above = lambda buy, sell: ("close_above", "close_below", buy, sell)
    both = lambda level: above(level, level)
    a9, a21, a12, a26 = (2 / (n + 1) for n in (9, 21, 12, 26))
    inside = f"high < phigh AND low > plow AND bucket - pbucket = {minutes * 60_000_000_000}"
    return {
        "breakout": above("high20", "low20"),
        "ema-cross": both(f"({1 - a21!r} * e21 - {1 - a9!r} * e9) / {a9 - a21!r}"),
        "macd": both(f"(signal - {1 - a12!r} * e12 + {1 - a26!r} * e26) / {a12 - a26!r}"),
        "rsi-recovery": above("greatest(high, close + greatest(0, 13 * (30 / 70D * loss - gain)))", "least(low, close - greatest(0, 13 * (30 / 70D * gain - loss)))"),
        "squeeze": above("mean20 + 2 * sd20", "mean20 - 2 * sd20"),
        # the close that ends on its own band of 20: 19 known closes, two deviations of all 20
        "reversion": ("reentry_above", "reentry_below", "mean19 - sqrt(16 / 3D) * sd19", "mean19 + sqrt(16 / 3D) * sd19"),
        "inside-bar": above(f"CASE WHEN {inside} THEN phigh END", f"CASE WHEN {inside} THEN plow END"),
        "liquidity-sweep": ("sweep_reclaim", "sweep_reject", "low20", "high20"),
        "donchian55": above("high55", "low55"),
        "roc-momentum": above("greatest(base * 1.005D, e50)", "least(base * 0.995D, e50)"),
        "two-bar-pullback": above("greatest(high, phigh)", "least(low, plow)"),
        "nr7-breakout": ("breakout", "breakout", "high", "low"),
    }


def setup_triggers(bars: DataFrame, minutes: int, context: DataFrame | None = None) -> DataFrame:
    """(instrument, bucket, rule, side, mode, price, reference): a row for each bar, rule and
    side. ``context`` (``rules.context``) gives the references of rules without a level; without
    it these are null."""
    state = trigger_state(bars)
    need = [c for c in "vwap atr ema20 ema13 cloud_top cloud_bottom sar dema kama chandelier_short chandelier_long".split()]
    if context is not None:
        state = state.join(context.select("instrument", "bucket", *[F.col(c).alias("e20" if c == "ema20" else c) for c in need]), ["instrument", "bucket"], "left")
    else:
        state = state.withColumns({"e20" if c == "ema20" else c: F.lit(None).cast("double") for c in need})
    levels, entries = _levels(minutes), []
    for rule in RULES:
        buy_mode, sell_mode, buy, sell = levels.get(rule.id, ("close_above", "close_below", "high", "low"))
        references = (buy, sell)
        if rule.id in REFERENCES or rule.id in PATTERNS or rule.buy[: len(ADVANCED)] == ADVANCED:
            mode = "pattern" if rule.id in PATTERNS else "indicator"
            buy_mode, sell_mode, buy, sell, references = mode, mode, "NULL", "NULL", REFERENCES.get(rule.id, ("close", "close"))
        elif rule.id == "inside-bar":
            references = ("phigh", "plow")
        elif rule.id in ("nr7-breakout", "two-bar-pullback", "breakout-retest"):
            references = ("close", "close")
        for side, mode, level, reference in (("BUY", buy_mode, buy, references[0]), ("SELL", sell_mode, sell, references[1])):
            price = F.expr(f"CAST({level} AS DOUBLE)")
            entries.append(F.struct(F.lit(rule.id).alias("rule"), F.lit(side).alias("side"), F.lit(mode).alias("mode"), price.alias("price"), F.expr(f"CAST({reference} AS DOUBLE)").alias("reference")))
    return state.select("instrument", "bucket", F.explode(F.array(*entries)).alias("t")).select("instrument", "bucket", "t.*")
