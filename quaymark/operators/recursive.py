"""Recursive indicators, re-seeded inside the last 160 bars.

Each bar's value comes from its own window, seeded at the window's first bar; a running
value from the start of history is not the same. So all windows of an instrument advance
together: a recursion is one numpy step over a column of windows for each of 160 places.
Each function takes and returns arrays of (windows, places). ``with_recursive`` returns the
last place of each series and, as ``prev_*``, the place before it in the same window.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 160
MINIMUM = 60
CHUNK = 4096
BLOCK = 2048  # bars of an instrument in a task's group, beside the window before them


def scan(step: Callable, *columns: np.ndarray) -> np.ndarray:
    """``step(i, previous, values at i)`` along the places; ``previous`` is None at first."""
    out, value = [], None
    for i in range(columns[0].shape[1]):
        value = step(i, value, *(c[:, i] for c in columns))
        out.append(value)
    return np.stack(out, axis=1)


def ema(x: np.ndarray, n: int) -> np.ndarray:
    """Exponential mean seeded with the first value that is there."""
    a = 2 / (n + 1)
    return scan(lambda i, v, x: x if v is None else np.where(np.isnan(v), x, v + a * (x - v)), x)


def ema_full(x: np.ndarray, n: int) -> np.ndarray:
    """The same, null until ``n`` values were there."""
    seen = np.cumsum(~np.isnan(x), axis=1)
    return np.where(seen >= n, ema(x, n), np.nan)


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    """Wilder's smoothing, seeded with the mean of the first ``n`` values that are there."""
    first = int(np.isnan(x[0]).sum())
    out = np.full(x.shape, np.nan)
    if x.shape[1] < first + n:
        return out
    v = x[:, first : first + n].mean(axis=1)
    out[:, first + n - 1] = v
    for i in range(first + n, x.shape[1]):
        v = (v * (n - 1) + x[:, i]) / n
        out[:, i] = v
    return out


def lag(x: np.ndarray, k: int = 1) -> np.ndarray:
    out = np.full(x.shape, np.nan)
    out[:, k:] = x[:, :-k]
    return out


def rolled(x: np.ndarray, n: int, how: Callable) -> np.ndarray:
    out = np.full(x.shape, np.nan)
    if x.shape[1] >= n:
        out[:, n - 1 :] = how(np.lib.stride_tricks.sliding_window_view(x, n, axis=1), axis=2)
    return out


def ratio(a: np.ndarray, b: np.ndarray, other: float) -> np.ndarray:
    """a / b where b is positive, else ``other``; null stays null."""
    out = np.divide(a, b, out=np.full(np.broadcast(a, b).shape, other), where=b > 0)
    return np.where(np.isnan(a) | np.isnan(b), np.nan, out)


def strength(gain: np.ndarray, loss: np.ndarray) -> np.ndarray:
    rs = np.divide(gain, loss, out=np.zeros(gain.shape), where=loss != 0)
    out = np.where(loss == 0, np.where(gain == 0, 50.0, 100.0), 100 - 100 / (1 + rs))
    return np.where(np.isnan(gain), np.nan, out)


def supertrend(high, low, close, atr, k: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    upper = lower = line = None
    direction = np.full(len(close), -1.0)
    lines, ways = np.full(close.shape, np.nan), np.full(close.shape, np.nan)
    for i in range(close.shape[1]):
        if np.isnan(atr[0, i]):
            continue
        mid = (high[:, i] + low[:, i]) / 2
        up, down = mid + k * atr[:, i], mid - k * atr[:, i]
        if upper is None:
            new_upper, new_lower = up, down
        else:
            before = close[:, i - 1]
            new_upper = np.where((up < upper) | (before > upper), up, upper)
            new_lower = np.where((down > lower) | (before < lower), down, lower)
            direction = np.where(line == upper, np.where(close[:, i] > new_upper, 1.0, -1.0), np.where(close[:, i] < new_lower, -1.0, 1.0))
        upper, lower = new_upper, new_lower
        line = np.where(direction == 1, lower, upper)
        lines[:, i], ways[:, i] = line, direction
    return lines, ways


def directional(high, low, tr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ADX and both directional indices of 14 bars."""
    up, down = high - lag(high), lag(low) - low
    plus = np.where((up > down) & (up > 0), up, 0.0)
    minus = np.where((down > up) & (down > 0), down, 0.0)
    for x in (plus, minus):
        x[:, 0] = np.nan
    tr = tr.copy()
    tr[:, 0] = np.nan
    base = wilder(tr, 14)
    di_plus, di_minus = ratio(100 * wilder(plus, 14), base, 0.0), ratio(100 * wilder(minus, 14), base, 0.0)
    dx = ratio(100 * np.abs(di_plus - di_minus), di_plus + di_minus, 0.0)
    return wilder(dx, 14), di_plus, di_minus


def parabolic(high, low, close) -> tuple[np.ndarray, np.ndarray]:
    """Parabolic stop: acceleration .02 to .2 by .02, direction from the first two closes."""
    lines, ways = np.full(close.shape, np.nan), np.full(close.shape, np.nan)
    rising = close[:, 1] > close[:, 0]
    low2, high2 = np.minimum(low[:, 0], low[:, 1]), np.maximum(high[:, 0], high[:, 1])
    line, extreme = np.where(rising, low2, high2), np.where(rising, high2, low2)
    speed = np.full(len(close), 0.02)
    lines[:, 1], ways[:, 1] = line, np.where(rising, 1.0, -1.0)
    for i in range(2, close.shape[1]):
        h, lo = high[:, i], low[:, i]
        line = line + speed * (extreme - line)
        line = np.where(rising, np.minimum(line, np.minimum(low[:, i - 1], low[:, i - 2])), np.maximum(line, np.maximum(high[:, i - 1], high[:, i - 2])))
        turn = np.where(rising, lo < line, h > line)
        further = ~turn & np.where(rising, h > extreme, lo < extreme)
        line = np.where(turn, np.where(rising, np.maximum(extreme, h), np.minimum(extreme, lo)), line)
        rising = rising ^ turn
        extreme = np.where(turn | further, np.where(rising, h, lo), extreme)
        speed = np.where(turn, 0.02, np.where(further, np.minimum(0.2, speed + 0.02), speed))
        lines[:, i], ways[:, i] = line, np.where(rising, 1.0, -1.0)
    return lines, ways


def fisher(median, n: int = 10) -> np.ndarray:
    hi, lo = rolled(median, n, np.max), rolled(median, n, np.min)
    place = np.where(hi == lo, 0.0, np.divide(median - lo, hi - lo, out=np.zeros(median.shape), where=hi > lo) - 0.5)
    x, f, out = np.zeros(len(median)), np.zeros(len(median)), np.full(median.shape, np.nan)
    for i in range(n - 1, median.shape[1]):
        x = 0.66 * place[:, i] + 0.67 * x
        x = np.where(x > 0.99, 0.999, np.where(x < -0.99, -0.999, x))
        f = 0.5 * np.log((1 + x) / (1 - x)) + 0.5 * f
        out[:, i] = f
    return out


def kama(close, n: int = 10, fast: int = 2, slow: int = 30) -> np.ndarray:
    out = np.full(close.shape, np.nan)
    v = close[:, :n].mean(axis=1)
    out[:, n - 1] = v
    moves = np.abs(np.diff(close, axis=1))
    for i in range(n, close.shape[1]):
        path = moves[:, i - n : i].sum(axis=1)
        e = np.divide(np.abs(close[:, i] - close[:, i - n]), path, out=np.zeros(len(v)), where=path > 0)
        v = v + (e * (2 / (fast + 1) - 2 / (slow + 1)) + 2 / (slow + 1)) ** 2 * (close[:, i] - v)
        out[:, i] = v
    return out


def unit_range(x: np.ndarray, n: int) -> np.ndarray:
    """Place of x in its last n values, 0 to 100; null where they are all the same."""
    hi, lo = rolled(x, n, np.max), rolled(x, n, np.min)
    return np.where(hi > lo, 100 * np.divide(x - lo, hi - lo, out=np.zeros(x.shape), where=hi > lo), np.nan)


def series(o: np.ndarray, h: np.ndarray, lo: np.ndarray, c: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
    """All recursive series of the windows."""
    before = lag(c)
    first = np.where(np.isnan(before), o, before)
    tr = np.maximum(h - lo, np.maximum(np.abs(h - first), np.abs(lo - first)))
    change = c - before
    zero = np.where(np.isnan(change), 0.0, change)
    gain, loss = wilder(np.maximum(change, 0), 14), wilder(np.maximum(-change, 0), 14)
    out = {f"ema{n}": ema(c, n) for n in (9, 12, 13, 20, 21, 26, 50)}
    out["atr"], out["rsi"] = wilder(tr, 14), strength(gain, loss)
    out["macd"] = out["ema12"] - out["ema26"]
    out["macd_signal"] = ema(out["macd"], 9)
    out["supertrend"], out["supertrend_way"] = supertrend(h, lo, c, wilder(tr, 10))
    out["adx"], out["di_plus"], out["di_minus"] = directional(h, lo, tr)
    out["sar"], out["sar_way"] = parabolic(h, lo, c)
    mid = (h + lo) / 2
    out["fisher"] = fisher(mid)
    out["fisher_trigger"] = lag(out["fisher"])
    triple = ema(ema(ema(c, 15), 15), 15)
    out["trix"] = np.where(np.isnan(lag(triple)), 0.0, 100 * (triple / np.where(np.isnan(lag(triple)), triple, lag(triple)) - 1))
    out["trix_signal"] = ema(out["trix"], 9)
    out["tsi"] = ratio(100 * ema(ema(zero, 25), 13), ema(ema(np.abs(zero), 25), 13), 0.0)
    out["tsi_signal"] = ema(out["tsi"], 7)
    out["dema"] = 2 * out["ema21"] - ema(out["ema21"], 21)
    atr22 = wilder(tr, 22)
    out["chandelier_long"], out["chandelier_short"] = rolled(h, 22, np.max) - 3 * atr22, rolled(lo, 22, np.min) + 3 * atr22
    out["kama"] = kama(c)
    out["ppo"] = 100 * (out["ema12"] - out["ema26"]) / out["ema26"]
    out["ppo_signal"] = ema(out["ppo"], 9)
    hi5, lo5 = rolled(h, 5, np.max), rolled(lo, 5, np.min)
    out["smi"] = ratio(200 * ema(ema(c - (hi5 + lo5) / 2, 3), 3), ema(ema(hi5 - lo5, 3), 3), 0.0)
    out["smi_signal"] = ema(out["smi"], 3)
    raw = unit_range(out["rsi"], 14)
    raw = np.where(np.isnan(raw) & ~np.isnan(rolled(out["rsi"], 14, np.max)), 50.0, raw)
    out["stoch_rsi_k"] = rolled(raw, 3, np.mean)
    out["stoch_rsi_d"] = rolled(out["stoch_rsi_k"], 3, np.mean)
    out["bulls"], out["bears"] = h - out["ema13"], lo - out["ema13"]
    e1 = ema_full(c, 21)
    e2 = ema_full(e1, 21)
    out["tema"] = 3 * e1 - 3 * e2 + ema_full(e2, 21)
    out["zlema"] = ema_full(2 * c - lag(c, 10), 21)
    cycle = unit_range(ema_full(c, 23) - ema_full(c, 50), 10)
    out["stc"] = ema_full(unit_range(ema_full(cycle, 3), 10), 3)
    spread = ema_full(h - lo, 9)
    out["mass"] = rolled(spread / ema_full(spread, 9), 25, np.sum)
    out["mass_bulge"] = rolled(lag(out["mass"]), 10, np.max)
    have = np.logical_and.accumulate(v > 0, axis=1)  # up to each bar: later ones are not known there
    vol = np.where(have, v, np.nan)
    out["force"] = ema_full(change * vol, 13)
    growth = np.where(np.isnan(before), 0.0, zero / np.where(np.isnan(before), 1.0, before))
    fewer = vol < lag(vol)
    out["nvi"] = np.where(have, 1000 * np.cumprod(1 + np.where(fewer, growth, 0.0), axis=1), np.nan)
    out["nvi_signal"] = ema_full(out["nvi"], 21)
    out["vpt"] = np.cumsum(np.where(have, vol * growth, np.nan), axis=1)
    out["vpt_signal"] = ema_full(out["vpt"], 21)
    flow = np.where(h > lo, ((c - lo) - (h - c)) / np.where(h > lo, h - lo, 1.0), 0.0)
    out["adl"] = np.cumsum(np.where(have, flow * vol, np.nan), axis=1)
    for name, how in (("adl_high", np.max), ("adl_low", np.min)):
        out[name] = np.where(have, rolled(lag(out["adl"]), 20, how), np.nan)
    return out


with np.errstate(all="ignore"):
    NAMES = list(series(*(np.ones((1, 70)),) * 5))
OUT = [n for name in NAMES for n in (name, f"prev_{name}")]


def kernel(bars: pd.DataFrame, window: int = WINDOW) -> pd.DataFrame:
    """Values for the bars of one instrument, in order of time."""
    bars = bars.sort_values("bucket")
    cols = [bars[c].to_numpy(np.float64) for c in ("open", "high", "low", "close", "volume")]
    n = len(bars)
    out = {c: np.full(n, np.nan) for c in OUT}
    with np.errstate(all="ignore"):
        head = min(n, window - 1)
        if head > 1:  # windows that begin with history are one window, read at each place
            for name, s in series(*(c[None, :head] for c in cols)).items():
                out[name][:head] = s[0]
                out[f"prev_{name}"][1:head] = s[0, :-1]
        for at in range(window - 1, n, CHUNK):
            end = min(n, at + CHUNK)
            views = [np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(c[at - window + 1 : end], window)) for c in cols]
            for name, s in series(*views).items():
                out[name][at:end] = s[:, -1]
                out[f"prev_{name}"][at:end] = s[:, -2]
    early = np.arange(n) < MINIMUM - 1
    keys = bars[["instrument", "bucket"]].reset_index(drop=True)
    frame = pd.DataFrame({c: np.where(early | ~np.isfinite(x), np.nan, x) for c, x in out.items()})
    return pd.concat([keys, frame], axis=1)


def with_recursive(bars: DataFrame, names: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """``instrument, bucket`` and the recursive values (``names``, or all) of each bar with at
    least 60 bars of history. An instrument's bars are cut into blocks, each with the bars
    before it that its windows reach back to, so that a long history is many tasks."""
    names = names or OUT
    schema = "instrument string, bucket long, " + ", ".join(f"{c} double" for c in names)
    some = bars.select("instrument", "bucket", *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")])
    bar = F.row_number().over(Window.partitionBy("instrument").orderBy("bucket")) - 1
    own, reach = F.expr(f"__bar div {block}"), F.expr(f"(__bar + {WINDOW - 1}) div {block}")
    newest = F.floor(F.max("__bar").over(Window.partitionBy("instrument")) / block)
    dealt = some.withColumn("__bar", bar).withColumn("__last", newest)
    dealt = dealt.withColumn("__block", F.explode(F.sequence(own, F.least(reach, F.col("__last")))))

    def one(f: pd.DataFrame) -> pd.DataFrame:
        mine = f.loc[f["__bar"] // block == f["__block"], "bucket"]
        out = kernel(f)
        return out.loc[out["bucket"].isin(mine), ["instrument", "bucket", *names]]

    out = dealt.groupBy("instrument", "__block").applyInPandas(one, schema)
    return out.select("instrument", "bucket", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in names])


def ema_native(bars: DataFrame, n: int, window: int = WINDOW) -> DataFrame:
    """One exponential mean without Python: a fold over the window as an array."""
    over = f"PARTITION BY instrument ORDER BY bucket ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW"
    a = 2 / (n + 1)
    fold = F.aggregate(F.slice("w", 2, window), F.element_at("w", 1), lambda v, x: v + (x - v) * F.lit(a))
    return bars.withColumn("w", F.expr(f"collect_list(close) OVER ({over})")).withColumn(f"ema{n}", fold).drop("w")
