"""Setup triggers: the level put in as the next close is where the rule's crossing happens."""

import random

import numpy as np
from pyspark.sql import functions as F

from quaymark.operators import bars as B
from quaymark.operators import triggers as R

STEP = 60 * B.MINUTE


def series(n=260, seed=4):
    rng, price, out = random.Random(seed), 100.0, []
    for k in range(n):
        close = price + rng.uniform(-1, 1)
        out.append(("x", k * STEP, price, max(price, close) + rng.uniform(0, 0.4), min(price, close) - rng.uniform(0, 0.4), close, 5.0))
        price = close
    return out


def ema(x, n):
    v = x[0]
    for c in x[1:]:
        v += (c - v) * 2 / (n + 1)
    return v


def strength(x):
    d = np.diff(x)
    gain, loss = np.maximum(d, 0)[:14].mean(), np.maximum(-d, 0)[:14].mean()
    for c in d[14:]:
        gain, loss = (gain * 13 + max(c, 0)) / 14, (loss * 13 + max(-c, 0)) / 14
    return 100 - 100 / (1 + gain / loss)


def macd_gap(x):
    m = [ema(x[: k + 1], 12) - ema(x[: k + 1], 26) for k in range(len(x))]
    return m[-1] - ema(m, 9)


def test_levels_are_where_the_crossings_happen(spark):
    rows = series()
    t = R.setup_triggers(spark.createDataFrame(rows, "instrument string, bucket long, open double, high double, low double, close double, volume double"), 60)
    got = {(r["rule"], r["side"]): r for r in t.filter(F.col("bucket") == 239 * STEP).collect()}
    assert len(got) == 2 * 66
    known = [r[5] for r in rows[:240]][-159:]
    after = lambda level, e: [*known, level + e]
    tiny = 1e-6
    for rule, gap in (("ema-cross", lambda x: ema(x, 9) - ema(x, 21)), ("macd", macd_gap)):
        level = got[rule, "BUY"]["price"]
        assert level == got[rule, "SELL"]["price"] and gap(after(level, tiny)) > 0 > gap(after(level, -tiny)) and abs(gap(after(level, 0))) < 1e-9
    low = got["reversion", "BUY"]["price"]
    band = lambda x: np.mean(x[-20:]) - 2 * np.std(x[-20:])
    assert after(low, tiny)[-1] > band(after(low, tiny)) and after(low, -tiny)[-1] < band(after(low, -tiny))
    roc = got["roc-momentum", "BUY"]["price"]
    e50 = ema(known, 50)
    assert roc == max(known[-12] * 1.005, e50) or abs(roc - max(known[-12] * 1.005, e50)) < 1e-9
    last = rows[239]
    assert got["breakout", "BUY"]["price"] == max(r[3] for r in rows[220:240]) and got["donchian55", "SELL"]["price"] == min(r[4] for r in rows[185:240])
    assert got["pullback", "BUY"]["price"] == last[3] and got["two-bar-pullback", "SELL"]["price"] == min(last[4], rows[238][4])
    assert got["stochastic", "BUY"]["price"] is None and got["stochastic", "BUY"]["reference"] == last[5] and got["tema-reclaim", "SELL"]["mode"] == "indicator"


def test_strength_reaches_its_threshold_at_the_level(spark):
    seen = 0
    for seed in range(6):
        rows = series(200, seed)
        for k in range(160, 200):  # a fall, after which the ratio is low
            rows[k] = ("x", k * STEP, 100.0 - k * 0.1, 100.3 - k * 0.1, 99.0 - k * 0.1 - seed * 0.01, 99.4 - k * 0.1, 5.0)
        t = R.setup_triggers(spark.createDataFrame(rows, "instrument string, bucket long, open double, high double, low double, close double, volume double"), 60)
        r = t.filter((F.col("bucket") == 199 * STEP) & (F.col("rule") == "rsi-recovery") & (F.col("side") == "BUY")).first()
        known = [v[5] for v in rows][-159:]
        if strength(known) < 30 and r["price"] > rows[-1][3]:  # the level is the ratio's, not the bar's high
            seen += 1
            assert abs(strength([*known, r["price"]]) - 30) < 1e-6
    assert seen or strength(known) >= 30


def test_short_histories_have_no_triggers(spark):
    t = spark.createDataFrame(series(59), "instrument string, bucket long, open double, high double, low double, close double, volume double")
    assert R.setup_triggers(t, 60).count() == 0
