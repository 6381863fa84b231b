"""Indicators over plain rolling frames, as SQL window expressions in layers.

``{n}`` in an expression is the window of the ``n`` bars up to the current one, ``{n:k}``
the same ending ``k`` bars earlier, and ``{}`` the instrument's order alone (for ``lag``).
Each layer may use the columns of the layers before it. The texts run on Spark as they
stand; windows share one partitioning by instrument, so all layers need one shuffle.
A frame that is not full yet gives null (``full`` counts the bars so far).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FRAME = re.compile(r"\{(\d*)(?::(\d+))?\}")


def frames(sql: str) -> str:
    """Replace the frame marks by OVER clauses."""

    def over(m: re.Match) -> str:
        base = "PARTITION BY instrument ORDER BY bucket"
        if not m[1]:
            return f"OVER ({base})"
        n, k = int(m[1]), int(m[2] or 0)
        return f"OVER ({base} ROWS BETWEEN {n - 1 + k} PRECEDING AND {f'{k} PRECEDING' if k else 'CURRENT ROW'})"

    return _FRAME.sub(over, sql)


def _weighted(column: str, n: int, weights=None, frame: int = 0) -> str:
    """Weighted sum of the last ``n`` values (weights 1..n by default, divided by their sum)."""
    weights = list(weights or range(1, n + 1))
    total = sum(weights)
    lag = lambda k: f"lag({column}, {k + frame}) {{}}" if k + frame else column
    return "(" + " + ".join(f"{w!r}e0 * {lag(n - 1 - k)}" if isinstance(w, int) else f"{w!r} * {lag(n - 1 - k)}" for k, w in enumerate(weights)) + f") / {float(total)!r}"


def alma_weights(n: int = 21, offset: float = 0.85, sigma: float = 6.0) -> list[float]:
    import math

    m, s = offset * (n - 1), n / sigma
    return [math.exp(-((k - m) ** 2) / (2 * s * s)) for k in range(n)]


_FLAT = "CASE WHEN {hi} = {lo} THEN {other} ELSE {value} END"


def _mean_deviation(n: int) -> str:
    terms = " + ".join(f"abs({f'lag(typical, {k}) {{}}' if k else 'typical'} - typical_mean)" for k in range(n))
    return f"({terms}) / {float(n)}"


#: name -> expression; one dict a layer
LAYERS: list[dict[str, str]] = [
    {
        "full": "row_number() {}",
        "pc": "lag(close) {}", "po": "lag(open) {}", "ph": "lag(high) {}", "pl": "lag(low) {}",
        "typical": "(high + low + close) / 3", "median": "(high + low) / 2",
    },
    {
        "change": "close - pc", "tr0": "high - low",
        "tr": "greatest(high - low, abs(high - coalesce(pc, open)), abs(low - coalesce(pc, open)))",
        "up_move": "CASE WHEN pc IS NULL THEN 0.0 ELSE greatest(0.0, close - pc) END", "down_move": "CASE WHEN pc IS NULL THEN 0.0 ELSE greatest(0.0, pc - close) END",
        "de_max": "CASE WHEN ph IS NULL THEN 0.0 ELSE greatest(0.0, high - ph) END", "de_min": "CASE WHEN pl IS NULL THEN 0.0 ELSE greatest(0.0, pl - low) END",
        "pressure": "close - least(low, coalesce(pc, close))", "true_range": "greatest(high, coalesce(pc, close)) - least(low, coalesce(pc, close))",
        "vm_plus": "abs(high - pl)", "vm_minus": "abs(low - ph)",
        "bb_mean": "avg(close) {20}", "bb_sd": "stddev_pop(close) {20}",
        "vwap": "sum(typical * volume) {20} / nullif(sum(volume) {20}, 0)",
        "hi14": "max(high) {14}", "lo14": "min(low) {14}",
        "high20": "max(high) {20:1}", "low20": "min(low) {20:1}", "high55": "max(high) {55:1}", "low55": "min(low) {55:1}",
        "recent_high": "max(high) {3}", "recent_low": "min(low) {3}",
        "tenkan": "(max(high) {9} + min(low) {9}) / 2", "kijun": "(max(high) {26} + min(low) {26}) / 2", "span52": "(max(high) {52} + min(low) {52}) / 2",
        "typical_mean": "avg(typical) {20}",
        "high26": "max(high) {26}", "low26": "min(low) {26}",
        "roc": "100 * (close / lag(close, 12) {} - 1)",
        "volume_mean": "avg(volume) {20:1}", "volume_low": "min(volume) {21}", "volume60_low": "min(volume) {60}",
        "sma20": "avg(close) {20}", "wma10": _weighted("close", 10), "wma21": _weighted("close", 21),
        "alma": _weighted("close", 21, alma_weights()),
        "ols_slope": "regr_slope(close, CAST(bar AS DOUBLE)) {20}", "ols_intercept": "regr_intercept(close, CAST(bar AS DOUBLE)) {20}", "close_var": "var_pop(close) {20}",
        "roc11": "100 * (close / lag(close, 11) {} - 1)", "roc14": "100 * (close / lag(close, 14) {} - 1)",
        "roc10": "100 * (close / lag(close, 10) {} - 1)", "roc15": "100 * (close / lag(close, 15) {} - 1)", "roc20": "100 * (close / lag(close, 20) {} - 1)", "roc30": "100 * (close / lag(close, 30) {} - 1)",
        "inside": "ph < lag(high, 2) {} AND pl > lag(low, 2) {}",
        "mother_high": "lag(high, 2) {}", "mother_low": "lag(low, 2) {}",
        "range_prior_low": "min(high - low) {6:1}",
        "flow_volume": "CASE WHEN high = low THEN 0.0 ELSE ((close - low) - (high - close)) / (high - low) * volume END",
        "awesome": "avg(median) {5} - avg(median) {34}",
    },
    {
        "bb_upper": "bb_mean + 2 * bb_sd", "bb_lower": "bb_mean - 2 * bb_sd", "bb_width": "4 * bb_sd / bb_mean",
        "stoch_k": _FLAT.format(hi="hi14", lo="lo14", other="50.0", value="100 * (close - lo14) / nullif(hi14 - lo14, 0)"),
        "cci_deviation": _mean_deviation(20),
        "cloud_a": "(lag(tenkan, 26) {} + lag(kijun, 26) {}) / 2", "cloud_b": "lag(span52, 26) {}", "chikou": "lag(close, 26) {}",
        "vortex_plus": "coalesce(sum(vm_plus) {14} / nullif(sum(tr) {14}, 0), 0.0)", "vortex_minus": "coalesce(sum(vm_minus) {14} / nullif(sum(tr) {14}, 0), 0.0)",
        "ult7": "coalesce(sum(pressure) {7} / nullif(sum(true_range) {7}, 0), 0.5)", "ult14": "coalesce(sum(pressure) {14} / nullif(sum(true_range) {14}, 0), 0.5)", "ult28": "coalesce(sum(pressure) {28} / nullif(sum(true_range) {28}, 0), 0.5)",
        "demarker": "coalesce(sum(de_max) {14} / nullif(sum(de_max) {14} + sum(de_min) {14}, 0), 0.5)",
        "volume_ratio": "volume / nullif(volume_mean, 0)", "has_volume": "volume_low > 0",
        "ols_end": "ols_intercept + ols_slope * bar",
        "hull_raw": "2 * wma10 - wma21",
        "efficiency": "coalesce(abs(close - lag(close, 10) {}) / nullif(sum(abs(change)) {10}, 0), 0.0)",
        "chop": "100 * log10(nullif(sum(true_range) {14}, 0) / nullif(hi14 - lo14, 0)) / log10(14.0)",
        "coppock_raw": "roc11 + roc14",
        "kst": "1 * avg(roc10) {10} + 2 * avg(roc15) {10} + 3 * avg(roc20) {10} + 4 * avg(roc30) {15}",
        "cmo": "coalesce(100 * (sum(up_move) {14} - sum(down_move) {14}) / nullif(sum(up_move) {14} + sum(down_move) {14}, 0), 0.0)",
        "cmf": "CASE WHEN min(volume) {20} > 0 THEN sum(flow_volume) {20} / sum(volume) {20} END",
        "dpo": "lag(close, 11) {} - sma20",
        "vhf": "(max(close) {28} - min(close) {28}) / nullif(sum(abs(change)) {28}, 0)",
        "eom_raw": "CASE WHEN volume > 0 AND ph IS NOT NULL THEN (median - (ph + pl) / 2) * (high - low) / volume * 1e8 END",
        "money_up": "CASE WHEN typical > lag(typical) {} THEN typical * volume ELSE 0.0 END", "money_down": "CASE WHEN typical < lag(typical) {} THEN typical * volume ELSE 0.0 END",
        "fractal_high": "CASE WHEN min(CASE WHEN step_ok THEN 1 ELSE 0 END) {5} = 1 AND lag(high, 3) {} > greatest(lag(high, 1) {}, lag(high, 2) {}, lag(high, 4) {}, lag(high, 5) {}) THEN lag(high, 3) {} END",
        "fractal_low": "CASE WHEN min(CASE WHEN step_ok THEN 1 ELSE 0 END) {5} = 1 AND lag(low, 3) {} < least(lag(low, 1) {}, lag(low, 2) {}, lag(low, 4) {}, lag(low, 5) {}) THEN lag(low, 3) {} END",
        "failed_high": "CASE WHEN min(CASE WHEN step_ok THEN 1 ELSE 0 END) {21} = 1 THEN max(high) {20:2} END", "failed_low": "CASE WHEN min(CASE WHEN step_ok THEN 1 ELSE 0 END) {21} = 1 THEN min(low) {20:2} END",
        "retest_high": "CASE WHEN min(CASE WHEN step_ok THEN 1 ELSE 0 END) {22} = 1 THEN max(high) {20:3} END", "retest_low": "CASE WHEN min(CASE WHEN step_ok THEN 1 ELSE 0 END) {22} = 1 THEN min(low) {20:3} END",
        "nr7": "min(CASE WHEN step_ok THEN 1 ELSE 0 END) {6} = 1 AND high > low AND high - low < range_prior_low",
        "contiguous22": "min(CASE WHEN step_ok THEN 1 ELSE 0 END) {21} = 1", "contiguous3": "min(CASE WHEN step_ok THEN 1 ELSE 0 END) {2} = 1", "contiguous60": "min(CASE WHEN step_ok THEN 1 ELSE 0 END) {59} = 1",
    },
    {
        "stoch_d": "avg(stoch_k) {3}", "williams": "stoch_k - 100",
        "cci": "CASE WHEN cci_deviation > 0 THEN (typical - typical_mean) / (0.015 * cci_deviation) ELSE 0.0 END",
        "cloud_top": "greatest(cloud_a, cloud_b)", "cloud_bottom": "least(cloud_a, cloud_b)",
        "ultimate": "100 * (4 * ult7 + 2 * ult14 + ult28) / 7",
        "ols_residual": "close - ols_end",
        "ols_sse": "greatest(0.0, close_var - ols_slope * ols_slope * 33.25)",
        "hma": _weighted("hull_raw", 4), "coppock": _weighted("coppock_raw", 10), "kst_signal": "avg(kst) {9}",
        "eom": "avg(eom_raw) {14}",
        "mfi": "100 * sum(money_up) {14} / nullif(sum(money_up) {14} + sum(money_down) {14}, 0)",
        "squeeze": "bb_width",
    },
    {
        "ols_sd": "sqrt(ols_sse)", "ols_r2": "CASE WHEN close_var * 20 <= 1e-20 THEN 0.0 ELSE greatest(0.0, least(1.0, 1 - ols_sse / nullif(close_var, 0))) END",
    },
]


def with_bar_number(bars: DataFrame) -> DataFrame:
    return bars.withColumn("bar", F.expr(frames("row_number() {}")))


def rolling(bars: DataFrame) -> DataFrame:
    """``bars`` (with ``step_ok``) and all columns of ``LAYERS``. Columns that a query does
    not use are pruned with their windows."""
    out = with_bar_number(bars)
    for layer in LAYERS:
        out = out.select("*", *[F.expr(frames(e)).alias(c) for c, e in layer.items()])
    # the 20 % point of the 40 widths before this one, and how long ago the extremes were
    out = out.withColumn("__widths", F.expr(frames("collect_list(bb_width) {40:1}")))
    out = out.withColumn("squeeze_threshold", F.when(F.size("__widths") == 40, F.element_at(F.array_sort("__widths"), 8))).drop("__widths")
    last = lambda extreme, by: F.expr(frames(f"max_by(bar, struct({by}, bar)) {{26}}")).alias(extreme)
    out = out.select("*", last("__at_high", "high"), last("__at_low", "-low"))
    return out.withColumns({
        "aroon_up": 100 * (25 - (F.col("bar") - F.col("__at_high"))) / 25, "aroon_down": 100 * (25 - (F.col("bar") - F.col("__at_low"))) / 25,
    }).drop("__at_high", "__at_low")


def rolling_sql(bars: str, columns: list[str], minimum: int = 60, digits: int = 6) -> str:
    """SQL text of ``columns`` over the table expression ``bars``: the layers nested. Rows
    with fewer than ``minimum`` bars so far are left out."""
    inner = f"SELECT *, {frames('row_number() {}')} AS bar FROM {bars}"
    needed = set(columns)
    kept: list[dict[str, str]] = []
    for layer in reversed(LAYERS):
        mine = {c: e for c, e in layer.items() if c in needed or c == "full"}
        needed |= {w for e in mine.values() for w in re.findall(r"[a-z_][a-z_0-9]*", e)}
        kept.append(mine)
    for layer in reversed(kept):
        if layer:
            inner = f"SELECT *, {', '.join(f'{frames(e)} AS {c}' for c, e in layer.items())} FROM ({inner})"
    return f"SELECT instrument, bucket, {', '.join(f'round({c}, {digits}) + 0.0 AS {c}' for c in columns)} FROM ({inner}) WHERE bar >= {minimum}"
