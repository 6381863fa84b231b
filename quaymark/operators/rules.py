"""The rule catalogue: each rule is a list of checks for buying and one for selling.

Checks are SQL conditions over the columns of ``context``: the bar and its predecessor
(``p*``), the bar before that (``b*``), rolling columns (``p_x``: the bar before), and recursive columns (``prev_x``: the
place before in the same window). A side fires when all its checks hold; buying is asked
first. All rules are evaluated in one projection.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from .bars import daily_levels, with_steps
from .recursive import with_recursive
from .rolling import frames, rolling


@dataclass(frozen=True)
class Rule:
    id: str
    buy: tuple[str, ...]
    sell: tuple[str, ...]
    family: str = "trend"
    volume: bool = False
    warmup: int = 60


BULL, BEAR = "close > open", "close < open"
UP, DOWN = "close > ema50", "close < ema50"
ABOVE, BELOW = "close > ph", "close < pl"
CALM = "trend < 1.2"
RISE, FALL = "close > pc", "close < pc"


def body(k: float) -> str:
    return f"abs(close - open) >= {k} * atr"


def crosses(now: str, before: str, level: str, before_level: str | None = None) -> tuple[str, str]:
    old = before_level or level
    return f"{before} <= {old} AND {now} > {level}", f"{before} >= {old} AND {now} < {level}"


ADVANCED = ("contiguous60", body(0.2))
PATTERN = ("step_ok", body(0.25))
TREND_UP = "ema21 > ema50 AND ema21 > prev_ema21 AND close > ema21"
TREND_DOWN = "ema21 < ema50 AND ema21 < prev_ema21 AND close < ema21"
VOLUME = "coalesce(volume_ratio >= 1.2 OR NOT has_volume, true)"


def _advanced(id: str, buy: list[str], sell: list[str], family: str = "trend", volume: bool = False, warmup: int = 78) -> Rule:
    more = ("volume60_low > 0",) if volume else ()
    return Rule(id, (*ADVANCED, BULL, *more, *buy), (*ADVANCED, BEAR, *more, *sell), family, volume, warmup)


def _reclaim(now: str, before: str) -> tuple[list[str], list[str]]:
    return [f"pc <= {before}", f"close > {now}", f"{now} > {before}", UP], [f"pc >= {before}", f"close < {now}", f"{now} < {before}", DOWN]


def _recover(now: str, before: str, low: float, high: float, buy: list[str], sell: list[str]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    inside = f"{now} > {low} AND {now} < {high}"
    return (f"{before} <= {low}", inside, *buy), (f"{before} >= {high}", inside, *sell)


def _both(pair: tuple[str, str], buy: list[str], sell: list[str]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    return (pair[0], *buy), (pair[1], *sell)


#: In catalogue order.
RULES: list[Rule] = [
    _advanced("alma-reclaim", *_reclaim("alma", "p_alma")),
    _advanced("hma-reclaim", *_reclaim("hma", "p_hma")),
    _advanced("regression-trend", ["ols_r2 >= 0.6", "ols_slope > 0.05 * atr", ABOVE, UP], ["ols_r2 >= 0.6", "ols_slope < -0.05 * atr", BELOW, DOWN]),
    _advanced("regression-reentry", ["p_ols_sd > 0 AND p_ols_residual < -2 * p_ols_sd", "ols_residual > -1.5 * ols_sd", RISE, CALM], ["p_ols_sd > 0 AND p_ols_residual > 2 * p_ols_sd", "ols_residual < 1.5 * ols_sd", FALL, CALM], "reversion"),
    _advanced("efficiency-trend", ["efficiency >= 0.6", "ema21 > ema50", ABOVE], ["efficiency >= 0.6", "ema21 < ema50", BELOW]),
    _advanced("chop-breakout", ["chop < 38.2", "close > high20", UP], ["chop < 38.2", "close < low20", DOWN], "breakout"),
    _advanced("cmo-recovery", ["p_cmo <= -50", "cmo > -50 AND cmo < 50", ABOVE, CALM], ["p_cmo >= 50", "cmo > -50 AND cmo < 50", BELOW, CALM], "reversion"),
    _advanced("coppock-cross", *map(list, _both(crosses("coppock", "p_coppock", "0"), [UP], [DOWN])), family="momentum"),
    _advanced("kst-cross", *map(list, _both(crosses("kst", "p_kst", "kst_signal", "p_kst_signal"), ["kst > 0", UP], ["kst < 0", DOWN])), family="momentum"),
    _advanced("cmf-breakout", ["p_cmf <= 0.1 AND cmf > 0.1", ABOVE, UP], ["p_cmf >= -0.1 AND cmf < -0.1", BELOW, DOWN], "volume", True),
    _advanced("utc-opening-range", ["pc <= opening_high AND close > opening_high", UP], ["pc >= opening_low AND close < opening_low", DOWN], "session"),
    _advanced("previous-day-breakout", ["pc <= previous_day_high AND close > previous_day_high", UP], ["pc >= previous_day_low AND close < previous_day_low", DOWN], "session"),
    _advanced("tema-reclaim", *_reclaim("tema", "prev_tema"), warmup=160),
    _advanced("zlema-reclaim", *_reclaim("zlema", "prev_zlema"), warmup=160),
    _advanced("vhf-breakout", ["vhf >= 0.4", "close > high20", UP], ["vhf >= 0.4", "close < low20", DOWN], "breakout"),
    _advanced("stc-recovery", ["prev_stc <= 25 AND stc > 25 AND stc < 75", ABOVE, UP], ["prev_stc >= 75 AND stc < 75 AND stc > 25", BELOW, DOWN], "momentum", warmup=160),
    _advanced("dpo-recovery", *map(list, _both(crosses("dpo", "p_dpo", "0"), [ABOVE, CALM], [BELOW, CALM])), family="reversion"),
    _advanced("mass-reversal", ["mass_bulge > 27 AND prev_mass >= 26.5 AND mass < 26.5", ABOVE, CALM], ["mass_bulge > 27 AND prev_mass >= 26.5 AND mass < 26.5", BELOW, CALM], "reversion", warmup=160),
    _advanced("force-cross", *map(list, _both(crosses("force", "prev_force", "0"), [ABOVE, UP], [BELOW, DOWN])), family="volume", volume=True, warmup=160),
    _advanced("eom-cross", *map(list, _both(crosses("eom", "p_eom", "0"), [ABOVE, UP], [BELOW, DOWN])), family="volume", volume=True),
    _advanced("nvi-reclaim", *map(list, _both(crosses("nvi", "prev_nvi", "nvi_signal", "prev_nvi_signal"), [ABOVE, UP], [BELOW, DOWN])), family="volume", volume=True, warmup=160),
    _advanced("vpt-cross", *map(list, _both(crosses("vpt", "prev_vpt", "vpt_signal", "prev_vpt_signal"), [ABOVE, UP], [BELOW, DOWN])), family="volume", volume=True, warmup=160),
    _advanced("adl-breakout", ["adl > adl_high", ABOVE, UP], ["adl < adl_low", BELOW, DOWN], "volume", True, 160),
    _advanced("mfi-recovery", ["p_mfi <= 20 AND mfi > 20 AND mfi < 65", ABOVE, CALM], ["p_mfi >= 80 AND mfi < 80 AND mfi > 35", BELOW, CALM], "reversion", True),
    Rule("breakout-retest", (*PATTERN, "bc > retest_high", "pl <= retest_high AND pc > retest_high AND pc < bc", "close > open AND close > ph", "ema21 > ema50 AND close > ema21"), (*PATTERN, "bc < retest_low", "ph >= retest_low AND pc < retest_low AND pc > bc", "close < open AND close < pl", "ema21 < ema50 AND close < ema21"), "pattern"),
    Rule("two-bar-pullback", (*PATTERN, "contiguous3", "bc < bo AND pc < po", "least(bl, pl) <= prev_ema21", "close > open AND close > greatest(bh, ph)", TREND_UP), (*PATTERN, "contiguous3", "bc > bo AND pc > po", "greatest(bh, ph) >= prev_ema21", "close < open AND close < least(bl, pl)", TREND_DOWN), "pattern"),
    Rule("fractal-breakout", (*PATTERN, "pc <= fractal_high AND close > fractal_high", BULL, TREND_UP), (*PATTERN, "pc >= fractal_low AND close < fractal_low", BEAR, TREND_DOWN), "pattern"),
    Rule("failed-breakout", (*PATTERN, "contiguous22", "pc < failed_low", "close > open AND close > failed_low AND close < failed_high", CALM), (*PATTERN, "contiguous22", "pc > failed_high", "close < open AND close < failed_high AND close > failed_low", CALM), "pattern"),
    Rule("nr7-breakout", (*PATTERN, "p_nr7", ABOVE, BULL, TREND_UP), (*PATTERN, "p_nr7", BELOW, BEAR, TREND_DOWN), "pattern"),
    Rule("engulfing-reclaim", (*PATTERN, "pc < po AND close > open AND open <= pc AND close > po", "pl <= prev_ema21", TREND_UP), (*PATTERN, "pc > po AND close < open AND open >= pc AND close < po", "ph >= prev_ema21", TREND_DOWN), "pattern"),
    Rule("pullback", ("ema9 > ema21 AND ema21 > ema50", "pl <= prev_ema9", ABOVE, "rsi > 45 AND rsi < 72"), ("ema9 < ema21 AND ema21 < ema50", "ph >= prev_ema9", BELOW, "rsi > 28 AND rsi < 55")),
    Rule("breakout", ("close > high20", "close > ema21", "high - low > 0.8 * atr", VOLUME), ("close < low20", "close < ema21", "high - low > 0.8 * atr", VOLUME), "breakout"),
    Rule("reversion", ("trend < 0.65", "pc < p_bb_lower", "close >= bb_lower", RISE, "rsi < 45"), ("trend < 0.65", "pc > p_bb_upper", "close <= bb_upper", FALL, "rsi > 55"), "reversion"),
    Rule("ema-cross", *_both(crosses("ema9", "prev_ema9", "ema21", "prev_ema21"), [UP, BULL], [DOWN, BEAR])),
    Rule("macd", *_both(crosses("macd", "prev_macd", "macd_signal", "prev_macd_signal"), [UP, RISE], [DOWN, FALL]), "momentum"),
    Rule("rsi-recovery", ("prev_rsi <= 30", "rsi > 30 AND rsi < 55", ABOVE), ("prev_rsi >= 70", "rsi > 45 AND rsi < 70", BELOW), "reversion"),
    Rule("squeeze", ("p_bb_width > 0 AND p_bb_width <= squeeze_threshold", "close > p_bb_upper", "high - low > 0.8 * atr", VOLUME), ("p_bb_width > 0 AND p_bb_width <= squeeze_threshold", "close < p_bb_lower", "high - low > 0.8 * atr", VOLUME), "breakout"),
    Rule("vwap", ("has_volume", "pl <= p_vwap", "close > vwap", "ema21 > prev_ema21", ABOVE), ("has_volume", "ph >= p_vwap", "close < vwap", "ema21 < prev_ema21", BELOW), "volume", True),
    Rule("supertrend", ("supertrend_way = 1", ABOVE, "close - open >= 0.25 * atr"), ("supertrend_way = -1", BELOW, "open - close >= 0.25 * atr")),
    Rule("stochastic", ("p_stoch_k <= 20", "stoch_k > 20 AND stoch_k < 65", "stoch_k > stoch_d", RISE, CALM), ("p_stoch_k >= 80", "stoch_k > 35 AND stoch_k < 80", "stoch_k < stoch_d", FALL, CALM), "reversion"),
    Rule("inside-bar", ("inside", "contiguous3", "close > mother_high", "high - low >= 0.5 * atr"), ("inside", "contiguous3", "close < mother_low", "high - low >= 0.5 * atr"), "breakout"),
    Rule("liquidity-sweep", ("low < low20 AND close > low20", BULL, "least(open, close) - low >= abs(close - open)", CALM), ("high > high20 AND close < high20", BEAR, "high - greatest(open, close) >= abs(close - open)", CALM), "reversion"),
    Rule("continuation", ("ema9 > ema21 AND ema21 > ema50", "ema21 > prev_ema21", "close > ema9 AND close - ema9 <= 1.5 * atr", "close - open >= 0.2 * atr", "close - low >= 0.65 * (high - low)", "rsi > 50 AND rsi < 78"), ("ema9 < ema21 AND ema21 < ema50", "ema21 < prev_ema21", "close < ema9 AND ema9 - close <= 1.5 * atr", "open - close >= 0.2 * atr", "high - close >= 0.65 * (high - low)", "rsi > 22 AND rsi < 50")),
    Rule("keltner-reentry", ("pc < prev_ema20 - 2 * prev_atr", "close >= ema20 - 2 * atr", BULL, "rsi < 50", CALM), ("pc > prev_ema20 + 2 * prev_atr", "close <= ema20 + 2 * atr", BEAR, "rsi > 50", CALM), "reversion"),
    Rule("adx-continuation", ("adx >= 25 AND adx >= prev_adx", "di_plus > di_minus", UP, ABOVE), ("adx >= 25 AND adx >= prev_adx", "di_minus > di_plus", DOWN, BELOW)),
    Rule("ichimoku", ("cloud_top IS NOT NULL", "tenkan > kijun", "close > cloud_top", "close > chikou", ABOVE), ("cloud_top IS NOT NULL", "tenkan < kijun", "close < cloud_bottom", "close < chikou", BELOW), warmup=78),
    Rule("cci-recovery", *_recover("cci", "p_cci", -100, 100, [BULL, RISE, CALM], [BEAR, FALL, CALM]), "reversion"),
    Rule("aroon", ("p_aroon_up <= p_aroon_down AND aroon_up > aroon_down", "aroon_up >= 70", "aroon_down <= 30", UP, BULL), ("p_aroon_down <= p_aroon_up AND aroon_down > aroon_up", "aroon_down >= 70", "aroon_up <= 30", DOWN, BEAR)),
    Rule("donchian55", ("close > high55", UP, BULL), ("close < low55", DOWN, BEAR), "breakout"),
    Rule("roc-momentum", ("p_roc <= 0.5 AND roc > 0.5", UP, BULL), ("p_roc >= -0.5 AND roc < -0.5", DOWN, BEAR), "momentum"),
    Rule("parabolic-sar", ("prev_sar_way = -1 AND sar_way = 1", "close > sar", "close > ema21", BULL), ("prev_sar_way = 1 AND sar_way = -1", "close < sar", "close < ema21", BEAR)),
    Rule("williams-recovery", *_recover("williams", "p_williams", -80, -20, [ABOVE, CALM], [BELOW, CALM]), "reversion"),
    Rule("fisher-recovery", ("prev_fisher <= -1", "prev_fisher <= prev_fisher_trigger AND fisher > fisher_trigger", BULL, RISE, CALM), ("prev_fisher >= 1", "prev_fisher >= prev_fisher_trigger AND fisher < fisher_trigger", BEAR, FALL, CALM), "reversion"),
    Rule("trix", *_both(crosses("trix", "prev_trix", "trix_signal", "prev_trix_signal"), ["trix > 0", UP, BULL], ["trix < 0", DOWN, BEAR]), "momentum"),
    Rule("tsi", *_both(crosses("tsi", "prev_tsi", "tsi_signal", "prev_tsi_signal"), ["tsi > 0", UP, BULL], ["tsi < 0", DOWN, BEAR]), "momentum"),
    Rule("dema-reclaim", (*_reclaim("dema", "prev_dema")[0], BULL), (*_reclaim("dema", "prev_dema")[1], BEAR)),
    Rule("chandelier", ("pc <= prev_chandelier_short AND close > prev_chandelier_short", "close > chandelier_long", UP, BULL), ("pc >= prev_chandelier_long AND close < prev_chandelier_long", "close < chandelier_short", DOWN, BEAR)),
    Rule("vortex", ("p_vortex_plus <= p_vortex_minus AND vortex_plus > vortex_minus", UP, BULL), ("p_vortex_minus <= p_vortex_plus AND vortex_minus > vortex_plus", DOWN, BEAR)),
    Rule("kama-reclaim", (*_reclaim("kama", "prev_kama")[0], BULL), (*_reclaim("kama", "prev_kama")[1], BEAR)),
    Rule("ppo", *_both(crosses("ppo", "prev_ppo", "ppo_signal", "prev_ppo_signal"), ["ppo > 0", UP, BULL], ["ppo < 0", DOWN, BEAR]), "momentum"),
    Rule("ultimate-recovery", *_recover("ultimate", "p_ultimate", 30, 70, [BULL, RISE, CALM], [BEAR, FALL, CALM]), "reversion"),
    Rule("smi", ("prev_smi <= -40", "prev_smi <= prev_smi_signal AND smi > smi_signal", "smi < 40", BULL, RISE, CALM), ("prev_smi >= 40", "prev_smi >= prev_smi_signal AND smi < smi_signal", "smi > -40", BEAR, FALL, CALM), "reversion"),
    Rule("stoch-rsi", ("prev_stoch_rsi_k <= 20", "stoch_rsi_k > 20 AND stoch_rsi_k < 80", "stoch_rsi_k > stoch_rsi_d", BULL, RISE, CALM), ("prev_stoch_rsi_k >= 80", "stoch_rsi_k > 20 AND stoch_rsi_k < 80", "stoch_rsi_k < stoch_rsi_d", BEAR, FALL, CALM), "reversion"),
    Rule("elder-ray", ("ema13 > prev_ema13", "bears < 0 AND bears > prev_bears", "close > ema13", BULL), ("ema13 < prev_ema13", "bulls > 0 AND bulls < prev_bulls", "close < ema13", BEAR)),
    Rule("demarker", *_recover("demarker", "p_demarker", 0.3, 0.7, [BULL, RISE, CALM], [BEAR, FALL, CALM]), "reversion"),
    Rule("awesome", *_both(crosses("awesome", "p_awesome", "0"), [UP, BULL], [DOWN, BEAR]), "momentum"),
]

# The families, the rules of each (all others are of the first), the rules that ask
# for real volume, and the bars of history a rule asks for (all others: 60).
FAMILIES = "trend breakout reversion price-structure volatility session multi-timeframe economic-event microstructure cross-market".split()
MEMBERS = {
    "session": "utc-opening-range previous-day-breakout".split(),
    "volatility": "squeeze nr7-breakout".split(),
    "multi-timeframe": ["ichimoku"],
    "price-structure": "breakout-retest two-bar-pullback fractal-breakout failed-breakout engulfing-reclaim inside-bar liquidity-sweep".split(),
    "reversion": (
        "regression-reentry cmo-recovery stc-recovery dpo-recovery mass-reversal mfi-recovery reversion rsi-recovery stochastic keltner-reentry cci-recovery williams-recovery fisher-recovery "
        "ultimate-recovery smi stoch-rsi demarker"
    ).split(),
    "breakout": "breakout donchian55 chop-breakout vhf-breakout cmf-breakout adl-breakout".split(),
}
VOLUME_RULES = "vwap cmf-breakout force-cross eom-cross nvi-reclaim vpt-cross adl-breakout mfi-recovery".split()
WARMUP = {"ichimoku": 78, "previous-day-breakout": 160}

_family = {id: family for family, ids in MEMBERS.items() for id in ids}
RULES = [replace(r, family=_family.get(r.id, FAMILIES[0]), volume=r.id in VOLUME_RULES, warmup=WARMUP.get(r.id, 60)) for r in RULES]

#: Candidates for research: stop 1.4 ATR; both sides true means hold.
RESEARCH: list[tuple[Rule, float]] = [
    (Rule("rsi2-trend-recovery", ("p_rsi2 <= 10 AND rsi2 > 10 AND rsi2 < 70", "close > ema200", BULL), ("p_rsi2 >= 90 AND rsi2 < 90 AND rsi2 > 30", "close < ema200", BEAR), "reversion", warmup=220), 1.0),
    (Rule("ema200-engulfing", ("pc < po AND open < pc AND close > po", "close > ema200 AND ema200 > p_ema200"), ("pc > po AND open > pc AND close < po", "close < ema200 AND ema200 < p_ema200"), "pattern", warmup=220), 1.5),
    (Rule("atr-expansion-channel", ("close - open > 1.5 * atr", "close > high20 AND pc <= high20", UP), ("open - close > 1.5 * atr", "close < low20 AND pc >= low20", DOWN), "breakout", warmup=220), 1.5),
    (Rule("utc-asian-range", ("session_ready AND session_hour >= 7 AND session_hour < 10", "pc <= night_high AND close > night_high", BULL), ("session_ready AND session_hour >= 7 AND session_hour < 10", "pc >= night_low AND close < night_low", BEAR), "session", warmup=220), 1.5),
    (Rule("daily-vwap-reentry", ("pc < p_day_vwap - 2 * prev_atr", "close >= day_vwap - 1.5 * atr AND close < day_vwap", BULL), ("pc > p_day_vwap + 2 * prev_atr", "close <= day_vwap + 1.5 * atr AND close > day_vwap", BEAR), "reversion", True, 220), 1.0),
    (Rule("regression40-reentry", ("abs(slope40) < 0.1 * atr", "p_z40 <= -2 AND z40 > -1.5 AND z40 < 0", BULL), ("abs(slope40) < 0.1 * atr", "p_z40 >= 2 AND z40 < 1.5 AND z40 > 0", BEAR), "reversion", warmup=220), 1.0),
]

#: Rolling columns whose value one bar ago a rule reads.
LAGGED = (
    "alma hma ols_sd ols_residual cmo coppock kst kst_signal cmf dpo eom mfi nr7 bb_lower bb_upper bb_width vwap stoch_k cci aroon_up aroon_down roc williams "
    "vortex_plus vortex_minus ultimate demarker awesome"
).split()

#: Rules whose target is closer than 1.8 times the risk.
NEAR_TARGET = (
    "dpo-recovery mass-reversal mfi-recovery reversion rsi-recovery stochastic keltner-reentry cci-recovery williams-recovery fisher-recovery ultimate-recovery smi stoch-rsi demarker"
).split()
RECENT_STOP = "two-bar-pullback breakout-retest stochastic keltner-reentry cci-recovery williams-recovery fisher-recovery dema-reclaim kama-reclaim ultimate-recovery smi stoch-rsi elder-ray demarker".split()
TWO_BAR_STOP = "nr7-breakout engulfing-reclaim fractal-breakout failed-breakout".split()


def context(bars: DataFrame, minutes: int) -> DataFrame:
    """Every column the rules read, one row per bar with at least 60 bars of history."""
    base = rolling(with_steps(bars, minutes))
    keep = [c for c in base.columns if not c.startswith("__")]
    base = written(base.select(*keep), "rolling")
    more = {f"p_{c}": F.expr(frames(f"lag({c}) {{}}")) for c in LAGGED}
    more |= {f"b{c[0]}": F.expr(frames(f"lag({c}, 2) {{}}")) for c in ("open", "high", "low", "close")}
    base = base.withColumns(more)
    levels = daily_levels(bars, minutes).select("instrument", "bucket", "previous_day_high", "previous_day_low", "opening_high", "opening_low")
    rec = with_recursive(bars)
    out = base.join(levels, ["instrument", "bucket"]).join(rec, ["instrument", "bucket"])
    # written: dozens of rules read these columns, and planning them anew for each is slow
    return written(out.filter("full >= 60").withColumn("trend", F.expr("abs(ema21 - ema50) / greatest(atr, 1e-9)")), "context")


def _all(checks: tuple[str, ...]) -> Column:
    return F.coalesce(F.expr(" AND ".join(f"({c})" for c in checks)), F.lit(False))


def _passed(checks: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for c in checks:
        out = out + F.coalesce(F.expr(f"({c})"), F.lit(False)).cast("int")
    return out


def side(rule: Rule) -> Column:
    """1 buys, -1 sells, 0 holds."""
    return F.when((F.col("atr") > 0) & _all(rule.buy), 1).when((F.col("atr") > 0) & _all(rule.sell), -1).otherwise(0)


def score(rule: Rule) -> Column:
    """Percent of the checks that hold on the nearer side, rounded half up."""
    buy, sell = _passed(rule.buy) / len(rule.buy), _passed(rule.sell) / len(rule.sell)
    return F.floor(F.greatest(buy, sell) * 100 + 0.5).cast("int")


def stop(rule: Rule, way: Column) -> Column:
    """The stop of a signal in direction ``way``; on the wrong side it falls back to 1.4 ATR."""
    atr, close = F.col("atr"), F.col("close")
    level = lambda low, high, k: F.when(way == 1, F.expr(low)).otherwise(F.expr(high)) - way * atr * k
    out = close - way * atr * (2.0 if rule.id == "donchian55" else 1.4)
    if rule.id in RECENT_STOP:
        out = level("recent_low", "recent_high", 0.1)
    elif rule.id in TWO_BAR_STOP:
        out = level("least(low, pl)", "greatest(high, ph)", 0.1)
    elif rule.id == "supertrend":
        out = F.when(F.col("supertrend_way") == way, F.col("supertrend") - way * atr * 0.05).otherwise(out)
    elif rule.id == "inside-bar":
        out = level("mother_low", "mother_high", 0.1)
    elif rule.id == "liquidity-sweep":
        out = level("low", "high", 0.1)
    elif rule.id == "continuation":
        out = level("least(ema21, recent_low)", "greatest(ema21, recent_high)", 0.1)
    elif rule.id == "ichimoku":
        out = F.coalesce(level("least(kijun, cloud_bottom)", "greatest(kijun, cloud_top)", 0.1), out)
    elif rule.id == "parabolic-sar":
        out = F.when(F.col("sar_way") == way, F.col("sar") - way * atr * 0.05).otherwise(out)
    elif rule.id == "chandelier":
        out = level("chandelier_long", "chandelier_short", 0.05)
    return F.when((out <= 0) | (way * (close - out) <= 0) | out.isNull(), close - way * atr * 1.4).otherwise(out)


def reward(rule: Rule) -> float:
    return 2.0 if rule.id == "donchian55" else 1.3 if rule.id in NEAR_TARGET else 1.8


def signals(ctx: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """One row per bar and rule that fires: side, entry, stop, target, score. All rules
    are columns of one projection, unpivoted by a generator: no join with the catalogue."""
    chosen = rules or RULES
    ctx = ctx.withColumns({f"__side{k}": side(rule) for k, rule in enumerate(chosen)})
    entries = []
    for k, rule in enumerate(chosen):
        way = F.col(f"__side{k}")
        entries.append(F.when(way != 0, F.struct(
            F.lit(rule.id).alias("rule"), F.lit(k).alias("rank"), F.lit(rule.family).alias("family"), way.alias("way"), stop(rule, way).alias("stop"), F.lit(reward(rule)).alias("rr"), F.lit(100).alias("score"))))  # all checks hold
    fired = ctx.withColumn("s", F.explode(F.array_compact(F.array(*entries))))
    target = F.col("close") + F.col("s.way") * F.abs(F.col("close") - F.col("s.stop")) * F.col("s.rr")
    return fired.select("instrument", "bucket", "close", "atr", "s.*", target.alias("target")).withColumnRenamed("close", "entry")


#: Precedence of the router: what fires first is chosen; then the catalogue in order.
ROUTE = (
    "breakout-retest nr7-breakout engulfing-reclaim fractal-breakout failed-breakout two-bar-pullback inside-bar liquidity-sweep squeeze cci-recovery aroon donchian55 breakout roc-momentum ppo "
    "williams-recovery ultimate-recovery smi stoch-rsi demarker awesome kama-reclaim fisher-recovery parabolic-sar chandelier vortex trix tsi dema-reclaim adx-continuation ichimoku "
    "keltner-reentry stochastic rsi-recovery ema-cross macd"
).split()


def route(ctx: DataFrame) -> DataFrame:
    """The one rule of each bar (see ``score`` for how near the others are): the first of ``ROUTE`` that fires (a 55-bar channel needs
    ADX 25, a squeeze 0.9 of the threshold), then the established trend rules, then any
    catalogue rule that fires, else a context rule that holds."""
    by_id = {r.id: r for r in RULES}
    extra = {"donchian55": F.col("adx") >= 25, "squeeze": F.expr("p_bb_width <= 0.9 * squeeze_threshold")}
    steps: list[tuple[str, Column]] = []
    for id in ROUTE:
        on = side(by_id[id]) != 0
        steps.append((id, on & F.coalesce(extra[id], F.lit(False)) if id in extra else on))
    on = {id: side(by_id[id]) != 0 for id in ("supertrend", "elder-ray", "pullback", "vwap", "continuation", "reversion")}
    aligned = F.expr("(ema9 > ema21 AND ema21 > ema50 OR ema9 < ema21 AND ema21 < ema50) AND trend > 0.8")
    steps += [("supertrend", on["supertrend"] & (F.col("supertrend_way") != F.col("prev_supertrend_way"))), ("elder-ray", on["elder-ray"])]
    steps += [(id, aligned & on[id]) for id in ("pullback", "vwap", "continuation")]
    steps += [(r.id, aligned & (side(r) != 0)) for r in RULES if r.id not in ROUTE and r.id not in on]
    apart = ~F.coalesce(aligned, F.lit(False))  # in a trend an established supertrend is no choice of its own
    steps += [("reversion", on["reversion"]), ("supertrend", apart & on["supertrend"])]
    steps += [(r.id, side(r) != 0) for r in RULES]  # a completed rule is never masked by a preference
    chosen = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(id)) for id, c in steps])
    fallback = F.when(aligned, "continuation").when(F.col("trend") < 0.65, "stochastic").otherwise("continuation")
    return ctx.select("instrument", "bucket", F.coalesce(chosen, fallback).alias("rule"), chosen.isNotNull().alias("complete"))


def research_context(ctx: DataFrame, bars: DataFrame, minutes: int) -> DataFrame:
    """The columns of the research rules, for bars with 220 bars before them without a gap."""
    day = 24 * 60 * 60_000_000_000
    w = "PARTITION BY instrument ORDER BY bucket"
    day_w = f"PARTITION BY instrument, bucket div {day}L ORDER BY bucket"
    night = 7 * 60 // minutes
    rows = bars.withColumn("bar", F.expr(f"row_number() OVER ({w})")).withColumns({
        "typical": F.expr("(high + low + close) / 3"),
        "c240": F.expr(f"collect_list(close) OVER ({w} ROWS BETWEEN 239 PRECEDING AND CURRENT ROW)"),
        "slope40": F.expr(f"regr_slope(close, CAST(bar AS DOUBLE)) OVER ({w} ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)"),
        "cut40": F.expr(f"regr_intercept(close, CAST(bar AS DOUBLE)) OVER ({w} ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)"),
        "var40": F.expr(f"var_pop(close) OVER ({w} ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)"),
        "is_night": F.expr(f"bucket % {day}L < {7 * 3600}000000000L"),
    })
    rows = rows.withColumns({
        "night_high": F.expr(f"max(CASE WHEN is_night THEN high END) OVER ({day_w})"), "night_low": F.expr(f"min(CASE WHEN is_night THEN low END) OVER ({day_w})"),
        "session_ready": F.expr(f"count_if(is_night) OVER ({day_w}) = {night}"), "session_hour": F.expr(f"(bucket % {day}L) / 3.6e12 + {minutes / 60.0}"),
        "day_vwap": F.expr(f"CASE WHEN count(*) OVER ({day_w}) >= {max(2, 240 // minutes)} AND min(volume) OVER ({day_w}) > 0 THEN sum(typical * volume) OVER ({day_w}) / sum(volume) OVER ({day_w}) END"),
        "z40": F.expr("(close - cut40 - slope40 * bar) / nullif(sqrt(greatest(0.0, var40 - slope40 * slope40 * (40 * 40 - 1) / 12.0)), 0)"),
    })

    def mean200(values: Column) -> Column:
        seed = F.aggregate(F.slice(values, 1, 200), F.lit(0.0), lambda a, x: a + x) / 200
        return F.aggregate(F.slice(values, 201, 40), seed, lambda v, x: v + (x - v) * F.lit(2 / 201))

    def rsi2(values: Column) -> Column:
        moves = F.zip_with(F.slice(values, 2, 239), F.slice(values, 1, F.size(values) - 1), lambda b, a: b - a)
        one = lambda sign: F.aggregate(F.slice(moves, 3, 239), (F.greatest(sign * F.element_at(moves, 1), F.lit(0.0)) + F.greatest(sign * F.element_at(moves, 2), F.lit(0.0))) / 2, lambda v, x: (v + F.greatest(sign * x, F.lit(0.0))) / 2)
        gain, loss = one(F.lit(1.0)), one(F.lit(-1.0))
        return F.when(loss == 0, F.when(gain == 0, 50.0).otherwise(100.0)).otherwise(100 - 100 / (1 + gain / F.when(loss != 0, loss)))

    rows = rows.filter(F.size("c240") >= 220)
    before = F.slice("c240", 1, F.size("c240") - 1)
    rows = rows.withColumns({"ema200": mean200(F.col("c240")), "p_ema200": mean200(before), "rsi2": rsi2(F.col("c240")), "p_rsi2": rsi2(before)})
    rows = rows.withColumns({"p_day_vwap": F.expr(f"lag(day_vwap) OVER ({day_w})"), "p_z40": F.expr(f"lag(z40) OVER ({w})")})
    names = "ema200 p_ema200 rsi2 p_rsi2 night_high night_low session_ready session_hour day_vwap p_day_vwap z40 p_z40 slope40".split()
    return ctx.filter("run >= 220").join(rows.select("instrument", "bucket", *names), ["instrument", "bucket"])


def research_signals(ctx: DataFrame) -> DataFrame:
    """Signals of the research rules; one whose sides both hold does not fire."""
    entries = []
    for k, (rule, rr) in enumerate(RESEARCH):
        buy, sell = _all(rule.buy), _all(rule.sell)
        way = F.when(buy & ~sell, 1).when(sell & ~buy, -1).otherwise(0)
        entries.append(F.when((way != 0) & (F.col("atr") > 0), F.struct(
            F.lit(rule.id).alias("rule"), F.lit(len(RULES) + k).alias("rank"), F.lit(rule.family).alias("family"), way.alias("way"), (F.col("close") - way * F.col("atr") * 1.4).alias("stop"), F.lit(rr).alias("rr"), F.lit(100).alias("score"))))
    fired = ctx.withColumn("s", F.explode(F.array_compact(F.array(*entries))))
    target = F.col("close") + F.col("s.way") * F.abs(F.col("close") - F.col("s.stop")) * F.col("s.rr")
    return fired.select("instrument", "bucket", "close", "atr", "s.*", target.alias("target")).withColumnRenamed("close", "entry")
