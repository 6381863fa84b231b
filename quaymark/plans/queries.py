"""The registered queries: each operator over the given tables, with SQL where SQL can say it.

Events are read as trades of one instrument per event type, and of ``all`` together (the
only one without gaps at small sizes). Bars are 60 minutes wide unless stated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import texts, times
from ..operators import bars as B
from ..operators import features as V
from ..operators import metrics as M
from ..operators import recursive as R
from ..operators import resample as H
from ..operators import rolling as G
from ..operators import rules as K
from ..operators import stats as S
from ..operators import trades as T
from ..sources.tables import shared_folder, written
from ..streaming import live as L
from .recursive_sql import FOLDS, ROUND, market_features_sql, recursive_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
HOUR = 60 * B.MINUTE


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of each event type and of all together."""
    return B.ticks_from_events(table(spark, sf_dir, "events"), F.explode(F.array(F.col("event_type"), F.lit("all"))))


def hours(spark: SparkSession, sf_dir: str, minutes: int = 60) -> DataFrame:
    return B.ohlc(ticks(spark, sf_dir), minutes)


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> list:
    return [(F.round(c, digits) + 0.0).alias(c) for c in columns]  # no negative zero


def bars_sql(minutes: int = 60, steps: bool = False) -> str:
    w = minutes * B.MINUTE
    extra = f", coalesce(bucket - lag(bucket) OVER (PARTITION BY instrument ORDER BY bucket) = {w}, false) AS step_ok" if steps else ""
    return f"""WITH typed AS (SELECT event_type AS instrument, epoch_us(ts) * 1000 AS ns, event_id AS sequence, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume FROM events WHERE value > 0),
ticks AS (SELECT * FROM typed UNION ALL SELECT 'all', ns, sequence, price, volume FROM typed),
grouped AS (SELECT instrument, ns - ns % {w} AS bucket, arg_min(price, struct_pack(a := ns, b := sequence)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, struct_pack(a := ns, b := sequence)) AS close, sum(volume) AS volume, count(*) AS trades, max(ns) AS last_ns FROM ticks GROUP BY 1, 2),
newest AS (SELECT *, max(last_ns) OVER (PARTITION BY instrument) AS newest FROM grouped),
bars AS (SELECT instrument, bucket, open, high, low, close, volume, trades{extra} FROM newest WHERE bucket + {w} <= newest)
"""


BARS = bars_sql()
STEPS = bars_sql(steps=True)
SHAPE = ["instrument", "bucket", "open", "high", "low", "close", "volume", "trades"]


# -- bars -----------------------------------------------------------------------------


@query("a01_ohlc_15m", bars_sql(15) + "SELECT * FROM bars")
def ohlc_15m(spark, sf_dir):
    return hours(spark, sf_dir, 15).select(*SHAPE)


@query("a01_ohlc_60m", BARS + "SELECT * FROM bars")
def ohlc_60m(spark, sf_dir):
    return hours(spark, sf_dir).select(*SHAPE)


@query("a02_four_hours_from_hours", BARS + f"""SELECT instrument, bucket - bucket % {4 * HOUR} AS bucket, arg_min(open, bucket) AS open, max(high) AS high, min(low) AS low, arg_max(close, bucket) AS close,
sum(volume) AS volume, CAST(sum(trades) AS BIGINT) AS trades FROM bars b GROUP BY instrument, b.bucket - b.bucket % {4 * HOUR} HAVING count(*) = 4""")
def coarser(spark, sf_dir):
    return B.coarser(hours(spark, sf_dir), 240, 60).select(*SHAPE)


@query("a04_daily_levels", BARS + f"""SELECT b.instrument, b.bucket, p.h AS previous_day_high, p.l AS previous_day_low, t.oh AS opening_high, t.ol AS opening_low FROM bars b
LEFT JOIN (SELECT instrument, bucket // {24 * HOUR} AS day, max(high) AS h, min(low) AS l FROM bars GROUP BY 1, 2 HAVING count(*) = 24) p ON p.instrument = b.instrument AND p.day + 1 = b.bucket // {24 * HOUR}
LEFT JOIN (SELECT instrument, bucket // {24 * HOUR} AS day, max(high) AS oh, min(low) AS ol FROM bars WHERE bucket % {24 * HOUR} = 0 GROUP BY 1, 2) t ON t.instrument = b.instrument AND t.day = b.bucket // {24 * HOUR} AND b.bucket % {24 * HOUR} >= {HOUR} AND b.bucket % {24 * HOUR} < {4 * HOUR}""")
def daily_levels(spark, sf_dir):
    return B.daily_levels(hours(spark, sf_dir), 60).select("instrument", "bucket", "previous_day_high", "previous_day_low", "opening_high", "opening_low")


@query("a06_tick_totals", "SELECT event_type AS instrument, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS volume FROM events WHERE value > 0 GROUP BY 1")
def tick_totals(spark, sf_dir):
    t = B.ticks_from_events(table(spark, sf_dir, "events")).filter(B.valid_tick())
    return t.groupBy("instrument").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


@query("p02_since", "SELECT event_id AS sequence, epoch_us(ts) * 1000 AS ns, value AS price FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00'")
def since(spark, sf_dir):
    t = B.ticks_from_events(table(spark, sf_dir, "events"))
    return B.since(t, 1_705_752_000 * 1_000_000_000).select("sequence", "ns", "price")


@query("p07_contiguity", STEPS + """, islands AS (SELECT *, sum(CASE WHEN step_ok THEN 0 ELSE 1 END) OVER (PARTITION BY instrument ORDER BY bucket) AS g FROM bars)
SELECT instrument, bucket, step_ok, row_number() OVER (PARTITION BY instrument, g ORDER BY bucket) AS run FROM islands""")
def contiguity(spark, sf_dir):
    return B.with_steps(hours(spark, sf_dir), 60).select("instrument", "bucket", "step_ok", F.col("run").cast("long").alias("run"))


@query("p09_bar_quality", BARS + f""", s AS (SELECT *, bucket - lag(bucket) OVER (PARTITION BY instrument ORDER BY bucket) AS step FROM bars)
SELECT instrument, count(*) AS bars, count(*) FILTER (WHERE NOT (open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= greatest(open, close, low) AND low <= least(open, close))) AS invalid,
count(*) FILTER (WHERE step = 0) AS duplicates, count(*) FILTER (WHERE step > {HOUR}) AS gaps, CAST(coalesce(sum(CASE WHEN step > {HOUR} THEN step // {HOUR} - 1 END), 0) AS BIGINT) AS missing,
CASE WHEN count(*) FILTER (WHERE step > {HOUR}) > 0 THEN 'gaps' ELSE 'complete' END AS status FROM s GROUP BY 1""")
def bar_quality(spark, sf_dir):
    return B.quality(hours(spark, sf_dir), 60)


QUARTER = 15 * B.MINUTE


@query("q11_history_merge", BARS + f""", q AS (SELECT instrument, ns - ns % {QUARTER} AS bucket, arg_max(price, struct_pack(a := ns, b := sequence)) AS close, max(ns) AS last_ns FROM ticks GROUP BY 1, 2),
c AS (SELECT *, max(last_ns) OVER (PARTITION BY instrument) AS newest FROM q),
new AS (SELECT instrument, bucket - bucket % {HOUR} AS bucket, arg_max(close, bucket) AS close, 1 AS version FROM c WHERE bucket + {QUARTER} <= newest GROUP BY instrument, c.bucket - c.bucket % {HOUR} HAVING count(*) = 4),
m AS (SELECT *, row_number() OVER (PARTITION BY instrument, bucket ORDER BY version DESC) AS k FROM (SELECT instrument, bucket, close, 0 AS version FROM bars UNION ALL SELECT * FROM new)),
n AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY bucket DESC) AS r FROM m WHERE k = 1)
SELECT instrument, bucket, close, version FROM n WHERE r <= 5000""")
def history_merge(spark, sf_dir):
    """Hours from ticks, replaced where the same hour can be built of four quarters; the
    newest 5000 of each instrument are the history that is kept."""
    old = hours(spark, sf_dir).withColumn("version", F.lit(0))
    new = B.coarser(hours(spark, sf_dir, 15), 60, 15).withColumn("version", F.lit(1))
    return B.merge_keep_last(old, new, ["instrument", "bucket"], "version", 5000).select("instrument", "bucket", "close", "version")


# -- rolling indicators: one query for each, all from the same layered expressions ------

ROLLING = {
    "i03_bollinger": ["bb_mean", "bb_sd", "bb_upper", "bb_lower", "bb_width"], "i05_vwap": ["vwap"], "i10_stochastic": ["stoch_k", "stoch_d"],
    "i12_ichimoku": ["tenkan", "kijun", "cloud_a", "cloud_b", "cloud_top", "cloud_bottom", "chikou"], "i13_cci": ["cci"], "i17_vortex": ["vortex_plus", "vortex_minus"], "i22_williams": ["williams"],
    "i25_ultimate": ["ultimate"], "i29_demarker": ["demarker"], "i30_awesome": ["awesome"], "i31_donchian": ["high20", "low20", "high55", "low55", "recent_high", "recent_low"], "i32_roc": ["roc"],
    "i35_volume_ratio": ["volume_ratio", "volume_mean"], "i37_weighted_means": ["sma20", "wma10", "wma21"], "i38_ols": ["ols_slope", "ols_end", "ols_residual", "ols_r2"], "i39_efficiency": ["efficiency"], "i40_choppiness": ["chop"],
    "i41_alma": ["alma"], "i42_hma": ["hma"], "i43_coppock": ["coppock"], "i44_kst": ["kst", "kst_signal"], "i45_cmo": ["cmo"], "i46_cmf": ["cmf"], "i51_dpo": ["dpo"], "i53_vhf": ["vhf"], "i55_eom": ["eom"],
    "i58_mfi": ["mfi"], "i59_fractal": ["fractal_high", "fractal_low"], "i60_channels": ["failed_high", "failed_low", "retest_high", "retest_low"],
}


def _rolling(columns: list[str], digits: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = G.rolling(B.with_steps(hours(spark, sf_dir), 60)).filter("full >= 60")
        return out.select("instrument", "bucket", *rounded(out, columns, digits))

    return run


for _name, _columns in ROLLING.items():
    _digits = 2 if _name == "i55_eom" else 6  # its values are in the billions
    query(_name, STEPS + G.rolling_sql("bars", _columns, digits=_digits))(_rolling(_columns, _digits))


@query("i04_squeeze_threshold", STEPS + """, w AS (SELECT *, row_number() OVER s AS bar, 4 * stddev_pop(close) OVER (PARTITION BY instrument ORDER BY bucket ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
 / avg(close) OVER (PARTITION BY instrument ORDER BY bucket ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS width FROM bars WINDOW s AS (PARTITION BY instrument ORDER BY bucket)),
l AS (SELECT *, list(width) OVER (PARTITION BY instrument ORDER BY bucket ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING) AS l FROM w)
SELECT instrument, bucket, round(list_sort(l)[8], 6) AS squeeze_threshold FROM l WHERE bar >= 60""")
def squeeze(spark, sf_dir):
    out = G.rolling(B.with_steps(hours(spark, sf_dir), 60)).filter("full >= 60")
    return out.select("instrument", "bucket", *rounded(out, ["squeeze_threshold"]))


@query("i14_aroon", STEPS + """, w AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY bucket) AS bar FROM bars),
m AS (SELECT a.instrument, a.bucket, a.bar, arg_max(b.bar, struct_pack(h := b.high, i := b.bar)) AS at_high, arg_min(b.bar, struct_pack(l := b.low, i := -b.bar)) AS at_low
FROM w a JOIN w b ON a.instrument = b.instrument AND b.bar BETWEEN a.bar - 25 AND a.bar WHERE a.bar >= 60 GROUP BY 1, 2, 3)
SELECT instrument, bucket, round(100 * (25 - (bar - at_high)) / 25.0, 6) AS aroon_up, round(100 * (25 - (bar - at_low)) / 25.0, 6) AS aroon_down FROM m""")
def aroon(spark, sf_dir):
    out = G.rolling(B.with_steps(hours(spark, sf_dir), 60)).filter("full >= 60")
    return out.select("instrument", "bucket", *rounded(out, ["aroon_up", "aroon_down"]))


@query("i36_patterns", STEPS + """, w AS (SELECT *, row_number() OVER s AS bar, lag(high) OVER s < lag(high, 2) OVER s AND lag(low) OVER s > lag(low, 2) OVER s AS inside,
high > low AND min(CASE WHEN step_ok THEN 1 ELSE 0 END) OVER (PARTITION BY instrument ORDER BY bucket ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) = 1
 AND high - low < min(high - low) OVER (PARTITION BY instrument ORDER BY bucket ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS nr7 FROM bars WINDOW s AS (PARTITION BY instrument ORDER BY bucket))
SELECT instrument, bucket, inside, nr7 FROM w WHERE bar >= 60""")
def patterns(spark, sf_dir):
    return G.rolling(B.with_steps(hours(spark, sf_dir), 60)).filter("full >= 60").select("instrument", "bucket", "inside", "nr7")


# -- recursive indicators ---------------------------------------------------------------

WINDOWED = """, w AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY bucket) AS bar,
 list(struct_pack(o := open, h := high, l := low, c := close)) OVER (PARTITION BY instrument ORDER BY bucket ROWS BETWEEN 159 PRECEDING AND CURRENT ROW) AS x FROM bars)
"""


def ema_sql(n: int) -> str:
    return f"list_reduce(list_transform(x, lambda r: r.c), lambda v, c: v + (c - v) * {2 / (n + 1)!r})"


@query("i01_ema_window", BARS + WINDOWED + f"SELECT instrument, bucket, round({ema_sql(21)}, 6) AS ema21 FROM w WHERE bar >= 60")
def ema_window(spark, sf_dir):
    b = G.with_bar_number(hours(spark, sf_dir))
    return R.ema_native(b, 21).filter("bar >= 60").select("instrument", "bucket", F.round("ema21", 6).alias("ema21"))


def recursive(names: list[str]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = R.with_recursive(hours(spark, sf_dir), [n for x in names for n in (x, f"prev_{x}")]).filter(F.col(names[0]).isNotNull())
        return out.select("instrument", "bucket", *[c for n in names for c in rounded(out, [n, f"prev_{n}"], ROUND.get(n, 6))])

    return run


_WILDER = "list_reduce(list_prepend(list_avg({v}[1:14]), {v}[15:]), lambda v, d: (v * 13 + d) / 14)"
_RANGES = "list_transform(x, lambda r, i: greatest(r.h - r.l, abs(r.h - CASE WHEN i = 1 THEN r.o ELSE x[i - 1].c END), abs(r.l - CASE WHEN i = 1 THEN r.o ELSE x[i - 1].c END)))"


def _prev(sql: str) -> str:
    return sql.replace("(x,", "(x[:len(x) - 1],")


query("i06_atr", BARS + WINDOWED + f", t AS (SELECT *, {_RANGES} AS tr FROM w WHERE bar >= 60), s AS (SELECT *, tr[:len(tr) - 1] AS tr1 FROM t) SELECT instrument, bucket, round({_WILDER.format(v='tr')}, 6) AS atr, round({_WILDER.format(v='tr1')}, 6) AS prev_atr FROM s")(recursive(["atr"]))
query("i07_rsi", BARS + WINDOWED + f""", t AS (SELECT *, list_transform(range(2, len(x) + 1), lambda i: x[i].c - x[i - 1].c) AS d FROM w WHERE bar >= 60),
u AS (SELECT *, list_transform(d, lambda v: greatest(v, 0.0)) AS g, list_transform(d, lambda v: greatest(-v, 0.0)) AS l FROM t),
v AS (SELECT *, g[:len(g) - 1] AS g1, l[:len(l) - 1] AS l1 FROM u),
r AS (SELECT instrument, bucket, {_WILDER.format(v='g')} AS a, {_WILDER.format(v='l')} AS b, {_WILDER.format(v='g1')} AS a1, {_WILDER.format(v='l1')} AS b1 FROM v)
SELECT instrument, bucket, round(CASE WHEN b = 0 THEN CASE WHEN a = 0 THEN 50.0 ELSE 100.0 END ELSE 100 - 100 / (1 + a / b) END, 6) AS rsi, round(CASE WHEN b1 = 0 THEN CASE WHEN a1 = 0 THEN 50.0 ELSE 100.0 END ELSE 100 - 100 / (1 + a1 / b1) END, 6) AS prev_rsi FROM r""")(recursive(["rsi"]))
query("i01_emas", BARS + WINDOWED + "SELECT instrument, bucket, " + ", ".join(f"round({ema_sql(n)}, 6) AS ema{n}, round({_prev(ema_sql(n))}, 6) AS prev_ema{n}" for n in (9, 21, 50)) + " FROM w WHERE bar >= 60")(recursive(["ema9", "ema21", "ema50"]))

RECURSIVE = {
    "i08_macd": ["macd", "macd_signal"], "i09_supertrend": ["supertrend", "supertrend_way"], "i11_adx": ["adx", "di_plus", "di_minus"], "i15_parabolic_sar": ["sar", "sar_way"], "i16_fisher": ["fisher"], "i18_trix": ["trix", "trix_signal"],
    "i19_tsi": ["tsi", "tsi_signal"], "i20_dema": ["dema"], "i21_chandelier": ["chandelier_long", "chandelier_short"], "i23_kama": ["kama"], "i24_ppo": ["ppo", "ppo_signal"], "i26_smi": ["smi", "smi_signal"], "i27_stoch_rsi": ["stoch_rsi_k", "stoch_rsi_d"],
    "i28_elder_ray": ["bulls", "bears"], "i49_tema_zlema": ["tema", "zlema"], "i50_stc": ["stc"], "i52_mass_index": ["mass", "mass_bulge"], "i54_force": ["force"], "i56_volume_indices": ["nvi", "vpt", "adl"], "i57_volume_signals": ["nvi_signal", "vpt_signal", "adl_high", "adl_low"],
}
for _name, _columns in RECURSIVE.items():
    query(_name, recursive_sql(_name, BARS, _columns) if _name in FOLDS else None)(recursive(_columns))


@query("i33_keltner_trend", BARS + WINDOWED + f""", t AS (SELECT *, {_RANGES} AS tr FROM w WHERE bar >= 60), s AS (SELECT *, {_WILDER.format(v='tr')} AS atr, {ema_sql(20)} AS e20, {ema_sql(21)} AS e21, {ema_sql(50)} AS e50 FROM t)
SELECT instrument, bucket, round(e20 - 2 * atr, 6) AS keltner_lower, round(e20 + 2 * atr, 6) AS keltner_upper, round(abs(e21 - e50) / greatest(atr, 1e-9), 6) AS trend FROM s""")
def keltner(spark, sf_dir):
    r = R.with_recursive(hours(spark, sf_dir), ["ema20", "ema21", "ema50", "atr"]).filter("atr IS NOT NULL")
    return r.select("instrument", "bucket", F.expr("round(ema20 - 2 * atr, 6)").alias("keltner_lower"), F.expr("round(ema20 + 2 * atr, 6)").alias("keltner_upper"), F.expr("round(abs(ema21 - ema50) / greatest(atr, 1e-9), 6)").alias("trend"))


@query("i63_higher_direction", BARS + f""", h AS (SELECT instrument, bucket - bucket % {4 * HOUR} AS start, arg_max(close, bucket) AS close, max(bucket) AS last FROM bars b GROUP BY instrument, b.bucket - b.bucket % {4 * HOUR} HAVING count(*) = 4),
l AS (SELECT *, list(close) OVER (PARTITION BY instrument ORDER BY start ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS x FROM h),
e AS (SELECT *, list_reduce(x, lambda v, c: v + (c - v) * 0.2) AS fast, list_reduce(x, lambda v, c: v + (c - v) * {2 / 22!r}) AS slow,
 list_reduce(x[:len(x) - 1], lambda v, c: v + (c - v) * 0.2) AS before FROM l WHERE len(x) >= 21)
SELECT instrument, start AS bucket, CASE WHEN fast > slow AND fast > before THEN 'UP' WHEN fast < slow AND fast < before THEN 'DOWN' ELSE 'NEUTRAL' END AS direction FROM e""")
def higher_direction(spark, sf_dir):
    return higher(hours(spark, sf_dir), 240, 60)


def higher(b: DataFrame, minutes: int, step: int) -> DataFrame:
    """Direction of the coarser bars: two exponential means over their last 60."""
    h = B.coarser(b, minutes, step).withColumn("x", F.expr("collect_list(close) OVER (PARTITION BY instrument ORDER BY bucket ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)")).filter("size(x) >= 21")
    mean = lambda x, n: F.aggregate(F.slice(x, 2, 60), F.element_at(x, 1), lambda v, c: v + (c - v) * F.lit(2 / (n + 1)))
    h = h.withColumns({"fast": mean(F.col("x"), 9), "slow": mean(F.col("x"), 21), "before": mean(F.slice("x", 1, F.size("x") - 1), 9)})
    way = F.when((F.col("fast") > F.col("slow")) & (F.col("fast") > F.col("before")), "UP").when((F.col("fast") < F.col("slow")) & (F.col("fast") < F.col("before")), "DOWN").otherwise("NEUTRAL")
    return h.select("instrument", "bucket", way.alias("direction"))


@query("j06_asof_higher", BARS + f""", h AS (SELECT instrument, bucket - bucket % {4 * HOUR} AS start, arg_max(close, bucket) AS close FROM bars b GROUP BY instrument, b.bucket - b.bucket % {4 * HOUR} HAVING count(*) = 4)
SELECT b.instrument, b.bucket, h.close AS higher_close FROM bars b ASOF LEFT JOIN (SELECT instrument, start + {4 * HOUR} AS ends, close FROM h) h ON b.instrument = h.instrument AND b.bucket + {HOUR} >= h.ends""")
def asof_higher(spark, sf_dir):
    """The last complete coarser bar at or before each bar's end: one sorted pass over the
    union of both, not a range join."""
    b = hours(spark, sf_dir)
    h = B.coarser(b, 240, 60).select("instrument", (F.col("bucket") + 4 * HOUR).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("bucket"), F.col("close").alias("h"))
    u = h.unionByName(b.select("instrument", (F.col("bucket") + HOUR).alias("at"), F.lit(1).alias("kind"), "bucket", F.lit(None).cast("double").alias("h")))
    w = Window.partitionBy("instrument").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return u.withColumn("higher_close", F.last("h", ignorenulls=True).over(w)).filter("kind = 1").select("instrument", "bucket", "higher_close")


# -- readiness and features ---------------------------------------------------------------


@query("p08_readiness", STEPS + f""", n AS (SELECT *, row_number() OVER s AS bar, CASE WHEN open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= greatest(open, close, low) AND low <= least(open, close) AND coalesce(volume, 0) >= 0 THEN 0 ELSE 1 END AS bad FROM bars WINDOW s AS (PARTITION BY instrument ORDER BY bucket)),
asked(warmup, volume) AS (VALUES {', '.join(f'({w}, {str(v).lower()})' for w, v in V.requirements())}),
h AS (SELECT a.instrument, a.bucket, a.bar, q.warmup, q.volume, count(*) FILTER (WHERE b.bar > a.bar - q.warmup AND b.bad = 1) AS bad, count(*) FILTER (WHERE b.bar > a.bar - q.warmup + 1 AND NOT b.step_ok) AS gaps,
 count(*) FILTER (WHERE b.bar > a.bar - 60 AND coalesce(b.volume, 0) <= 0) AS idle FROM n a CROSS JOIN asked q JOIN n b ON b.instrument = a.instrument AND b.bar BETWEEN a.bar - greatest(q.warmup, 60) + 1 AND a.bar GROUP BY 1, 2, 3, 4, 5)
SELECT instrument, bucket, warmup, volume, CASE WHEN bar < warmup THEN 'insufficient-history' WHEN bad > 0 OR gaps > 0 THEN 'non-contiguous-history' WHEN volume AND idle > 0 THEN 'real-volume-required' END AS reason FROM h""")
def ready(spark, sf_dir):
    return V.readiness(hours(spark, sf_dir), 60)


@query("v19_market_features", market_features_sql(STEPS, HOUR))
def market_vectors(spark, sf_dir):
    b = written(hours(spark, sf_dir), "bars")
    v = V.market_features(K.context(b, 60), b, directions(b), 60)
    return v.select("instrument", "bucket", *rounded(v, V.MARKET))


@query("m25_factor_check", BARS + """, r AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY bucket DESC) AS r FROM bars)
SELECT instrument, max(bucket) AS bucket, round(avg(close), 6) AS mean20, round(stddev_samp(close), 6) AS std20, round(regr_slope(close, -r), 6) AS slope20, round(regr_r2(close, -r), 6) AS r_squared20 FROM r WHERE r <= 20 GROUP BY 1 HAVING count(*) = 20""")
def factor_check(spark, sf_dir):
    """Mean, sample deviation, slope and fit of the last 20 closes of each instrument."""
    out = G.rolling(B.with_steps(hours(spark, sf_dir), 60)).groupBy("instrument").agg(F.max_by(F.struct("bucket", "full", "sma20", "bb_sd", "ols_slope", "ols_r2"), "bucket").alias("n")).select("instrument", "n.*").filter("full >= 20")
    out = out.select("instrument", "bucket", F.col("sma20").alias("mean20"), (F.col("bb_sd") * F.sqrt(F.lit(20 / 19))).alias("std20"), F.col("ols_slope").alias("slope20"), F.col("ols_r2").alias("r_squared20"))
    return out.select("instrument", "bucket", *rounded(out, ["mean20", "std20", "slope20", "r_squared20"]))


# -- rules ------------------------------------------------------------------------------


@query("k01_signals")
def signals(spark, sf_dir):
    s = K.signals(K.context(hours(spark, sf_dir), 60))
    return s.select("instrument", "bucket", "rule", "family", F.when(F.col("way") == 1, "BUY").otherwise("SELL").alias("side"), "score", *rounded(s, ["entry", "stop", "target"]))


@query("k01_readiness")
def readiness(spark, sf_dir):
    """How near each bar is to the rules that have not fired: the best score below 100."""
    ctx = K.context(hours(spark, sf_dir), 60)
    scores = F.array_sort(F.array(*[F.struct((-K.score(r)).alias("score"), F.lit(r.id).alias("rule")) for r in K.RULES]))
    best = F.element_at(F.filter(scores, lambda s: s["score"] > -100), 1)
    return ctx.select("instrument", "bucket", best["rule"].alias("rule"), (-best["score"]).alias("score"))


@query("k03_router")
def router(spark, sf_dir):
    return K.route(K.context(hours(spark, sf_dir), 60))


@query("k09_research_signals")
def research(spark, sf_dir):
    b = hours(spark, sf_dir)
    s = K.research_signals(K.research_context(K.context(b, 60), b, 60))
    return s.select("instrument", "bucket", "rule", "way", *rounded(s, ["entry", "stop", "target"]))


@query("a21_family_summary")
def families(spark, sf_dir):
    """Rules of each family, those that fired, and their signals; families without any count too."""
    rules = spark.createDataFrame([(r.id, r.family) for r in K.RULES], "rule string, family string")
    catalogue = spark.createDataFrame([(f,) for f in K.FAMILIES], "family string").join(rules, "family", "left")
    fired = K.signals(K.context(hours(spark, sf_dir), 60)).groupBy("rule").agg(F.count("*").alias("n"), F.sum("score").alias("s"))
    each = catalogue.join(fired, "rule", "left").groupBy("family")
    return each.agg(F.count("rule").alias("rules"), F.count("n").alias("fired"), F.coalesce(F.sum("n"), F.lit(0)).alias("signals"), (F.sum("s") / F.sum("n")).alias("score"))


@query("k08_trade_examples")
def examples(spark, sf_dir):
    """Signals of all rules under three costs, labelled: the training examples."""
    t = rule_trades(spark, sf_dir)
    return t.select("instrument", "bucket", "rule", "family", "way", "cost", "valid", "reason", "status", "y", "ambiguous", "entry_ns", "label_end_ns", *rounded(t, ["net_rr", "net_r"]))


def directions(b: DataFrame) -> DataFrame:
    """(instrument, at, direction): the four-hour direction by the time it is known."""
    return higher(b, 240, 60).select("instrument", (F.col("bucket") + 4 * HOUR).alias("at"), "direction")


def considered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bars, their context, and the signals that the bar after follows at once (``next_open``),
    with ``rejected``: the rule's history does not suffice, or the coarser direction is opposed."""
    b = written(hours(spark, sf_dir), "bars")  # read five times below; the ticks are read once
    ctx = K.context(b, 60)
    follow = b.select("instrument", (F.col("bucket") - HOUR).alias("bucket"), F.col("open").alias("next_open"))
    fired = V.with_direction(V.ready_signals(K.signals(ctx), b, 60).join(follow, ["instrument", "bucket"]), directions(b), 60)
    opposed = ((F.col("way") == 1) & (F.col("direction") == "DOWN")) | ((F.col("way") == -1) & (F.col("direction") == "UP"))
    rejected = F.when(F.col("not_ready").isNotNull(), "history").when(opposed, "higher")
    # written: plans refer to their columns many times over, and the rules of all would be put in each
    return b, ctx, written(fired.withColumn("rejected", rejected).drop("not_ready", "direction"), "fired")


def rule_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of the signals that are not rejected, entered at the next bar's open, labelled."""
    b, _, fired = considered(spark, sf_dir)
    chosen = fired.filter("rejected IS NULL").drop("rejected")
    return T.label(T.plans(chosen, quote="next_open").drop("next_open"), b, 60)


@query("k08_rejected_signals")
def rejected(spark, sf_dir):
    """Why signals do not become examples: history, coarser direction, or the plan under a cost."""
    _, _, fired = considered(spark, sf_dir)
    planned = T.plans(fired, quote="next_open")
    why = F.coalesce("rejected", F.when(~F.col("valid"), "plan"), F.lit("none"))
    return planned.groupBy("cost", why.alias("why")).agg(F.count("*").alias("n"))


@query("v116_trade_features")
def trade_vectors(spark, sf_dir):
    """The feature vector of each valid plan: 34 features, then the 82 of the second version."""
    b, ctx, fired = considered(spark, sf_dir)
    planned = T.plans(fired.filter("rejected IS NULL").drop("rejected"), quote="next_open").filter("valid")
    v = V.trade_features(written(planned, "planned"), written(V.market_features(ctx, b, directions(b), 60), "vectors"), 60)
    return v.select("instrument", "bucket", "rule", "way", "cost", F.transform("features", lambda x: F.round(x, 6) + 0.0).alias("features"))


@query("k12_ranked_ideas")
def ideas(spark, sf_dir):
    """The best three of each bar: complete first, nearest by ATR, one for each rule."""
    s = K.signals(K.context(hours(spark, sf_dir), 60)).withColumn("distance", F.abs(F.col("target") - F.col("entry")) / F.col("atr"))
    w = Window.partitionBy("instrument", "bucket").orderBy(F.desc("score"), F.col("distance").asc_nulls_last(), "rule", "way")
    return s.withColumn("place", F.row_number().over(w)).filter("place <= 3").select("instrument", "bucket", "place", "rule", "way", F.round("distance", 6).alias("distance"))


# -- labels of simple plans (SQL can say these) -------------------------------------------


def bracket_trades(spark: SparkSession, sf_dir: str, costs: tuple[float, ...] = (1.0, 2.0)) -> DataFrame:
    """A long and a short trade at every bar with barriers three percent away."""
    b = hours(spark, sf_dir)
    s = b.select("instrument", "bucket", F.col("close").alias("entry"), F.lit(1e9).alias("atr"), F.explode(F.array(F.lit(1), F.lit(-1))).alias("way"))
    s = s.withColumns({"rule": F.when(F.col("way") == 1, "long").otherwise("short"), "stop": F.col("entry") * (1 - 0.03 * F.col("way")), "target": F.col("entry") * (1 + 0.03 * F.col("way"))})
    return T.label(T.plans(s, costs), b, 60)


TRADES = BARS + f""", plans AS (SELECT instrument, bucket, w.way, CASE WHEN w.way = 1 THEN 'long' ELSE 'short' END AS rule, c.cost, close * (1 + w.way * (c.cost * 2.0 / 10000)) AS entry, close * (1 - 0.03 * w.way) AS stop, close * (1 + 0.03 * w.way) AS target
 FROM bars, (VALUES (1), (-1)) w(way), (VALUES (1.0::DOUBLE), (2.0::DOUBLE)) c(cost)),
ahead AS (SELECT p.*, k.k, b.bucket AS bt, b.open AS o, b.high AS h, b.low AS l, b.close AS c FROM plans p CROSS JOIN generate_series(1, 16) k(k) LEFT JOIN bars b ON b.instrument = p.instrument AND b.bucket = p.bucket + k.k * {HOUR}),
touched AS (SELECT *, CASE WHEN bt IS NULL THEN 'censored' WHEN (way = 1 AND l <= stop) OR (way = -1 AND h >= stop) THEN 'stop' WHEN (way = 1 AND h >= target) OR (way = -1 AND l <= target) THEN 'target' WHEN k = 16 THEN 'expired' END AS kind FROM ahead),
first AS (SELECT instrument, bucket, rule, way, cost, entry, stop, target, arg_min(kind, k) AS status, min(bt + {HOUR}) FILTER (WHERE kind IS NOT NULL) AS ends,
 arg_min(CASE WHEN way = 1 THEN least(stop, o) ELSE greatest(stop, o) END, k) FILTER (WHERE kind IS NOT NULL) AS stopped, arg_min(c, k) FILTER (WHERE kind IS NOT NULL) AS last FROM touched GROUP BY ALL),
settled AS (SELECT *, CASE status WHEN 'stop' THEN stopped WHEN 'target' THEN target WHEN 'expired' THEN last END * (1 - way * cost * 2.0 / 10000) AS exit, stop * (1 - way * (cost * 2.0 / 10000)) AS exit_stop FROM first),
trades AS (SELECT instrument, bucket, rule, cost, status, bucket + {HOUR} AS entry_ns, CASE WHEN status <> 'censored' THEN ends END AS label_end_ns,
 (way * (exit - entry) - (entry + exit) * (cost * 2.0) / 10000) / (way * (entry - exit_stop) + (entry + exit_stop) * (cost * 2.0) / 10000) AS net_r FROM settled)
"""


@query("j05_barrier_labels", TRADES + "SELECT instrument, bucket, rule, cost, status, label_end_ns, round(net_r, 6) AS net_r FROM trades")
def barrier_labels(spark, sf_dir):
    return bracket_trades(spark, sf_dir).select("instrument", "bucket", "rule", "cost", "status", "label_end_ns", F.round("net_r", 6).alias("net_r"))


@query("j05_barrier_join", TRADES + "SELECT instrument, bucket, rule, cost, status FROM trades")
def barrier_join(spark, sf_dir):
    b = hours(spark, sf_dir)
    s = b.select("instrument", "bucket", F.col("close").alias("entry"), F.lit(1e9).alias("atr"), F.explode(F.array(F.lit(1), F.lit(-1))).alias("way"))
    s = s.withColumns({"rule": F.when(F.col("way") == 1, "long").otherwise("short"), "stop": F.col("entry") * (1 - 0.03 * F.col("way")), "target": F.col("entry") * (1 + 0.03 * F.col("way"))})
    return T.label_join(T.plans(s, (1.0, 2.0)), b, 60)


@query("k05_net_plans", TRADES + "SELECT instrument, bucket, rule, cost, round(entry, 6) AS entry, round(way * (entry - exit_stop) + (entry + exit_stop) * (cost * 2.0) / 10000, 6) AS net_risk FROM settled")
def net_plans(spark, sf_dir):
    t = bracket_trades(spark, sf_dir)
    return t.select("instrument", "bucket", "rule", "cost", *rounded(t, ["entry", "net_risk"]))


@query("a08_outcome_counts", TRADES + "SELECT rule, cost, count(*) AS n, count(*) FILTER (WHERE status = 'target') AS target, count(*) FILTER (WHERE status = 'stop') AS stop, count(*) FILTER (WHERE status = 'expired') AS expired, count(*) FILTER (WHERE status = 'censored') AS censored, count(*) FILTER (WHERE net_r > 0) AS positive, count(*) FILTER (WHERE net_r < 0) AS negative, round(avg(net_r), 6) AS mean_r FROM trades GROUP BY 1, 2")
def outcome_counts(spark, sf_dir):
    o = M.outcome_counts(bracket_trades(spark, sf_dir), "rule", "cost")
    return o.drop("ambiguous").withColumn("mean_r", F.round("mean_r", 6))


@query("q01_non_overlapping", TRADES.replace("WITH ", "WITH RECURSIVE ", 1) + """, t AS (SELECT * FROM trades WHERE label_end_ns IS NOT NULL),
n AS (SELECT t.*, u.entry_ns AS next_entry FROM t ASOF LEFT JOIN t u ON t.instrument = u.instrument AND t.rule = u.rule AND t.cost = u.cost AND t.label_end_ns < u.entry_ns),
picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instrument, rule, cost ORDER BY entry_ns) AS k FROM n) WHERE k = 1
 UNION ALL SELECT n.*, p.k + 1 FROM picked p JOIN n ON n.instrument = p.instrument AND n.rule = p.rule AND n.cost = p.cost AND n.entry_ns = p.next_entry)
SELECT instrument, rule, cost, entry_ns, label_end_ns, status FROM picked""")
def non_overlapping(spark, sf_dir):
    t = T.non_overlapping(bracket_trades(spark, sf_dir), ["instrument", "rule", "cost"])
    return t.select("instrument", "rule", "cost", "entry_ns", "label_end_ns", "status")


@query("k07_one_position")
def one_position(spark, sf_dir):
    t = T.one_position(rule_trades(spark, sf_dir).filter("valid"), ["instrument", "rule", "cost"])
    m = M.trade_metrics(t, "rule", "cost")
    return m.select("rule", "cost", "n", "wins", *rounded(m, ["expectancy", "total_r", "profit_factor", "drawdown", "win_rate", "low", "high"]))


@query("a11_trade_metrics", TRADES + """, d AS (SELECT *, sum(net_r) OVER w AS s FROM trades WHERE net_r IS NOT NULL WINDOW w AS (PARTITION BY instrument, rule, cost ORDER BY entry_ns ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, greatest(max(s) OVER (PARTITION BY instrument, rule, cost ORDER BY entry_ns ROWS UNBOUNDED PRECEDING), 0.0) AS top FROM d),
g AS (SELECT instrument, rule, cost, count(*) AS n, count(*) FILTER (WHERE net_r > 0) AS wins, avg(net_r) AS expectancy, sum(net_r) AS total_r, sum(greatest(net_r, 0.0)) AS gain, sum(greatest(-net_r, 0.0)) AS loss, max(top - s) AS drawdown FROM e GROUP BY 1, 2, 3)
SELECT instrument, rule, cost, n, wins, round(expectancy, 6) AS expectancy, round(total_r, 6) AS total_r, round(gain / nullif(loss, 0), 6) AS profit_factor, round(drawdown, 6) AS drawdown, round(100.0 * wins / n, 6) AS win_rate,
round(100 * ((wins * 1.0 / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt((wins * 1.0 / n) * (1 - wins * 1.0 / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 6) AS low FROM g""")
def trade_metrics(spark, sf_dir):
    m = M.trade_metrics(bracket_trades(spark, sf_dir), "instrument", "rule", "cost")
    return m.select("instrument", "rule", "cost", "n", "wins", *rounded(m, ["expectancy", "total_r", "profit_factor", "drawdown", "win_rate", "low"]))


@query("q08_losing_streak", TRADES + """, d AS (SELECT *, CASE WHEN net_r < 0 THEN 1 ELSE 0 END AS loss FROM trades WHERE net_r IS NOT NULL),
i AS (SELECT *, sum(1 - loss) OVER (PARTITION BY instrument, rule, cost ORDER BY entry_ns) AS g FROM d), r AS (SELECT instrument, rule, cost, g, sum(loss) AS run FROM i GROUP BY 1, 2, 3, 4)
SELECT instrument, rule, cost, CAST(max(run) AS BIGINT) AS longest_losing_streak FROM r GROUP BY 1, 2, 3""")
def streak(spark, sf_dir):
    return M.losing_streak(bracket_trades(spark, sf_dir), "instrument", "rule", "cost")


@query("m07_grid_search", TRADES + """, c AS (SELECT instrument, rule, cost, count(*) AS n, avg(net_r) AS m FROM trades WHERE net_r IS NOT NULL GROUP BY 1, 2, 3)
SELECT instrument, rule, min(n) AS n, round(min(m), 6) AS objective, count(*) AS costs, min(n) >= 50 AS eligible FROM c GROUP BY 1, 2""")
def grid(spark, sf_dir):
    g = S.grid_search(bracket_trades(spark, sf_dir), 50, ("instrument", "rule"))
    return g.select("instrument", "rule", "n", F.round("objective", 6).alias("objective"), "costs", "eligible")


@query("q04_purged_split", TRADES + f""", u AS (SELECT DISTINCT entry_ns FROM trades WHERE label_end_ns IS NOT NULL), o AS (SELECT list_sort(list(entry_ns)) AS l FROM u), b AS (SELECT l[len(l) // 2 + 1] AS first, l[len(l) * 3 // 4 + 1] AS second FROM o)
SELECT CASE WHEN entry_ns < first AND label_end_ns < first THEN 'train' WHEN entry_ns >= first + {16 * HOUR} AND entry_ns < second AND label_end_ns < second THEN 'validation' WHEN entry_ns >= second + {16 * HOUR} THEN 'test' ELSE 'purged' END AS part, count(*) AS n
FROM trades, b WHERE label_end_ns IS NOT NULL GROUP BY 1""")
def purged(spark, sf_dir):
    return T.purged_split(bracket_trades(spark, sf_dir).filter("label_end_ns IS NOT NULL"), 60).groupBy("part").agg(F.count("*").alias("n"))


@query("q06_walk_forward")
def walk_forward(spark, sf_dir):
    w = T.walk_forward(written(bracket_trades(spark, sf_dir).filter("label_end_ns IS NOT NULL"), "trades"), 60)
    m = M.trade_metrics(w, "fold", "part", "rule", "cost")
    return m.select("fold", "part", "rule", "cost", "n", *rounded(m, ["expectancy", "drawdown"]))


@query("m08_walk_forward_rules")
def walk_forward_rules(spark, sf_dir):
    """The research report: rules chosen in each fold's fit window, measured in its test."""
    t = rule_trades(spark, sf_dir).filter("valid AND label_end_ns IS NOT NULL").select("instrument", "rule", "cost", "entry_ns", "label_end_ns", "net_r")
    t = written(t, "trades")
    w = T.walk_forward(t, 60)
    best = S.grid_search(w.filter("part = 'fit'"), 20, ("fold", "rule")).filter("eligible")
    top = best.withColumn("r", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("objective"), "rule"))).filter("r = 1").select("fold", "rule")
    m = M.trade_metrics(w.filter("part = 'test'").join(top, ["fold", "rule"]), "fold", "rule", "cost")
    return m.select("fold", "rule", "cost", "n", *rounded(m, ["expectancy", "drawdown"]))


@query("m20_class_labels", BARS + f""", f AS (SELECT *, lead(close, 4) OVER w AS later, lead(bucket, 4) OVER w AS later_at FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY bucket))
SELECT instrument, bucket, CASE WHEN later_at = bucket + {4 * HOUR} THEN CASE WHEN later / close - 1 > 0.02 THEN 'UP' WHEN later / close - 1 < -0.02 THEN 'DOWN' ELSE 'FLAT' END END AS class FROM f""")
def class_labels(spark, sf_dir):
    return T.class_label(hours(spark, sf_dir), 60, F.lit(0.02)).select("instrument", "bucket", "class")


# -- resampling -------------------------------------------------------------------------


@query("m01_stationary_bootstrap")
def m01(spark, sf_dir):
    return S.stationary_bootstrap(bracket_trades(spark, sf_dir), ["instrument", "rule", "cost"])


@query("m02_block_bootstrap")
def m02(spark, sf_dir):
    return S.block_bootstrap(bracket_trades(spark, sf_dir), ["instrument", "rule", "cost"])


@query("m03_moving_blocks")
def m03(spark, sf_dir):
    return H.moving_blocks(bracket_trades(spark, sf_dir), ["instrument", "rule", "cost"])


@query("m05_path_risk")
def m05(spark, sf_dir):
    return S.path_risk(bracket_trades(spark, sf_dir), ["instrument", "rule", "cost"])


@query("m06_holm", TRADES + """, p AS (SELECT instrument, rule, cost, (count(*) FILTER (WHERE net_r <= 0) + 1) / (count(*) + 1.0) / 10 AS p FROM trades WHERE net_r IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT *, p * (count(*) OVER () - row_number() OVER (ORDER BY p, instrument, rule, cost) + 1) AS raw, row_number() OVER (ORDER BY p, instrument, rule, cost) AS k FROM p)
SELECT instrument, rule, cost, round(p, 9) AS p, round(least(1.0, max(raw) OVER (ORDER BY k)), 9) AS p_holm FROM r""")
def holm(spark, sf_dir):
    t = bracket_trades(spark, sf_dir).filter("net_r IS NOT NULL").groupBy("instrument", "rule", "cost").agg(((F.count_if(F.col("net_r") <= 0) + 1) / (F.count("*") + 1) / 10).alias("p"))
    h = M.holm(t)
    return h.select("instrument", "rule", "cost", F.round("p", 9).alias("p"), F.round("p_holm", 9).alias("p_holm"))


# -- probabilities ------------------------------------------------------------------------

SCORED = "WITH s AS (SELECT (o_orderkey * 37 % 1001) / 1000.0 AS probability, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, o_orderpriority AS k, o_orderkey AS id FROM orders)\n"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_orderkey") * 37 % 1001 / 1000.0).alias("probability"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), F.col("o_orderpriority").alias("k"), F.col("o_orderkey").alias("id"))


@query("a10_reliability_bins", SCORED + "SELECT CAST(b.b AS INTEGER) AS bin, count(s.y) AS n, round(avg(y), 9) AS rate, round(avg(probability), 9) AS mean_probability FROM range(10) b(b) LEFT JOIN s ON least(9, CAST(floor(probability * 10) AS INTEGER)) = b.b GROUP BY 1")
def reliability(spark, sf_dir):
    r = M.reliability(scored(spark, sf_dir))
    return r.select("bin", "n", *rounded(r, ["rate", "mean_probability"], 9))


@query("a15_brier", SCORED + "SELECT k, count(*) AS n, round(avg((probability - y) * (probability - y)), 9) AS brier, round(avg(y) * (1 - avg(y)), 9) AS baseline, round(avg(CASE WHEN (probability >= 0.5) = (y = 1) THEN 1 ELSE 0 END), 9) AS accuracy FROM s GROUP BY 1")
def brier(spark, sf_dir):
    b = M.brier(scored(spark, sf_dir), "probability", "y", "k")
    return b.select("k", "n", *rounded(b, ["brier", "baseline", "accuracy"], 9))


@query("a14_segments", SCORED + """, r AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS r, count(*) OVER () AS n FROM s)
SELECT CASE WHEN r >= n * 2 // 3 THEN 2 WHEN r >= n // 3 THEN 1 ELSE 0 END AS segment, count(*) AS n, count(*) FILTER (WHERE probability > 0.6) AS selected, round(avg(y) FILTER (WHERE probability > 0.6), 9) AS hit_rate, round(avg(y), 9) AS rate FROM r GROUP BY 1""")
def segments(spark, sf_dir):
    s = M.segments(scored(spark, sf_dir), "id")
    return s.select("segment", "n", "selected", *rounded(s, ["hit_rate", "rate"], 9))


@query("p12_confidence_gate", SCORED + "SELECT id FROM s WHERE floor(probability * 1000 + 0.5) > 600")
def confidence(spark, sf_dir):
    return scored(spark, sf_dir).filter(M.confident(F.col("probability"))).select("id")


@query("m23_publication_gate", SCORED + "SELECT k, count(*) AS n, avg((probability - y) * (probability - y)) < avg(y) * (1 - avg(y)) AND count(*) >= 200 AND sum(y) >= 40 AND sum(1 - y) >= 40 AS published FROM s GROUP BY 1")
def gate(spark, sf_dir):
    return M.publication_gate(scored(spark, sf_dir), "k").select("k", "n", "published")


@query("a17_quantiles", """WITH l AS (SELECT l_returnflag AS k, list_sort(list(l_extendedprice)) AS x FROM lineitem GROUP BY 1)
SELECT k, len(x) AS n, """ + ", ".join(f"round(q.q{p}, 6) AS linear_{p}, x[CAST(floor((len(x) - 1) * {p / 100}) AS BIGINT) + 1] AS lower_{p}, x[greatest(CAST(ceil(len(x) * {p / 100}) AS BIGINT), 1)] AS nearest_{p}" for p in (5, 50, 95))
+ " FROM l JOIN (SELECT l_returnflag AS f, " + ", ".join(f"quantile_cont(l_extendedprice, {p / 100}) AS q{p}" for p in (5, 50, 95)) + " FROM lineitem GROUP BY 1) q ON q.f = l.k")
def quantiles(spark, sf_dir):
    q = M.quantiles(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("k"), "l_extendedprice"), "l_extendedprice", (0.05, 0.5, 0.95), "k")
    return q.select("k", "n", *[c for p in (5, 50, 95) for c in (F.round(f"linear_{p}", 6).alias(f"linear_{p}"), F.col(f"lower_{p}"), F.col(f"nearest_{p}"))])


@query("a19_equity", "SELECT o_custkey AS account, sum(CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice) ELSE 0 END) AS realized, sum(CASE WHEN o_orderstatus <> 'F' THEN round(o_totalprice) ELSE 0 END) AS floating, count(DISTINCT CAST(o_orderdate AS DATE)) AS trading_days FROM orders GROUP BY 1")
def equity(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    p = o.select(F.col("o_custkey").alias("account"), F.col("o_orderdate").cast("timestamp").alias("at"), (F.col("o_orderstatus") == "F").alias("closed"), F.round("o_totalprice").alias("pnl"), F.lit(0.0).alias("risk"))
    return M.equity(p, "UTC").select("account", "realized", "floating", "trading_days")


@query("m10_standardized", """WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_discount) AS md, stddev_pop(l_discount) AS sd FROM lineitem)
SELECT l_orderkey, l_linenumber, round(greatest(-5, least(5, (l_quantity - mq) / sq)), 6) AS l_quantity, round(greatest(-5, least(5, (l_discount - md) / sd)), 6) AS l_discount FROM lineitem, s""")
def standardized(spark, sf_dir):
    z = S.standardized(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"), ["l_quantity", "l_discount"])
    return z.select("l_orderkey", "l_linenumber", *rounded(z, ["l_quantity", "l_discount"]))


TREE = {"split_feature": 0, "threshold": 24.5, "decision_type": "<=", "missing_type": "NaN", "default_left": False, "left_child": {"split_feature": 1, "threshold": 0.045, "left_child": {"leaf_value": -0.4}, "right_child": {"leaf_value": 0.1}}, "right_child": {"split_feature": 2, "threshold": "1||3||5", "decision_type": "==", "left_child": {"leaf_value": 0.7}, "right_child": {"leaf_value": 0.2}}}


@query("m22_tree_scores", """SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(1.5 * m - 0.2))), 9) AS p FROM (SELECT *, CASE WHEN l_quantity <= 24.5 THEN CASE WHEN l_discount <= 0.045 THEN -0.4 ELSE 0.1 END ELSE CASE WHEN l_linenumber IN (1, 3, 5) THEN 0.7 ELSE 0.2 END END AS m FROM lineitem)""")
def tree(spark, sf_dir):
    """A dumped tree and its calibration, scored as expressions inside generated code."""
    margin = S.tree_scores(TREE, ["l_quantity", "l_discount", "l_linenumber"])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.sigmoid(margin * 1.5 - 0.2), 9).alias("p"))


# -- models -------------------------------------------------------------------------------

CLASSES = 3


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").filter("embedding IS NOT NULL AND label IS NOT NULL")
    return e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"), F.pmod("label", F.lit(CLASSES)).alias("class"))


@query("j11_nearest_classes")
def nearest(spark, sf_dir):
    v = vectors(spark, sf_dir)
    n = v.filter("id % 4 <> 0").count()
    every = max(1, -(-n // S.FIT_ROWS))
    train = v.filter((F.col("id") % 4 != 0) & (F.pmod(F.xxhash64("id"), F.lit(every)) == 0)).orderBy("id").limit(S.FIT_ROWS)
    p = S.nearest_classes(train, v.filter("id % 4 = 0"), 15, CLASSES)
    return p.select("id", F.transform("p", lambda x: F.round(x, 9)).alias("p"))


@query("m11_classifier_race")
def race(spark, sf_dir):
    """Each classifier fitted on a bounded sample (by hash of the id), scored on all held-out
    rows in Arrow batches, compared by log-loss and Brier score."""
    import numpy as np
    import pandas as pd

    v = vectors(spark, sf_dir)
    sample = v.filter("id % 4 <> 0").orderBy(F.xxhash64("id")).limit(2000).toPandas()
    if not len(sample):
        return spark.createDataFrame([], "model string, n long, brier double, log_loss double, accuracy double")
    x, y = np.stack(sample["features"].to_numpy()), sample["class"].to_numpy(int)
    mean, scale = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    z = np.clip((x - mean) / scale, -5, 5)
    fitted = {
        "softmax": S.fit_softmax(z, y, CLASSES), "linear": S.fit_discriminant(z, y, CLASSES, 0.25, pooled=True), "quadratic": S.fit_discriminant(z, y, CLASSES, 0.5), "network": S.fit_network(z, y, CLASSES), "stumps": S.fit_stumps(z, y, CLASSES),
    }

    def scores(name, model, z):
        if name == "softmax":
            return np.hstack([z, np.ones((len(z), 1))]) @ model
        if name in ("linear", "quadratic"):
            return S.discriminant_scores(model, z)
        if name == "network":
            return S.network_scores(model, z)
        return S.stump_values(model, z)

    def run(frames):
        for f in frames:
            if not len(f):
                continue
            z = np.clip((np.stack(f["features"].to_numpy()) - mean) / scale, -5, 5)
            for name, model in fitted.items():
                s = scores(name, model, z)
                p = np.exp(s - s.max(axis=1, keepdims=True))
                yield pd.DataFrame({"model": name, "actual": f["class"], "p": list(p / p.sum(axis=1, keepdims=True))})

    held = v.filter("id % 4 = 0").mapInPandas(run, "model string, actual int, p array<double>")
    squares = F.aggregate(F.transform("p", lambda x, i: F.pow(x - (i == F.col("actual")).cast("double"), 2)), F.lit(0.0), lambda a, x: a + x)
    mine = F.element_at("p", F.col("actual") + 1)
    out = held.groupBy("model").agg(F.count("*").alias("n"), F.avg(squares).alias("brier"), F.avg(-F.log(F.greatest(mine, F.lit(1e-15)))).alias("log_loss"), F.avg((F.array_position("p", F.array_max("p")) - 1 == F.col("actual")).cast("int")).alias("accuracy"))
    return out.select("model", "n", *rounded(out, ["brier", "log_loss", "accuracy"]))


# -- joins, sets, limits --------------------------------------------------------------------


@query("j02_registry_join", "SELECT c_mktsegment, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def registry_join(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("n"))


@query("j03_semi_join", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    return o.join(c, o.o_custkey == c.c_custkey, "left_semi").select("o_orderkey")


@query("j04_missing_and_unknown", """SELECT p_partkey AS k, 'missing' AS side FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)
UNION ALL SELECT DISTINCT l_partkey, 'unknown' FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)""")
def missing(spark, sf_dir):
    p, used = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")).distinct()
    return p.join(used, "k", "left_anti").withColumn("side", F.lit("missing")).unionByName(used.join(p, "k", "left_anti").withColumn("side", F.lit("unknown")))


@query("j08_session_join", BARS + f"""SELECT instrument, bucket, close FROM bars WHERE bucket % {24 * HOUR} >= {8 * HOUR} AND bucket % {24 * HOUR} < {16 * HOUR}""")
def sessions(spark, sf_dir):
    from ..sources.imports import in_sessions

    b = hours(spark, sf_dir).withColumns({"symbol": F.col("instrument"), "time": F.timestamp_seconds(F.expr("bucket div 1000000000L"))})
    days = b.select("symbol", F.date_trunc("day", "time").alias("d")).distinct().select("symbol", (F.col("d") + F.expr("INTERVAL 8 HOURS")).alias("start"), (F.col("d") + F.expr("INTERVAL 16 HOURS")).alias("end"))
    return in_sessions(b, days).select("instrument", "bucket", "close")


@query("t01_newest_ticks", "SELECT event_id AS sequence, epoch_us(ts) * 1000 AS ns, value AS price FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def newest(spark, sf_dir):
    t = B.ticks_from_events(table(spark, sf_dir, "events"))
    return t.orderBy(F.desc("ns"), F.desc("sequence")).limit(1000).orderBy("ns", "sequence").select("sequence", "ns", "price")


@query("t05_top_per_key", "SELECT o_custkey, o_orderkey, k FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def top(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(w).cast("long")).filter("k <= 3").select("o_custkey", "o_orderkey", "k")


@query("u03_set_difference", "SELECT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_suppkey FROM lineitem WHERE l_quantity > 49")
def difference(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), "l_returnflag", "l_quantity")
    return li.filter("l_returnflag = 'R'").select("k").distinct().join(li.filter("l_quantity > 49"), "k", "left_anti")


# -- texts ----------------------------------------------------------------------------------


@query("d13_html_to_text", r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS t FROM a)
SELECT page_id, trim(regexp_replace(t, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text FROM b""")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", texts.html_to_text(F.col("html")).alias("text"))


@query("d14_clean_url")
def clean_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", texts.clean_url(F.col("url")).alias("url"))


@query("d16_title_key", r"SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS title FROM documents")
def title_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", texts.title_key(F.col("text")).alias("title"))


@query("u05_news_dedupe")
def news(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"), F.col("page_id").alias("published"))
    return texts.dedupe_news(p).select("id", "url", "title")


@query("d18_digests", "SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents")
def digests(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))


@query("d05_time_cycles", "SELECT event_id, round(sin(2 * 3.141592653589793 * (hour(ts) + minute(ts) / 60.0) / 24), 6) AS sin_day, round(cos(2 * 3.141592653589793 * (dayofweek(ts) + hour(ts) / 24.0 + minute(ts) / 1440.0) / 7), 6) AS cos_week FROM events")
def cycles(spark, sf_dir):
    t = B.ticks_from_events(table(spark, sf_dir, "events"))
    c = times.cycles(F.col("ms"))
    return t.select(F.col("sequence").alias("event_id"), F.round(c[0], 6).alias("sin_day"), F.round(c[3], 6).alias("cos_week"))


@query("d03_rfc3339", "SELECT event_id, epoch_us(ts) * 1000 AS ns, CAST(6 AS INTEGER) AS digits FROM events")
def rfc3339(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("t"))
    ns, digits = times.rfc3339_ns(F.concat("t", F.lit("Z")))
    return e.select("event_id", ns.alias("ns"), digits.alias("digits"))


@query("d04_local_to_utc", "SELECT o_orderkey, o_orderdate + INTERVAL 12 HOURS AS utc FROM orders")
def local_utc(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    utc = times.local_to_utc((F.col("o_orderdate") + F.expr("INTERVAL 12 HOURS")).cast("timestamp"), "UTC")
    return o.select("o_orderkey", utc.cast("timestamp_ntz").alias("utc"))


# -- streams ----------------------------------------------------------------------------------


@query("r01_stream_ohlc", f"""WITH t AS (SELECT event_type AS instrument, epoch_us(ts) * 1000 AS ns, event_id AS sequence, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume FROM events)
SELECT instrument, ns - ns % {HOUR} AS bucket, arg_min(price, struct_pack(a := ns, b := sequence)) AS open, max(price) AS high, min(price) AS low, arg_max(price, struct_pack(a := ns, b := sequence)) AS close, sum(volume) AS volume, count(*) AS trades
FROM t GROUP BY 1, 2 HAVING bucket + {HOUR} <= (SELECT max(ns) // 1000000 * 1000000 FROM t)""")
def stream_bars(spark, sf_dir):
    """Events as a file stream, bars as they close: the same rows as the batch query. All
    files are one trigger, so no tick is late, however times are dealt to files."""
    s = L.stream_table(spark, sf_dir, "events", L.TICKS, files=None)
    s = s.select(F.col("event_type").alias("instrument"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("sequence"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("volume"))
    return L.run_to_table(L.stream_ohlc(s, 60), shared_folder(spark))


@query("r05_ordered_trades", """WITH t AS (SELECT event_type AS instrument, event_id AS sequence, event_id * 7919 % 1000003 AS trade_id, epoch_us(ts) * 1000 AS ns FROM events),
m AS (SELECT *, max(trade_id) OVER w AS i, max(ns) OVER w AS n FROM t WINDOW w AS (PARTITION BY instrument ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT instrument, sequence, trade_id, ns FROM m WHERE i IS NULL OR (trade_id > i AND ns >= n)""")
def ordered(spark, sf_dir):
    t = B.ticks_from_events(table(spark, sf_dir, "events")).withColumn("trade_id", F.col("sequence") * 7919 % 1000003)
    return L.ordered_trades(t).select("instrument", "sequence", "trade_id", "ns")


@query("r08_book_replay")
def books(spark, sf_dir):
    """Events as depth updates, a session for each type and day."""
    t = B.ticks_from_events(table(spark, sf_dir, "events"))
    first = F.row_number().over(Window.partitionBy("instrument", "date").orderBy("sequence")) == 1
    m = t.select(F.date_format("date", "yyyy-MM-dd").alias("session"), F.col("instrument").alias("symbol"), "sequence", F.when(first, "snapshot").otherwise("update").alias("kind"),
                 F.when(F.col("sequence") % 2 == 0, "bid").otherwise("ask").alias("side"), F.when(F.col("sequence") % 2 == 0, (F.col("price") % 50 + 1).cast("decimal(18,2)").cast("string")).otherwise((F.col("price") % 50 + 52).cast("decimal(18,2)").cast("string")).alias("price"), F.col("volume").cast("decimal(18,3)").cast("string").alias("quantity"))
    return L.replay_books(m)


@query("r10_latency", "WITH m AS (SELECT event_type AS k, CAST(event_id * 7919 % 150000 - 2000 AS DOUBLE) AS x FROM events) SELECT k, count(*) AS n, count(*) FILTER (WHERE x < 0) AS skewed, count(*) FILTER (WHERE abs(x) > 120000) AS invalid, " + ", ".join(f"round(quantile_cont(x, {p}) FILTER (WHERE x BETWEEN 0 AND 120000), 6) AS p{int(p * 100)}" for p in (0.5, 0.95, 0.99)) + " FROM m GROUP BY 1")
def latency(spark, sf_dir):
    m = table(spark, sf_dir, "events").select(F.col("event_type").alias("k"), (F.col("event_id") * 7919 % 150000 - 2000).cast("double").alias("latency_ms"))
    s = L.latency_summary(m, "k")
    return s.select("k", "n", "skewed", "invalid", *rounded(s, ["p50", "p95", "p99"]))


FOLLOWED = BARS + f""", s AS (SELECT instrument || '-' || bucket AS id, instrument AS symbol, bucket + {HOUR} AS a, bucket + {5 * HOUR} AS z, close * 0.9 AS stop, close * 1.1 AS target FROM bars),
q AS (SELECT instrument, ns, sequence, price FROM ticks), h AS (SELECT s.id, q.ns, q.sequence, q.price, CASE WHEN q.price <= s.stop THEN 'stop' WHEN q.price >= s.target THEN 'target' END AS t FROM s JOIN q ON q.instrument = s.symbol AND q.ns >= s.a AND q.ns < s.z),
f AS (SELECT id, arg_min(t, struct_pack(a := ns, b := sequence)) AS t, arg_min(price, struct_pack(a := ns, b := sequence)) AS price, min(ns) AS ns FROM h WHERE t IS NOT NULL GROUP BY 1)
"""


@query("r13_followed_signals", FOLLOWED + "SELECT s.id, coalesce(f.t, CASE WHEN n.m >= s.z THEN 'expired' ELSE 'watching' END) AS status, coalesce(f.ns, CASE WHEN f.t IS NULL AND n.m >= s.z THEN s.z END) AS at_ns, f.price FROM s LEFT JOIN f USING (id) JOIN (SELECT instrument, max(ns) AS m FROM q GROUP BY 1) n ON n.instrument = s.symbol")
def followed(spark, sf_dir):
    """Every bar's close as a signal, followed for four hours from the bar's end; those of a
    symbol overlap."""
    b = hours(spark, sf_dir)
    s = b.select(F.concat_ws("-", "instrument", "bucket").alias("id"), F.col("instrument").alias("symbol"), (F.col("bucket") + HOUR).alias("reference_ns"), (F.col("bucket") + 5 * HOUR).alias("horizon_ns"), F.lit("BUY").alias("side"), (F.col("close") * 0.9).alias("stop"), (F.col("close") * 1.1).alias("target"))
    return L.follow_signals(s, ticks(spark, sf_dir).filter(B.valid_tick()).withColumnRenamed("instrument", "symbol"))


@query("a07_follow_status_counts", FOLLOWED + "SELECT coalesce(f.t, CASE WHEN n.m >= s.z THEN 'expired' ELSE 'watching' END) AS status, count(*) AS n FROM s LEFT JOIN f USING (id) JOIN (SELECT instrument, max(ns) AS m FROM q GROUP BY 1) n ON n.instrument = s.symbol GROUP BY 1")
def follow_counts(spark, sf_dir):
    return followed(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query("r15_signal_changes", BARS + """, m AS (SELECT *, avg(close) OVER (PARTITION BY instrument ORDER BY bucket ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS a FROM bars), s AS (SELECT instrument, bucket, 'mean-20|' || CASE WHEN close > a THEN 'BUY' ELSE 'SELL' END AS signature FROM m),
l AS (SELECT *, lag(signature) OVER (PARTITION BY instrument ORDER BY bucket) AS before FROM s) SELECT instrument, bucket, signature FROM l WHERE before IS NULL OR before <> signature""")
def changes(spark, sf_dir):
    b = hours(spark, sf_dir).withColumn("a", F.expr(G.frames("avg(close) {20}")))
    d = b.select("instrument", "bucket", F.lit("mean-20").alias("rule"), F.when(F.col("close") > F.col("a"), "BUY").otherwise("SELL").alias("side"))
    return L.signal_changes(d).select("instrument", "bucket", "signature")


@query("q13_last_run", STEPS + """, i AS (SELECT *, sum(CASE WHEN step_ok THEN 0 ELSE 1 END) OVER (PARTITION BY instrument ORDER BY bucket) AS g FROM bars), r AS (SELECT *, row_number() OVER (PARTITION BY instrument, g ORDER BY bucket) AS run FROM i)
SELECT instrument, CAST(arg_max(run, bucket) AS INTEGER) AS run, max(bucket) AS bucket FROM r GROUP BY 1""")
def last_run(spark, sf_dir):
    return L.last_run(hours(spark, sf_dir), 60)


@query("r20_market_health", """WITH q AS (SELECT event_type AS symbol, epoch_us(ts) * 1000 AS ns, value AS price, value * 0.999 AS bid, value * 1.001 AS ask, user_id % 3 AS u FROM events), n AS (SELECT max(ns) AS now FROM q),
l AS (SELECT symbol, arg_max(struct_pack(ns := ns, bid := bid, ask := ask, u := u), ns) AS r FROM q GROUP BY 1)
SELECT symbol, CASE WHEN (now - r.ns) / 1e9 >= CASE WHEN r.u > 0 THEN 30 ELSE 120 END THEN 'stale' WHEN r.u > 0 THEN 'live' ELSE 'snapshot' END AS state, round((now - r.ns) / 1e9, 6) AS age_s, round(10000 * (r.ask - r.bid) / ((r.bid + r.ask) / 2), 6) AS spread_bps FROM l, n""")
def health(spark, sf_dir):
    q = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") * 1000).alias("ns"), (F.col("value") * 0.999).alias("bid"), (F.col("value") * 1.001).alias("ask"), F.when(F.col("user_id") % 3 > 0, "websocket").otherwise("rest").alias("transport"))
    newest = q.groupBy("symbol").agg(F.max_by(F.struct("ns", "bid", "ask", "transport"), "ns").alias("r")).select("symbol", "r.*")
    now = newest.agg(F.max("ns")).first()[0] or 0
    h = L.market_health(newest, F.lit(now))
    return h.select("symbol", "state", *rounded(h, ["age_s", "spread_bps"]))
