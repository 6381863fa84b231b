"""Queries of selection in time, of the model search and of its statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import boosting as X
from ..operators import decisions as D
from ..operators import features as V
from ..operators import resample as H
from ..operators import rules as K
from ..operators import selection as Z
from ..operators import trades as T
from ..operators import triggers as R
from ..sources.tables import written
from .queries import BARS, HOUR, TRADES, bracket_trades, directions, hours, market_vectors, query, rounded

#: (instrument, at, direction): the coarser direction by the time it is known.
DIRECTIONS = f"""h4 AS (SELECT instrument, bucket - bucket % {4 * HOUR} AS start, arg_max(close, bucket) AS close FROM bars b GROUP BY instrument, b.bucket - b.bucket % {4 * HOUR} HAVING count(*) = 4),
l4 AS (SELECT *, list(close) OVER (PARTITION BY instrument ORDER BY start ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS x FROM h4),
e4 AS (SELECT *, list_reduce(x, lambda v, c: v + (c - v) * 0.2) AS fast, list_reduce(x, lambda v, c: v + (c - v) * {2 / 22!r}) AS slow, list_reduce(x[:len(x) - 1], lambda v, c: v + (c - v) * 0.2) AS before FROM l4 WHERE len(x) >= 21),
d4 AS (SELECT instrument, start + {4 * HOUR} AS at, CASE WHEN fast > slow AND fast > before THEN 1 WHEN fast < slow AND fast < before THEN -1 ELSE 0 END AS higher FROM e4)
"""


def settled(spark, sf_dir: str) -> DataFrame:
    """Bracket trades with ``y`` and whether the four-hour direction agrees (``aligned``)."""
    b = written(hours(spark, sf_dir), "bars")
    t = V.with_direction(bracket_trades(spark, sf_dir), directions(b), 60)
    higher = F.when(F.col("direction") == "UP", 1).when(F.col("direction") == "DOWN", -1).otherwise(0)
    return t.withColumn("aligned", ~Z.opposed(F.col("way"), higher))


THIRDS = f""", a AS (SELECT t.*, CASE WHEN rule = 'long' THEN 1 ELSE -1 END * coalesce(d.higher, 0) >= 0 AS aligned FROM trades t ASOF LEFT JOIN d4 d ON d.instrument = t.instrument AND t.entry_ns >= d.at),
s AS (SELECT min(entry_ns) AS low, max(entry_ns) - min(entry_ns) AS span FROM trades),
w AS (SELECT CAST(k AS INTEGER) AS "window", low + k * (span // 3) AS start_ns, low + (k + 1) * (span // 3) AS end_ns FROM s, generate_series(0, 2) g(k)),
t AS (SELECT a.*, w."window" FROM a JOIN w ON entry_ns >= start_ns AND entry_ns < end_ns AND label_end_ns < end_ns WHERE aligned AND status <> 'censored'),
"""
#: Of rows ``t`` with ``g`` (the key) the chain of trades, one at a time.
CHAIN = """n AS (SELECT t.*, u.entry_ns AS next_entry FROM t ASOF LEFT JOIN t u ON t.g = u.g AND t.label_end_ns < u.entry_ns),
picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY entry_ns) AS k FROM n) WHERE k = 1
 UNION ALL SELECT n.*, p.k + 1 FROM picked p JOIN n ON n.g = p.g AND n.entry_ns = p.next_entry)
"""
RECURSIVE = TRADES.replace("WITH ", "WITH RECURSIVE ", 1)


@query("q02_window_trades", RECURSIVE + ", " + DIRECTIONS + THIRDS.replace("SELECT a.*, w.", "SELECT a.*, concat_ws('|', a.instrument, rule, cost, w.\"window\") AS g, w.") + CHAIN + 'SELECT instrument, rule, cost, "window" AS fold, entry_ns, label_end_ns FROM picked')
def window_trades(spark, sf_dir):
    """Trades along the coarser direction, one at a time inside each third of the time."""
    t = written(settled(spark, sf_dir), "settled")
    low, high = t.agg(F.min("entry_ns"), F.max("entry_ns")).first()
    third = ((high or 0) - (low or 0)) // 3
    windows = spark.createDataFrame([(k, (low or 0) + k * third, (low or 0) + (k + 1) * third) for k in range(3)], "window int, start_ns long, end_ns long")
    return Z.window_trades(t, windows, ["instrument", "rule", "cost"], "aligned").select("instrument", "rule", "cost", F.col("window").alias("fold"), "entry_ns", "label_end_ns")


@query("q05_selection_split", RECURSIVE + f""", o AS (SELECT list_sort(list(DISTINCT entry_ns)) AS l FROM trades WHERE label_end_ns IS NOT NULL), b AS (SELECT l[len(l) * 3 // 4 + 1] AS cut FROM o),
t AS (SELECT trades.*, concat_ws('|', instrument, rule, cost) AS g FROM trades, b WHERE label_end_ns IS NOT NULL AND entry_ns >= cut + {16 * HOUR}),
{CHAIN}, z AS (SELECT 'fit' AS part, rule, cost, entry_ns, label_end_ns FROM trades, b WHERE label_end_ns < cut UNION ALL SELECT 'validation', rule, cost, entry_ns, label_end_ns FROM picked)
SELECT part, rule, cost, count(*) AS n, min(entry_ns) AS first_ns, max(label_end_ns) AS last_ns FROM z GROUP BY 1, 2, 3""")
def selection_split(spark, sf_dir):
    t = written(bracket_trades(spark, sf_dir).filter("label_end_ns IS NOT NULL"), "settled")
    fit, validation, _ = Z.selection_split(t, 16 * HOUR, ["instrument", "rule", "cost"])
    both = fit.withColumn("part", F.lit("fit")).unionByName(validation.withColumn("part", F.lit("validation")))
    return both.groupBy("part", "rule", "cost").agg(F.count("*").alias("n"), F.min("entry_ns").alias("first_ns"), F.max("label_end_ns").alias("last_ns"))


@query("q07_research_folds", RECURSIVE + """, k AS (SELECT instrument, bucket, row_number() OVER (PARTITION BY instrument ORDER BY bucket) - 1 AS k, count(*) OVER (PARTITION BY instrument) AS n FROM bars),
w AS (SELECT instrument, CAST(i AS INTEGER) AS fold, max(bucket) FILTER (WHERE k = floor(n * (0.5 + i / 6))) AS start_ns, max(bucket) FILTER (WHERE k = floor(n * (0.5 + (i + 1) / 6)) - 1) AS end_ns FROM k, generate_series(0, 2) g(i) WHERE n >= 240 GROUP BY 1, 2),
p AS (SELECT t.*, w.fold, CASE WHEN label_end_ns < start_ns THEN 'train' WHEN entry_ns >= start_ns AND label_end_ns <= end_ns THEN 'test' END AS part FROM trades t JOIN w USING (instrument) WHERE net_r IS NOT NULL AND label_end_ns IS NOT NULL),
t AS (SELECT *, concat_ws('|', instrument, rule, cost, fold, part) AS g FROM p WHERE part IS NOT NULL),
""" + CHAIN + """, m AS (SELECT instrument, fold, rule, cost, count(*) FILTER (WHERE part = 'train') AS train_n, count(*) FILTER (WHERE part = 'test') AS test_n, avg(net_r) FILTER (WHERE part = 'train') AS train_mean, avg(net_r) FILTER (WHERE part = 'test') AS test_mean FROM picked GROUP BY 1, 2, 3, 4),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY instrument, fold ORDER BY train_mean DESC, rule, cost) AS INTEGER) AS place, train_n >= 20 AND train_mean > 0 AS eligible FROM m WHERE train_n > 0)
SELECT instrument, fold, rule, cost, place, train_n, test_n, round(train_mean, 6) AS train_mean, round(test_mean, 6) AS test_mean, eligible, coalesce(place = min(place) FILTER (WHERE eligible) OVER (PARTITION BY instrument, fold), false) AS selected FROM r WHERE place <= 5""")
def research_folds(spark, sf_dir):
    """Strategies frozen by what ended before a fold, measured in the fold."""
    r = Z.research_walk_forward(written(bracket_trades(spark, sf_dir), "trades"), hours(spark, sf_dir), ["rule", "cost"])
    return r.select("instrument", "fold", "rule", "cost", "place", "train_n", "test_n", F.round("train_mean", 6).alias("train_mean"), F.round("test_mean", 6).alias("test_mean"), "eligible", "selected")


# -- the model search -----------------------------------------------------------------------

#: The search of the registered query: the penalties and shapes of ``VARIANTS`` with fewer trees.
QUERY_VARIANTS = (X.Logistic("logistic-c01", 0.1), X.Logistic("logistic-c1", 1.0), X.Boosted("boosted-shallow", 8, 3, 7, 40), X.Boosted("boosted-medium", 10, 4, 15, 80))


def examples_of_bars(spark, sf_dir: str) -> DataFrame:
    """Bracket trades at cost 1 with the 19 features of their bar, side and net reward to risk."""
    v = written(market_vectors(spark, sf_dir), "vectors")
    t = bracket_trades(spark, sf_dir, (1.0,)).filter("label_end_ns IS NOT NULL")
    rows = t.join(v, ["instrument", "bucket"])
    return rows.select("instrument", "rule", "cost", "entry_ns", "label_end_ns", "y", F.array(*[F.col(n) for n in V.MARKET], F.col("way").cast("double"), "net_rr").alias("features"))


@query("m21_model_search")
def model_search(spark, sf_dir):
    out = X.model_search(written(examples_of_bars(spark, sf_dir), "examples"), 16 * HOUR, ["instrument", "rule", "cost"], QUERY_VARIANTS)
    return out.select("stage", "name", "n", *rounded(out, ["brier", "baseline", "a", "b"]))


# -- intervals and the class model ----------------------------------------------------------


@query("m04_core_interval")
def core_interval(spark, sf_dir):
    """95 % intervals of the mean net R of trades taken one at a time."""
    t = Z.non_overlapping(bracket_trades(spark, sf_dir), ["instrument", "rule", "cost"])
    out = H.core_interval(t, ["instrument", "rule", "cost"])
    return out.select("instrument", "rule", "cost", "n", *rounded(out, ["mean", "low", "high"]))


def class_samples(spark, sf_dir: str) -> DataFrame:
    """Each bar's 19 features and the class of the next four hours against the ATR and the cost."""
    b = written(hours(spark, sf_dir), "bars")
    v = written(V.market_features(K.context(b, 60), b, directions(b), 60), "vectors")
    rows = D.numbered(b).join(v, ["instrument", "bucket"])
    rows = rows.withColumn("features", F.array(*[F.col(n) for n in V.MARKET])).select("instrument", "bucket", "bar", "bars", "features", F.col(V.MARKET[7]).alias("atr_share"))
    labelled = T.class_label(b.join(rows.select("instrument", "bucket", "atr_share"), ["instrument", "bucket"], "left"), 60, D.neutral_band(F.col("atr_share"), F.col("close")), D.HORIZON)
    return rows.drop("atr_share").join(labelled.select("instrument", "bucket", "class"), ["instrument", "bucket"])


@query("m19_model_choice")
def model_choice(spark, sf_dir):
    out = D.class_models(written(class_samples(spark, sf_dir), "samples"))
    names = ["temperature", "brier", "log_loss", "adjusted_brier", "test_brier", "test_log_loss", "test_accuracy"]
    return out.select("instrument", "place", "algorithm", "setting", "n", "selected", "test_n", F.transform("bias", lambda b: F.round(b, 6)).alias("bias"), *rounded(out, names))


@query("k02_setup_triggers")
def setup_triggers(spark, sf_dir):
    """Of each instrument's every bar and rule: the next close at which its crossing happens."""
    b = written(hours(spark, sf_dir), "bars")
    out = R.setup_triggers(b, 60, K.context(b, 60))
    return out.select("instrument", "bucket", "rule", "side", "mode", *rounded(out, ["price", "reference"]))
