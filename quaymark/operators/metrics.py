"""Aggregates over labelled trades, probabilities and accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

Z95 = 1.96


def outcome_counts(trades: DataFrame, *keys: str) -> DataFrame:
    """Counts by status, ambiguous ones, signs, and the mean of what is valid."""
    done = F.col("status") != "censored"
    return trades.groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.count_if(F.col("status") == s).alias(s) for s in ("target", "stop", "expired", "censored")],
        F.count_if(F.col("ambiguous")).alias("ambiguous"), F.count_if(done & (F.col("net_r") > 0)).alias("positive"), F.count_if(done & (F.col("net_r") < 0)).alias("negative"),
        F.avg(F.when(done, F.col("net_r"))).alias("mean_r"),
    )


def wilson(wins: Column, n: Column) -> tuple[Column, Column]:
    """95 % Wilson interval of a share."""
    p, zz = wins / n, Z95 * Z95
    middle, half = (p + zz / (2 * n)) / (1 + zz / n), Z95 * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return middle - half, middle + half


def trade_metrics(trades: DataFrame, *keys: str, order: tuple[str, ...] = ("entry_ns",)) -> DataFrame:
    """n, wins, win rate with its interval, expectancy, total, profit factor (null without
    losses), and the largest drawdown along the path of cumulative results."""
    done = trades.filter("net_r IS NOT NULL")
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    path = done.withColumn("__sum", F.sum("net_r").over(w))
    path = path.withColumn("__top", F.greatest(F.max("__sum").over(w), F.lit(0.0)))
    out = path.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("net_r") > 0).alias("wins"), F.avg("net_r").alias("expectancy"), F.sum("net_r").alias("total_r"),
        F.sum(F.greatest("net_r", F.lit(0.0))).alias("__gain"), F.sum(F.greatest(-F.col("net_r"), F.lit(0.0))).alias("__loss"), F.max(F.col("__top") - F.col("__sum")).alias("drawdown"),
    )
    low, high = wilson(F.col("wins"), F.col("n"))
    return out.withColumns({
        "win_rate": 100 * F.col("wins") / F.col("n"), "low": 100 * low, "high": 100 * high,
        "profit_factor": F.when(F.col("__loss") > 0, F.col("__gain") / F.col("__loss")),
    }).drop("__gain", "__loss")


def losing_streak(trades: DataFrame, *keys: str, order: str = "entry_ns") -> DataFrame:
    """Longest run of losses: gaps and islands."""
    w = Window.partitionBy(*keys).orderBy(order)
    loss = F.when(F.col("net_r") < 0, 1).otherwise(0)
    islands = trades.filter("net_r IS NOT NULL").withColumn("__loss", loss).withColumn("__island", F.sum(1 - F.col("__loss")).over(w))
    runs = islands.groupBy(*keys, "__island").agg(F.sum("__loss").alias("run"))
    return runs.groupBy(*keys).agg(F.max("run").alias("longest_losing_streak"))


def reliability(rows: DataFrame, probability: str = "probability", outcome: str = "y", bins: int = 10) -> DataFrame:
    """Equal bins of probability; 1.0 falls into the last one, empty bins stay."""
    spark = rows.sparkSession
    k = F.least(F.lit(bins - 1), F.floor(F.col(probability) * bins)).cast("int")
    found = rows.groupBy(k.alias("bin")).agg(F.count("*").alias("n"), F.avg(outcome).alias("rate"), F.avg(probability).alias("mean_probability"))
    return spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(found, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def expected_calibration_error(rows: DataFrame, probability: str = "probability", outcome: str = "y", bins: int = 10) -> DataFrame:
    r = reliability(rows, probability, outcome, bins).filter("n > 0")
    return r.agg((F.sum(F.col("n") * F.abs(F.col("rate") - F.col("mean_probability"))) / F.sum("n")).alias("ece"))


def brier(rows: DataFrame, probability: str = "probability", outcome: str = "y", *keys: str) -> DataFrame:
    """Brier score, that of the base rate, skill, log-loss (clipped) and accuracy."""
    p, y = F.col(probability), F.col(outcome)
    clipped = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), p))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(y).alias("rate"),
        F.avg(-(y * F.log(clipped) + (1 - y) * F.log(1 - clipped))).alias("log_loss"), F.avg(((p >= 0.5).cast("int") == y).cast("int")).alias("accuracy"),
    )
    base = F.col("rate") * (1 - F.col("rate"))
    return out.withColumns({"baseline": base, "skill": F.when(base > 0, 1 - F.col("brier") / base)})


def class_diagnostics(rows: DataFrame, probabilities: str = "p", actual: str = "actual") -> DataFrame:
    """Multi-class Brier, log-loss and accuracy (the first largest class is predicted);
    ``p`` is an array, ``actual`` an index from 0."""
    p, k = F.col(probabilities), F.col(actual)
    squares = F.aggregate(F.transform(p, lambda x, i: (x - (i == k).cast("double")) * (x - (i == k).cast("double"))), F.lit(0.0), lambda a, x: a + x)
    mine = F.greatest(F.lit(1e-15), F.element_at(p, k.cast("int") + 1))
    first = F.array_position(p, F.array_max(p)) - 1
    return rows.agg(F.count("*").alias("n"), F.avg(squares).alias("brier"), F.avg(-F.log(mine)).alias("log_loss"), F.avg((first == k).cast("int")).alias("accuracy"))


def _places(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, value, c, end): each distinct value, how often it occurs and how many rows of its
    key it ends, nulls first. Values are counted, cut into ranges and numbered range by range, so
    that no task holds a key."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named: a range stays a task
    counted = rows.groupBy(*keys, value).agg(F.count("*").alias("c")).repartitionByRange(tasks, *keys, value)
    counted = written(counted.withColumn("__part", F.spark_partition_id()), "counted")
    by = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = counted.groupBy(*keys, "__part").agg(F.sum("c").alias("s")).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__part").alias("__p"), F.coalesce(F.sum("s").over(by), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*keys, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("__part") == F.col("__p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return counted.withColumn("end", F.sum("c").over(within)).join(F.broadcast(before), same).select(*keys, value, "c", (F.col("end") + F.col("__before")).alias("end"))


def segments(rows: DataFrame, order: str, parts: int = 3, value: str = "probability", outcome: str = "y") -> DataFrame:
    """Chronological parts cut at floor(n * i / parts), not ntile; per part n, hits above
    0.6 and their rate. Only rows that share the value at a cut are numbered."""
    n = rows.count()
    wanted = [n * i // parts for i in range(1, parts)] if n else []
    holds = F.lit(False)
    for c in wanted:
        holds = holds | ((F.col("end") > c) & (F.col("end") - F.col("c") <= c))
    found = _places(rows, order, []).filter(holds).collect() if wanted else []  # a row a cut at most
    o, part, cuts = F.col(order), F.lit(0), [next(r for r in found if r["end"] - r["c"] <= c < r["end"]) for c in wanted]
    tied = F.lit(False)
    for r in {(r[order], r["c"]): r for r in cuts if r["c"] > 1}.values():
        tied = tied | o.eqNullSafe(F.lit(r[order]))
    if any(r["c"] > 1 for r in cuts):
        numbered = rows.filter(tied).withColumn("__r", F.row_number().over(Window.partitionBy(order).orderBy(order)) - 1)
        rows = rows.filter(~tied).withColumn("__r", F.lit(0)).unionByName(numbered)
    for c, r in zip(wanted, cuts, strict=True):
        after = o.isNotNull() if r[order] is None else F.coalesce(o > F.lit(r[order]), F.lit(False))
        at = o.eqNullSafe(F.lit(r[order])) & (F.col("__r") >= c - (r["end"] - r["c"]) if r["c"] > 1 else F.lit(c <= r["end"] - r["c"]))
        part = part + (after | at).cast("int")
    return rows.groupBy(part.alias("segment")).agg(
        F.count("*").alias("n"), F.count_if(F.col(value) > 0.6).alias("selected"), F.avg(F.when(F.col(value) > 0.6, F.col(outcome))).alias("hit_rate"), F.avg(outcome).alias("rate")
    )


def quantiles(rows: DataFrame, value: str, shares: tuple[float, ...] = (0.05, 0.5, 0.95), *keys: str) -> DataFrame:
    """Linear, lower (floor((n-1)p)) and nearest-rank (ceil(pn)-1) quantiles, exact at any
    size: values are taken from the places of the distinct ones."""
    counts = rows.groupBy(*keys).agg(F.count(value).alias("n"))
    places = _places(rows.filter(F.col(value).isNotNull()), value, list(keys))
    joined = places.join(F.broadcast(counts), list(keys)) if keys else places.crossJoin(F.broadcast(counts))  # one row, or one a key
    at = lambda place: F.max(F.when((F.col("end") - F.col("c") <= place) & (place < F.col("end")), F.col(value)))
    pick = []
    for p in shares:
        k, place = int(p * 100), (F.col("n") - 1) * p
        pick += [at(F.floor(place)).alias(f"lower_{k}"), at(F.ceil(place)).alias(f"__upper_{k}"), at(F.greatest(F.ceil(F.col("n") * p) - 1, F.lit(0))).alias(f"nearest_{k}")]
    picked = joined.groupBy(*keys).agg(*pick)
    out = counts.join(picked, list(keys)) if keys else counts.crossJoin(F.broadcast(picked))
    linear = []
    for p in shares:
        k, place = int(p * 100), (F.col("n") - 1) * p
        low, high = F.col(f"lower_{k}"), F.col(f"__upper_{k}")
        linear.append(F.when(low == high, low.cast("double")).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high).alias(f"linear_{k}"))
    return out.select(*keys, "n", *linear, *[F.col(f"{kind}_{int(p * 100)}") for p in shares for kind in ("lower", "nearest")])


def holm(rows: DataFrame, p: str = "p", *keys: str) -> DataFrame:
    """Holm's adjustment: the running maximum of p * (m - rank + 1), at most 1."""
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    order = by.orderBy(p)
    raw = F.col(p) * (F.count("*").over(by) - F.row_number().over(order) + 1)
    return rows.withColumn("__raw", raw).withColumn("p_holm", F.least(F.lit(1.0), F.max("__raw").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))).drop("__raw")


def equity(positions: DataFrame, zone: str = "Europe/Paris") -> DataFrame:
    """Per account: realized and floating result, open risk, distinct trading days, and the
    change since the first equity of each local day."""
    day = F.to_date(F.from_utc_timestamp("at", zone))
    return positions.withColumn("day", day).groupBy("account").agg(
        F.sum(F.when(F.col("closed"), F.col("pnl")).otherwise(0.0)).alias("realized"), F.sum(F.when(~F.col("closed"), F.col("pnl")).otherwise(0.0)).alias("floating"),
        F.sum(F.when(~F.col("closed"), F.col("risk")).otherwise(0.0)).alias("open_risk"), F.count_distinct("day").alias("trading_days"),
    )


def publication_gate(rows: DataFrame, *keys: str) -> DataFrame:
    """Per key: counts, Brier against the base rate, and the reasons not to publish."""
    b = brier(rows, "probability", "y", *keys)
    tests = [("too-few", F.col("n") < 200), ("few-positives", F.col("n") * F.col("rate") < 40), ("few-negatives", F.col("n") * (1 - F.col("rate")) < 40), ("no-skill", ~(F.col("brier") < F.col("baseline"))), ("degenerate", F.col("baseline") <= 0)]
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(True)), F.lit(name)) for name, t in tests]))
    return b.withColumn("reasons", F.array_join(reasons, ",")).withColumn("published", F.col("reasons") == "")


def confident(p: Column) -> Column:
    """The gate compares the percentage shown: one decimal, rounded half up, above 60."""
    return F.floor(p * 1000 + 0.5) > 600
