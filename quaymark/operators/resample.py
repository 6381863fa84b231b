"""Resampling by a seeded congruential sequence, without a loop over its draws.

A draw is a function of its place: ``m`` steps of ``x -> A x + C (mod 2**32)`` are one such
step with other numbers, made of a leap for each digit of ``m``. So every
draw of every repetition is a column of its place, repetitions are rows, and the statistics
are aggregates over them; the results are those of drawing one by one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

#: The sequence (fixed values).
MULTIPLIER, INCREMENT, MODULUS = 1664525, 1013904223, 1 << 32


def leaps(bits: int = 6, levels: int = 7) -> list[list[tuple[int, int]]]:
    """By level, multiplier and increment of ``d * 2**(bits * level)`` steps at once for every
    digit ``d`` below ``2**bits``."""
    then = lambda f, g: (f[0] * g[0] % MODULUS, (g[0] * f[1] + g[1]) % MODULUS)
    out, one = [], (MULTIPLIER, INCREMENT)
    for _ in range(levels):
        row = [(1, 0)]
        for _ in range(1 << bits):
            row.append(then(row[-1], one))
        one = row.pop()
        out.append(row)
    return out


def draw(seed: int, place: Column) -> Column:
    """The ``place``-th number (from 1; below 2**42) of the sequence, in [0, 1): a look-up and a
    step for each digit of the place, a batch of places at a time. (The same look-ups as array
    expressions build their tables anew for every row and take a hundred times as long.)"""
    table = np.array(leaps(), np.uint64)

    @F.pandas_udf("double")
    def drawn(places: pd.Series) -> pd.Series:
        at, x = places.to_numpy(np.int64), np.full(len(places), seed % MODULUS, np.uint64)
        for level, row in enumerate(table):
            a, c = row[(at >> 6 * level) & 63].T
            x = (a * x + c) & np.uint64(MODULUS - 1)
        return pd.Series(x / MODULUS)

    return drawn(place.cast("long"))


def _numbered(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(k, i, n, x): finite values in order within their key."""
    w = Window.partitionBy("k")
    fine = rows.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf"))).select(F.struct(*keys).alias("k"), F.col(value).cast("double").alias("x"), F.col(order).alias("o"))
    return written(fine.select("k", "x", (F.row_number().over(w.orderBy("o", "x")) - 1).cast("long").alias("i"), F.count("*").over(w).alias("n")), "sample")


def _intervals(means: DataFrame, sample: DataFrame, low: Column, high: Column) -> DataFrame:
    """Per key the values at two ranks (from 0) of the repetitions' sorted means."""
    ends = means.groupBy("k").agg(F.array_sort(F.collect_list("mean")).alias("m")).select("k", F.element_at("m", low + 1).alias("low"), F.element_at("m", high + 1).alias("high"))
    every = sample.groupBy("k").agg(F.count("*").alias("n"), F.avg("x").alias("mean"))
    return every.join(ends, "k", "left").select("k.*", "n", "mean", "low", "high")


def core_interval(rows: DataFrame, keys: list[str], value: str = "net_r", order: str = "entry_ns", reps: int = 1000, block: float = 3.0, seed: int = 20261014) -> DataFrame:
    """95 % interval of the mean by stationary blocks of mean length ``block``. Each repetition
    draws a place for every position, then a number for every position; a position starts a
    block at its own place if that number is at most 1 / ``block``, else it follows its
    predecessor. Ranks are floor((reps - 1) p); fewer than two values have no interval."""
    sample = _numbered(rows, keys, value, order)
    drawn = sample.filter("n >= 2").withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"))))
    begin = F.col("rep") * 2 * F.col("n")
    place = F.floor(draw(seed, begin + F.col("i") + 1) * F.col("n"))
    starts = (F.col("i") == 0) | (draw(seed, begin + F.col("n") + F.col("i") + 1) <= 1 / block)
    w = Window.partitionBy("k", "rep").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    drawn = drawn.select("k", "rep", "i", "n", F.when(starts, F.struct("i", place.alias("place"))).alias("s")).withColumn("s", F.last("s", ignorenulls=True).over(w))
    at = drawn.select("k", "rep", ((F.col("s.place") + F.col("i") - F.col("s.i")) % F.col("n")).alias("i"))
    means = at.join(sample.select("k", "i", "x").hint("merge"), ["k", "i"]).groupBy("k", "rep").agg(F.avg("x").alias("mean"))
    return _intervals(means, sample, *[F.floor(F.lit((reps - 1) * p)).cast("int") for p in (0.025, 0.975)])


def moving_blocks(rows: DataFrame, keys: list[str], value: str = "net_r", order: str = "entry_ns", reps: int = 400, block: int = 3, seed: int = 20261013, least: int = 20) -> DataFrame:
    """95 % interval of the mean by circular blocks of ``block`` values: a repetition draws one
    start a block. Ranks are floor(.025 reps) and ceil(.975 reps) - 1; fewer than ``least``
    values have no interval."""
    sample = _numbered(rows, keys, value, order)
    size = F.least(F.lit(block).cast("long"), F.col("n"))
    long = sample.filter(F.col("n") >= least)
    # every place with the values of the block that starts there
    starts = long.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), size - 1))).groupBy("k", F.pmod(F.col("i") - F.col("j"), F.col("n")).alias("i")).agg(F.array_sort(F.collect_list(F.struct("j", "x"))).alias("values"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named: the repetitions are few bytes, their draws are not
    drawn = long.filter("i = 0").select("k", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"))).alias("rep")).repartition(tasks, "k", "rep")
    drawn = drawn.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / size) - 1)))
    at = (F.floor(draw(seed, F.col("rep") * F.ceil(F.col("n") / size) + F.col("b") + 1) * F.col("n")) % F.col("n")).alias("i")
    taken = F.least(size, F.col("n") - F.col("b") * size).cast("int").alias("taken")
    total = F.aggregate(F.slice("values", F.lit(1), F.col("taken")), F.lit(0.0), lambda a, v: a + v["x"])
    # merged: the planner counts a repetition as one row, and would send all draws to the driver for a broadcast
    means = drawn.select("k", "rep", "n", taken, at).join(starts.hint("merge"), ["k", "i"]).groupBy("k", "rep").agg((F.sum(total) / F.first("n")).alias("mean"))
    return _intervals(means, sample, F.lit(int(0.025 * reps)), F.lit(-(-reps * 975 // 1000) - 1)).drop("mean")
