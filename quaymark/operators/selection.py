"""Which trades count: one at a time, inside windows, and exact places in time.

One-at-a-time selection looks sequential: a trade is kept if it enters after the last kept
one ended. But what follows a kept trade depends on that trade alone, so each trade gets a
link to the next compatible one by an as-of pass, and the chain from the first trade is
followed by pointer doubling: after ``k`` joins every link spans ``2 ** k`` links and all of
the chain's first ``2 ** k`` trades are marked. A chain of a million trades takes twenty
joins, none of which holds a whole key in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

#: Ranges a pass of ``nth_values`` counts; as many rows reach the driver.
RANGES = 1024


def nth_values(rows: DataFrame, column: str, ranks: list[int]) -> list[int]:
    """The distinct whole numbers of ``column`` at these ranks (from 0) in ascending order.
    Each pass counts distinct values in ``RANGES`` ranges and narrows to the one that holds
    the rank, so no task sorts or holds them all, and nothing passes through a double."""
    values = written(rows.select(F.col(column).cast("long").alias("v")).filter("v IS NOT NULL").distinct(), "values")
    out = []
    for rank in ranks:
        low, high, n = values.agg(F.min("v"), F.max("v"), F.count("*")).first()
        if not n:
            out.append(0)
            continue
        rank = min(max(rank, 0), n - 1)
        while low < high:
            width = (high - low) // RANGES + 1
            inside = values.filter((F.col("v") >= low) & (F.col("v") <= high))
            counts = inside.groupBy(F.expr(f"(v - {low}L) div {width}L").alias("r")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).orderBy("r").collect()
            for r in counts:
                if rank < r["n"]:
                    low, high = r["a"], r["b"]
                    break
                rank -= r["n"]
        out.append(low)
    return out


def next_links(numbered: DataFrame, key: str, entry: str, end: str, strict: bool = True) -> DataFrame:
    """(key, ``n``, ``to``): of each trade the number of the first one that enters after it
    ended (at its end too, unless ``strict``); null if there is none. Numbers ``n`` follow
    the entries; starts and ends are passed once, in order of time."""
    starts = numbered.select(key, F.col(entry).alias("t"), F.lit(0 if strict else 1).alias("o"), F.lit(1).alias("c"), F.lit(None).cast("int").alias("n"), "size")
    ends = numbered.select(key, F.col(end).alias("t"), F.lit(1 if strict else 0).alias("o"), F.lit(0).alias("c"), "n", "size")
    seen = F.sum("c").over(Window.partitionBy(key).orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0))
    to = F.greatest(seen + 1, F.col("n") + 1).cast("int")
    return starts.unionByName(ends).withColumn("to", to).filter("n IS NOT NULL").select(key, "n", F.when(F.col("to") <= F.col("size"), F.col("to")).alias("to"))


def follow_chain(links: DataFrame, key: str) -> DataFrame:
    """(key, ``n``) of the rows on the chain from 1, by pointer doubling."""
    state = written(links.withColumn("on", F.col("n") == 1), "links")
    while not state.filter("on AND to IS NOT NULL").isEmpty():
        hit = state.filter("on AND to IS NOT NULL").select(key, F.col("to").alias("n"), F.lit(True).alias("hit"))
        further = state.select(key, F.col("n").alias("to"), F.col("to").alias("far"))
        state = written(
            state.join(further, [key, "to"], "left").join(hit, [key, "n"], "left").select(key, "n", F.col("far").alias("to"), (F.col("on") | F.coalesce("hit", F.lit(False))).alias("on")),
            "links",
        )
    return state.filter("on").select(key, "n")


def non_overlapping(trades: DataFrame, keys: list[str], entry: str = "entry_ns", end: str = "label_end_ns", strict: bool = True) -> DataFrame:
    """Within each key, trades in order of entry (then of rule and id, where there are any
    that are no key); one is kept if it enters after the last kept one ended (at its end
    too, unless ``strict``). Trades without an end are left out; null keys are a key."""
    order = [entry, *[c for c in ("rule", "id") if c in trades.columns and c not in keys]]
    key = F.struct(*keys) if keys else F.struct(F.lit(0))
    by = Window.partitionBy("__k")
    rows = trades.filter(F.col(end).isNotNull() & F.col(entry).isNotNull()).select(key.alias("__k"), F.struct(*trades.columns).alias("row"), *order, F.col(end).alias("__end"))
    numbered = rows.select("__k", "row", F.col(entry).alias("t0"), F.col("__end").alias("t1"), F.row_number().over(by.orderBy(*order)).alias("n"), F.count("*").over(by).alias("size"))
    numbered = written(numbered, "numbered")
    return numbered.join(follow_chain(next_links(numbered, "__k", "t0", "t1", strict), "__k"), ["__k", "n"], "left_semi").select("row.*")


def window_trades(trades: DataFrame, windows: DataFrame, keys: list[str], aligned: str | None = None) -> DataFrame:
    """The settled trades of each window (``window, start_ns, end_ns``: enter from its start
    on, and enter and end before its end), those ``aligned`` with the higher timeframe if a
    column says so, one at a time inside the window."""
    rows = trades.filter("y IN (0, 1) AND label_end_ns IS NOT NULL")
    if aligned:
        rows = rows.filter(F.coalesce(F.col(aligned), F.lit(False)))
    # windows are a short list of folds
    rows = rows.join(F.broadcast(windows), (F.col("entry_ns") >= F.col("start_ns")) & (F.col("entry_ns") < F.col("end_ns")) & (F.col("label_end_ns") < F.col("end_ns")))
    return non_overlapping(rows.drop("start_ns", "end_ns"), [*keys, "window"])


def selection_split(development: DataFrame, embargo_ns: int, keys: list[str], share: float = 0.75) -> tuple[DataFrame, DataFrame, int]:
    """Inside the development part: trades to fit on (ended before the boundary), and trades
    to choose on (entered an embargo after it, one at a time). The boundary is the entry
    time at ``share`` of the distinct ones."""
    n = development.select("entry_ns").distinct().count()
    boundary = nth_values(development, "entry_ns", [int(n * share)])[0]
    fit = development.filter(F.col("label_end_ns") < boundary)
    return fit, non_overlapping(development.filter(F.col("entry_ns") >= boundary + embargo_ns), keys), boundary


def chronological_split(trades: DataFrame, embargo_ns: int, keys: list[str], shares: tuple[float, float] = (0.5, 0.75), one_at_a_time: tuple[str, ...] = ("test",)) -> DataFrame:
    """Settled trades with their ``part``: development (entered and ended before the first
    boundary), calibration (an embargo later, before the second), test (an embargo later);
    boundaries are exact entry times at ``shares`` of the distinct ones. Purged trades are
    left out; parts named in ``one_at_a_time`` do not overlap."""
    rows = written(trades.filter("y IN (0, 1) AND label_end_ns IS NOT NULL"), "settled")
    n = rows.select("entry_ns").distinct().count()
    first, second = nth_values(rows, "entry_ns", [int(n * s) for s in shares])
    t, e = F.col("entry_ns"), F.col("label_end_ns")
    part = F.when((t < first) & (e < first), "development").when((t >= first + embargo_ns) & (t < second) & (e < second), "calibration").when(t >= second + embargo_ns, "test")
    rows = rows.withColumn("part", part).filter("part IS NOT NULL")
    whole = rows.filter(~F.col("part").isin(*one_at_a_time))
    return whole.unionByName(non_overlapping(rows.filter(F.col("part").isin(*one_at_a_time)), [*keys, "part"]))


def fold_windows(bars: DataFrame, folds: int = 3, least: int = 240) -> DataFrame:
    """(instrument, fold, start_ns, end_ns) of expanding folds over the second half of each
    instrument's bars: fold ``i`` begins at bar floor(n (1/2 + i / (2 folds))). Instruments
    with fewer than ``least`` bars have none."""
    numbered = bars.select("instrument", "bucket", (F.row_number().over(Window.partitionBy("instrument").orderBy("bucket")) - 1).alias("k"), F.count("*").over(Window.partitionBy("instrument")).alias("n"))
    cuts = numbered.filter(F.col("n") >= least)
    at = lambda i: F.floor(F.col("n") * (0.5 + i / (2 * folds)))
    return cuts.groupBy("instrument").agg(
        F.array(*[F.struct(F.lit(i).alias("fold"), F.max(F.when(F.col("k") == at(i), F.col("bucket"))).alias("start_ns"), F.max(F.when(F.col("k") == at(i + 1) - 1, F.col("bucket"))).alias("end_ns")) for i in range(folds)]).alias("f")
    ).select("instrument", F.inline("f"))


def research_walk_forward(trades: DataFrame, bars: DataFrame, strategy: list[str], folds: int = 3, contenders: int = 5, least: int = 20) -> DataFrame:
    """Walk-forward research of each instrument: in every fold the strategies (one trade at
    a time each) are ranked by mean net R of what ended before the fold, the first
    ``contenders`` are frozen and measured in the fold; the first with at least ``least``
    trades and a positive mean is ``selected``. The fold's own trades choose nothing."""
    f = written(fold_windows(bars, folds), "folds")
    settled = trades.filter("label_end_ns IS NOT NULL AND net_r IS NOT NULL").select("instrument", *strategy, "entry_ns", "label_end_ns", "net_r")
    both = settled.join(F.broadcast(f), "instrument")  # folds x instruments rows
    part = F.when(F.col("label_end_ns") < F.col("start_ns"), "train").when((F.col("entry_ns") >= F.col("start_ns")) & (F.col("label_end_ns") <= F.col("end_ns")), "test")
    both = both.withColumn("part", part).filter("part IS NOT NULL").select("instrument", "fold", "part", *strategy, "entry_ns", "label_end_ns", "net_r")
    chosen = non_overlapping(both, ["instrument", "fold", "part", *strategy])
    m = chosen.groupBy("instrument", "fold", *strategy).agg(
        *[F.count_if(F.col("part") == p).alias(f"{p}_n") for p in ("train", "test")], *[F.avg(F.when(F.col("part") == p, F.col("net_r"))).alias(f"{p}_mean") for p in ("train", "test")]
    ).filter("train_n > 0")
    w = Window.partitionBy("instrument", "fold").orderBy(F.desc("train_mean"), *strategy)
    m = m.withColumns({"place": F.row_number().over(w), "eligible": (F.col("train_n") >= least) & (F.col("train_mean") > 0)})
    first = F.min(F.when(F.col("eligible"), F.col("place"))).over(Window.partitionBy("instrument", "fold"))
    return m.withColumn("selected", F.coalesce(F.col("place") == first, F.lit(False))).filter(F.col("place") <= contenders)


def opposed(way: Column, higher: Column) -> Column:
    """Whether a trade goes against the higher timeframe's direction (1, -1, 0 or null)."""
    return F.coalesce(way * higher < 0, F.lit(False))
