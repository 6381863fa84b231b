"""Mixing sources to target weights by entropy balancing.

Every document i has a rate r_i, how often the mix takes it. Among all rates that meet
the token targets, the one closest to "each once" is chosen: the least sum of
size_i * (r_i log r_i - r_i). Its solution is exponentially tilted, r_i = exp(lambda . f_i)
with one multiplier for each constraint the document falls under, and the multipliers
minimise the convex dual. Newton's method finds them: each iteration is one distributed
sum over the corpus's cells (token totals by constraint values, which Spark aggregates
first), and only totals of constraints come to the driver: at most ``MAX_CONSTRAINTS``.
With more sources than that nothing comes to the driver: sources are numbered in ranges,
the capped targets are reshared by sums over the table of sources, and as each document
falls under one constraint alone, the dual falls apart into one equation a source, whose
Newton steps are a column expression.

Rates then become whole copies. Rows with the same id and text are counted and dealt in
lots of at most ``LOT``, all others alone. Within a source, lots are dealt into buckets by hash
(about ``BUCKET`` documents each, so a hot source becomes many groups); a bucket goes from
the largest document to the smallest and gives each the number of copies that brings the
words taken so far closest to the rate times the words seen so far. What is left over at
the end is about half the size of the smallest documents; trades of single copies between
two documents of the bucket then lower it further.

Cases: null text has size 0 and copies that take 0 words; a null source is a source of its
own, last in order; sources of size 0 have target 0; repeated rows are separate rows;
an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, materialize, read_table

CAP = 3.0
BUCKET = 4096
LOT = 256
MAX_CONSTRAINTS = 4096  # on the driver
STEPS = 60
WEIGHTS = (1, 2, 3)


def capped_targets(sizes: list[int], weights: list[float], cap: float = CAP) -> list[float]:
    """Targets in proportion to ``weights`` that sum to all sizes; none above ``cap``
    times its size, the excess reshared by weight among the others until none is above."""
    target, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        whole = sum(weights[k] for k in sorted(free))
        over = [k for k in sorted(free) if left * weights[k] / whole > cap * sizes[k]]
        if not over:
            for k in free:
                target[k] = left * weights[k] / whole
            break
        for k in over:
            target[k] = cap * sizes[k]
            free.discard(k)
        left = float(sum(sizes)) - sum(target[k] for k in range(len(sizes)) if k not in free)
    return target


def entropy_balance(cells: DataFrame, constraints: list[str], targets: dict[str, dict], steps: int = STEPS, tol: float = 1e-12) -> dict[str, dict]:
    """Multipliers of the dual. ``cells`` has the constraint columns and ``size``;
    ``targets[column][value]`` are the tokens wanted. Each iteration sums the tokens that
    the current rates give, by value and by pair of values, in Spark."""
    index = {(c, v): k for k, (c, v) in enumerate((c, v) for c in constraints for v in targets[c])}
    if len(index) > MAX_CONSTRAINTS:
        raise ValueError(f"{len(index)} constraints; at most {MAX_CONSTRAINTS}")
    want = np.array([float(targets[c][v]) for c, v in index])
    lam = np.where(want > 0, 0.0, -50.0)
    spark = cells.sparkSession
    for _ in range(steps):
        rated = cells
        power = F.lit(0.0)
        for c in constraints:
            table = spark.createDataFrame([(v, float(lam[index[c, v]])) for v in targets[c]], f"v {cells.schema[c].dataType.simpleString()}, l_{c} double")
            rated = rated.join(F.broadcast(table), F.col(c).eqNullSafe(F.col("v"))).drop("v")  # at most MAX_CONSTRAINTS rows
            power = power + F.col(f"l_{c}")
        rated = rated.withColumn("tokens", F.col("size") * F.exp(power))
        grad, hess = -want.copy(), np.zeros((len(index),) * 2)
        sums = rated.groupBy(*constraints).agg(F.sum("tokens").alias("tokens")).collect() if len(constraints) == 1 else [
            row for a in range(len(constraints)) for b in range(a, len(constraints))
            for row in rated.groupBy(F.lit(a).alias("__a"), F.lit(b).alias("__b"), F.col(constraints[a]).alias("__x"), F.col(constraints[b]).alias("__y")).agg(F.sum("tokens").alias("tokens")).collect()
        ]
        for row in sums:
            a, b, x, y = (0, 0, row[0], row[0]) if len(constraints) == 1 else row[:4]
            i, j, t = index[constraints[a], x], index[constraints[b], y], row["tokens"]
            if i == j:
                grad[i] += t
                hess[i, i] += t
            elif a != b:
                hess[i, j] += t
                hess[j, i] += t
        live = want > 0
        if not live.any() or np.abs(grad[live]).max() <= tol * want.sum():
            break
        h = hess[np.ix_(live, live)]
        step = np.linalg.lstsq(h + 1e-12 * np.trace(h) / len(h) * np.eye(len(h)), grad[live], rcond=None)[0]
        lam[live] -= np.clip(step, -1, 1)
    return {c: {v: float(lam[index[c, v]]) for v in targets[c]} for c in constraints}


def round_copies(sizes: np.ndarray, rate: float, cap: int = int(CAP)) -> np.ndarray:
    """Copies of each of the documents, given from the largest to the smallest."""
    copies, seen, taken = np.zeros(len(sizes), np.int64), 0.0, 0.0
    for k, size in enumerate(sizes.tolist()):
        seen += size
        n = int(min(cap, max(0, np.floor((rate * seen - taken) / size + 0.5)))) if size else int(min(cap, np.floor(rate + 0.5)))
        copies[k] = n
        taken += n * size
    return repaired(sizes, copies, rate * float(sizes.sum()), cap)


def repaired(sizes: np.ndarray, copies: np.ndarray, target: float, cap: int, steps: int = 16) -> np.ndarray:
    """Change one document by a copy, or trade a copy between two, while that brings the
    words taken closer to the target."""
    for _ in range(steps):
        short = target - float((sizes * copies).sum())
        more, less = np.flatnonzero((copies < cap) & (sizes > 0)), np.flatnonzero((copies > 0) & (sizes > 0))
        found = [(abs(short), (), ())]
        for rows, sign in ((more, 1), (less, -1)):
            if len(rows):
                k = rows[np.abs(short - sign * sizes[rows]).argmin()]
                found.append((abs(short - sign * sizes[k]), (k,) if sign > 0 else (), (k,) if sign < 0 else ()))
        if len(more) and len(less):
            order = less[np.argsort(sizes[less], kind="stable")]
            at = np.clip(np.searchsorted(sizes[order], sizes[more] - short), 0, len(order) - 1)
            for near in (at, np.maximum(at - 1, 0)):
                left = np.abs(short - sizes[more] + sizes[order[near]])
                k = int(left.argmin())
                found.append((left[k], (more[k],), (order[near[k]],)))
        best = min(found, key=lambda f: f[0])
        if best[0] >= abs(short) - 1e-9:
            break
        copies[list(best[1])] += 1
        copies[list(best[2])] -= 1
    return copies


def planned(cells: DataFrame, cap: float = CAP, bucket: int = BUCKET, most: int = MAX_CONSTRAINTS) -> DataFrame:
    """(source, source_size, target, rate, buckets) of ``cells`` (source, size, n)."""
    if cells.limit(most + 1).count() > most:
        return planned_apart(cells, cap, bucket)
    # Python orders texts by code point
    found = sorted(cells.collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    weights = [WEIGHTS[k % len(WEIGHTS)] for k in range(len(found))]
    target = dict(zip([r["source"] for r in found], capped_targets([r["size"] for r in found], weights, cap), strict=True))
    lam = entropy_balance(cells, ["source"], {"source": target})["source"] if found else {}
    rows = [(r["source"], r["size"], float(target[r["source"]]), float(min(cap, np.exp(lam[r["source"]]))) if target[r["source"]] > 0 else 0.0, max(1, -(-r["n"] // bucket))) for r in found]
    return F.broadcast(cells.sparkSession.createDataFrame(rows, "source string, source_size long, target double, rate double, buckets long"))  # at most that many rows


def planned_apart(cells: DataFrame, cap: float = CAP, bucket: int = BUCKET) -> DataFrame:
    """The same for any number of sources, as Spark jobs over their table."""
    order = [F.col("source").asc_nulls_last()]
    ranged = cells.repartitionByRange(max(1, cells.count() // (16 * MAX_CONSTRAINTS)), *order).withColumn("part", F.spark_partition_id())
    inside = ranged.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1)
    inside = materialize(inside, "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    parts = inside.groupBy("part").agg(F.count("*").alias("rows")).withColumn("base", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.col("base") + F.col("k")) % len(WEIGHTS) + 1).cast("int"))
    held = materialize(inside.join(parts.select("part", "base"), "part").select("source", "size", "n", weight.alias("weight")), "weights")
    capped, level = F.lit(False), 0.0
    while True:  # targets are level * weight, or the cap's; the level only rises, so what is capped stays so
        left, whole, fixed = held.agg(
            F.sum("size"), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))), F.sum(F.when(capped, cap * F.col("size")).otherwise(0.0))
        ).first()
        if not whole:
            break
        level = (left - fixed) / whole
        over = F.lit(level) * F.col("weight") > cap * F.col("size")
        if held.filter(over & ~capped).isEmpty():
            break
        capped = over
    target = F.when(capped, cap * F.col("size")).otherwise(F.lit(level) * F.col("weight"))
    tokens = lambda x: F.col("size") * F.exp(x)
    newton = lambda x, _: x - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (tokens(x) - F.col("target")) / tokens(x)))
    power = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.lit(0.0), newton)
    rate = F.when((F.col("target") > 0) & (F.col("size") > 0), F.least(F.lit(float(cap)), F.exp(power))).otherwise(0.0)
    out = held.withColumn("target", target.cast("double")).withColumn("rate", rate)
    out = out.select("source", F.col("size").alias("source_size"), "target", "rate", F.greatest(F.lit(1), F.ceil(F.col("n") / bucket)).cast("long").alias("buckets"))
    return materialize(out, "plan")  # written, so that Spark can split a hot source in the join


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: float = CAP, bucket: int = BUCKET, most: int = MAX_CONSTRAINTS) -> DataFrame:
    """One row per input row: id, ``size``, ``source_size``, ``target``, ``taken``,
    ``copies``, ``rate`` and ``text_hash`` (of the raw text)."""
    rows = materialize(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
        ),
        "sizes",
    )
    cells = materialize(rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "cells")
    plan = planned(cells, cap, bucket, most).withColumnRenamed("source", "s")
    lots = rows.groupBy("source", "id", "text_hash", "size").agg(F.count("*").alias("alike"))  # copies meet in tasks first
    lots = lots.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(alike - 1) div {LOT}L"))))
    lots = lots.withColumn("alike", F.least(F.lit(LOT), F.col("alike") - F.col("lot") * LOT))
    dealt = lots.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    hashed = F.when(F.col("lot") == 0, F.xxhash64("id", "text_hash")).otherwise(F.xxhash64("id", "text_hash", "lot"))
    dealt = dealt.withColumn("bucket", F.pmod(hashed, F.col("buckets")))
    limit = int(cap)

    def give(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.loc[frame.index.repeat(frame["alike"])].sort_values(["size", "id", "text_hash"], ascending=[False, True, True], kind="stable")
        frame["copies"] = round_copies(frame["size"].to_numpy(), float(frame["rate"].iloc[0]), limit) if len(frame) else 0
        frame["taken"] = frame["copies"] * frame["size"]
        return frame

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, size long, source_size long, target double, rate double, copies long, taken long, text_hash long"
    given = dealt.groupBy("source", "bucket").applyInPandas(lambda f: give(f)[["id", "size", "source_size", "target", "rate", "copies", "taken", "text_hash"]], schema)
    return given.withColumnRenamed("id", id_col)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it."""
    given = mix(docs).filter("copies > 0").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "copies")
    given = given.groupBy("__id", "__hash").agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
    cols = docs.columns
    taken = docs.withColumn("__h", F.xxhash64(F.coalesce(F.col("text"), F.lit("")))).join(
        given, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash"))
    )
    if not given.filter("__rows > 1").isEmpty():  # repeated rows: one of them stands for all their copies
        taken = taken.dropDuplicates(["__id", "__hash"])
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*cols)
