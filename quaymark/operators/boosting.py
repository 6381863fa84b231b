"""Binary models fitted by Spark aggregates over all rows, and the search among them.

*Boosted trees.* Features are binned once at equal-frequency cuts. A level of a tree is one
pass: tasks add up gradients and hessians by (candidate, leaf, feature, bin), Spark sums
them, and windows over the bins find the best cut of each leaf. All candidates of a search
grow side by side in the same pass, so a search takes as many passes as its largest
candidate alone. What reaches the driver is one row a leaf. Margins are written every
``KEEP`` trees, so that a pass evaluates only the trees since.

*Logistic regression.* Newton steps; tasks add up the normal equations.

*Search.* Development, calibration and test parts follow each other in time. Candidates are
fitted on what ended before an inner boundary and compared by Brier score on what entered
after it and an embargo, one trade at a time; ties go to the smaller name. The chosen one is
fitted again on all of the development part, its margins are calibrated by Platt's two
numbers on the calibration part, and the test part measures it once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from .selection import chronological_split, selection_split

BINS, KEEP, RATE, LAMBDA = 64, 16, 0.04, 2.0


@dataclass(frozen=True)
class Boosted:
    """A candidate: trees, depth, most leaves of a tree, least rows of a leaf."""

    name: str
    trees: int
    depth: int
    leaves: int
    least: int


@dataclass(frozen=True)
class Logistic:
    name: str
    c: float


#: The search space (fixed values).
VARIANTS = (
    Logistic("logistic-c01", 0.1), Logistic("logistic-c1", 1.0),
    Boosted("boosted-shallow", 120, 4, 15, 40), Boosted("boosted-medium", 250, 6, 31, 80), Boosted("boosted-regularized", 350, 8, 63, 150),
)

Tree = list[tuple[int, int, int, float]]  # by node: feature (-1: leaf), bin, left child, value


def cut_points(rows: DataFrame, width: int, bins: int = BINS) -> list[list[float]]:
    """Of each feature at most ``bins - 2`` increasing cuts of about equal frequency."""
    shares = [k / (bins - 1) for k in range(1, bins - 1)]
    found = rows.agg(*[F.percentile_approx(F.when(~F.isnan(F.col("features")[k]), F.col("features")[k]), shares, 10_000).alias(f"f{k}") for k in range(width)]).first()
    return [sorted(set(c or [])) for c in found]


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64) if len(column) else np.zeros((0, width))


def binned(rows: DataFrame, cuts: list[list[float]]) -> DataFrame:
    """``rows`` with ``bins`` (a byte a feature; 0: missing, then the number of cuts below)."""

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = _matrix(frame["features"], len(cuts))
            out = np.stack([np.where(np.isnan(x[:, k]), 0, 1 + np.searchsorted(c, x[:, k], "left")) for k, c in enumerate(cuts)], axis=1).astype(np.uint8) if cuts else np.zeros((len(x), 0), np.uint8)
            yield frame.drop(columns="features").assign(bins=[r.tobytes() for r in out])

    kept = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "features")
    return rows.mapInPandas(put, kept + ", bins binary")


def tree_values(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The node each row of bins ends in, and that node's value."""
    feature, cut, child, value = (np.array(c) for c in zip(*tree))
    at = np.zeros(len(x), np.int64)
    while True:
        inner = feature[at] >= 0
        if not inner.any():
            return at, value[at].astype(np.float64)
        rows = np.flatnonzero(inner)
        node = at[rows]
        at[rows] = child[node] + (x[rows, feature[node]] > cut[node])


def _bins(column: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), width)


def _histograms(work: list[tuple[int, list[Tree], Tree]], width: int, bins: int):
    """Of each candidate: gradients, hessians and counts of the open leaves of its last tree."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {k: np.zeros((len(grown), width, bins, 3)) for k, _, grown in work}
        for frame in frames:
            x, y = _bins(frame["bins"], width), frame["y"].to_numpy(np.float64)
            margins = _matrix(frame["margins"], 0)
            for k, done, grown in work:
                margin = margins[:, k] + sum((tree_values(t, x)[1] for t in done), np.zeros(len(x)))
                p = 1 / (1 + np.exp(-margin))
                node, _ = tree_values(grown, x)
                flat = (node[:, None] * width + np.arange(width)) * bins + x
                for what, values in enumerate((p - y, p * (1 - p), np.ones(len(x)))):
                    sums[k][..., what] += np.bincount(flat.ravel(), np.repeat(values, width), minlength=len(grown) * width * bins).reshape(len(grown), width, bins)
        for k, held in sums.items():
            node, feature, at = np.nonzero(held[..., 2])
            if len(node):
                g, h, n = held[node, feature, at].T
                yield pd.DataFrame({"k": np.int32(k), "node": node.astype(np.int32), "feature": feature.astype(np.int32), "bin": at.astype(np.int32), "g": g, "h": h, "n": n.astype(np.int64)})

    return add


def _best_cuts(sums: DataFrame) -> DataFrame:
    """(k, node, g, h, n, best): the leaf's own sums and its cut of highest gain, if any."""
    total = sums.groupBy("k", "node", "feature", "bin", "least").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    w = Window.partitionBy("k", "node", "feature")
    below = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    t = total.withColumns({f"{c}_l": F.sum(c).over(below) for c in "ghn"} | {f"{c}_t": F.sum(c).over(w) for c in "ghn"})
    part = lambda g, h: g * g / (h + LAMBDA)
    gain = part(F.col("g_l"), F.col("h_l")) + part(F.col("g_t") - F.col("g_l"), F.col("h_t") - F.col("h_l")) - part(F.col("g_t"), F.col("h_t"))
    allowed = (F.col("n_l") >= F.col("least")) & (F.col("n_t") - F.col("n_l") >= F.col("least"))
    # gains that differ by rounding alone are equal; then the first feature and bin
    cut = F.when(allowed & (gain > 1e-9), F.struct(F.round(gain, 9).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b")))
    return t.groupBy("k", "node").agg(F.max(cut).alias("best"), F.max_by("g_t", -F.col("feature")).alias("g"), F.max_by("h_t", -F.col("feature")).alias("h"), F.max("n_t").alias("n"))


def fit_boosted(rows: DataFrame, candidates: list[Boosted], bins: int = BINS, rate: float = RATE) -> dict[str, dict]:
    """Models by name, fitted on all ``rows`` (``features``, ``y``): ``cuts``, ``base``, ``trees``."""
    first = rows.select(F.size("features")).first()
    if first is None or not candidates:
        return {}
    width = first[0]
    cuts = cut_points(rows, width, bins)
    share = rows.agg(F.avg("y")).first()[0]
    base = float(np.log(share / (1 - share))) if 0 < share < 1 else 0.0
    data = written(binned(rows.select("features", F.col("y").cast("double").alias("y")), cuts).withColumn("margins", F.array(*[F.lit(base)] * len(candidates))), "binned")
    models = {c.name: {"cuts": cuts, "base": base, "trees": []} for c in candidates}
    fresh: list[list[Tree]] = [[] for _ in candidates]
    for round_ in range(max(c.trees for c in candidates)):
        grown: dict[int, Tree] = {k: [(-1, 0, 0, 0.0)] for k, c in enumerate(candidates) if round_ < c.trees}
        open_ = dict.fromkeys(grown, True)
        for level in range(max(candidates[k].depth for k in grown) + 1):
            work = [(k, fresh[k], grown[k]) for k in grown if open_[k] and level <= candidates[k].depth]
            if not work:
                break
            least = F.element_at(F.array(*[F.lit(c.least) for c in candidates]), F.col("k") + 1)
            sums = data.mapInPandas(_histograms(work, width, bins), "k int, node int, feature int, bin int, g double, h double, n long").withColumn("least", least)
            found = _best_cuts(sums).collect()  # one row for each leaf
            for k, _, tree in work:
                leaves = [r for r in found if r["k"] == k and tree[r["node"]][0] < 0]
                for r in leaves:
                    tree[r["node"]] = (-1, 0, 0, -rate * r["g"] / (r["h"] + LAMBDA))
                best = sorted((r for r in leaves if r["best"] and level < candidates[k].depth), key=lambda r: (-r["best"]["gain"], r["node"]))
                room = candidates[k].leaves - sum(t[0] < 0 for t in tree)
                for r in best[: max(0, room)]:
                    tree[r["node"]] = (-r["best"]["f"], -r["best"]["b"], len(tree), 0.0)
                    tree += [(-1, 0, 0, 0.0), (-1, 0, 0, 0.0)]
                open_[k] = bool(best[: max(0, room)])
        for k, tree in grown.items():
            fresh[k].append(tree)
            models[candidates[k].name]["trees"].append(tree)
        if (round_ + 1) % KEEP == 0:
            data, fresh = written(_with_margins(data, fresh, width), "margins"), [[] for _ in candidates]
    return models


def _with_margins(data: DataFrame, fresh: list[list[Tree]], width: int) -> DataFrame:
    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x, margins = _bins(frame["bins"], width), _matrix(frame["margins"], len(fresh))
            for k, trees in enumerate(fresh):
                for tree in trees:
                    margins[:, k] += tree_values(tree, x)[1]
            yield frame.assign(margins=list(margins))

    return data.mapInPandas(add, data.schema)


# -- logistic regression --------------------------------------------------------------------


def _equations(weights: np.ndarray, mean: np.ndarray, scale: np.ndarray):
    """Gradient and curvature of the log-loss of each candidate (a row of ``weights``, the
    last number its intercept), added up in a task."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, d = weights.shape
        grad, curve = np.zeros((n, d)), np.zeros((n, d, d))
        for frame in frames:
            x = np.concatenate([(_matrix(frame["features"], d - 1) - mean) / scale, np.ones((len(frame), 1))], axis=1)
            y = frame["y"].to_numpy(np.float64)
            for k, w in enumerate(weights):
                p = 1 / (1 + np.exp(-(x @ w)))
                grad[k] += x.T @ (p - y)
                curve[k] += (x * (p * (1 - p))[:, None]).T @ x
        both = np.concatenate([grad[:, :, None], curve], axis=2)
        k, i = np.divmod(np.arange(n * d), d)
        yield pd.DataFrame({"k": k.astype(np.int32), "i": i.astype(np.int32), "sums": list(both.reshape(n * d, d + 1))})

    return add


def fit_logistic(rows: DataFrame, strengths: dict[str, float], steps: int = 25, standardize: bool = True) -> dict[str, dict]:
    """Models by name for each strength C (the penalty is half the squared weights over C,
    free of the intercept): ``mean``, ``scale``, ``weights``, ``intercept``."""
    first = rows.select(F.size("features")).first()
    if first is None or not strengths:
        return {}
    d = first[0]
    mean, scale = np.zeros(d), np.ones(d)
    if standardize:
        found = rows.agg(*[F.avg(F.col("features")[k]).alias(f"m{k}") for k in range(d)], *[F.stddev_pop(F.col("features")[k]).alias(f"s{k}") for k in range(d)]).first()
        mean, scale = np.array(found[:d], float), np.array([s if s > 0 else 1.0 for s in found[d:]], float)
    names, weights = list(strengths), np.zeros((len(strengths), d + 1))
    penalty = np.array([1 / strengths[n] for n in names])[:, None] * np.r_[np.ones(d), 0]
    for _ in range(steps):
        sums = rows.select("features", F.col("y").cast("double").alias("y")).mapInPandas(_equations(weights, mean, scale), "k int, i int, sums array<double>")
        total = sums.groupBy("k", "i").agg(F.array(*[F.sum(F.col("sums")[j]) for j in range(d + 2)]).alias("s")).collect()
        both = np.zeros((len(names), d + 1, d + 2))
        for r in total:
            both[r["k"], r["i"]] = r["s"]
        moves = [np.linalg.solve(both[k, :, 1:] + np.diag(penalty[k]) + 1e-12 * np.eye(d + 1), both[k, :, 0] + penalty[k] * weights[k]) for k in range(len(names))]
        weights = weights - np.stack(moves)
        if max(np.abs(m).max() for m in moves) < 1e-10:
            break
    return {n: {"mean": mean, "scale": scale, "weights": weights[k, :d], "intercept": float(weights[k, d])} for k, n in enumerate(names)}


def score(rows: DataFrame, models: dict[str, dict]) -> DataFrame:
    """``rows`` with ``margins``, a map from a model's name to its raw score, for ``features``."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            columns = {}
            x = _matrix(frame["features"], 0)
            for name, m in models.items():
                if "trees" in m:
                    b = np.stack([np.where(np.isnan(x[:, k]), 0, 1 + np.searchsorted(c, x[:, k], "left")) for k, c in enumerate(m["cuts"])], axis=1)
                    columns[name] = m["base"] + sum((tree_values(t, b)[1] for t in m["trees"]), np.zeros(len(x)))
                else:
                    columns[name] = (x - m["mean"]) / m["scale"] @ m["weights"] + m["intercept"]
            yield frame.drop(columns="features").assign(margins=[dict(zip(columns, map(float, r))) for r in zip(*columns.values())])

    kept = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "features")
    return rows.mapInPandas(add, kept + ", margins map<string,double>")


def probability(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


def brier_by_model(scored: DataFrame) -> DataFrame:
    """(name, n, brier) of each model's probabilities."""
    each = scored.select("y", F.explode("margins").alias("name", "margin"))
    return each.groupBy("name").agg(F.count("*").alias("n"), F.avg((probability(F.col("margin")) - F.col("y")) ** 2).alias("brier"))


def fit_variants(rows: DataFrame, variants: tuple) -> dict[str, dict]:
    boosted = fit_boosted(rows, [v for v in variants if isinstance(v, Boosted)])
    return boosted | fit_logistic(rows, {v.name: v.c for v in variants if isinstance(v, Logistic)})


def model_search(trades: DataFrame, embargo_ns: int, keys: list[str], variants: tuple = VARIANTS) -> DataFrame:
    """The search over trades (``features``, ``y``, ``entry_ns``, ``label_end_ns``): a row for
    each (``stage``, ``name``): ``selection`` of every candidate, ``calibration`` and ``test``
    of the chosen one, with ``n``, ``brier`` and ``baseline`` (the Brier score of the
    development part's rate; null for candidates); Platt's numbers are ``a`` and ``b``.
    Without both classes to fit on there are no rows."""
    parts = written(chronological_split(trades, embargo_ns, keys), "parts")
    development = parts.filter("part = 'development'")
    fit, validation, _ = selection_split(development, embargo_ns, keys)
    fit = written(fit, "fit")
    out = "stage string, name string, n long, brier double, baseline double, a double, b double"
    spark = trades.sparkSession
    if fit.select("y").distinct().count() < 2:
        return spark.createDataFrame([], out)
    candidates = brier_by_model(score(validation.select("features", "y"), fit_variants(fit, variants))).collect()
    if not candidates:
        return spark.createDataFrame([], out)
    chosen = min(candidates, key=lambda r: (r["brier"], r["name"]))["name"]
    rows = [("selection", r["name"], r["n"], r["brier"], None, None, None) for r in candidates]
    final = fit_variants(development, tuple(v for v in variants if v.name == chosen))
    rate = development.agg(F.avg("y")).first()[0]
    margins = written(score(parts.filter("part <> 'development'").select("part", "features", "y"), final).select("part", "y", F.col("margins")[chosen].alias("margin")), "margins")
    held = margins.filter("part = 'calibration'").select(F.array("margin").alias("features"), "y")
    platt = fit_logistic(held, {"platt": 1e6}, standardize=False).get("platt")
    a, b = (float(platt["weights"][0]), platt["intercept"]) if platt else (1.0, 0.0)
    measured = margins.groupBy("part").agg(F.count("*").alias("n"), F.avg((probability(F.lit(a) * F.col("margin") + b) - F.col("y")) ** 2).alias("brier"), F.avg((F.lit(rate) - F.col("y")) ** 2).alias("baseline"))
    rows += [(r["part"], chosen, r["n"], r["brier"], r["baseline"], a, b) for r in measured.collect()]
    return spark.createDataFrame(rows, out)
