"""The class model of an instrument: candidates fitted on the first half of its history,
one chosen on the next quarter, measured on the last.

The history of an instrument is its newest ``HISTORY`` bars by contract, so an instrument is
a group of bounded size and instruments are the tasks. Samples (a bar's features and the
class of what follows) are split by the bar's number: training ends before half of the bars,
calibration lies between half and three quarters, each an horizon away from the part before.

Candidates come in a fixed order: multinomial logistic, weighted neighbours (15, 31, 61),
quadratic discriminants (shrinkage .25, .5, .9), networks (8 and 16 hidden units), linear
discriminants (.25, .9), boosted stumps. All but the neighbours have the temperature of the
least log-loss on the calibration part, the first of equals, 1 before all. The candidate of
least Brier score is chosen; a tie stays with the earlier one. Class intercepts fitted on the
calibration part follow it only if they lower its Brier score there. The test part chooses
nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stats as S
from .trades import directional_cost

CLASSES = ("UP", "DOWN", "FLAT")
HISTORY, HORIZON, NEUTRAL_ATR = 2000, 4, 0.35
LEAST_TRAIN, LEAST_CALIBRATION, LEAST_CLASS = 120, 50, 5
TEMPERATURES = np.exp(np.log(0.25) + np.arange(41) * np.log(16) / 40)
OUT = (
    "instrument string, place int, algorithm string, setting double, temperature double, n long, brier double, log_loss double, "
    "selected boolean, adjusted_brier double, bias array<double>, test_n long, test_brier double, test_log_loss double, test_accuracy double"
)


def neutral_band(atr_share: Column, close: Column) -> Column:
    """Change of price that counts as none: a share of the ATR, and a round trip's cost."""
    return NEUTRAL_ATR * atr_share + directional_cost(close)


def chances(scores: np.ndarray, temperature: float = 1.0) -> np.ndarray:
    z = scores / temperature
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def brier(p: np.ndarray, y: np.ndarray) -> float:
    return float(((p - np.eye(p.shape[1])[y]) ** 2).sum(axis=1).mean())


def log_loss(p: np.ndarray, y: np.ndarray) -> float:
    return float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-15)).mean())


def adjusted(p: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Chances with class intercepts."""
    return chances(np.log(np.maximum(p, 1e-15)) + bias)


def fit_intercepts(p: np.ndarray, y: np.ndarray, steps: int = 300, ridge: float = 0.02, rate: float = 0.2) -> np.ndarray | None:
    """Class intercepts of least regularised log-loss, by full steps, always of mean zero.
    None for fewer than 50 rows or a chance of zero."""
    if len(p) < 50 or (p <= 0).any():
        return None
    bias, seen = np.zeros(p.shape[1]), np.bincount(y, minlength=p.shape[1]) / len(y)
    for _ in range(steps):
        bias = bias - rate * (adjusted(p, bias).mean(axis=0) - seen + ridge * bias)
        bias -= bias.mean()
    return bias


def best_temperature(scores: np.ndarray, y: np.ndarray) -> float:
    best, loss = 1.0, log_loss(chances(scores), y)
    for t in TEMPERATURES:
        other = log_loss(chances(scores, t), y)
        if other < loss:
            best, loss = float(t), other
    return best


def candidates(x: np.ndarray, y: np.ndarray):
    """(algorithm, setting, function of features to scores or chances, whether scores) in order."""
    mean, scale = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    put = lambda v: np.clip((v - mean) / scale, -5, 5)
    z, k = put(x), len(CLASSES)
    share = np.bincount(y, minlength=k) / len(y)
    ones = lambda v: np.hstack([put(v), np.ones((len(v), 1))])
    w = S.fit_softmax(z, y, k)
    yield "multinomial-logistic", None, lambda v: ones(v) @ w, True
    for near in (15, 31, 61):
        if len(z) > near:
            yield "weighted-knn", float(near), lambda v, near=near: S.neighbour_votes(z, y, share, put(v), near), False
    for shrink in (0.25, 0.5, 0.9):
        m = S.fit_discriminant(z, y, k, shrink)
        yield "regularized-qda", shrink, lambda v, m=m: S.discriminant_scores(m, put(v)), True
    for hidden in (8, 16):
        net = S.fit_network(z, y, k, hidden)
        yield "neural-network", float(hidden), lambda v, net=net: S.network_scores(net, put(v)), True
    for shrink in (0.25, 0.9):
        m = S.fit_discriminant(z, y, k, shrink, pooled=True)
        yield "regularized-lda", shrink, lambda v, m=m: S.discriminant_scores(m, put(v)), True
    stumps = S.fit_stumps(z, y, k)
    yield "gradient-boosted-stumps", 32.0, lambda v: S.stump_values(stumps, put(v)), True


def choose(name: str | None, index: np.ndarray, end: np.ndarray, x: np.ndarray, y: np.ndarray, bars: int) -> list[tuple]:
    """Rows of ``OUT`` for the samples of one instrument; none without enough samples."""
    train_end, calibration_end = bars // 2, bars * 3 // 4
    train = (index < train_end) & (end < train_end)
    held = (index >= train_end + HORIZON) & (end < calibration_end)
    test = index >= calibration_end + HORIZON
    if train.sum() < LEAST_TRAIN or held.sum() < LEAST_CALIBRATION or np.bincount(y[train], minlength=len(CLASSES)).min() < LEAST_CLASS:
        return []
    found = []
    for algorithm, setting, scores, raw in candidates(x[train], y[train]):
        got = scores(x[held])
        t = best_temperature(got, y[held]) if raw else 1.0
        p = chances(got, t) if raw else got
        found.append((algorithm, setting, t, brier(p, y[held]), log_loss(p, y[held]), p, (lambda v, s=scores, t=t, raw=raw: chances(s(v), t) if raw else s(v))))
    best = min(range(len(found)), key=lambda i: found[i][3])  # the earliest of equals
    bias = fit_intercepts(found[best][5], y[held])
    after = brier(adjusted(found[best][5], bias), y[held]) if bias is not None else None
    apply = after is not None and after < found[best][3]
    out = []
    for i, (algorithm, setting, t, b, loss, _, predict) in enumerate(found):
        more: tuple = (None,) * 6
        if i == best:
            p = predict(x[test]) if test.any() else None
            p = adjusted(p, bias) if p is not None and apply else p
            more = (after, bias.tolist() if apply else None, int(test.sum()), *((brier(p, y[test]), log_loss(p, y[test]), float((p.argmax(axis=1) == y[test]).mean())) if p is not None else (None,) * 3))
        out.append((name, i, algorithm, setting, t, int(held.sum()), b, loss, i == best, *more))
    return out


def class_models(samples: DataFrame, history: int = HISTORY) -> DataFrame:
    """A row for each candidate of each instrument. ``samples``: instrument, ``bar`` (number of
    the bar, from 0), ``bars`` (how many the instrument has), ``features``, ``class`` (null: no
    label). Only the newest ``history`` bars count."""
    first = F.greatest(F.lit(0), F.col("bars") - history)
    kept = samples.filter(F.col("class").isin(*CLASSES) & (F.col("bar") >= first)).select(
        "instrument", (F.col("bar") - first).cast("long").alias("index"), F.least("bars", F.lit(history)).cast("long").alias("bars"), "features",
        F.array_position(F.array(*map(F.lit, CLASSES)), F.col("class")).cast("int").alias("y"),
    )

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("index", kind="stable")
        index = f["index"].to_numpy()
        rows = choose(f["instrument"].iloc[0], index, index + HORIZON, np.stack(f["features"].to_numpy()).astype(float), f["y"].to_numpy() - 1, int(f["bars"].iloc[0]))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    return kept.groupBy("instrument").applyInPandas(run, OUT)


def numbered(bars: DataFrame) -> DataFrame:
    """``bars`` with ``bar`` and ``bars``."""
    w = Window.partitionBy("instrument")
    return bars.withColumns({"bar": F.row_number().over(w.orderBy("bucket")) - 1, "bars": F.count("*").over(w)})
