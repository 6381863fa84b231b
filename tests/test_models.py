"""Selection in time by links and doubling; models fitted by aggregates against plain numpy."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaymark.operators import boosting as X
from quaymark.operators import selection as Z


def plain_chain(rows, strict=True):
    kept, busy = [], None
    for a, b, i in sorted(rows, key=lambda r: (r[0], r[2])):
        if busy is None or a > busy or (not strict and a == busy):
            kept.append(i)
            busy = b
    return kept


@pytest.mark.parametrize("strict", [True, False])
def test_chain_matches_a_loop(spark, strict):
    rng = random.Random(6)
    rows = []
    for key in ("a", "b", None, "one"):
        for k in range(200 if key != "one" else 1):
            start = rng.randrange(300)
            rows.append((key, start, start + rng.choice([0, 0, 1, 5, 20, 200]), len(rows), "n", 7))
    rows.append(("a", 5, None, len(rows), "n", 7))
    t = spark.createDataFrame(rows, "k string, entry_ns long, label_end_ns long, id long, n string, size int")  # clashing names
    got = Counter((r["k"], r["id"]) for r in Z.non_overlapping(t, ["k"], strict=strict).collect())
    want = Counter((key, i) for key in ("a", "b", None, "one") for i in plain_chain([(r[1], r[2], r[3]) for r in rows if r[0] == key and r[2] is not None], strict))
    assert got == want
    assert Z.non_overlapping(t.limit(0), ["k"]).count() == 0


def test_ranks_of_times_are_exact(spark, monkeypatch):
    monkeypatch.setattr(Z, "RANGES", 7)
    rng = random.Random(2)
    values = [rng.randrange(-(2**62), 2**62) for _ in range(300)] + [2**62 + k for k in range(40)]
    t = spark.createDataFrame([(v,) for v in values + values[:50]] + [(None,)], "v long")
    order = sorted(set(values))
    ranks = [0, 1, 170, len(order) - 1, 10**6]
    assert Z.nth_values(t, "v", ranks) == [order[min(r, len(order) - 1)] for r in ranks]
    assert Z.nth_values(t.limit(0), "v", [0]) == [0]


def test_windows_keep_what_enters_and_ends_inside(spark):
    rows = [("x", k, k + 3, 1, k % 2 == 0) for k in range(40)] + [("x", 1, 2, None, True)]
    t = spark.createDataFrame(rows, "instrument string, entry_ns long, label_end_ns long, y int, aligned boolean")
    w = spark.createDataFrame([(0, 0, 20), (1, 20, 40)], "window int, start_ns long, end_ns long")
    got = sorted((r["window"], r["entry_ns"]) for r in Z.window_trades(t, w, ["instrument"], "aligned").collect())
    assert got == [(0, k) for k in (0, 4, 8, 12, 16)] + [(1, k) for k in (20, 24, 28, 32, 36)]
    every = sorted((r["window"], r["entry_ns"]) for r in Z.window_trades(t, w, ["instrument"]).collect())
    assert every == [(0, k) for k in (0, 4, 8, 12, 16)] + [(1, k) for k in (20, 24, 28, 32, 36)]


def points(n=600, width=4, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)).round(2)
    x[rng.random((n, width)) < 0.05] = np.nan
    z = np.nan_to_num(x)
    y = (z[:, 0] * z[:, 1] + 0.5 * z[:, 2] + rng.normal(scale=0.5, size=n) > 0).astype(int)
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(list(map(float, r)), int(v), k) for k, (r, v) in enumerate(zip(x, y))], "features array<double>, y int, k int").repartition(3)


def plain_boosting(b, y, c, rate, base):
    """Trees level by level over a whole matrix of bins."""
    margin = np.full(len(y), base)
    for _ in range(c.trees):
        leaf, leaves, open_ = np.zeros(len(y), int), 1, True
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        for _ in range(c.depth):
            found = []
            for q in range(leaves):
                rows = leaf == q
                whole = g[rows].sum() ** 2 / (h[rows].sum() + X.LAMBDA)
                best = None
                for f in range(b.shape[1]):
                    for cut in np.unique(b[rows, f]):
                        left, right = rows & (b[:, f] <= cut), rows & (b[:, f] > cut)
                        if min(left.sum(), right.sum()) < c.least:
                            continue
                        gain = sum(g[s].sum() ** 2 / (h[s].sum() + X.LAMBDA) for s in (left, right)) - whole
                        if gain > 1e-9 and (best is None or (round(gain, 9), -f, -cut) > best[:3]):
                            best = (round(gain, 9), -f, -cut, left, right)
                if best:
                    found.append((-best[0], q, best))
            room = c.leaves - leaves
            for _, q, best in sorted(found, key=lambda t: t[:2])[: max(0, room)]:
                leaf[best[4]] = leaves
                leaves += 1
            open_ = bool(found[: max(0, room)])
            if not open_:
                break
        for q in range(leaves):
            rows = leaf == q
            margin[rows] -= rate * g[rows].sum() / (h[rows].sum() + X.LAMBDA)
    return margin


def test_boosting_matches_plain_trees(spark, monkeypatch):
    monkeypatch.setattr(X, "KEEP", 2)
    x, y = points()
    candidates = [X.Boosted("small", 3, 2, 4, 20), X.Boosted("tight", 2, 3, 5, 40)]
    models = X.fit_boosted(frame(spark, x, y), candidates, bins=16, rate=0.3)
    scored = {r["k"]: r["margins"] for r in X.score(frame(spark, x, y), models).collect()}
    for c in candidates:
        m = models[c.name]
        b = np.stack([np.where(np.isnan(x[:, k]), 0, 1 + np.searchsorted(cut, x[:, k], "left")) for k, cut in enumerate(m["cuts"])], axis=1)
        want = plain_boosting(b, y, c, 0.3, m["base"])
        got = np.array([scored[k][c.name] for k in range(len(x))])
        assert len(m["trees"]) == c.trees and np.abs(got - want).max() < 1e-9


def test_boosting_learns_an_interaction(spark):
    x, y = points(1500)
    model = X.fit_boosted(frame(spark, x, y), [X.Boosted("m", 12, 4, 15, 20)], rate=0.3)
    brier = {r["name"]: r["brier"] for r in X.brier_by_model(X.score(frame(spark, x, y), model)).collect()}
    assert brier["m"] < 0.16 < 0.24 < np.mean((y.mean() - y) ** 2)


def test_logistic_regression_is_at_its_optimum(spark):
    x, y = points()
    x = np.nan_to_num(x)
    models = X.fit_logistic(frame(spark, x, y), {"weak": 0.1, "strong": 1.0})
    for name, c in (("weak", 0.1), ("strong", 1.0)):
        m = models[name]
        z = (x - m["mean"]) / m["scale"]
        p = 1 / (1 + np.exp(-(z @ m["weights"] + m["intercept"])))
        assert np.abs(c * z.T @ (p - y) + m["weights"]).max() < 1e-6 and abs((p - y).sum()) < 1e-6
    assert X.fit_logistic(frame(spark, x[:0], y[:0]), {"a": 1.0}) == {}


def test_search_prefers_the_smaller_name_and_measures_once(spark):
    x, y = points(900)
    rows = [("i", list(map(float, np.nan_to_num(f))), int(v), 10 * k, 10 * k + 5) for k, (f, v) in enumerate(zip(x, y))]
    t = spark.createDataFrame(rows, "instrument string, features array<double>, y int, entry_ns long, label_end_ns long")
    same = (X.Logistic("b", 1.0), X.Logistic("a", 1.0), X.Boosted("c", 2, 2, 3, 40))
    out = {(r["stage"], r["name"]): r for r in X.model_search(t, 100, ["instrument"], same).collect()}
    assert {k for k in out} >= {("selection", "a"), ("selection", "b"), ("selection", "c")}
    chosen = min((r["brier"], n) for (s, n), r in out.items() if s == "selection")[1]
    assert chosen != "b" and {s for s, n in out if n == chosen} == {"selection", "calibration", "test"}
    assert out["test", chosen]["n"] == len([k for k in range(900) if 10 * k >= 6750 + 100])
    assert X.model_search(t.limit(0), 100, ["instrument"], same).count() == 0
