"""Draws by leaps and models of classes, each against a loop that follows its definition."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaymark.operators import decisions as D
from quaymark.operators import resample as H
from quaymark.operators import stats as S
from quaymark.plans import model_queries


def sequence(seed):
    state = seed
    while True:
        state = (state * 1664525 + 1013904223) % 2**32
        yield state / 2**32


def test_draws_by_leaps_are_those_of_the_sequence(spark):
    for seed in (0, 1, 20261014, 2**32 - 1):
        steps = sequence(seed)
        want = [next(steps) for _ in range(3000)]
        got = [r["d"] for r in spark.range(1, 3001).select("id", H.draw(seed, F.col("id")).alias("d")).orderBy("id").collect()]
        assert got == want
    state, a, c, place = 7, 1664525, 1013904223, 123_456_789_012
    for j in range(40):  # by squaring
        state = (a * state + c) % 2**32 if place >> j & 1 else state
        a, c = a * a % 2**32, (a * c + c) % 2**32
    assert spark.range(1).select(H.draw(7, F.lit(place))).first()[0] == state / 2**32


def values(spark):
    rng = random.Random(5)
    rows = [(key, n, rng.gauss(0.1, 1)) for key, size in (("a", 45), ("b", 31), (None, 20), ("one", 1), ("two", 2)) for n in range(size)]
    rows += [("a", 999, None), ("a", 998, math.nan), ("a", 997, math.inf), ("empty", 1, None)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, entry_ns long, net_r double")


def of(rows, key):
    return [v for k, _, v in sorted(rows, key=lambda r: r[1]) if k == key and v is not None and math.isfinite(v)]


def test_core_interval_is_that_of_a_loop(spark):
    rows, t = values(spark)
    got = {r["k"]: (r["n"], r["low"], r["high"]) for r in H.core_interval(t, ["k"], reps=120).collect()}
    for key in ("a", "b", None, "two"):
        x, draws, means = of(rows, key), sequence(20261014), []
        for _ in range(120):
            places = [math.floor(next(draws) * len(x)) for _ in x]
            numbers = [next(draws) for _ in x]
            for i in range(1, len(x)):
                if numbers[i] > 1 / 3:
                    places[i] = (places[i - 1] + 1) % len(x)
            means.append(sum(x[p] for p in places) / len(x))
        means.sort()
        assert got[key] == (len(x), pytest.approx(means[math.floor(119 * 0.025)], abs=1e-12), pytest.approx(means[math.floor(119 * 0.975)], abs=1e-12))
    assert got["one"] == (1, None, None) and "empty" not in got
    assert H.core_interval(t.limit(0), ["k"]).count() == 0


def test_draws_are_never_broadcast(spark):
    _, t = values(spark)
    for way in (H.moving_blocks, H.core_interval):
        plan = way(t, ["k"])._jdf.queryExecution()
        draws = [line for line in plan.sparkPlan().toString().splitlines() if "Join" in line and "#" in line and " i#" in line.replace("[i#", " i#")]
        assert draws and all("SortMergeJoin" in line for line in draws)


def test_moving_blocks_are_those_of_a_loop(spark):
    rows, t = values(spark)
    got = {r["k"]: (r["n"], r["low"], r["high"]) for r in H.moving_blocks(t, ["k"], reps=100).collect()}
    for key in ("a", "b", None):
        x, draws, means = of(rows, key), sequence(20261013), []
        for _ in range(100):
            taken = []
            while len(taken) < len(x):
                at = math.floor(next(draws) * len(x))
                taken += [x[(at + j) % len(x)] for j in range(min(3, len(x) - len(taken)))]
            means.append(sum(taken) / len(x))
        means.sort()
        assert got[key] == (len(x), pytest.approx(means[2], abs=1e-12), pytest.approx(means[97], abs=1e-12))
    assert got["two"] == (2, None, None)


def test_stationary_bootstrap_draws_in_order(spark):
    rows, t = values(spark)
    got = {r["k"]: r for r in S.stationary_bootstrap(t, ["k"], reps=60).collect()}
    x = np.array(of(rows, "a"))
    rng, means = np.random.default_rng(71421), []
    for _ in range(60):
        picks = [int(rng.integers(len(x)))]
        while len(picks) < len(x):
            picks.append(int(rng.integers(len(x))) if rng.random() < 0.25 else (picks[-1] + 1) % len(x))
        means.append(x[picks].mean())
    assert [got["a"]["low"], got["a"]["high"]] == [float(q) for q in np.quantile(means, [0.025, 0.975])]
    assert got["one"]["low"] is None


# -- models of classes ----------------------------------------------------------------------


def sample(n=90, d=3, seed=1):
    rng = np.random.default_rng(seed)
    x = np.clip(rng.normal(size=(n, d)).round(1), -5, 5)
    y = np.where(x[:, 0] > 0.5, 0, np.where(x[:, 1] > 0.3, 1, 2))
    return x, y


def soft(z):
    top = max(z)
    e = [math.exp(v - top) for v in z]
    return [v / sum(e) for v in e]


def test_softmax_weights_follow_plain_steps():
    x, y = sample()
    share = [float((y == k).mean()) for k in range(3)]
    w = [[math.log(share[k]), 0.0, 0.0, 0.0] for k in range(3)]
    for step in range(30):
        g = [[0.0] * 4 for _ in range(3)]
        for row, label in zip(x, y):
            v = [1.0, *row]
            p = soft([sum(a * b for a, b in zip(w[k], v)) for k in range(3)])
            for k in range(3):
                for j in range(4):
                    g[k][j] += (p[k] - (label == k)) * v[j]
        for k in range(3):
            for j in range(4):
                w[k][j] -= 0.12 / (1 + step / 400) * (g[k][j] / len(x) + (0.01 * w[k][j] if j else 0))
    got = S.fit_softmax(x, y, 3, steps=30)
    want = np.array(w).T
    assert np.abs(got - np.vstack([want[1:], want[:1]])).max() < 1e-12


def test_seeded_numbers_by_unsigned_arithmetic():
    u = lambda v: np.uint32(v % 2**32)
    state, want = 137799, []
    with np.errstate(over="ignore"):
        for _ in range(50):
            state = (state + 0x6D2B79F5) % 2**32
            t = u(state)
            t = (t ^ (t >> np.uint32(15))) * (t | np.uint32(1))
            t = t ^ (t + (t ^ (t >> np.uint32(7))) * (t | np.uint32(61)))
            want.append(int(t ^ (t >> np.uint32(14))) / 2**32)
    assert S.seeded_uniform(137799, 50).tolist() == want


def test_network_starts_and_steps_as_defined():
    x, y = sample(40)
    start = S.fit_network(x, y, 3, hidden=2, steps=0)
    u = 2 * S.seeded_uniform(137799, 12) - 1
    assert start[0][2, 1] == u[1 * 3 + 2] * math.sqrt(6 / 5) and start[2][1, 2] == u[6 + 2 * 2 + 1] * math.sqrt(6 / 5)
    assert np.allclose(start[3], [math.log((y == k).mean()) for k in range(3)])

    def loss(p):
        z = S.network_scores(p, x)
        q = np.exp(z - z.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        return -np.log(q[np.arange(len(y)), y]).mean() + 0.005 * ((p[0] ** 2).sum() + (p[2] ** 2).sum())

    after = S.fit_network(x, y, 3, hidden=2, steps=1)
    for k in range(4):  # the first step of Adam is the rate, against the sign of the gradient
        for at in np.ndindex(start[k].shape):
            up = [q.copy() for q in start]
            up[k][at] += 1e-6
            slope = (loss(up) - loss(start)) / 1e-6
            if abs(slope) > 1e-4:
                assert after[k][at] - start[k][at] == pytest.approx(-0.015 * np.sign(slope), rel=1e-3)


def test_stumps_follow_plain_rounds():
    x, y = sample(80)
    base, got = S.fit_stumps(x, y, 3, rounds=4)
    n, logits = len(x), [[math.log((y == k).mean()) for k in range(3)] for _ in x]
    assert base == pytest.approx(logits[0])
    splits = []
    for j in range(3):
        v, used = sorted(x[:, j]), set()
        for q in range(1, 8):
            at = math.floor(n * q / 8)
            while at < n and at > 0 and v[at] == v[at - 1]:
                at += 1
            if at < 12 or n - at < 12 or at in used:
                continue
            used.add(at)
            splits.append((j, (v[at - 1] + v[at]) / 2))
    want = []
    for _ in range(4):
        p = [soft(z) for z in logits]
        for k in range(3):
            g = [(y[i] == k) - p[i][k] for i in range(n)]
            h = [max(1e-8, p[i][k] * (1 - p[i][k])) for i in range(n)]
            best, gain = (-1, 0.0, sum(g) / (sum(h) + 1), sum(g) / (sum(h) + 1)), sum(g) ** 2 / (sum(h) + 1)
            for j, c in splits:
                side = [i for i in range(n) if x[i, j] <= c]
                a, b = sum(g[i] for i in side), sum(h[i] for i in side)
                one = a * a / (b + 1) + (sum(g) - a) ** 2 / (sum(h) - b + 1)
                if one > gain + 1e-12:
                    best, gain = (j, c, a / (b + 1), (sum(g) - a) / (sum(h) - b + 1)), one
            left, right = (0.08 * max(-2, min(2, v)) for v in best[2:])
            want.append((k, best[0], best[1], left, right))
            for i in range(n):
                logits[i][k] += left if best[0] < 0 or x[i, best[0]] <= best[1] else right
    assert [t[:2] for t in got] == [t[:2] for t in want]
    assert np.abs(np.array([t[2:] for t in got]) - np.array([t[2:] for t in want])).max() < 1e-9
    assert np.abs(S.stump_values((base, got), x) - np.array(logits)).max() < 1e-9


def test_neighbour_votes_by_a_loop(spark):
    x, y = sample(60)
    share = np.bincount(y, minlength=3) / 60
    queries = np.vstack([x[:5] + 0.05, x[:2]])
    for q, got in zip(queries, S.neighbour_votes(x, y, share, queries, 15)):
        near = sorted(range(60), key=lambda i: (math.dist(q, x[i]), i))[:15]
        w = [1 / (1 + math.dist(q, x[i])) for i in near]
        votes = [sum(a for a, i in zip(w, near) if y[i] == k) / sum(w) * 15 for k in range(3)]
        assert got == pytest.approx([(votes[k] + 3 * share[k]) / 18 for k in range(3)])
    rows = [(k, list(map(float, r * [10, 1, 100])), int(v)) for k, (r, v) in enumerate(zip(x, y))]
    t = spark.createDataFrame(rows, "id long, features array<double>, class int")
    got = {r["id"]: r["p"] for r in S.nearest_classes(t, t.filter("id < 5"), 15).collect()}
    z = np.clip((x - x.mean(axis=0)) / x.std(axis=0), -5, 5)  # scales do not count
    assert all(got[k] == pytest.approx(S.neighbour_votes(z, y, share, z[k : k + 1], 15)[0], abs=1e-9) for k in range(5))


def test_intercepts_follow_plain_steps():
    rng = np.random.default_rng(2)
    p = rng.dirichlet([2, 2, 2], 70)
    y = np.array([2] * 50 + [0] * 15 + [1] * 5)
    bias = [0.0, 0.0, 0.0]
    for _ in range(300):
        g = [0.0] * 3
        for row, label in zip(p, y):
            q = soft([math.log(v) + b for v, b in zip(row, bias)])
            for k in range(3):
                g[k] += q[k] - (label == k)
        bias = [b - 0.2 * (v / 70 + 0.02 * b) for b, v in zip(bias, g)]
        bias = [b - sum(bias) / 3 for b in bias]
    got = D.fit_intercepts(p, y)
    assert got == pytest.approx(bias) and D.brier(D.adjusted(p, got), y) < D.brier(p, y)
    assert D.fit_intercepts(p[:49], y[:49]) is None


def test_the_earlier_of_equal_candidates_is_chosen(monkeypatch):
    n = 800
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(n, 2)), rng.integers(0, 3, n)
    flat = lambda v: np.full((len(v), 3), 1 / 3)
    worse = lambda v: np.tile([0.8, 0.1, 0.1], (len(v), 1))
    monkeypatch.setattr(D, "candidates", lambda x, y: iter([("a", None, worse, False), ("b", 1.0, flat, False), ("c", 2.0, flat, False)]))
    out = D.choose("i", np.arange(n), np.arange(n) + 4, x, y, n)
    assert [(r[2], r[8]) for r in out] == [("a", False), ("b", True), ("c", False)]
    assert out[1][5] == len([k for k in range(n) if k >= 404 and k + 4 < 600]) and out[1][11] == 196
    assert D.choose("i", np.arange(100), np.arange(100) + 4, x[:100], y[:100], 100) == []


def test_plans_of_class_samples_stay_small(spark):
    plan = model_queries.class_samples(spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "Join" in plan and "Union" not in plan  # the features are made once


def test_class_models_keep_the_newest_history(spark):
    x, y = sample(700, 4, 9)
    rows = [("i", k, 700, list(map(float, x[k])), D.CLASSES[y[k]] if k % 50 else None) for k in range(700)] + [("few", k, 9, [0.0] * 4, "UP") for k in range(9)]
    t = spark.createDataFrame(rows, "instrument string, bar int, bars int, features array<double>, class string")
    out = D.class_models(t, history=600).orderBy("place").collect()
    assert [r["place"] for r in out] == list(range(12)) and sum(r["selected"] for r in out) == 1
    top = next(r for r in out if r["selected"])
    assert top["brier"] == min(r["brier"] for r in out) and top["test_accuracy"] > 0.8
    assert D.class_models(t.limit(0)).count() == 0
