"""Quality classifier: Bradley-Terry scores from preference pairs.

A document of quality 1 is preferred to one of quality 0. Scores are linear in features
of the whole text; weights minimise the logistic loss on feature differences of such
pairs (Newton's method with a ridge). Rejected is what scores below a quantile of the
training scores: the share of quality 0 among them. Scores are mapped to 0..1 by a
logistic curve that passes ``THRESHOLD`` at that quantile.

The fit uses at most ``MAX_LABELLED`` labelled rows (those whose ids have the smallest
hashes), which bounds the broadcast of labels and what the driver gets, at any size of the
corpus. Scoring is a function of one text and needs no shuffle.

Cases: null text counts as empty, and empty texts get a score; labels that are null or
whose document is missing are ignored; an id that is labelled twice counts twice; with no
labels of one kind every document scores 0.5. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_crc, read_table

THRESHOLD = 0.3
MAX_LABELLED = 20_000
PAIRS = 8
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Sums of the byte histogram: groups of bytes, then single punctuation marks.
GROUPS = [range(97, 123), range(65, 91), range(48, 58), [32], [10], [9, 11, 12, 13], range(128, 256)] + [[c] for c in PUNCTUATION]
_SUMS = np.zeros((256, len(GROUPS)))
for _k, _g in enumerate(GROUPS):
    _SUMS[list(_g), _k] = 1


def features(texts) -> np.ndarray:
    """A row of features for each text: shares of byte groups, and how much repeats."""
    hist = np.zeros((len(texts), 256))
    rest = np.zeros((len(texts), 8))
    for k, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        hist[k] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        words, lines = raw.split(), raw.split(b"\n")
        n, distinct = len(words), len(set(words))
        same = sum(map(bytes.__eq__, words[1:], words)) if distinct * 2 < n else 0
        rest[k] = (
            np.log1p(len(raw)), np.log1p(n), len(raw) / (n + 1), (n - distinct) / (n + 1), same / (n + 1),
            1 - len(set(lines)) / len(lines), n / len(lines), raw.isupper(),
        )
    size = hist.sum(axis=1, keepdims=True) + 1
    shares = (hist @ _SUMS) / size
    rest[:, 2] = np.log1p(rest[:, 2])
    rest[:, 6] = np.log1p(rest[:, 6])
    return np.hstack([np.log1p(100 * shares), rest])


def _newton(x: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    """Weights that minimise the mean of log(1 + exp(-x w)) plus ridge |w|^2 / 2."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(x @ w, -30, 30)))
        grad = -(x * p[:, None]).mean(axis=0) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(x: np.ndarray, good: np.ndarray, ridge: float = 1e-3, pairs: int = PAIRS, seed: int = 6) -> dict | None:
    """The model for feature rows ``x``; ``good`` marks those of quality 1."""
    up, down = x[good], x[~good]
    if not len(up) or not len(down):
        return None
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    rng = np.random.default_rng(seed)
    many, few = (up, down) if len(up) >= len(down) else (down, up)
    left, right = rng.integers(len(many), size=pairs * len(few)), np.repeat(np.arange(len(few)), pairs)
    diff = (many[left] - few[right]) / scale * (1 if many is up else -1)
    w = _newton(np.clip(diff, -20, 20), ridge)
    scores = (x - mean) / scale @ w
    cut = float(np.quantile(scores, 1 - good.mean()))
    # one slope maps scores to chances, with THRESHOLD at the cut
    base, y, slope = np.log(THRESHOLD / (1 - THRESHOLD)), good.astype(float), 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * (scores - cut) + base, -30, 30)))
        grad = ((p - y) * (scores - cut)).mean() + 1e-3 * slope
        slope -= np.clip(grad / ((p * (1 - p) * (scores - cut) ** 2).mean() + 1e-3), -1, 1)
    return {"mean": mean, "scale": scale, "w": w, "cut": cut, "slope": max(float(slope), 1e-3), "base": float(base)}


def score(model: dict | None, texts) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    s = (features(texts) - model["mean"]) / model["scale"] @ model["w"]
    return 1 / (1 + np.exp(-np.clip(model["slope"] * (s - model["cut"]) + model["base"], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> dict | None:
    """Fit on at most ``max_labelled`` labelled rows of the training part."""
    some = (
        labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(id_crc("doc_id") % 5 != 0)
        .select(F.col("doc_id").alias("__id"), F.col("quality").alias("__good"))
        .orderBy(F.xxhash64("__id"), "__id", "__good").limit(max_labelled)
    )
    texts = docs.select(F.col("doc_id").alias("__id"), "text").join(F.broadcast(some), "__id").select("text", "__good")  # max_labelled rows

    def rows(frames):
        for f in frames:
            yield pd.DataFrame({"x": list(features(f["text"])), "good": f["__good"] == 1})

    got = texts.mapInPandas(rows, "x array<double>, good boolean").toPandas()
    if not len(got):
        return None
    order = np.lexsort(np.stack(got["x"].to_numpy()).T)  # the same fit in whatever order rows come
    return fit(np.stack(got["x"].to_numpy())[order], got["good"].to_numpy(dtype=bool)[order])


def scorer(model: dict | None, text: Column) -> Column:
    @F.pandas_udf("double")
    def quality(texts: pd.Series) -> pd.Series:
        return pd.Series(score(model, texts))

    return quality(text)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", (id_crc("doc_id") % 5 == 0).alias("held_out"), scorer(model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go."""
    model = train(docs, read_table(spark, sf_dir, "labels"))
    cols = docs.columns
    return docs.withColumn("__score", scorer(model, F.col("text"))).filter(F.col("__score") >= THRESHOLD).select(*cols)
