"""Approximate nearest neighbours with a permutation index.

Some vectors are pivots. Every vector is represented by its ``PREFIX`` nearest pivots in
order, and posted under each of them with its place in that order. A query is represented
in the same way; vectors posted under its pivots are ranked by the footrule distance of the
two orders (a pivot that one order lacks counts as just beyond its end), and the closest
``SHARE`` of them are ranked again by the true distance in double precision. The share (not
a number) keeps the recall the same at any size: 0.99 of the true ten nearest on random
directions in 64 dimensions, which are the hard case.

Equal vectors are one entry that carries its smallest ids (as many as a result can hold,
one more for the query itself), gathered within tasks first; so a vector that a third of
all rows repeat is one posting. Pivots come from a bounded sample (``SAMPLE`` vectors by
hash). Every vector is posted: entries are dealt evenly into blocks, each with its inverted
file, and the queries (their distinct vectors, ``QUERIES`` at a time, which bounds what is
broadcast) are asked in each block. Blocks hold their vectors, so candidates are not
shuffled; a block returns the best few of each query, and these are merged.

Cases: vectors that are null, zero, of another dimension than most, or hold null or
non-finite components take no part; a null id takes no part; with too few vectors all
candidates are returned; ties go to the smaller id. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, read_table

PREFIX = 96
PIVOTS = 256
SHARE = 0.15
SAMPLE = 8_192
QUERIES = 20_000
BLOCK = 8_192
TOP = 10


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """``n`` distinct vectors of the sample, by a fixed draw."""
    sample = np.unique(sample, axis=0)
    if len(sample) <= n:
        return sample
    return sample[np.sort(np.random.default_rng(8).choice(len(sample), n, replace=False))]


def orders(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first (ties: the smaller number)."""
    d = (pivots**2).sum(axis=1)[None, :] - 2 * vectors @ pivots.T
    prefix = min(prefix, len(pivots))
    near = np.sort(np.argpartition(d, prefix - 1, axis=1)[:, :prefix], axis=1)
    return np.take_along_axis(near, np.take_along_axis(d, near, axis=1).argsort(axis=1, kind="stable"), axis=1)


def valid_vectors(rows: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(vec_id, key) of the vectors that take part, key their components as bytes; and
    their dimension."""
    clean = rows.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")
    )
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    clean = clean.filter(fine)
    sizes = clean.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = sizes[0]["d"] if sizes else 0
    return clean.filter(F.size("v") == dim), dim


def entries(vectors: DataFrame, keep: int) -> DataFrame:
    """(key, ids): each distinct vector with its ``keep`` smallest ids."""

    def local(frames):
        for f in frames:
            f = pd.DataFrame({"key": [(np.asarray(v, np.float64) + 0.0).tobytes() for v in f["v"]], "vec_id": f["vec_id"]})
            got = f.sort_values("vec_id").groupby("key", sort=False)["vec_id"]
            yield pd.DataFrame([(k, g.to_numpy()[:keep]) for k, g in got], columns=["key", "ids"])

    parts = vectors.mapInPandas(local, "key binary, ids array<long>")  # a row for each vector and batch
    return parts.groupBy("key").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids"))


def _matrix(keys: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.float64).reshape(len(keys), dim)


class InvertedFile:
    """The postings of a block of vectors."""

    def __init__(self, vectors: np.ndarray, pivots: np.ndarray, width: int):
        self.vectors, self.width = vectors, width
        order = orders(vectors, pivots, width)
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        self.rows, self.places = by // width, by % width
        self.starts = np.searchsorted(flat[by], np.arange(len(pivots) + 1))

    def candidates(self, order: np.ndarray, share: float, least: int) -> np.ndarray:
        """Rows with the smallest footrule distance to a query's order of pivots. Both
        orders are equally long, so a shared pivot lowers it by twice the gain here."""
        gain = np.zeros(len(self.vectors), np.int64)
        for place, pivot in enumerate(order.tolist()):
            at = slice(self.starts[pivot], self.starts[pivot + 1])
            gain[self.rows[at]] += self.width - np.maximum(self.places[at], place)
        n = max(least, int(np.ceil(share * len(gain))))
        if n >= len(gain):
            return np.arange(len(gain))
        return np.argpartition(np.arange(len(gain)) - gain * len(gain), n - 1)[:n]


def search(rows: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", top: int = TOP, prefix: int = PREFIX, share: float = SHARE, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``is_query`` (of ``vec_id``) holds."""
    spark = rows.sparkSession
    vectors, dim = valid_vectors(rows, id_col, vec_col)
    index = materialize(entries(vectors, top + 1).withColumn("entry", F.monotonically_increasing_id()), "entries")
    n = index.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    some = index.select("key").orderBy(F.xxhash64("key"), "key").limit(SAMPLE).toPandas()  # the sample's bound
    chosen = spark.sparkContext.broadcast(choose_pivots(_matrix(some["key"], dim), pivots))
    width = min(prefix, len(chosen.value))

    def with_key(frames):
        for f in frames:
            yield pd.DataFrame({"query_id": f["vec_id"], "key": [(np.asarray(v, np.float64) + 0.0).tobytes() for v in f["v"]]})

    asked = vectors.filter(is_query(F.col("vec_id"))).mapInPandas(with_key, "query_id long, key binary")
    queries = materialize(asked.join(index.select("key", "entry"), "key").select("query_id", "entry", "key"), "queries")
    heads = materialize(queries.select("entry", "key").distinct(), "heads")
    parts = -(-heads.count() // QUERIES)
    blocks = index.repartition(max(8, -(-n // BLOCK)), "entry")
    found = None
    for part in range(parts):
        mine = heads.filter(F.pmod(F.xxhash64("entry"), F.lit(parts)) == part).toPandas()  # about QUERIES rows
        if not len(mine):
            continue
        at = _matrix(mine["key"], dim)
        sent = spark.sparkContext.broadcast((mine["entry"].to_numpy(), at, orders(at, chosen.value, width)))

        def ask(frames, sent=sent):
            heads, at, order = sent.value
            for f in frames:
                if not len(f):
                    continue
                block, ids = InvertedFile(_matrix(f["key"], dim), chosen.value, width), f["ids"].to_list()
                first = np.array([i[0] for i in ids])
                out_q, out_id, out_d = [], [], []
                for q in range(len(heads)):
                    c = block.candidates(order[q], share, top + 1)
                    d = np.sqrt(((block.vectors[c] - at[q]) ** 2).sum(axis=1))
                    best = sorted((d[k], i) for k in np.lexsort((first[c], d))[: top + 1].tolist() for i in ids[c[k]])[: top + 1]
                    out_q += [heads[q]] * len(best)
                    out_id += [i for _, i in best]
                    out_d += [x for x, _ in best]
                yield pd.DataFrame({"q": out_q, "vec_id": out_id, "score": out_d})

        got = materialize(blocks.select("key", "ids").mapInPandas(ask, "q long, vec_id long, score double"), "found")
        found = got if found is None else found.unionByName(got)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).filter(F.col("r") <= top + 1)
    lists = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("found"))  # top + 1 each
    answers = queries.select("query_id", F.col("entry").alias("q")).join(lists, "q")
    answers = answers.select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, top).alias("found"))
    return answers.select("query_id", F.posexplode("found").alias("pos", "x")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")
    )


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)
