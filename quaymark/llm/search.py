"""Ranked lexical search of many queries at once, by shared partial sums.

The items are the stated queries. They are dealt into blocks; the items of a block share
terms, and a shared set of terms costs one accumulator a document instead of one an item:

1. *Mining.* In a block, the two operands (terms or earlier sums) that most items have in
   common become a new operand, their sum, and take their place in those items; this is
   repeated until no two are shared by ``SHARED`` items. Every step is a node of a DAG whose
   leaves are terms; an item is the sum of the operands left in it.
2. *Frequencies.* Documents are read once a block. A task keeps of each document its number
   of terms and the frequencies of the block's terms, written as a table; document
   frequencies and totals are Spark sums over it.
3. *Accumulators.* A task takes a slice of documents, computes one contribution for each
   term, follows the DAG in order so that every shared sum is made once for the slice, and
   adds the operands of each item. Of each item it keeps its own best, so that what leaves a
   task is items x ``top`` rows; these meet in two steps, never all in one group.

All scores are 64-bit integers, so the order of the sums cannot change a result. No document
or item is left out; only the report is cut to ``top``.

Cases: null or term-less texts count in nothing and are never found. An item without terms
(or whose terms no document holds) has no rows. Equal scores are ranked by id, null ids last,
then by row; repeated rows are ranked separately. Items with equal or null ids are separate
queries. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, read_table

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Items of one block (one pass over the documents), and items that make a sum worth its node.
BLOCK, SHARED = 512, 2
#: Documents of one slice of accumulators.
SLICE = 1024
TOP = 10
_terms = re.compile(TERM).findall
_LOWER = {c: c + 32 for c in range(65, 91)}


def terms_of(text: str | None) -> list[str]:
    """The terms of a text in order; only A-Z are lower-cased."""
    return _terms((text or "").translate(_LOWER))


def share_sums(sets: list[list[int]], n_terms: int, least: int = SHARED) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """The DAG of shared sums of these term sets: nodes (numbered from ``n_terms`` on) as
    pairs of earlier operands, and for each set the operands whose sum it is."""
    use = np.zeros((n_terms, len(sets)), dtype=np.float32)
    for k, members in enumerate(sets):
        use[members, k] = 1
    wide = np.flatnonzero(use.sum(axis=1) >= least)  # others are shared by no two sets
    rest = [sorted(set(members) - set(wide.tolist())) for members in sets]
    use, names, nodes = use[wide], wide.tolist(), []
    both = use @ use.T
    np.fill_diagonal(both, 0)
    while both.size:
        a, b = divmod(int(both.argmax()), len(names))
        if both[a, b] < least:
            break
        common = use[a] * use[b]
        use[a] -= common
        use[b] -= common
        use = np.vstack([use, common])
        names.append(n_terms + len(nodes))
        nodes.append((names[a], names[b]))
        grown = np.zeros((len(names), len(names)), dtype=np.float32)
        grown[:-1, :-1] = both
        for row in (a, b, len(names) - 1):
            grown[row] = grown[:, row] = use @ use[row]
            grown[row, row] = 0
        both = grown
        gone = [r for r in (a, b) if not use[r].any()]
        if gone:  # used up: nothing shares it any more
            kept = np.setdiff1d(np.arange(len(names)), gone)
            both, use, names = both[np.ix_(kept, kept)], use[kept], [names[r] for r in kept]
    for row, name in enumerate(names):
        for k in np.flatnonzero(use[row]):
            rest[k].append(name)
    return nodes, rest


def _frequencies(words: dict[str, int]):
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lengths, found, times = [], [], []
            for text in frame["text"]:
                terms = terms_of(text)
                known = Counter(map(words.get, terms))
                known.pop(None, None)
                lengths.append(len(terms))
                found.append(np.fromiter(known.keys(), np.int32, len(known)))
                times.append(np.fromiter(known.values(), np.int64, len(known)))
            yield pd.DataFrame({"row_id": frame["row_id"], "id": frame["id"], "n": lengths, "terms": found, "times": times})

    return count


def _scores(weights: np.ndarray, nodes: list[tuple[int, int]], sums: list[list[int]], n_docs: int, total: int, top: int):
    """Each task's best documents of every item."""

    def rank(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[tuple] = [()] * len(sums)  # scores, null marks, ids, rows; best first
        for frame in frames:
            for begin in range(0, len(frame), SLICE):
                part = frame.iloc[begin : begin + SLICE]
                size = np.array([len(t) for t in part["terms"]])
                where, term = np.repeat(np.arange(len(part)), size), np.concatenate([*part["terms"], np.empty(0, np.int32)]).astype(np.int64)
                times = np.concatenate([*part["times"], np.empty(0, np.int64)]).astype(np.int64)
                m = 10 + (90 * part["n"].to_numpy(np.int64) * n_docs) // total
                value = weights[term] * ((1_000_000_000 * times) // (1000 * times + 8 * m[where]))
                acc = np.zeros((len(weights) + len(nodes), len(part)), dtype=np.int64)
                acc[term, where] = value
                for k, (a, b) in enumerate(nodes, len(weights)):
                    np.add(acc[a], acc[b], out=acc[k])
                unknown = part["id"].isna().to_numpy()
                ids, rows = part["id"].fillna(0).to_numpy(np.int64), part["row_id"].to_numpy(np.int64)
                for item, operands in enumerate(sums):
                    score = acc[operands].sum(axis=0)
                    at = np.flatnonzero(score > (best[item][0][-1] - 1 if best[item] and len(best[item][0]) == top else 0))
                    if not len(at):
                        continue
                    new = (score[at], unknown[at], ids[at], rows[at])
                    both = tuple(np.concatenate(x) for x in zip(best[item], new)) if best[item] else new
                    order = np.lexsort((both[3], both[2], both[1], -both[0]))[:top]
                    best[item] = tuple(x[order] for x in both)
        for item, found in enumerate(best):
            if found:
                yield pd.DataFrame({"item": np.int32(item), "score": found[0], "row_id": found[3], "id": pd.Series(found[2], dtype="Int64").mask(found[1])})

    return rank


def lexical_search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """Each item's ``top`` documents: item id, ``rank``, document id, ``score``."""
    spark = docs.sparkSession
    texts = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    asked = materialize(items.select(F.monotonically_increasing_id().alias("item_row"), F.col(item_col).alias("item_name"), F.col(item_text).alias("text")), "items")
    blocks = max(1, math.ceil(asked.count() / block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_row"), F.lit(blocks)))
    found = None
    for k in range(blocks):
        # the stated queries of one block, about BLOCK of them: a bounded part of the items
        rows = asked.filter(F.col("block") == k).orderBy("item_row").collect()
        sets = [sorted(set(terms_of(r["text"]))) for r in rows]
        words = {t: n for n, t in enumerate(sorted(set().union(*sets)))}
        if not words:
            continue
        nodes, sums = share_sums([[words[t] for t in s] for s in sets], len(words))
        tf = materialize(texts.mapInPandas(_frequencies(words), "row_id long, id long, n long, terms array<int>, times array<long>"), "frequencies")
        counted = tf.filter("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("total")).first()
        if not counted["docs"]:
            continue
        df = tf.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        weighed = df.select("term", F.floor(1000 * F.log((2.0 * counted["docs"] + 2) / (2 * F.col("df") + 1))).cast("long").alias("w"))
        weights = np.zeros(len(words), dtype=np.int64)
        for r in weighed.collect():  # at most one row for each term of the block's items
            weights[r["term"]] = r["w"]
        best = tf.filter(F.size("terms") > 0).mapInPandas(
            _scores(weights, nodes, sums, counted["docs"], counted["total"], top), "item int, score long, row_id long, id long"
        )
        order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row_id")]
        part = Window.partitionBy("item", F.pmod(F.xxhash64("row_id"), F.lit(64))).orderBy(*order)
        best = best.withColumn("r", F.row_number().over(part)).filter(F.col("r") <= top)
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top)
        names = spark.createDataFrame([(n, r["item_name"]) for n, r in enumerate(rows)], f"item int, item_name {dict(asked.dtypes)['item_name']}")
        done = best.join(F.broadcast(names), "item").select(F.col("item_name").alias(item_col), "rank", F.col("id").alias(id_col), "score")
        done = materialize(done, "ranked") if blocks > 1 else done
        found = done if found is None else found.unionByName(done)
    if found is None:
        return spark.createDataFrame([], f"{item_col} {dict(asked.dtypes)['item_name']}, rank int, {id_col} long, score long")
    return found


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
g AS (SELECT count(*) AS n_docs, sum(len(ts)) AS total FROM d WHERE len(ts) > 0),
tf AS (
  SELECT doc_id, n, term, count(*) AS f
  FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, g GROUP BY term, n_docs),
s AS (
  SELECT item_id, doc_id,
         CAST(sum(w * ((1000000000 * f) // (1000 * f + 8 * (100 - 90 + ((90 * n * n_docs) // total))))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), g GROUP BY item_id, doc_id),
r AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""
