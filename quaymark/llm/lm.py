"""Language-model scoring with a hashed maximum-entropy model.

The softmax is factored by classes: P(w | h) = P(c | h) * P(s | c, h) * P(w | c, s). The class
c of a token follows from its last letters (the ``OWN`` most frequent tokens have classes of
their own), its part s of the class from its hash. The first two factors are maximum-entropy
models over hashed features of the history, n-grams and skip-grams: for the class a bias, the
last token, the last two, the second last and the third last; for the part the class alone,
with the last token and with the second last. P(w | c, s) is the token's share of the
training counts of its part, one added for each token and one for all unknown ones, so the
whole sums to one.

Texts are read once. Each task writes its documents in chunks of about ``CHUNK`` tokens: the
distinct tokens of the chunk (as 64-bit hashes, which stand for them from here on, with
their training counts and endings) and each document's tokens as numbers in that list.
Counts cover all training documents: the lists are summed up by hash in one shuffle, which
has a token once a chunk, so a frequent token is no hot key, and go back to their chunks.

Training is distributed gradient descent: in each round every task takes Adagrad steps over
its share of the round's chunks, starting from the same weights; the weights are then
averaged by tokens (in blocks of the table, in Spark), and only the table, of fixed size,
comes to the driver. Every training document is in one round. Scoring is one pass over
the chunks, each with its counts.

Cases: null text is the empty text, whose only token is the end; rows with null or repeated
ids are separate documents; without training documents all counts are 0; a text longer than
a chunk is a chunk of its own. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_crc, materialize, read_table

END = b"\n"  # no word holds a line feed
CLASSES = 32
OWN = 12
PARTS = 16
BITS = 13
FEATURES = 1 << BITS
ROUNDS = 2
BATCH = 8192
RATE = 0.5
BLOCK = 512
CHUNK = 1_000_000


def words(raw: bytes | None) -> list[bytes]:
    """Tokens of a text in UTF-8: A-Z lower-cased, split at white space, one end."""
    out = (raw or b"").lower().split()
    out.append(END)
    return out


def token_hash(token: bytes) -> int:
    """The 64-bit hash that stands for a token, as a signed number."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(token)).view(np.int64))


def ending(token: bytes) -> int:
    """The class of a token that has no class of its own, by its last letters."""
    stem = token.rstrip(b".,!?;:")
    return OWN + zlib.crc32(stem[-2:] + (b"," if len(stem) < len(token) else b"")) % (CLASSES - OWN)


def _slot(x: np.ndarray, kind: int, low: int) -> np.ndarray:
    """Table rows ``low`` and up of hashed features."""
    h = (x + np.uint32(kind * 0x9E3779B9 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35)
    return np.maximum((h >> np.uint32(32 - BITS)).astype(np.uint16), np.uint16(low))


def features(h: np.ndarray, place: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the class model and of the part model for each token: ``h`` are 32 bits
    of the tokens' hashes, ``place`` their places in their documents."""
    back = []
    for k in (1, 2, 3):
        past = np.full(len(h), 7 + k, np.uint32)
        past[k:] = np.where(place[k:] >= k, h[:-k], np.uint32(7 + k))
        back.append(past)
    one, two, three = back
    c = classes.astype(np.uint32) * np.uint32(0x27D4EB2F)
    first = np.stack([np.zeros(len(h), np.uint16), _slot(one, 1, 1), _slot(one * np.uint32(31) + two, 2, 1), _slot(two, 3, 1), _slot(three, 4, 1)], axis=1)
    second = np.stack([classes.astype(np.uint16), _slot(one ^ c, 5, CLASSES), _slot(two ^ c, 6, CLASSES)], axis=1)
    return first, second


def log_probs(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """log P of every outcome."""
    z = weights.take(rows[:, 0], axis=0)
    for k in range(1, rows.shape[1]):
        z += weights.take(rows[:, k], axis=0)
    np.minimum(z, 80, out=z)  # so that no power is infinite
    z -= np.log(np.exp(z) @ np.ones(z.shape[1], z.dtype))[:, None]
    return z


def sums_of_runs(x: np.ndarray, first: np.ndarray, sizes: np.ndarray, few: int = 12) -> np.ndarray:
    """Sums of the runs of rows that begin at ``first``: most runs are short, so the second rows
    of all runs are added at once, then the third ones; long runs one by one."""
    out = x.take(first, axis=0)
    long = sizes > few
    for k in range(1, few):
        at = np.flatnonzero((sizes > k) & ~long)
        if not len(at):
            break
        out[at] += x.take(first[at] + k, axis=0)
    for k in np.flatnonzero(long):
        out[k] = x[first[k] : first[k] + sizes[k]].sum(axis=0)
    return out


def descend(weights: np.ndarray, power: np.ndarray, rows: np.ndarray, target: np.ndarray) -> None:
    """One Adagrad step on a batch, in place."""
    g = np.exp(log_probs(weights, rows))
    g[np.arange(len(g)), target] -= 1
    flat = rows.ravel()
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    at, sizes = ordered[first], np.diff(np.append(first, len(flat)))
    sums = sums_of_runs(g.take(order // rows.shape[1], axis=0), first, sizes)
    sums /= np.sqrt(sizes).astype(np.float32)[:, None]
    held = power.take(at, axis=0) + sums * sums
    power[at] = held
    weights[at] -= RATE * sums / np.sqrt(held)


def chunked(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows of ``docs`` (id, held_out, raw) as chunks: the documents' ids, ``held_out`` and token
    numbers (two bytes and the rest of each, apart, so that they compress), and the chunk's
    distinct tokens: hashes, training counts, endings."""
    kind = docs.schema["id"].dataType

    def rows(batches):
        number, schema = TaskContext.get().partitionId() << 32, None
        ids, held, sizes, tokens, seen = [], [], [], [], {}

        def out():
            nonlocal number
            flat = np.concatenate(tokens)
            distinct = list(seen)
            mine = np.repeat(~np.array(held, bool), sizes)
            counts = np.bincount(flat[mine], minlength=len(distinct))
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct)).view(np.int64)
            row = {
                "chunk": number, "ids": ids.copy(), "held": held.copy(), "sizes": sizes.copy(), "low": (flat & 0xFFFF).astype("<u2").tobytes(), "high": (flat >> 16).astype("<u2").tobytes(),
                "hashes": hashes, "counts": counts, "endings": np.fromiter(map(ending, distinct), np.int8, len(distinct)),
            }
            number += 1
            for x in (ids, held, sizes, tokens, seen):
                x.clear()
            return pa.RecordBatch.from_pylist([row], schema=schema)

        total = 0
        for batch in batches:
            schema = pa.schema([
                ("chunk", pa.int64()), ("ids", pa.list_(batch.schema.field("id").type)), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("low", pa.binary()), ("high", pa.binary()),
                ("hashes", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("endings", pa.list_(pa.int8())),
            ])
            put = seen.setdefault
            for doc, out_of, raw in zip(batch.column("id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("raw"), strict=True):
                found = words(raw.as_py())
                if total and total + len(found) > chunk:
                    yield out()
                    total = 0
                tokens.append(np.array([put(t, len(seen)) for t in found], np.int64))
                ids.append(doc)
                held.append(out_of)
                sizes.append(len(found))
                total += len(found)
        if total:
            yield out()

    return docs.select("id", "held_out", "raw").mapInArrow(
        rows, f"chunk long, ids array<{kind.simpleString()}>, held array<boolean>, sizes array<long>, low binary, high binary, hashes array<long>, counts array<long>, endings array<byte>"
    )


class Chunk:
    """One chunk's tokens as numbers."""

    def __init__(self, r, own: dict[int, int]):
        self.sizes = np.array(r["sizes"], np.int64)
        self.ids = np.frombuffer(r["low"], "<u2").astype(np.int32) | (np.frombuffer(r["high"], "<u2").astype(np.int32) << 16)
        hashes = np.array(r["hashes"], np.int64)
        self.kinds = np.array(r["endings"], np.int64)
        for h, k in own.items():
            self.kinds[hashes == h] = k
        self.parts = (hashes.view(np.uint64) >> np.uint64(60)).astype(np.int64)
        self.short = (hashes.view(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        self.place = np.arange(len(self.ids)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)

    def batches(self, use: np.ndarray | None = None, size: int = 16 * BATCH):
        """(token numbers, features, classes, parts) of the tokens, or those to ``use``, by and by."""
        ids, place = (self.ids, self.place) if use is None else (self.ids[use], self.place[use])
        for at in range(0, len(ids), size):
            # three tokens more in front, for the history
            low = max(0, at - 3)
            i = ids[low : at + size]
            c = self.kinds[i]
            first, second = features(self.short[i], place[low : at + size], c)
            skip = at - low
            yield i[skip:], first[skip:], second[skip:], c[skip:], self.parts[i[skip:]]


def train(chunks: DataFrame, own: dict[int, int], mass: np.ndarray, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Weights of the class and part models after all rounds over ``chunks``. The biases start at
    the shares of the classes and parts (``mass``), so training starts from the counts alone."""
    spark = chunks.sparkSession
    by_class = mass.sum(axis=1)
    tables = [np.zeros((FEATURES, CLASSES), np.float32), np.zeros((FEATURES, PARTS), np.float32)]
    tables[0][0] = np.log(np.maximum(by_class, 1e-9) / by_class.sum())
    tables[1][:CLASSES] = np.log(np.maximum(mass, 1e-9) / np.maximum(by_class, 1e-9)[:, None])
    tables += [np.ones_like(t) for t in tables]
    width = [t.shape[1] for t in tables]
    for k in range(rounds):
        sent = spark.sparkContext.broadcast((tables, own))

        def rows(frames, sent=sent):
            start, mine = sent.value
            w1, w2, p1, p2 = local = [t.copy() for t in start]
            n = 0
            for f in frames:
                for r in f.to_dict("records"):
                    c = Chunk(r, mine)
                    for _, first, second, kind, part in c.batches(np.repeat(~np.array(r["held"], bool), c.sizes)):
                        for at in range(0, len(kind), BATCH):
                            here = slice(at, at + BATCH)
                            descend(w1, p1, first[here], kind[here])
                            descend(w2, p2, second[here], part[here])
                        n += len(kind)
            if n:
                yield pd.DataFrame([(at, n, b"".join(t[at : at + BLOCK].tobytes() for t in local)) for at in range(0, FEATURES, BLOCK)], columns=["at", "n", "block"])

        def mean(frame: pd.DataFrame) -> pd.DataFrame:
            n = frame["n"].to_numpy(np.float64)
            total = sum(np.frombuffer(x, np.float32) * m for x, m in zip(frame["block"], n, strict=True))
            return pd.DataFrame([(frame["at"].iloc[0], (total / n.sum()).astype(np.float32).tobytes())], columns=["at", "block"])

        parts = chunks.filter(F.pmod(F.xxhash64("chunk"), F.lit(rounds)) == k).select("held", "sizes", "low", "high", "hashes", "endings").mapInPandas(rows, "at int, n long, block binary")
        for r in parts.groupBy("at").applyInPandas(mean, "at int, block binary").collect():  # the tables, of fixed size
            flat, low = np.frombuffer(r["block"], np.float32), 0
            for t, m in zip(tables, width, strict=True):
                t[r["at"] : r["at"] + BLOCK] = flat[low : low + BLOCK * m].reshape(-1, m)
                low += BLOCK * m
    return tables[:2]


def counted(chunks: DataFrame) -> DataFrame:
    """(chunk, at, hash, kind, c, first) of each chunk's distinct tokens: their training counts in
    the whole corpus, and whether the row is the first of its token."""
    each = F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size("hashes") - 1).alias("at"), "hashes", "counts", "endings"))
    tokens = chunks.select("chunk", each.alias("t"))
    tokens = tokens.select("chunk", F.col("t.at").alias("at"), F.col("t.hashes").alias("hash"), F.col("t.counts").alias("n"), F.col("t.endings").alias("kind"))
    same = Window.partitionBy("hash")
    return tokens.select("chunk", "at", "hash", "kind", F.sum("n").over(same).alias("c"), (F.row_number().over(same.orderBy("chunk")) == 1).alias("first"))


def fit(chunks: DataFrame, counts: DataFrame, rounds: int = ROUNDS) -> tuple:
    """(total, distinct, own classes by hash, mass of each class and part, weights)."""
    known = counts.filter("first AND c > 0")
    total, distinct = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    own = {r["hash"]: k for k, r in enumerate(known.orderBy(F.desc("c"), "hash").select("hash").limit(OWN).collect())}
    kind = F.col("kind").cast("int")
    for h, k in own.items():
        kind = F.when(F.col("hash") == h, k).otherwise(kind)
    mass = np.zeros((CLASSES, PARTS))
    mass[OWN:] = 1  # unknown tokens have no class of their own
    for r in known.groupBy(kind.alias("k"), F.shiftrightunsigned("hash", 60).alias("s")).agg(F.sum(F.col("c") + 1).alias("n")).collect():  # CLASSES * PARTS rows
        mass[r["k"], r["s"]] += r["n"]
    return total, distinct, own, mass, train(chunks, own, mass, rounds)


def score(docs: DataFrame, rounds: int = ROUNDS, chunk: int = CHUNK) -> DataFrame:
    """Scores of the rows of ``docs`` (id, held_out, raw), learning from those not held out."""
    spark = docs.sparkSession
    chunks = materialize(chunked(docs, chunk), "chunks")
    counts = materialize(counted(chunks), "counts")
    total, distinct, own, mass, weights = fit(chunks, counts, rounds)
    sent = spark.sparkContext.broadcast((own, weights, mass, float(np.log10(total + distinct + 1))))

    def rows(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own, (w1, w2), mass, base = sent.value
        parts = []
        c = np.zeros(len(right), np.int64)
        c[right["at"].to_numpy()] = right["c"].to_numpy()
        log_c, log_mass = np.log10(c + 1.0), np.log10(np.maximum(mass, 1))
        for r in left.to_dict("records"):
            x = Chunk(r, own)
            logp = []
            for ids, first, second, kind, part in x.batches():
                lane = np.arange(len(ids))
                both = log_probs(w1, first)[lane, kind].astype(np.float64) + log_probs(w2, second)[lane, part]
                logp.append(both / np.log(10) + log_c[ids] - log_mass[kind, part])
            starts = np.cumsum(x.sizes) - x.sizes
            sums = lambda v: np.add.reduceat(v, starts)  # noqa: B023, E731
            parts.append(pd.DataFrame({
                "id": pd.Series(list(r["ids"]), dtype=object), "held_out": list(r["held"]), "n_tokens": x.sizes, "n_known": sums((c[x.ids] > 0).astype(np.int64)),
                "base_score": sums(log_c[x.ids]) - x.sizes * base, "score": sums(np.concatenate(logp)),
            }))
        return pd.concat(parts) if parts else pd.DataFrame(columns=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    kind = docs.schema["id"].dataType.simpleString()
    data = chunks.select("chunk", "ids", "held", "sizes", "low", "high", "hashes", "endings").groupBy("chunk").cogroup(counts.select("chunk", "at", "c").groupBy("chunk"))
    out = data.applyInPandas(rows, f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held = (id_crc("doc_id") % 7 == 2).alias("held_out")
    return score(docs.select(F.col("doc_id").alias("id"), held, F.col("text").cast("binary").alias("raw"))).withColumnRenamed("id", "doc_id")
