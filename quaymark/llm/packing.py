"""Pattern packing by non-negative least squares.

Documents become tokens, and only those longer than a sequence are cut. The histogram of
piece lengths (at most one bin for each length up to the sequence's) is all the driver
gets. There, patterns of few lengths that fill a sequence exactly are enumerated, repeat
counts are fitted to the histogram by non-negative least squares, rounded down and held
within it; the rest is packed length by length, best fit first, always as many times as
the histogram allows. The result is a short list of (pattern, repeats), its size bounded
by the sequence length.

Pieces then find their places in parallel: pieces of one length are numbered (in buckets,
so that a common length is not one task), and the number tells the pattern, the repeat and
the place in it.

Cases: null text is the empty text; a document without tokens is its end id alone; rows
are packed separately even if they repeat; an empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, read_table

LENGTH = 2048
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CACHE = 900_000
SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")
#: Token runs of printable ASCII; none crosses white space.
_ascii_runs = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^\sA-Za-z0-9]+").findall
#: Lower-case letters that the tokenizer's normalizers leave as they are: such a word is one run.
_plain = re.compile("[a-zß-öø-ÿ]+").fullmatch
_loaded: dict[str, tuple] = {}


def _byte_letters() -> dict[int, str]:
    """The letters above with the two characters by which byte-level BPE names their bytes:
    a printable Latin-1 byte names itself, the others are numbered from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
    return {c: "".join(names[b] for b in chr(c).encode()) for c in range(0xDF, 0x100)}


_NAMED = _byte_letters()


def _tokenizer(path: str) -> tuple:
    """The tokenizer, its BPE model and this worker's memory of what it has seen."""
    if path not in _loaded:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _loaded[path] = (tokenizer, tokenizer.model, {})
    return _loaded[path]


def _parts(chunk: str) -> list[str]:
    """A chunk between white spaces, cut where tokens end in any case; beyond printable ASCII
    (the tokenizer composes characters there) only points and commas after a letter go, one
    that stays a letter in lower case."""
    if chunk.isascii() and chunk.isprintable():
        return _ascii_runs(chunk)
    core = chunk.rstrip(".,")
    cut = len(core) < len(chunk) and core and core[-1] <= "\u024f" and core[-1].lower()[-1].isalpha()
    return [core, chunk[len(core) :]] if cut else [chunk]


def encode(texts: list[str], path: str = TOKENIZER) -> list[bytes]:
    """Ids of each text as unsigned 32-bit little-endian bytes, the same as
    ``Tokenizer.encode(text, add_special_tokens=False).ids``. Chunks between white space
    are looked up; those not seen yet are cut into parts, and new parts encoded, plain words
    by the BPE model itself, others by the whole tokenizer."""
    tokenizer, model, seen = _tokenizer(path)
    packed = lambda ids: np.array(ids, "<u4").tobytes()
    lists: list[list[bytes] | None] = []
    direct: dict[int, bytes] = {}
    for k, text in enumerate(texts):
        raw = text.encode("utf-8").lower()  # lower-cases ASCII; the tokenizer does the rest
        if SPECIAL[0] in raw or SPECIAL[1] in raw:  # these are tokens of their own
            direct[k] = packed(tokenizer.encode(text, add_special_tokens=False).ids)
            lists.append(None)
        else:
            lists.append(raw.split())
    if len(seen) > CACHE:
        seen.clear()
    later: dict[bytes, list[bytes]] = {}
    fresh: set[bytes] = set()
    for c in set().union(*[x for x in lists if x]) - seen.keys():
        word = c.decode()
        if _plain(word):
            seen[c] = packed([t.id for t in model.tokenize(word if word.isascii() else word.translate(_NAMED))])
        else:
            later[c] = parts = [w.encode() for w in _parts(word)]
            fresh.update(parts)
    rest = []
    for w in fresh - seen.keys():
        word = w.decode()
        if _plain(word):
            seen[w] = packed([t.id for t in model.tokenize(word if word.isascii() else word.translate(_NAMED))])
        else:
            rest.append(word)
    for w, e in zip(rest, tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
        seen[w.encode()] = packed(e.ids)
    for c, parts in later.items():
        seen[c] = b"".join(map(seen.__getitem__, parts))
    return [direct[k] if x is None else b"".join(map(seen.__getitem__, x)) for k, x in enumerate(lists)]


def pieces_of(ids: bytes, length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of one document's ids, the end id 0 added."""
    ids += b"\0\0\0\0"
    step = 4 * length
    return [(k, at // 4, len(part := ids[at : at + step]) // 4, zlib.crc32(part)) for k, at in enumerate(range(0, len(ids), step))]


def tokenized(docs: DataFrame, id_col: str, text_col: str, length: int, path: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(frames):
        for f in frames:
            got, at = [], 0
            while at < len(f):  # a few MB of text at a time
                end, size = at, 0
                while end < len(f) and (end == at or size < 4_000_000):
                    size += len(f["text"].iat[end] or "")
                    end += 1
                for doc, ids in zip(f["id"].iloc[at:end], encode([t or "" for t in f["text"].iloc[at:end]], path), strict=True):
                    got += [(doc, *p) for p in pieces_of(ids, length)]
                at = end
            yield pd.DataFrame(got, columns=["id", "piece", "start", "length", "ids_crc32"]).astype({"id": f["id"].dtype})

    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInPandas(rows, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def patterns_for(hist: np.ndarray, length: int, grid: int = 48) -> np.ndarray:
    """Patterns of two to four lengths that fill a sequence exactly: all pairs, and triples
    and quadruples whose other lengths come from the ``grid`` most common ones. Rows of
    lengths, 0 for none."""
    have = np.flatnonzero(hist)
    have = have[(have > 0) & (have < length)]
    if not len(have):
        return np.zeros((0, 4), np.int64)
    mass = np.zeros(length + 1, bool)
    mass[have] = True
    common = have[np.argsort(-hist[have], kind="stable")[:grid]]
    spread = have[np.unique(np.linspace(0, len(have) - 1, grid).astype(int))]
    seeds = np.unique(np.concatenate([common, spread]))
    out = []
    a = have[have * 2 <= length]
    out.append(np.stack([length - a, a, 0 * a, 0 * a], axis=1))
    x, y = np.meshgrid(have, seeds, indexing="ij")
    z = length - x - y
    ok = (z > 0) & (x >= y)
    out.append(np.stack([x[ok], y[ok], z[ok], 0 * z[ok]], axis=1))
    few = seeds[:: max(1, len(seeds) // 24)]
    x, y, w = np.meshgrid(have, few, few, indexing="ij")
    z = length - x - y - w
    ok = (z > 0) & (x >= y) & (y >= w)
    out.append(np.stack([x[ok], y[ok], w[ok], z[ok]], axis=1))
    p = np.concatenate(out)
    p = -np.sort(-p, axis=1)
    p = p[mass[np.where(p > 0, p, have[0])].all(axis=1)]
    return np.unique(p, axis=0)


def nnls(patterns: np.ndarray, hist: np.ndarray, steps: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared distance of the lengths the patterns
    use from the histogram: projected gradient steps with momentum."""
    used = patterns > 0
    size = len(hist)
    apply = lambda x: np.bincount(patterns.ravel(), np.where(used, x[:, None], 0).ravel(), size)
    back = lambda r: np.where(used, r[patterns], 0).sum(axis=1)
    v = np.ones(len(patterns))
    for _ in range(20):  # the largest eigenvalue gives the step
        v = back(apply(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        nxt = np.maximum(0, y - back(apply(y) - hist) / (1.05 * norm))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = nxt + (t - 1) / s * (nxt - x)
        x, t = nxt, s
    return x


def plan(hist: np.ndarray, length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, repeats) that use up ``hist`` (hist[n] pieces of n)."""
    left = hist.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[length]:
        out.append(((length,), int(left[length])))
        left[length] = 0
    patterns = patterns_for(left, length)
    if len(patterns):
        x = np.floor(nnls(patterns, left.astype(float)) + 1e-6).astype(np.int64)
        for k in np.argsort(-x, kind="stable")[: int((x > 0).sum())].tolist():
            need: dict[int, int] = {}
            for n in patterns[k][patterns[k] > 0].tolist():
                need[n] = need.get(n, 0) + 1
            times = min(int(x[k]), *(int(left[n]) // m for n, m in need.items()))
            if times > 0:
                out.append((tuple(n for n, m in need.items() for _ in range(m)), times))
                for n, m in need.items():
                    left[n] -= times * m
    # the rest: the longest piece, then always the longest that fits, as often as there are pieces
    top = length - 1
    while True:
        while top > 0 and not left[top]:
            top -= 1
        if top <= 0:
            break
        one, room = [], length
        trial = left.copy()
        n = top
        while room > 0:
            n = min(n, room)
            while n > 0 and not trial[n]:
                n -= 1
            if n <= 0:
                break
            m = min(room // n, int(trial[n]))
            one += [n] * m
            trial[n] -= m
            room -= m * n
        used = left - trial
        at = np.flatnonzero(used)
        times = int((left[at] // used[at]).min())
        out.append((tuple(one), times))
        left[at] -= times * used[at]
    return out


def places(packed: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Ranges of piece numbers of each length: ``length``, ``low`` (first number),
    ``first_sequence``, ``per`` (pieces of this length in a sequence), ``offsets``."""
    nxt: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in packed:
        at, offsets = 0, {}
        for n in lengths:
            offsets.setdefault(n, []).append(at)
            at += n
        for n, where in offsets.items():
            rows.append((n, nxt.get(n, 0), sequence, where))
            nxt[n] = nxt.get(n, 0) + times * len(where)
        sequence += times
    return pd.DataFrame(rows, columns=["length", "low", "first_sequence", "offsets"])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, path: str = TOKENIZER) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = materialize(tokenized(docs, id_col, text_col, length, path).withColumn("bucket", F.spark_partition_id()), "pieces")
    counts = materialize(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")
    hist = np.zeros(length + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``length`` rows
        hist[r["length"]] = r["n"]
    table = places(plan(hist, length)).sort_values(["length", "low"])
    where = spark.sparkContext.broadcast({
        int(n): (g["low"].to_numpy(np.int64), g["first_sequence"].to_numpy(np.int64), list(g["offsets"])) for n, g in table.groupby("length")
    })
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    numbered = pieces.join(base.select("length", "bucket", "base"), ["length", "bucket"]).withColumn(
        "number", F.col("base") + F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece", "start", "ids_crc32")) - 1
    )
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(frames):
        for f in frames:
            sequence, offset = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
            lengths, number = f["length"].to_numpy(), f["number"].to_numpy()
            for n in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == n)
                low, first, offsets = where.value[n]
                k = np.searchsorted(low, number[at], side="right") - 1
                rest = number[at] - low[k]
                per = np.array([len(o) for o in offsets])[k]
                sequence[at] = first[k] + rest // per
                offset[at] = [offsets[i][j] for i, j in zip(k.tolist(), (rest % per).tolist(), strict=True)]
            yield f[["id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=sequence, offset=offset)

    out = numbered.select("id", "piece", "start", "length", "ids_crc32", "number").mapInPandas(
        rows, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
    return out.withColumnRenamed("id", id_col)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every piece of the mix with its sequence and place."""
    return pack(docs)
