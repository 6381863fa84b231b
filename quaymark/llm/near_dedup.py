"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is its words (A-Z lower-cased, split at white space); equal word sequences are one
node from the start. A node's k-mers are its runs of ``K`` words, each labelled with how
often it occurred before, so repeats count. Each of ``SKETCHES`` hash functions picks the
``PICK`` k-mers with the smallest hashes and keeps them in text order; that ordered pick is
one value (Order MinHash). Where a text of at most ``SHORT`` words may be in a pair, edits at the
threshold may touch nearly every k-mer, and sketches alone would miss one pair in ten. So such
texts and their partners (a text matches none longer than ``1 / SIMILARITY`` times its words)
have their rarest runs of ``w`` neighbouring words as values too: an edit touches at most ``w``
runs, so texts that match share one of each one's first ``w * (1 - SIMILARITY)`` of them plus
``w`` in any fixed order. Texts up to ``TINY`` words and their partners do so with pairs, longer
ones with runs of three, which texts that do not match hardly share. No such pair is missed,
and ``FEW`` sketches do for texts up to ``SHORT``.

Nodes that share a value are a bucket. No bucket emits its pairs. First all its members are
compared with one of them, its leader; the matches link nodes into classes. Similarity is
not transitive, so that is not the end: wherever the rest of a bucket (the members without
the leader, matched or not) lies in more than one class, every two members of different
classes are compared. Buckets of at most ``SMALL`` nodes do that in one task each. Larger
ones are dealt anew: texts up to ``TINY / SIMILARITY`` words by the pairs of words that are
rarest among them, which again misses none; longer ones than ``TINY`` by ``AGAIN`` MinHash values
of neighbouring words, which texts of that length that match share with near certainty (at the
threshold all but one pair in 5000). Both part texts that only a common passage brought
together. What is still large is compared in blocks of
twice ``SMALL`` nodes, without those of one class. So nothing is capped, no unbounded group has
to fit into one task, and members of one class are not compared with each other.

Most texts of a bucket only share a passage. Each node has a ``sign``: for each of ``BITS`` classes of
words, whether it has an odd number of them. An edit turns at most two bits, one that changes the
length one, so signs and lengths tell most pairs apart, and never two that match. Only texts with
a likely partner left are fetched and aligned.

A pair matches when the edit distance of the word sequences is at most ``1 - SIMILARITY`` of
the longer one: a bit-parallel alignment in a diagonal band of that width, on 32-bit hashes
of the words (two unequal words pass as equal once in 4 billion). Matches are linked into
classes by contracting links to the smallest neighbour until none is left.

Cases: null text is the empty text; empty texts form one class; texts shorter than K words
have one k-mer, all they have; null or repeated ids are separate rows; an empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import count as numbers

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_rows, materialize, read_table

K = 5
PICK = 2
SKETCHES = 72
SIMILARITY = 0.8
SMALL = 512
SHORT = 150  # words
FEW = 24  # sketches of texts up to that
TINY = 64  # words; up to that pairs of words tell, beyond it runs of three
AGAIN = 16  # values by which longer texts of large buckets are dealt anew
ALONE = 10_000  # links
BITS = 256  # of a sign
FILTER = 1 << 24  # bits of the filter by which texts that nobody asks for are left out
LISTED = 65536  # pairs of words more frequent than one in so many are known by their counts, so there are at most so many
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_MULTIPLY = (_mix(np.arange(1, 257, dtype=np.uint64) * _GOLD) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (_mix(np.arange(1001, 1257, dtype=np.uint64) * _GOLD) >> np.uint64(32)).astype(np.uint32)


def labelled(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-mers of a sequence of word hashes, labelled by occurrence."""
    if len(words) < k:
        words = np.concatenate([words, np.zeros(k - len(words), np.uint64)])
    n = len(words) - k + 1
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x100000001B3) + words[j : j + n]
    h = _mix(h)
    order = np.argsort(h, kind="stable")
    ordered = h[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    if new.all():
        return h
    starts = np.flatnonzero(new)
    seen = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    again = seen > 0
    h[order[again]] = _mix(ordered[again] + seen[again].astype(np.uint64) * _GOLD)
    return h


def sketch(kmers: np.ndarray, sketches: int = SKETCHES, pick: int = PICK) -> np.ndarray:
    """One value for each hash function: its smallest k-mers in text order."""
    pick = min(pick, len(kmers))
    values = np.zeros(sketches, np.uint64)
    short = (kmers >> np.uint64(32)).astype(np.uint32)
    step = max(1, min(sketches, 65536 // len(kmers)))  # some functions at a time bound the memory of long texts
    for at in range(0, sketches, step):
        m = min(step, sketches - at)
        h = short[None, :] * _MULTIPLY[at : at + m, None]
        h += _ADD[at : at + m, None]
        where = np.empty((m, pick), np.int64)
        lanes = np.arange(m)
        for j in range(pick):
            where[:, j] = h.argmin(axis=1)
            h[lanes, where[:, j]] = np.uint32(2**32 - 1)
        where.sort(axis=1)
        v = np.arange(at, at + m, dtype=np.uint64) * _GOLD
        for j in range(pick):
            v = _mix(v * np.uint64(3) + kmers[where[:, j]])
        values[at : at + m] = v
    return values.view(np.int64)


def distance_within(a: list, b: list, most: int) -> bool:
    """Whether the edit distance of two sequences is at most ``most``. The vertical
    differences in a diagonal band of 2 * most + 1 cells are the bits of two integers,
    which a few additions and shifts carry from one column to the next (Hyyro's band)."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return False
    low = 0
    while low < len(b) and a[low] == b[low]:
        low += 1
    high = 0
    while high < len(b) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    if not b or not most:
        return len(a) <= most
    most = min(most, len(a))
    width = 2 * most + 1
    full = (1 << width) - 1
    bits: dict = {}
    for j, w in enumerate(a):
        bits[w] = bits.get(w, 0) | (1 << j)
    vp, vn, dist = full & (full << (width - most - 1)), 0, most
    corner, edge, start = 1 << (width - 1), 1 << (width - 2), most + 1 - width
    stop = most + len(b) - (len(a) - most)  # later columns can lower the distance by no more than this allows
    for i, w in enumerate(b):
        x = bits.get(w, 0)
        x = (x << -start if start < 0 else x >> start) & full
        start += 1
        d = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp, hn = vn | (full & ~(d | vp)), d & vp
        if i < len(a) - most:
            dist += not d & corner
        else:
            dist += bool(hp & edge) - bool(hn & edge)
            edge >>= 1
        if dist > stop:
            return False
        vp, vn = hn | (full & ~((d >> 1) | hp)), (d >> 1) & hp
    return dist <= most


def _parsed(seq: bytes) -> tuple[list, set]:
    """A sequence of 32-bit word hashes and its distinct words."""
    x = np.frombuffer(seq, np.uint32).tolist()
    return x, set(x)


def _allowed(n: float, similarity: float) -> int:
    """Edits that a match allows when the longer text has ``n`` words."""
    return int((1 - similarity) * n + 1e-9)


def _partner(similarity: float, words: int = SHORT) -> int:
    """Words of the longest text that matches one of ``words``."""
    return int(words / similarity + 1e-9)


def _alike(a: tuple[list, set], b: tuple[list, set], most: int) -> bool:
    (x, u), (y, v) = a, b
    if abs(len(x) - len(y)) > most or len(u - v) > most or len(v - u) > most:  # each word that the other lacks is an edit
        return False
    return distance_within(x, y, most)


def same(a: bytes, b: bytes, similarity: float = SIMILARITY) -> bool:
    """Whether two sequences of 32-bit word hashes are that similar."""
    return _alike(_parsed(a), _parsed(b), _allowed(max(len(a), len(b)) / 4, similarity))


class Memo(dict):
    """Hashes of the words seen so far."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _node(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def sign_of(hashed: np.ndarray) -> np.ndarray:
    """For each class of words, as their hashes deal them, whether there is an odd number: bits of longs."""
    odd = np.bincount((hashed & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketched(docs: DataFrame, id_col: str, text_col: str, k: int, sketches: int, pick: int, similarity: float = SIMILARITY) -> DataFrame:
    """Rows (row, id, raw_sha, digest, n, sketch, short, run, sign). The sketch, the sign, and the labelled
    pairs (``short``) and runs of three words (``run``) of texts that the filter is for, stand only where
    a task meets a word sequence first."""
    kind = docs.schema[id_col].dataType.simpleString()
    pairs, runs = _partner(similarity, TINY), _partner(similarity)

    def rows(frames):
        seen: set[bytes] = set()
        memo = Memo()
        for f in frames:
            digests, sizes, values, few, threes, signs = [], [], [], [], [], []
            for text in f["text"]:
                words = _words(text)
                digest = _node(words)
                value = short = run = sign = None
                if digest not in seen:
                    seen.add(digest)
                    if len(memo) > 300_000:
                        memo.clear()
                    hashed = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
                    value = sketch(labelled(hashed, k), min(FEW, sketches) if len(words) <= SHORT else sketches, pick)
                    sign = sign_of(hashed)
                    if len(words) <= pairs:
                        short = labelled(hashed, 2).view(np.int64)
                    if TINY < len(words) <= runs:
                        run = labelled(hashed, 3).view(np.int64)
                digests.append(digest)
                sizes.append(len(words))
                values.append(value)
                few.append(short)
                threes.append(run)
                signs.append(sign)
            yield f[["row", "id", "raw_sha"]].assign(digest=digests, n=sizes, sketch=values, short=few, run=threes, sign=signs)

    raw = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.sha2(raw, 256).alias("raw_sha"), raw.alias("text"))
    return texts.mapInPandas(rows, f"row long, id {kind}, raw_sha string, digest binary, n int, sketch array<long>, short array<long>, run array<long>, sign array<long>")


def word_hashes(docs: DataFrame, text_col: str, asked: DataFrame) -> DataFrame:
    """(node, words): the word sequences of the nodes ``asked`` for (node, digest) as 32-bit hashes. A
    filter of their digests, of one size for any input, leaves out most others before the join."""
    spot = asked.select((F.crc32("digest") % FILTER).alias("spot"))
    marks = spot.groupBy(F.expr("spot div 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(spot % 64 as int)))").alias("bits")).toArrow()
    held = np.zeros(FILTER // 64, np.int64)  # the driver gets no more than this
    held[marks["at"].to_numpy()] = marks["bits"].to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(held.astype("<i8").tobytes())

    def rows(frames):
        marked, seen = sent.value, set()
        for f in frames:
            digests, hashes = [], []
            for text in f["text"]:
                words = _words(text)
                digest = _node(words)
                at = zlib.crc32(digest) % FILTER
                if marked[at >> 3] >> (at & 7) & 1 and digest not in seen:
                    seen.add(digest)
                    digests.append(digest)
                    hashes.append(np.fromiter(map(zlib.crc32, words), np.uint32, len(words)).tobytes())
            yield pd.DataFrame({"digest": digests, "words": hashes})

    found = docs.select(F.col(text_col).alias("text")).mapInPandas(rows, "digest binary, words binary")
    return found.join(asked, "digest").dropDuplicates(["node"]).select("node", "words")


def likely_pairs(pairs: DataFrame, signs: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (node, leader) that lengths and signs (node, n, sign) do not tell apart. Of the
    edits allowed, as many as the lengths differ by turn one bit, the others at most two."""
    for side in ("node", "leader"):
        pairs = pairs.join(signs.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sign").alias(f"sign_{side}")), side)
    apart = F.abs(F.col("n_node") - F.col("n_leader"))
    most = F.floor((1 - similarity) * F.greatest("n_node", "n_leader") + 1e-9)
    turned = sum((F.bit_count(F.col("sign_node")[k].bitwiseXOR(F.col("sign_leader")[k])) for k in range(BITS // 64)), F.lit(0))
    return pairs.filter((apart <= most) & (turned <= 2 * most - apart)).select("node", "leader")


def verify(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """(node, leader) of the ``pairs`` that match."""

    def rows(frames):
        for f in frames:
            yield f.loc[[same(a, b, similarity) for a, b in zip(f["wa"], f["wb"], strict=True)], ["node", "leader"]]

    with_a = pairs.join(words.withColumnRenamed("words", "wa"), "node")
    both = with_a.join(words.select(F.col("node").alias("leader"), F.col("words").alias("wb")), "leader")
    return both.select("node", "leader", "wa", "wb").mapInPandas(rows, "node long, leader long")


def by_rare_runs(tokens: DataFrame, similarity: float, width: int = 2) -> DataFrame:
    """(node, label, key): rows (node, label, n, tokens: labelled runs of ``width`` words) dealt by
    the first runs, of which texts that match share one, from the rarest. Any fixed order would
    do; this one is by the counts of the runs with a share of 1 / ``LISTED`` or more, then by hash.
    Of texts of n and m >= n words that match, m - width + 1 - width e runs or more are shared (e:
    the edits that m allows), so the first n - m + width e + 1 are enough; over all m that is
    width e(n) + width at most, if ``similarity`` is 0.8."""

    def count(frames):
        for f in frames:
            got: Counter = Counter()
            for x in f["tokens"]:
                got.update(x.tolist())
            yield pd.DataFrame({"token": list(got.keys()), "n": list(got.values())}, dtype="int64")

    total = tokens.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    counts = tokens.select("tokens").mapInPandas(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    often = sorted((r["token"], r["n"]) for r in counts.filter(F.col("n") >= max(2, total / LISTED)).collect())  # at most LISTED rows
    sent = tokens.sparkSession.sparkContext.broadcast((np.array([t for t, _ in often] or [0], np.int64), np.array([n for _, n in often] or [0], np.int64)))

    def first(frames):
        known, counts = sent.value
        for f in frames:
            nodes, labels, keys = [], [], []
            for node, label, n, x in zip(f["node"], f["label"], f["n"], f["tokens"], strict=True):
                at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                order = np.lexsort((x, np.where(known[at] == x, counts[at], 0)))[: width * (_allowed(n, similarity) + 1)]
                nodes.append(np.full(len(order), node))
                labels.append(np.full(len(order), label))
                keys.append(x[order])
            if nodes:
                yield pd.DataFrame({"node": np.concatenate(nodes), "label": np.concatenate(labels), "key": np.concatenate(keys)}, dtype="int64")

    return tokens.mapInPandas(first, "node long, label long, key long")


def mixed(members: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """``members`` (key, node, label), written, and the buckets (key, size) of them that hold more
    than one class; of buckets with the same members (as their combined hashes tell) one."""
    members = materialize(members, f"{label}-members")  # made once, read twice
    alike = [F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("z")]
    several = members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"), *alike).filter("low < high")
    # written, so that Spark can split a hot bucket in the join with its members
    return members, materialize(several.groupBy("x", "y", "z", "size", "low", "high").agg(F.min("key").alias("key")).select("key", "size"), f"{label}-keys")


def _overlaps(seqs: list[bytes], some: np.ndarray) -> np.ndarray:
    """How many words ``some`` of the sequences share with each, counted with repeats: frequent
    words by products of matrices, rarer ones by the few pairs of sequences that hold them."""
    kinds = [labelled(np.frombuffer(x, np.uint32).astype(np.uint64), 1) for x in seqs]
    kinds = [x[: len(raw) // 4] for x, raw in zip(kinds, seqs, strict=True)]
    _, place, often = np.unique(np.concatenate(kinds), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(kinds)), [len(x) for x in kinds])
    frequent = (often > 1) & (32 * often >= len(seqs))
    out = np.zeros((len(some), len(kinds)), np.float32)
    use, column, width = frequent[place], (np.cumsum(frequent) - 1)[place], int(frequent.sum())
    for at in range(0, width, 8192):  # some columns at a time bound the memory
        here = use & (column >= at) & (column < at + 8192)
        part = np.zeros((len(kinds), min(8192, width - at)), np.float32)
        part[row[here], column[here] - at] = 1
        out += part[some] @ part.T
    rare = np.flatnonzero(((often > 1) & ~frequent)[place])
    rare = rare[np.argsort(place[rare], kind="stable")]
    word, holder, line = place[rare], row[rare], np.full(len(kinds), -1)
    line[some] = np.arange(len(some))
    for far in range(1, int(often[~frequent].max(initial=1))):  # a word's holders stand together, so its pairs are so far apart
        at = np.flatnonzero(word[far:] == word[:-far])
        for a, b in ((holder[at], holder[at + far]), (holder[at + far], holder[at])):
            here = line[a] >= 0
            np.add.at(out.reshape(-1), line[a[here]] * len(kinds) + b[here], np.float32(1))
    return out


def linked(labels: list, own: list, seqs: list[bytes], similarity: float) -> list[tuple]:
    """Pairs of labels whose texts match, of all pairs of texts that differ in label and, where
    two blocks (``own``) meet, in block. Texts that share too few words are told apart all at
    once, the others are aligned until their classes are one."""
    name = np.unique(labels, return_inverse=True)[1]
    block, size = np.array(own), np.array([len(x) // 4 for x in seqs])
    some = np.flatnonzero(name != np.bincount(name).argmax())  # each pair has one that is not in the largest class
    place = np.full(len(seqs), -1)
    place[some] = some
    apart = (name[some][:, None] != name[None, :]) & ((place[None, :] < 0) | (some[:, None] < place[None, :]))
    if (block != block[0]).any():
        apart &= block[some][:, None] != block[None, :]
    longer = np.maximum(size[some][:, None], size[None, :])
    if len(seqs) > 8 and apart.any():
        apart &= _overlaps(seqs, some) >= longer - np.floor((1 - similarity) * longer + 1e-9)
    root = list(range(int(name.max()) + 1))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out, parsed = [], {}
    rows, columns = np.nonzero(apart)
    for a, b in zip(some[rows].tolist(), columns.tolist(), strict=True):
        x, y = find(name[a]), find(name[b])
        if x != y:
            for k in (a, b):
                if k not in parsed:
                    parsed[k] = _parsed(seqs[k])
            if _alike(parsed[a], parsed[b], _allowed(max(len(seqs[a]), len(seqs[b])) // 4, similarity)):
                root[max(x, y)] = min(x, y)
                out.append((labels[a], labels[b]))
    return out


def partnered(labels: np.ndarray, own: np.ndarray, size: np.ndarray, signs: np.ndarray, similarity: float) -> np.ndarray:
    """Whether each member of a bucket has one of another label and, where two blocks (``own``) meet, of
    the other block, that lengths and signs do not tell apart from it."""
    name = np.unique(labels, return_inverse=True)[1]
    some = np.flatnonzero(name != np.bincount(name).argmax())  # each pair has one that is not in the largest class
    if not len(some):
        return np.zeros(len(name), bool)
    turned = np.zeros((len(some), len(name)), np.int64)
    for k in range(signs.shape[1]):
        turned += np.bitwise_count(signs[some, k][:, None] ^ signs[None, :, k])
    apart = np.abs(size[some][:, None] - size[None, :])
    most = np.floor((1 - similarity) * np.maximum(size[some][:, None], size[None, :]) + 1e-9)
    near = (name[some][:, None] != name[None, :]) & (apart <= most) & (turned <= 2 * most - apart)
    if (own != own[0]).any():
        near &= own[some][:, None] != own[None, :]
    out = near.any(axis=0)
    out[some] |= near.any(axis=1)
    return out


def likely(buckets: DataFrame, signs: DataFrame, similarity: float, rows: int, batch: int = 2048) -> DataFrame:
    """The members (key, own, node, label), ``rows`` in all, of small buckets that have a likely partner there."""
    groups = max(1, rows // batch)

    def keep(f: pd.DataFrame) -> pd.DataFrame:
        label, own, size = (f[c].to_numpy(np.int64) for c in ("label", "own", "n"))
        signs, kept = np.stack(f["sign"].to_list()).view(np.uint64), np.zeros(len(f), bool)
        for at in f.groupby("key", sort=False).indices.values():
            kept[at] = partnered(label[at], own[at], size[at], signs[at], similarity)
        return f.loc[kept, ["key", "own", "node", "label"]]

    dealt = buckets.join(signs.select("node", "n", "sign"), "node").withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)))
    dealt = dealt.select("group", "key", "own", "node", "label", "n", "sign")
    return dealt.groupBy("group").applyInPandas(keep, "key long, own long, node long, label long")


def solve(buckets: DataFrame, words: DataFrame, similarity: float, batch: int = 512) -> DataFrame:
    """(node, leader) links between the classes of the members (key, own, node, label) of small
    buckets; buckets with about ``batch`` members together are one task's group."""
    groups = max(1, buckets.count() // batch)

    def link(f: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        for _, g in f.groupby("key", sort=False):
            found += linked(g["label"].tolist(), g["own"].tolist(), g["words"].tolist(), similarity)
        return pd.DataFrame(found, columns=["node", "leader"], dtype="int64")

    dealt = buckets.join(words, "node").withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)))
    return dealt.select("group", "key", "own", "label", "words").groupBy("group").applyInPandas(link, "node long, leader long").distinct()


def blocks(buckets: DataFrame, small: int) -> DataFrame:
    """The members of large buckets (key, node, label), dealt into blocks of about ``small``, of
    which each two meet in a bucket of their own. A class with more members than that has
    blocks of its own, which need not meet each other."""
    held = buckets.join(buckets.groupBy("key", "label").agg(F.count("*").alias("alike")), ["key", "label"])
    party = F.when(F.col("alike") > small, F.xxhash64("label")).otherwise(0)
    held = materialize(held.select("key", "node", "label", party.alias("party")), "parties")
    parties = held.groupBy("key", "party").agg(F.ceil(F.count("*") / small).cast("int").alias("parts"))
    listed = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.col("party"), k.alias("part")))
    every = parties.groupBy("key").agg(F.flatten(F.collect_list(listed)).alias("every"))
    parties = materialize(parties.join(every, "key"), "blocks")
    mine = F.struct(F.col("party"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    meets = F.filter("every", lambda o: (o["party"] != F.col("party")) | (F.col("party") == 0))
    dealt = held.join(parties, ["key", "party"]).withColumn("mine", mine).withColumn("other", F.explode(meets))
    both = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
    return dealt.select(both.alias("key"), F.xxhash64("mine").alias("own"), "node", "label")


def relabelled(members: DataFrame, maps: list[DataFrame]) -> DataFrame:
    """``members`` with the ``label`` of each ``node``: itself, led on by the ``maps`` in turn."""
    out = members.withColumn("label", F.col("node"))
    for m in maps:
        out = out.join(m.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to")
    return out


def links(docs: DataFrame, nodes: DataFrame, text_col: str, similarity: float = SIMILARITY, small: int = SMALL) -> list[DataFrame]:
    """The classes of the ``nodes`` (node, digest, n, sketch, short, run, sign; equal rows may repeat) by
    verified links, as tables (node, label) that lead on from label to label (see ``relabelled``)."""
    short = nodes.filter("short IS NOT NULL").select("node", "n", F.col("short").alias("tokens"))
    run = nodes.filter("run IS NOT NULL").select("node", "n", F.col("run").alias("tokens"))
    members = nodes.select("node", F.explode("sketch").alias("key"))
    for tokens, width in ((short, 2), (run, 3)):
        members = members.unionByName(by_rare_runs(tokens.withColumn("label", F.col("node")), similarity, width).select("node", "key"))
    lead = members.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).filter("leader < last")
    lead = materialize(lead.select("key", "leader"), "leaders")  # written, so that Spark can split a hot bucket in the join
    asked = materialize(members.join(lead, "key").filter("node <> leader").select("key", "node", "leader"), "asked")
    if asked.isEmpty():
        return []
    signs = materialize(nodes.filter("sign IS NOT NULL").select("node", "digest", "n", "sign").dropDuplicates(["node"]), "signs")
    texts = lambda wanted, label: materialize(word_hashes(docs, text_col, materialize(signs.select("node", "digest").join(wanted.distinct(), "node", "left_semi"), label)), "words")
    pairs = materialize(likely_pairs(asked.select("node", "leader").distinct(), signs, similarity), "pairs")
    maps: list[DataFrame] = []
    if not pairs.isEmpty():
        words = texts(pairs.select("node").union(pairs.select("leader")), "involved")
        maps = classes(materialize(verify(pairs, words, similarity), "found"))
    rest, keys_rest = mixed(relabelled(asked.select("key", "node").distinct(), maps), "rest")
    if keys_rest.isEmpty():
        return maps

    def near(held: DataFrame, keys: DataFrame) -> DataFrame:
        keys = keys.filter(F.col("size") <= small)
        rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        few = held.join(keys.select("key"), "key").withColumn("own", F.lit(0).cast("long"))
        return materialize(likely(few, signs, similarity, rows), "close")

    close = near(rest, keys_rest)
    # of large buckets only the nodes are asked for, each once; their keys are few and written apart, so that Spark can broadcast them
    hot = materialize(keys_rest.filter(F.col("size") > small).select("key"), "hot-keys")
    crowd = materialize(rest.join(hot, "key", "left_semi").select("node").distinct(), "crowd")
    wanted = close.select("node").union(crowd)
    if wanted.isEmpty():
        return maps
    words = texts(wanted, "involved")
    maps += classes(materialize(solve(close, words, similarity), "solved"))
    # labels are told once a node and go with its keys
    large = materialize(relabelled(crowd, maps), "large")
    if large.isEmpty():
        return maps

    def keys(frames):
        for f in frames:
            f = f.loc[[len(x) > 4 * TINY for x in f["words"]]]
            seqs = [np.frombuffer(x, np.uint32).astype(np.uint64) for x in f["words"]]
            if seqs:
                yield pd.DataFrame({"node": f["node"], "label": f["label"], "keys": [sketch(labelled(_mix(x), 2), AGAIN, 1) for x in seqs]})

    again = words.join(large, "node").select("node", "label", "words").mapInPandas(keys, "node long, label long, keys array<long>")
    tiny = materialize(short.join(large, "node").dropDuplicates(["node"]), "crowded")
    rare = by_rare_runs(tiny, similarity)
    dealt, keys_dealt = mixed(again.select("node", "label", F.explode("keys").alias("key")).unionByName(rare), "dealt")
    found = materialize(solve(near(dealt, keys_dealt), words, similarity), "across")
    over = keys_dealt.filter(F.col("size") > small).select("key")
    if not over.isEmpty():
        large = materialize(blocks(materialize(dealt.join(over, "key"), "over"), 2 * small), "meeting")
        met = materialize(likely(large, signs, similarity, large.count()), "met")
        found = found.unionByName(materialize(solve(met, words, similarity), "across"))
    return maps + classes(found)


def classes(edges: DataFrame) -> list[DataFrame]:
    """The classes of ``edges`` (node, leader), as tables (node, label) that lead on from label to
    label. In each round every node goes over to its smallest neighbour and the links follow,
    until none is left; node numbers are random, so that chains shorten quickly too."""
    live = materialize(edges.filter("node <> leader").select(F.col("node").alias("u"), F.col("leader").alias("v")).distinct(), "links")
    maps: list[DataFrame] = []
    left = live.count()
    while left:
        one = (lambda x: x.coalesce(1)) if left <= ALONE else (lambda x: x)  # so few links need no shuffle
        live = one(live)
        both = one(live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        near = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).filter("label < node")
        maps.append(materialize(near, "near"))
        ends = live
        for side in ("u", "v"):
            to = one(maps[-1]).select(F.col("node").alias(side), F.col("label").alias("to"))
            ends = ends.join(to, side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
        live = materialize(ends.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        left = live.count()
    return maps


def numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` with a ``node``, the number of their word sequence, and all nodes. It is a hash of the
    digest, by the first seed that gives different digests different numbers, so that sketches of
    one sequence by several tasks are one node without a join."""
    for seed in numbers():
        out = rows.withColumn("node", F.xxhash64("digest", F.lit(seed)))
        ids = materialize(out.select("node", "digest").distinct(), "nodes")
        if ids.groupBy("node").count().filter("count > 1").isEmpty():
            return out, ids.select("node")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, sketches: int = SKETCHES, pick: int = PICK, similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: id, ``group_id`` (smallest id of its class), ``group_size``,
    ``kept`` (one row of each class) and ``raw_sha``."""
    rows, ids = numbered(materialize(sketched(docs, id_col, text_col, k, sketches, pick, similarity), "sketches"))
    nodes = rows.filter("sketch IS NOT NULL").select("node", "digest", "n", "sketch", "short", "run", "sign")
    labels = materialize(relabelled(ids, links(docs, nodes, text_col, similarity)).select("node", "label"), "labels")
    named = materialize(rows.select("row", "id", "raw_sha", "node").join(labels, "node").select("row", "id", "raw_sha", "label"), "named")
    best = F.struct(F.col("id").isNull().alias("u"), F.col("id").alias("i"), F.col("row").alias("r"))
    groups = materialize(named.groupBy("label").agg(F.min(best).alias("best"), F.count("*").alias("group_size")), "groups")  # apart, so that Spark splits a hot group in the join
    return named.join(groups, "label").select(
        F.col("id").alias(id_col), F.col("best.i").alias("group_id"), "group_size", (F.col("row") == F.col("best.r")).alias("kept"), "raw_sha"
    )


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read_table(spark, sf_dir, "documents")).select("doc_id", "group_id", "group_size", "kept")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class of near-duplicates stays."""
    kept = near_dedup(docs).filter("kept").select("doc_id", F.col("raw_sha").alias("text_sha"))
    return keep_rows(docs, kept)
