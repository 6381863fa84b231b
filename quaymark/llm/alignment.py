"""Alignment of two tokenizers by an associative fragment monoid.

Tokenizer A encodes a space and the text, tokenizer B the text (it puts the space there
itself), so both cover the same bytes. Byte offsets where tokens of both end cut them into
groups; all A-B pairs of a group are links.

A *fragment* is what a byte range knows of this: the tokens that end in it, as an open
prefix (up to its first common cut), closed groups, and an open suffix (after its last cut);
without any common cut all of it is open. Fragments compose associatively: the left suffix
and the right prefix become one more group, so ranges can be joined in any bracketing and a
text of any length is reduced as a tree of Spark tasks, ``FAN`` fragments at a time.

Texts up to ``CHUNK`` characters are one fragment. Longer ones are cut into byte ranges,
wherever they fall. A range's task encodes it together with the rest of the words it cuts:
neither tokenizer has a token that reaches across a single space between two characters
that are no white space, so what lies between two such spaces is encoded alike alone and in
its text (the tests compare with whole texts). A run without such a space that is longer
than a chunk stays whole.

Words repeat, so a task remembers the groups and links of up to ``MEMORY`` of them. The
links of a document leave its task once, as sorted numbers and their repeats.

An id pair's count is the number of documents that hold it linked: tasks count before they
shuffle, so a pair that all documents hold is one number a task. Documents then look their
pairs up. Up to ``TABLE`` different pairs, a size that is checked, travel as a broadcast
array; beyond it pairs are joined by shuffle. Both ways give the same rows.

Cases: null and empty texts, and texts that either tokenizer does not give back byte for
byte (B reads U+2581 as a space), have no tokens: zeros and an empty ``groups_sha256``.
Repeated rows are separate documents. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table

TOKENIZER_A = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER_B = public_tokenizers.path("piece_bpe_32k.model")
CHUNK, FAN = 32_768, 16
MEMORY = 300_000
TABLE = 4_000_000
_safe = re.compile(r"(?<=\S) (?=\S)")
_doubtful = re.compile(r"\s\s").search
NONE = np.empty(0, np.int64)


class Fragment(NamedTuple):
    """Tokens of a byte range. Without a cut all of them are in the prefix."""

    cut: bool
    prefix: tuple[list[int], list[int]]
    groups: str
    counts: tuple[int, int, int, int]  # tokens of A and B, groups, links; of closed groups
    keys: np.ndarray  # a * size of B + b of the closed groups' links, sorted
    times: np.ndarray
    suffix: tuple[list[int], list[int]]


def group_text(a: list[int], b: list[int]) -> str:
    return ",".join(map(str, a)) + "|" + ",".join(map(str, b))


def merged(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order and the sums of their times."""
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, weights=times, minlength=len(found)).astype(np.int64)


def groups_of(ids_a, ends_a, ids_b, ends_b) -> tuple[list[tuple[list[int], list[int]]], tuple[list[int], list[int]]]:
    """The tokens up to each common end, and those after the last one."""
    found, i, j, from_a, from_b = [], 0, 0, 0, 0
    while i < len(ends_a) and j < len(ends_b):
        if ends_a[i] == ends_b[j]:
            i, j = i + 1, j + 1
            found.append((ids_a[from_a:i], ids_b[from_b:j]))
            from_a, from_b = i, j
        elif ends_a[i] < ends_b[j]:
            i += 1
        else:
            j += 1
    return found, (ids_a[from_a:], ids_b[from_b:])


def closed(groups: list[tuple[list[int], list[int]]], size_b: int) -> tuple:
    """Text, counts, keys and times of closed groups."""
    keys = np.array([a * size_b + b for x, y in groups for a in x for b in y], dtype=np.int64)
    counts = sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(keys)
    return ";".join(group_text(*g) for g in groups), counts, *merged(keys, np.ones(len(keys)))


def fragment(ids_a, ends_a, ids_b, ends_b, lo: int, hi: int, size_b: int) -> Fragment:
    """The fragment of the tokens that end after byte ``lo``, up to ``hi``."""
    a, b = (slice(int(np.searchsorted(e, lo, "right")), int(np.searchsorted(e, hi, "right"))) for e in (ends_a, ends_b))
    groups, rest = groups_of(ids_a[a], ends_a[a], ids_b[b], ends_b[b])
    if not groups:
        return Fragment(False, rest, "", (0, 0, 0, 0), NONE, NONE, ([], []))
    return Fragment(True, groups[0], *closed(groups[1:], size_b), rest)


def compose(x: Fragment, y: Fragment, size_b: int) -> Fragment:
    """The fragment of two adjacent ranges; ``EMPTY`` is its neutral element."""
    if not x.cut:
        return y._replace(prefix=(x.prefix[0] + y.prefix[0], x.prefix[1] + y.prefix[1]))
    joint = x.suffix[0] + y.prefix[0], x.suffix[1] + y.prefix[1]
    if not y.cut:
        return x._replace(suffix=joint)
    text, counts, keys, times = closed([joint] if joint[0] else [], size_b)
    keys, times = merged(np.concatenate([x.keys, keys, y.keys]), np.concatenate([x.times, times, y.times]))
    return Fragment(
        True, x.prefix, ";".join(t for t in (x.groups, text, y.groups) if t),
        tuple(map(sum, zip(x.counts, counts, y.counts))), keys, times, y.suffix,
    )


EMPTY = Fragment(False, ([], []), "", (0, 0, 0, 0), NONE, NONE, ([], []))
#: The start of a text is a cut: composed with it, a whole text has all its groups closed.
START = EMPTY._replace(cut=True)


class Pair:
    """Both tokenizers, the bytes of their tokens, and the words this worker has aligned."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        a.encode_special_tokens = True  # their strings in a text are plain text
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.bytes_a = {i: bytes(byte.get(c, 0x3F) for c in token) for token, i in a.get_vocab().items()}
        self.encode_a = self._by_ranks(path_a) or (lambda text: a.encode(text, add_special_tokens=False).ids)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_b, self.sizes_b = len(pieces), np.array(list(map(len, self.bytes_b)))
        self.sizes_a = np.zeros(max(self.bytes_a) + 1, np.int64)
        for i, token in self.bytes_a.items():
            self.sizes_a[i] = len(token)
        self.known: dict[str, int] = {}  # places of words in what follows
        self.texts, self.counts, self.begin, self.keys, self.used = [], np.zeros((0, 4), np.int64), np.zeros(1, np.int64), NONE, NONE

    def _by_ranks(self, path: str):
        """A byte-level BPE whose merges are in the order of their ids is a table of ranks,
        which another encoder of the same ids works through several times faster."""
        import json

        import tiktoken

        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        vocabulary, split = held["model"]["vocab"], held.get("pre_tokenizer") or {}
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in held["model"]["merges"]]
        if held.get("normalizer") or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space"):
            return None
        if [vocabulary[m] for m in merges] != list(range(256, 256 + len(merges))):
            return None
        special = {t["id"] for t in held.get("added_tokens") or []}
        ranks = {b: i for i, b in self.bytes_a.items() if i not in special}
        return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def forget(self, kept: np.ndarray | None = None) -> None:
        """Empty the memory, but for these words."""
        words = list(self.known) if kept is not None else []
        kept = NONE if kept is None else kept
        texts, self.counts, sizes = [self.texts[k] for k in kept] if len(kept) else [], self.counts[kept], np.diff(self.begin)[kept]
        places = np.repeat(self.begin[kept] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        self.known = {words[k]: n for n, k in enumerate(kept.tolist())}
        self.texts, self.keys, self.begin, self.used = texts, self.keys[places], np.r_[0, np.cumsum(sizes)], np.zeros(len(kept), np.int64)

    def encode(self, words: list[str]) -> tuple | None:
        """Ids and ends of these words, each with its space, one behind the other: of A, of
        B, and the words' own ends. None where bytes differ."""
        text = " ".join(words)
        ids_a, ids_b, raw = self.encode_a(" " + text), self.b.encode(text), (" " + text).encode()
        if not raw == b"".join(map(self.bytes_a.__getitem__, ids_a)) == b"".join(map(self.bytes_b.__getitem__, ids_b)):
            return None
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        return ids_a, np.cumsum(self.sizes_a[ids_a]), ids_b, np.cumsum(self.sizes_b[ids_b]), ends

    def learn(self, words: set[str]) -> None:
        """Align these words, if they are new, and remember them."""
        new = words - self.known.keys()
        if len(self.known) + len(new) > MEMORY:  # those used again, at most half, stay
            order = np.argsort(-self.used, kind="stable")[: MEMORY // 2]
            self.forget(np.sort(order[self.used[order] > 1]))
            new = words - self.known.keys()
        odd = [w for w in new if w[0].isspace() or w[-1].isspace()]  # not safe beside others
        plain = list(new.difference(odd))
        found = [self._aligned(part) for part in ([plain[k : k + 1024] for k in range(0, len(plain), 1024)] + [[w] for w in odd])]
        for part in found:
            for names, texts, _, _, _ in part:
                self.known.update(zip(names, range(len(self.texts), len(self.texts) + len(names))))
                self.texts += texts
        parts = [x for part in found for x in part]
        if parts:
            self.counts = np.concatenate([self.counts, *(x[2] for x in parts)])
            self.keys = np.concatenate([self.keys, *(x[3] for x in parts)])
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(np.concatenate([x[4] for x in parts]))])
            self.used = np.concatenate([self.used, np.zeros(len(self.counts) - len(self.used), np.int64)])

    def _aligned(self, words: list[str]) -> list[tuple]:
        """Words with their groups as text, counts (-1: bytes differ), keys of their links
        and how many these are."""
        found = self.encode(words)
        if found is None:  # some word's bytes differ: each alone
            if len(words) > 1:
                return [x for w in words for x in self._aligned([w])]
            return [(words, [""], np.array([[-1, 0, 0, 0]]), NONE, np.zeros(1, np.int64))]
        ids_a, ends_a, ids_b, ends_b, ends = found
        a, b = np.array(ids_a), np.array(ids_b)
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        n_a, n_b = (np.bincount(np.searchsorted(cuts, e), minlength=len(cuts)) for e in (ends_a, ends_b))
        first_a, first_b, links = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b, n_a * n_b
        group = np.repeat(np.arange(len(cuts)), links)
        nth = np.arange(len(group)) - np.repeat(np.cumsum(links) - links, links)
        keys = a[first_a[group] + nth // n_b[group]] * self.size_b + b[first_b[group] + nth % n_b[group]]
        last = np.searchsorted(cuts, ends, "right")  # groups up to each word's end
        sums = np.diff(np.stack([np.r_[0, np.cumsum(x)][last] for x in (n_a, n_b, np.ones(len(cuts), np.int64), links)], axis=1), axis=0, prepend=0)
        texts = [
            f"{ids_a[i]}|{ids_b[j]}" if m == n == 1 else group_text(ids_a[i : i + m], ids_b[j : j + n])
            for i, m, j, n in zip(first_a.tolist(), n_a.tolist(), first_b.tolist(), n_b.tolist())
        ]
        spans = zip([0, *last.tolist()], last.tolist())
        return [(words, [";".join(texts[x:y]) for x, y in spans], sums, keys, sums[:, 3])]

    def whole(self, words: list[str]) -> tuple[str, tuple, np.ndarray, np.ndarray] | None:
        """Text, counts, keys and times of known words in a row; None where bytes differ."""
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        n = self.counts[at]
        if (n[:, 0] < 0).any():
            return None
        size = n[:, 3]
        places = np.repeat(self.begin[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        keys, times = np.unique(self.keys[places], return_counts=True)
        np.add.at(self.used, at, 1)
        return ";".join(map(self.texts.__getitem__, at.tolist())), tuple(n.sum(axis=0).tolist()), keys, times


_pairs: dict[tuple, Pair] = {}


def loaded(path_a: str, path_b: str) -> Pair:
    if (path_a, path_b) not in _pairs:
        _pairs[path_a, path_b] = Pair(path_a, path_b)
    return _pairs[path_a, path_b]


def words_of(text: str) -> list[str]:
    """A text cut at its safe spaces, which belong to the words after them."""
    return _safe.split(text) if _doubtful(text) or text[0].isspace() or text[-1].isspace() else text.split(" ")


def _last_safe(text: str, at: int) -> int:
    """The last safe space up to ``at``; -1, the space before the text, if there is none."""
    place = text.rfind(" ", 0, at + 1)
    while place > 0 and not _safe.match(text, place):
        place = text.rfind(" ", 0, place)
    return place if place > 0 else -1


def ranges(text: str, chunk: int = CHUNK) -> Iterator[tuple[str, int, int]]:
    """Consecutive byte ranges: the words a range touches, and where the range begins and
    ends in them, as bytes counted from the space before the first word."""
    lo = 0
    while lo < len(text):
        hi = min(lo + chunk, len(text))
        found = _safe.search(text, hi)
        end = found.start() if found else len(text)
        if end - hi > chunk:  # a run longer than a chunk stays whole
            hi = end
        begin = _last_safe(text, lo) + 1
        yield text[begin:end], 0 if lo == max(begin - 1, 0) else 1 + len(text[begin:lo].encode()), 1 + len(text[begin:hi].encode())
        lo = hi


def packed(keys: np.ndarray, times: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys as their differences, and their times; small numbers compress well."""
    steps = np.diff(keys, prepend=0)
    return steps.astype("<u8" if len(steps) and steps.max() >= 1 << 32 else "<u4").tobytes(), times.astype("<u4").tobytes()


def unpacked(keys: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(times) // 4
    return np.cumsum(np.frombuffer(keys, "<u4" if len(keys) == 4 * n else "<u8"), dtype=np.int64), np.frombuffer(times, "<u4").astype(np.int64)


#: Of a document: its counts, the hash of its groups, its links.
ALIGNED = "row_id long, id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys binary, times binary"
FRAGMENT = (
    "row_id long, id string, pos int, ok boolean, cut boolean, prefix_a array<int>, prefix_b array<int>, groups string, "
    "n_a long, n_b long, n_groups long, n_links long, keys binary, times binary, suffix_a array<int>, suffix_b array<int>"
)


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


def _short(paths: tuple[str, str]):
    """Texts of one fragment, whose words are all closed groups."""

    def align(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = loaded(*paths)
        for frame in frames:
            for begin in range(0, len(frame), 256):
                part = frame.iloc[begin : begin + 256]
                words = [words_of(t) if t else [] for t in part["text"]]
                pair.learn({w for ws in words for w in ws})
                rows = []
                for row, name, ws in zip(part["row_id"], part["id"], words):
                    found = pair.whole(ws) if ws else None
                    if found is None:
                        rows.append((row, name, 0, 0, 0, 0, "", b"", b""))
                    else:
                        text, counts, keys, times = found
                        rows.append((row, name, *counts, hashlib.sha256(text.encode()).hexdigest(), *packed(keys, times)))
                yield pd.DataFrame(rows, columns=_names(ALIGNED))

    return align


def _cut(chunk: int):
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row, name, text in zip(frame["row_id"], frame["id"], frame["text"]):
                for pos, (words, lo, hi) in enumerate(ranges(text, chunk)):
                    yield pd.DataFrame({"row_id": [row], "id": [name], "pos": [pos], "words": [words], "lo": [lo], "hi": [hi]})

    return cut


def _as_row(row: int, name: str | None, pos: int, ok: bool, x: Fragment) -> tuple:
    return row, name, pos, ok, x.cut, *x.prefix, x.groups, *x.counts, *packed(x.keys, x.times), *x.suffix


def _fragments(paths: tuple[str, str]):
    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = loaded(*paths)
        for frame in frames:
            parted = [words_of(t) for t in frame["words"]]
            for at, (row, name, pos, words, lo, hi) in enumerate(zip(frame["row_id"], frame["id"], frame["pos"], parted, frame["lo"], frame["hi"])):
                if at % 16 == 0:
                    pair.learn({w for ws in parted[at : at + 16] for w in ws})
                ends = list(accumulate(1 + len(w.encode()) for w in words))
                inside = [k for k, (a, b) in enumerate(zip([0, *ends], ends)) if lo <= a and b <= hi]

                def cut_word(k: int) -> Fragment | None:
                    begin, found = ends[k - 1] if k else 0, pair.encode([words[k]])
                    return fragment(*found[:4], lo - begin, hi - begin, pair.size_b) if found else None

                last, parts = len(words) - 1, []
                if 0 not in inside:
                    parts.append(cut_word(0))
                if inside:  # whole words: cuts on both sides, all groups closed
                    found = pair.whole([words[k] for k in inside])
                    parts.append(Fragment(True, ([], []), *found, ([], [])) if found else None)
                if last > 0 and last not in inside:
                    parts.append(cut_word(last))
                ok = None not in parts
                x = reduce(lambda u, v: compose(u, v, pair.size_b), parts, EMPTY) if ok else EMPTY
                yield pd.DataFrame([_as_row(row, name, pos, ok, x)], columns=_names(FRAGMENT))

    return encode


def _of_row(r) -> Fragment:
    lists = ([int(i) for i in x] for x in (r.prefix_a, r.prefix_b, r.suffix_a, r.suffix_b))
    pa, pb, sa, sb = lists
    return Fragment(bool(r.cut), (pa, pb), r.groups, (r.n_a, r.n_b, r.n_groups, r.n_links), *unpacked(r.keys, r.times), (sa, sb))


def _compose(paths: tuple[str, str], fan: int):
    """``fan`` neighbours of a text into one fragment."""

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        size_b, first, ok = loaded(*paths).size_b, frame.iloc[0], bool(frame["ok"].all())
        parts = map(_of_row, frame.sort_values("pos").itertuples()) if ok else ()
        whole = reduce(lambda x, y: compose(x, y, size_b), parts, EMPTY)
        return pd.DataFrame([_as_row(first["row_id"], first["id"], first["pos"] // fan, ok, whole)], columns=_names(FRAGMENT))

    return join


def _finish(paths: tuple[str, str]):
    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size_b = loaded(*paths).size_b
        for frame in frames:
            for r in frame.itertuples():
                x = compose(START, _of_row(r), size_b) if r.ok else EMPTY
                name = hashlib.sha256(x.groups.encode()).hexdigest() if r.ok else ""
                yield pd.DataFrame([(r.row_id, r.id, *x.counts, name, *packed(x.keys, x.times))], columns=_names(ALIGNED))

    return finish


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] = (TOKENIZER_A, TOKENIZER_B), chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """One row per row of ``docs``: its id as text and the other columns of ``ALIGNED``."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    long = F.char_length(F.coalesce("text", F.lit(""))) > chunk
    done = rows.filter(~long).mapInPandas(_short(paths), ALIGNED)
    parts = rows.filter(long).mapInPandas(_cut(chunk), "row_id long, id string, pos int, words string, lo long, hi long")
    # ranges of one text go to different tasks
    parts = materialize(parts.repartition(F.xxhash64("row_id", "pos")).mapInPandas(_fragments(paths), FRAGMENT), "fragments")
    most = parts.agg(F.max("pos")).first()[0] or 0
    while most > 0:
        parts = materialize(parts.groupBy("row_id", F.floor(F.col("pos") / fan).alias("next")).applyInPandas(_compose(paths, fan), FRAGMENT), "fragments")
        most //= fan
    return materialize(done.unionByName(parts.mapInPandas(_finish(paths), ALIGNED)), "aligned")


def _pair_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many documents of this task hold each pair."""
    kept, waiting = [(NONE, NONE)], 0
    for frame in frames:
        for keys, times in zip(frame["keys"], frame["times"]):
            found = unpacked(keys, times)[0]
            kept.append((found, np.ones(len(found), np.int64)))
            waiting += len(found)
            if waiting > TABLE:
                kept, waiting = [merged(*(np.concatenate(x) for x in zip(*kept)))], 0
    keys, docs = merged(*(np.concatenate(x) for x in zip(*kept)))
    yield pd.DataFrame({"key": keys, "docs": docs})


def _look_up(table):
    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_keys, all_docs, all_best = table.value
        for frame in frames:
            best, total = [], []
            for keys, times in zip(frame["keys"], frame["times"]):
                found, times = unpacked(keys, times)
                at = np.searchsorted(all_keys, found)
                best.append(int(times[all_best[at]].sum()))
                total.append(int((times * all_docs[at]).sum()))
            yield frame.drop(columns=["keys", "times"]).assign(n_best=best, count_sum=total)

    return look


def _exploded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for row, keys, times in zip(frame["row_id"], frame["keys"], frame["times"]):
            found, times = unpacked(keys, times)
            yield pd.DataFrame({"row_id": np.full(len(found), row), "key": found, "times": times})


def cross_align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] = (TOKENIZER_A, TOKENIZER_B), chunk: int = CHUNK, fan: int = FAN, table: int = TABLE) -> DataFrame:
    """One row per row of ``docs``: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``,
    ``n_best`` (links that are their A id's most frequent ones), ``count_sum`` (of the
    links' document counts) and ``groups_sha256``. ``table``: pairs that are broadcast."""
    spark = docs.sparkSession
    rows = align(docs, id_col, text_col, paths, chunk, fan)
    counts = rows.select("keys", "times").mapInPandas(_pair_counts, "key long, docs long").groupBy("key").agg(F.sum("docs").alias("docs"))
    counts = materialize(counts.withColumn("a", F.expr(f"key div {loaded(*paths).size_b}")), "pairs")
    top = counts.groupBy("a").agg(F.max("docs").alias("top"))  # one row a token of A: its vocabulary bounds it
    pairs = counts.join(F.broadcast(top), "a").select("key", "docs", (F.col("docs") == F.col("top")).alias("best"))
    if counts.count() <= table:
        held = pairs.toArrow()
        order = np.argsort(held["key"].to_numpy())
        held = spark.sparkContext.broadcast(tuple(held[c].to_numpy()[order] for c in ("key", "docs", "best")))
        out = rows.mapInPandas(_look_up(held), ALIGNED.replace(", keys binary, times binary", ", n_best long, count_sum long"))
    else:
        links = rows.select("row_id", "keys", "times").mapInPandas(_exploded, "row_id long, key long, times long").join(pairs, "key")
        sums = links.groupBy("row_id").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum")
        )
        out = rows.join(sums, "row_id", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})
    return out.select(F.col("id").cast("long").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_align(read_table(spark, sf_dir, "documents"))
