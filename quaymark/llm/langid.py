"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text gives, at any place of another text,
the longest piece found in that language's sample. Parsing a text greedily into such
pieces, a language needs c phrases; c * log2(size of the sample) is what they cost in
bits, and the language with the lowest cost wins (ties: the smaller code by code point).
Texts are parsed in segments of ``SEGMENT`` characters, the costs added up, so that many
segments of many texts advance together, one numpy step for each character position.

The automata are fitted on a bounded sample of labelled rows: of each language about
``SAMPLE_ROWS`` rows by hash of the id, of each at most ``WINDOW`` characters (a window
whose place the hash gives), together at most ``SAMPLE_CHARS``. Only they are sent to the
executors; their size depends on the number of languages, not on the corpus. Whole texts
are parsed. Letters are lower-cased; everything else counts as a gap.

Cases: null texts and texts without a letter are ``und`` with score 0; a letter that no
sample has is a phrase of its own in every language; without any labelled text every
answer is ``und``. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_crc, read_table

SAMPLE_ROWS = 200
WINDOW = 400
SAMPLE_CHARS = 20_000
SEGMENT = 512
BLOCK = 4096
TABLE = 0x250  # code points in the table of symbols, or up to the largest letter of the samples
DENSE = 94  # most frequent letters, whose transitions are a table; those of others are sorted keys


def automaton_moves(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all pieces of ``symbols`` (state 0 is the empty piece)."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return moves


def suffix_automaton(symbols: list[int], alphabet: int) -> np.ndarray:
    """Those transitions as a table (-1: no such piece)."""
    return _table(automaton_moves(symbols), alphabet)


def _table(moves: list[dict[int, int]], alphabet: int) -> np.ndarray:
    """The transitions by the symbols below ``alphabet``."""
    table = np.full((len(moves), alphabet), -1, np.int32)
    for state, row in enumerate(moves):
        for c, to in row.items():
            if c < alphabet:
                table[state, c] = to
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def build(samples: dict[str, str]) -> dict | None:
    """The model: one table with the automata of all languages, one after the other, and the
    transitions by rarer letters (many, in a script of thousands) as sorted keys."""
    samples = {k: v for k, v in sorted(samples.items()) if any(c.isalpha() for c in v)}
    if not samples:
        return None
    seen = Counter(c for text in samples.values() for c in text.lower() if c.isalpha())
    letters = sorted(seen, key=lambda c: (-seen[c], c))
    gap, every, width = 1, len(letters) + 2, min(len(letters), DENSE) + 2  # symbol 0 is a letter that no sample has
    known = max(TABLE, max(map(ord, letters)) + 1)
    symbol = np.full(known, gap, np.uint8 if every < 256 else np.uint16 if every < 65536 else np.uint32)
    for cp in range(known):
        if chr(cp).isalpha():
            symbol[cp] = 0
    for k, c in enumerate(letters):
        symbol[ord(c)] = k + 2
    tables, roots, sizes, at = [], [], [], 0
    rare: dict[int, int] = {}
    for text in samples.values():
        moves = automaton_moves(_symbols(text, symbol).tolist())
        table = _table(moves, width)
        table[:, 0] = -1
        tables.append(np.where(table >= 0, (table + at) * width, -1))
        rare |= {(state + at) * width * every + c: (to + at) * width for state, row in enumerate(moves) for c, to in row.items() if c >= width}
        roots.append(at * width)
        sizes.append(max(2, len(text)))
        at += len(moves)
    tables.append(np.full((1, width), -1))  # the state no piece continues: before a text, and after an unknown letter
    kind = np.int64 if (at + 1) * width > 2**31 - 1 else np.int32
    keys = np.array(sorted(rare), np.int64)
    model = {"languages": list(samples), "symbol": symbol, "moves": np.concatenate(tables).ravel().astype(kind), "start": at * width, "bits": np.log2(sizes)}
    model |= {"width": width, "every": every, "keys": keys, "values": np.array([rare[k] for k in keys.tolist()], kind)}
    again = _next(model, np.repeat(np.array(roots, kind)[:, None], every, axis=1), np.arange(every))
    model["again"] = np.where(again < 0, at * width, again).astype(kind)
    return model


def _next(model: dict, state: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The states that the symbols ``c`` (one a column) lead to; -1: none."""
    moves, width, keys = model["moves"], model["width"], model["keys"]
    if not len(keys):
        return moves[state + c]
    far = np.flatnonzero(c >= width)
    to = moves[state + np.where(c < width, c, 0)]
    if len(far):
        asked = state[:, far].astype(np.int64) * model["every"] + c[far].astype(np.int64)
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        to[:, far] = np.where(keys[at] == asked, model["values"][at], -1)
    return to


def _symbols(text: str, symbol: np.ndarray) -> np.ndarray:
    cps = code_points(text)
    out = symbol[np.minimum(cps, len(symbol) - 1)]
    far = cps >= len(symbol)
    if far.any():
        chars = np.unique(cps[far])
        alpha = np.array([chr(c).isalpha() for c in chars.tolist()])
        out[far] = np.where(alpha[np.searchsorted(chars, cps[far])], 0, 1)
    return out


def phrases(model: dict, segments: list[np.ndarray]) -> np.ndarray:
    """Phrases of each segment (rows) in each language (columns)."""
    counts = np.zeros((len(segments), len(model["languages"])), np.int64)
    if not segments:
        return counts
    sizes = np.array([len(s) for s in segments])
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    grid = np.zeros((int(sizes[0]), len(segments)), model["symbol"].dtype)
    for k, at in enumerate(order.tolist()):
        grid[: sizes[k], k] = segments[at]
    again = model["again"]
    state = np.full((len(model["languages"]), len(segments)), model["start"], again.dtype)
    found = np.zeros(state.shape, np.int32)
    live = np.searchsorted(-sizes, -np.arange(1, len(grid) + 1), side="right")
    for t, n in enumerate(live.tolist()):
        c = grid[t, :n]
        to = _next(model, state[:, :n], c)
        miss = to < 0
        found[:, :n] += miss
        state[:, :n] = np.where(miss, again[:, c], to)
    counts[order] = found.T
    return counts


def predict(model: dict | None, texts) -> tuple[list[str], np.ndarray]:
    """Language and score (chance against the other languages, tempered) of each text."""
    langs, scores = ["und"] * len(texts), np.zeros(len(texts))
    if model is None:
        return langs, scores
    bits = np.zeros((len(texts), len(model["languages"])))
    sizes = np.zeros(len(texts))
    segments: list[np.ndarray] = []
    owner: list[int] = []

    def flush() -> None:
        if segments:
            np.add.at(bits, owner, phrases(model, segments) * model["bits"])
            segments.clear()
            owner.clear()

    for k, text in enumerate(texts):
        if not text or not any(map(str.isalpha, text)):
            continue
        symbols = _symbols(text, model["symbol"])
        sizes[k] = len(symbols)
        for at in range(0, len(symbols), SEGMENT):
            segments.append(symbols[at : at + SEGMENT])
            owner.append(k)
            if len(segments) >= BLOCK:
                flush()
    flush()
    for k in np.flatnonzero(sizes).tolist():
        best = int(bits[k].argmin())
        langs[k] = model["languages"][best]
        scores[k] = 1 / np.exp2(np.clip((bits[k][best] - bits[k]) / 8, -60, 0)).sum()
    return langs, scores


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, window: int = WINDOW, chars: int = SAMPLE_CHARS) -> dict | None:
    """Automata from the training part of ``docs`` (text, lang, doc_id)."""
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").filter(id_crc("doc_id") % 4 != 2)
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return None
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 2 * rows / r["count"])))])
    hashed = F.xxhash64("doc_id", F.lit(4))
    some = known.withColumn("__h", hashed).filter(F.pmod("__h", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    pieces = some.select("lang", "__h", F.expr("substring(text, cast(pmod(__h, greatest(char_length(text) - %d, 0) + 1) as int) + 1, %d)" % (window, window)).alias("piece"))
    samples: dict[str, str] = {}
    for r in sorted(pieces.collect(), key=lambda r: (r["__h"], r["piece"])):  # about 2 * rows pieces a language
        have = samples.get(r["lang"], "")
        if len(have) < chars:
            samples[r["lang"]] = have + r["piece"][: chars - len(have)] + "\n"
    return build(samples)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = spark.sparkContext.broadcast(train(docs.select("doc_id", "text", "lang")))

    def rows(frames):
        for f in frames:
            lang, score = predict(model.value, f["text"])
            yield pd.DataFrame({"doc_id": f["doc_id"], "held_out": f["held_out"], "lang_pred": lang, "score": score})

    part = docs.select("doc_id", (id_crc("doc_id") % 4 == 2).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return part.mapInPandas(rows, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
