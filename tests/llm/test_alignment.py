"""Cross-tokenizer alignment against whole texts encoded alone, the monoid's laws, edge cases."""

import hashlib
import random
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quaymark.llm import alignment as al

DOCS = "doc_id long, text string, n_a long, id string, keys string, pos int"
PIECES = ["the ", "Über", " ", "  ", "\n", "\t ", "a", "éé", "漢字", "🙂", "don't", "123", "<|endoftext|>", "</s>", "...", " ", "​", "x " * 5, "\x1c", "-- ", "é"]


def plain(rows):
    """Each text encoded whole; all counts by dictionaries."""
    from tokenizers import Tokenizer

    pair, tokenizer = al.loaded(al.TOKENIZER_A, al.TOKENIZER_B), Tokenizer.from_file(al.TOKENIZER_A)
    tokenizer.encode_special_tokens = True
    docs, count = [], Counter()
    for i, text in rows:
        groups = []
        if text:
            a = tokenizer.encode(" " + text, add_special_tokens=False).ids
            b = pair.b.encode(text)
            raw = (" " + text).encode()
            if b"".join(pair.bytes_a[x] for x in a) == raw == b"".join(pair.bytes_b[x] for x in b):
                at, spots = 0, defaultdict(lambda: ([], []))
                ends_a, ends_b = np.cumsum([len(pair.bytes_a[x]) for x in a]), np.cumsum([len(pair.bytes_b[x]) for x in b])
                cuts = sorted(set(ends_a) & set(ends_b))
                for side, ids, ends in ((0, a, ends_a), (1, b, ends_b)):
                    for x, e in zip(ids, ends):
                        spots[next(c for c in cuts[int(np.searchsorted(cuts, e)) :])][side].append(x)
                groups = [spots[c] for c in cuts]
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        count.update(set(links))
        docs.append((i, groups, links))
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return Counter(
        (
            i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
            sum(count[k] == top[k[0]] for k in links), sum(count[k] for k in links),
            hashlib.sha256(";".join(al.group_text(*g) for g in groups).encode()).hexdigest() if groups else "",
        )
        for i, groups, links in docs
    )


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("chunk,fan,table", [(32_768, 16, 10**6), (23, 2, 10**6), (60, 3, 0)])
def test_alignment_matches_whole_texts(spark, chunk, fan, table):
    rows = list(enumerate(odd_texts(150))) + [(3, "same text"), (3, "same text"), (None, "same text"), (900, None), (901, ""), (902, " "), (903, "a▁b"), (904, "x" * 3000), (905, "\n"), (906, "word " * 4000), (907, " lead and trail ")]
    docs = spark.createDataFrame([(i, t, 1, "x", "y", 2) for i, t in rows], DOCS)
    out = al.cross_align(docs, chunk=chunk, fan=fan, table=table)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got, want = Counter(tuple(r) for r in out.collect()), plain(rows)
    assert got == want


def test_alignment_of_nothing(spark):
    assert al.cross_align(spark.createDataFrame([], DOCS)).count() == 0


ENDS = st.lists(st.integers(1, 4), min_size=1, max_size=30)


@settings(max_examples=200, deadline=None)
@given(ENDS, ENDS, st.lists(st.integers(0, 60), max_size=6), st.randoms())
def test_fragments_compose_in_any_bracketing(a, b, cuts, rng):
    short = min(sum(a), sum(b))  # both cover the same bytes
    ends = [[e for e in np.cumsum(x).tolist() if e < short] + [short] for x in (a, b)]
    ids = [list(range(len(e))) for e in ends]
    bounds = sorted({0, short, *(c for c in cuts if c < short)})
    parts = [al.fragment(ids[0], ends[0], ids[1], ends[1], lo, hi, 100) for lo, hi in zip(bounds, bounds[1:])]
    whole = al.compose(al.START, al.fragment(ids[0], ends[0], ids[1], ends[1], 0, short, 100), 100)
    while len(parts) > 1:  # any two neighbours first
        k = rng.randrange(len(parts) - 1)
        parts[k : k + 2] = [al.compose(parts[k], parts[k + 1], 100)]
    got = al.compose(al.START, al.compose(al.compose(al.EMPTY, parts[0], 100), al.EMPTY, 100), 100)
    assert got.suffix == ([], []) and got.groups == whole.groups and got.counts == whole.counts
    assert got.keys.tolist() == whole.keys.tolist() and got.times.tolist() == whole.times.tolist()
    assert got.groups == ";".join(al.group_text(*g) for g in al.groups_of(ids[0], ends[0], ids[1], ends[1])[0])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join), st.integers(1, 25))
def test_ranges_cover_the_text_once(text, chunk):
    total = 0
    for words, lo, hi in al.ranges(text, chunk):
        raw = (" " + words).encode()
        assert 0 <= lo < hi <= len(raw)
        total += hi - lo
    assert total == (1 + len(text.encode()) if text else 0)


def test_fragments_are_open_where_a_range_cuts_a_word():
    parts = [(words, lo, hi) for words, lo, hi in al.ranges("some words here " * 20, 10)]
    assert any(lo > 0 for _, lo, _ in parts) and any(hi < len(words) for words, _, hi in parts)
    assert reduce(lambda n, p: n + p[2] - p[1], parts, 0) == 321


def test_ranks_give_the_tokenizer_s_ids_and_memory_forgets(monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(al.TOKENIZER_A)
    tokenizer.encode_special_tokens = True
    pair = al.Pair(al.TOKENIZER_A, al.TOKENIZER_B)
    texts = odd_texts(1500, 11)
    assert [pair.encode_a(t) for t in texts] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    want = {t: pair.whole(al.words_of(t)) for t in texts[:200] if not pair.learn(set(al.words_of(t)))}
    monkeypatch.setattr(al, "MEMORY", 40)
    for t in texts[:200]:
        pair.learn(set(al.words_of(t)))
        got = pair.whole(al.words_of(t))
        assert (got is None) == (want[t] is None)
        if got:
            assert got[:2] == want[t][:2] and got[2].tolist() == want[t][2].tolist() and got[3].tolist() == want[t][3].tolist()
    assert len(pair.known) < 100
