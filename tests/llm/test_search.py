"""Ranked lexical search against a plain evaluation and on edge cases."""

import math
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quaymark.llm import search

DOCS = "doc_id long, text string, item_id long, rank int, score double"
ITEMS = "item_id long, text string, doc_id long"


def tables(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 1, 2, 3.0) for i, t in docs], DOCS),
        spark.createDataFrame([(i, t, 9) for i, t in items], ITEMS),
    )


def plain(docs, items, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def split(text):
        out, word = [], ""
        for c in (text or "").translate(lower) + " ":
            if c.isdigit() and c.isascii() or "a" <= c <= "z" or ord(c) > 127:
                word += c
            elif word:
                out, word = [*out, word], ""
        return out

    held = [Counter(split(t)) for _, t in docs]
    n_docs, total = sum(1 for h in held if h), sum(sum(h.values()) for h in held)
    df = Counter(t for h in held for t in h)
    out = []
    for item, text in items:
        scored = []
        for (doc, _), h in zip(docs, held):
            n = sum(h.values())
            if n:
                m = 10 + 90 * n * n_docs // total
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * h[t] // (1000 * h[t] + 8 * m)) for t in set(split(text)) if h[t])
                if s > 0:
                    scored.append((-s, doc is None, doc or 0))
        out += [(item, r, None if u else d, -s) for r, (s, u, d) in enumerate(sorted(scored)[:top], 1)]
    return Counter(out)


@pytest.mark.parametrize("block", [512, 3])
def test_search_matches_plain_evaluation(spark, block):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)] + ["Été", "ÀB", "x9"]
    docs = [(k // 2 if k > 40 else k, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for k in range(120)]
    docs += [(None, "w1 w2 w3"), (None, None), (500, ""), (501, "... --- ..."), (502, " ".join(rng.choices(words, k=20_000))), (503, "w1-w2_W3"), (503, "w1-w2_W3")]
    items = [(k % 9, " ".join(rng.choices(words, k=rng.randint(1, 25)))) for k in range(14)] + [(None, "w1 W2"), (77, None), (78, ""), (79, "never"), (80, "w1 w1 w2")]
    d, i = tables(spark, docs, items)
    out = search.lexical_search(d, i, block=block)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in out.collect()) == plain(docs, items, 10)


def test_search_of_nothing(spark):
    for docs, items in [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")]), ([], [])]:
        d, i = tables(spark, docs, items)
        assert search.lexical_search(d, i).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), max_size=9), max_size=9))
def test_shared_sums_are_the_sets(sets):
    nodes, sums = search.share_sums([sorted(s) for s in sets], 13)

    def leaves(k):
        return [k] if k < 13 else [x for o in nodes[k - 13] for x in leaves(o)]

    assert [sorted(x for o in operands for x in leaves(o)) for operands in sums] == [sorted(s) for s in sets]


def test_a_shared_set_is_summed_once():
    nodes, sums = search.share_sums([[0, 1, 2, 3, 4], [0, 1, 2, 3, 5], [0, 1, 2, 3, 6]], 7)
    assert len(nodes) == 3 and all(len(s) == 2 for s in sums)
