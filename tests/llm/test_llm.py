"""The ten operators on small tables, against brute force and on edge cases."""

import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import functions as F  # noqa: E402

from quaymark.llm import ann, chat, common, exact_dedup, langid, lm, mixing, near_dedup, packing, quality, url_filter  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, name string, h string"


def texts(spark, rows):
    """Documents with extra columns whose names clash with what operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y") for i, t, s in rows], DOCS)


def edge_rows():
    long = " ".join(f"word{k % 997}" for k in range(30_000))
    return [(1, None, "a"), (2, "", "b"), (3, " \t\n", None), (4, "same text here", "a"), (4, "same text here", "a"), (None, "same  text here ", "b"), (None, "other", None), (7, long, "a"), (8, long, "a"), (9, long + " tail", "b")]


# -- exact dedup ------------------------------------------------------------------------


def brute_exact(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", "", t or "")
    groups = defaultdict(list)
    for k, (i, t, _) in enumerate(rows):
        groups[norm(t)].append((-len(t or ""), i is None, i or 0, k))
    keep = {}
    for members in groups.values():
        best = min(members)
        for m in members:
            keep[m[3]] = (None if best[1] else best[2], len(members))
    return Counter((rows[k][0], *v) for k, v in keep.items())


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_dedup_matches_brute_force_even_when_all_keys_clash(spark, bits):
    rows = edge_rows() + [(20 + k, "".join(random.Random(k % 7).choices("ab", k=40)), "c") for k in range(30)]
    out = exact_dedup.exact_dedup(texts(spark, rows), block=8 if bits == 2 else 4096, key_bits=bits).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in out) == brute_exact(rows)
    assert sum(r["kept"] for r in out) == len({re.sub(r"\s+", "", t or "") for _, t, _ in rows})


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_dedup(texts(spark, [])).count() == 0


def test_exact_stage_keeps_one_of_repeated_rows(spark):
    kept = exact_dedup.exact_stage(spark, texts(spark, edge_rows()), SF)
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert kept.count() == 5


# -- near dedup ---------------------------------------------------------------------------


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (x != y)))
        row = nxt
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.integers(0, 8))
def test_banded_distance(a, b, most):
    assert near_dedup.distance_within(a, b, most) == (plain_distance(a, b) <= most)


def test_near_dedup_finds_every_class(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    common = rng.choices(vocabulary, k=9)
    rows, truth = [], []
    for g in range(40):
        base = (common if g % 2 else []) + rng.choices(vocabulary, k=rng.randint(12, 120))
        for _ in range(rng.choice([1, 1, 2, 4])):
            words = list(base)
            for _ in range(int(0.04 * len(words))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words), "s"))
            truth.append(g)
    out = {r["doc_id"]: r["group_id"] for r in near_dedup.near_dedup(texts(spark, rows)).collect()}
    seqs = [r[1].split() for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if plain_distance(seqs[a], seqs[b]) <= int(0.2 * max(len(seqs[a]), len(seqs[b]))):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert out == {k: find(k) for k in range(len(rows))}


def found_classes(spark, rows, small=128, sketches=24, pick=2):
    """The class of each id by the operator's links, with buckets of more than ``small`` nodes called large."""
    docs = texts(spark, rows)
    table = common.materialize(near_dedup.sketched(docs, "doc_id", "text", 5, sketches, pick), "sketches")
    nodes = table.withColumn("node", F.xxhash64("row"))
    labels = near_dedup.relabelled(nodes.select("id", "node"), near_dedup.links(docs, nodes, "text", 0.8, small=small))
    return {r["id"]: r["label"] for r in labels.collect()}, [(r["id"], r["sketch"], r["n"]) for r in nodes.collect()]


def partition(labels):
    groups = defaultdict(set)
    for k, v in labels.items():
        groups[v].add(k)
    return {frozenset(g) for g in groups.values()}


def classes_of_pairs(rows, sketched, every=False):
    """Classes when all pairs that share a value (or are short texts), or ``every`` pair, are compared."""
    seqs = {i: np.array([zlib.crc32(w.encode()) for w in t.split()], np.uint32).tobytes() for i, t, _ in rows}
    parent = {i: i for i in seqs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, sa, na in sketched:
        for b, sb, nb in sketched:
            if a < b and (every or max(na, nb) <= near_dedup.SHORT / 0.8 or set(sa) & set(sb)) and find(a) != find(b) and near_dedup.same(seqs[a], seqs[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return partition({i: find(i) for i in seqs})


def test_near_dedup_divides_large_buckets_without_losing_links(spark):
    hot = [f"h{k}" for k in range(9)]
    rows = [(k, " ".join(hot + [f"u{k // 2}a", f"u{k // 2}b", f"u{k // 2}c", f"u{k // 2}d"]), "s") for k in range(40)]
    rows = [(k, t + (" x" if k % 2 else ""), s) for k, t, s in rows]
    labels, _ = found_classes(spark, rows, small=2)
    assert partition(labels) == {frozenset((2 * k, 2 * k + 1)) for k in range(20)}


@pytest.mark.parametrize("small", [2, 128])
def test_near_dedup_links_copies_through_a_text_that_matches_them_all(spark, small):
    hub = [f"h{k}" for k in range(100)]
    rows = [(0, " ".join(hub), "s")]
    for k in range(1, 49):  # notes at different places are 24 edits apart, two more than a match allows
        at = k % 8 * 12 + 6
        rows.append((k, " ".join(hub[:at] + [f"n{k}.{j}" for j in range(12)] + hub[at:]), "s"))
    rows.append((49, " ".join(f"z{k}" for k in range(100)), "s"))
    labels, _ = found_classes(spark, rows, small=small)
    assert partition(labels) == {frozenset(range(49)), frozenset((49,))}


@pytest.mark.parametrize(("copies", "size", "small"), [(300, 60, 128), (300, 90, 8)])
def test_near_dedup_keeps_all_links_of_large_groups(spark, copies, size, small):
    rng = random.Random(copies + size)
    base = [f"b{k}" for k in range(size)]
    rows = []
    for i in range(copies):
        words = list(base)
        for at in rng.sample(range(size), rng.randint(size // 20, size // 4)):
            words[at] = f"x{i}.{at}"
        rows.append((i, " ".join(words), "s"))
    labels, sketched = found_classes(spark, rows, small=small)
    mine = partition(labels)
    assert all(any(c <= m for m in mine) for c in classes_of_pairs(rows, sketched))
    true = classes_of_pairs(rows, sketched, every=True)
    assert all(any(m <= c for c in true) for m in mine)


def test_near_dedup_follows_chains_at_the_threshold(spark):
    rows = []
    for k in range(12):  # neighbours are 20 of 100 edits apart, all others more
        rows.append((k, " ".join(f"w{j}.{k}" if j // 20 == k % 5 else f"w{j}.{k - (k - j // 20) % 5}" for j in range(100)), "s"))
    labels, _ = found_classes(spark, rows, sketches=72)
    assert partition(labels) == {frozenset(range(12))}


def test_classes_contract_long_chains_and_stars(spark):
    rng = random.Random(3)
    ids = rng.sample(range(10**9), 600)
    chain = list(zip(ids[:400], ids[1:400], strict=False))
    star = [(ids[400], x) for x in ids[401:]]
    edges = spark.createDataFrame([e for pair in chain + star for e in (pair, pair[::-1])], "node long, leader long")
    nodes = spark.createDataFrame([(x,) for x in ids], "node long")
    labels = {r["node"]: r["label"] for r in near_dedup.relabelled(nodes, near_dedup.classes(edges)).collect()}
    assert partition(labels) == {frozenset(ids[:400]), frozenset(ids[400:])}


def test_near_dedup_sketches_bring_similar_texts_together():
    rng = np.random.default_rng(11)
    for n, edits, least in ((70, 0.2, 0.86), (100, 0.2, 0.86), (400, 0.2, 0.86), (70, 0.15, 0.97), (400, 0.15, 0.97), (400, 0.1, 0.99)):
        met = 0
        for _ in range(200):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            b = a.copy()
            at = rng.choice(n, int(edits * n + 1e-9), replace=False)
            b[at] = rng.integers(0, 2**63, len(at)).astype(np.uint64)
            va, vb = (near_dedup.sketch(near_dedup.labelled(w)) for w in (a, b))
            met += bool((va == vb).any())
        assert met >= least * 200, (n, edits)


def test_near_dedup_finds_short_texts_with_a_word_changed_in_the_middle(spark):
    rows = []
    for g in range(30):
        w = [f"g{g}w{k}" for k in range(5 + g % 6)]
        rows += [(2 * g, " ".join(w), "s"), (2 * g + 1, " ".join(w[: len(w) // 2] + ["x"] + w[len(w) // 2 + 1 :]), "s")]
    out = {r["doc_id"]: r["group_id"] for r in near_dedup.near_dedup(texts(spark, rows)).collect()}
    assert out == {k: k // 2 * 2 for k in range(60)}


@pytest.mark.parametrize("small", [512, 16])
def test_near_dedup_misses_no_pair_at_the_threshold_up_to_the_filter_s_length(spark, small):
    rng, rows, truth = random.Random(8), [], set()
    for n in (5, 10, 30, 64, 65, 66, 80, 100, 120, 149, 150):
        for _ in range(12):
            base = [f"w{rng.randrange(400)}" for _ in range(n)]
            longer = int(n / 0.8) if rng.random() < 0.5 else n  # words added, or changed
            words = list(base)
            if longer > n:
                for _ in range(longer - n):
                    words.insert(rng.randrange(len(words) + 1), f"x{rng.random()}")
            else:
                for at in rng.sample(range(n), int(0.2 * n)):
                    words[at] = f"x{rng.random()}"
            truth.add(frozenset((len(rows), len(rows) + 1)))
            rows += [(len(rows), " ".join(base), "s"), (len(rows) + 1, " ".join(words), "s")]
    labels, _ = found_classes(spark, rows, sketches=near_dedup.SKETCHES, small=small)
    assert partition(labels) == truth


def test_near_dedup_classes_of_many_short_copies_are_those_of_all_pairs(spark):
    rng = random.Random(12)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(700):
        words = list(base)
        for at in rng.sample(range(120), rng.randint(12, 30)):
            words[at] = f"x{i}.{at}"
        rows.append((i, " ".join(words), "s"))
    labels, sketched = found_classes(spark, rows, sketches=near_dedup.SKETCHES)
    assert partition(labels) == classes_of_pairs(rows, sketched, every=True)


def test_near_dedup_fetches_no_texts_that_only_share_a_passage(spark, monkeypatch):
    rng = random.Random(17)
    passage = " ".join(f"shared{k}" for k in range(30))
    rows = [(k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) + " " + passage, "") for k in range(200)]
    rows.append((200, rows[7][1].replace(passage, passage + " more"), ""))
    written = defaultdict(int)

    def counted(df, label):
        out = common.materialize(df, label)
        written[label] += out.count()
        return out

    monkeypatch.setattr(near_dedup, "materialize", counted)
    out = {r["doc_id"]: r["group_id"] for r in near_dedup.near_dedup(texts(spark, rows)).collect()}
    assert out == {k: 7 if k == 200 else k for k in range(201)}
    assert written["asked"] > 100 and written["words"] <= 10


def test_near_dedup_signs_rule_out_no_match():
    rng = random.Random(18)
    ruled_out = 0
    for n in [1, 5, 10, 40, 150, 400]:
        for _ in range(60):
            a = [f"w{rng.randrange(3000)}" for _ in range(n)]
            b, most = list(a), int(0.2 * n + 1e-9)
            for _ in range(most):
                at = rng.randrange(len(b))
                b[at : at + rng.randrange(2)] = [f"x{rng.randrange(3000)}"] * rng.randrange(2)
            c = [f"w{rng.randrange(3000)}" for _ in range(n)]
            hashed = [np.array([xxhash.xxh3_64_intdigest(w) for w in x], np.uint64) for x in (a, b, c)]
            signs = np.stack([near_dedup.sign_of(h) for h in hashed]).view(np.uint64)
            size, own = np.array([len(h) for h in hashed]), np.zeros(3, np.int64)
            if plain_distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9):
                assert near_dedup.partnered(np.array([1, 2]), own[:2], size[:2], signs[:2], 0.8).all()
            ruled_out += not near_dedup.partnered(np.array([1, 2]), own[:2], size[[0, 2]], signs[[0, 2]], 0.8).any()
    assert ruled_out > 240


def test_near_dedup_aligns_no_texts_that_share_too_few_rare_words(monkeypatch):
    rng = random.Random(11)
    # every word is in two or three of the texts, but no two texts share many
    texts_of = [[] for _ in range(200)]
    for word in range(4000):
        for t in rng.sample(range(200), rng.choice((2, 3))):
            texts_of[t] += [word] * rng.choice((1, 1, 2))
    texts_of[7] = texts_of[3][:-2] + [9999, 9999]
    seqs = [np.array(x, np.uint32).tobytes() for x in texts_of]
    some = np.array([0, 3, 7, 50, 199])
    shared = [[sum((Counter(texts_of[a]) & Counter(x)).values()) for x in texts_of] for a in some]
    got = near_dedup._overlaps(seqs, some)
    kept = np.arange(200)[None, :] != some[:, None]
    assert (got == np.array(shared))[kept].all()
    aligned = []
    alike = near_dedup._alike
    monkeypatch.setattr(near_dedup, "_alike", lambda a, b, most: aligned.append(1) or alike(a, b, most))
    assert near_dedup.linked(list(range(200)), [0] * 200, seqs, 0.8) == [(3, 7)] and len(aligned) == 1


def test_near_dedup_takes_the_nodes_of_large_buckets_once(spark, monkeypatch):
    rng = random.Random(12)
    passage = " ".join(f"p{j}" for j in range(45))
    rows = [(i, passage + " " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(35)), "") for i in range(60)]
    written = Counter()

    def counted(df, label):
        out = common.materialize(df, label)
        written[label] += out.count()
        return out

    monkeypatch.setattr(near_dedup, "materialize", counted)
    labels, _ = found_classes(spark, rows, sketches=near_dedup.SKETCHES, small=8)
    assert len(set(labels.values())) == 60
    assert written["hot-keys"] and 0 < written["crowd"] <= 60 and not written["rest"]


def test_near_dedup_edges(spark):
    out = near_dedup.near_dedup(texts(spark, edge_rows())).collect()
    assert len(out) == len(edge_rows())
    groups = Counter(r["group_size"] for r in out)
    assert groups == Counter({3: 6, 1: 1, 0: 0}) + Counter() or groups[3] >= 3
    assert near_dedup.near_dedup(texts(spark, [])).count() == 0


# -- mixing -------------------------------------------------------------------------------


def test_capped_targets():
    t = mixing.capped_targets([100, 100, 100], [1, 2, 3])
    assert t == [50.0, 100.0, 150.0]
    t = mixing.capped_targets([10, 1000], [3, 1])
    assert t == [30.0, 980.0]
    assert mixing.capped_targets([0, 5], [1, 2]) == [0.0, 5.0]


def test_mix_meets_targets_and_reruns_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = (mixing.mix(docs).toPandas().sort_values("doc_id").reset_index(drop=True) for _ in range(2))
    assert a.equals(b)
    sizes = dict(zip(a["doc_id"], a["size"], strict=True))
    for r in docs.collect():
        assert sizes[r["doc_id"]] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    for s, g in a.groupby(a["doc_id"].map(source)):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= max(30, 0.01 * g["target"].iloc[0]), s
    assert (a["taken"] <= 3 * a["size"]).all()


def test_mix_plans_many_sources_as_few(spark):
    """The plan over any number of sources is that of the driver's, ties, nulls and empty sources included."""
    rng = random.Random(3)
    rows = [(None if k == 7 else f"s{k:04d}" if k % 2 else f"\u00e9{k}", rng.choice([0, 1, 10, 100, 10_000, 1_000_000]), rng.randint(1, 9)) for k in range(60)]
    cells = spark.createDataFrame(rows, "source string, size long, n long")
    few, many = ({r["source"]: r for r in p.collect()} for p in (mixing.planned(cells), mixing.planned(cells, most=10)))
    assert few.keys() == many.keys() and sum(r["source_size"] for r in many.values()) == sum(r[1] for r in rows)
    for s, r in few.items():
        assert many[s]["buckets"] == r["buckets"] and many[s]["target"] == pytest.approx(r["target"], rel=1e-9)
        if r["source_size"]:
            assert many[s]["rate"] == pytest.approx(r["rate"], rel=1e-6)


def test_mix_deals_repeated_rows_in_lots(spark):
    """A row repeated thousands of times is split over buckets; every row comes back."""
    rows = [(1, "a b c", "en", "x")] * 3000 + [(k, "w " * (k % 9 + 1), "en", "y") for k in range(2, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("size", F.lit("z")).withColumn("bucket", F.lit("z")).withColumn("lot", F.lit("z"))
    out = mixing.mix(docs, bucket=500)
    got = out.groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in got} == {1: 3000, **{k: 1 for k in range(2, 400)}}
    for r in out.groupBy("target").agg(F.sum("taken").alias("t")).collect():
        assert abs(r["t"] - r["target"]) <= 30
    few = mixing.mix(docs, bucket=500, most=1).groupBy("target").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(r["t"] - r["target"]) <= 30 for r in few)


def test_two_margins_balance(spark):
    cells = spark.createDataFrame([("a", "x", 10), ("a", "y", 30), ("b", "x", 20), ("b", "y", 40)], "s string, l string, size long")
    lam = mixing.entropy_balance(cells, ["s", "l"], {"s": {"a": 50.0, "b": 50.0}, "l": {"x": 30.0, "y": 70.0}})
    total = lambda k, v: sum(r["size"] * np.exp(lam["s"][r["s"]] + lam["l"][r["l"]]) for r in cells.collect() if r[k] == v)
    assert [round(total("s", "a"), 4), round(total("l", "x"), 4), round(total("l", "y"), 4)] == [50, 30, 70]


def test_mix_edges(spark):
    out = mixing.mix(texts(spark, edge_rows()))
    assert out.count() == len(edge_rows())
    assert mixing.mix(texts(spark, [])).count() == 0


# -- packing --------------------------------------------------------------------------------


def test_encode_is_the_tokenizer():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.TOKENIZER)
    odd = ["It's a DOG's life, isn't 'S?", "é̂ ÉCOLE. İstanbul, don't", "a\x1cb c d 12,345.67 <|endoftext|> x", "naïve,, über... ß. 'll'd", "", "a.b,c-d_e 'tis 'Twas", "Σίσυφος ΟΔΟΣ, éa."]
    for text in odd:
        assert packing.encode([text])[0] == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_packing_encodes_odd_strings_like_the_tokenizer():
    plain, _, _ = packing._tokenizer(packing.TOKENIZER)
    pool = [*"abcXYZ 's.,!?-_'\t\n 0129éÉßüñİıŞẞΣσςжЖ中文ﬁªº½²한각", "\u0301", "\u0307", "\u00ad", "\u200b", "\ufeff", "\x1c", "\x85", "\x00", "\U0001f600"]
    pool += ["'s", "'RE", "İ.", "aİ.", "é.", "<|startoftext|>", "<|ENDOFTEXT|>", "don't", "ǅ", ".,"]
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choices(pool, k=rng.randint(0, 12)))
        assert packing.encode([text])[0] == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_plan_uses_every_piece_and_wastes_little():
    rng = np.random.default_rng(3)
    hist = np.zeros(2049, np.int64)
    for n in rng.integers(1, 2049, 5000):
        hist[n] += 1
    plan = packing.plan(hist)
    used = np.zeros(2049, np.int64)
    for lengths, times in plan:
        assert sum(lengths) <= 2048
        for n in lengths:
            used[n] += times
    assert (used == hist).all()
    assert sum(t for _, t in plan) <= 1.01 * (hist * np.arange(2049)).sum() / 2048 + 1


def test_pack_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = packing.pack(docs).toPandas().sort_values(["sequence_id", "offset"])
    assert ((got.groupby("sequence_id")["length"].cumsum() - got["length"]) == got["offset"]).all()
    assert got.groupby("sequence_id")["length"].sum().max() <= 2048
    for r in docs.limit(60).collect():
        ids = packing.encode([r["text"] or ""])[0]
        want = packing.pieces_of(ids)
        mine = got[got["doc_id"] == r["doc_id"]].sort_values("piece")
        assert [tuple(x) for x in mine[["piece", "start", "length", "ids_crc32"]].itertuples(index=False)] == want


def test_pack_edges(spark):
    out = packing.pack(texts(spark, edge_rows()))
    assert out.groupBy("doc_id", "piece").count().filter("doc_id = 4").first()["count"] == 2
    assert out.filter("doc_id = 1").first()["length"] == 1
    assert packing.pack(texts(spark, [])).count() == 0


# -- language ---------------------------------------------------------------------------------


def brute_phrases(sample, text):
    count, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        count, at = count + 1, at + n
    return count


def test_phrases_are_greedy_longest_matches():
    model = langid.build({"aa": "the cat sat on the mat and the hat", "bb": "der hund und die katze und das haus"})
    rng = random.Random(1)
    for _ in range(40):
        text = "".join(rng.choices("the catunddr ", k=rng.randint(1, 60)))
        got = langid.phrases(model, [langid._symbols(text, model["symbol"])])[0]
        want = [brute_phrases(s, text) for s in ("the cat sat on the mat and the hat", "der hund und die katze und das haus")]
        assert list(got) == want, text


SCRIPTS = {
    "el": "η γάτα κάθεται στο χαλί και ο σκύλος κοιμάται στο σπίτι", "ru": "кошка сидит на ковре и собака спит дома у огня", "uk": "кішка сидить на килимі і собака спить вдома біля вогню",
    "ar": "القطة تجلس على السجادة والكلب ينام في البيت", "zh": "猫坐在地毯上狗睡在房子里我们喜欢它们", "ja": "猫は敷物の上に座り犬は家で眠るのが好きです", "en": "the cat",
}


def test_languages_of_any_script():
    model = langid.build(SCRIPTS)
    asked = {"el": "ο σκύλος και η γάτα", "ru": "собака и кошка дома", "uk": "собака і кішка вдома", "ar": "الكلب على السجادة", "zh": "狗坐在地毯上", "ja": "犬は家に座り", "en": "the cat"}
    assert langid.predict(model, list(asked.values()))[0] == list(asked)


@pytest.mark.parametrize("dense", [0, 3, 94])
def test_phrases_are_the_same_with_rare_letters_apart(monkeypatch, dense):
    monkeypatch.setattr(langid, "DENSE", dense)
    model = langid.build({"aa": SCRIPTS["zh"], "bb": SCRIPTS["el"]})
    rng = random.Random(2)
    for _ in range(40):
        text = "".join(rng.choices(SCRIPTS["zh"][:9] + "στο και", k=rng.randint(1, 60)))
        got = langid.phrases(model, [langid._symbols(text, model["symbol"])])[0]
        assert list(got) == [brute_phrases(SCRIPTS[s], text) for s in ("zh", "el")], text


def test_language_accuracy_and_edges(spark):
    out = langid.op4_language(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    held = out[out["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.95
    assert langid.predict(None, ["abc"])[0] == ["und"]
    model = langid.build({"en": "the cat"})
    assert langid.predict(model, [None, "", "12 34", "the"])[0] == ["und", "und", "und", "en"]


# -- language model ---------------------------------------------------------------------------


def test_lm_counts_and_gain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in lm.op5_lm_score(spark, SF).collect()}
    rows = docs.collect()
    tokens = {r["doc_id"]: lm.words((r["text"] or "").encode()) for r in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(t for i, x in tokens.items() if not held[i] for t in x)
    n, v = sum(c.values()), len(c)
    for i, x in tokens.items():
        assert got[i]["n_tokens"] == len(x) and got[i]["n_known"] == sum(c[t] > 0 for t in x) and got[i]["train_tokens"] == n and got[i]["held_out"] == held[i]
        assert got[i]["base_score"] == pytest.approx(sum(np.log10((c[t] + 1) / (n + v + 1)) for t in x), abs=1e-6)
    assert sum(got[i]["score"] for i in tokens if held[i]) > sum(got[i]["base_score"] for i in tokens if held[i])


def lm_docs(docs, held=False):
    return docs.select(F.col("doc_id").alias("id"), F.lit(held).alias("held_out"), F.col("text").cast("binary").alias("raw"))


def test_lm_scores_match_a_plain_model(spark):
    """Scores recomputed token by token with the trained tables, and sums over all words."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    rows = docs.collect()
    held = {r["doc_id"]: r["doc_id"] % 3 == 0 for r in rows}
    named = docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 3 == 0).alias("held_out"), F.col("text").cast("binary").alias("raw"))
    chunks = common.materialize(lm.chunked(named, 5000), "chunks")
    total, distinct, own, mass, (w1, w2) = lm.fit(chunks, common.materialize(lm.counted(chunks), "counts"))
    tokens = {r["doc_id"]: lm.words((r["text"] or "").encode()) for r in rows}
    c = Counter(t for i, x in tokens.items() if not held[i] for t in x)
    assert (total, distinct) == (sum(c.values()), len(c))
    kind = lambda t: own.get(lm.token_hash(t), lm.ending(t))
    part = lambda t: (lm.token_hash(t) % 2**64) >> 60
    plain = Counter()
    for t, n in c.items():
        plain[kind(t), part(t)] += n + 1
    assert all(mass[k, s] == plain[k, s] + (k >= lm.OWN) for k in range(lm.CLASSES) for s in range(lm.PARTS))

    def slot(x, number, low):
        h = (x + number * 0x9E3779B9) % 2**32 * 0x85EBCA6B % 2**32
        return max((h ^ h >> 15) * 0xC2B2AE35 % 2**32 >> 32 - lm.BITS, low)

    def chances(before, k=None):
        """P of each class, or of each part of class ``k``, after the tokens ``before``."""
        one, two, three = ((lm.token_hash(before[-j]) % 2**32 if len(before) >= j else 7 + j) for j in (1, 2, 3))
        if k is None:
            at, w = (0, slot(one, 1, 1), slot((one * 31 + two) % 2**32, 2, 1), slot(two, 3, 1), slot(three, 4, 1)), w1
        else:
            at, w = (k, slot(one ^ k * 0x27D4EB2F % 2**32, 5, lm.CLASSES), slot(two ^ k * 0x27D4EB2F % 2**32, 6, lm.CLASSES)), w2
        z = np.exp(sum(w[x].astype(float) for x in at))
        return z / z.sum()

    got = {r["id"]: r for r in lm.score(named, chunk=5000).collect()}
    for i in list(tokens)[:6]:
        x = tokens[i][:4000]
        if len(x) == len(tokens[i]):
            want = sum(np.log10(chances(x[:j])[kind(t)] * chances(x[:j], kind(t))[part(t)] * (c[t] + 1) / mass[kind(t), part(t)]) for j, t in enumerate(x))
            assert got[i]["score"] == pytest.approx(want, rel=1e-4)
    before = tokens[next(iter(tokens))][:2]
    first, second = chances(before), [chances(before, k) for k in range(lm.CLASSES)]
    words = sum(first[kind(t)] * second[kind(t)][part(t)] * (n + 1) / mass[kind(t), part(t)] for t, n in c.items())
    unknown = sum(first[k] * second[k][s] / mass[k, s] for k in range(lm.OWN, lm.CLASSES) for s in range(lm.PARTS))
    assert words + unknown == pytest.approx(1, abs=1e-4)


def test_lm_sums_of_runs():
    rng = np.random.default_rng(2)
    sizes = np.array([1, 2, 12, 13, 40, 1, 11, 3])
    first = np.cumsum(sizes) - sizes
    x = rng.normal(size=(sizes.sum(), 4))
    assert np.allclose(lm.sums_of_runs(x, first, sizes), np.add.reduceat(x, first, axis=0))


def test_lm_edges(spark):
    docs = texts(spark, edge_rows())
    assert lm.score(lm_docs(docs)).count() == len(edge_rows())
    none = lm.score(lm_docs(docs, held=True), chunk=3).collect()
    assert len(none) == len(edge_rows()) and {r["n_known"] for r in none} == {0}
    assert lm.score(lm_docs(docs.limit(0))).count() == 0


# -- quality ------------------------------------------------------------------------------------


def test_quality_accuracy(spark):
    out = quality.op6_quality(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    assert out["score"].between(0, 1).all() and ((out["score"] >= 0.3) == (out["predicted"] == 1)).all()
    assert (out["predicted"] == out["quality"]).mean() > 0.9


def test_quality_edges():
    x = quality.features([None, "", "a", "A B! " * 1000])
    assert np.isfinite(x).all()
    assert quality.fit(x, np.array([True] * 4)) is None
    assert (quality.score(None, [None, "a"]) == 0.5).all()


# -- nearest neighbours -----------------------------------------------------------------------------


def brute_nearest(ids, x, q, top=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    d[q] = np.inf
    return set(ids[np.lexsort((ids, d))[:top]])


def test_ann_recall_and_scores(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toPandas()
    ids, x = e["vec_id"].to_numpy(), np.stack(e["embedding"]).astype(float)
    got = ann.search(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"), lambda i: i % 10 == 0).toPandas()
    hits = total = 0
    for q, g in got.groupby("query_id"):
        at = int(np.flatnonzero(ids == q)[0])
        want = brute_nearest(ids, x, at)
        hits += len(want & set(g["vec_id"]))
        total += len(want)
        assert list(g.sort_values("rank")["score"]) == sorted(g["score"])
    assert hits / total >= 0.9


def test_ann_edges(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [0.5, 0.5]), (6, [1.0, 0.0, 3.0]), (None, [1.0, 1.0]), (7, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r)[:3] for r in ann.search(frame, lambda i: i % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 7), (0, 2, 100), (0, 3, 5), (100, 1, 0), (100, 2, 7), (100, 3, 5)]
    assert ann.search(frame.limit(0), lambda i: i % 100 == 0).count() == 0


# -- URLs ---------------------------------------------------------------------------------------------


def test_urls(spark):
    urls = ["https://A.Example.COM/en/7x?q#f", "http://xcom/en/1", "http://example.net/de/8", "http://de.example.net/de/9", None, "no scheme/com/en/", "ftp://b.org/es/", "http://com/en/", "a://b.org:80/es/", "http://x.com?/en/"]
    rows = spark.createDataFrame([(k, u, "h", "p") for k, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(rows, url_filter.rule_table(spark, url_filter.RULES)).collect()}
    assert got[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[1] == ("xcom", "/en/1", None, "allow")
    assert got[2][2:] == ("example.net/de/8", "block") and got[3][2:] == ("net/de/", "block")
    assert got[4] == ("", "", None, "allow") and got[5] == ("", "", None, "allow")
    assert got[6][2:] == ("org/es/", "block") and got[7][2:] == ("com/en/", "block") and got[8][2] is None and got[9] == ("x.com", "", None, "allow")
    none = url_filter.rule_table(spark, url_filter.RULES).limit(0)
    assert {r["verdict"] for r in url_filter.filter_urls(rows, none).collect()} == {"allow"}
    assert url_filter.filter_urls(rows.limit(0), url_filter.rule_table(spark, url_filter.RULES)).count() == 0


def test_url_rules_are_those_of_the_contract(spark):
    contract = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert dict(url_filter.RULES) == contract
    rows = spark.createDataFrame([(k, f"https://www.{rule}") for k, rule in enumerate(contract)], "page_id long, url string")
    got = url_filter.filter_urls(rows, url_filter.rule_table(spark, url_filter.RULES)).collect()
    assert {r["rule"]: r["verdict"] for r in got} == contract


# -- conversations --------------------------------------------------------------------------------------


def test_quotations_link_and_go(spark):
    rows = [
        (1, 0, "user", "How do I sort?\nIt must be stable."), (1, 1, "assistant", "Use merge sort."), (1, 2, "user", "> It must be  STABLE.\nWhy that?"),
        (1, 3, "assistant", "Someone wrote:\n> > It must be stable.\n> Why that?\nBecause."), (1, 4, None, "> never said\nOther"), (2, 0, "user", None), (2, 0, "user", None), (None, 1, "user", "x"), (3, None, "user", "> x"),
    ]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, root string")
    got = {(r["conv_id"], r["turn"]): r for r in chat.link_quotations(frame).collect()}
    assert (got[1, 2]["parent_turn"], got[1, 2]["root_turn"], got[1, 2]["depth"], got[1, 2]["text"]) == (0, 0, 1, "Why that?")
    assert (got[1, 3]["parent_turn"], got[1, 3]["depth"], got[1, 3]["text"], got[1, 3]["quote_levels"]) == (2, 2, "Because.", 2)
    assert [t for t in sorted((r["position"], r["turn"]) for (c, _), r in got.items() if c == 1)] == [(0, 0), (1, 2), (2, 3), (3, 1), (4, 4)]
    assert got[1, 4]["text"] == "Other" and got[1, 4]["role"] == "user" and got[1, 4]["parent_turn"] is None
    assert len(chat.link_quotations(frame).collect()) == len(rows)
    assert chat.link_quotations(frame.limit(0)).count() == 0
    whole = {r["conv_id"]: r["chat"] for r in chat.conversation_texts(chat.link_quotations(frame)).collect()}
    assert whole[1].index("Why that?") < whole[1].index("merge sort")


def test_quotations_do_not_depend_on_line_breaks_and_levels_link(spark):
    rows = [
        (1, 0, "The first point is long. The second point is\nlonger than a line.\n\nA last word"),
        (1, 1, "An answer that nobody quotes."),
        (1, 2, "> The second point\n> is longer than\n> a line.\nI disagree."),
        (1, 3, ">> The second point is longer than a line.\nMe too."),  # as turn 2 quotes it
        (1, 4, ">>> A last word\nFound in own text alone."),
        (1, 5, "> Nobody said that.\nSo?"),
        (2, 0, "I disagree."), (2, 1, "> The first point is long.\nIn another conversation."),
    ]
    frame = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r["parent_turn"] for r in chat.link_quotations(frame).collect()}
    assert got == {(1, 0): None, (1, 1): None, (1, 2): 0, (1, 3): 2, (1, 4): 0, (1, 5): None, (2, 0): None, (2, 1): None}


def brute_parents(rows):
    """By comparing each quoted hash with all earlier messages of its conversation."""
    out = {}
    parsed = [(c, t, *chat.parse(x)) for c, t, x in rows]
    holds = [{**chat.quotations(q), 0: chat.pieces(own)} for _, _, own, q in parsed]
    for i, (c, t, _, quoted) in enumerate(parsed):
        votes = defaultdict(lambda: [0, set()])
        for level, hashes in chat.quotations(quoted).items():
            for at, exact in {(level - 1, 1), (0, int(level == 1))}:
                for h in hashes:
                    earlier = [(parsed[j][1], j) for j in range(len(rows)) if parsed[j][0] == c and parsed[j][1] < t and h in holds[j].get(at, ())]
                    if earlier:
                        vote = votes[max(earlier)]
                        vote[0] = max(vote[0], exact)
                        vote[1].add(h)
        if votes:
            out[c, t] = max((e, len(hs), turn) for (turn, _), (e, hs) in votes.items())[2]
    return out


@pytest.mark.parametrize("bucket", [4, 1024])
def test_quotations_match_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(chat, "BUCKET", bucket)
    rng = random.Random(5)
    said = ["Yes.", "No.", "A long remark about sorting.", "It is stable.", "Thanks!", "Why is that?"]
    rows = []
    for c in range(6):
        for t in range(30):
            text = [" ".join(rng.sample(said, 2))]
            for _ in range(rng.randint(0, 2)):
                words = " ".join(rng.sample(said, 2)).split()
                cut, marks = rng.randint(1, len(words)), ">" * rng.randint(1, 3)
                text.insert(0, f"{marks} {' '.join(words[:cut])}\n{marks} {' '.join(words[cut:])}\n")
            rows.append((c, t, "\n".join(text)))
    frame = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r["parent_turn"] for r in chat.link_quotations(frame).collect() if r["parent_turn"] is not None}
    assert got == brute_parents(rows) and len(got) > 50


# -- the pipeline ------------------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = quality.quality_stage(spark, docs, SF)
    ids = {r["doc_id"] for r in kept.collect()}
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids == {r["doc_id"] for r in docs.collect() if quality.score(model, [r["text"]])[0] >= 0.3}
    exact = exact_dedup.exact_stage(spark, kept, SF)
    norm = [re.sub(r"[\x20\x09-\x0D]+", "", r["text"] or "") for r in exact.collect()]
    assert len(norm) == len(set(norm)) and set(norm) == {re.sub(r"[\x20\x09-\x0D]+", "", r["text"] or "") for r in kept.collect()}
    near = near_dedup.near_stage(spark, exact, SF)
    seqs = [near_dedup._words(r["text"]) for r in near.collect()]
    for a in range(len(seqs)):
        for b in range(a):
            n = max(len(seqs[a]), len(seqs[b]))
            assert not near_dedup.distance_within(seqs[a], seqs[b], int(0.2 * n)) or not set(zip(*[seqs[a][j:] for j in range(5)], strict=False)) & set(zip(*[seqs[b][j:] for j in range(5)], strict=False))
    mixed = mixing.mixing_stage(spark, near, SF)
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(near).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({k: v for k, v in want.items() if v})
    assert mixed.columns == docs.columns
    final = corpus_pipeline.run(spark, SF)
    assert final.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048
    assert {r["doc_id"] for r in final.select("doc_id").distinct().collect()} == {k for k, v in want.items() if v}
