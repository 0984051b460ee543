"""Top-k search, similarity join, components and decontamination against brute force."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from numerant.llm import common
from numerant.llm import decontamination as D
from numerant.llm import partenum as P
from numerant.llm import voronoi
from numerant.llm.components import connected_components


def brute_top(rows, k, every):
    sound = [(i, [math.floor(64 * float(np.float32(c))) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, q in sound:
        if i % every:
            continue
        ranked = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in sound if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k(spark, monkeypatch, seed):
    monkeypatch.setattr(voronoi, "QUERIES_PER_BLOCK", 7)
    monkeypatch.setattr(voronoi, "ROWS_PER_BLOCK", 16)
    rng = random.Random(seed)
    rows = [(k, [rng.gauss(0, 1) for _ in range(5)]) for k in range(150)]
    rows += [(200 + k, [1.0, 0.5, 0.25, 0.0, -1.0]) for k in range(60)]  # one vector that many share
    rows += [(300 + k, [5 + rng.gauss(0, 0.01) for _ in range(5)]) for k in range(30)]
    rows += [(400, None), (401, [1.0, None, 2.0, 3.0, 4.0]), (402, [float("nan")] * 5), (403, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (404, [0.0] * 5), (-20, [1.0] * 5), (None, [1.0] * 5), (405, [2.0]), (420, [])]
    table = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<float>, score double")
    got = sorted(map(tuple, voronoi.inner_product_top_k(table, F.col("vec_id") % 20 == 0, 6).collect()))
    assert got == brute_top(rows, 6, 20)


def test_top_k_of_a_query_with_more_than_k_rows(spark):
    rng = random.Random(3)
    others = [k for k in range(101, 300) if k % 20]
    place = {r.id: r.h for r in spark.range(20_000).withColumn("h", F.xxhash64("id")).collect()}
    first = sorted(place[k] for k in others)
    hot = next(k for k in range(1000, 20_000, 20) if first[1] < place[k] < first[4])  # so that it is a pivot beside others
    rows = [(hot, [50.0, 0.0, 0.0])] * 30 + [(k, [rng.gauss(0, 1), 45 + rng.gauss(0, 1), rng.gauss(0, 1)]) for k in others]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, voronoi.inner_product_top_k(table, F.col("vec_id") % 20 == 0, 6).collect()))
    whole = [(i, [math.floor(64 * float(np.float32(c))) for c in v]) for i, v in rows]
    want = []
    for q in sorted({i for i, _ in rows if i % 20 == 0}):
        ranked = sorted((-sum(a * b for a, b in zip(x, y)), j) for i, x in whole if i == q for j, y in whole if j != q)[:6]
        want += [(q, r + 1, j, -s) for r, (s, j) in enumerate(ranked)]
    assert got == want and len(got) == 6


def test_top_k_of_few(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in voronoi.inner_product_top_k(table, F.col("vec_id") == 0, 20).collect()] == [(0, 1, 1, 64 * 64 * 11)]
    assert voronoi.inner_product_top_k(table.limit(0), F.lit(True), 3).count() == 0
    assert voronoi.inner_product_top_k(table.limit(1), F.lit(True), 3).count() == 0


def test_top_k_of_large_numbers(spark):
    rows = [(k, [float(2**40 * (k + 1)), 0.5]) for k in range(5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    small = [(k, [math.floor(v[0] / 2**36), math.floor(v[1])]) for k, v in rows]
    got = voronoi.inner_product_top_k(table, F.lit(True), 4, scale=1 / 2**36).collect()
    assert {(r.query_id, r.vec_id): r.score for r in got} == {(a, b): x[0] * y[0] + x[1] * y[1] for a, x in small for b, y in small if a != b}


def shingles(text, n=3):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_groups(rows, n=3, percent=90):
    parent = {d: d for d, _ in rows if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, shingles(t, n)) for d, t in rows if d is not None]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return sorted((d, len(s), root(d)) for d, s in sets)


@pytest.mark.parametrize("seed", [3, 4])
def test_near_groups(spark, seed):
    rng, rows = random.Random(seed), []
    for base in range(14):
        text = [f"w{rng.randrange(60)}" for _ in range(rng.choice([1, 2, 3, 8, 12, 20, 31, 45, 90, 200, 400]))]
        for _ in range(rng.randint(1, 7)):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(1000)}"
            rows.append((rng.randrange(10**6), rng.choice([" ", "\n", "\t "]).join(copy).upper()))
            text = copy if rng.random() < 0.5 else text
    rows += [(5, None), (6, ""), (7, " \n\t"), (8, "Éa b"), (9, "éa b"), (10, "a b"), (11, "A  B "), (12, "x y z"), (12, "x y z"), (13, "x y z")]
    docs = spark.createDataFrame([(d, t, d, d) for d, t in rows] + [(None, "x y z", 1, 1)], "doc_id long, text string, n long, component_id long")
    got = [tuple(r) for r in P.near_groups(docs).collect()]
    assert sorted(g for g in got if g[0] is not None) == brute_groups(rows)
    assert [g for g in got if g[0] is None] == [(None, 1, None)]
    assert P.near_groups(docs.limit(0)).count() == 0


def test_groups_of_keys_with_several_texts(spark):
    a, b, c = (" ".join(f"{k}{n}" for n in range(9)) for k in "abc")
    rows = [(3, a), (5, a), (5, b), (9, b), (20, c), (20, c), (21, a + " x"), (30, b), (30, c), (40, "lonely words here")]
    got = sorted(map(tuple, P.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == sorted((d, len(shingles(t)), 40 if d == 40 else 21 if d == 21 else 3) for d, t in rows)


def test_groups_without_bitmaps(spark, monkeypatch):
    """More ids than a bitmap takes: rows are joined without one."""
    monkeypatch.setattr(common, "MOST_IDS", 0)
    words = [f"w{k}" for k in range(40)]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join([*words, "x"])), (4, "other words stand here"), (5, None), (5, " ".join(words[:20]))]
    assert common.id_filter(spark.range(1)) is None
    got = sorted(map(tuple, P.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(1, 38, 1), (2, 38, 1), (3, 39, 1), (4, 2, 4), (5, 0, 5), (5, 18, 5)]


def test_bitmaps_hold_their_ids(spark):
    ids = spark.createDataFrame([(k * 7919 - 10**6,) for k in range(500)], "id long")
    known = common.id_filter(ids)
    every = spark.range(-(10**6), 3 * 10**6, 997).union(ids).selectExpr("id", "id as bits", "id as bucket").distinct()
    inside, outside = common.maybe_in(every, "id", known), common.maybe_in(every, "id", known, inside=False)
    assert inside.columns == every.columns and inside.join(ids, "id").count() == 500 and outside.join(ids, "id").count() == 0
    assert inside.count() + outside.count() == every.count() and inside.count() < 1000


@pytest.mark.parametrize(("group", "large", "seed"), [(64, 1000, 5), (2, 1000, 6), (2, 6, 7)])
def test_groups_of_a_passage_that_many_share(spark, monkeypatch, group, large, seed):
    """Texts that are alike for the most part, but mostly not enough to link: large groups are divided, no link is lost."""
    monkeypatch.setattr(P, "BLOCK", 16)
    monkeypatch.setattr(P, "ROUNDS", 1)
    rng, rows = random.Random(seed), []
    passages = [[f"p{k}w{n}" for n in range(40)] for k in range(2)]
    for d in range(160):
        words = list(passages[d % 2]) + [f"o{rng.randrange(10**6)}" for _ in range(rng.randint(0, 10))]
        if d % 5 == 0:
            words[rng.randrange(len(words))] = "changed"
        rows.append((d, " ".join(words)))
        if d % 7 == 0:
            rows.append((1000 + d, " ".join([*words, "end"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, P.near_groups(docs, words=5, percent=80, group=group, large=large).collect()))
    assert got == brute_groups(rows, 5, 80)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 260), st.integers(0, 40), st.integers(0, 40), st.integers(0, 10**6), st.sampled_from([70, 80, 90]), st.integers(0, 3))
def test_similar_sets_share_a_signature(common, left, right, seed, percent, cut):
    rng = np.random.default_rng(seed)
    every = np.unique(rng.integers(0, 1 << 63, common + left + right, dtype=np.uint64) * np.uint64(2))
    rng.shuffle(every)
    a, b = np.sort(every[: common + left]), np.sort(np.concatenate([every[:common], every[common + left :]]))
    if P.similar(a, b, percent):
        assert set(P.signatures(a, percent, cut).tolist()) & set(P.signatures(b, percent, cut).tolist())


def test_unlike_sets_hardly_share_signatures():
    """Partitions without elements, which all sets have, sign nothing but for odd sets that have very many of them."""
    rng = np.random.default_rng(4)
    for size in (5, 20, 80, 400):
        signed = [set(P.signatures(np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2)), 80).tolist()) for _ in range(60)]
        assert sum(len(x & y) for k, x in enumerate(signed) for y in signed[:k]) <= 5  # of 1,770 pairs


def test_plans_hold():
    """Differences in any ``k`` partitions leave ``sure`` subsets without one."""
    for k in range(0, 400):
        parts, kept, sure = P.plan(k)
        assert parts > k and sure == math.comb(parts - k, kept) >= 1 and len(P.subsets(parts, kept)) == math.comb(parts, kept)


def test_components(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + k, 1001 + k) for k in range(40)] + [(2000, k) for k in range(2001, 2100)] + [(5, 5), (None, 4)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = dict(map(tuple, connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def toks(t):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())


def made_corpus(rng):
    items = [[f"i{k}w{rng.randrange(40)}" for _ in range(n)] for k, n in enumerate([60, 30, 13, 11, 7, 3, 25])]
    bench = [(k, " ".join(w)) for k, w in enumerate(items)] + [(50, None), (51, ""), (52, "?!")]
    docs, want = [], defaultdict(set)
    for d in range(120):
        body = [f"d{rng.randrange(500)}" for _ in range(rng.randint(0, 150))]
        if d % 3 == 0:
            k = rng.randrange(len(items))
            passage = list(items[k])
            if len(passage) >= 25 and rng.random() < 0.5:
                passage = passage[5:]
            if len(passage) >= 13 and rng.random() < 0.6:
                for at in rng.sample(range(len(passage)), max(1, len(passage) // 8)):
                    passage[at] = "changed"
            at = rng.randint(0, len(body))
            body[at:at] = [w.upper() for w in passage]
            want[d].add(k)
        docs.append((d, ", ".join(body)))
    return docs, bench, want


@pytest.mark.parametrize("limit", [D.BROADCAST_CHARS, 0])
def test_overlaps(spark, limit):
    docs, bench, want = made_corpus(random.Random(11))
    table = spark.createDataFrame([(d, t, "z") for d, t in docs] + [(500, None, "z"), (501, "", "z"), (None, docs[0][1], "z"), (3, docs[3][1], "z")], "doc_id long, text string, similarity string")
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = D.overlaps(table, items, broadcast_chars=limit).collect()
    found = defaultdict(set)
    for r in got:
        found[r.doc_id].add(r.item_id)
        assert r.n_equal >= 0.8 * r.n_words - 1e-9 and abs(r.similarity - r.n_equal / r.n_words) < 1e-12
        doc, item = toks(docs[r.doc_id or 0][1])[r.first_word : r.last_word], toks(bench[r.item_id][1])
        assert any(sum(a == b for a, b in zip(doc, item[o:])) == r.n_equal for o in range(len(item)))
    assert {k: v for k, v in found.items() if k is not None} == dict(want) and found[None] == want[0]
    assert sum(r.doc_id == 3 for r in got) == 2 * len(want[3])
    kept = D.clean_documents(table, items, broadcast_chars=limit)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([d for d, _ in docs if d not in want] + [500, 501])
    assert D.overlaps(table.limit(0), items, broadcast_chars=limit).count() == 0
    assert D.overlaps(table, items.limit(0), broadcast_chars=limit).count() == 0


def brute_overlaps(docs, bench):
    """By all places of every item in every document: stretches of 13 words, or of the whole item, of which 4 in 5 agree."""
    out = set()
    for d, t in docs:
        doc = toks(t)
        for k, u in bench:
            item = toks(u)
            for shift in range(-len(item) + 1, len(doc)):
                same = [0 <= p < len(item) and doc[p + shift] == item[p] if 0 <= p + shift < len(doc) else None for p in range(len(item))]
                if any(
                    same[a] and same[b - 1] and None not in same[a:b] and 5 * sum(same[a:b]) >= 4 * (b - a)
                    for a in range(len(same)) for b in range(a + min(13, len(item)), len(same) + 1)
                ):
                    out.add((d, k))
                    break
    return out


@pytest.mark.parametrize("limit", [D.BROADCAST_CHARS, 0])
def test_overlaps_are_those_of_brute_force(spark, limit):
    rng = random.Random(limit + 2)
    items = [[f"i{k}w{rng.randrange(30)}" for _ in range(n)] for k, n in enumerate([1, 2, 5, 6, 8, 10, 11, 12, 13, 14, 15, 16, 20, 25, 26, 40])]
    docs = []
    for d in range(120):
        passage = list(rng.choice(items))
        for _ in range(rng.randint(0, 1 + len(passage) // 4)):
            passage[rng.randrange(len(passage))] = f"x{rng.randrange(9)}"
        low = rng.randint(0, 3) if len(passage) > 13 else 0
        docs.append((d, " ".join([f"d{rng.randrange(500)}" for _ in range(rng.randint(0, 9))] + passage[low:] + [f"d{rng.randrange(500)}" for _ in range(rng.randint(0, 9))])))
    bench = [(k, " ".join(w)) for k, w in enumerate(items)]
    got = D.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), broadcast_chars=limit)
    want = brute_overlaps(docs, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and 40 < len(want) < 110


def test_short_items_with_substitutions(spark):
    item, other = "a b c d e f g h i j", "k l m n o p q r s t u"
    docs = spark.createDataFrame([(1, item.replace("e", "x")), (2, other.replace("n", "x").replace("r", "y")), (3, item.replace("c", "x").replace("e", "y").replace("g", "z"))], "doc_id long, text string")
    got = D.overlaps(docs, spark.createDataFrame([(7, item), (8, other)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.n_equal, r.n_words) for r in got) == [(1, 7, 9, 10), (2, 8, 9, 11)]
    with pytest.raises(ValueError, match="share"):
        D.overlaps(docs, docs.select(F.col("doc_id").alias("item_id"), "text"), share=0.5)


def test_masks_meet_every_stretch():
    for length in range(1, 14):
        for whole in (True, False):
            sizes, gone = D.patterns(length, whole)
            met = np.zeros(len(sizes), bool)
            for mask in D.masks_for(length, whole):
                assert mask[-1] < length
                met |= D.met(mask, sizes, gone)
            assert met.all()
    assert set(sizes.tolist()) == set(range(13, 26))  # longer stretches have a part of 13 to 25 words that agrees as well


def test_a_stretch_that_agrees_at_its_ends():
    same = np.array([True] * 12 + [False] * 4 + [True, True, False] + [True] * 5 + [False] + [True] * 4)
    assert D.longest_agreement(same, 0.8) == (16, 29)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.booleans(), max_size=30))
def test_longest_agreement(same):
    same = np.array(same, bool)
    low, high = D.longest_agreement(same, 0.8)
    trimmed = max((b - a for a in range(len(same)) for b in range(a + 1, len(same) + 1) if same[a] and same[b - 1] and same[a:b].mean() >= 0.8 - 1e-9), default=0)
    assert high - low == trimmed and (trimmed == 0 or same[low] and same[high - 1] and same[low:high].mean() >= 0.8 - 1e-9)
