"""Periodic runs, removal of repeated spans and the Merkle manifest against brute force."""

import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from numerant.llm import debruijn, merkle, periodic, queries
from numerant.llm.common import NOT_SPACE, hashed_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall(text or "")


# --- runs ---


def brute_runs(w, least, exponent):
    """Every run by its definition: maximal stretches of each period whose smallest period it is."""
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            part = w[start : i + q]
            smallest = next(p for p in range(1, q + 1) if all(a == b for a, b in zip(part, part[p:], strict=False)))
            if len(part) >= max(least, exponent * q) and smallest == q:
                out.append((start, len(part), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def found_runs(texts, **options):
    words, bounds, *_ = hashed_words([t.encode() for t in texts], NOT_SPACE)
    return periodic.find_runs(words, bounds, **options)


periods = st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=7), st.integers(1, 9)), max_size=4)


@settings(max_examples=200, deadline=None)
@given(st.lists(periods, min_size=1, max_size=4), st.sampled_from([(24, 3), (5, 2), (1, 2), (9, 4)]))
def test_runs_are_those_of_the_definition(texts, limits):
    least, exponent = limits
    texts = [" ".join(x for block, times in parts for x in block * times) for parts in texts]
    assert found_runs(texts, least=least, exponent=exponent) == [brute_runs(words_of(t), least, exponent) for t in texts]


def test_ranges_of_lags_make_up_the_whole():
    rng = random.Random(1)
    w = [rng.choice("ab") for _ in range(60)]
    text = " ".join(w * 4 + ["x"] * 40 + (["p", "q"] * 30 + ["r"]) * 5)
    whole = found_runs([text])[0]
    parts = [r for low in range(1, 300, 37) for r in found_runs([text], low=low, high=low + 36)[0]]
    assert sorted(parts) == sorted(whole) == sorted(brute_runs(words_of(text), 24, 3)) and whole


def periodic_rows():
    rng = random.Random(5)
    some = [" ".join(rng.choice(["tick", "tock", "x"]) for _ in range(rng.randrange(200))) for _ in range(30)]
    lines = ["buy now and save\t" * 20, "a " * 500, " b\x0b" * 23, "c " * 24, "é " * 30 + " " * 3, "lead in " + "one two three four five six seven eight nine " * 3 + "one", None, "", " \n\t ", "word"]
    return [(k, t) for k, t in enumerate(some + lines)] + [(7, "a " * 500), (7, "a " * 500), (None, "z y " * 15), (None, None)]


def test_periodic_runs(spark):
    rows = [(k, t, "kept out") for k, t in periodic_rows()]
    table = spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3)
    want = sorted(((k, tuple(r := brute_runs(words_of(t), 24, 3)), brute_collapsed(words_of(t), r)) for k, t, _ in rows), key=str)
    for lags in (periodic.LAGS, 8):  # the second deals ranges of lags out
        got = periodic.periodic_runs(table, lags=lags)
        assert got.columns == ["doc_id", "runs", "collapsed"]
        assert sorted(((r.doc_id, tuple(map(tuple, r.runs)), r.collapsed) for r in got.collect()), key=str) == want
    assert periodic.periodic_runs(table.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic.periodic_runs(table, exponent=1)


def test_periodic_runs_of_text_keys(spark):
    table = spark.createDataFrame([("a`b", "k " * 30)], "`my``key` string, text string")
    assert periodic.periodic_runs(table.withColumnRenamed("my`key", "name"), key="name").collect()[0].runs[0].length == 30


def test_planted_periods_follow_the_contract(spark):
    text = " ".join(map(str, range(50)))
    rows = [(k, text) for k in range(200)] + [(k, "one  two") for k in range(200, 260)] + [(k, t) for k in range(260, 300) for t in ("", None, " \t")] + [(None, text)]
    changed = 0
    for r, (k, t) in zip(queries.planted_periods(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect(), rows, strict=True):
        w, x = words_of(t), zlib.crc32(str(k).encode())
        if k is not None and x % 10 == 0 and w:
            n, g = len(w), x // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            changed += 1
        assert words_of(r.text) == w and (r.text is None) == (t is None)
    assert changed > 10


# --- repeated spans ---


def brute_kept(rows, window):
    """Of each row, by key and text: words and those that stay."""
    order = sorted({(k, t) for k, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    first, out = {}, {}
    for k, t in order:
        w = words_of(t)
        gone = set()
        for i in range(len(w) - window + 1):
            x = tuple(w[i : i + window])
            if x in first:
                gone.update(range(i, i + window))
            else:
                first[x] = (k, i)
        out[k, t] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def repeated_rows(seed, vocabulary):
    rng = random.Random(seed)
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [some(rng.randrange(5, 60)) for _ in range(6)]
    rows = []
    for k in range(60):
        w = []
        for _ in range(rng.randrange(4)):
            w += some(rng.randrange(12)) + rng.choice(shared)[rng.randrange(4) :]
        rows.append((k * 3, " ".join(w)))
    rows += [(200, rows[4][1]), (201, rows[4][1]), (202, rows[4][1] + " tail"), (3, rows[1][1])]  # copies, and a row that is there twice
    return rows + [(300, None), (301, ""), (302, " \t\n"), (303, "loop " * 70), (304, "p q r " * 20), (305, "p q r " * 9), (None, " ".join(shared[0]))]


@pytest.mark.parametrize("seed,window,vocabulary", [(1, 6, "ab"), (2, 20, [f"w{k}" for k in range(40)]), (3, 3, "abcdefgh"), (4, 2, "abcdefgh")])
def test_without_repeats(spark, seed, window, vocabulary):
    rows = repeated_rows(seed, vocabulary)
    want = brute_kept(rows, window)
    table = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, n_words int").repartition(3)
    got = debruijn.without_repeats(table, window=window)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((k, *want[k, t]) for k, t in rows), key=str)


def test_without_repeats_where_no_bitmap_is_made(spark, monkeypatch):
    monkeypatch.setattr(debruijn, "id_filter", lambda ids: None)
    rows = repeated_rows(6, "abcdef")
    want = brute_kept(rows, 8)
    got = debruijn.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=8)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((k, *want[k, t]) for k, t in rows), key=str)


def test_repeated_spans_say_the_words_of_their_sources(spark):
    rows = [r for r in repeated_rows(8, [f"w{k}" for k in range(30)]) if r[0] is not None]
    rows = list(dict(rows).items())
    words = {k: words_of(t) for k, t in rows}
    found = debruijn.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), window=10).collect()
    covered = {k: set() for k in words}
    for r in found:
        assert words[r.doc_id][r.start : r.start + r.n_words] == words[r.source_key][r.source_start : r.source_start + r.n_words]
        assert (r.source_key, r.source_start) < (r.doc_id, r.start) and r.n_words >= 10
        covered[r.doc_id] |= set(range(r.start, r.start + r.n_words))
    want = brute_kept(rows, 10)
    assert {k: len(c) for k, c in covered.items()} == {k: want[k, t][1] for k, t in rows}
    assert max(r.n_words for r in found) > 30


def test_repeats_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert debruijn.without_repeats(empty).collect() == [] and debruijn.repeated_spans(empty).collect() == []
    with pytest.raises(ValueError):
        debruijn.without_repeats(empty, window=1)


def test_least_of():
    v = np.random.default_rng(1).integers(0, 9, 50).astype(np.uint64)
    for n in range(1, 20):
        least, at = debruijn.least_of(v, n)
        assert [(int(v[i : i + n].min()), i + int(v[i : i + n].argmin())) for i in range(len(v) - n + 1)] == list(zip(least.tolist(), at.tolist(), strict=True))


# --- manifest ---


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_manifest(rows, tampered):
    """leaf, subroot, root, proof, folded root and verdict of each row, by the plain definition."""
    leaf = lambda r: h(*[enc(r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    langs = {}
    for r in sorted(rows, key=lambda r: (r["lang"] is not None, (r["lang"] or "").encode(), r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))):
        langs.setdefault(r["lang"], []).append(r)

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
        return levels

    trees = {lang: tree([leaf(r) for r in rs]) for lang, rs in langs.items()}
    top = tree([t[-1][0] for t in trees.values()])
    out = []
    for place, (lang, rs) in enumerate(langs.items()):
        for i, r in enumerate(rs):
            now, proof = leaf(r | {"text": tampered(r)}), []
            for levels, k in ((trees[lang], i), (top, place)):
                for level in levels[:-1]:
                    run, own = level[k - k % 8 : k - k % 8 + 8], k % 8
                    proof += run[:own] + run[own + 1 :]
                    now = h(*run[:own], now, *run[own + 1 :])
                    k //= 8
            out.append((r["doc_id"], leaf(r), trees[lang][-1][0], top[-1][0], h(*proof), now, now == top[-1][0], tuple(proof)))
    return sorted(out, key=str)


def manifest_rows():
    rng = random.Random(3)
    rows = [{"doc_id": k, "text": rng.choice(["Aé", "b", "", "C d"]) + str(k), "lang": rng.choice(["en", "de", "de", "de", "de"]), "source": rng.choice(["s", None]), "n_chars": k} for k in range(400)]
    rows += [{"doc_id": None, "text": None, "lang": None, "source": None, "n_chars": None}, {"doc_id": 5, "text": "Z", "lang": None, "source": "x", "n_chars": 1}]
    rows += [{"doc_id": 9, "text": "again", "lang": "fr", "source": "x", "n_chars": 1}] * 3 + [{"doc_id": 9, "text": "Other", "lang": "fr", "source": "x", "n_chars": 2}]
    return rows + [{"doc_id": 77, "text": "Lone", "lang": "ζ", "source": "x", "n_chars": 4}, {"doc_id": 78, "text": "Lone", "lang": "", "source": "x", "n_chars": 4}]


@pytest.mark.parametrize("levels,top", [(4, 16_384), (1, 16_384), (1, 8), (2, 5)])
def test_manifest(spark, levels, top):
    rows = manifest_rows()
    schema = "doc_id long, text string, lang string, source string, n_chars long, leaf int"
    table = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], 0) for r in rows], schema).repartition(5)
    hit = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))
    got = merkle.manifest(table, ["doc_id", "source", "lang", "n_chars", "text"], "lang", now={"text": F.when(hit, F.lower("text")).otherwise(F.col("text"))}, with_proofs=True, block_levels=levels, top=top)
    found = sorted(((*tuple(r)[:-1], tuple(r.proof)) for r in got.collect()), key=str)
    lowered = lambda r: r["text"].lower() if r["text"] is not None and r["doc_id"] is not None and r["doc_id"] % 3 == 0 else r["text"]
    want = brute_manifest(rows, lowered)
    assert found == want
    assert {r[6] for r in want} == {True, False}


def test_manifest_of_little(spark):
    schema = "doc_id string, lang string, text string"
    assert merkle.manifest(spark.createDataFrame([], schema), ["text"], "lang").collect() == []
    one = merkle.manifest(spark.createDataFrame([("k", "en", "t" * 100_000)], schema), ["text"], "lang").collect()[0]
    assert one.leaf == one.subroot == one.root == one.folded_root == h(f"100000:{'t' * 100_000}") and one.proof_sha256 == h("") and one.verified
