"""Trained operators: held-out accuracy on small made-up corpora, and odd rows."""

import math
import random
import re

import numpy as np
import pytest
import zstandard

from numerant.llm import language, quality, toxicity
from numerant.llm.common import hashed_words

ALPHABETS = {"aa": ["ba", "be", "bo", "da", "du"], "bb": ["ki", "ku", "zö", "zi", "ät"], "cc": ["lo", "ma", "né", "ra", "sa"]}


def words(rng, kind, n):
    return " ".join("".join(rng.choice(ALPHABETS[kind]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng, rows = random.Random(4), []
    for k in range(600):
        kind = rng.choice(list(ALPHABETS))
        toxic, bad = rng.random() < 0.2, rng.random() < 0.3
        text = words(rng, kind, rng.randint(20, 60)).split()
        if toxic:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), rng.choice(["grobian", "lump"]))
        if bad:
            text = [w + rng.choice(["###", "$$$", "%%%"]) for w in text]
        rows.append((k, " ".join(text), kind, int(toxic), int(not bad)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int, quality int")


ODD = [(-1, None, "score"), (-2, "", "score"), (-3, "123 %%", "score"), (None, "ba be", "score"), (-4, "ba be " * 30000, "score"), (-4, "ba be " * 30000, "score")]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, score string")


def test_language(spark, corpus):
    rows, docs = corpus
    model = language.fit(docs.filter("doc_id % 4 <> 2"), rows=400)
    assert model.languages == ["aa", "bb", "cc"]
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    held = [r for r in rows if r[0] % 4 == 2]
    assert np.mean([got[r[0]].lang_pred == r[2] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    strange = language.predict(model, ["qxw vvy pfff jjh"])
    assert strange[0][0] in model.languages  # an answer, but one may reject it
    out = language.identify(odd(spark), model).collect()
    assert len(out) == 6
    by = {r.doc_id: r for r in out}
    assert [(by[k].lang_pred, by[k].score, by[k].rejected) for k in (-1, -2, -3)] == [("und", 0.0, True)] * 3
    assert by[None].lang_pred == "aa" and by[-4].lang_pred == "aa"
    assert language.identify(docs.limit(0), model).count() == 0


def test_language_without_training(spark, corpus):
    model = language.fit(corpus[1].limit(0))
    assert {r.lang_pred for r in language.identify(corpus[1].limit(3), model).collect()} == {"und"}


def test_language_features_do_not_depend_on_the_batch():
    texts = ["Ba be bo", None, "zi", "Éa", "x"]
    found, of, _ = language.subwords(texts)
    for k, t in enumerate(texts):
        assert sorted(found[of == k].tolist()) == sorted(language.subwords([t])[0].tolist())


def test_toxicity(spark, corpus):
    rows, docs = corpus
    labels = docs.select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.filter("doc_id % 5 <> 0"), label="toxic")
    assert 0 < len(model.index) < 3000
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}
    held = [r for r in rows if r[0] % 5 == 0]
    assert np.mean([(got[r[0]] >= 0.5) == bool(r[3]) for r in held]) > 0.97
    out = toxicity.score_documents(odd(spark), model).collect()
    assert len(out) == 6 and all(0 <= r.score < 0.5 for r in out)
    long = toxicity.scores(model, ["ba be " * 50000 + "grobian lump"])
    assert long[0] > 0.5  # a long text is not diluted
    kept = toxicity.clean_documents(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, s in got.items() if s < 0.5}
    assert toxicity.clean_documents(docs.limit(0), model).count() == 0


def test_toxicity_batches_and_empty_training(spark, corpus):
    rows, docs = corpus
    model = toxicity.fit(docs, docs.select("doc_id", "toxic"), label="toxic", rows=200)
    texts = [r[1] for r in rows[:40]] + [None, ""]
    assert np.allclose(toxicity.scores(model, texts), [toxicity.scores(model, [t])[0] for t in texts])
    none = toxicity.fit(docs, docs.select("doc_id", "toxic").limit(0), label="toxic")
    assert toxicity.scores(none, ["a"])[0] == 0.5


def test_ftrl_leaves_most_weights_at_zero():
    rng = random.Random(2)
    rows = [(np.unique(np.array([rng.randrange(1000, 9000) for _ in range(30)] + ([5] if k % 3 == 0 else []))), int(k % 3 == 0)) for k in range(400)]
    model = toxicity.train(rows)
    assert 5 in model.index and len(model.index) < 800
    assert model.weight[model.index.tolist().index(5)] > 2


def test_quality(spark, corpus):
    rows, docs = corpus
    labels = docs.select("doc_id", "quality")
    model = quality.fit(docs, labels.filter("doc_id % 3 <> 1"), label="quality")
    got = {r.doc_id: r.score for r in quality.score_documents(docs, model).collect()}
    held = [r for r in rows if r[0] % 3 == 1]
    assert np.mean([(got[r[0]] >= 0.5) == bool(r[4]) for r in held]) > 0.95
    out = quality.score_documents(odd(spark), model).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
    assert quality.score_documents(docs.limit(0), model).count() == 0


def test_quality_with_one_label():
    model = quality.train([("a b c", 1)] * 5)
    assert quality.scores(model, ["x", None])[0] > 0.9
    assert quality.scores(quality.train([]), ["x"])[0] == 0.5


def test_samples_count_a_repeated_key_once(spark):
    rows = [(1, "b"), (1, "a"), (1, None), (2, None), (3, "c"), (None, "d")] + [(4, f"t{k:02}") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 2), (4, 1), (None, 1)], "doc_id long, toxic int")
    got = sorted(map(tuple, toxicity.sample(docs, labels, 10, label="toxic").collect()))
    assert got == [(1, 1, "a"), (2, 0, None), (4, 1, "t00")]
    assert toxicity.sample(docs, labels, 2, label="toxic").count() == 2
    model = quality.fit(docs, labels, label="toxic")
    assert 0 <= quality.scores(model, ["x"])[0] <= 1


def dense_ftrl(rows, size, passes=3, alpha=1.0, beta=1.0, l1=4.0, l2=0.02):
    """FTRL-proximal, one coordinate after the other."""
    z, n, w = [0.0] * (size + 1), [0.0] * (size + 1), [0.0] * (size + 1)
    for _ in range(passes):
        for found, label in rows:
            at = [*found, size]
            for i in at:
                most = 0.0 if i == size else l1
                w[i] = 0.0 if abs(z[i]) <= most else -(z[i] - math.copysign(most, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
            g = 1 / (1 + math.exp(-sum(w[i] for i in at))) - label
            for i in at:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    return [0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2) for i in range(size)]


def test_ftrl_is_that_of_a_plain_version():
    rng = random.Random(5)
    rows = [(sorted(rng.sample(range(60), 8)), rng.randint(0, 1)) for _ in range(300)]
    rows = [(f, int(3 in f or label and rng.random() < 0.3)) for f, label in rows]
    model = toxicity.train([(np.array(f), y) for f, y in rows])
    want = dense_ftrl(rows, 60)
    assert {int(i): pytest.approx(w, abs=1e-9) for i, w in zip(model.index, model.weight)} == {i: w for i, w in enumerate(want) if w}


def test_toxicity_features_and_scores_are_those_of_a_plain_version():
    def plain(text):
        words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
        return set(words) | {(1, a, b) for a, b in zip(words, words[1:])} | {(2, a, b) for a, b in zip(words, words[2:])}

    texts = ["a b c a b", "b a", "", None, "Ünë two ünë", "x"]
    names: dict = {}
    for t in texts:  # the same text features, the same indices: as many distinct ones, and equal ones for equal sets
        hashes, bounds, *_ = hashed_words(toxicity.lowered([t]))
        found = frozenset(toxicity.features(hashes, bounds)[0].tolist())
        assert len(found) == len(plain(t))
        names.setdefault(frozenset(plain(t)), found)
        assert names[frozenset(plain(t))] == found
    some = sorted(next(f for p, f in names.items() if len(p) > 4))
    model = toxicity.Model(np.array(some), np.linspace(-1, 1, len(some)), 0.25)
    weight = dict(zip(some, model.weight.tolist()))
    for t, p in zip(texts, toxicity.scores(model, texts)):
        assert p == pytest.approx(1 / (1 + math.exp(-0.25 - sum(weight.get(i, 0.0) for i in names[frozenset(plain(t))]))))


def test_quality_scores_are_those_of_a_plain_version():
    good, bad = b"ba be bo " * 300, b"zu zy zz " * 300
    model = quality.Model(good, bad, 2.5, -0.5)

    def size(raw, text):
        known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data, total = text.encode(), 0
        for k in range(0, len(data), 1024):
            total += len(zstandard.ZstdCompressor(level=9, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False).compress(data[k : k + 1024]))
        return total

    texts = ["ba be bo ba zz", "zu zy zz " * 500, "é" * 3000]
    want = [1 / (1 + math.exp(-2.5 * (size(bad, t) - size(good, t)) / (size(bad, t) + size(good, t)) + 0.5)) for t in texts]
    assert quality.scores(model, texts).tolist() == pytest.approx(want, abs=0.02)


def test_language_scores_are_those_of_a_plain_version():
    texts = ["ba be bo", "zi", "ba", "", None, "123"]
    rng = np.random.default_rng(3)
    table = rng.normal(size=(1 << language.BITS, 3)).astype(np.float32)
    model = language.Model(["x", "y", "z"], table, np.array([0.1, 0.0, -0.1]), 0.7, 0.5)
    names, score, rejected = language.predict(model, texts)
    for k, t in enumerate(texts):
        found, _, lettered = language.subwords([t])
        if not lettered[0]:
            assert (names[k], score[k], bool(rejected[k])) == ("und", 0.0, True)
            continue
        logits = [(sum(float(table[f, c]) for f in found) / len(found) + float(model.bias[c])) / 0.7 for c in range(3)]
        p = [math.exp(x) / sum(map(math.exp, logits)) for x in logits]
        assert names[k] == "xyz"[int(np.argmax(p))] and score[k] == pytest.approx(max(p), abs=1e-5) and bool(rejected[k]) == (max(p) < 0.5)
