"""Language identification: averaged hashed subword embeddings with a linear softmax, and calibrated rejection.

A text's subwords are the letter n-grams of its lower-cased words, with word edges, hashed into a table of vectors. The
text's vector is their average; a linear layer and a softmax give the languages' probabilities. Vectors and layer are
trained together by stochastic gradient descent in numpy. A temperature fitted on texts kept out of the training makes
the probabilities honest, and the lowest tenth of a percent of right answers there sets the score below which an answer
counts as rejected.

As everything after the averaging is linear, scoring looks up each subword's share of the logits: the table that goes
to the executors has one number per bucket and language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numerant.llm.common import grouped, mixed, small_batches

BITS, SIZES, WIDTH = 16, (2, 3, 4), 16
#: At most so many rows are learnt from, a fifth of them only for calibration.
TRAIN_ROWS = 3_000
UNKNOWN = "und"
_NGRAM_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93]


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray  # bucket x language: what one subword adds to the logits, before averaging
    bias: np.ndarray
    temperature: float
    least: float  # answers that score less are rejected


_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000))
    return _letters[0]


def subwords(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text number of every subword of every text, and which texts have letters."""
    lowered = [f" {(t or '').lower()} ".encode("utf-32-le", "replace") for t in texts]
    codes = np.frombuffer(b"".join(lowered), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) // 4 for t in lowered])
    letter = letter_table()[codes]
    lettered = np.bincount(owner[letter], minlength=len(texts)) > 0
    marks = np.where(letter, codes, 0).astype(np.uint64)
    found, of = [], []
    for n in SIZES:
        if len(marks) < n:
            continue
        last = len(marks) - n + 1
        # All letters, or all but an edge at either end; a text's own blanks keep n-grams from crossing texts.
        fits = letter[: last].copy() if n == 2 else letter[1 : last + 1].copy()
        if n == 2:
            fits |= letter[1 : last + 1]
        else:
            for k in range(2, n - 1):
                fits &= letter[k : last + k]
        at = np.flatnonzero(fits)
        hashed = np.full(len(at), n, np.uint64)
        for k in range(n):
            hashed += marks[at + k] * np.uint64(_NGRAM_ODD[k])
        found.append((mixed(hashed) >> np.uint64(64 - BITS)).astype(np.int64))
        of.append(owner[at])
    return np.concatenate(found), np.concatenate(of), lettered


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], least_steps: int = 12_000, rate: float = 0.5, seed: int = 7) -> Model:
    """From (distinct buckets, their counts, language), in 5 passes or as many as make ``least_steps`` steps; without
    rows there is no language."""
    languages = sorted({r[2] for r in rows})
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    number = {name: k for k, name in enumerate(languages)}
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (1 << BITS, WIDTH)) / WIDTH
    layer, bias = np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    kept, rest = [r for k, r in enumerate(rows) if k % 5], rows[::5]
    kept = kept or rest
    passes = max(5, -(-least_steps // len(kept)))
    steps, done = passes * len(kept), 0
    for _ in range(passes):
        for k in rng.permutation(len(kept)):
            found, counts, name = kept[k]
            now = rate * (1 - done / steps)
            done += 1
            share = counts / counts.sum()
            mean = share @ vectors[found]
            error = softmax(mean @ layer + bias)
            error[number[name]] -= 1
            back = layer @ error
            layer -= now * np.outer(mean, error)
            bias -= 0.1 * now * error
            vectors[found] -= now * 8 * share[:, None] * back
    table = vectors @ layer
    logits = np.array([(c / c.sum()) @ table[f] + bias for f, c, _ in rest])
    right = np.array([number[name] for _, _, name in rest])
    grid = np.geomspace(0.2, 5, 60)
    loss = [-np.log(softmax(logits / t)[np.arange(len(right)), right] + 1e-12).mean() for t in grid]
    heat = float(grid[int(np.argmin(loss))])
    sure = softmax(logits / heat)
    good = sure.max(axis=1)[sure.argmax(axis=1) == right]
    return Model(languages, table.astype(np.float32), bias, heat, float(np.quantile(good, 0.001)) if len(good) else 0.0)


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and whether the answer is rejected; ``und`` (score 0, rejected) for texts without letters."""
    names, sure, odd = [], [], []
    for part in grouped([len(t or "") for t in texts], 500_000):
        n = len(texts[part])
        if not model.languages:
            names, sure, odd = names + [UNKNOWN] * n, sure + [np.zeros(n)], odd + [np.ones(n, bool)]
            continue
        found, of, lettered = subwords(texts[part])
        count = np.maximum(np.bincount(of, minlength=n), 1)
        logits = np.stack([np.bincount(of, model.table[found, k], n) for k in range(len(model.languages))], axis=1)
        p = softmax((logits / count[:, None] + model.bias) / model.temperature)
        best = p.argmax(axis=1)
        score = np.where(lettered, p[np.arange(n), best], 0.0)
        names += [model.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
        sure.append(score)
        odd.append(score < model.least if lettered.all() else (score < model.least) | ~lettered)
    return names, np.concatenate(sure) if sure else np.zeros(0), np.concatenate(odd) if odd else np.zeros(0, bool)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """Learns from at most ``rows`` rows with a language and letters, chosen by a hash of the key. A repeated key counts
    once, with its smallest text; rows without key, language or text are left out. From no rows at all comes a model
    that knows no language.

    Subwords are counted where the texts are; one task, whose input the bound keeps small, trains.
    """
    small_batches(docs.sparkSession)
    known = docs.filter(F.col(key).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull())
    chosen = known.select(F.col(key).alias("_key")).distinct().orderBy(F.xxhash64("_key"), "_key").limit(rows)
    picked = known.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"), F.col(lang).alias("_lang")).join(F.broadcast(chosen), "_key")
    picked = picked.groupBy("_key").agg(F.min(F.struct("_text", "_lang")).alias("one")).select("_key", "one.*")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                found, counts = np.unique(subwords([t])[0], return_counts=True)
                out.append((found.astype("<u2").tobytes(), counts.astype("<u4").tobytes()))
            cols = [pa.array(c, pa.binary()) for c in (zip(*out, strict=True) if out else ([], []))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2), *cols], ["id", "lang", "found", "counts"])

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        got.sort(key=lambda r: ((r[0] * 0x9E3779B97F4A7C15) % (1 << 64), r[2]))  # the same order every time
        used = [(np.frombuffer(found, "<u2").astype(np.int64), np.frombuffer(counts, "<u4").astype(float), name) for _, name, found, counts in got]
        m = train([r for r in used if len(r[0])])
        yield pa.RecordBatch.from_pydict({"names": [m.languages], "table": [m.table.astype("<f4").tobytes()], "bias": [m.bias.tolist()], "temperature": [m.temperature], "least": [m.least]}, pa.schema({"names": pa.list_(pa.string()), "table": pa.binary(), "bias": pa.list_(pa.float64()), "temperature": pa.float64(), "least": pa.float64()}))

    counts = picked.mapInArrow(counted, "id long, lang string, found binary, counts binary")
    made = counts.repartition(1).mapInArrow(trained, "names array<string>, table binary, bias array<double>, temperature double, least double").collect()
    if not made:
        return train([])
    m = made[0]
    return Model(list(m.names), np.frombuffer(bytes(m.table), "<f4").reshape(1 << BITS, -1) if m.names else np.zeros((1 << BITS, 0), np.float32), np.array(m.bias), m.temperature, m.least)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, lang_pred, score (0 to 1), rejected.

    Null and empty texts and texts without letters are ``und`` with score 0, rejected. Repeated rows stay repeated, null
    keys stay null, an empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, score, odd = predict(shared.value, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(odd)], [key, "lang_pred", "score", "rejected"])

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, lang_pred string, score double, rejected boolean")
