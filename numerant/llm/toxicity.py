"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the words, word pairs and pairs with one word between that occur in it, hashed into a fixed
space; each counts once, so a long text is not diluted. Training goes through a bounded sample of labelled rows with a
learning rate of its own for each weight; the L1 penalty leaves most weights at exactly 0, and the model that goes to
the executors is the short list of the others. Scoring first drops features without a weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numerant.llm.common import grouped, hashed_words, mixed, small_batches

BITS = 20
#: At most so many labelled rows are learnt from.
TRAIN_ROWS = 12_000


@dataclass(frozen=True)
class Model:
    index: np.ndarray  # sorted, of the weights that aren't 0
    weight: np.ndarray
    bias: float


def features(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature indices of consecutive texts of words, with repeats, and the text of each."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    shift = np.uint64(64 - BITS)
    found, of = [hashes >> shift], [owner]
    for gap, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        if len(hashes) > gap:
            same = owner[gap:] == owner[:-gap]
            found.append((mixed(hashes[:-gap] * np.uint64(salt) + hashes[gap:]) >> shift)[same])
            of.append(owner[gap:][same])
    return np.concatenate(found).astype(np.int64), np.concatenate(of)


def lowered(texts: list[str | None]) -> list[bytes]:
    return [(t or "").lower().encode("utf-8", "replace") for t in texts]


def train(rows: list[tuple[np.ndarray, int]], passes: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.02) -> Model:
    """FTRL-proximal over (distinct feature indices, label), in the order given."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)  # the last is the bias, which has no L1

    def weights(at: np.ndarray, z_at: np.ndarray, n_at: np.ndarray) -> np.ndarray:
        penalty = np.where(at == 1 << BITS, 0.0, l1)
        w = -(z_at - np.sign(z_at) * penalty) / ((beta + np.sqrt(n_at)) / alpha + l2)
        return np.where(np.abs(z_at) <= penalty, 0.0, w)

    for _ in range(passes):
        for found, label in rows:
            at = np.append(found, np.uint32(1 << BITS))
            z_at, n_at = z[at], n[at]
            w = weights(at, z_at, n_at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
            grown = n_at + g * g
            z[at] = z_at + g - (np.sqrt(grown) - np.sqrt(n_at)) / alpha * w
            n[at] = grown
    every = np.arange((1 << BITS) + 1)
    w = weights(every, z, n)
    index = np.flatnonzero(w[:-1])
    return Model(index, w[index], float(w[-1]))


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    """The probability of label 1 for each text; null counts as empty."""
    table = np.zeros(1 << BITS, bool)
    table[model.index] = True
    coded, out = lowered(texts), []
    for part in grouped([len(c) for c in coded]):
        hashes, bounds, *_ = hashed_words(coded[part])
        found, of = features(hashes, bounds)
        heavy = table[found]
        pairs = np.unique(of[heavy] << BITS | found[heavy])
        weight = model.weight[np.searchsorted(model.index, pairs & ((1 << BITS) - 1))]
        margin = np.bincount(pairs >> BITS, weight, len(bounds) - 1) + model.bias
        out.append(1 / (1 + np.exp(-np.clip(margin, -30, 30))))
    return np.concatenate(out) if out else np.zeros(0)


def sample(docs: DataFrame, labels: DataFrame, rows: int, key: str = "doc_id", text: str = "text", label: str = "label") -> DataFrame:
    """At most ``rows`` labelled texts, chosen by a hash of the key: (key, label, text).

    A repeated key counts once, with its largest label and its smallest text (null only if it has no other), so that
    the bound is one of rows. Rows without a key or with other labels than 0 and 1 are left out.
    """
    small_batches(docs.sparkSession)
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    chosen = known.orderBy(F.xxhash64(key), key).limit(rows)  # integers, few; broadcast as bounded by ``rows``
    found = docs.select(F.col(key), F.col(text).cast("string").alias("_text")).join(F.broadcast(chosen), key)
    return found.groupBy(key, "_label").agg(F.min("_text").alias("_text"))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label", rows: int = TRAIN_ROWS) -> Model:
    """Learns from at most ``rows`` rows of ``labels`` (key, label 0 or 1; other values are left out).

    Without labelled rows the model scores 0.5 everywhere. Features are made where the texts are, and one task, whose
    input the bound keeps small, trains; what comes to the driver is the short list of weights.
    """

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = []
            for t in lowered(b.column(2).to_pylist()):
                hashes, bounds, *_ = hashed_words([t])
                packed.append(np.unique(features(hashes, bounds)[0]).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(packed, pa.binary())], ["id", "label", "found"])

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(x, label, found) for b in batches for x, label, found in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        got.sort(key=lambda r: ((r[0] * 0x9E3779B97F4A7C15) % (1 << 64), r[2]))  # the same order every time
        model = train([(np.frombuffer(found, "<u4"), label) for _, label, found in got])
        yield pa.RecordBatch.from_pydict({"at": [*model.index.tolist(), 1 << BITS], "weight": [*model.weight.tolist(), model.bias]})

    made = sample(docs, labels, rows, key, text, label).mapInArrow(featured, "id long, label int, found binary")
    weights = sorted((r.at, r.weight) for r in made.repartition(1).mapInArrow(trained, "at long, weight double").collect())
    return Model(np.array([at for at, _ in weights[:-1]], np.int64), np.array([w for _, w in weights[:-1]]), weights[-1][1]) if weights else Model(np.zeros(0, np.int64), np.zeros(0), 0.0)


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key and score (0 to 1). Null texts count as empty, repeated rows stay repeated, null keys
    stay null, an empty table gives no rows; other columns are not read."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(shared.value, b.column(1).to_pylist()))], [key, "score"])

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(score, f"`{key}` {dict(docs.dtypes)[key]}, score double")


def clean_documents(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns.

    A score equal to the threshold goes. Null and empty texts score as texts without words do; rows with a null key and
    repeated rows are judged like all others. An empty table stays empty.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text)
            yield b.filter(pa.array(scores(shared.value, b.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(keep, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes))
