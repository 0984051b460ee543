"""Quality: a compression classifier. A text is of the kind whose dictionary compresses it better.

Two zstandard dictionaries are built, from good and from bad labelled texts. A text is cut into blocks (all of it), each
block is compressed with either dictionary, and the normalised difference of the summed sizes,
``(bad - good) / (bad + good)``, is turned into a probability by a logistic curve fitted on labelled texts that went
into neither dictionary. Blocks keep a long text from being compressed by its own past instead of the dictionaries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numerant.llm.common import small_batches
from numerant.llm.toxicity import sample

#: At most so many labelled rows are learnt from; a third of them only calibrates.
TRAIN_ROWS = 9_000
DICTIONARY_BYTES = 64 << 10
BLOCK = 1024
LEVEL = 9


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    bias: float


class Sizes:
    """Compressed sizes of texts with either dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        self.tools = []
        for raw in (good, bad):
            known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            self.tools.append(zstandard.ZstdCompressor(dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False))

    def difference(self, text: str | None) -> float:
        """The normalised difference, above 0 if the good dictionary fits better; 0 for an empty text."""
        data = (text or "").encode("utf-8", "replace")
        blocks = [data[k : k + BLOCK] for k in range(0, len(data), BLOCK)]
        good, bad = (sum(len(t.compress(b)) for b in blocks) for t in self.tools)
        return (bad - good) / (bad + good) if good + bad else 0.0


def dictionary(texts: list[str], size: int = DICTIONARY_BYTES) -> bytes:
    """Dictionary content from texts: evenly spread blocks of them, as much as the size allows."""
    blocks = [b for t in texts if (d := t.encode("utf-8", "replace")) for b in (d[k : k + 256] for k in range(0, len(d), 256))]
    n = size // 256
    picked = blocks if len(blocks) <= n else [blocks[k * len(blocks) // n] for k in range(n)]
    return b"".join(picked) or b"\n" * 8


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and bias of the logistic curve of largest likelihood (Newton's method, slightly damped)."""
    scale = max(float(np.abs(x).mean()), 1e-9)
    a, w = np.column_stack([x / scale, np.ones(len(x))]), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        w += np.linalg.solve(h, a.T @ (y - p) - 1e-3 * w)
    return float(w[0] / scale), float(w[1])


def train(rows: list[tuple[str, int]]) -> Model:
    """From (text, label 0 or 1). Without both labels the share of 1s (0.5 if there are no rows) is the score of every text."""
    part = [[t for t, y in rows[k % 3 :: 3] if y == want] for want in (1, 0) for k in (0, 1)]
    good, bad = dictionary(part[0] + part[1]), dictionary(part[2] + part[3])
    rest = rows[2::3]
    y = np.array([label for _, label in rest], float)
    if len({label for _, label in rows}) < 2 or not len(rest):
        share = np.clip(np.mean([label for _, label in rows]) if rows else 0.5, 0.01, 0.99)
        return Model(good, bad, 0.0, float(np.log(share / (1 - share))))
    sizes = Sizes(good, bad)
    return Model(good, bad, *logistic(np.array([sizes.difference(t) for t, _ in rest]), y))


def scores(model: Model, texts: list[str | None], sizes: Sizes | None = None) -> np.ndarray:
    sizes = sizes or Sizes(model.good, model.bad)
    margin = model.slope * np.array([sizes.difference(t) for t in texts], float) + model.bias
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label", rows: int = TRAIN_ROWS) -> Model:
    """Learns from at most ``rows`` rows of ``labels`` (key, label 0 or 1; other values are left out), in one task whose
    input that bound keeps small. A repeated key counts once; without rows every text scores 0.5."""

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        found.sort(key=lambda r: ((int(r[0]) * 0x9E3779B97F4A7C15) % (1 << 64), r[2] or ""))  # the same order every time
        model = train([(t or "", y) for _, y, t in found])
        yield pa.RecordBatch.from_pydict({"good": [model.good], "bad": [model.bad], "slope": [model.slope], "bias": [model.bias]})

    made = sample(docs, labels, rows, key, text, label).repartition(1).mapInArrow(trained, "good binary, bad binary, slope double, bias double").collect()
    return Model(bytes(made[0].good), bytes(made[0].bad), made[0].slope, made[0].bias) if made else train([])


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key and score (0 to 1). Null texts count as empty, repeated rows stay repeated, null keys
    stay null, an empty table gives no rows; other columns are not read."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(shared.value.good, shared.value.bad)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(shared.value, b.column(1).to_pylist(), sizes))], [key, "score"])

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(score, f"`{key}` {dict(docs.dtypes)[key]}, score double")
