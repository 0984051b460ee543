"""Benchmark decontamination by spaced seeds.

A spaced seed is a mask over consecutive words: ones are hashed, zeros may be anything, so a substituted word does not
hide an overlap. Seeds of the benchmark's items and of the documents are joined by hash; every meeting names an item, a
document and a shift between them, and the words around it are compared one by one. A document overlaps an item where a
stretch of at least ``least`` words (or the whole item, if that is shorter) agrees in at least ``share`` of them, its
ends included.

The masks meet every such stretch. Of a stretch of 26 words or more, some part of 13 to 25 words agrees in as large a
share, and ``MASKS`` meet every way of substituting a fifth of 13 to 25 words. Shorter items, and a smaller ``least``,
have masks of their own, found by ``masks_for`` in the same way.

A benchmark of up to ``BROADCAST_CHARS`` characters goes to every task (as seeds and words, 40 bytes for each character at
most); a larger one is joined by shuffles, after the documents' seeds have passed a bitmap of fixed size. Words are runs
of letters and digits, lower case.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from numerant.llm.common import grouped, hashed_words, mixed, small_batches, stored
from numerant.llm.toxicity import lowered

LONG = 13  # stretches of so many words have the masks that follow, shorter ones their own
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 2, 4, 8, 9), (0, 5, 8, 9, 10, 11))
LEAST, SHARE = 13, 0.8
LEAST_SHARE = 0.8  # of which the masks are made
BROADCAST_CHARS = 4 << 20
BITMAP_BITS = 24
_FACTORS = mixed(np.arange(1, 65, dtype=np.uint64))


def seeds(words: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    """The hash of every place where the mask fits."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, salt, np.uint64)
    for k, at in enumerate(mask):
        total += words[at : at + n] * _FACTORS[k]
    return mixed(total)


def patterns(length: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ``length`` words, and unless it is the ``whole`` item up to twice that, as sizes and bits of the
    places where they disagree; as many as ``LEAST_SHARE`` allows, at the ends too unless the item is whole."""
    sizes, gone = [], []
    for n in range(length, length + 1 if whole else 2 * length):
        inner = range(1, n - 1) if whole else range(n)
        for places in combinations(inner, int((1 - LEAST_SHARE) * n + 1e-9)):
            sizes.append(n)
            gone.append(sum(1 << p for p in places))
    return np.array(sizes), np.array(gone, np.int64)


def met(mask: tuple[int, ...], sizes: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Which of these stretches have a place where the mask agrees."""
    bits, out = sum(1 << p for p in mask), np.zeros(len(sizes), bool)
    for shift in range(int(sizes.max()) - mask[-1]):
        out |= (shift + mask[-1] < sizes) & (gone & (bits << shift) == 0)
    return out


@cache
def masks_for(length: int, whole: bool) -> tuple[tuple[int, ...], ...]:
    """Masks that meet every stretch of ``length`` words or more (or of exactly that many, of a ``whole`` item): as many
    words as are always met, at most six, chosen one after the other by what they still meet."""
    if length >= LONG:
        return MASKS
    sizes, gone = patterns(length, whole)
    for weight in range(min(6, length), 0, -1):
        every = [(0, *c) for c in combinations(range(1, length), weight - 1)]
        meets, left, chosen = np.array([met(m, sizes, gone) for m in every]), np.ones(len(sizes), bool), []
        if not meets.any(axis=0).all():
            continue
        while left.any():
            best = int((meets & left).sum(axis=1).argmax())
            chosen.append(every[best])
            left &= ~meets[best]
        return tuple(chosen)
    raise ValueError("no mask meets a stretch without words")


def kind_of(words: int, least: int) -> tuple[int, bool]:
    """The kind of masks for an item: the length of its stretches, and whether they are the whole item."""
    return (words, True) if words < min(least, LONG) else (min(least, LONG), False)


def salted(kind: tuple[int, bool]) -> list[tuple[tuple[int, ...], int]]:
    return [(mask, 1000 * kind[0] + 500 * kind[1] + k) for k, mask in enumerate(masks_for(*kind))]


def item_seeds(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of an item's seeds."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = [seeds(words, m, salt) for m, salt in salted(kind_of(len(words), least))]
    return np.concatenate(found), np.concatenate([np.arange(len(f)) for f in found])


class Benchmark:
    """Items by number, with an index of their seeds; ``kinds`` are the kinds of masks that they have."""

    def __init__(self, ids: list, words: list[np.ndarray], least: int):
        self.ids, self.words = ids, words
        self.kinds = sorted({kind_of(len(w), least) for w in words if len(w)})
        found = [item_seeds(w, least) for w in words]
        hashes = np.concatenate([f[0] for f in found] or [np.zeros(0, np.uint64)])
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.item = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])[order]
        self.at = np.concatenate([f[1] for f in found] or [np.zeros(0, np.int64)])[order]
        self.bitmap = bitmap(self.hashes)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"bitmap": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state
        self.bitmap = bitmap(self.hashes)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << BITMAP_BITS, bool)
    out[hashes >> np.uint64(64 - BITMAP_BITS)] = True
    return out


def document_seeds(words: np.ndarray, known: np.ndarray, kinds: list[tuple[int, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the seeds of a text, or of many in a row, that pass the bitmap."""
    hashes, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for mask, salt in (m for kind in kinds for m in salted(kind)):
        found = seeds(words, mask, salt)
        place = np.flatnonzero(known[found >> np.uint64(64 - BITMAP_BITS)])
        hashes.append(found[place])
        at.append(place)
    return np.concatenate(hashes), np.concatenate(at)


def longest_agreement(same: np.ndarray, share: float) -> tuple[int, int]:
    """The longest stretch that agrees in at least ``share`` of its places and at both ends (the last of equals); (0, 0)
    if none."""
    if not same.any():
        return 0, 0
    gain = np.concatenate([[0.0], np.cumsum(np.where(same, 1 - share, -share))])
    lowest = np.minimum.accumulate(np.where(same, gain[:-1], np.inf))  # falls from left to right, at places that agree
    ends = np.flatnonzero(same) + 1
    begin = np.searchsorted(-lowest, -(gain[ends] + 1e-9), "left")  # the first place that is no higher
    length = ends - begin
    best = len(length) - 1 - int(length[::-1].argmax())
    return int(begin[best]), int(ends[best])


def overlap(doc: np.ndarray, item: np.ndarray, shift: int, least: int, share: float) -> tuple[int, int, int] | None:
    """First and last (exclusive) word in the document, and how many agree, with the item laid at ``shift``."""
    low, high = max(0, shift), min(len(doc), shift + len(item))
    if high <= low:
        return None
    same = doc[low:high] == item[low - shift : high - shift]
    a, b = longest_agreement(same, share)
    return (low + a, low + b, int(same[a:b].sum())) if b - a >= min(least, len(item)) else None


def best_overlaps(doc: np.ndarray, meetings: set[tuple[int, int]], items: dict | list, least: int, share: float) -> dict:
    """For each item with a verified overlap, the one with the most agreeing words (then the first)."""
    out: dict = {}
    for item, shift in sorted(meetings):
        if (found := overlap(doc, items[item], shift, least, share)) and (item not in out or (-found[2], found[0]) < (-out[item][2], out[item][0])):
            out[item] = found
    return out


def in_texts(bench: Benchmark, texts: list[str | None], least: int, share: float) -> list[dict]:
    """Verified overlaps of each text: item number -> (first word, last word, agreeing words)."""
    coded, out = lowered(texts), []
    for part in grouped([len(c) for c in coded]):
        words, bounds, *_ = hashed_words(coded[part])
        hashes, at = document_seeds(words, bench.bitmap, bench.kinds)
        low, high = np.searchsorted(bench.hashes, hashes, "left"), np.searchsorted(bench.hashes, hashes, "right")
        n = high - low
        entry = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        place = np.repeat(at, n)
        text = np.searchsorted(bounds, place, "right") - 1
        found = np.unique(np.stack([text, bench.item[entry], place - bounds[text] - bench.at[entry]], axis=1), axis=0) if len(entry) else np.zeros((0, 3), np.int64)
        meetings: dict[int, set] = {}
        for t, item, shift in found.tolist():
            meetings.setdefault(t, set()).add((item, shift))
        out += [best_overlaps(words[bounds[t] : bounds[t + 1]], meetings[t], bench.words, least, share) if t in meetings else {} for t in range(len(bounds) - 1)]
    return out


def sound(least: int, share: float) -> None:
    if share < LEAST_SHARE or least < 1:
        raise ValueError(f"share must be {LEAST_SHARE} or more, and least 1 or more")


def items_of(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    return benchmark.filter(F.col(text).isNotNull()).select(F.col(key).alias("item_id"), F.col(text).cast("string").alias("_item"))


def collected(benchmark: DataFrame, key: str, text: str, least: int, most: int) -> Benchmark | None:
    """The benchmark, if its texts have at most ``most`` characters in all."""
    items = items_of(benchmark, key, text)
    if (items.agg(F.sum(F.length("_item"))).first()[0] or 0) > most:
        return None
    rows = sorted(items.collect(), key=lambda r: (r.item_id is None, r.item_id, r._item))
    words, bounds, *_ = hashed_words(lowered([r._item for r in rows]))
    return Benchmark([r.item_id for r in rows], [words[a:b].copy() for a, b in zip(bounds, bounds[1:], strict=False)], least)


FOUND = "item_id {item}, first_word long, last_word long, n_equal long, n_words long, similarity double"


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", least: int = LEAST, share: float = SHARE, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """One row per document and benchmark item that overlap: key, item_id, first_word and last_word (of the document's
    words, exclusive), n_equal, n_words of the stretch, and similarity (their ratio).

    Null and empty texts, on either side, overlap with nothing; null keys stay null; repeated rows give repeated rows
    on the documents' side, and repeated items one row each; an empty table on either side gives no rows; other columns
    are not read. A ``share`` below 0.8 or a ``least`` below 1 is an error, as no masks are made for it.
    """
    sound(least, share)
    spark = docs.sparkSession
    small_batches(spark)
    schema = f"`{key}` {dict(docs.dtypes)[key]}, " + FOUND.format(item=dict(benchmark.dtypes)[item_key])
    base = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    bench = collected(benchmark, item_key, item_text, least, broadcast_chars)
    if bench is None:
        return _shuffled(base, items_of(benchmark, item_key, item_text), key, least, share, schema)
    shared = spark.sparkContext.broadcast(bench)
    item_type = to_arrow_type(benchmark.schema[item_key].dataType)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            rows = [(k, item, f) for k, found in enumerate(in_texts(known, b.column(1).to_pylist(), least, share)) for item, f in sorted(found.items())]
            yield rows_of(b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), [known.ids[r[1]] for r in rows], [r[2] for r in rows], key, item_type)

    return base.mapInArrow(find, schema)


def rows_of(keys: pa.Array, items: list, found: list[tuple[int, int, int]], key: str, item_type: pa.DataType) -> pa.RecordBatch:
    first, last, equal = (pa.array([f[k] for f in found], pa.int64()) for k in range(3))
    words = [f[1] - f[0] for f in found]
    similar = pa.array([f[2] / n for f, n in zip(found, words, strict=True)], pa.float64())
    return pa.RecordBatch.from_arrays([keys, pa.array(items, item_type), first, last, equal, pa.array(words, pa.int64()), similar], [key, "item_id", "first_word", "last_word", "n_equal", "n_words", "similarity"])


def _shuffled(base: DataFrame, items: DataFrame, key: str, least: int, share: float, schema: str) -> DataFrame:
    """The way for benchmarks of any size: seeds of both sides meet in a join."""
    spark = base.sparkSession
    items = stored(items.withColumn("_no", F.xxhash64("item_id", "_item")), "items")

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for no, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words, *_ = hashed_words(lowered([text]))
                hashes, at = item_seeds(words, least)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.full(len(at), no, np.int64)), pa.array(at.astype(np.int64)), pa.array(np.full(len(at), len(words), np.int32))], ["seed", "_no", "item_at", "size"])

    test = stored(items.select("_no", "_item").mapInArrow(of_items, "seed long, _no long, item_at long, size int"), "item-seeds")
    kinds = sorted({kind_of(r.size, least) for r in test.select(F.least("size", F.lit(LONG)).alias("size")).distinct().collect()})
    place = F.shiftrightunsigned("seed", 64 - BITMAP_BITS) + 1
    marks = test.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    known = np.zeros(1 << BITMAP_BITS, bool)
    for r in marks.collect():  # 512 rows of 4 KB at most
        known[(r.bucket - 1) << 15 : r.bucket << 15] = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")
    shared = spark.sparkContext.broadcast(np.packbits(known))
    # Equal texts overlap with the same items, so texts are known by a digest.
    texts = base.filter(F.col("_text").isNotNull()).withColumn("_digest", F.sha2("_text", 256))

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            for digest, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                hashes, at = document_seeds(hashed_words(lowered([text]))[0], bits, kinds)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array([digest] * len(at)), pa.array(at.astype(np.int64))], ["seed", "_digest", "at"])

    train = texts.select("_digest", "_text").mapInArrow(of_texts, "seed long, _digest string, at long")
    meetings = train.join(test, "seed").select("_digest", "_no", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    meetings = meetings.join(texts.select("_digest", "_text").dropDuplicates(["_digest"]), "_digest").join(items.select("_no", "_item").dropDuplicates(["_no"]), "_no")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                doc, item = (hashed_words(lowered([r[c]]))[0] for c in ("_text", "_item"))
                if found := overlap(doc, item, r["shift"], least, share):
                    rows.append((r["_digest"], r["_no"], *found))
            cols = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = [pa.string()] + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["_digest", "_no", "first_word", "last_word", "n_equal"])

    agreed = meetings.mapInArrow(verify, "_digest string, _no long, first_word long, last_word long, n_equal long")
    best = agreed.groupBy("_digest", "_no").agg(F.min(F.struct(-F.col("n_equal"), "first_word", "last_word", "n_equal")).alias("b"))
    out = texts.select(key, "_digest").join(best, "_digest").join(items.select("_no", "item_id"), "_no")
    n = F.col("b.last_word") - F.col("b.first_word")
    return out.select(key, "item_id", "b.first_word", "b.last_word", "b.n_equal", n.alias("n_words"), (F.col("b.n_equal") / n).alias("similarity"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", least: int = LEAST, share: float = SHARE, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """The rows of ``docs`` that overlap with no item, with all their columns; rows without text stay, repeated rows too.
    Empty tables pass through. Limits are those of ``overlaps``."""
    sound(least, share)
    small_batches(docs.sparkSession)
    bench = collected(benchmark, item_key, item_text, least, broadcast_chars)
    if bench is None:
        digest = F.sha2(F.col(text).cast("string"), 256)
        found = overlaps(docs.select(digest.alias("_digest"), F.col(text)), benchmark, "_digest", text, item_key, item_text, least, share, broadcast_chars)
        return docs.withColumn("_digest", digest).join(found.select("_digest").distinct(), "_digest", "left_anti").select(docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(bench)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = in_texts(shared.value, b.column(b.schema.get_field_index(text)).to_pylist(), least, share)
            yield b.filter(pa.array([not f for f in found], pa.bool_()))

    return docs.mapInArrow(keep, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes))
