"""Best-fit-decreasing packing of documents into sequences, over all documents at once.

Only a document longer than a sequence is cut: the first piece takes what is left over a multiple of the capacity, the
others are full. A piece's length is a whole number up to the capacity, so the packing of any number of pieces follows
from how many there are of each length. ``best_fit_decreasing`` works on those counts: pieces by falling length, each
into the open bin with the least room that still holds it, found in a segment tree over remaining capacities. Bins
that are alike are moved together, so its result is a short list of runs (length, rank of the first piece, first bin,
pieces per bin, offset). Every piece then finds its place from its rank among pieces of its length.

Ranks are made in two levels (length and a salt of the row, then offsets of salts), so that a length that most pieces
have, as the full one in a large corpus, is dealt out over as many tasks as its count asks for, whatever their keys. The driver sees counts by
length and salt only: one for each length, and one more for every ``PER_SALT`` pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from numerant.llm.common import small_batches, stored
from numerant.llm.tokens import encoder

#: Pieces of a length and salt, which one task ranks, in expectation.
PER_SALT = 50_000


class RoomTree:
    """A segment tree over remaining capacities: how many groups of open bins have each, and the tightest that fits."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, by: int) -> None:
        k = room + self.size
        while k:
            self.count[k] += by
            k >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least ``least`` that some bin has."""
        k = least + self.size
        while k > 1:
            if self.count[k]:
                break
            while k > 1 and k & 1:  # go up past right children
                k >>= 1
            if k <= 1:
                return None
            k += 1
        if k <= 1:
            return None
        while k < self.size:
            k = 2 * k if self.count[2 * k] else 2 * k + 1
        return k - self.size


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first bin, pieces per bin, offset) for ``counts`` pieces of each length.

    The run's piece of rank r is in bin ``first bin + (r - first rank) // pieces per bin``, at
    ``offset + (r - first rank) % pieces per bin * length``. Pieces of length 0 are not packed.
    """
    tree, bins, made, runs = RoomTree(capacity), {}, 0, []  # bins: room -> [(first bin, how many)]

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if not bins.get(room):
                bins[room] = []
                tree.add(room, 1)
            bins[room].append((first, n))

    for length in sorted((x for x in counts if x > 0), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, per = capacity, capacity // length
                first, n = made, -(-left // per)
                made += n
            else:
                per = room // length
                first, n = bins[room].pop()
                if not bins[room]:
                    tree.add(room, -1)
            used = min(left, n * per)
            runs.append((length, rank, used, first, per, capacity - room))
            full, rest = divmod(used, per)
            put(room - per * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            put(room, first + full + bool(rest), n - full - bool(rest))
            left, rank = left - used, rank + used
    return runs


def pieces_of(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of every whole text: key, piece, start, length, ids_crc32 and, if asked for, the ids."""
    small_batches(docs.sparkSession)
    names = [key, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, ids in zip(b.column(0).to_pylist(), encoder(vocabulary).ids(b.column(1).to_pylist()), strict=True):
                data = ids + end
                total = len(data) // 4
                cuts = [0, *range(total % capacity or capacity, total + 1, capacity)]
                for n, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = data[4 * low : 4 * high]
                    rows.append((k, n, low, high - low, zlib.crc32(part)) + ((np.frombuffer(part, "<i4"),) if with_ids else ()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = f"`{key}` long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(cut, schema)


def placed(pieces: DataFrame, capacity: int, key: str = "doc_id") -> DataFrame:
    """``pieces`` (a stored table, as it is read twice, with a number for each row, _row) with sequence_id and offset."""
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # ``capacity`` rows at most
    salts = [-(-counts.get(k, 1) // PER_SALT) for k in range(capacity + 1)]
    salt_of = F.get(F.array(*map(F.lit, salts)), F.col("length").cast("int"))
    own = [c for c in pieces.columns if c != "_row"]
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("_row"), salt_of.cast("long")).cast("int"))
    first = np.cumsum([0, *salts])  # of the salts of each length
    table = np.zeros(first[-1], np.int64)
    for r in salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")).collect():
        table[first[r.length] + r._salt] = r.n
    ahead_of = np.cumsum(table) - table
    before = ahead_of - np.repeat(ahead_of[first[:-1]], salts)  # pieces of smaller salts of the same length
    runs = best_fit_decreasing(counts, capacity)
    runs = np.array(sorted(runs), np.int64).reshape(-1, 6)
    begins = runs[:, 0] << 44 | runs[:, 1]
    window = Window.partitionBy("length", "_salt").orderBy(F.col(key), "piece", "ids_crc32", "_row")
    ranked = salted.withColumn("_rank", F.row_number().over(window) - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, salt, rank = (b.column(c).to_numpy().astype(np.int64) for c in ("length", "_salt", "_rank"))
            rank = rank + before[first[length] + salt]
            at = np.searchsorted(begins, length << 44 | rank, "right") - 1
            ahead = rank - runs[at, 1]
            sequence = runs[at, 3] + ahead // runs[at, 4]
            offset = runs[at, 5] + ahead % runs[at, 4] * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array(sequence), pa.array(offset)], [*own, "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes if c != "_row")
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 1024, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    Null and empty texts are one piece of the end id. Repeated rows are packed as often as they occur; null keys are
    kept. An empty table gives no rows. Sequences are numbered from 0 and filled without gaps from offset 0.
    """
    pieces = pieces_of(docs, vocabulary, end_id, capacity, key, text, with_ids)
    return placed(stored(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces"), capacity, key)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the ids of each sequence, from pieces packed ``with_ids``; a sequence has ``capacity`` ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
