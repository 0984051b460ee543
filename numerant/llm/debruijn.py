"""Removal of long repeated spans of words by compaction of the de Bruijn graph of the texts.

Every ``window`` consecutive words are an edge, from the node of their first words to that of their last. Only edges that
may occur twice are kept: an edge's bucket is the least hash of the ``SEED`` words in a row that it holds, equal edges
share it, and a bucket that all texts together enter once has no repeated edge. Consecutive edges of a text whose least
hash is the same occurrence travel as one piece (its hash, and where it starts); equal pieces are counted before
anything else.

In buckets that hold different pieces the graph is made: edges are joined with their numbers of different edges before
and after, ends of pieces included, and pieces are cut where a node branches. What lies between is a path, of which every
occurrence of an edge holds the whole, so a path's occurrences and its first one, the source, are those of its first
edge; paths are counted by that. Elsewhere a piece is a path. A path that occurs twice is a repeat wherever its coordinates
(key, text, place) aren't those of its source; adjacent repeats whose sources are adjacent make up long spans.

An edge is known by its hash and its bucket, 64 bits each, and by its source's coordinates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from numerant.llm.common import NOT_SPACE, grouped, hashed_words, id_filter, maybe_in, mixed, powers, small_batches, stored

WINDOW = 20
SEED = 6  # words whose least hash is a window's bucket
_SALT = np.uint64(0xD6E8FEB86659FD93)


def rolling(values: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive values."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[: len(values)], out=sums[1:])
    return mixed((sums[n:] - sums[:-n]) * powers(len(values) + 1, -1)[: len(values) + 1 - n])


def least_of(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of every ``n`` consecutive values, and where it stands (the first of equals)."""

    def better(v: np.ndarray, at: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
        left = v[: len(v) - by] <= v[by:]
        return np.where(left, v[: len(v) - by], v[by:]), np.where(left, at[: len(at) - by], at[by:])

    width, out, at = 1, values, np.arange(len(values))
    while 2 * width <= n:
        out, at = better(out, at, width)
        width *= 2
    return better(out, at, n - width) if n > width else (out, at)


class Pieces:
    """The pieces of texts: text, start (the first window's first word), size (windows), bucket, and edges of all in a row."""

    def __init__(self, texts: list[bytes], window: int, seed: int):
        words, bounds, *_ = hashed_words(texts, NOT_SPACE)
        counts = np.maximum(np.diff(bounds) - window + 1, 0)
        text = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(len(text)) + np.repeat(bounds[:-1] - (np.cumsum(counts) - counts), counts)
        seeds = mixed(rolling(words, seed) ^ _SALT)
        edges = buckets = place = np.zeros(0, np.uint64)
        if len(at):
            edges, (buckets, place) = rolling(words, window)[at], least_of(seeds, window - seed + 1)
            buckets, place = buckets[at], place[at]
        begins = np.ones(len(at), bool)
        begins[1:] = (text[1:] != text[:-1]) | (place[1:] != place[:-1])
        first = np.flatnonzero(begins)
        self.first, self.edges = np.append(first, len(at)), edges
        self.size, self.bucket, self.text = np.diff(self.first), buckets[first], text[first]
        self.start = at[first] - bounds[self.text]
        sums = np.zeros(len(edges) + 1, np.uint64)
        np.cumsum(mixed(edges + _SALT) * powers(len(edges))[: len(edges)], out=sums[1:])
        self.name = mixed((sums[self.first[1:]] - sums[first]) * powers(len(edges) + 1, -1)[first] + self.size.astype(np.uint64))


def _in_parts(batch: pa.RecordBatch, window: int, seed: int) -> Iterator[tuple[slice, Pieces]]:
    texts = [t.encode() for t in batch.column("_text").to_pylist()]
    for part in grouped([len(t) for t in texts]):
        yield part, Pieces(texts[part], window, seed)


def bucket_counts(rows: DataFrame, window: int, seed: int) -> DataFrame:
    """_bucket and how many pieces enter it (_n), summed for each part of a batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, p in _in_parts(b, window, seed):
                bucket, n = np.unique(p.bucket, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(n.astype(np.int64))], ["_bucket", "_n"])

    return rows.mapInArrow(count, "_bucket long, _n long")


def pieces(rows: DataFrame, window: int, seed: int, with_edges: bool) -> DataFrame:
    """_bucket, _piece (its hash), _key, _of (the text's hash), _start and, if asked for, _edges."""
    names = ["_bucket", "_piece", "_key", "_of", "_start"] + ["_edges"] * with_edges

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, p in _in_parts(b, window, seed):
                which = pa.array(p.text + part.start)
                own = [pa.array(p.bucket.view(np.int64)), pa.array(p.name.view(np.int64)), b.column("_key").take(which), b.column("_of").take(which), pa.array(p.start.astype(np.int32))]
                lists = [pa.ListArray.from_arrays(pa.array(p.first.astype(np.int32)), pa.array(p.edges.view(np.int64)))] if with_edges else []
                yield pa.RecordBatch.from_arrays(own + lists, names)

    schema = f"_bucket long, _piece long, _key {dict(rows.dtypes)['_key']}, _of long, _start int" + ", _edges array<long>" * with_edges
    return rows.mapInArrow(cut, schema)


def paths_of(found: DataFrame) -> DataFrame:
    """Of distinct pieces of a bucket (_bucket, _piece, _edges) their paths: _no (of the first edge in the piece), _size and
    _head (the first edge)."""
    n = F.size("_edges")
    before = F.concat(F.array(F.lit(0).cast("long")), F.slice("_edges", F.lit(1), n - 1))
    after = F.concat(F.slice("_edges", F.lit(2), n - 1), F.array(F.lit(0).cast("long")))
    edges = found.select("_bucket", "_piece", F.posexplode(F.arrays_zip(F.col("_edges").alias("edge"), before.alias("before"), after.alias("after"))).alias("_no", "_e"))
    edges = edges.select("_bucket", "_piece", "_no", F.col("_e.edge").alias("_edge"), F.col("_e.before").alias("_before"), F.col("_e.after").alias("_after"))
    one = lambda c: F.min(c) == F.max(c)
    degrees = edges.groupBy("_bucket", "_edge").agg(one("_before").alias("_one_in"), one("_after").alias("_one_out"))
    joined = edges.drop("_before", "_after").join(degrees, ["_bucket", "_edge"])
    listed = joined.groupBy("_bucket", "_piece").agg(F.array_sort(F.collect_list(F.struct("_no", "_edge", "_one_in", "_one_out"))).alias("_each"))  # fewer edges than a window has words
    begins = F.filter("_each", lambda e, k: (k == 0) | ~e["_one_in"] | ~F.get("_each", k - 1)["_one_out"])
    listed = listed.withColumn("_begins", begins).withColumn("_most", F.size("_each"))
    made = F.transform("_begins", lambda e, k: F.struct(e["_no"].alias("_no"), (F.coalesce(F.get("_begins", k + 1)["_no"], F.col("_most")) - e["_no"]).alias("_size"), e["_edge"].alias("_head")))
    return listed.select("_bucket", "_piece", F.explode(made).alias("_p")).select("_bucket", "_piece", "_p.*")


def _source(place: Column) -> Column:
    return F.struct(F.col("_source._key").alias("_key"), F.col("_source._of").alias("_of"), (F.col("_source._start") + place).alias("_start"))


def repeats(rows: DataFrame, window: int, seed: int) -> DataFrame:
    """Occurrences of repeated paths that aren't the source: _key, _of, _start, _size (windows) and _source (_key, _of,
    _start). ``rows`` has _key, _of and _text, of at least ``window`` words or none."""
    counts = bucket_counts(rows, window, seed).groupBy("_bucket").agg(F.sum("_n").alias("_n"))
    known_twice = stored(counts.filter("_n > 1").select("_bucket"), "buckets")
    known = id_filter(known_twice)

    def entered_twice(found: DataFrame) -> DataFrame:
        return found.join(known_twice, "_bucket", "left_semi") if known is None else maybe_in(found, "_bucket", known)

    found = entered_twice(pieces(rows, window, seed, True)).groupBy("_bucket", "_piece")
    found = found.agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_key", "_of", "_start")).alias("_source"), F.any_value("_edges").alias("_edges"))
    found = stored(found, "pieces")
    mixed_buckets = stored(found.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_bucket"), "buckets")
    several = id_filter(mixed_buckets)

    whole = maybe_in(found, "_bucket", several, inside=False).filter("_n > 1").select("_bucket", "_piece", F.lit(0).alias("_no"), F.size("_edges").alias("_size"), "_source")
    parts = paths_of(maybe_in(found, "_bucket", several)).join(found.select("_bucket", "_piece", "_n", "_source"), ["_bucket", "_piece"])
    parts = parts.withColumn("_source", _source(F.col("_no")))
    twice = parts.groupBy("_bucket", "_head").agg(F.sum("_n").alias("_n"), F.min("_source").alias("_first")).filter("_n > 1").drop("_n")
    parts = parts.join(twice, ["_bucket", "_head"]).select("_bucket", "_piece", "_no", "_size", F.col("_first").alias("_source"))
    paths = stored(whole.unionByName(parts), "paths")

    placed = entered_twice(pieces(rows, window, seed, False)).join(paths, ["_bucket", "_piece"]).withColumn("_start", F.col("_start") + F.col("_no"))
    is_source = F.col("_key").eqNullSafe(F.col("_source._key")) & (F.col("_of") == F.col("_source._of")) & (F.col("_start") == F.col("_source._start"))
    return placed.filter(~is_source).select("_key", "_of", "_start", "_size", "_source")


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    words = F.col(f"`{text}`").cast("string")
    rows = docs.select(F.col(f"`{key}`").alias("_key"), words.alias("_text"))
    return rows.withColumn("_of", F.xxhash64("_text"))


def _checked(window: int, seed: int) -> int:
    if window < 2:
        raise ValueError("window must be 2 words or more")
    return max(1, min(seed, window - 1))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Spans whose every window of ``window`` words also starts earlier (smaller key, or same text, earlier), as long as
    their sources go along: key, start, n_words, source_key, source_start.

    Words are what ASCII white space separates. Null, empty and shorter texts have no spans; null keys come first; of
    texts with the same key the order is that of their hashes, and equal rows count as one; an empty table gives no rows.
    """
    seed = _checked(window, seed)
    small_batches(docs.sparkSession)
    found = repeats(_rows(docs, key, text).filter("_text is not null"), window, seed).distinct()
    found = found.select("_key", "_of", "_start", "_size", F.col("_source._key").alias("_from"), F.col("_source._of").alias("_from_of"), (F.col("_source._start") - F.col("_start")).alias("_shift"))
    along = ["_key", "_of", "_from", "_from_of", "_shift"]
    beside = Window.partitionBy(*along).orderBy("_start")
    found = found.withColumn("_new", F.coalesce(F.lag(F.col("_start") + F.col("_size")).over(beside) != F.col("_start"), F.lit(True)))
    spans = found.withColumn("_span", F.count_if("_new").over(beside)).groupBy(*along, "_span")
    spans = spans.agg(F.min("_start").cast("long").alias("start"), (F.sum("_size") + window - 1).alias("n_words"))
    return spans.select(F.col("_key").alias(key), "start", "n_words", F.col("_from").alias("source_key"), (F.col("start") + F.col("_shift")).alias("source_start"))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_removed and kept, the words that no repeated window covers, joined by
    blanks. A window is repeated if its words also start earlier (smaller key, or the same text, earlier); all are
    judged on the input.

    Words are what ASCII white space separates. Null and empty texts have no words and an empty kept text; null keys come
    first; of texts with the same key the order is that of their hashes; equal rows count as one text, and each gets the
    same result; an empty table gives no rows; other columns are not read.
    """
    seed = _checked(window, seed)
    small_batches(docs.sparkSession)
    rows = _rows(docs, key, text)
    found = repeats(rows.filter("_text is not null"), window, seed)
    spans = found.groupBy("_key", "_of").agg(F.collect_set(F.struct("_start", "_size")).alias("_spans"))  # fewer than the text has words
    spans = stored(spans, "spans")
    known = id_filter(spans.select("_of"))
    kind = docs.schema[key].dataType.simpleString()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, gone, out = [], [], []
            for coded, spans in zip(b.column("_text").to_pylist(), b.column("_spans").to_pylist(), strict=True):
                words = (coded or "").encode().split()
                n = len(words)
                if spans:
                    change = np.zeros(n + 1, np.int64)
                    for s in spans:
                        change[s["_start"]] += 1
                        change[s["_start"] + s["_size"] + window - 1] -= 1
                    words = [w for w, covered in zip(words, np.cumsum(change).tolist(), strict=False) if not covered]
                total.append(n), gone.append(n - len(words)), out.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())], [key, "n_words", "n_removed", "kept"])

    meets = F.col("r._key").eqNullSafe(F.col("s._key")) & (F.col("r._of") == F.col("s._of"))
    held = rows.filter("_text is not null")
    some = maybe_in(held, "_of", known).alias("r").join(spans.alias("s"), meets, "left").select("r._key", "r._text", "s._spans")
    none = maybe_in(held, "_of", known, inside=False).unionByName(rows.filter("_text is null")).select("_key", "_text", F.lit(None).cast(some.schema["_spans"].dataType).alias("_spans"))
    return some.unionByName(none).mapInArrow(keep, f"`{key}` {kind}, n_words long, n_removed long, kept string")
