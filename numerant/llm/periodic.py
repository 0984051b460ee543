"""Runs: stretches of a text's words that repeat with a period, three times or more, found by comparing the words with
themselves at every lag.

A run of period q and at least ``exponent * q`` words (and ``least``) is a stretch of places where the words, compared with
the same words shifted by q, are equal, ``need(q) = max(least - q, (exponent - 1) * q)`` of them in a row. All lags up to a
text's words over ``exponent`` are compared, and many texts at once. As such a stretch holds a whole ``gram`` of equal
places at one of every ``need(q) - gram + 1`` places, only these are compared first, each with a hash of its next ``gram``
words; where one is equal, the whole text is compared at this lag and its true stretches are measured. So nothing is
missed, and a text of n words costs n log n comparisons besides those at lags where something repeats.

Long texts are dealt out as ranges of lags: both the copies of the text that travel and the lags of a task grow with the
square root of its lags.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numerant.llm.common import NOT_SPACE, grouped, hashed_words, mixed, small_batches

LEAST, EXPONENT = 24, 3
#: Texts with at most so many lags are scanned where they lie.
LAGS = 4_096
#: Periods up to this one are looked for with every range of lags, so that their multiples need no scan.
SHORT = 64
RUNS = "array<struct<start bigint, length bigint, period bigint>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def need(q: int, least: int, exponent: int) -> int:
    """How many equal places in a row a run of period ``q`` has at least."""
    return max(least - q, (exponent - 1) * q, 1)


def gram_of(least: int, exponent: int) -> int:
    return max(1, min(need(q, least, exponent) for q in range(1, max(least, 1) + 1)) // 2)


def prime_factors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] * (n > 1)


def stretches(same: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """First place and length of every stretch of at least ``least`` true places."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    keep = ends - starts >= least
    yield from zip(starts[keep].tolist(), (ends - starts)[keep].tolist(), strict=True)


def runs_at(words: np.ndarray, q: int, least: int, exponent: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the runs of smallest period ``q`` of one text."""
    for start, n in stretches(words[:-q] == words[q:], need(q, least, exponent)):
        block = words[start : start + q]
        if not any(np.array_equal(block, words[start + q // p : start + q // p + q]) for p in prime_factors(q)):
            yield start, n + q, q


def find_runs(words: np.ndarray, bounds: np.ndarray, low: int = 1, high: int | None = None, least: int = LEAST, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """For each text (``words[bounds[t]:bounds[t + 1]]``) its runs with periods from ``low`` to ``high``, by start and period."""
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")  # of each lag, the texts that are long enough come first
    offsets = np.concatenate(([0], np.cumsum(sizes[order])))
    own = [words[bounds[t] : bounds[t + 1]] for t in order]
    gram = gram_of(least, exponent)
    # Words of different texts are made different.
    line = np.concatenate([w ^ mixed(np.uint64([k + 1]))[0] for k, w in enumerate(own)]) if own else np.zeros(0, np.uint64)
    hashes = np.zeros(max(0, len(line) - gram + 1), np.uint64)
    for k in range(gram):
        hashes = hashes * _ODD + line[k : k + len(hashes)]
    found: list[list] = [[] for _ in own]
    longest = int(sizes.max(initial=0))
    high = min(longest // exponent, high or longest)
    long_enough = np.sort(sizes)
    for q in chain(range(1, min(low, SHORT + 1)), range(low, high + 1)):
        many = len(sizes) - int(np.searchsorted(long_enough, max(least, exponent * q)))
        end = min(int(offsets[many]) - q, len(hashes) - q)
        if end <= 0:
            continue
        step = need(q, least, exponent) - gram + 1
        hits = np.flatnonzero(hashes[:end:step] == hashes[q : q + end : step]) * step
        if not len(hits):
            continue
        texts = np.searchsorted(offsets, hits, "right") - 1
        for t in np.unique(texts).tolist():
            at = hits[texts == t] - offsets[t]
            for start, length, period in found[t]:  # multiples of a period that is known make no run of their own there
                if q % period == 0:
                    at = at[(at < start) | (at + q + gram > start + length)]
            if len(at) and sizes[order[t]] > q:
                found[t] += runs_at(own[t], q, least, exponent)
    out: list[list] = [[] for _ in own]
    for t, runs in zip(order.tolist(), found, strict=True):
        out[t] = sorted((s, n, q) for s, n, q in runs if q >= low)
        out[t].sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by blanks, without those that some run holds after its first period."""
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = [w for w, n in zip(words, np.cumsum(change).tolist(), strict=False) if not n]
    return b" ".join(words)


def _coded(column: pa.Array) -> list[bytes]:
    return [(t or "").encode() for t in column.to_pylist()]


def _as_rows(runs: list[list[tuple[int, int, int]]]) -> pa.Array:
    return pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], _RUNS)


def _in_texts(texts: list[bytes], least: int, exponent: int) -> Iterator[list]:
    for part in grouped([len(t) for t in texts]):
        words, bounds, *_ = hashed_words(texts[part], NOT_SPACE)
        yield from find_runs(words, bounds, 1, None, least, exponent)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, exponent: int = EXPONENT, lags: int = LAGS) -> DataFrame:
    """One row per row of ``docs``: key, runs (start, length and period in words, by start and period) and collapsed, the
    text without the words that a run holds after its first period, joined by blanks.

    A run is a stretch of at least ``least`` and ``exponent`` (2 or more) times its smallest period of words, as long as
    it can be. Words are what ASCII white space separates. Null and empty texts have no runs and an empty collapsed
    text; null keys stay; repeated rows give repeated rows; an empty table gives none; other columns are not read.
    """
    if least < 1 or exponent < 2:
        raise ValueError("least must be 1 or more and exponent 2 or more")
    small_batches(docs.sparkSession)
    key_name, kind = f"`{key}`", docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key_name).alias("_key"), F.col(f"`{text}`").cast("string").alias("_text"))
    # No more words than half the bytes, so most texts are known to have few lags without being split.
    large = F.coalesce(F.octet_length("_text") > 2 * exponent * lags, F.lit(False))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _coded(b.column(1))
            runs = list(_in_texts(texts, least, exponent))
            short = [collapsed(t.split(), r).decode() for t, r in zip(texts, runs, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), _as_rows(runs), pa.array(short, pa.string())], [key, "runs", "collapsed"])

    schema = f"{key_name} {kind}, runs {RUNS}, collapsed string"
    small = rows.filter(~large).mapInArrow(scan, schema)

    # Equal texts are scanned once; a text's ranges of lags are dealt out.
    held = rows.filter(large).withColumn("_digest", F.sha2("_text", 256))
    most = F.floor(F.size(F.split("_text", r"[\x20\x09-\x0D]+")) / exponent) + 1
    texts = held.select("_digest", "_text").dropDuplicates(["_digest"]).withColumn("_most", most)
    texts = texts.withColumn("_ranges", F.ceil(F.sqrt(F.col("_most") / lags))).withColumn("_each", F.ceil(F.col("_most") / F.col("_ranges")))
    ranges = texts.withColumn("_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_ranges") - 1))).select("_digest", "_no", (F.col("_no") * F.col("_each") + 1).alias("_low"), ((F.col("_no") + 1) * F.col("_each")).alias("_high"), "_text")

    def scan_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for low, high, coded in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), _coded(b.column(4)), strict=True):
                words, bounds, *_ = hashed_words([coded], NOT_SPACE)
                out += find_runs(words, bounds, low, high, least, exponent)
            yield pa.RecordBatch.from_arrays([b.column(0), _as_rows(out)], ["_digest", "_runs"])

    parts = ranges.repartition(F.col("_digest"), F.col("_no")).mapInArrow(scan_range, f"_digest string, _runs {RUNS}")
    whole = parts.groupBy("_digest").agg(F.flatten(F.collect_list("_runs")).alias("_runs"))  # fewer runs than the text has words
    by_place = F.array_sort("_runs", lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int")).otherwise(F.signum(a["period"] - b["period"]).cast("int")))
    joined = held.join(whole, "_digest").select("_key", "_text", by_place.alias("_runs"))

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = [[(r["start"], r["length"], r["period"]) for r in rs] for rs in b.column(2).to_pylist()]
            short = [collapsed(t.split(), r).decode() for t, r in zip(_coded(b.column(1)), runs, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(short, pa.string())], [key, "runs", "collapsed"])

    return small.union(joined.mapInArrow(collapse, schema))
