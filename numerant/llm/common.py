"""Helpers shared by the operators of this subpackage: shared storage, word hashing, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents handed to Python at once. Long texts make the usual 10,000 too many for an executor.
DOCS_PER_BATCH = 256
BATCH_BYTES = 16 << 20

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = DOCS_PER_BATCH, size: int = BATCH_BYTES) -> None:
    """Arrow batches of at most ``rows`` rows and ``size`` bytes (or one longer row), so that long texts fit a worker.

    The session keeps these settings, as queries that were made with them run later; lower ones stay as they are.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        now = int(spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", most)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session that names none, as in tests, gets a local folder as its checkpoint folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="numerant-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: lineage ends here and nothing runs twice."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes the files of a table made by ``stored`` once nothing will read it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def fold(doc_id, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null ids are in no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


class Memo(dict):
    """A bounded memo of ``make(key)``: two generations, of which the older one is dropped when the newer is full."""

    def __init__(self, make, size: int = 200_000):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_starts(lengths: np.ndarray) -> np.ndarray:
    """Where each of the consecutive runs of these lengths begins."""
    out = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=out[1:])
    return out


_ODD = 0x9E3779B97F4A7C15
_BYTE_HASH = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_powers = {1: np.ones(1, np.uint64), -1: np.ones(1, np.uint64)}


def powers(n: int, sign: int = 1) -> np.ndarray:
    """The first ``n`` powers, modulo 2**64, of an odd number (or of its inverse)."""
    if len(_powers[sign]) < n:
        steps = np.full(max(n, 1 << 20), _ODD if sign > 0 else pow(_ODD, -1, 1 << 64), np.uint64)
        steps[0] = 1
        _powers[sign] = np.cumprod(steps, dtype=np.uint64)
    return _powers[sign]


def run_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes ``codes[start:end]``, the same on every machine and wherever the run stands."""
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_BYTE_HASH[codes] * powers(len(codes))[: len(codes)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * powers(len(codes) + 1, -1)[starts] + (ends - starts).astype(np.uint64))


#: What a word is made of, by byte of UTF-8: letters, digits and all that is not ASCII; or all but ASCII white space.
WORD_BYTES = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
NOT_SPACE = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])


def hashed_words(texts: list[bytes], kept: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts in UTF-8: their hashes, where each text's words begin (one more entry than texts), and each
    word's first and last byte (end exclusive) in its own text."""
    codes = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.zeros(len(codes) + 1, np.int8)
    inside[1:] = kept[codes]
    edges = np.flatnonzero(inside[1:] != inside[:-1])  # every text ends with a separator, so edges come in pairs
    starts, ends = edges[::2], edges[1::2]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1, out=offsets[1:])
    bounds = np.searchsorted(starts, offsets)
    shift = np.repeat(offsets[:-1], np.diff(bounds))
    return run_hashes(codes, starts, ends), bounds, starts - shift, ends - shift


def grouped(sizes: list[int], most: int = 500_000) -> Iterator[slice]:
    """Consecutive slices of at most ``most`` in all, or of one larger entry."""
    low = total = 0
    for k, size in enumerate(sizes):
        if total and total + size > most:
            yield slice(low, k)
            low, total = k, 0
        total += size
    if sizes:
        yield slice(low, len(sizes))


#: A filter of ids is made of so many at most, in 8 MB; beyond that rows are joined without it.
MOST_IDS = 4_000_000


def _place(key: str, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.col(key).cast("long")), 64 - bits) + 1


def id_filter(ids: DataFrame) -> tuple[int, DataFrame] | None:
    """A bitmap over hashes of the integers in the first column of ``ids``, with 16 to 32 bits for each: never wrong about
    an id that is there. It spares a shuffle most of the rows that it would drop. None for more than ``MOST_IDS``.
    """
    n = ids.count()
    if n > MOST_IDS:
        return None
    bits = max(15, (16 * n).bit_length())
    place = _place(ids.columns[0], bits)
    marks = ids.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    return bits, stored(marks, "marks")


def columns(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever their names are made of."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def maybe_in(df: DataFrame, key: str, known: tuple[int, DataFrame] | None, inside: bool = True) -> DataFrame:
    """The rows of ``df`` whose ``key`` (not null) may be in the set that ``id_filter`` made ``known``; or the others.

    The bitmap is a small table by its own bound, so it is broadcast. Without one, every row may be in the set.
    """
    if known is None:
        return df if inside else df.filter(F.lit(False))
    place = _place(key, known[0])
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_marks.bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1, F.lit(False))
    joined = df.alias("_rows").join(F.broadcast(known[1].alias("_marks")), F.bitmap_bucket_number(place) == F.col("_marks.bucket"), "left")
    return joined.filter(hit if inside else ~hit).select("_rows.*")
