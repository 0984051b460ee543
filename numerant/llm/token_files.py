"""Token-id output: length-delimited binary records with masked checksums, and an index of offsets for shuffled reads.

A record file holds, for each document: the payload's length (unsigned 64-bit), the masked CRC-32 of those eight bytes
(unsigned 32-bit), the payload, and the masked CRC-32 of the payload; all little-endian. The payload is the document's
key (64-bit, the smallest value for null) and its ids, two bytes each if the vocabulary allows it, else four. The index
file beside it holds for each record its offset and its number of ids (unsigned 64-bit both), so that a reader can go to
any record. The mask turns a checksum by 15 bits and adds a constant, so that checksums of checksums stay useful.

Each task writes its own files under a name of its attempt and then renames them, so a task that runs again after a
lost executor replaces the same content.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from numerant.llm.common import small_batches
from numerant.llm.tokens import encoder

HEAD, TAIL, ENTRY = "<QI", "<I", "<QQ"
NO_KEY = -(1 << 63)


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack(TAIL, masked_crc(length)), payload, struct.pack(TAIL, masked_crc(payload))))


def read_record(source, offset: int | None = None) -> bytes | None:
    """The payload at ``offset`` (or where the file stands); None at the end. A wrong checksum raises ValueError."""
    if offset is not None:
        source.seek(offset)
    head = source.read(struct.calcsize(HEAD))
    if not head:
        return None
    if len(head) < struct.calcsize(HEAD):
        raise ValueError("the file ends within a record")
    length, crc = struct.unpack(HEAD, head)
    if masked_crc(head[:8]) != crc:
        raise ValueError("a length doesn't fit its checksum")
    body = source.read(length + 4)
    if len(body) < length + 4 or masked_crc(body[:-4]) != struct.unpack(TAIL, body[-4:])[0]:
        raise ValueError("a payload doesn't fit its checksum")
    return body[:-4]


@dataclass(frozen=True)
class TokenFiles:
    """What ``write_tokens`` wrote: the folder, the bytes per id, and per file (in order) its name, records and ids."""

    folder: str
    width: int
    files: list[tuple[str, int, int]]

    @property
    def firsts(self) -> list[int]:
        """How many ids stand in the files before each file."""
        out, total = [], 0
        for _, _, ids in self.files:
            out.append(total)
            total += ids
        return out


def store_uri(uri: str) -> str:
    """A URI as Spark writes it, as Arrow writes it."""
    kind, there, rest = uri.partition("://")
    if not there:
        return uri if uri.startswith("/") else f"file:{uri}"
    if kind in ("s3a", "s3n"):
        return f"s3://{rest}"
    if kind == "abfss" and "@" in rest:  # container@account.host/path
        account = rest.partition("@")[2].partition(".")[0]
        return f"{uri}?account_name={account}"
    return uri


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it. Python tasks reach it by themselves, so they need credentials of their
    own where the store asks for some."""
    return pafs.FileSystem.from_uri(store_uri(uri))


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text") -> TokenFiles:
    """Encodes every whole text, appends ``end_id`` and writes record files to ``folder`` (a URI all machines share).

    Ascending keys: file by file, and within each file. Null keys come first, null texts are empty, repeated keys each
    get a record (ordered by a hash of the text), an empty table gives no files; other columns are not read. Rows with the same
    key, and equal rows, are dealt out over files too. What comes to the driver is one row per file; files that failed
    attempts have left are deleted at the end.
    """
    small_batches(docs.sparkSession)
    width = 2 if max(encoder(vocabulary).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, records, count, at = f"part-{task.partitionId():06d}", 0, 0, 0
        fs, root = filesystem(folder)
        own = f"{root}/_{name}-{task.taskAttemptId()}"
        data = index = None
        end = np.array([end_id], f"<u{width}").tobytes()
        for b in batches:
            for k, ids in zip(b.column(0).to_pylist(), encoder(vocabulary).ids(b.column(1).to_pylist()), strict=True):
                if data is None:
                    fs.create_dir(root, recursive=True)
                    data, index = fs.open_output_stream(f"{own}.rec"), fs.open_output_stream(f"{own}.idx")
                n = len(ids) // 4 + 1
                short = ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
                record = framed(struct.pack("<q", NO_KEY if k is None else k) + short + end)
                data.write(record)
                index.write(struct.pack(ENTRY, at, n))
                at, records, count = at + len(record), records + 1, count + n
        if data is not None:
            data.close(), index.close()
            for kind in ("rec", "idx"):
                fs.move(f"{own}.{kind}", f"{root}/{name}.{kind}")
            yield pa.RecordBatch.from_pydict({"name": [name], "records": [records], "ids": [count]})

    rows = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).cast("string").alias("_text"))
    rows = rows.withColumns({"_hash": F.xxhash64("_text"), "_row": F.monotonically_increasing_id()})
    order = [F.col("_key").asc_nulls_first(), "_hash", "_row"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("_key", "_text")
    done = ordered.mapInArrow(write, "name string, records long, ids long")
    files = sorted((r.name, r.records, r.ids) for r in done.collect())
    fs, root = filesystem(folder)
    for left in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if left.base_name.startswith("_part-"):
            fs.delete_file(left.path)
    return TokenFiles(folder, width, files)


def read_tokens(spark: SparkSession, files: TokenFiles, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per record: key, start (ids of all records before it), n_tokens, ids_crc32 (of the ids as unsigned
    32-bit little-endian integers), file, offset, and the ids themselves if asked for. Every checksum is verified."""
    folder, width = files.folder, files.width
    schema = f"`{key}` long, start long, n_tokens long, ids_crc32 long, file string, offset long" + ", ids array<int>" * with_ids

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for b in batches:
            for name, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}.idx") as f:
                    index = np.frombuffer(f.read(), "<u8").reshape(-1, 2)
                rows, start = [], first
                with fs.open_input_stream(f"{root}/{name}.rec") as f:
                    for offset, n in index.tolist():
                        payload = read_record(f)
                        ids = np.frombuffer(payload, f"<u{width}", offset=8).astype("<u4")
                        k = struct.unpack_from("<q", payload)[0]
                        rows.append((None if k == NO_KEY else k, start, len(ids), zlib.crc32(ids.tobytes()), name, offset) + ((ids.astype(np.int32),) if with_ids else ()))
                        if len(ids) != n:
                            raise ValueError(f"{name}: the index and the record at {offset} differ")
                        start += n
                        if len(rows) == 1000:
                            yield arrow_rows(rows, with_ids)
                            rows = []
                if rows:
                    yield arrow_rows(rows, with_ids)

    def arrow_rows(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
        names = [key, "start", "n_tokens", "ids_crc32", "file", "offset"] + ["ids"] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    listed = [(n, first) for (n, _, _), first in zip(files.files, files.firsts, strict=True)]
    table = spark.createDataFrame(listed, "name string, first long")
    return table.repartition(max(1, len(listed))).mapInArrow(load, schema)


def read_one(files: TokenFiles, name: str, number: int) -> tuple[int | None, np.ndarray]:
    """Key and ids of one record, found by the index alone: what a shuffled reader does."""
    fs, root = filesystem(files.folder)
    with fs.open_input_file(f"{root}/{name}.idx") as f:
        offset, n = struct.unpack(ENTRY, f.read_at(16, number * 16))
    with fs.open_input_file(f"{root}/{name}.rec") as f:
        payload = read_record(f, offset)
    key = struct.unpack_from("<q", payload)[0]
    return (None if key == NO_KEY else key), np.frombuffer(payload, f"<u{files.width}", n, 8)
