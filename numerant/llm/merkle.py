"""A Merkle manifest of a table: one tree per group of rows, their roots under one root, and a proof for every row.

A leaf is the SHA-256 of a row's fields; nodes have eight children. Leaves get their places from range partitions and the
counts of those before them, so a group of any size is dealt out. ``BLOCK`` leaves of a group are one row of a table, which
a task reduces to one node; where more than ``TOP`` nodes are left, the nodes are dealt into blocks again. The small tree
above is built by the driver and broadcast (32 bytes a node); with the suffix of a block's path from it, tasks finish
the proofs of the block's rows and fold each row up to the root, from what the row holds now.

What comes to the driver is ``TOP`` nodes at most, or one per group where there are more groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from numerant.llm.common import small_batches, stored

WAYS = 8
BLOCK_LEVELS = 4  # 4,096 leaves in a block
TOP = 16_384
ROWS_PER_RANGE = 1_000_000
HEX = 64
BLOCKS_PER_BATCH = 16


def field(value: Column) -> Column:
    """``-`` for null, else the number of bytes in UTF-8, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(data: bytes) -> bytes:
    return sha256(data).hexdigest().encode()


def above(level: list[bytes]) -> list[bytes]:
    """The nodes over ``level``; the last run may be shorter, even a single node."""
    return [digest(b"".join(level[k : k + WAYS])) for k in range(0, len(level), WAYS)]


def height(n: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // WAYS), levels + 1
    return levels


def path(levels: list[list[bytes]], k: int) -> list[tuple[bytes, bytes]]:
    """What stands left and right of place ``k`` of the lowest level, and of the nodes above it; the top level has none."""
    out = []
    for level in levels:
        low = k - k % WAYS
        out.append((b"".join(level[low:k]), b"".join(level[k + 1 : low + WAYS])))
        k //= WAYS
    return out


def grown(level: list[bytes], levels: int) -> list[list[bytes]]:
    out = [level]
    for _ in range(levels):
        out.append(above(out[-1]))
    return out


class Top:
    """The tree above the blocks, as the driver builds it: every group's levels, and those over the groups' roots."""

    def __init__(self, nodes: list[tuple[str, int, bytes]]):
        groups: dict[str, list] = {}
        for group, place, node in nodes:
            groups.setdefault(group, []).append((place, node))
        self.names = sorted(groups, key=str.encode)
        self.levels = {}
        for name in self.names:
            level = [node for _, node in sorted(groups[name])]
            self.levels[name] = grown(level, height(len(level)))
        roots = [self.levels[name][-1][0] for name in self.names]
        self.upper = grown(roots, height(len(roots)))
        self.place = {name: k for k, name in enumerate(self.names)}
        self.root = self.upper[-1][0] if roots else b""

    def suffix(self, group: str, place: int) -> tuple[list[tuple[bytes, bytes]], bytes]:
        """The path from a block's node to the root, and the group's root."""
        levels = self.levels[group]
        return path(levels[:-1], place) + path(self.upper[:-1], self.place[group]), levels[-1][0]


def group_name(group: Column) -> Column:
    """Groups as texts that order as they do, nulls first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def numbered(leaves: DataFrame, key: str) -> DataFrame:
    """``leaves`` (stored) with _at, their place among their group's by key (nulls first), and _n, the group's leaves.

    Equal keys go by leaf and then by row. Range partitions split groups, keys and repeated rows alike.
    """
    order = ["_group", F.col(key).asc_nulls_first(), "_leaf", "_row"]
    spark = leaves.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-leaves.count() // ROWS_PER_RANGE))
    ranges = stored(leaves.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("_group", "_part").agg(F.count(F.lit(1)).alias("_here"))
    ahead = Window.partitionBy("_group").orderBy("_part")
    counts = counts.withColumn("_ahead", F.sum("_here").over(ahead) - F.col("_here")).withColumn("_n", F.sum("_here").over(Window.partitionBy("_group"))).drop("_here")
    within = Window.partitionBy("_group", "_part").orderBy(*order[1:])
    ranked = ranges.withColumn("_rank", F.row_number().over(within) - 1)
    return ranked.join(counts, ["_group", "_part"]).withColumn("_at", F.col("_ahead") + F.col("_rank")).drop("_part", "_rank", "_ahead", "_row")


def in_blocks(nodes: DataFrame, size: int, *carried: str) -> DataFrame:
    """One row per block of ``size`` consecutive nodes (_group, _at, _n, _leaf): _group, _n, _block and the columns as arrays."""
    each = F.struct("_at", "_leaf", *carried)
    rows = nodes.groupBy("_group", "_n", F.expr(f"_at div {size}").alias("_block")).agg(F.array_sort(F.collect_list(each), lambda a, b: F.when(a["_at"] < b["_at"], -1).otherwise(1)).alias("_each"))
    return rows.select("_group", "_n", "_block", *[F.col(f"_each.{c}").alias(c) for c in ("_leaf", *carried)])


def tops(blocks: DataFrame, levels: int) -> DataFrame:
    """The node that each block is reduced to: _group, _n (nodes of the group now), _at, _leaf."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [grown([x.hex().encode() for x in leaves], min(levels, height(n)))[-1][0] for n, leaves in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)]
            left = [-(-n // WAYS**levels) for n in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(left, pa.int64()), b.column(2), pa.array([bytes.fromhex(m.decode()) for m in made], pa.binary())], ["_group", "_n", "_at", "_leaf"])

    return blocks.select("_group", "_n", "_block", "_leaf").mapInArrow(reduce, "_group string, _n long, _at long, _leaf binary")


_SUFFIX = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_SUFFIX_SQL = "array<struct<left string, right string>>"


def _as_suffix(steps: list[tuple[bytes, bytes]]) -> list[dict]:
    return [{"left": a.decode(), "right": b.decode()} for a, b in steps]


def manifest(docs: DataFrame, fields: list[str], group: str, key: str = "doc_id", now: dict[str, Column] | None = None, with_proofs: bool = False, block_levels: int = BLOCK_LEVELS, top: int = TOP) -> DataFrame:
    """One row per row of ``docs``: key, leaf, subroot (of its group), root, proof_sha256, folded_root, verified, and with
    ``with_proofs`` the proof itself (siblings from the leaf up, left to right, as an array of hex digests).

    Leaves are made of ``fields``, in this order. ``now`` says what fields hold at the time of the check (by default what
    they hold): folded_root is made from these and the siblings of the manifest, and verified says that it is the root.

    Null fields count as such, null groups are a group of their own, the first; null keys come first in their group; equal
    keys stand by leaf; repeated rows are leaves each. An empty table gives no rows. A single row's leaf is the root, and
    its proof is empty. Columns besides key, group and fields are not read.
    """
    small_batches(docs.sparkSession, BLOCKS_PER_BATCH)
    leaf = lambda cols: F.sha2(F.concat(*[field(c) for c in cols]), 256)
    held = [F.col(f"`{c}`") for c in fields]
    now = now or {}
    present = [now.get(c, col) for c, col in zip(fields, held, strict=True)]
    same = F.lit(True)
    for c, col in zip(fields, held, strict=True):
        if c in now:
            same = same & now[c].eqNullSafe(col)
    leaves = docs.select(F.col(f"`{key}`").alias("_key"), group_name(F.col(f"`{group}`")).alias("_group"), F.unhex(leaf(held)).alias("_leaf"), F.when(~same, F.unhex(leaf(present))).alias("_now"))
    leaves = stored(leaves.withColumn("_row", F.monotonically_increasing_id()), "leaves")

    size = WAYS**block_levels
    rounds = [stored(in_blocks(numbered(leaves, "_key"), size, "_key", "_now"), "blocks")]
    while True:
        nodes = stored(tops(rounds[-1], block_levels), "nodes")
        total, most = nodes.agg(F.count(F.lit(1)), F.max("_n")).first()
        if total <= top or most == 1:
            break
        rounds.append(stored(in_blocks(nodes, size), "blocks"))
    summit = Top([(r._group, r._at, r._leaf.hex().encode()) for r in nodes.collect()])
    shared = docs.sparkSession.sparkContext.broadcast(summit)

    above_blocks = None  # for all rounds but the highest: _group, _block, _suffix, _subroot
    for blocks in reversed(rounds[1:]):
        above_blocks = _suffixes(blocks if above_blocks is None else blocks.join(above_blocks, ["_group", "_block"]), shared, block_levels)
    return _proofs(rounds[0] if above_blocks is None else rounds[0].join(above_blocks, ["_group", "_block"]), shared, block_levels, key, docs, with_proofs)


def _known(batch: pa.RecordBatch, shared) -> Iterator[tuple[list[tuple[bytes, bytes]], bytes]]:
    """The suffix and the subroot of each block of the batch: from the joined columns, else from the broadcast tree."""
    if "_suffix" in batch.schema.names:
        suffixes, roots = batch.column("_suffix").to_pylist(), batch.column("_subroot").to_pylist()
        yield from (([(s["left"].encode(), s["right"].encode()) for s in steps], root.encode()) for steps, root in zip(suffixes, roots, strict=True))
    else:
        yield from (shared.value.suffix(g, k) for g, k in zip(batch.column("_group").to_pylist(), batch.column("_block").to_pylist(), strict=True))


def _suffixes(blocks: DataFrame, shared, block_levels: int) -> DataFrame:
    """For every node in ``blocks`` (each the top of a block one round lower) its path to the root."""
    size = WAYS**block_levels

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column("_group").to_pylist(), b.column("_n").to_pylist(), b.column("_block").to_pylist(), b.column("_leaf").to_pylist(), _known(b, shared), strict=True)
            for group, n, block, leaves, (suffix, subroot) in rows:
                levels = grown([x.hex().encode() for x in leaves], min(block_levels, height(n)))
                steps = [_as_suffix(path(levels[:-1], k) + suffix) for k in range(len(leaves))]
                count = len(leaves)
                yield pa.RecordBatch.from_arrays([pa.array([group] * count), pa.array(range(block * size, block * size + count), pa.int64()), pa.array(steps, _SUFFIX), pa.array([subroot.decode()] * count)], ["_group", "_block", "_suffix", "_subroot"])

    return blocks.mapInArrow(walk, f"_group string, _block long, _suffix {_SUFFIX_SQL}, _subroot string")


def fold(node: bytes, steps: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a node and what stands left and right of its path lead to."""
    for left, right in steps:
        node = digest(left + node + right)
    return node


def _proofs(blocks: DataFrame, shared, block_levels: int, key: str, docs: DataFrame, with_proofs: bool) -> DataFrame:
    kind = docs.schema[key].dataType
    names = [key, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] + ["proof"] * with_proofs
    key_type = to_arrow_type(kind)

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("_key")
            known = _known(b, shared)
            for k, (n, leaves, present) in enumerate(zip(b.column("_n").to_pylist(), b.column("_leaf").to_pylist(), b.column("_now").to_pylist(), strict=True)):
                suffix, subroot = next(known)
                tree = grown([x.hex().encode() for x in leaves], min(block_levels, height(n)))
                proofs, folded, whole = [], [], []
                for place, (leaf, other) in enumerate(zip(tree[0], present, strict=True)):
                    steps = path(tree[:-1], place) + suffix
                    siblings = b"".join(s for step in steps for s in step)
                    proofs.append(sha256(siblings).hexdigest())
                    folded.append(fold(leaf if other is None else other.hex().encode(), steps).decode())
                    if with_proofs:
                        whole.append([siblings[i : i + HEX].decode() for i in range(0, len(siblings), HEX)])
                root, count = shared.value.root.decode(), len(leaves)
                own = [keys[k].values.cast(key_type), pa.array([x.decode() for x in tree[0]]), pa.array([subroot.decode()] * count), pa.array([root] * count), pa.array(proofs), pa.array(folded), pa.array([f == root for f in folded])]
                yield pa.RecordBatch.from_arrays(own + [pa.array(whole, pa.list_(pa.string()))] * with_proofs, names)

    schema = f"`{key}` {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", proof array<string>" * with_proofs
    return blocks.mapInArrow(prove, schema)
