"""Similar documents by word shingles: an exact Jaccard join with PartEnum signatures.

Two sets of similarity at least p/q differ in few elements for their size. Sets are banded by size. For each band the
domain of elements is cut into partitions, and subsets of them are enumerated (pairs where few elements may differ, else
single ones), so many that some of them hold no difference. The content of a subset, hashed, is a signature.

There are more partitions than differences require, so a set may do without some of its subsets: at least ``sure`` of
two similar sets are equal, so in any order of signatures that is the same for all sets, each may leave out its first
``sure`` - 1, and the last of the equal ones remains in both. Empty subsets come first, which all sets would share and
which sign nothing, then the signatures that most sets have. So a passage that many documents hold makes no groups, and
of sets that share fewer than ``sure`` signatures with any others none are compared.

What is wanted are the groups that links form, so links are looked for only until they join the groups:

1. equal sets become one node, and so do the texts of one key;
2. in each group of nodes with a common signature, all are compared with one hub, the member with most company over all
   its signatures; the links found are joined to components;
3. nodes with a common signature that are still in different components are compared with each other: in groups of up
   to ``GROUP`` nodes by a join, in larger ones by blocks of sketches, of which only pairs that may be similar come out.
   In a group of more than ``LARGE`` nodes, as a passage that very many documents hold can make, similar sets must also
   share a signature in another partition of the domain: it is divided by these first. Nothing else can be linked, so
   components are then exact.

Before any text is fetched, a pair must pass the size bound and a sketch of 256 parities, which differ in no more
places than the sets do, and before texts are joined to pairs, one of 2,048; pairs of the last step pass that one, too,
before they come out. Signatures are grouped with partial sums,
hubs are joined by sort-merge joins that adaptive execution splits, and no group is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from numerant.llm.common import NOT_SPACE, grouped, hashed_words, id_filter, maybe_in, mixed, removed, small_batches, stored
from numerant.llm.components import connected_components

WORDS = 3
PERCENT = 90
BAND = 1.35
SKETCH = 256
SALTS = 16
WIDE_SKETCH = 2048
#: Groups of up to GROUP nodes are compared by a join, larger ones in blocks of about BLOCK; groups of more than LARGE
#: nodes are divided first, in ROUNDS rounds at most. The results are the same for any numbers.
GROUP = 64
BLOCK = 2048
LARGE = 16_384
ROUNDS = 3
#: Sets of so many elements have a sketch of WIDE_SKETCH parities too, as 256 tell less of them.
WIDE_FROM = 256
NODE = ["doc", "n", "p0", "p1", "p2", "p3", "wide", "signed", "spare"]
BANDS = 128
_FACTORS = mixed(np.arange(1, 17, dtype=np.uint64))


@cache
def bands(most: int) -> tuple[int, ...]:
    """First sizes of the bands, up to the one that holds ``most``."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, int(out[-1] * BAND) + 1))
    return tuple(out)


def band_of(size: int) -> int:
    return int(np.searchsorted(np.array(bands(1 << 40)), size, "right")) - 1


@cache
def plan(k: int) -> tuple[int, int, int]:
    """For sets that differ in at most ``k`` elements: partitions, how many of them a subset has, and how many subsets of
    two such sets are equal at least."""
    if k <= 3:
        parts, kept = (k + 2, 2) if k else (1, 1)
    else:
        parts, kept = k + 1 + max(1, k // 4), 1
    return parts, kept, comb(parts - k, kept)


@cache
def subsets(parts: int, kept: int) -> np.ndarray:
    return np.array(list(combinations(range(parts), kept)), np.int64).reshape(-1, kept)


def signed_bands(elements: np.ndarray, percent: int, seed: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """For each band in which a set given as sorted distinct 64-bit hashes may meet another: the band, the hashed contents
    of its subsets, their sizes, and ``sure``. Other seeds cut the domain elsewhere."""
    n = len(elements)
    if seed:
        elements = np.sort(mixed(elements ^ _FACTORS[seed]))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed(elements ^ _FACTORS[15]), out=sums[1:])
    for band in range(band_of(-(-n * percent // 100)), band_of(n) + 1):  # where the smaller set of a pair may be
        k = (bands(1 << 40)[band + 1] - 1) * (100 - percent) // percent
        parts, kept, sure = plan(k)
        edges = np.arange(1, parts, dtype=np.uint64) * np.uint64(((1 << 64) - 1) // parts)
        cuts = np.concatenate([[0], np.searchsorted(elements, edges), [n]])
        content, sizes = sums[cuts[1:]] - sums[cuts[:-1]], np.diff(cuts)
        chosen = subsets(parts, kept)
        held = np.full(len(chosen), band, np.uint64) * _FACTORS[14] + np.arange(len(chosen), dtype=np.uint64) * _FACTORS[13]
        for slot in range(kept):
            held += mixed(content[chosen[:, slot]] + _FACTORS[slot])
        yield band, mixed(held), sizes[chosen].sum(axis=1), sure


def signatures(elements: np.ndarray, percent: int, seed: int = 0) -> np.ndarray:
    """Signatures of a set, of which two similar sets share one in their band: those no smaller than the ``sure``-th
    smallest one."""
    return np.concatenate([held[size >= np.partition(size, sure - 1)[sure - 1]] for _, held, size, sure in signed_bands(elements, percent, seed)])


def spare_signatures(elements: np.ndarray, percent: int) -> tuple[np.ndarray, list[int]]:
    """All signatures of a set that have elements, with their band in the lowest bits; and the first band, and for each
    band how many signatures the set may do without. Where all ``sure`` may be empty, the empty ones sign too."""
    out, spare = [], []
    for band, held, size, sure in signed_bands(elements, percent):
        empty = int((size == 0).sum())
        spare += [sure - 1 - empty if empty < sure else sure - 1] if spare else [band, sure - 1 - empty if empty < sure else sure - 1]
        out.append((held if empty >= sure else held[size > 0]) & ~np.uint64(BANDS - 1) | np.uint64(band))
    return np.concatenate(out), spare


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes; a text of fewer words is one shingle."""
    coded, out = [(t or "").encode("utf-8", "replace").lower() for t in texts], []
    for part in grouped([len(c) for c in coded]):
        hashes, bounds, *_ = hashed_words(coded[part], NOT_SPACE)
        n = len(hashes) - words + 1
        rolled = np.zeros(max(n, 0), np.uint64)
        for k in range(words):
            rolled += hashes[k : k + len(rolled)] * _FACTORS[k]
        rolled = mixed(rolled)
        for low, high in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
            if high - low >= words:
                out.append(np.unique(rolled[low : high - words + 1]))
            elif high > low:
                out.append(mixed((hashes[low:high] * _FACTORS[: high - low]).sum(dtype=np.uint64).reshape(1) + _FACTORS[12:13] * np.array([high - low], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0


def parities(elements: np.ndarray, size: int) -> np.ndarray:
    """Of ``size`` classes of elements, whether the set holds an odd number of each, as bits of 64-bit integers."""
    return np.packbits((np.bincount((elements & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).view(np.uint64)


def described(docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """doc, n, the set's 128-bit identity (h1, h2), its sketches (p0 to p3; wide), its signatures and which it may spare."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, signed, spared, wide = [], [], [], []
            for s in shingle_sets(b.column(1).to_pylist(), words):
                parity = parities(s, SKETCH).view("<i8")
                ident = [int(mixed(s ^ _FACTORS[k]).sum(dtype=np.uint64).view(np.int64)) for k in (10, 11)]
                rows.append((len(s), *ident, *parity.tolist()))
                found, spare = spare_signatures(s, percent) if len(s) else (np.zeros(0, np.uint64), [])
                signed.append(found.view(np.int64))
                spared.append(np.array(spare, np.int64))
                wide.append(parities(s, WIDE_SKETCH).view("<i8").tolist() if len(s) >= WIDE_FROM else None)
            cols = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(wide, pa.list_(pa.int64())), lists(signed), lists(spared)], ["doc", "n", "h1", "h2", "p0", "p1", "p2", "p3", "wide", "signed", "spare"])

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(describe, "doc long, n long, h1 long, h2 long, p0 long, p1 long, p2 long, p3 long, wide array<long>, signed array<long>, spare array<long>")


def lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def may_link(a: str, b: str, percent: int) -> Column:
    """What sizes and sketches say: False only if the sets under these prefixes cannot be similar."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    flips = sum((F.bit_count(F.col(f"{a}.p{k}").bitwiseXOR(F.col(f"{b}.p{k}"))) for k in range(4)), F.lit(0))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (flips * (100 + percent) <= (n + m) * (100 - percent))


def may_link_wide(a: str, b: str, percent: int) -> Column:
    """What the wide sketches say, if both have one."""
    flips = F.aggregate(F.zip_with(f"{a}.wide", f"{b}.wide", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, p: total + p)
    return F.coalesce(flips * (100 + percent) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (100 - percent), F.lit(True))


@dataclass(frozen=True)
class Texts:
    """The documents of a join: their texts by key, and whether a key has several rows."""

    docs: DataFrame
    key: str
    text: str
    words: int
    percent: int
    repeated: bool

    def of(self, ids: DataFrame) -> DataFrame:
        """doc and text of the keys in ``ids`` (column doc); equal rows are one. Only these texts are shuffled."""
        base = self.docs.select(F.col(self.key).cast("long").alias("doc"), F.col(self.text).cast("string").alias("text")).filter("doc is not null")
        found = maybe_in(base, "doc", id_filter(ids)).join(ids, "doc", "left_semi")
        return found.distinct() if self.repeated else found

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of documents that are similar. ``pairs`` is a stored table."""
        words, percent = self.words, self.percent

        def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = shingle_sets(b.column(1).to_pylist(), words)
                wide = [parities(s, WIDE_SKETCH).tobytes() for s in found]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in found], pa.int64()), pa.array(wide, pa.binary())], ["doc", "text", "n", "wide"])

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n, m = b.column(2).to_numpy(), b.column(4).to_numpy()
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(-1, WIDE_SKETCH // 64) for c in (3, 5))
                yield b.select([0, 1]).filter(pa.array(np.bitwise_count(x ^ y).sum(axis=1) * (100 + percent) <= (n + m) * (100 - percent)))

        texts = stored(self.of(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()).mapInArrow(sketch, "doc long, text string, n long, wide binary"), "texts")
        x, y = (texts.select(F.col("doc").alias(c), F.col("n").alias(f"n_{c}"), F.col("wide").alias(f"wide_{c}")) for c in "ab")
        close = pairs.join(x, "a").join(y, "b").select("a", "b", "n_a", "wide_a", "n_b", "wide_b").mapInArrow(near, "a long, b long").distinct()
        close = stored(close, "close")
        both = close.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b")

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hub, known = None, None
            for b in batches:
                left, right, x, y = (b.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))
                found = []
                for k, s in enumerate(shingle_sets(x, words)):
                    if y[k] != hub:  # hubs come many times in a row
                        hub, known = y[k], shingle_sets([y[k]], words)[0]
                    if similar(s, known, percent):
                        found.append(k)
                yield pa.RecordBatch.from_arrays([pa.array([left[k] for k in found], pa.int64()), pa.array([right[k] for k in found], pa.int64())], ["a", "b"])

        links = stored(both.mapInArrow(check, "a long, b long").distinct(), "links")
        removed(texts)
        removed(close)
        return links

    def divided(self, large: DataFrame, seed: int) -> DataFrame:
        """Groups (sig, doc) divided by the signatures of another partition of the domain."""
        words, percent = self.words, self.percent

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [signatures(s, percent, seed).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in shingle_sets(b.column(1).to_pylist(), words)]
                yield pa.RecordBatch.from_arrays([b.column(0), lists(found)], ["doc", "signed"])

        again = self.of(large.select("doc").distinct()).mapInArrow(sign, "doc long, signed array<long>")
        return large.join(again, "doc").select(F.explode("signed").alias("other"), "sig", "doc").select(F.xxhash64("sig", "other").alias("sig"), "doc").distinct()


def grouped_nodes(signed: DataFrame) -> DataFrame:
    """sig, doc and company (how many nodes have the signature), of signatures with company."""
    shared = stored(signed.groupBy("sig").agg(F.count(F.lit(1)).alias("company")).filter("company > 1"), "shared")
    return maybe_in(signed, "sig", id_filter(shared.select("sig"))).join(shared, "sig").select(*signed.columns, "company")


def without_spare(company: DataFrame) -> DataFrame:
    """sig, doc and company of the signatures that a node can't do without: in each band (doc, band) all but the ``spare``
    ones that most nodes have. Ties are broken by the signature, so the order is the same for all nodes."""
    band = F.col("sig").bitwiseAND(BANDS - 1)
    rows = company.withColumn("nth", F.row_number().over(Window.partitionBy("doc", band).orderBy(F.desc("company"), "sig")))
    return rows.withColumn("least", F.min("spare").over(Window.partitionBy("doc", band))).filter("nth > least").select("sig", "doc", "company")


def with_hubs(company: DataFrame) -> DataFrame:
    """``company`` with the hub of each signature: the node with most company over all its signatures, then the smallest.

    Of many copies of one text with changes of their own, that is the text that they were made from, if it is there.
    """
    marks = company.groupBy("doc").agg(F.sum("company").alias("mark"))
    best = company.join(marks, "doc").groupBy("sig").agg(F.max(F.struct("mark", (-F.col("doc")).alias("minus"))).alias("m"))
    return company.join(best.select("sig", (-F.col("m.minus")).alias("hub")), "sig")


def still_apart(groups: DataFrame, parts: DataFrame) -> DataFrame:
    """The groups that have nodes in different components (doc, part; a node that isn't there is alone), with part."""
    placed = groups.join(parts, "doc", "left").select("sig", "doc", "company", F.coalesce("part", "doc").alias("part"))
    apart = placed.groupBy("sig").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("sig")
    return placed.join(apart, "sig", "left_semi")


def joined_pairs(members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes of a group, in different components, that may link."""
    x, y = members.alias("x"), members.alias("y")
    found = x.join(y, F.expr("x.sig = y.sig and x.doc < y.doc and x.part <> y.part") & may_link("x", "y", percent) & may_link_wide("x", "y", percent))
    return found.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"))


def block_pairs(members: DataFrame, percent: int) -> DataFrame:
    """The same for large groups: their nodes are dealt into blocks, and blocks meet each other."""
    fields, longs = ["doc", "part", "n", "p0", "p1", "p2", "p3"], WIDE_SKETCH // 64

    def block(table: pa.Table) -> pa.Table:
        """The nodes of a block, of which a salt bounds the number, as one row."""
        wide = table["wide"].combine_chunks().flatten().to_numpy().reshape(len(table), -1).T
        data = np.concatenate([np.stack([table[c].to_numpy() for c in fields]), wide]).astype("<i8")
        return pa.table({"sig": table["sig"].slice(0, 1), "block": table["block"].slice(0, 1), "data": pa.array([data.tobytes()], pa.binary())})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one, other in zip(*(b.column(c).to_pylist() for c in range(2)), strict=True):
                x, y = (np.frombuffer(d, "<i8").reshape(len(fields) + longs, -1) for d in (one, other))
                for low in range(0, x.shape[1], 256):
                    u = x[:, low : low + 256, None]
                    v = y[:, None, :]
                    fits = (u[1] != v[1]) & ((u[0] < v[0]) if one == other else (u[0] != v[0]))
                    fits &= np.minimum(u[2], v[2]) * 100 >= np.maximum(u[2], v[2]) * percent
                    flips = sum(np.bitwise_count(u[k] ^ v[k]).astype(np.int64) for k in range(3, 7))
                    at, to = np.nonzero(fits & (flips * (100 + percent) <= (u[2] + v[2]) * (100 - percent)))
                    keep = []
                    for first in range(0, len(at), 1 << 15):
                        u, v = x[:, low + at[first : first + (1 << 15)]], y[:, to[first : first + (1 << 15)]]
                        flips = np.bitwise_count(u[-longs:] ^ v[-longs:]).sum(axis=0, dtype=np.int64)
                        keep.append((np.minimum(u[2], v[2]) < WIDE_FROM) | (flips * (100 + percent) <= (u[2] + v[2]) * (100 - percent)))
                    keep = np.concatenate(keep) if keep else np.zeros(0, bool)
                    left, right = x[0, low + at[keep]], y[0, to[keep]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right))], ["a", "b"])

    dealt = members.withColumn("block", F.pmod(F.xxhash64("doc"), F.ceil(F.col("company") / BLOCK)).cast("int"))
    wide = F.coalesce("wide", F.array_repeat(F.lit(0).cast("long"), longs)).alias("wide")
    blocks = dealt.select("sig", "block", *fields, wide).groupBy("sig", "block").applyInArrow(block, "sig long, block int, data binary")
    x, y = blocks.alias("x"), blocks.alias("y")
    met = x.join(y, F.expr("x.sig = y.sig and x.block <= y.block")).select(F.col("x.data").alias("one"), F.col("y.data").alias("other"))
    return met.mapInArrow(compare, "a long, b long")


def near_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text", group: int = GROUP, large: int = LARGE) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id.

    A document's set is its distinct shingles of ``words`` words (lower-cased A-Z, cut at ASCII white space); with fewer
    words, the whole sequence. Documents link when 100 * intersection >= percent * union; component_id is the smallest
    key that links lead to, the document's own included. Null, empty and blank texts have no shingles and link with
    nothing. Rows with equal keys are one document with several texts, which are all in one component. Rows with a null
    key link with nothing and have a null component_id. An empty table gives no rows; other columns are not read.
    ``group`` and ``large`` only decide how much work it takes.
    """
    small_batches(docs.sparkSession)
    sets = stored(described(docs, key, text, words, percent), "sets")
    full = sets.filter("n > 0 and doc is not null")
    heads = full.groupBy("h1", "h2").agg(F.min("doc").alias("head"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    heads = stored(heads, "heads")

    # Equal sets are one node. Most sets have no copy and are nodes as they are, without a shuffle.
    known = id_filter(heads.select("h1"))
    copied = maybe_in(full, "h1", known).groupBy("h1", "h2").agg(F.min("doc").alias("doc"), *[F.first(c).alias(c) for c in NODE[1:]])
    copied = stored(copied.select(*NODE), "copied")
    nodes = maybe_in(full, "h1", known, inside=False).select(*NODE).union(copied)
    facts = nodes.drop("signed", "spare")

    # Of sets with copies, which may be very many, every share finds its head in one of SALTS places.
    salt = F.pmod(F.xxhash64("doc"), F.lit(SALTS))
    many = heads.select("h1", "h2", "head", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    headed = full.select("doc", "n", "h1", "h2", salt.alias("salt")).join(many, ["h1", "h2", "salt"], "left").select("doc", "n", F.coalesce("head", "doc").alias("head"))

    # Keys with several texts are in all their groups.
    keys = full.groupBy("doc").agg(F.count(F.lit(1)).alias("rows"), (F.min(F.struct("h1", "h2")) != F.max(F.struct("h1", "h2"))).alias("differ")).filter("rows > 1")
    keys = stored(keys, "keys")
    own = headed.join(keys.filter("differ").select("doc"), "doc", "left_semi").filter("doc <> head").select(F.col("doc").alias("a"), F.col("head").alias("b")).distinct()
    own = stored(own, "own")
    texts = Texts(docs, key, text, words, percent, repeated=not keys.isEmpty())

    # All nodes with a common signature meet its hub.
    signed = nodes.select(F.explode("signed").alias("sig"), "doc", "spare")
    spare = F.get("spare", (F.col("sig").bitwiseAND(BANDS - 1) - F.get("spare", F.lit(0)) + 1).cast("int"))
    company = stored(without_spare(grouped_nodes(signed.select("sig", "doc", spare.cast("int").alias("spare")))), "company")
    pairs = with_hubs(company).filter("doc <> hub").select(F.col("doc").alias("a"), F.col("hub").alias("b")).distinct()
    x, y = facts.drop("wide").alias("x"), facts.drop("wide").alias("y")
    near = pairs.join(x, F.col("a") == F.col("x.doc")).join(y, F.col("b") == F.col("y.doc")).filter(may_link("x", "y", percent)).select("a", "b")
    near = stored(near.distinct(), "pairs")
    links = texts.verified(near)
    parts = connected_components(links.union(own)).select(F.col("node").alias("doc"), F.col("component").alias("part"))
    parts = stored(parts, "joined")

    # Nodes with a common signature that are still apart.
    tables = [stored(still_apart(company, parts), "open")]
    for seed in range(1, ROUNDS + 1):
        hot = tables[-1].filter(F.col("company") > large).select("sig", "doc")
        if hot.isEmpty():
            break
        tables.append(stored(still_apart(grouped_nodes(texts.divided(hot, seed)), parts), "open"))
    cross = near.limit(0)
    for k, members in enumerate(tables):
        members = members.join(facts, "doc")
        some = (F.col("company") > group) & (F.col("company") <= large if k < ROUNDS else F.lit(True))
        cross = cross.union(joined_pairs(members.filter(F.col("company") <= group), percent)).union(block_pairs(members.filter(some), percent))
    tried = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cross = stored(cross.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    more = texts.verified(cross)
    component = stored(connected_components(links.union(own).union(more)), "components")
    for done in (company, near, *tables, cross, parts, links, more, own, keys, copied):
        removed(done)

    result = headed.join(component, F.col("head") == F.col("node"), "left")
    result = result.select("doc", "n", F.coalesce("component", "head").alias("component_id"))
    rest = sets.filter("n = 0 or doc is null").select("doc", "n", F.col("doc").alias("component_id"))
    return result.union(rest).select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), "component_id")
