"""Exact top-k search by inner product: a Voronoi kNN join.

The largest inner products are the nearest neighbours once every vector gets one more coordinate that makes all lengths
equal (0 for queries): ``|q - x|^2 = |q|^2 + M - 2 q.x``. In that space

1. a few pivots are drawn, and queries and data are grouped by their nearest pivot;
2. summaries per pivot (radii, and the smallest distances of distinct ids to it) bound, for each group of queries, how far its
   k-th neighbour can be;
3. data go, in blocks of a cell, only to groups of queries for which the triangle inequality and the bisecting plane
   leave them a chance;
4. each group is solved locally, block by block, with running bests, and blocks that cannot beat them are passed over.

Scores are integer inner products and exact; bounds are floating point with a margin and only ever keep too much. Cells
and groups of any size are dealt out by a salt, so a vector or cell that a third of all rows share spreads over tasks.
The driver sees the pivots, of which there are at most ``MOST_PIVOTS``, the summaries per pivot, and for every pair of
pivots whether data of one go to the queries of the other: a table of at most ``MOST_PIVOTS`` squared rows, 262,144,
whatever the number of vectors. It is broadcast; how many parts the queries of a group are in stands beside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from numerant.llm.common import stored

MOST_PIVOTS = 512
QUERIES_PER_BLOCK = 2048
ROWS_PER_BLOCK = 4096
BATCH_BYTES = 32 << 20
SLACK = 1e-6  # relative margin of the bounds
LARGEST = 2.0**53  # of components


def packed(rows: np.ndarray) -> bytes:
    """Whole numbers in the narrowest of three formats; the length tells which."""
    most = np.abs(rows).max(initial=0)
    return rows.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8").tobytes()


def unpacked(data: bytes, n: int, dim: int) -> np.ndarray:
    if not n or not dim:
        return np.zeros((n, dim))
    return np.frombuffer(data, {2: "<i2", 4: "<i4", 8: "<f8"}[len(data) // (n * dim)]).reshape(n, dim).astype(float)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly; those that 64 bits can't hold are the largest that they can."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1]) < 2.0**53:
        return (q @ x.T).astype(np.int64)
    most = (1 << 63) - 1
    exact = [[sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for v in x.tolist()] for u in q.tolist()]
    return np.array([[max(-most, min(most, s)) for s in row] for row in exact], np.int64).reshape(len(q), len(x))


def lifted(x: np.ndarray, most: float, query: bool) -> np.ndarray:
    """One more coordinate: 0 for queries, what is missing to the greatest squared length for data."""
    extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, most - (x * x).sum(axis=1)))
    return np.column_stack([x, extra])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T))


def smallest(far: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` smallest distances, in order, of distinct ids, and these ids."""
    order = np.argsort(far, kind="stable")
    far, ids = far[order], ids[order]
    first = np.sort(np.unique(ids, return_index=True)[1])[:n]
    return far[first], ids[first]


class Best:
    """The k best (score, id) of each query of a block so far; equal scores go to the smaller id."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k, n = ids, k, len(ids)
        self.least = np.full(n, np.iinfo(np.int64).min)  # the k-th score, once there are k
        self.query, self.score, self.vec = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the queries ``rows`` with the vectors ``ids``."""
        at, col = np.nonzero((scores >= self.least[rows][:, None]) & (ids[None, :] != self.ids[rows][:, None]))
        if not len(at):
            return
        query = np.concatenate([self.query, rows[at]])
        score = np.concatenate([self.score, scores[at, col]])
        vec = np.concatenate([self.vec, ids[col]])
        order = np.lexsort((vec, -score, query))
        query = query[order]
        starts = np.searchsorted(query, np.arange(len(self.ids)))
        keep = np.arange(len(query)) - starts[query] < self.k
        self.query, self.score, self.vec = query[keep], score[order][keep], vec[order][keep]
        ends = np.searchsorted(self.query, np.arange(len(self.ids)), "right")
        full = np.bincount(self.query, minlength=len(self.ids)) == self.k
        self.least[full] = self.score[ends[full] - 1]


def inner_product_top_k(vectors: DataFrame, is_query, k: int, scale: float = 64.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that ``is_query`` (a column over ``vectors``), the k other
    vectors with the largest inner product of components turned into ``floor(scale * x)``; ties to the smaller id.

    Rows without a key, and vectors that are null or hold null or non-finite components, take no part; shorter vectors
    count as padded with 0. Fewer than k others: all of them. An empty table gives no rows. Of a repeated key every row
    is a candidate, and none of them for queries of that key. Components beyond ``LARGEST`` count as that, and scores stay
    within 64 bits. Other columns are not read.
    """
    spark = vectors.sparkSession
    x = F.col("_x")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    base = vectors.select(F.col(key).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"), F.col(vector).cast("array<double>").alias("_x"))
    base = base.filter(F.col("id").isNotNull() & x.isNotNull() & sound)
    base = stored(base.select("id", "query", F.transform(x, lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(LARGEST)), F.lit(-LARGEST))).cast("double")).alias("x")), "vectors")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    square = F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c)
    n, n_queries, dim, most = base.agg(F.count(F.lit(1)), F.count_if("query"), F.max(F.size("x")), F.max(square)).first()
    if not n or not n_queries:
        return empty

    # 1. Pivots, and every row's nearest one.
    n_pivots = int(min(MOST_PIVOTS, max(8, n**0.5 / 4)))
    drawn = [r.x for r in base.orderBy(F.xxhash64("id"), "id").limit(n_pivots).select("x").collect()]
    pivots = lifted(np.array([r + [0.0] * (dim - len(r)) for r in drawn], float).reshape(len(drawn), dim), most, False)

    def padded(column: pa.Array) -> np.ndarray:
        rows = column.to_pylist()
        out = np.zeros((len(rows), dim))
        for i, r in enumerate(rows):
            out[i, : len(r)] = r
        return out

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, asked = padded(b.column(2)), b.column(1).to_numpy(zero_copy_only=False)
            for query in (False, True):
                at = np.flatnonzero(asked) if query else np.arange(len(rows))
                far = distances(lifted(rows[at], most, query), pivots)
                cell = far.argmin(axis=1) if len(at) else np.zeros(0, np.int64)
                data = [packed(rows[i : i + 1]) for i in at]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(np.full(len(at), query)), pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(at)), cell]), pa.array(data, pa.binary())], ["id", "query", "cell", "far", "x"])

    assigned = base.mapInArrow(assign, "id long, query boolean, cell int, far double, x binary")
    assigned = stored(assigned.withColumn("row", F.monotonically_increasing_id()), "assigned")  # repeated ids are dealt out by it

    # 2. Summaries per pivot, and from them the bound of each cell of queries.
    counts = {(r.query, r.cell): (r.n, r.far) for r in assigned.groupBy("query", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            cell, far, ids = (b.column(c).to_numpy() for c in range(3))
            for c in np.unique(cell).tolist():
                at = cell == c
                old = least.get(c, (np.zeros(0), np.zeros(0, np.int64)))
                least[c] = smallest(np.concatenate([old[0], far[at]]), np.concatenate([old[1], ids[at]]), k + 1)
        for c, (far, ids) in least.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(far), c, np.int32)), pa.array(far), pa.array(ids)], ["cell", "far", "id"])

    few = assigned.filter("not query").select("cell", "far", "id").mapInArrow(nearest, "cell int, far double, id long")
    few = few.groupBy("cell", "id").agg(F.min("far").alias("far"))
    few = few.groupBy("cell").agg(F.slice(F.sort_array(F.collect_list(F.struct("far", "id"))), 1, k + 1).alias("few"))
    near = {r.cell: (np.array([x.far for x in r.few]), np.array([x.id for x in r.few], np.int64)) for r in few.collect()}
    between = distances(pivots, pivots)
    slack = SLACK * (1 + float(between.max()))
    cells = sorted(c for asked, c in counts if asked)
    bound = {}
    near_ids = np.concatenate([ids for _, ids in near.values()])
    for i in cells:  # of k + 1 ids at most one is a query's own, however many rows it has
        reach, _ = smallest(np.concatenate([counts[True, i][1] + between[i, j] + far for j, (far, _) in near.items()]), near_ids, k + 1)
        bound[i] = reach[k] + slack if len(reach) > k else np.inf

    # 3. Groups of query cells that lie together, split by a salt where one is large; blocks of data for each.
    order, left = [], set(cells)
    while left:
        order.append(min(left, key=lambda c: (between[order[-1], c], c) if order else (0, c)))
        left.remove(order[-1])
    groups, size = [], QUERIES_PER_BLOCK
    for c in order:
        if size + counts[True, c][0] > QUERIES_PER_BLOCK:
            groups.append([])
            size = 0
        groups[-1].append(c)
        size += counts[True, c][0]
    of_cell = {c: g for g, members in enumerate(groups) for c in members}
    parts = [max(1, -(-sum(counts[True, c][0] for c in members) // QUERIES_PER_BLOCK)) for members in groups]
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // sum(parts))  # shares of the data, solved apart
    wanted = []  # (cell of data, group of queries, its parts, least and greatest distance of use)
    for j in near:
        for g, members in enumerate(groups):
            lows, highs = [], []
            for i in members:
                if between[i, j] / 2 - counts[True, i][1] <= bound[i] + slack or i == j:
                    lows.append(between[i, j] - counts[True, i][1] - bound[i] - slack)
                    highs.append(between[i, j] + counts[True, i][1] + bound[i] + slack)
            wanted += [(j, g, parts[g], float(min(lows)), float(max(highs)))] if lows else []
    targets = spark.createDataFrame(wanted, "cell int, grp int, parts int, low double, high double")

    rows_per_block = int(min(ROWS_PER_BLOCK, max(256, 2 * n / n_pivots)))
    salts = {(False, c): -(-m // rows_per_block) for (asked, c), (m, _) in counts.items() if not asked}
    salt_of = F.create_map(*[F.lit(v) for c, s in ((c, s) for (_, c), s in salts.items()) for v in (c, s)])
    group_of = F.create_map(*[F.lit(v) for c, g in of_cell.items() for v in (c, g)])
    part_of = F.create_map(*[F.lit(v) for g, p in enumerate(parts) for v in (g, p)])

    def block(table: pa.Table) -> pa.Table:
        """All rows of a group as one row; bounded, as salts bound the group."""
        ids = table["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        rows = np.concatenate([unpacked(v, 1, dim) for v in table["x"].to_pylist()]) if dim else np.zeros((len(ids), 0))
        far = table["far"].to_numpy()
        names = table.column_names[:2]
        return pa.table({names[0]: table[names[0]].slice(0, 1), names[1]: table[names[1]].slice(0, 1), "n": pa.array([len(ids)], pa.int32()), "least": [far.min()], "most": [far.max()], "ids": [ids[order].astype("<i8").tobytes()], "xs": [packed(rows[order])]})

    hashed = F.xxhash64("row")
    data = assigned.filter("not query").select("cell", F.pmod(hashed, salt_of[F.col("cell")].cast("long")).cast("int").alias("salt"), "id", "far", "x")
    data = data.groupBy("cell", "salt").applyInArrow(block, "cell int, salt int, n int, least double, most double, ids binary, xs binary")
    asked = assigned.filter("query").withColumn("grp", group_of[F.col("cell")])
    asked = asked.select("grp", F.pmod(hashed, part_of[F.col("grp")].cast("long")).cast("int").alias("part"), "id", "far", "x")
    asked = asked.groupBy("grp", "part").applyInArrow(block, "grp int, part int, n int, least double, most double, ids binary, xs binary")
    asked = asked.select("grp", "part", F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("xs").alias("q_xs"))
    asked = asked.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    sent = data.join(F.broadcast(targets), "cell").filter((F.col("most") >= F.col("low")) & (F.col("least") <= F.col("high")))
    sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("share", F.pmod(F.hash("cell", "salt"), F.lit(spread)))
    pairs = sent.join(asked, ["grp", "part", "share"]).select("grp", "part", "share", "cell", "n", "least", "most", "ids", "xs", "q_n", "q_ids", "q_xs")

    # 4. Local search.
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, q, length = None, None, None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(best.ids[best.query]), pa.array(best.vec), pa.array(best.score)], ["query_id", "vec_id", "score"])

        for b in batches:
            for r in b.to_pylist():
                if (mark := (r["grp"], r["part"], r["share"])) != now:
                    if best:
                        yield told()
                    now, best = mark, Best(np.frombuffer(r["q_ids"], "<i8"), k)
                    q = unpacked(r["q_xs"], r["q_n"], dim)
                    length = (q * q).sum(axis=1)
                    to_pivots = distances(lifted(q, most, True), pivots)
                far = to_pivots[:, r["cell"]]
                low = np.maximum(0, np.maximum(far - r["most"], r["least"] - far))
                limit = np.sqrt(np.maximum(0, length + most - 2.0 * best.least)) + slack  # of the k-th best so far
                limit[best.least <= -(1 << 63) + 1] = np.inf  # there are fewer than k, or scores that 64 bits can't hold
                rows = np.flatnonzero(low <= limit)
                ids = np.frombuffer(r["ids"], "<i8")
                x = unpacked(r["xs"], r["n"], dim)
                for at in range(0, len(rows), 512):
                    some = rows[at : at + 512]
                    best.add(some, products(q[some], x), ids)
        if best:
            yield told()

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)  # a pair of blocks is one row
    found = pairs.mapInArrow(solve, "query_id long, vec_id long, score long")
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
