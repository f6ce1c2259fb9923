"""Exact top-k inner products by dual-tree search over cover trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortforge.llm.tables import written

_LOW = np.iinfo(np.int64).min
_HIGH = np.iinfo(np.int64).max


class CoverTree:
    """Points in nested groups; each node has a centre point and its covering radius.

    The children of a node are led by points at more than half its radius from each
    other, at most ``arity`` of them, and every point belongs to its nearest leader. The
    radius of a node is measured, so bounds hold whatever the number of leaders.
    """

    def __init__(self, points: np.ndarray, leaf: int = 64, arity: int = 16):
        self.points, self.leaf, self.arity = points, leaf, arity
        self.centre: list[np.ndarray] = []
        self.norm: list[float] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.rows: list[np.ndarray] = []
        self.root = self._node(np.arange(len(points)), 0)

    def _node(self, rows: np.ndarray, depth: int) -> int:
        centre = self.points[rows[0]]
        away = np.sqrt(((self.points[rows] - centre) ** 2).sum(axis=1))
        number = len(self.centre)
        self.centre.append(centre)
        self.norm.append(float(np.sqrt((centre**2).sum())))
        self.radius.append(float(away.max()))
        self.children.append([])
        self.rows.append(rows)
        if len(rows) > self.leaf:
            self.children[number] = [self._node(part, depth + 1) for part in self._parts(rows, away, depth)]
        return number

    def _parts(self, rows: np.ndarray, away: np.ndarray, depth: int) -> list[np.ndarray]:
        if depth >= 12 or away.max() == 0:
            return [rows[at : at + self.leaf] for at in range(0, len(rows), self.leaf)]
        nearest, owner, target = away.copy(), np.zeros(len(rows), int), away.max() / 2
        for leader in range(1, self.arity):
            far = int(nearest.argmax())
            if nearest[far] <= target:
                break
            from_far = np.sqrt(((self.points[rows] - self.points[rows[far]]) ** 2).sum(axis=1))
            owner[from_far < nearest] = leader
            nearest = np.minimum(nearest, from_far)
        parts = []
        for leader in range(owner.max() + 1):
            mine = np.flatnonzero(owner == leader)
            if len(mine):
                parts.append(rows[mine[np.argsort(nearest[mine], kind="stable")]])
        return parts


class Search:
    """Best ``k`` candidates of every query; ties go to the smaller id."""

    def __init__(self, k: int, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray):
        self.k, self.ids, self.floor = k, query_ids, floor
        self.queries = queries
        self.tree = CoverTree(queries.astype(np.float64))
        self.score = np.full((len(queries), k), _LOW, np.int64)
        self.best = np.full((len(queries), k), _HIGH, np.int64)
        self.compared = 0

    def visit(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Take in a block of candidates."""
        tree = CoverTree(vectors.astype(np.float64), leaf=256)
        large = max(1, int(np.abs(vectors).max(initial=0))) * max(1, int(np.abs(self.queries).max(initial=0)))
        exact = large * max(1, vectors.shape[1]) < 1 << 53
        kind = np.float64 if exact else np.int64
        mine, theirs = self.queries.astype(kind), vectors.astype(kind)
        stack = [(0, 0)]
        while stack:
            q, c = stack.pop()
            worst = np.maximum(self.score[self.tree.rows[q], -1], self.floor[self.tree.rows[q]]).min()
            if self._bound(tree, q, c) < worst:
                continue
            if self.tree.children[q] and (not tree.children[c] or self.tree.radius[q] >= tree.radius[c]):
                below = [(child, c) for child in self.tree.children[q]]
            elif tree.children[c]:
                below = [(q, child) for child in tree.children[c]]
            else:
                self._compare(self.tree.rows[q], tree.rows[c], ids, mine, theirs)
                continue
            stack += sorted(below, key=lambda pair: self._bound(tree, *pair))

    def _bound(self, tree: CoverTree, q: int, c: int) -> float:
        """No pair below the two nodes scores more; rounding errors are allowed for."""
        a, b = self.tree.centre[q], tree.centre[c]
        rq, rc = self.tree.radius[q], tree.radius[c]
        top = float(a @ b) + self.tree.norm[q] * rc + tree.norm[c] * rq + rq * rc
        return top + 1e-9 * (abs(top) + self.tree.norm[q] * tree.norm[c]) + 1e-3

    def _compare(self, q: np.ndarray, c: np.ndarray, ids: np.ndarray, mine: np.ndarray, theirs: np.ndarray) -> None:
        found = (mine[q] @ theirs[c].T).astype(np.int64)
        self.compared += found.size
        # Only what reaches a query's kth score so far, or its floor, can enter its best.
        enters = found >= np.maximum(self.score[q, -1], self.floor[q])[:, None]
        some, any_ = np.flatnonzero(enters.any(axis=1)), np.flatnonzero(enters.any(axis=0))
        if not len(some):
            return
        q, c, found = q[some], c[any_], found[np.ix_(some, any_)]
        candidates = np.broadcast_to(ids[c], found.shape)
        own = candidates == self.ids[q][:, None]
        score = np.concatenate([self.score[q], np.where(own, _LOW, found)], axis=1)
        names = np.concatenate([self.best[q], np.where(own, _HIGH, candidates)], axis=1)
        order = np.lexsort((names, -np.maximum(score, -_HIGH)), axis=-1)[:, : self.k]
        self.score[q] = np.take_along_axis(score, order, axis=1)
        self.best[q] = np.take_along_axis(names, order, axis=1)


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    return vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    )


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _assigner(pivot_ids: np.ndarray, pivots: np.ndarray, k: int):
    """Nearest pivot of each vector, and the kth score among the pivots: a floor of the kth best of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, ids = _matrix(batch.column(1)), batch.column(0).to_numpy()
            product = vectors.astype(float) @ pivots.T.astype(float)
            cell = ((pivots.astype(float) ** 2).sum(axis=1) - 2 * product).argmin(axis=1)
            product[ids[:, None] == pivot_ids[None, :]] = -np.inf
            floor = np.full(len(ids), _LOW)
            if len(pivots) >= k:
                kth = -np.sort(-product, axis=1)[:, k - 1]
                safe = np.isfinite(kth) & (np.abs(kth) < 1 << 52)
                floor = np.where(safe, np.floor(np.where(safe, kth, 0)), _LOW).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cell, pa.int32()), pa.array(floor, pa.int64())],
                names=["vec_id", "vector", "cell", "floor"],
            )

    return run


def _blocks(counts: dict[int, int], most: int) -> tuple[Column, Column]:
    """First block and number of blocks of each cell; small neighbouring cells share one."""
    first, parts, number, filled = F.lit(0), F.lit(1), 0, 0
    for cell in sorted(counts):
        need = math.ceil(counts[cell] / most)
        if filled and filled + counts[cell] > most:
            number, filled = number + 1, 0
        first = F.when(F.col("cell") == cell, number).otherwise(first)
        parts = F.when(F.col("cell") == cell, need).otherwise(parts)
        if need > 1:
            number, filled = number + need, 0
        else:
            filled += counts[cell]
    return first, parts


def _with_blocks(df: DataFrame, name: str, most: int) -> DataFrame:
    counts = {r[0]: r[1] for r in df.groupBy("cell").count().collect()}
    first, parts = _blocks(counts, most)
    return df.withColumn(name, (first + F.pmod(F.xxhash64("vec_id", F.lit("block")), parts)).cast("int"))


def _ball(name: str):
    """Centre, radius and worst floor of a block."""

    def run(table: pa.Table) -> pa.Table:
        points = _matrix(table["vector"]).astype(float)
        centre = points.mean(axis=0)
        return pa.table(
            {
                name: table[name][:1],
                "centre": pa.array([centre.tolist()], pa.list_(pa.float64())),
                "radius": pa.array([float(np.sqrt(((points - centre) ** 2).sum(axis=1)).max())]),
                "floor": pa.array([int(table["floor"].to_numpy().min())], pa.int64()),
            }
        )

    return run


def _searcher(k: int):
    def run(key: tuple, candidates: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not len(candidates) or not len(queries):
            return schema.empty_table()
        floor = queries["q_floor"].to_numpy()
        search = Search(k, queries["q_vec_id"].to_numpy(), _matrix(queries["q_vector"]), floor)
        search.visit(candidates["vec_id"].to_numpy(), _matrix(candidates["vector"]))
        found = search.best != _HIGH
        ids = np.broadcast_to(search.ids[:, None], found.shape)
        return pa.table([ids[found], search.best[found], search.score[found]], schema=schema)

    return run


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_column: str = "vec_id",
    vector_column: str = "vector",
    pivots: int = 64,
    block_rows: int = 4096,
    chunk_rows: int = 2048,
) -> DataFrame:
    """The ``k`` highest inner products of every query with all other vectors.

    ``vectors`` has integer vectors of one length; rows satisfying ``is_query`` (on the id
    column) are queries, every row is a candidate except the query's own. Returns
    ``query_id, rank`` (from 1)``, vec_id, score``; ties go to the smaller id.

    ``pivots`` vectors, chosen by a hash of their id, divide the space into cells; cells are cut
    or joined into blocks of about ``block_rows`` rows, so identical or close vectors fill as
    many blocks as they need. Blocks whose ball cannot reach a query chunk's worst kth score among the pivots
    are left out; each other (block, chunk) pair is one dual-tree search of bounded size,
    and only ``k`` rows a query leave it.

    Null ids, and vectors that are null or hold nulls, take no part; a repeated id counts
    once, with its greatest vector; with fewer candidates than ``k``, all are returned; an
    empty table gives an empty result. Components and scores must fit 64 bits. Vectors of several lengths are
    an error.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_column].cast("long").alias("vec_id"), vectors[vector_column].alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull()))
    rows = written(rows.groupBy("vec_id").agg(F.max("vector").alias("vector")), "vectors")
    lengths = rows.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
    out = "query_id long, rank int, vec_id long, score long"
    if lengths[0] is None:
        return spark.createDataFrame([], out)
    if lengths[0] != lengths[1]:
        raise ValueError("vectors of several lengths")
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit("pivot")), "vec_id").limit(pivots).toArrow()
    assign = _assigner(sample["vec_id"].to_numpy(), _matrix(sample["vector"]), k)
    schema = "vec_id long, vector array<bigint>, cell int, floor long"
    celled = written(rows.mapInArrow(assign, schema), "vector-cells")
    candidates = _with_blocks(celled, "block", block_rows)
    queries = _with_blocks(celled.where(is_query), "chunk", chunk_rows)
    ball = "centre array<double>, radius double, floor long"
    blocks = candidates.groupBy("block").applyInArrow(_ball("block"), f"block int, {ball}").drop("floor")
    chunks = queries.groupBy("chunk").applyInArrow(_ball("chunk"), f"chunk int, {ball}")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda a: F.sqrt(dot(a, a))
    b, c = blocks.alias("b"), chunks.alias("c")
    bound = (
        dot(F.col("b.centre"), F.col("c.centre"))
        + norm(F.col("c.centre")) * F.col("b.radius")
        + norm(F.col("b.centre")) * F.col("c.radius")
        + F.col("b.radius") * F.col("c.radius")
    )
    # One row for each block and chunk of bounded size: the query set against all rows, in blocks.
    same_length = F.size("b.centre") == F.size("c.centre")
    pairs = b.join(c, same_length & (bound * (1 + 1e-9) + 1 >= F.col("c.floor"))).select("block", "chunk")
    pairs = written(pairs, "vector-pairs")
    left = candidates.join(pairs, "block").select("block", "chunk", "vec_id", "vector")
    names = ("block", "chunk", "vec_id", "vector", "floor")
    right = queries.join(pairs, "chunk").select(*[F.col(c).alias(f"q_{c}") for c in names])
    found = left.groupBy("block", "chunk").cogroup(right.groupBy("q_block", "q_chunk"))
    found = found.applyInArrow(_searcher(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
