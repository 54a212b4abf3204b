"""Exact top-k inner products with vector-approximation files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelgrid.llm.blocks import each_row
from reelgrid.llm.shared import pin

#: Rows of a block of vectors and of a block of queries; a task holds one of each.
BLOCK, ASKED = 8192, 1024
#: Queries of a block that are searched at once.
TILE = 256
#: Cells of each dimension; a cell's number is one byte.
CELLS = 16
#: The share of pairs above which the exact vectors of a block are read all together.
DENSE = 1 / 16

_INDEX = "part int, block long, dims int, ids binary, vectors binary, cells binary, edges binary"
_ASKED = "asked long, a_dims int, a_ids binary, a_vectors binary"


def _matrix(batch: pa.RecordBatch, scale: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """The ids and whole-number vectors of the rows whose components are all there and finite."""
    ids, rows = [], []
    column = batch.column("vector")
    for i, vector in zip(batch.column("id").to_pylist(), column):
        if i is None or not vector.is_valid:
            continue
        values = vector.values
        if values.null_count:
            continue
        x = np.floor(scale * values.to_numpy(zero_copy_only=False).astype(np.float64))
        if np.isfinite(x).all():
            ids.append(i)
            rows.append(x)
    return np.array(ids, np.int64), rows


def _blocks(batches: Iterator[pa.RecordBatch], scale: float, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of up to ``size`` rows of equal length; a shorter vector stands in a block of its own length."""
    held: dict[int, tuple[list, list]] = {}
    for batch in batches:
        ids, rows = _matrix(batch, scale)
        for i, x in zip(ids, rows):
            own = held.setdefault(len(x), ([], []))
            own[0].append(i)
            own[1].append(x)
            if len(own[0]) == size:
                yield len(x), np.array(own[0], np.int64), np.array(own[1])
                del held[len(x)]
    for dims, (ids, rows) in held.items():
        yield dims, np.array(ids, np.int64), np.array(rows).reshape(len(ids), dims)


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold them all; those beyond 32 bits stay as they are."""
    most = np.abs(x).max(initial=0)
    return x.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64).tobytes()


def _wide(data: bytes, rows: int, dims: int) -> np.ndarray:
    kind = {2: np.int16, 4: np.int32}.get(len(data) // max(rows * dims, 1), np.float64)
    return np.frombuffer(data, kind).reshape(rows, dims).astype(np.float64)


def _index(scale: float):
    from pyspark import TaskContext

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, (dims, ids, x) in enumerate(_blocks(batches, scale, BLOCK)):
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            low = x.min(0) if len(x) else np.zeros(dims)
            wide = np.maximum(x.max(0) - low + 1, 1) / CELLS
            cells = np.minimum((x - low) // wide, CELLS - 1).astype(np.uint8)
            # what a cell can hold is read off its members, so its bounds hold whatever the rounding
            edges = np.zeros((2, CELLS, dims))
            for c in range(CELLS):
                inside = cells == c
                edges[0, c] = np.where(inside, x, np.inf).min(0)
                edges[1, c] = np.where(inside, x, -np.inf).max(0)
            edges[~np.isfinite(edges)] = 0
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()), "block": [(part << 32) + number], "dims": pa.array([dims], pa.int32()),
                    "ids": [ids.tobytes()], "vectors": [_narrow(x)], "cells": [cells.tobytes()],
                    "edges": [edges.tobytes()],
                }
            )

    return build


def _ask(scale: float):
    from pyspark import TaskContext

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for part, (dims, ids, x) in enumerate(_blocks(batches, scale, ASKED)):
            yield pa.RecordBatch.from_pydict(
                {
                    "asked": [block + part], "a_dims": pa.array([dims], pa.int32()),
                    "a_ids": [ids.tobytes()], "a_vectors": [_narrow(x)],
                }
            )

    return build


class _Block:
    """A block as the queries of a group read it: exact vectors, and the edges of the cells that they lie in."""

    def __init__(self, row: dict, many: int):
        self.number, self.many, dims = row["block"], many, row["dims"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        both = min(dims, many)
        cells = np.frombuffer(row["cells"], np.uint8).reshape(len(self.ids), dims)[:, :both]
        edges = np.frombuffer(row["edges"]).reshape(2, CELLS, dims)[:, :, :both]
        self.most = np.abs(edges).max(initial=0)
        self.exact = _wide(row["vectors"], len(self.ids), dims)[:, :both]
        at = np.arange(both)
        self.edges = np.hstack([edges[1][cells, at], edges[0][cells, at]])

    def kept_as(self, kind: type) -> None:
        self.exact, self.edges = self.exact.astype(kind, copy=False), self.edges.astype(kind, copy=False)


def nearest(q: np.ndarray, own: np.ndarray, k: int, block: _Block, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which query has which row of the block among its k best, with the score; ``best`` has the k best scores of each
    query so far, ascending, and is brought up to date.

    Exact vectors are read from the highest bounds down: the first few where a query has no k scores yet, then those
    whose bounds reach the kth score. Only scores that reach it are returned.
    """
    ids = block.ids
    left, right = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
    # the greatest product a cell allows: its upper edge where the query is positive, else its lower one
    bounds = np.hstack([np.maximum(q, 0), np.minimum(q, 0)]) @ block.edges.T
    for n in np.flatnonzero(right > left):
        bounds[n, left[n] : right[n]] = -np.inf
    least = best[:, 0].copy()
    bare = np.flatnonzero(least == -np.inf)
    if len(bare) and len(ids) >= 4 * k:
        first = np.argpartition(bounds[bare], -4 * k, axis=1)[:, -4 * k :]
        scores = np.einsum("nd,nfd->nf", q[bare], block.exact[first]).astype(np.float64)
        scores[ids[first] == own[bare, None]] = -np.inf
        least[bare] = np.partition(scores, -k, axis=1)[:, -k]
    reach = bounds >= least[:, None]
    if np.count_nonzero(reach) > DENSE * reach.size:
        products = q @ block.exact.T
        at, row = np.divmod(np.flatnonzero(products >= least[:, None]), len(ids))
        score = products[at, row].astype(np.float64)
    else:
        at, row = np.divmod(np.flatnonzero(reach), len(ids))
        score = np.einsum("nd,nd->n", q[at], block.exact[row]).astype(np.float64)
    keep = (score >= least[at]) & (ids[row] != own[at])
    at, row, score = at[keep], row[keep], score[keep]
    order = np.lexsort((row, -score, at))  # rows ascend by id
    at, row, score = at[order], row[order], score[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at, "left")
    keep = rank < k
    at, row, score, rank = at[keep], row[keep], score[keep], rank[keep]
    found = np.full(best.shape, -np.inf)
    found[at, rank] = score
    best[:] = np.sort(np.concatenate([best, found], 1), 1)[:, -k:]
    return at, ids[row], score.astype(np.int64)


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: _Block | None = None
        reached: dict[int, np.ndarray] = {}
        for row in each_row(batches):
            many, asked = row["a_dims"], np.frombuffer(row["a_ids"], np.int64)
            if block is None or (block.number, block.many) != (row["block"], many):
                block = _Block(row, many)
            q = _wide(row["a_vectors"], len(asked), many)[:, : block.exact.shape[1]]
            # whole numbers below 2**24 are exact in single precision
            single = np.abs(q).sum(1).max(initial=1) * block.most < 2**24
            block.kept_as(np.float32 if single else np.float64)
            q = q.astype(block.exact.dtype, copy=False)
            best = reached.setdefault(row["asked"], np.full((len(asked), k), -np.inf))
            for start in range(0, len(asked), TILE):
                of = slice(start, start + TILE)
                at, ids, score = nearest(q[of], asked[of], k, block, best[of])
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (asked[of][at], ids, score)], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, asked: DataFrame, k: int = 5, id: str = "vec_id", vector: str = "vector", scale: float = 256.0) -> DataFrame:
    """For every query vector the k rows with the greatest inner product of floor(scale * x), exactly.

    A vector-approximation file is built in blocks: each dimension of a block is cut into cells, and a vector is kept
    as its cells' numbers beside the exact values. A query scans the cells for upper bounds on its products, then
    reads the exact vectors with the highest bounds, and those whose bounds reach the kth score known by then. Blocks
    of vectors make up parts, a task each, and every part meets a copy of all queries; what a query reaches in a block
    must be reached in the next. The results of all blocks are merged by a ranked window with a limit in each task.

    Returns query_id, rank (from 1), vec_id, score. Ties go to the smaller id. A query's own id is no candidate. Null
    ids and vectors that are null or hold null, NaN or infinite components take no part; an empty vector scores 0;
    vectors of unequal length are compared over their common components; of rows that repeat an id each counts, as
    candidate and as query, but ranks stay 1 to k for each id. Components must stay below about 2**26 / scale for
    products to be exact. Empty tables give an empty result.
    """
    plain = lambda df: df.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    rows, questions = plain(vectors), plain(asked)
    many, wanted = rows.count(), questions.count()
    # each part meets a copy of all queries, so there are no more parts than make the copies as large as the table
    parts = max(many // max(wanted, 1), rows.sparkSession.sparkContext.defaultParallelism)
    parts = max(1, min(parts, -(-many // BLOCK)))
    index = pin(rows.repartition(parts).mapInArrow(_index(scale), _INDEX)).repartitionById(parts, "part")
    questions = questions.repartition(max(1, -(-wanted // ASKED))).mapInArrow(_ask(scale), _ASKED)
    copies = questions.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartitionById(parts, "part")
    # Spark takes the copies for as few as the queries; to broadcast them would put them all through the driver
    pairs = index.hint("merge").join(copies.hint("merge"), "part")
    found = pairs.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int"), "vec_id", "score"
    )
