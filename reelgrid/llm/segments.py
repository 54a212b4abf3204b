"""Hard negatives by inner product, with bounds from the means and deviations of vector segments.

A vector is cut into segments. Of each its mean and deviation are kept, scaled by the root of its length, so that the
product of two segments is that of the means, give or take that of the deviations. Sums over all segments bound an
inner product; halving the segments tightens the bound, down to the vectors themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelgrid.llm.shared import pin

#: Rows of a block of vectors and of a block of anchors; a task holds one of each.
BLOCK, ASKED = 8192, 256
#: Segments of a vector, level by level, each twice or more those before; each level refines the bounds of the one before.
#: The last one is stored, the others follow from it.
LEVELS = (4, 8, 16, 32)
#: The share of pairs above which a level is computed for all pairs of two blocks.
DENSE = 1 / 16
#: Rows against which every anchor is scored first, so that all blocks start from scores that must be reached.
SEED = 4096

#: A block of rows (``kind`` 0), then the blocks of anchors that meet it (``kind`` 1).
_BLOCK = "block long, kind int, asked long, dims int, ids binary, labels binary, rows binary, vectors binary, summaries binary, wanted binary"
#: What rounding may take from a bound, as a share of the vectors' lengths; summaries are stored in single precision.
_SLACK = 1e-6


def cuts(dims: int, segments: int) -> np.ndarray:
    """Where the segments of a vector begin and end; the ends of few segments are ends of more of them too."""
    segments = max(1, min(segments, dims))
    return np.arange(segments + 1) * dims // segments


def summary(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean and deviation of each segment of the rows of ``x``, both times the root of the segment's length."""
    ends = cuts(x.shape[1], segments)
    means, spreads = np.zeros((len(x), len(ends) - 1)), np.zeros((len(x), len(ends) - 1))
    for s, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        if b > a:
            part = x[:, a:b]
            mean = part.mean(1)
            means[:, s] = mean * np.sqrt(b - a)
            spreads[:, s] = np.sqrt(((part - mean[:, None]) ** 2).sum(1))
    return means, spreads


def coarser(fine: tuple[np.ndarray, np.ndarray], dims: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The summary of fewer segments from that of the finest ones; deviations are never too small."""
    inner, outer = cuts(dims, LEVELS[-1]), cuts(dims, segments)
    if not dims or len(inner) == len(outer):
        return fine
    first = np.searchsorted(inner, outer[:-1])
    means = np.add.reduceat(fine[0] * np.sqrt(np.diff(inner)), first, axis=1) / np.sqrt(np.diff(outer))
    squares = np.add.reduceat(fine[0] ** 2 + fine[1] ** 2, first, axis=1)
    # what is stored is rounded, and the difference of two near squares would show it
    return means, np.sqrt(np.maximum(squares - means**2, 0) + _SLACK * squares)


def bounds(q: tuple[np.ndarray, np.ndarray], x: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of all rows of ``q`` with all rows of ``x``, from their summaries."""
    middle, width = q[0] @ x[0].T, q[1] @ x[1].T
    width += _slack(q, x)[:, None]
    return middle - width, middle + width


def _slack(q, x) -> np.ndarray:
    """What rounding may take from a bound; it grows with the vectors' lengths."""
    size = lambda s: np.sqrt((s[0] ** 2).sum(1) + (s[1] ** 2).sum(1))
    most = size(x).max(initial=0)
    return _SLACK * (1 + size(q) * most)


def surviving(q: list, x: list, exact: Callable, possible: Callable, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of anchors and rows that may matter, with their scores, as three arrays.

    ``q`` and ``x`` are summaries, coarse to fine; ``possible(anchors, lower, upper)`` says which bounds may still matter
    (``anchors`` are their rows of ``q``); ``apart`` are the pairs to look at.
    """
    stays, dense, a, n = apart, True, None, None
    for level in range(len(q)):
        if dense:
            # while many pairs stay, all products of a level cost less than picking the pairs
            lower, upper = bounds(q[level], x[level])
            stays = stays & possible(np.arange(len(stays))[:, None], lower, upper)
            dense = np.count_nonzero(stays) > DENSE * stays.size
            if not dense:
                a, n = np.nonzero(stays)
            continue
        middle = np.einsum("ij,ij->i", q[level][0][a], x[level][0][n])
        width = np.einsum("ij,ij->i", q[level][1][a], x[level][1][n]) + _slack(q[level], x[level])[a]
        near = possible(a, middle - width, middle + width)
        a, n = a[near], n[near]
    if dense:
        a, n = np.nonzero(stays)
    return a, n, exact(a, n, dense)


def best_per(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the ``k`` first of their group: higher scores, then smaller ids."""
    order = np.lexsort((ids, -score, group))
    sorted_group = group[order]
    first = np.flatnonzero(np.append(True, sorted_group[1:] != sorted_group[:-1])) if len(order) else np.empty(0, int)
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[place < k]


def _rows(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[tuple[int, int, int, np.ndarray, list]]:
    """The rows that take part: row, id, label, whole-number vector and windows asked for."""
    for batch in batches:
        vectors = batch.column("vector")
        wanted = batch.column("wanted").to_pylist() if "wanted" in batch.schema.names else [None] * batch.num_rows
        for r, (row, i, label) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("row", "id", "label")))):
            if i is None or label is None or not vectors[r].is_valid or vectors[r].values.null_count:
                continue
            x = np.floor(scale * vectors[r].values.to_numpy(zero_copy_only=False).astype(np.float64))
            if np.isfinite(x).all():
                yield row, i, label, x, wanted[r]


def _packed(size: int, scale: float, kind: int, at_most: int, tasks: int):
    """Blocks of up to ``size`` rows of equal length, numbered over ``tasks`` tasks."""
    from pyspark import TaskContext

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def block(dims: int) -> pa.RecordBatch:
            nonlocal made
            rows, ids, labels, vectors, wanted = zip(*held.pop(dims))
            x = np.array(vectors).reshape(len(rows), dims)
            number, made = part + made * tasks, made + 1
            whole = lambda v: np.array(v, np.int64).tobytes()
            asked = np.full((len(rows), at_most), np.nan)
            for n, scores in enumerate(wanted):
                if scores:
                    asked[n, : len(scores)] = scores
            fine = np.concatenate(summary(x, LEVELS[-1]), axis=1).astype(np.float32)
            whole_numbers = x.astype(np.int32) if np.abs(x).max(initial=0) < 2**31 else x
            made_of = {
                "block": pa.array([number], pa.int64()), "kind": pa.array([kind], pa.int32()), "asked": pa.array([number], pa.int64()),
                "dims": pa.array([dims], pa.int32()), "ids": [whole(ids)], "labels": [whole(labels)], "rows": [whole(rows)],
                "vectors": [whole_numbers.tobytes()], "summaries": [fine.tobytes()], "wanted": [asked.tobytes()],
            }
            return pa.RecordBatch.from_pydict(made_of)

        for found in _rows(batches, scale):
            own = held.setdefault(len(found[3]), [])
            own.append(found)
            if len(own) == size:
                yield block(len(found[3]))
        for dims in list(held):
            yield block(dims)

    return pack


class _Block:
    def __init__(self, row: dict, at_most: int):
        whole = lambda c: np.frombuffer(row[c], np.int64)
        self.ids, self.labels, self.rows, self.dims = whole("ids"), whole("labels"), whole("rows"), row["dims"]
        n = len(self.ids)
        kind = np.int32 if len(row["vectors"]) == 4 * n * self.dims else np.float64
        self.x = np.frombuffer(row["vectors"], kind).reshape(n, self.dims).astype(np.float64)
        self.wanted = np.frombuffer(row["wanted"]).reshape(n, at_most)
        both = np.frombuffer(row["summaries"], np.float32).reshape(n, -1).astype(np.float64)
        fine = both[:, : both.shape[1] // 2], both[:, both.shape[1] // 2 :]
        self.levels = [coarser(fine, self.dims, s) for s in LEVELS]

    def scored(self, other: _Block, apart: np.ndarray, possible: Callable):
        """Pairs of rows of this block with rows of another one that may matter, with their exact scores."""
        if self.dims == other.dims:

            def exact(a, n, dense):
                found = (self.x @ other.x.T)[a, n] if dense else np.einsum("ij,ij->i", self.x[a], other.x[n])
                return found.astype(np.int64)

            return surviving(self.levels, other.levels, exact, possible, apart)
        # vectors of unequal length share no segments; their common components are multiplied
        both = min(self.dims, other.dims)
        scores = self.x[:, :both] @ other.x[:, :both].T
        a, n = np.nonzero(apart & possible(np.arange(len(scores))[:, None], scores, scores))
        return a, n, scores[a, n].astype(np.int64)


def _positives(anchors: _Block, block: _Block, k: int, reach: np.ndarray):
    """The ``k`` first rows of an anchor's label in a block, of those that reach ``reach``."""
    apart = (anchors.labels[:, None] == block.labels) & (anchors.ids[:, None] != block.ids)
    a, n, s = anchors.scored(block, apart, lambda a, lower, upper: upper >= reach[a, 0])
    kept = best_per(a, s, block.ids[n], k)
    return a[kept], np.zeros(len(kept), np.int64), block.ids[n[kept]], s[kept]


def _negatives(anchors: _Block, block: _Block, k: int, low: float, high: float, reach: np.ndarray):
    """The ``k`` first rows of another label whose score lies between shares of each wanted score, if it reaches ``reach``."""
    least, most = low * anchors.wanted, high * anchors.wanted
    apart = anchors.labels[:, None] != block.labels

    def possible(a, lower, upper):
        found = np.zeros(lower.shape, bool)
        for slot in range(least.shape[1]):
            # comparisons with a missing (NaN) wanted score are false
            found |= (100 * upper >= least[a, slot]) & (upper >= reach[a, slot]) & (100 * lower <= most[a, slot])
        return found

    a, n, s = anchors.scored(block, apart, possible)
    out = []
    for slot in range(least.shape[1]):
        inside = np.flatnonzero((100 * s >= least[a, slot]) & (100 * s <= most[a, slot]))
        kept = inside[best_per(a[inside], s[inside], block.ids[n[inside]], k)]
        out.append((a[kept], np.full(len(kept), slot), block.ids[n[kept]], s[kept]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _reached(found, anchors: _Block, k: int, slots: int) -> np.ndarray:
    """The ``k``-th score of each anchor and slot; nothing need be reached where fewer were found."""
    reach = np.full((len(anchors.ids), slots), -np.inf)
    a, slot, _, s = found
    if len(a):
        group = a * slots + slot
        many = np.bincount(group, minlength=reach.size)
        least = np.full(reach.size, np.inf)
        np.minimum.at(least, group, s.astype(np.float64))
        reach = np.where(many >= k, least, -np.inf).reshape(reach.shape)
    return reach


def _meet(search: Callable, slots: int, k: int, at_most: int, seed: bytes | None):
    """Let the blocks of anchors pass a block of rows; rows of a block come first and are read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = {d: _Block(r, at_most) for d, r in _unpacked(seed).items()}
        block, number = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    block, number = _Block(row, at_most), row["block"]
                    continue
                if block is None or number != row["block"]:
                    continue  # no block has this number
                anchors = _Block(row, at_most)
                reach = np.full((len(anchors.ids), slots), -np.inf)
                if anchors.dims in first:
                    reach = _reached(search(anchors, first[anchors.dims], k, reach), anchors, k, slots)
                a, slot, ids, scores = search(anchors, block, k, reach)
                yield pa.RecordBatch.from_pydict(
                    {"row": anchors.rows[a], "anchor_id": anchors.ids[a], "slot": slot, "vec_id": ids, "score": scores}
                )

    return run


def _unpacked(seed: bytes | None) -> dict[int, dict]:
    if not seed:
        return {}
    with pa.ipc.open_stream(seed) as stream:
        return {r["dims"]: r for r in stream.read_all().to_pylist()}


def _joined(blocks: DataFrame, last: int, anchors: DataFrame) -> DataFrame:
    """Every block followed by all blocks of anchors."""
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long")))
    both = blocks.unionByName(anchors.withColumn("block", numbers))
    return both.repartitionById(last + 1, F.col("block").cast("int")).sortWithinPartitions("block", "kind", "asked")


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    id: str = "vec_id",
    label: str = "label",
    vector: str = "vector",
    scale: float = 256.0,
) -> DataFrame:
    """For every anchor and each of its positives, the hardest negatives: high scores, but not too near the positive's.

    Scores are inner products of floor(scale * x); higher ones come first, ties by smaller id. An anchor's positives are
    its first ``positives`` other rows of its label; the negatives of a positive are its first ``negatives`` rows of
    another label that score ``low`` to ``high`` percent of the positive. Rows and anchors meet in blocks: bounds from
    segment summaries are refined level by level for the pairs that may still matter, then the vectors themselves are
    multiplied. Every anchor is first scored against the same few rows; scores found there must be reached elsewhere.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. Rows with a null id,
    label or vector or a null, NaN or infinite component take no part; empty vectors score 0; vectors of unequal length
    are compared over their common components. Of rows that repeat an id each counts and is an anchor by itself, but
    none is its own positive. Components must stay below about 2**26 / scale for exact products. Empty tables and
    anchors without positives or without fitting negatives give no rows.
    """
    plain = vectors.select(
        F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector"), anchors.alias("anchor"),
    )
    rows = pin(plain.filter("id is not null and label is not null and vector is not null").withColumn("row", F.monotonically_increasing_id()))
    narrow = ["row", "id", "label", "vector"]
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"

    def packed(df: DataFrame, size: int, kind: int) -> DataFrame:
        # a tenth is left free, so that a task seldom has more than one block
        tasks = max(1, -(-df.count() * 10 // (9 * size)))
        return pin(df.repartition(tasks, "row").mapInArrow(_packed(size, scale, kind, positives, tasks), _BLOCK))

    blocks = packed(rows.select(*narrow), BLOCK, 0)
    last = blocks.agg(F.max("block")).first()[0]
    if last is None:
        return vectors.sparkSession.createDataFrame([], empty)
    asked = pin(rows.filter("anchor").select(*narrow))
    few = rows.select(*narrow).orderBy(F.xxhash64("row"), "row").limit(SEED).coalesce(1)
    seed = _bytes(few.mapInArrow(_packed(SEED, scale, 0, positives, 1), _BLOCK).toArrow())

    def met(anchor_rows: DataFrame, search: Callable, slots: int, k: int) -> DataFrame:
        found = _joined(blocks, last, packed(anchor_rows, ASKED, 1)).mapInArrow(
            _meet(search, slots, k, positives, seed), "row long, anchor_id long, slot long, vec_id long, score long"
        )
        best = Window.partitionBy("row", "slot").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    def positive(a, b, k, reach):
        return _positives(a, b, k, reach)

    def negative(a, b, k, reach):
        return _negatives(a, b, k, low, high, reach)

    first = pin(met(asked, positive, 1, positives).select("row", (F.col("rank") - 1).cast("long").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    scores = first.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))).alias("p"))
    wanted = asked.join(scores.select("row", F.col("p.positive_score").cast("array<double>").alias("wanted")), "row")
    second = met(wanted, negative, positives, negatives)
    return second.join(first, ["row", "slot"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def _bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()
