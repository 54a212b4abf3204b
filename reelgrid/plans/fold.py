"""Sequential folds per key over chunks of the timeline.

Some states are neither sums nor extremes. Each task walks one contiguous chunk, batch by batch, and restarts the state
at every new key. Only the first key of a chunk may continue from the chunk before, so only a chunk filled by a single
key can pass on a state that depends on its own entry. What such a chunk does to whatever state it meets is therefore
summarised as a function, its *effect*: a table, an affine or clamped line, a few registers. The effects, one small row
per chunk, are applied one after the other, which gives the state each chunk starts from; then all chunks are walked.
So every row is walked twice, side by side with the others, however long a key keeps its state.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from reelgrid.plans.ordered import CHUNK, spread

BATCH_ROWS = 10_000
Rows = dict[str, list]
Step = Callable[[str | None, Rows], tuple[Rows, str]]


class Machine(NamedTuple):
    """A sequential rule, row by row and as effects.

    ``step(state, rows)`` gets some consecutive rows of one key as columns and the text state before them (None at a
    key's start); it returns the output columns for those rows and the state after them. ``extend(effect, rows)`` is
    the effect of the rows so far and some more; the effect of no rows is None. ``enter(effect, state)`` is the state
    after the effect's rows for any state before them. An effect must stay small whatever the number of rows; if it can't,
    ``enter`` may give None, and the chunk is walked from that state by a job of its own.
    """

    step: Step
    extend: Callable[[Any, Rows], Any]
    enter: Callable[[Any, str], str | None]


def fold_timeline(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    machine: Machine,
    output: list[StructField],
    keep: list[str] | None = None,
    keep_chunk: bool = False,
) -> DataFrame:
    """Rows of ``keys``, ``order``, the ``keep`` columns and ``output`` as the machine computes them.

    Pass narrow rows only. Rows with a chunk already are taken as :func:`~reelgrid.plans.ordered.spread` left them for
    a walk.
    """
    cut = rows if CHUNK in rows.columns else spread(rows, keys, order, walk=True)
    columns = [c for c in rows.columns if c != CHUNK]
    text = lambda name: StructField(name, StringType())
    exit_schema = StructType([cut.schema[CHUNK], text("first_key"), text("last_key"), text("state"), StructField("effect", BinaryType())])
    kept = [*[cut.schema[c] for c in [*keys, *order, *(keep or [])]], *([cut.schema[CHUNK]] if keep_chunk else [])]
    out_schema = StructType([*kept, *output])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, Rows]]:
        """Consecutive rows of one chunk and key."""
        for batch in batches:
            data = batch.to_pydict()
            begin = 0
            for (chunk, *key), run in groupby(zip(data[CHUNK], *(data[k] for k in keys), strict=True)):
                end = begin + sum(1 for _ in run)
                yield chunk, key, {c: data[c][begin:end] for c in columns}
                begin = end

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # per chunk: its first key, its last key, the last key's state and what it does to an earlier state if it is alone
        ends: dict[int, list] = {}
        for chunk, key, part in runs(batches):
            name = json.dumps(key, default=str)
            end = ends.setdefault(chunk, [name, name, None, None])
            if name != end[1]:
                end[1:] = [name, None, None]
            if end[0] == end[1]:
                end[3] = machine.extend(end[3], part)
            _, end[2] = machine.step(end[2], part)
        if ends:
            found = [(c, *e[:3], pickle.dumps(e[3])) for c, e in ends.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(v), f.type) for v, f in zip(zip(*found, strict=True), arrow_exit, strict=True)], schema=arrow_exit
            )

    def emit(entries: dict[int, str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready: Rows = {f.name: [] for f in arrow_out}

            def batch() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(ready[f.name], f.type) for f in arrow_out], schema=arrow_out)

            here, mine, state = None, None, None
            for chunk, key, part in runs(batches):
                if chunk != here:
                    state = entries.get(chunk)
                elif key != mine:
                    state = None
                here, mine = chunk, key
                found, state = machine.step(state, part)
                data = {**part, **found, CHUNK: [chunk] * len(part[order[0]])}
                for name, values in ready.items():
                    values.extend(data[name])
                if len(ready[order[0]]) >= BATCH_ROWS:
                    yield batch()
                    for values in ready.values():
                        values.clear()
            yield batch()

        return run

    def walked(chunk: int, entry: str) -> str:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = entry
            for _, _, part in runs(batches):
                _, state = machine.step(state, part)
            yield pa.RecordBatch.from_arrays([pa.array([None if state is entry else state], pa.string())], ["state"])

        ends = cut.filter(F.col(CHUNK) == chunk).mapInArrow(run, "state string").filter("state is not null").collect()
        return ends[0]["state"] if ends else entry

    arrow_exit, arrow_out = to_arrow_schema(exit_schema), to_arrow_schema(out_schema)
    # One row per chunk: as many as there are partitions.
    entries: dict[int, str] = {}
    key, state = None, None
    for end in sorted(cut.mapInArrow(exits, exit_schema).collect(), key=lambda r: r[CHUNK]):
        if end.first_key == key:
            entries[end[CHUNK]] = state
            alone = end.first_key == end.last_key
            state = (machine.enter(pickle.loads(end.effect), state) or walked(end[CHUNK], state)) if alone else end.state
        else:
            state = end.state
        key = end.last_key
    return cut.mapInArrow(emit(entries), out_schema)
