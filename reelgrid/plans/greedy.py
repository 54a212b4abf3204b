"""Greedy cuts: a new group starts at the first instant beyond the length of the current group.

The rule is sequential, but inside one contiguous chunk every possible first cut leads to one last cut. A chunk is
therefore a table from the first cut to the last one, and the tables of neighbouring chunks merge into that of both by
looking up, for each last cut of the first, the next cut in the second. Tables are merged ``FAN`` at a time, level by
level, until few are left; then the cut each table starts from is handed down the same levels, and each chunk is cut
with the group it starts in. Equal ends of neighbouring first cuts are kept once. No task holds more than ``FAN``
tables, none of which has more rows than its chunks have instants.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from reelgrid.plans.ordered import CHUNK, spread
from reelgrid.plans.session import pinned_table

#: Tables merged by one task.
FAN = 8

# A row of a table: from a first cut after the row before's up to ``cut`` (null: whatever came before), the last cut
# and how many cuts there are. Each row also tells the table's node, its first and last key, and the first and last
# instant of its first key.
_TABLE = "node long, first_key string, last_key string, begin long, finish long, cut long, exit long, cuts long"
_OPEN = "node long, open long, before long"


class _Node:
    """The table of some neighbouring chunks."""

    def __init__(self, rows: pd.DataFrame):
        top = rows.iloc[0]
        self.first_key, self.last_key, self.begin, self.finish = top["first_key"], top["last_key"], int(top["begin"]), int(top["finish"])
        self.fixed = bool(rows["cut"].isna().any())
        plain = lambda c: rows[c].to_numpy(np.int64)
        self.cuts = np.empty(0, np.int64) if self.fixed else plain("cut")
        self.exits, self.counts = plain("exit"), plain("cuts")

    def through(self, entry: tuple[int, int] | None, length: int, side: str) -> tuple[int, int]:
        """The last cut and the cuts so far for a group that is open before, as its first instant and its cuts so far."""
        if self.fixed:
            return int(self.exits[0]), int(self.counts[0])
        first, before = entry or (None, 0)
        i = 0 if first is None else int(np.searchsorted(self.cuts, first + length, side=side))
        return (first, before) if i == len(self.cuts) else (int(self.exits[i]), before + int(self.counts[i]))

    def then(self, other: _Node, length: int, side: str) -> _Node:
        """The table of this node and the next one; it takes this one's place."""
        follows = other.first_key == self.last_key
        if self.fixed or other.fixed or not follows:
            entry = (int(self.exits[0]), int(self.counts[0])) if self.fixed and follows else None
            exit, count = other.through(entry, length, side)
            # only a key that goes on from before leaves the end open
            self.fixed, self.cuts, self.exits, self.counts = True, np.empty(0, np.int64), np.array([exit]), np.array([count])
        else:
            i = np.searchsorted(other.cuts, self.exits + length, side=side)
            cut = i < len(other.cuts)
            at = np.minimum(i, len(other.cuts) - 1)
            exits = np.where(cut, other.exits[at], self.exits)
            counts = self.counts + np.where(cut, other.counts[at], 0)
            if self.finish < self.begin + length:
                # the first cut may be beyond this node
                exits, counts = np.concatenate([exits, other.exits]), np.concatenate([counts, other.counts])
                self.cuts = np.concatenate([self.cuts, other.cuts])
            self.exits, self.counts = exits, counts
            self.finish = other.finish
        self.last_key = other.last_key
        return self

    def rows(self, node: int) -> pd.DataFrame:
        """The table, of neighbouring rows with equal ends only the last one."""
        same = np.append((self.exits[1:] == self.exits[:-1]) & (self.counts[1:] == self.counts[:-1]), False)
        cuts = [None] if self.fixed else self.cuts[~same]
        return pd.DataFrame(
            {
                "node": node, "first_key": self.first_key, "last_key": self.last_key, "begin": self.begin, "finish": self.finish,
                "cut": pd.array(cuts, "Int64"), "exit": self.exits[~same], "cuts": self.counts[~same],
            }
        )


def _nodes(rows: pd.DataFrame) -> list[tuple[int, _Node]]:
    return [(int(n), _Node(part)) for n, part in rows.sort_values(["node", "cut"]).groupby("node", sort=True)]


def _opened(nodes: list[tuple[int, _Node]], entry: tuple[str, int, int] | None, length: int, side: str) -> list[tuple[int, int, int]]:
    """The group that is open where each node begins, if it goes on there; ``entry`` is the one before the first node."""
    found = []
    for number, node in nodes:
        open_group = entry[1:] if entry and entry[0] == node.first_key else None
        if open_group:
            found.append((number, *open_group))
        entry = (node.last_key, *node.through(open_group, length, side))
    return found


def first_cuts(tables: DataFrame, length: int, side: str) -> DataFrame:
    """``node``, ``open``, ``before``: for each chunk that goes on from the one before the open group's first instant and number."""
    levels, here, fan = [], tables, FAN
    count = (tables.agg(F.max("node")).first()[0] or 0) + 1
    while count > fan:
        levels.append(here)
        above = F.floor(F.col("node") / fan).cast("long")

        def merge(rows: pd.DataFrame) -> pd.DataFrame:
            nodes = _nodes(rows)
            merged = nodes[0][1]
            for _, node in nodes[1:]:
                merged = merged.then(node, length, side)
            return merged.rows(nodes[0][0] // fan)

        here = pinned_table(here.groupBy(above.alias("_above")).applyInPandas(merge, _TABLE))
        count = -(-count // fan)

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_opened(_nodes(rows), None, length, side), columns=["node", "open", "before"])

    opened = here.groupBy(F.lit(0).alias("_all")).applyInPandas(chain, _OPEN)
    for below in reversed(levels):

        def hand_down(rows: pd.DataFrame) -> pd.DataFrame:
            nodes, top = _nodes(rows), rows.iloc[0]
            entry = None if pd.isna(top["open"]) else (nodes[0][1].first_key, int(top["open"]), int(top["before"]))
            return pd.DataFrame(_opened(nodes, entry, length, side), columns=["node", "open", "before"])

        given = opened.withColumnRenamed("node", "_above")
        both = below.withColumn("_above", F.floor(F.col("node") / fan).cast("long")).join(given, "_above", "left")
        opened = both.groupBy("_above").applyInPandas(hand_down, _OPEN)
    return opened


def greedy_groups(
    rows: DataFrame, keys: list[str], at: str, length: int, inclusive: bool = False, carry: list[str] | None = None
) -> DataFrame:
    """Rows (keys, ``at`` and the narrow ``carry`` columns) with ``group_first`` and ``group_no``.

    Rows of one instant share a group; ``inclusive`` cuts at exactly ``length`` too.
    """
    narrow = rows.select(*keys, at, *(carry or []))
    cut, columns = spread(narrow, keys, [at], walk=True), narrow.columns
    side = "left" if inclusive else "right"
    long = lambda name: StructField(name, LongType())
    output = StructType([*narrow.schema.fields, long("group_first"), long("group_no")])
    table = StructType.fromDDL(_TABLE)
    arrow_table, arrow_output = to_arrow_schema(table), to_arrow_schema(output)

    def runs(batches: Iterator[pa.RecordBatch]):
        """Rows of one chunk and key, piece by piece."""
        for batch in batches:
            data = batch.to_pydict()
            begin = 0
            for (chunk, *key), run in groupby(zip(data[CHUNK], *(data[k] for k in keys), strict=True)):
                end = begin + sum(1 for _ in run)
                yield chunk, key, {c: data[c][begin:end] for c in columns}
                begin = end

    def exits(times: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each possible first cut of a chunk ends up; the first key of a chunk may be open from before."""
        n = len(times)
        jump = np.append(np.searchsorted(times, times + length, side=side), n)
        possible = min(n, int(jump[0]) + 1) if first else 1
        last, steps = np.arange(n + 1), np.append(np.ones(n, np.int64), 0)
        # Doubling: after round r, ``jump`` is 2^r cuts ahead.
        while (jump[:n] < n).any():
            ahead = jump < n
            last[ahead] = last[jump[ahead]]
            steps = steps + steps[jump]
            jump = jump[jump]
        return times[:possible], times[last[:possible]], steps[:possible]

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, by_key in groupby(runs(batches), lambda r: r[0]):
            node, first = None, None
            for key, parts in groupby(by_key, lambda r: r[1]):
                times = np.unique(np.concatenate([np.asarray(p[2][at], np.int64) for p in parts]))
                cuts, last, steps = exits(times, node is None)
                name = json.dumps(key, default=str)
                node = {"first_key": first or name, "last_key": name, "begin": int(times[0]), "finish": int(times[-1])}
                if first:
                    cuts = pd.array([None], "Int64")
                first = first or name
                node |= {"cut": cuts, "exit": last, "cuts": steps}
            found = pd.DataFrame({"node": chunk, **node})
            yield pa.RecordBatch.from_pandas(found[table.fieldNames()], schema=arrow_table, preserve_index=False)

    def assign(opened: dict[int, tuple[int, int]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chunk, key, first, number = None, None, None, -1
            for here, mine, part in runs(batches):
                if here != chunk:
                    first, number = opened.get(here, (None, 0))
                    number -= 1
                elif mine != key:
                    first, number = None, -1
                chunk, key = here, mine
                times = np.asarray(part[at], np.int64)
                firsts, numbers, begin = np.empty(len(times), np.int64), np.empty(len(times), np.int64), 0
                while begin < len(times):
                    end = 0 if first is None else int(np.searchsorted(times, first + length, side=side))
                    if end <= begin:
                        first, number = int(times[begin]), number + 1
                        end = int(np.searchsorted(times, first + length, side=side))
                    firsts[begin:end], numbers[begin:end] = first, number
                    begin = max(end, begin + 1)
                part |= {"group_first": firsts, "group_no": numbers}
                yield pa.RecordBatch.from_arrays([pa.array(part[f.name], f.type) for f in arrow_output], schema=arrow_output)

        return run

    tables = pinned_table(cut.mapInArrow(summarise, table))
    # At most one row per chunk: only its first key can be open from before.
    opened = {r["node"]: (r["open"], r["before"]) for r in first_cuts(tables, length, side).collect()}
    return cut.mapInArrow(assign(opened), output)
