"""A Merkle manifest of a dataset: a tree over the rows of every source, and a tree over the sources' roots.

A tree is kept in aligned subtrees of up to ``HEIGHT`` steps, one row each. The nodes of a subtree lie in van Emde Boas
order: the tree is split at half its height, the upper half comes first, then each lower tree, all of them laid out the
same way. So the place of a node is arithmetic on its depth and number, and a path from a leaf to the root stays within
few neighbouring bytes whatever the size of a cache line. The roots of subtrees are the leaves of the subtrees above
them; a source of any size is a few rounds of small, equal groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from reelgrid.llm.shared import checked, pin, placed

#: Children of a node.
FAN = 3
#: Steps from the leaves of a subtree to its root; a subtree has up to FAN ** HEIGHT leaves.
HEIGHT = 6
#: Bytes of a digest.
WIDTH = 32
#: Rows of paths, about 2 kB each, up to which they may be broadcast.
FEW_PATHS = 5_000

_LONE = (0, ())


def digest(hexes: str) -> str:
    return hashlib.sha256(hexes.encode()).hexdigest()


def nodes_of(levels: int) -> int:
    """The nodes of a complete tree with so many levels."""
    return (FAN**levels - 1) // (FAN - 1)


def address(levels: int, depth: int, number: np.ndarray) -> np.ndarray:
    """Where nodes, given by their depth below the root and their number there, lie in van Emde Boas order."""
    if levels == 1:
        return np.zeros_like(number)
    upper = levels // 2
    if depth < upper:
        return address(upper, depth, number)
    lower, below = levels - upper, FAN ** (depth - upper)
    return nodes_of(upper) + number // below * nodes_of(lower) + address(lower, depth - upper, number % below)


@lru_cache(maxsize=64)
def _places(levels: int) -> list[np.ndarray]:
    return [address(levels, d, np.arange(FAN**d)) for d in range(levels)]


def build_subtree(leaves: list[bytes]) -> tuple[int, bytes, str]:
    """The levels, the laid out nodes and the root of the subtree over some leaves."""
    levels = 1
    while FAN ** (levels - 1) < len(leaves):
        levels += 1
    nodes = np.zeros((nodes_of(levels), WIDTH), np.uint8)
    row = [x.hex() for x in leaves]
    for depth in range(levels - 1, -1, -1):
        raw = np.frombuffer(bytes.fromhex("".join(row)), np.uint8)
        nodes[_places(levels)[depth][: len(row)]] = raw.reshape(-1, WIDTH)
        if depth:
            row = [digest("".join(row[i : i + FAN])) for i in range(0, len(row), FAN)]
    return levels, nodes.tobytes(), row[0]


def paths(levels: int, nodes: bytes, leaves: int) -> Iterator[list[tuple[int, tuple[str, ...]]]]:
    """For each leaf of a subtree, from it to the root: its place in its run and the digests of the others there."""
    spelt = nodes.hex()
    at = lambda place: spelt[2 * WIDTH * place : 2 * WIDTH * (place + 1)]
    steps, count = [], leaves
    for depth in range(levels - 1, 0, -1):
        row = [at(p) for p in _places(levels)[depth][:count].tolist()]
        steps.append([(i % FAN, tuple(row[j] for j in range(i // FAN * FAN, min(i // FAN * FAN + FAN, count)) if j != i)) for i in range(count)])
        count = -(-count // FAN)
    for i in range(leaves):
        yield [step[i // FAN**up] for up, step in enumerate(steps)]


def fold(leaf: str, steps: list[tuple[int, tuple[str, ...]]]) -> str:
    """The root that a leaf and the digests beside its path lead to."""
    for place, others in steps:
        leaf = digest("".join([*others[:place], leaf, *others[place:]]))
    return leaf


def _raised(levels: int, total: int, height: int) -> int:
    """How often a subtree's root is hashed alone until it reaches the height of its neighbours."""
    return height + 1 - levels if total > FAN**height else 0


_STEPS = ArrayType(StructType([StructField("place", IntegerType()), StructField("others", ArrayType(StringType()))]))


@dataclass(frozen=True)
class Forest:
    """Trees as rounds of subtrees: ``tree``, ``block``, ``total`` (leaves of the round), ``rows``, ``levels``, ``nodes``, ``root``."""

    rounds: list[DataFrame]
    height: int

    def roots(self) -> DataFrame:
        """``tree`` and ``root`` of every tree."""
        done = [r.filter(F.col("total") <= FAN**self.height).select("tree", "root") for r in self.rounds]
        out = done[0]
        for more in done[1:]:
            out = out.unionByName(more)
        return out

    def with_paths(self, top: DataFrame) -> DataFrame:
        """The subtrees of the first round with ``above``, the steps from their root to the end.

        ``top`` has the steps ``above`` and the ``subroot`` of every ``tree``.
        """
        given = None
        for subtrees in reversed(self.rounds):
            done = subtrees.filter(F.col("total") <= FAN**self.height).select("tree", "block").join(checked(top, FEW_PATHS), "tree")
            above = pin(done if given is None else done.unionByName(given))
            here = subtrees.join(checked(above, FEW_PATHS), ["tree", "block"])
            if subtrees is self.rounds[0]:
                return here
            shape = StructType([subtrees.schema["tree"], subtrees.schema["block"], StructField("subroot", StringType()), StructField("above", _STEPS)])
            given = here.select("tree", "block", "total", "levels", "nodes", F.size("rows").alias("n"), "subroot", "above").mapInArrow(
                _downwards(to_arrow_schema(shape), self.height), shape
            )
        raise AssertionError("a forest has a round at least")


def _steps(given) -> list[tuple[int, tuple[str, ...]]]:
    return [(s["place"], tuple(s["others"])) for s in given]


def _downwards(shape: pa.Schema, height: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rest = [_LONE] * _raised(row["levels"], row["total"], height) + _steps(row["above"])
                ways = [[{"place": p, "others": list(o)} for p, o in way + rest] for way in paths(row["levels"], row["nodes"], row["n"])]
                first = row["block"] * FAN**height
                yield pa.RecordBatch.from_pydict(
                    {
                        "tree": [row["tree"]] * len(ways), "block": list(range(first, first + len(ways))),
                        "subroot": [row["subroot"]] * len(ways), "above": ways,
                    }, schema=shape,
                )

    return run


def _subtrees(shape: pa.Schema, height: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                leaves = one.column("rows").flatten().field("digest").to_pylist()
                levels, nodes, root = build_subtree(leaves)
                total = one.column("total")[0].as_py()
                raised = fold(root, [_LONE] * _raised(levels, total, height))
                made = {"levels": [levels], "nodes": [nodes], "root": [root], "raised": [raised]}
                arrays = [one.column(f.name) if f.name in one.schema.names else pa.array(made[f.name], f.type) for f in shape]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, shape)], schema=shape)

    return run


def build(leaves: DataFrame, height: int = HEIGHT) -> Forest:
    """Trees over the pinned rows ``tree``, ``at`` (gapless from 0), ``total`` (rows of the tree), ``digest`` and any others."""
    most = leaves.agg(F.max("total")).first()[0] or 0
    rounds, here = [], leaves
    full = FAN**height
    while True:
        own = [c for c in here.columns if c not in ("tree", "at", "total")]
        rows = here.groupBy("tree", F.expr(f"at div {full}").alias("block"), "total").agg(
            F.sort_array(F.collect_list(F.struct(F.expr(f"cast(at % {full} as int)").alias("spot"), *own))).alias("rows")
        )
        shape = StructType([*rows.schema.fields, StructField("levels", IntegerType()), *StructType.fromDDL("nodes binary, root string, raised string").fields])
        built = pin(rows.mapInArrow(_subtrees(to_arrow_schema(shape), height), shape))
        rounds.append(built)
        if most <= full:
            return Forest(rounds, height)
        most = -(-most // full)
        here = built.filter(F.col("total") > full).select(
            "tree", F.col("block").alias("at"), F.ceil(F.col("total") / full).cast("long").alias("total"), F.unhex("raised").alias("digest")
        )


def leaf(fields: list[Column]) -> Column:
    """The digest of a row's fields: each as ``-`` if null, else its UTF-8 length, a colon and its text."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _numbered(rows: DataFrame) -> DataFrame:
    """Add ``at`` and ``total`` to a placed table: the place of each row in its ``tree`` and the tree's rows."""
    runs = rows.groupBy("tree", "_chunk").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("tree").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "tree", "_chunk", "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy("tree")).alias("total"),
    )
    joined = rows.join(checked(pin(runs)), ["tree", "_chunk"])
    return joined.withColumn("at", F.col("_row") - F.col("_first") + F.col("_before")).drop("_first", "_before", "_row", "_chunk")


@dataclass(frozen=True)
class Manifest:
    """The digests of a dataset: ``sources`` are the trees of its rows, ``top`` is the tree over their roots."""

    sources: Forest
    top: Forest
    kept: list[str]

    def root(self) -> str | None:
        """The digest of the whole dataset; none if it has no rows."""
        found = self.top.roots().first()
        return found["root"] if found else None

    def subroots(self) -> DataFrame:
        """``source`` and its ``subroot``."""
        return self.sources.roots().select(_source().alias("source"), F.col("root").alias("subroot"))

    def prove(self) -> DataFrame:
        """Every row's kept columns with ``leaf``, ``subroot``, ``root``, ``siblings``, ``folded_root`` and ``verified``.

        ``siblings`` are the digests beside the path from the leaf to the root, level by level and from left to right.
        ``folded_root`` is what the claimed leaf leads to with them; the row is verified if that is the root.
        """
        root = self.root()
        named = self.top.with_paths(
            self.top.roots().select("tree", F.col("root").alias("subroot"), F.array().cast(_STEPS).alias("above"))
        )
        shape = StructType([named.schema["tree"], StructField("subroot", StringType()), StructField("above", _STEPS)])
        upper = named.select("rows", "total", "levels", "nodes", "above").mapInArrow(_tops(to_arrow_schema(shape), self.top.height), shape)
        subtrees = self.sources.with_paths(pin(upper))
        inside = subtrees.schema["rows"].dataType.elementType
        texts = [StructField(n, StringType()) for n in ("leaf", "subroot", "root")]
        out = StructType([inside["_kept"], *texts, StructField("siblings", ArrayType(StringType())), StructField("folded_root", StringType()), StructField("verified", BooleanType())])
        proven = subtrees.select("rows", "total", "levels", "nodes", "subroot", "above").mapInArrow(_proofs(to_arrow_schema(out), root, self.sources.height), out)
        return proven.select("_kept.*", *[f.name for f in out.fields[1:]])


def _source() -> Column:
    return F.when(F.col("tree") != "", F.expr("substring(tree, 2)"))


def _ways(row: dict, height: int) -> Iterator[tuple[dict, list]]:
    rest = [_LONE] * _raised(row["levels"], row["total"], height) + _steps(row["above"])
    for leaf_row, way in zip(row["rows"], paths(row["levels"], row["nodes"], len(row["rows"]))):
        yield leaf_row, way + rest


def _tops(shape: pa.Schema, height: int):
    """What the tree over the sources' roots gives each source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = [(r["name"], r["digest"].hex(), [{"place": p, "others": list(o)} for p, o in way]) for r, way in _ways(row, height)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), shape)], schema=shape)

    return run


def _proofs(shape: pa.Schema, root: str | None, height: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                kept = one.column("rows").flatten().field("_kept")
                row = one.drop_columns(["rows"]).to_pylist()[0]
                inner = one.column("rows").flatten()
                row["rows"] = [{"digest": d, "claim": c} for d, c in zip(inner.field("digest").to_pylist(), inner.field("claim").to_pylist())]
                found = []
                for r, way in _ways(row, height):
                    own = r["digest"].hex()
                    folded = fold((r["claim"] or r["digest"]).hex(), way)
                    found.append((own, row["subroot"], root, [o for _, others in way for o in others], folded, folded == root))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*found), list(shape)[1:])]
                yield pa.RecordBatch.from_arrays([kept.cast(shape.field(0).type), *columns], schema=shape)

    return run


def manifest(docs: DataFrame, fields: list[str], by: str, order: str, claim: list[Column] | None = None, keep: list[str] | None = None, height: int = HEIGHT) -> Manifest:
    """Build the manifest of a dataset.

    A row's leaf is the digest of its ``fields``. The leaves of a source (``by``) ascend by ``order``; while there is
    more than one node, each run of ``FAN`` (the last may be shorter, even one) becomes the digest of their hex texts. Subtrees have ``height`` steps.
    The sources' roots, null first and then by their bytes, are joined the same way. ``claim`` are the fields as a
    reader holds them now; proofs fold the leaf of these (null or not given: the original fields).

    Null fields count as such, a null ``order`` comes first, rows that tie are ordered by their leaf and all count; a
    lone leaf is its source's root, a lone source's root that of the dataset. Without rows there is no root and no
    proof. Other columns take no part whatever their names.
    """
    own = keep or [order]
    first, second = leaf([F.col(f"`{f}`") for f in fields]), leaf(claim) if claim else F.lit(None).cast("string")
    rows = docs.select(
        F.when(F.col(f"`{by}`").isNull(), "").otherwise(F.concat(F.lit("s"), F.col(f"`{by}`").cast("string"))).alias("tree"),
        F.col(f"`{order}`").alias("_order"),
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("_kept"),
        F.unhex(first).alias("digest"),
        F.unhex(second).alias("claim"),
    )
    # where a claim repeats the leaf, it isn't kept
    rows = pin(rows.withColumn("claim", F.when(F.col("claim") != F.col("digest"), F.col("claim"))))
    leaves = _numbered(placed(rows, F.col("tree"), F.col("_order"), F.col("digest"))).drop("_order")
    sources = build(pin(leaves), height)
    roots = sources.roots().select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.unhex("root").alias("digest"))
    top = build(pin(_numbered(placed(pin(roots), F.col("name")))), height)
    return Manifest(sources, top, own)
