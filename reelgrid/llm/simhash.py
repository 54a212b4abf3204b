"""SimHash near-duplicates with BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from reelgrid.llm.components import components
from reelgrid.llm.shared import checked, pin

#: Words of a shingle, differing bits up to which fingerprints link, fingerprints in one tree.
SHINGLE, RADIUS, TREE = 4, 4, 1024
#: Keys of a shingle set and the least hashes in one: two sets that share 0.8 of their shingles share a key with chance
#: 1 - (1 - 0.8 ** 4) ** 16 = 0.9998.
BANDS, ROWS = 16, 4
#: Rows of one 8-byte key that may be broadcast.
SMALL_KEYS = 500_000


def shingles(text: str, words: int = SHINGLE) -> np.ndarray:
    """The hashes of all runs of ``words`` words, or of all words of a shorter text."""
    tokens = text.encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    line = memoryview(b" ".join(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(1, len(tokens) - words + 1)
    spans = zip(starts[:last].tolist(), ends[min(words, len(tokens)) - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], 42) for a, b in spans], np.uint64)


def majority(hashes: np.ndarray) -> int:
    votes = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 4096):
        some = hashes[start : start + 4096]
        votes += np.unpackbits(some.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes)).view(">u8")[0])


def fingerprint(text: str, words: int = SHINGLE) -> int:
    """The bits that more than half of the shingles' hashes have, as an unsigned number; 0 without words."""
    return majority(shingles(text, words))


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            found = np.array([fingerprint(t or "", words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("_kept"), pa.array(found)], ["_kept", "fp"])

    return run


_DRAW = np.random.default_rng(11)
_TIMES = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def bands(distinct: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of a set, each of the least of its members under ``ROWS`` orders."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(distinct), 4096):
        mixed = distinct[start : start + 4096, None] * _TIMES + _PLUS
        least = np.minimum(least, ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)).min(0))
    least = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(least[n].tobytes(), n) for n in range(BANDS)], np.uint64).view(np.int64)


def _name(distinct: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(distinct.tobytes(), 3)


def _sketches(words: int):
    """The fingerprint of each text, the name of its set of shingles and the set's keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, names, keys = [], [], []
            for text in batch.column("_text").to_pylist():
                hashes = shingles(text or "", words)
                distinct = np.unique(hashes)
                # repeats within a text must not turn its fingerprint away from those of like sets
                prints.append(majority(distinct))
                names.append(_name(distinct))
                keys.append(bands(distinct))
            flat = np.concatenate(keys or [np.empty(0, np.int64)])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(flat))
            both = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (prints, names)]
            yield pa.RecordBatch.from_arrays([batch.column("_kept"), *both, lists], ["_kept", "fp", "node", "keys"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingles(t or "", words)) for t in batch.column("_text").to_pylist()]
            names = np.array([_name(d) for d in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([d.tobytes() for d in found], pa.binary())], ["node", "members"])

    return run


class Forest:
    """BK-trees of many groups: a child hangs at its parent by their Hamming distance, a whole number from 1 to 64.

    Trees are built level by level: all values that have come down to a node split by their distance to it, and the
    first of each distance becomes the child. Searches go down the same way, all values at once.
    """

    def __init__(self, values: np.ndarray, groups: np.ndarray):
        self.values = values
        first = np.concatenate([[True], groups[1:] != groups[:-1]]) if len(values) else np.zeros(0, bool)
        self.roots = np.flatnonzero(first)
        tree_of = np.cumsum(first) - 1
        item = np.flatnonzero(~first)
        node = self.roots[tree_of[item]] if len(item) else item
        keys, children = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(item):
            far = np.bitwise_count(values[item] ^ values[node]).astype(np.int64)
            key, at, back = np.unique(node * 65 + far, return_index=True, return_inverse=True)
            keys.append(key)
            children.append(item[at])
            node = item[at][back]
            deeper = item != node
            item, node = item[deeper], node[deeper]
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        self.keys, self.children = key[order], np.concatenate(children)[order]

    def near(self, asked: np.ndarray, roots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) places of all values within ``radius``; each query starts at its tree's root."""
        got_q, got_n = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for start in range(0, len(asked), 2048):
            query, node = np.arange(start, min(start + 2048, len(asked))), roots[start : start + 2048]
            while len(query):
                far = np.bitwise_count(asked[query] ^ self.values[node]).astype(np.int64)
                hit = far <= radius
                got_q.append(query[hit])
                got_n.append(node[hit])
                # by the triangle inequality only these edges can lead to a match
                low = np.searchsorted(self.keys, node * 65 + np.maximum(far - radius, 1))
                many = np.searchsorted(self.keys, node * 65 + np.minimum(far + radius, 64), "right") - low
                query = np.repeat(query, many)
                node = self.children[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(len(query))]
        return np.concatenate(got_q), np.concatenate(got_n)


def spanning(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place each of ``count`` places reaches over the pairs (a, b)."""
    label = np.arange(count)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _links(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    label = spanning(len(values), a, b)
    moved = np.flatnonzero(label != np.arange(len(values)))
    both = [pa.array(values[moved].view(np.int64)), pa.array(values[label[moved]].view(np.int64))]
    return pa.RecordBatch.from_arrays(both, ["a", "b"])


def _within(radius: int):
    """Links inside groups that lie together in the rows, at most one for each value of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def search(values, groups):
            forest = Forest(values, groups)
            first = np.concatenate([[True], groups[1:] != groups[:-1]])
            query, node = forest.near(values, forest.roots[np.cumsum(first) - 1], radius)
            return _links(values, query, node)

        held_v, held_g = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            values = np.concatenate([held_v, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            groups = np.concatenate([held_g, batch.column("group").to_numpy(zero_copy_only=False)])
            if not len(values):
                continue
            cut = len(groups) - int(np.argmax(groups[::-1] != groups[-1])) if groups[0] != groups[-1] else 0
            if cut:
                yield search(values[:cut], groups[:cut])
            held_v, held_g = values[cut:], groups[cut:]
        if len(held_v):
            yield search(held_v, held_g)

    return run


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pack the values of each (group, shard), which lie together, into one row."""
    held, key = [], None
    for batch in batches:
        for g, s, v in zip(*(batch.column(c).to_pylist() for c in ("group", "shard", "fp"))):
            if key is not None and key != (g, s):
                yield _packed(key, held)
                held = []
            key = (g, s)
            held.append(v)
    if held:
        yield _packed(key, held)


def _packed(key: tuple[int, int], values: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([np.array(values, np.int64).tobytes()])],
        ["group", "shard", "packed"],
    )


def _across(radius: int):
    """Links between two shards of a group: the tree of one is walked with the values of the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, other in zip(batch.column("packed").to_pylist(), batch.column("asked").to_pylist()):
                tree, asked = np.frombuffer(own, np.uint64), np.frombuffer(other, np.uint64)
                forest = Forest(tree, np.zeros(len(tree), np.int64))
                query, node = forest.near(asked, np.zeros(len(asked), np.int64), radius)
                yield _links(np.concatenate([tree, asked]), node, query + len(tree))

    return run


def _keys(count: int, radius: int) -> list[Column]:
    """Group keys such that values within ``radius`` share one: the bits of all but ``radius`` of some blocks.

    More blocks make smaller groups and more keys; their number follows the number of values, the links don't.
    """
    blocks = radius + (1 if count <= 1 << 20 else 2 if count <= 1 << 27 else 3)
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    keys = []
    for n, some in enumerate(combinations(masks, blocks - radius)):
        mask = sum(some)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(signed).cast("long"))))
    return keys


def links(values: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that join all values of ``values`` (fp: distinct longs) with at most ``radius`` differing bits.

    Not all pairs are listed: a group of values that share a key gives at most one link for each of them, which joins
    the same values. Groups of more than ``TREE`` values are split into shards by a hash; each shard's tree is sent to
    the other shards of its group, so no task holds more than two.
    """
    count = values.count()
    keyed = values.select("fp", F.explode(F.array(*_keys(count, radius))).alias("group"))
    large = pin(keyed.groupBy("group").count().filter(F.col("count") > TREE))
    large = large.select("group", F.ceil(F.col("count") / TREE).cast("int").alias("shards"))
    keyed = keyed.join(checked(large), "group", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    shard = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("shards")).cast("int").alias("shard")
    keyed = keyed.select("fp", "group", "shards", shard).repartition("group", "shard").sortWithinPartitions("group", "shard", "fp")
    keyed = pin(keyed)
    # a shard of a large group is a group of its own here, and meets the others below
    own = F.when(F.col("shards") == 1, F.col("group")).otherwise(F.xxhash64("group", "shard"))
    shape = "a long, b long"
    inside = keyed.select("fp", own.alias("group")).repartition("group").sortWithinPartitions("group", "fp").mapInArrow(_within(radius), shape)
    split = keyed.filter("shards > 1").select("group", "shard", "fp").repartition("group", "shard").sortWithinPartitions("group", "shard", "fp")
    shards = pin(split.mapInArrow(_shards, "group long, shard int, packed binary"))
    others = shards.select("group", F.col("shard").alias("other"), F.col("packed").alias("asked"))
    pairs = shards.join(others, "group").filter("shard < other").select("group", "shard", "other", "packed", "asked")
    across = pairs.repartition("group", "shard", "other").select("packed", "asked").mapInArrow(_across(radius), shape)
    return inside.unionByName(across)


def _packed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pack the sets of each (group, shard), which lie together, into one row."""
    names = ["group", "shard", "nodes", "prints", "members"]

    def row() -> pa.RecordBatch:
        nodes, prints, members = zip(*held)
        parts = [[key[0]], [key[1]], [np.array(nodes, np.int64).tobytes()], [np.array(prints, np.int64).tobytes()], [list(members)]]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(p, k) for p, k in zip(parts, kinds)], names)

    held, key = [], None
    for batch in batches:
        for g, s, *value in zip(*(batch.column(c).to_pylist() for c in ("group", "shard", "node", "fp", "members"))):
            if held and key != (g, s):
                yield row()
                held = []
            key = (g, s)
            held.append(value)
    if held:
        yield row()


def _verified(radius: int, least: float):
    """Links between sets of which at least ``least`` is shared; sets that already hang together are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.to_pylist():
                two = one if one["nodes2"] is None else {k: one[f"{k}2"] for k in ("nodes", "prints", "members")}
                nodes, others = (np.frombuffer(x["nodes"], np.int64) for x in (one, two))
                prints, asked = (np.frombuffer(x["prints"], np.uint64) for x in (one, two))
                near = Forest(prints, np.zeros(len(prints), np.int64)).near(asked, np.zeros(len(asked), np.int64), radius)
                order = np.lexsort(near[::-1])
                query, node = near[0][order], near[1][order]
                if two is one:
                    query, node, label, shift = query[node < query], node[node < query], np.arange(len(nodes)), 0
                else:
                    label, shift = np.arange(len(nodes) + len(others)), len(nodes)
                sets = [[np.frombuffer(m, np.uint64) for m in x["members"]] for x in (one, two)]
                edges = np.searchsorted(query, np.arange(len(asked) + 1))
                links = []
                for q in range(len(asked)):
                    left = node[edges[q] : edges[q + 1]]
                    mine = sets[1][q]
                    left = left[label[left] != label[q + shift]]
                    while len(left):
                        n = left[0]
                        his = sets[0][n]
                        if min(len(mine), len(his)) >= least * max(len(mine), len(his)):
                            both = len(np.intersect1d(mine, his, assume_unique=True))
                            if both >= least * (len(mine) + len(his) - both):
                                links.append((others[q], nodes[n]))
                                label[label == label[n]] = label[q + shift]
                        left = left[1:]
                        left = left[label[left] != label[q + shift]]
                ends = np.array(links, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    return run


def similar(rows: DataFrame, texts: DataFrame, words: int, radius: int, least: float) -> DataFrame:
    """Links (a, b) that join all sets of ``rows`` (node, fp, keys, _hash) that share ``least`` of their shingles.

    ``radius`` is too wide for groups of equal blocks of bits, so sets meet by their keys. In each group the trees give
    the candidates, whose shingles, hashed again from ``texts`` (_hash, _text), decide. Only groups of two sets and
    more get them. Large groups are split like those of ``links``.
    """
    values = pin(rows.groupBy("node").agg(F.min("fp").alias("fp"), F.first("keys").alias("keys"), F.min("_hash").alias("_hash")))
    keyed = values.select("node", "fp", F.explode(F.array_distinct("keys")).alias("group"))
    sizes = pin(keyed.groupBy("group").count().filter("count > 1"))
    sizes = sizes.select("group", F.ceil(F.col("count") / TREE).cast("int").alias("shards"))
    keyed = pin(keyed.join(checked(sizes, SMALL_KEYS), "group"))
    wanted = values.join(keyed.select("node").distinct(), "node", "left_semi").select("_hash").distinct()
    found = texts.join(checked(pin(wanted), SMALL_KEYS), "_hash", "left_semi").select("_text")
    sets = pin(found.mapInArrow(_sets(words), "node long, members binary").dropDuplicates(["node"]))
    shard = F.pmod(F.xxhash64("node", F.lit(7)), F.col("shards")).cast("int").alias("shard")
    dealt = keyed.select("node", "fp", "group", shard).join(sets, "node")
    dealt = dealt.repartition("group", "shard").sortWithinPartitions("group", "shard", "node")
    shape = "group long, shard int, nodes binary, prints binary, members array<binary>"
    packed = pin(dealt.select("group", "shard", "node", "fp", "members").mapInArrow(_packed_sets, shape))
    columns = "nodes", "prints", "members"
    alone = packed.select(*columns, *[F.lit(None).cast(packed.schema[c].dataType).alias(f"{c}2") for c in columns])
    large = packed.join(checked(pin(sizes.filter("shards > 1").select("group"))), "group", "left_semi")
    others = large.select("group", F.col("shard").alias("other"), *[F.col(c).alias(f"{c}2") for c in columns])
    pairs = large.join(others, "group").filter("shard < other").repartition("group", "shard", "other")
    check = lambda df: df.select(*columns, *[f"{c}2" for c in columns]).mapInArrow(_verified(radius, least), "a long, b long")
    return check(alone).unionByName(check(pairs))


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", keep: list[str] | None = None,
    words: int = SHINGLE, radius: int = RADIUS, similarity: float | None = None,
) -> DataFrame:
    """Add ``fingerprint``, ``component_id`` and ``component`` to the columns ``keep`` (all, if not given).

    Fingerprints (16 hexadecimal digits) of shingles of ``words`` words link when at most ``radius`` bits differ;
    ``component_id`` is the smallest id that links reach, ``component`` the smallest fingerprint, by which components
    without ids are told apart. With ``similarity``, texts link when they share so much of their shingles (Jaccard) and
    their fingerprints lie within ``radius``, and ``component`` is the smallest name of a set of shingles. Null
    texts and texts without words have the fingerprint zero, shorter texts that of all their words; repeated rows are
    in one component; null ids belong to components but don't name them (null, if there is no other); an empty table
    stays empty. Columns named like the results are replaced.
    """
    own = [c for c in (keep or docs.columns) if c not in ("fingerprint", "component_id", "component")]
    rows = docs.select(
        F.struct(F.struct(*[F.col(f"`{c}`") for c in own]).alias("columns"), F.col(f"`{key}`").cast("long").alias("id")).alias("_kept"),
        F.col(f"`{text}`").cast("string").alias("_text"),
    )
    kept, whole = rows.schema["_kept"], [StructField(c, LongType()) for c in ("fp", "node")]
    if similarity is None:
        rows = pin(rows.mapInArrow(_fingerprints(words), StructType([kept, whole[0]]))).withColumn("node", F.col("fp"))
    else:
        texts = rows.select(F.xxhash64("_text").alias("_hash"), "_text")
        rows = rows.withColumn("_kept", F.struct("_kept.columns", "_kept.id", F.xxhash64("_text").alias("_hash")))
        shape = StructType([rows.schema["_kept"], *whole, StructField("keys", ArrayType(LongType()))])
        rows = pin(rows.mapInArrow(_sketches(words), shape))
    values = pin(rows.groupBy("node").agg(F.min("_kept.id").alias("least")))
    if similarity is None:
        linked = links(values.select(F.col("node").alias("fp")), radius)
    else:
        linked = similar(rows.select("node", "fp", "keys", "_kept._hash"), texts, words, radius, similarity)
    reached = pin(components(linked))
    inside = values.join(reached, "node", "left")
    inside = pin(inside.withColumn("root", F.coalesce("root", "node")))
    best = inside.groupBy("root").agg(F.min("least").alias("component_id"))
    named = pin(inside.join(best, "root").select("node", "component_id", "root"))
    hexed = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return rows.join(named, "node").select(
        "_kept.columns.*", hexed("fp").alias("fingerprint"), "component_id", hexed("root").alias("component")
    )


def deduplicated(
    docs: DataFrame, text: str = "text", key: str = "doc_id",
    words: int = SHINGLE, radius: int = RADIUS, similarity: float | None = None,
) -> DataFrame:
    """One row of each component, as it is: the one with the smallest id; rows without ids stand back.

    Of equal rows one stays. What goes is a list of hashes of id and text, so texts aren't shuffled unless rows repeat
    or the list is long.
    """
    identity = F.xxhash64(F.col(f"`{key}`").cast("string"), F.col(f"`{text}`").cast("string"))
    narrow = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"), identity.alias("_identity"))
    found = near_duplicates(narrow, "text", "id", ["id", "_identity"], words, radius, similarity)
    rows = pin(found.select("id", "_identity", "component"))
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("_identity"))
    first = rows.groupBy("component").agg(F.min_by("_identity", order).alias("_identity")).select("_identity")
    gone = pin(rows.select("_identity").distinct().join(first, "_identity", "left_anti"))
    left = docs.withColumn("_identity", identity).join(checked(gone, SMALL_KEYS), "_identity", "left_anti")
    repeated = rows.groupBy("_identity").count().filter("count > 1").join(first, "_identity", "left_semi")
    if repeated.limit(1).count():
        left = left.dropDuplicates(["_identity"])
    return left.drop("_identity")
