"""Repeated passages found with sharded FM-indexes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.blocks import each_row, packed, spelt_words, squeeze, unsqueeze
from reelgrid.llm.shared import parts, pin, pin_by

#: Words of a window, and of the anchors of which each window has one.
WINDOW, ANCHOR = 20, 8
#: A word is common if it makes up more than one in so many; there are at most so many of them.
COMMON = 65_000
#: Words of a block of documents.
BLOCK_WORDS = 1 << 19
#: Different stretches at one anchor beyond which its windows are dealt out one by one.
HOT = 256

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(int(_BASE), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WaveletMatrix:
    """A sequence of numbers as one bit vector per bit of its largest, with ranks in packed words of 32 bits."""

    BELOW = ((np.uint64(1) << np.arange(32, dtype=np.uint64)) - np.uint64(1)).astype(np.uint32)

    def __init__(self, sequence: np.ndarray, kinds: int):
        self.levels = max(1, int(kinds - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        symbols = np.arange(kinds, dtype=np.int32)
        first = np.zeros(kinds, np.int32)
        for level in reversed(range(self.levels)):
            bits = (sequence >> level & 1).astype(np.uint8)
            padded = np.zeros((len(bits) // 32 + 1) * 32, np.uint8)
            padded[: len(bits)] = bits
            packed_bits = np.packbits(padded, bitorder="little").view(np.uint32)
            self.words.append(packed_bits)
            ones = np.cumsum(np.bitwise_count(packed_bits), dtype=np.int32)
            self.before.append(np.concatenate([np.zeros(1, np.int32), ones[:-1]]))
            self.zeros.append(np.int32(len(bits) - int(ones[-1])))
            sequence = np.concatenate([sequence[bits == 0], sequence[bits == 1]])
            first = self._down(len(self.words) - 1, first, (symbols >> level & 1).astype(bool))
        self.first = first

    def _down(self, depth: int, at: np.ndarray, one: np.ndarray) -> np.ndarray:
        block = at >> 5
        ones = self.before[depth].take(block)
        ones += np.bitwise_count(self.words[depth].take(block) & self.BELOW.take(at & 31))
        return np.where(one, ones + self.zeros[depth], at - ones)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        for depth in range(self.levels):
            at = self._down(depth, at, (symbol & np.int32(1 << (self.levels - 1 - depth))) != 0)
        return at - self.first.take(symbol)


class FMIndex:
    """An index of texts of numbers from 1, parted by 0, for matches of up to ``depth`` numbers.

    Suffixes are sorted by their first ``depth`` numbers only, which is all that intervals of such patterns depend on.
    """

    #: Patterns searched at once, so that their state stays in the processor's cache.
    AT_ONCE = 1 << 14

    def __init__(self, text: np.ndarray, kinds: int, depth: int):
        n = len(text)
        rank, reach = text.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        ordered = rank[order]
        while reach < depth:
            ahead = min(reach, depth - reach)
            later = np.zeros(n, np.int64)
            later[: n - ahead] = rank[ahead:] + 1
            key = rank * np.int64(n + 2 + kinds) + later
            order = np.argsort(key)
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]))
            reach += ahead
        self.depth = depth
        self.text = text.astype(np.int32)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=kinds))]).astype(np.int32)
        self.last = WaveletMatrix(self.text[order - 1], kinds)
        # suffixes that share ``depth`` numbers: where they begin and end, and the first place they have in the text
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if n else np.zeros(0, bool)
        self.shared = (np.cumsum(new) - 1).astype(np.int32)
        self.bounds = np.append(np.flatnonzero(new), n).astype(np.int32)
        self.foremost = np.minimum.reduceat(order, self.bounds[:-1]) if n else order

    def matches(self, begin: np.ndarray, words: np.ndarray) -> np.ndarray:
        """For each stretch of the text, and each place in it with ``depth`` words to follow, where these come first.

        Matching statistics, cut off at ``depth``: a stretch is read backwards, each step extends the match by a word
        to the left, and a match that has got too long is cut at the right, which widens its interval of suffixes to
        all that share ``depth`` words. So a stretch takes one step for each of its words.
        """
        order = np.argsort(-words, kind="stable")
        count = np.maximum(words - self.depth + 1, 0)
        slot = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        for i in range(0, len(order), self.AT_ONCE):
            some = order[i : i + self.AT_ONCE]
            ends, size, place = begin[some] + words[some] - 1, words[some], slot[some] + count[some] - 1
            symbol = self.text.take(ends)
            low, high = self.starts.take(symbol), self.starts.take(symbol + 1)
            for step in range(int(size[0])):
                if step:
                    live = int(np.searchsorted(-size, -step, "left"))  # sizes fall; those above ``step`` go on
                    symbol = self.text.take(ends[:live] - step)
                    ranks = self.last.rank(np.concatenate([symbol, symbol]), np.concatenate([low[:live], high[:live]]))
                    base = self.starts.take(symbol)
                    low, high = ranks[:live] + base, ranks[live:] + base
                if step + 1 >= self.depth:
                    shared = self.shared.take(low)
                    low, high = self.bounds.take(shared), self.bounds.take(shared + 1)
                    out[place[: len(low)] - (step + 1 - self.depth)] = self.foremost.take(shared)
        return out


@dataclass
class Stretches:
    """The stretches of a block: runs of windows with one anchor. Places are those of its words."""

    hashes: np.ndarray
    begin: np.ndarray  # each document's first word
    rank: np.ndarray  # each document's place by id
    start: np.ndarray  # first window
    count: np.ndarray  # windows
    anchor: np.ndarray
    inner: np.ndarray  # whether the anchor comes more than once in the stretch, so that it may repeat itself
    first: np.ndarray  # whether no equal stretch of the block is earlier
    sums: np.ndarray
    back: np.ndarray

    def content(self, start: np.ndarray, words: np.ndarray | int) -> np.ndarray:
        words = np.asarray(words).astype(np.uint64)
        return _mix((self.sums[start + words.astype(np.int64)] - self.sums[start]) * self.back[start] + words)

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, at, "right") - 1

    def order(self, *keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order by keys, then by document and place; and which of the ordered rows are the first of their keys."""
        order = np.lexsort((at, self.rank[self.document(at)], *reversed(keys)))
        new = np.zeros(len(order), bool)
        if len(order):
            new[0] = True
        for key in keys:
            sorted_key = key[order]
            new[1:] |= sorted_key[1:] != sorted_key[:-1]
        return order, new


def stretches(row: dict) -> Stretches:
    vocabulary = unsqueeze(row["vocabulary"], np.uint64)
    lengths = unsqueeze(row["lengths"], np.int64)
    hashes = vocabulary[unsqueeze(row["words"], np.uint32)]
    n = len(hashes)
    ends = np.cumsum(lengths)
    ids = np.array([np.iinfo(np.int64).max if i is None else i for i in row["ids"]], np.int64)
    missing = np.array([i is None for i in row["ids"]], bool)
    rank = np.empty(len(ids), np.int64)
    rank[np.lexsort((np.arange(len(ids)), ids, missing))] = np.arange(len(ids))
    powers = np.cumprod(np.full(n + 1, _BASE, np.uint64)) * _BACK
    back = np.cumprod(np.full(n + 1, _BACK, np.uint64)) * _BASE
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(hashes) * powers[:n], dtype=np.uint64)])
    found = Stretches(hashes, ends - lengths, rank, *[np.empty(0, np.int64)] * 2, np.empty(0, np.uint64), *[np.empty(0, bool)] * 2, sums, back)
    # a document without words shares its first place with the next one; searching from the right skips it
    if n < WINDOW:
        return found
    grams = np.zeros(n - ANCHOR + 1, np.uint64)
    for j in range(ANCHOR):
        grams = grams * _BASE + hashes[j : n - ANCHOR + 1 + j]
    grams = _mix(grams)
    least, reach, want = grams, 1, WINDOW - ANCHOR + 1
    while reach < want:
        ahead = min(reach, want - reach)
        least = np.minimum(least[: len(least) - ahead], least[ahead:])
        reach += ahead
    valid = np.arange(n - WINDOW + 1) + WINDOW <= np.repeat(ends, lengths)[: n - WINDOW + 1]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    over = valid.copy()
    over[:-1] &= ~valid[1:] | new[1:]
    found.start = np.flatnonzero(new)
    found.count = np.flatnonzero(over) - found.start + 1
    found.anchor = _mix(least[found.start] ^ _BASE)
    reached = found.count + WINDOW - ANCHOR
    same = grams[_windows(found.start, reached)] == np.repeat(least[found.start], reached)
    found.inner = np.add.reduceat(same.astype(np.int64), np.cumsum(reached) - reached) > 1 if len(reached) else found.inner
    order, first = found.order(found.anchor, found.content(found.start, found.count + WINDOW - 1), at=found.start)
    found.first = np.zeros(len(order), bool)
    found.first[order[first]] = True
    return found


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)


def _anchors(found: Stretches) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(found.anchor[found.first], return_inverse=True)
    return keys, np.bincount(back, 1 + found.inner[found.first], len(keys)).astype(np.int64)


def _ask(shards: int):
    """How many different stretches a block has at each of its anchors; one that may repeat itself counts as two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(batches):
            keys, counts = _anchors(stretches(row))
            edges = np.searchsorted(_shard(keys, shards), np.arange(shards + 1))
            some = [s for s in range(shards) if edges[s] < edges[s + 1]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(some, pa.int32()), pa.array([row["block"]] * len(some), pa.int64()),
                    pa.array([squeeze(np.diff(keys[edges[s] : edges[s + 1]] >> _U(16), prepend=_U(0))) for s in some], pa.binary()),
                    pa.array([squeeze(counts[edges[s] : edges[s + 1]].astype(np.uint32)) for s in some], pa.binary()),
                ],
                ["shard", "block", "data", "more"],
            )

    return run


def _add_up(group: pd.DataFrame) -> pd.DataFrame:
    keys = [np.cumsum(unsqueeze(d, np.uint64)) for d in group["data"]]
    counts = np.concatenate([unsqueeze(d, np.uint32) for d in group["more"]]).astype(np.int64)
    ends = np.cumsum([len(k) for k in keys])
    _, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.minimum(np.bincount(back, counts), 1 << 30).astype(np.uint32)[back]
    data = [squeeze(total[e - n : e]) for e, n in zip(ends, np.diff(ends, prepend=0))]
    return pd.DataFrame({"kind": "totals", "shard": group["shard"], "block": group["block"], "data": data})


@dataclass
class Sent:
    """What a block sends to be searched: pieces of ``count`` windows from ``start``, by shard; and what it knows itself."""

    start: np.ndarray
    count: np.ndarray
    shard: np.ndarray
    known: np.ndarray  # starts of windows that have an earlier equal in the block


def _windows(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _sent(found: Stretches, answers: list[dict], shards: int) -> Sent:
    keys, _ = _anchors(found)
    totals = [unsqueeze(x["data"], np.uint32) for x in sorted(answers, key=lambda x: x["shard"]) if x["kind"] == "totals"]
    total = np.concatenate([*totals, np.empty(0, np.uint32)])
    at = np.minimum(np.searchsorted(keys, found.anchor), max(0, len(keys) - 1))
    many = total[at] if len(keys) else np.zeros(0, np.uint32)
    known = [_windows(found.start[~found.first], found.count[~found.first])]
    plain = found.first & (many > 1) & (many <= HOT)
    start, count, shard = found.start[plain], found.count[plain], _shard(_mix(found.anchor[plain]), shards)
    hot = found.first & (many > HOT)
    each = _windows(found.start[hot], found.count[hot])
    content = found.content(each, WINDOW)
    order, new = found.order(content, at=each)
    known.append(each[order[~new]])
    each, content = each[order[new]], content[order[new]]
    start = np.concatenate([start, each])
    count = np.concatenate([count, np.ones(len(each), np.int64)])
    shard = np.concatenate([shard, _shard(content, shards)])
    order = np.lexsort((start, shard))
    return Sent(start[order], count[order], shard[order], np.concatenate(known))


def _common_words(blocks: DataFrame) -> np.ndarray:
    """The sorted hashes of common words, at most ``COMMON``, found by the blocks in which they are common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(batches):
            vocabulary, words = unsqueeze(row["vocabulary"], np.uint64), unsqueeze(row["words"], np.uint32)
            counts = np.bincount(words, minlength=len(vocabulary))
            out = np.flatnonzero(counts > len(words) / COMMON)
            yield pa.RecordBatch.from_arrays(
                [pa.array(vocabulary[out].view(np.int64)), pa.array(counts[out].astype(np.int64)), pa.array(np.full(len(out), len(words) / len(out) if len(out) else 0.0))],
                ["word", "n", "words"],
            )

    found = pin(blocks.select("vocabulary", "words").mapInArrow(run, "word long, n long, words double"))
    every = found.agg(F.sum("words")).first()[0] or 0
    rows = found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") > every / COMMON).select("word").collect()
    return np.sort(np.array([r["word"] for r in rows], np.int64).view(np.uint64))


def _coded(hashes: np.ndarray, common: np.ndarray) -> tuple[bytes, bytes]:
    """Words as numbers of common ones, and 48 bits of the hashes of the others in their order."""
    at = np.minimum(np.searchsorted(common, hashes), max(0, len(common) - 1)) if len(common) else np.zeros(len(hashes), np.int64)
    hit = common[at] == hashes if len(common) else np.zeros(len(hashes), bool)
    return squeeze(np.where(hit, at + 1, 0).astype(np.uint16)), squeeze(hashes[~hit] >> _U(16))


def _decoded(codes: bytes, rest: bytes, common: np.ndarray) -> np.ndarray:
    numbers = unsqueeze(codes, np.uint16).astype(np.int64)
    hashes = np.concatenate([[_U(0)], common])[numbers]
    hashes[numbers == 0] = unsqueeze(rest, np.uint64)
    return hashes


def _send(shards: int, common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(batches):
            found = stretches(row)
            sent = _sent(found, row["answers"], shards)
            ids = np.array([np.iinfo(np.int64).max if i is None else i for i in row["ids"]], np.int64)
            edges = np.searchsorted(sent.shard, np.arange(shards + 1))
            some = [s for s in range(shards) if edges[s] < edges[s + 1]]
            cols: list[list[bytes]] = [[] for _ in range(6)]
            for s in some:
                start, count = sent.start[edges[s] : edges[s + 1]], sent.count[edges[s] : edges[s + 1]]
                document = found.document(start)
                numbers = (ids[document], found.rank[document].astype(np.uint32),
                           (start - found.begin[document]).astype(np.uint32), count.astype(np.uint32))
                text = _coded(found.hashes[_windows(start, count + WINDOW - 1)], common)
                for col, value in zip(cols, [*map(squeeze, numbers), *text]):
                    col.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array([row["block"]] * len(some), pa.int64()), *[pa.array(c, pa.binary()) for c in cols]],
                ["shard", "block", "ids", "ranks", "places", "counts", "codes", "rest"],
            )

    return run


def _search(group: pd.DataFrame, common: np.ndarray) -> pd.DataFrame:
    """Index a shard's pieces and say for each of their windows whether an equal one starts earlier."""
    col = lambda name, kind: [unsqueeze(d, kind) for d in group[name]]
    counts = col("counts", np.uint32)
    pieces = np.array([len(c) for c in counts])
    count = np.concatenate(counts).astype(np.int64)
    owner = np.repeat(np.arange(len(pieces)), pieces)
    block = group["block"].to_numpy()[owner]
    hashes = np.concatenate([_decoded(c, r, common) for c, r in zip(group["codes"], group["rest"])])
    ids, ranks, places = np.concatenate(col("ids", np.int64)), np.concatenate(col("ranks", np.uint32)), np.concatenate(col("places", np.uint32))
    order = np.lexsort((places, ranks, block, ids))
    kinds, numbers = np.unique(hashes, return_inverse=True)
    words = count + WINDOW - 1
    first = np.cumsum(words) - words
    # the pieces one after the other in the order of documents, each followed by a 0
    size = words[order]
    begin = np.cumsum(size + 1) - (size + 1)
    text = np.zeros(int(size.sum()) + len(size), np.int64)
    text[_windows(begin, size)] = numbers[_windows(first[order], size)] + 1
    index = FMIndex(text, len(kinds) + 1, WINDOW)
    earlier = index.matches(begin, size) < _windows(begin, count[order])
    # back to the order in which each block sent its windows
    windows_before = np.cumsum(count) - count
    result = np.empty(len(earlier), bool)
    result[_windows(windows_before[order], count[order])] = earlier
    ends = np.cumsum(np.bincount(owner, count, len(pieces)).astype(np.int64))
    data = [np.packbits(result[e - n : e]).tobytes() for e, n in zip(ends, np.diff(ends, prepend=0))]
    return pd.DataFrame({"kind": "earlier", "shard": group["shard"], "block": group["block"], "data": data})


def _remove(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(batches):
            answers = row["answers"] or []
            found = stretches(row)
            sent = _sent(found, answers, shards)
            edges = np.searchsorted(sent.shard, np.arange(shards + 1))
            repeated = [sent.known]
            for x in (x for x in answers if x["kind"] == "earlier"):
                own = slice(edges[x["shard"]], edges[x["shard"] + 1])
                start = _windows(sent.start[own], sent.count[own])
                bits = np.unpackbits(np.frombuffer(x["data"], np.uint8), count=len(start)).astype(bool)
                repeated.append(start[bits])
            start = np.concatenate(repeated)
            n = len(found.hashes)
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, start, 1)
            np.add.at(cover, start + WINDOW, -1)
            gone = np.cumsum(cover)[:n] > 0
            spelt = spelt_words(row["spelt"])
            numbers = unsqueeze(row["words"], np.uint32)
            lengths = unsqueeze(row["lengths"], np.int64)
            texts, removed, spans = [], [], []
            for begin, length in zip(found.begin.tolist(), lengths.tolist()):
                out = gone[begin : begin + length]
                kept = numbers[begin : begin + length][~out]
                texts.append(b" ".join([spelt[i] for i in kept.tolist()]).decode())
                removed.append(int(out.sum()))
                edge = np.flatnonzero(np.diff(out, prepend=False, append=False))
                spans.append([{"from": a, "to": b} for a, b in edge.reshape(-1, 2).tolist()])
            kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"], pa.int64()), pa.array(lengths), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(texts)],
                ["doc_id", "n_words", "n_removed", "removed", "kept"],
            )

    return run


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Remove each word of a passage of ``WINDOW`` or more words that also starts earlier in the corpus.

    Earlier means in a document with a smaller id, or at an earlier word of the same one. Returns doc_id, n_words,
    n_removed, ``removed`` (stretches of word positions, ``to`` excluded) and ``kept`` (the other words, joined by one
    space). Words end at ASCII white space.

    Every window belongs to the smallest hash among its runs of ``ANCHOR`` words, its anchor, so equal windows share
    one. Neighbouring windows with one anchor make a stretch. Anchors with a single stretch in the whole corpus, that
    comes once in it, can hold no repeat; the stretches of the others go to the shard of their anchor, where an FM-index is built of them
    and every window is searched in it backwards; windows matched in full are reported as earlier or not. Equal
    stretches of one block of documents are sent once. Where more than ``HOT`` different stretches share an anchor,
    their windows are dealt out one by one by their own content, so no anchor fills a shard.

    Null texts have no words; documents of fewer words than a window keep all; rows with one id are taken in the order
    of their blocks, null ids after all others; an empty table gives no rows; further columns are ignored. Words are
    compared by hashes, of 64 bits in a block and of 48 at least between blocks, so that two windows that differ in one
    word are taken for equal once in 2 ** 48 times.
    """
    shards = parts(docs.sparkSession)
    blocks = pin_by(packed(docs, text, key, full=BLOCK_WORDS), "block")
    asked = blocks.select("block", "ids", "lengths", "vocabulary", "words")
    request = "shard int, block long, data binary, more binary"
    answer = "kind string, shard int, block long, data binary"
    totals = pin(asked.mapInArrow(_ask(shards), request).groupBy("shard").applyInPandas(_add_up, answer))
    gather = lambda df: df.groupBy("block").agg(F.collect_list(F.struct("kind", "shard", "data")).alias("answers"))
    told = asked.join(gather(totals), "block")
    piece = "shard int, block long, ids binary, ranks binary, places binary, counts binary, codes binary, rest binary"
    common = _common_words(blocks)
    sent = told.mapInArrow(_send(shards, common), piece)
    found = pin(sent.groupBy("shard").applyInPandas(lambda group: _search(group, common), answer))
    ready = blocks.drop("held").join(gather(totals.unionByName(found)), "block", "left")
    shape = "doc_id long, n_words long, n_removed long, removed array<struct<from: int, to: int>>, kept string"
    return ready.mapInArrow(_remove(shards), shape)

