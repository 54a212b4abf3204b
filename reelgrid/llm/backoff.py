"""Log-probabilities of documents from a weighted backoff automaton."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.blocks import packed, squeeze, unsqueeze
from reelgrid.llm.shared import parts, pin, pin_by

#: Hashes of the end of a text and of its start; words' hashes are told from them by their own value only.
END, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Tokens that one lane of the traversal reads.
LANE = 128

_SHAPE = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def _tokens(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's vocabulary with both marks, the tokens with starts and ends, and each document's first and last place."""
    vocabulary = np.concatenate([unsqueeze(row["vocabulary"], np.uint64), [END, START]])
    lengths = unsqueeze(row["lengths"], np.int64)
    words = unsqueeze(row["words"], np.uint32).astype(np.int64)
    begin = np.cumsum(lengths + 2) - (lengths + 2)
    line = np.empty(len(words) + 2 * len(lengths), np.int64)
    inner = np.ones(len(line), bool)
    inner[begin] = inner[begin + lengths + 1] = False
    line[inner] = words
    line[begin], line[begin + lengths + 1] = len(vocabulary) - 1, len(vocabulary) - 2
    return vocabulary, line, begin, begin + lengths + 1


def _arcs(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All different neighbours of a block, by their places in its vocabulary, and how often training texts have them."""
    vocabulary, line, first, last = _tokens(row)
    trained = np.repeat(~np.array(row["held"], bool), last - first + 1)
    after = np.ones(len(line), bool)
    after[first] = False
    at = np.flatnonzero(after)
    size = np.int64(len(vocabulary))
    pairs, back = np.unique(line[at - 1] * size + line[at], return_inverse=True)
    return vocabulary, pairs // size, pairs % size, np.bincount(back, trained[at], len(pairs)).astype(np.int64), line


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _pair_order(vocabulary: np.ndarray, a: np.ndarray, b: np.ndarray, shards: int, common: np.ndarray):
    """The order in which a block's pairs are sent, by shard and as they are in it; and the shard of each.

    Pairs go to the shard of their first word, so that it can count what follows the word. What follows a common word
    is dealt out by the second word instead, and its counts are added up later.
    """
    left, right = vocabulary[a], vocabulary[b]
    shard = _shard(np.where(np.isin(left, common), right * np.uint64(0x9E3779B97F4A7C15), left), shards)
    order = np.argsort(shard.astype(np.uint16) if shards < 1 << 16 else shard, kind="stable")
    return order, shard[order]


def _ask_pairs(shards: int, common: list[int]):
    marked = np.array(common, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                vocabulary, a, b, counts, _ = _arcs(row)
                order, shard = _pair_order(vocabulary, a, b, shards, marked)
                edges = np.searchsorted(shard, np.arange(shards + 1))
                some = [s for s in range(shards) if edges[s] < edges[s + 1]]
                cols = [[], [], [], []]
                for s in some:
                    own = order[edges[s] : edges[s + 1]]
                    left = vocabulary[a[own]]
                    new = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]]))
                    cols[0].append(squeeze(np.diff(left[new], prepend=np.uint64(0))))
                    cols[1].append(squeeze(np.diff(np.append(new, len(own))).astype(np.uint32)))
                    cols[2].append(squeeze(vocabulary[b[own]] >> np.uint64(24)))
                    cols[3].append(squeeze(counts[own].astype(np.uint32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([row["block"]] * len(some), pa.int64()), *map(pa.array, cols)],
                    ["shard", "block", "left", "runs", "right", "counts"],
                )

    return run


def _merge_pairs(group: pd.DataFrame) -> pd.DataFrame:
    """Add up a shard's pairs: each block gets its pairs' counts back, words get how many others follow them."""
    left = [np.repeat(np.cumsum(unsqueeze(d, np.uint64)), unsqueeze(r, np.uint32)) for d, r in zip(group["left"], group["runs"])]
    right = [unsqueeze(d, np.uint64) for d in group["right"]]
    counts = np.concatenate([unsqueeze(d, np.uint32) for d in group["counts"]]).astype(np.int64)
    ends = np.cumsum([len(x) for x in left])
    all_left, all_right = np.concatenate(left), np.concatenate(right)
    del left, right
    order = np.lexsort((all_right, all_left))
    l, r = all_left[order], all_right[order]
    new = np.concatenate([[True], (l[1:] != l[:-1]) | (r[1:] != r[:-1])])
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    total = np.bincount(back, counts).astype(np.int64)
    answers = [squeeze(total[back[e - n : e]].astype(np.uint32)) for e, n in zip(ends, np.diff(ends, prepend=0))]
    seen = total > 0
    first = l[new][seen]
    start = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])) if len(first) else np.empty(0, np.int64)
    shard = int(group["shard"].iloc[0])
    out = pd.DataFrame({"kind": "pairs", "shard": shard, "block": group["block"], "data": answers, "more": b"", "n": 0, "v": 0})
    follow = {
        "kind": "follow", "shard": shard, "block": -1, "data": squeeze(first[start]),
        "more": squeeze(np.diff(np.append(start, len(first))).astype(np.uint32)),
        "n": int((total == 1).sum()), "v": int((total == 2).sum()),
    }
    return pd.concat([out, pd.DataFrame([follow])], ignore_index=True)


def _trained_counts(row: dict) -> tuple[np.ndarray, np.ndarray]:
    vocabulary, line, first, last = _tokens(row)
    trained = np.repeat(~np.array(row["held"], bool), last - first + 1)
    return vocabulary, np.bincount(line, trained, len(vocabulary)).astype(np.int64)


def _ask_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                vocabulary, counts = _trained_counts(row)
                order = np.argsort(vocabulary, kind="stable")
                edges = np.searchsorted(_shard(vocabulary[order], shards), np.arange(shards + 1))
                some = [s for s in range(shards) if edges[s] < edges[s + 1]]
                own = [order[edges[s] : edges[s + 1]] for s in some]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(["words"] * len(some)), pa.array(some, pa.int32()), pa.array([row["block"]] * len(some), pa.int64()),
                        pa.array([squeeze(vocabulary[o]) for o in own]), pa.array([squeeze(counts[o].astype(np.uint32)) for o in own]),
                    ],
                    ["kind", "shard", "block", "data", "more"],
                )

    return run


def _spread_follow(shards: int):
    """Deal the numbers of followers out to the shards of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, many = unsqueeze(row["data"], np.uint64), unsqueeze(row["more"], np.uint32)
                edges = np.searchsorted(_shard(words, shards), np.arange(shards + 1))
                some = [s for s in range(shards) if edges[s] < edges[s + 1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(["follow"] * len(some)), pa.array(some, pa.int32()), pa.array([-1] * len(some), pa.int64()),
                        pa.array([squeeze(words[edges[s] : edges[s + 1]]) for s in some]),
                        pa.array([squeeze(many[edges[s] : edges[s + 1]]) for s in some]),
                    ],
                    ["kind", "shard", "block", "data", "more"],
                )

    return run


def _merge_words(group: pd.DataFrame) -> pd.DataFrame:
    """Add up a shard's words: each block gets back how often its words occur and how many words follow them."""
    words = [unsqueeze(d, np.uint64) for d in group["data"]]
    values = np.concatenate([unsqueeze(d, np.uint32) for d in group["more"]]).astype(np.int64)
    ends = np.cumsum([len(w) for w in words])
    sizes = np.diff(ends, prepend=0)
    follow = np.repeat((group["kind"] == "follow").to_numpy(), sizes)
    keys, back = np.unique(np.concatenate(words), return_inverse=True)
    count = np.bincount(back, values * ~follow, len(keys)).astype(np.int64)
    after = np.bincount(back, values * follow, len(keys)).astype(np.int64)
    own = np.flatnonzero((group["kind"] == "words").to_numpy())
    at = [back[ends[i] - sizes[i] : ends[i]] for i in own]
    shard = int(group["shard"].iloc[0])
    out = pd.DataFrame({
        "kind": "words", "shard": shard, "block": group["block"].to_numpy()[own],
        "data": [squeeze(count[a]) for a in at], "more": [squeeze(after[a]) for a in at], "n": 0, "v": 0,
    })
    real = keys != START
    sums = {"kind": "sums", "shard": shard, "block": -1, "data": b"", "more": b"", "n": int(count[real].sum()), "v": int((count[real] > 0).sum())}
    return pd.concat([out, pd.DataFrame([sums])], ignore_index=True)


class Automaton:
    """States are the empty history (the last) and every word that training texts have; arcs are known pairs.

    An arc weighs its pair's log-probability, a state's failure arc leads to the empty history and weighs what the
    state leaves for other words. With discount d and t different followers of a word seen c times, a pair seen n
    times has (n - d + d t p) / c and the failure arc d t / c, where p is the single word's probability; all that can
    follow sums to one.
    """

    def __init__(self, counts, followers, a, b, pairs, total, kinds, discount):
        self.size = np.int64(len(counts))
        single = (counts + 1) / (total + kinds + 1)
        self.word = np.log10(single)
        self.known = counts > 0
        some = np.flatnonzero((pairs > 0) & (counts[a] > 0))
        a, b, pairs = a[some], b[some], pairs[some]
        self.arcs = a * self.size + b
        left = discount * followers[a] / counts[a]
        self.weight = np.log10((pairs - discount) / counts[a] + left * single[b])
        self.failure = np.zeros(len(counts) + 1)
        leaves = np.flatnonzero((counts > 0) & (followers > 0))
        self.failure[leaves] = np.log10(discount * followers[leaves] / counts[leaves])
        self.root = len(counts)

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Follow an arc, or the failure arc and then one of the empty history: weights and the states reached."""
        key = state * self.size + token
        at = np.minimum(np.searchsorted(self.arcs, key), max(0, len(self.arcs) - 1))
        hit = (self.arcs[at] == key) & (state != self.root) if len(self.arcs) else np.zeros(len(key), bool)
        weight = np.where(hit, self.weight[at] if len(self.arcs) else 0.0, self.failure[state] + self.word[token])
        return weight, np.where(self.known[token], token, self.root)

    def weights(self, line: np.ndarray, start: int) -> np.ndarray:
        """The weight of each token, read from left to right; ``start`` marks where texts begin and weighs nothing.

        The line is cut into lanes that are read side by side. A state depends on the last token alone, so a lane
        starts in the state of the token before it.
        """
        lanes = -(-len(line) // LANE)
        grid = np.full(lanes * LANE, start, np.int64)
        grid[: len(line)] = line
        grid = grid.reshape(lanes, LANE)
        before = np.concatenate([[start], grid[:-1, -1]])
        state = np.where(self.known[before], before, self.root)
        out = np.zeros(grid.shape)
        for column in range(LANE):
            weight, state = self.step(state, grid[:, column])
            out[:, column] = np.where(grid[:, column] == start, 0.0, weight)
        return out.reshape(-1)[: len(line)]


def _score(shards: int, common: list[int], total: int, kinds: int, discount: float):
    marked = np.array(common, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                vocabulary, a, b, _, line = _arcs(row)
                answers = sorted(row["answers"], key=lambda x: x["shard"])
                words = [x for x in answers if x["kind"] == "words"]
                join = lambda some, c, kind: np.concatenate([unsqueeze(x[c], kind) for x in some] or [np.empty(0, kind)])
                order = np.argsort(vocabulary, kind="stable")
                counts, followers = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
                counts[order], followers[order] = join(words, "data", np.int64), join(words, "more", np.int64)
                sent, _ = _pair_order(vocabulary, a, b, shards, marked)
                pairs = np.zeros(len(a), np.int64)
                pairs[sent] = join([x for x in answers if x["kind"] == "pairs"], "data", np.uint32)
                automaton = Automaton(counts, followers, a, b, pairs, total, kinds, discount)
                lengths = unsqueeze(row["lengths"], np.int64)
                begin = np.cumsum(lengths + 2) - (lengths + 2)
                start = len(vocabulary) - 1
                real = line != start
                base = np.where(real, np.log10((counts[line] + 1) / (total + kinds + 1)), 0.0)
                add = lambda x: np.add.reduceat(x, begin)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(lengths + 1),
                        pa.array(add((real & (counts[line] > 0)).astype(np.int64))),
                        pa.array(np.full(len(lengths), total, np.int64)), pa.array(add(base)),
                        pa.array(add(automaton.weights(line, start))),
                    ],
                    [c.split()[0] for c in _SHAPE.split(", ")],
                )

    return run


def score(docs: DataFrame, held: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Log10-probabilities of all documents under a bigram model of those that aren't ``held`` out.

    Words are lower-cased (A-Z) and end at ASCII white space; each text ends with one end token. Returns doc_id,
    held_out, n_tokens, n_known (tokens that training texts have), train_tokens, ``base_score`` (single words, add-one)
    and ``score`` (the automaton's).

    Documents are packed into blocks. Each block asks the shards of all pairs and of all words for the corpus counts of
    those it holds, sums are handed back in the order asked, and the block builds the automaton of its own words and
    reads its texts from left to right. What is sent grows with the different pairs of each block. Words that follow a
    very common word are dealt out by themselves; the list of such words is bounded by the number of shards.

    Null and empty texts consist of the end token; null ids learn, if ``held`` is null or false for them; repeated rows
    count and are scored each; an empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    shards = parts(spark)
    blocks = pin_by(packed(docs, text, key, F.coalesce(held, F.lit(False)), lower=True), "block")
    common = _common_words(blocks, shards)
    asked = blocks.select("block", "held", "lengths", "vocabulary", "words")
    request = "shard int, block long, left binary, runs binary, right binary, counts binary"
    answer = "kind string, shard int, block long, data binary, more binary, n long, v long"
    pairs = pin(asked.mapInArrow(_ask_pairs(shards, common), request).groupBy("shard").applyInPandas(_merge_pairs, answer))
    follow = pairs.filter("kind = 'follow'")
    once, twice = follow.agg(F.sum("n"), F.sum("v")).first()
    five = "kind string, shard int, block long, data binary, more binary"
    sent = asked.mapInArrow(_ask_words(shards), five).unionByName(follow.select("data", "more").mapInArrow(_spread_follow(shards), five))
    words = pin(sent.groupBy("shard").applyInPandas(_merge_words, answer))
    total, kinds = words.filter("kind = 'sums'").agg(F.sum("n"), F.sum("v")).first()
    discount = (once or 0) / max(1, (once or 0) + 2 * (twice or 0))
    discount = min(max(discount, 0.1), 0.9)
    back = pairs.filter("kind = 'pairs'").unionByName(words.filter("kind = 'words'"))
    back = back.groupBy("block").agg(F.collect_list(F.struct("kind", "shard", "data", "more")).alias("answers"))
    ready = blocks.drop("spelt").join(back, "block")
    return ready.mapInArrow(_score(shards, common, total or 0, kinds or 0, discount), _SHAPE)


def _common_words(blocks: DataFrame, shards: int) -> list[int]:
    """Hashes of words that make up more than about an eighth of a shard's share, by the blocks they stand out in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                vocabulary, line, *_ = _tokens(row)
                counts = np.bincount(line, minlength=len(vocabulary))
                out = np.flatnonzero(counts > len(line) / (8 * shards))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(vocabulary[out].view(np.int64)), pa.array(counts[out].astype(np.int64)), pa.array(np.full(len(out), len(line)))],
                    ["word", "n", "tokens"],
                )

    found = pin(blocks.select("lengths", "vocabulary", "words").mapInArrow(run, "word long, n long, tokens long"))
    every = found.filter(F.col("word") == int(START.astype(np.int64))).agg(F.sum("tokens")).first()[0] or 0
    rows = found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") > every / (8 * shards)).select("word").collect()
    return [int(np.int64(r["word"]).astype(np.uint64)) for r in rows]
