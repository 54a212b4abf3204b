"""Toxicity scores by averaged subword embeddings and a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from reelgrid.llm.sampling import labelled

#: Buckets of hashed character n-grams, their length and the size of an embedding.
BUCKETS, SHORT, LONG, DIMS = 1 << 16, 3, 6, 8
#: Words whose embeddings are averaged at once; a text scores as its most toxic window.
WINDOW = 3
#: Labelled documents of each class that a model is fitted on at most.
SAMPLE = 3000
#: Rounds on random windows, and windows of each class in one.
WARM, ROUND = 6, 12_000
#: Words whose scores a task remembers, and words whose subwords are found at once.
REMEMBERED, AT_ONCE = 400_000, 20_000
#: Characters of the longest word that stays whole; a longer one is read in pieces of so many, of which so many overlap.
LONGEST, PIECE, OVERLAP = 50, 16, 8

_EDGES = ".,;:!?\"'()[]{}*#$%&|"


def words_of(text: str) -> list[str]:
    """The words of a text; unspaced runs are cut into overlapping pieces, which are words of their own.

    ``OVERLAP`` is no less than ``LONG`` - 1, so every n-gram of a run lies whole in some piece.
    """
    found = []
    for w in text.lower().split():
        w = w.strip(_EDGES)
        if len(w) <= LONGEST:
            found.append(w)
        else:
            found.extend(w[at : at + PIECE] for at in range(0, len(w) - OVERLAP, PIECE - OVERLAP))
    return found


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) for every character n-gram of every word, and for the word as a whole."""
    marked = [f"<{w}>" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lengths)
    word = np.repeat(np.arange(len(words)), lengths)
    left = ends[word] - np.arange(len(chars))
    found_w, found_b = [], []
    rolling = np.full(len(chars), 1469598103934665603, np.uint64)
    prime = np.uint64(1099511628211)
    for n in range(1, LONG + 1):
        usable = len(chars) - n + 1
        if usable <= 0:
            break
        rolling[:usable] = (rolling[:usable] ^ chars[n - 1 :]) * prime
        if n >= SHORT:
            at = np.flatnonzero(left[:usable] >= n)
            found_w.append(word[at])
            found_b.append(rolling[at] + np.uint64(n))
    whole = np.zeros(len(words), np.uint64)
    if len(chars):
        place = np.arange(len(chars), dtype=np.uint64)
        mixed = (chars + np.uint64(977)) * (prime ** ((place - (ends - lengths)[word].astype(np.uint64)) % np.uint64(61) + np.uint64(1)))
        whole = np.add.reduceat(mixed, ends - lengths) if len(words) else whole
    found_w.append(np.arange(len(words)))
    found_b.append(whole)
    buckets = np.concatenate(found_b)
    buckets = (buckets ^ (buckets >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.concatenate(found_w), ((buckets >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)


def word_scores(words: list[str], bucket_scores: np.ndarray) -> np.ndarray:
    """The mean of a word's subword scores; as the softmax is linear, embeddings need not be averaged first."""
    word, bucket = subwords(words)
    return np.bincount(word, bucket_scores[bucket], len(words)) / np.maximum(np.bincount(word, minlength=len(words)), 1)


def windows(scores: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The mean score of the ``WINDOW`` words that end at each word, fewer at a text's start."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    at = np.arange(len(scores))
    begin = np.concatenate([[0], ends[:-1]])
    first = np.maximum(at - WINDOW + 1, np.repeat(begin, ends - begin))
    return (total[at + 1] - total[first]) / WINDOW


@dataclass
class Model:
    """Scores of buckets under the softmax, and the line from a text's greatest window to its log odds."""

    buckets: np.ndarray
    slope: float
    offset: float

    def log_odds(self, texts: list[str], known: dict[str, float]) -> np.ndarray:
        tokens = [words_of(t) for t in texts]
        fresh = list({w for words in tokens for w in words} - known.keys())
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
            fresh = list({w for words in tokens for w in words})
        for start in range(0, len(fresh), AT_ONCE):
            some = fresh[start : start + AT_ONCE]
            known.update(zip(some, word_scores(some, self.buckets).tolist()))
        flat = np.fromiter((known[w] for words in tokens for w in words), np.float64)
        counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
        best = np.zeros(len(texts))
        if len(flat):
            ends = np.cumsum(counts)
            has = counts > 0
            best[has] = np.maximum.reduceat(windows(flat, ends), (ends - counts)[has])
        return self.slope * best + self.offset


def train(texts: list[str], y: np.ndarray, stand_for: np.ndarray, seed: int = 5) -> Model:
    """Learn embeddings and softmax together, with Adam and a fixed seed.

    A toxic text holds a toxic window somewhere, a clean one holds none. So after some rounds on random windows, each
    round learns from the window of every text that scores highest so far, and from random ones of the clean texts.
    """
    draw = np.random.default_rng(seed)
    place: dict[str, int] = {}
    tokens = [np.array([place.setdefault(w, len(place)) for w in words_of(t)] or [-1], np.int64) for t in texts]
    keep = np.flatnonzero([t[0] >= 0 for t in tokens])
    tokens, y, stand_for = [tokens[i] for i in keep], y[keep], stand_for[keep]
    vocabulary = list(place)
    buckets, lengths = [], []
    for start in range(0, len(vocabulary), AT_ONCE):
        some = vocabulary[start : start + AT_ONCE]
        word, found = subwords(some)
        buckets.append(found[np.argsort(word, kind="stable")].astype(np.uint16))
        lengths.append(np.bincount(word, minlength=len(some)))
    bucket, many = np.concatenate(buckets), np.concatenate(lengths)
    first = np.cumsum(many) - many
    flat = np.concatenate(tokens)
    ends = np.cumsum([len(t) for t in tokens])
    starts = np.concatenate([[0], ends[:-1]])

    embedding = draw.normal(0, 0.1, (BUCKETS, DIMS)).astype(np.float32)
    soft = draw.normal(0, 0.3, (DIMS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    params = [embedding, soft, bias]
    one, two = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    t = 0

    def step(window_ends: np.ndarray, begin: np.ndarray, label: np.ndarray, rate: float) -> None:
        nonlocal t
        t += 1
        n = len(label)
        back = window_ends[:, None] - np.arange(WINDOW)[None, :]
        row, _ = np.nonzero(back >= begin[:, None])
        words = flat[back[back >= begin[:, None]]]
        length = many[words]
        at = np.repeat(first[words] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        gram, owner = bucket[at], np.repeat(row, length)
        share = (1.0 / (np.repeat(length, length) * WINDOW)).astype(np.float32)
        mean = np.stack([np.bincount(owner, share * embedding[gram, d], n) for d in range(DIMS)], 1).astype(np.float32)
        logit = mean @ soft + bias
        p = np.exp(logit - logit.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), label] -= 1
        p /= n
        back_to = p @ soft.T
        grad = np.stack([np.bincount(gram, share * back_to[owner, d], BUCKETS) for d in range(DIMS)], 1).astype(np.float32)
        for w, g, m, v in zip(params, (grad, mean.T @ p, p.sum(0)), one, two):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)

    def best() -> np.ndarray:
        own = embedding @ (soft[:, 1] - soft[:, 0])
        per_word = np.empty(len(place))
        for start in range(0, len(place), AT_ONCE):
            some = many[start : start + AT_ONCE]
            scores = own[bucket[first[start] : first[start] + some.sum()]]
            per_word[start : start + AT_ONCE] = np.bincount(np.repeat(np.arange(len(some)), some), scores, len(some)) / some
        scored = windows(per_word[flat], ends)
        return np.array([s + int(np.argmax(scored[s:e])) for s, e in zip(starts, ends)]), scored

    anywhere = lambda at: starts[at] + (draw.random(len(at)) * (ends[at] - starts[at])).astype(np.int64)
    everyone = np.arange(len(y))
    for epoch in range(WARM + 10):
        some = anywhere(everyone)
        if epoch < WARM:  # as many windows of toxic texts as of clean ones, whatever their numbers
            at = np.concatenate([np.repeat(np.flatnonzero(y == c), max(1, ROUND // max(1, int((y == c).sum())))) for c in (0, 1)])
            chosen, begin, label = anywhere(at), starts[at], y[at]
        else:
            clean = y == 0
            chosen = np.concatenate([best()[0], some[clean]])
            begin, label = np.concatenate([starts, starts[clean]]), np.concatenate([y, y[clean]])
        shuffled = draw.permutation(len(label))
        for s in range(0, len(label), 512):
            b = shuffled[s : s + 512]
            step(chosen[b], begin[b], label[b].astype(np.int64), 0.02 if epoch < WARM + 6 else 0.005)

    at, scored = best()
    top = scored[at]
    # one line from the greatest window to the log odds, with classes at their share of all labels
    weight = stand_for / stand_for.mean()
    spread = float(top.std()) or 1.0
    z = (top - top.mean()) / spread
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        off, curve = weight * (p - y), weight * p * (1 - p) + 1e-9
        hess = np.array([[(curve * z * z).sum() + 0.1, (curve * z).sum()], [(curve * z).sum(), curve.sum()]])
        da, db = np.linalg.solve(hess, [(off * z).sum() + 0.1 * a, off.sum()])
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
    return Model(embedding.astype(np.float64) @ (soft[:, 1] - soft[:, 0]), float(a / spread), float(b - a * top.mean() / spread))


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [row for batch in batches for row in batch.to_pylist()]
    if not rows:
        return
    rows.sort(key=lambda r: (str(r["id"]), r["text"] or ""))
    y = np.array([r["label"] for r in rows], np.int64)
    share = float(np.clip(y.mean(), 0.01, 0.99))
    model = Model(np.zeros(BUCKETS), 0.0, float(np.log(share / (1 - share))))
    texts = [r["text"] or "" for r in rows]
    stand_for = np.array([r["stand_for"] for r in rows])
    del rows
    if 0 < y.mean() < 1 and any(t.split() for t in texts):
        model = train(texts, y, stand_for)
    parts = [pa.array([model.buckets.tobytes()]), pa.array([model.slope]), pa.array([model.offset])]
    yield pa.RecordBatch.from_arrays(parts, ["buckets", "slope", "offset"])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", most: int = SAMPLE) -> Model:
    """Learn toxicity (1 toxic, 0 clean) from at most ``most`` labelled, not held-out documents of each class.

    The bounded sample is fitted in one task; the driver gets the model alone. Without documents of both classes the
    model gives every text the share of toxic labels, or 0.5 without labels.
    """
    rows, stand_for = labelled(docs, labels, "toxic", most)
    weight = F.when(F.col("_label") == 1, F.lit(float(stand_for.get(1, 1)))).otherwise(F.lit(float(stand_for.get(0, 1))))
    sample = rows.select(
        F.col("_id").cast("string").alias("id"), F.col(f"`{text}`").cast("string").alias("text"),
        F.col("_label").cast("long").alias("label"), weight.alias("stand_for"),
    )
    got = sample.repartition(1).mapInArrow(_train_task, "buckets binary, slope double, offset double").collect()
    if not got:
        return Model(np.zeros(BUCKETS), 0.0, 0.0)
    return Model(np.frombuffer(bytes(got[0]["buckets"])), got[0]["slope"], got[0]["offset"])


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            odds = [model.log_odds(texts[s : s + 200], known) for s in range(0, len(texts), 200)]
            scores = 1 / (1 + np.exp(-np.clip(np.concatenate(odds or [np.zeros(0)]), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["_kept", "score"])

    return run


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``score``, 0 to 1, to the columns ``keep`` (all, if not given).

    Every row is scored over its whole text, by itself: repeated rows repeat, null and empty texts get the score of a
    text without words, an empty table stays empty. A column named score is replaced.
    """
    own = [c for c in (keep or docs.columns) if c != "score"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_kept"), F.col(f"`{text}`").cast("string").alias("_text"))
    shape = StructType([rows.schema["_kept"], StructField("score", DoubleType())])
    return rows.mapInArrow(_score(model), shape).select("_kept.*", "score")
