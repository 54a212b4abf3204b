"""Quality scores by a factorisation machine."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from reelgrid.llm.sampling import labelled

#: Hashed words, bins of each statistic, rank of the pairwise interactions.
WORDS, BINS, RANK = 2048, 12, 8
#: Labelled documents of each class that a model is fitted on at most.
SAMPLE = 5000

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = b"0123456789"
_MARK = bytes(c for c in range(33, 127) if not chr(c).isalnum())
STATS = 14


def statistics(text: str, chars: int | None) -> tuple[np.ndarray, Counter]:
    """Structure statistics of a text, and its words with their counts."""
    raw = text.encode()
    words = raw.split()
    counts = Counter(words)
    size, n = max(1, len(raw)), max(1, len(words))
    left = lambda drop: size - len(raw.translate(None, drop)) if raw else 0
    upper, lower, marks = left(_UPPER), left(_LOWER), left(_MARK)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    top = max(counts.values(), default=0)
    values = [
        np.log1p(len(words)), np.log1p(len(text) if chars is None else max(0, chars)), len(counts) / n, top / n,
        sum(map(eq, words, words[1:])) / n, upper / max(1, upper + lower), marks / size, left(_DIGIT) / size,
        raw.count(b"\n") / n, lengths.mean(), lengths.std(), raw.count(b"|") / n,
        (raw.count(b"!!") + raw.count(b"**") + raw.count(b"##") + raw.count(b"$$") + raw.count(b"%%") + raw.count(b"&&")) / n,
        sum(c for c in counts.values() if c > 3) / n,
    ]
    return np.array(values, np.float64), counts


def _hashed(counts: Counter) -> tuple[np.ndarray, np.ndarray]:
    at = np.fromiter((zlib.crc32(w.lower()) % WORDS for w in counts), np.int64, len(counts))
    return at, np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))


@dataclass
class Model:
    """A factorisation machine over hashed words and binned statistics."""

    cuts: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def inputs(self, documents: list[tuple[str, int | None]]) -> np.ndarray:
        x = np.zeros((len(documents), WORDS + STATS * BINS), np.float32)
        for i, (text, chars) in enumerate(documents):
            values, counts = statistics(text, chars)
            at, weight = _hashed(counts)
            fill(x[i], values, at, weight, self.cuts)
        return x

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(machine(x, self.bias, self.linear, self.factors)[0], -30, 30)))


def fill(row: np.ndarray, values: np.ndarray, at: np.ndarray, weight: np.ndarray, cuts: np.ndarray) -> None:
    np.add.at(row, at, weight.astype(np.float32))
    norm = np.sqrt(float((row[:WORDS] ** 2).sum()))
    if norm:
        row[:WORDS] *= 1 / norm
    for s in range(STATS):
        row[WORDS + s * BINS + int(np.searchsorted(cuts[s], values[s], "right"))] = 0.5


def machine(x: np.ndarray, bias: float, linear: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits, and the sums over factors. Pairs cost linear time: half of (sum v x)^2 - sum (v x)^2."""
    sums = x @ factors
    pairs = 0.5 * (sums**2 - (x**2) @ (factors**2)).sum(1)
    return bias + x @ linear + pairs, sums


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cuts: np.ndarray, epochs: int = 30, seed: int = 3) -> Model:
    """Fit by Adam on the weighted log loss, with a fixed seed."""
    draw = np.random.default_rng(seed)
    size = x.shape[1]
    params = [np.zeros(1, np.float32), np.zeros(size, np.float32), draw.normal(0, 0.05, (size, RANK)).astype(np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    t = 0
    for _ in range(epochs):
        order = draw.permutation(len(y))
        for start in range(0, len(y), 256):
            b = order[start : start + 256]
            xb, t = x[b], t + 1
            logit, sums = machine(xb, float(params[0][0]), params[1], params[2])
            off = (weight[b] * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[b])).astype(np.float32) / len(b)
            pull = off[:, None] * xb
            grads = [
                off.sum(keepdims=True),
                pull.sum(0) + 2e-5 * params[1],
                pull.T @ sums - (pull * xb).sum(0)[:, None] * params[2] + 2e-5 * params[2],
            ]
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(cuts, float(params[0][0]), params[1], params[2])


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, chars, label in zip(*(batch.column(i).to_pylist() for i in range(3))):
            values, counts = statistics(text or "", chars)
            at, weight = _hashed(counts)
            rows.append((values.tobytes(), at.astype(np.int16).tobytes(), weight.astype(np.float32).tobytes(), label))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], ["stats", "at", "weight", "label"])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", chars: str = "n_chars", most: int = SAMPLE) -> Model:
    """Learn quality (1 good, 0 bad) from at most ``most`` labelled, not held-out documents of each class.

    Inputs are the words of a text, statistics of its structure and its length; executors turn the sample into numbers
    and the driver fits them. Classes are weighted back to their share of all labels. Without documents of both
    classes the model gives every text the share of good labels, or 0.5 without labels.
    """
    rows, stand_for = labelled(docs, labels, "quality", most)
    numbers = rows.select(
        F.col(f"`{text}`").cast("string"), F.col(f"`{chars}`").cast("long"), F.col("_label").cast("long"), F.col("_id")
    )
    got = numbers.mapInArrow(_numbers, "stats binary, at binary, weight binary, label long").toPandas()
    got = got.sort_values(["label", "stats", "at"], kind="stable")
    y = got["label"].to_numpy(np.float32)
    stats = np.array([np.frombuffer(s) for s in got["stats"]]).reshape(len(got), STATS)
    flat = np.zeros((STATS, BINS - 1))
    if len(set(y.tolist())) < 2:
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        size = WORDS + STATS * BINS
        return Model(flat, float(np.log(share / (1 - share))), np.zeros(size, np.float32), np.zeros((size, RANK), np.float32))
    # half of the cuts follow each class, so that a rare class is resolved too
    marks = [np.quantile(stats[y == c], np.linspace(0.02, 0.98, k), axis=0) for c, k in ((0, 5), (1, BINS - 6))]
    cuts = np.sort(np.concatenate(marks).T, axis=1)
    x = np.zeros((len(got), WORDS + STATS * BINS), np.float32)
    for i, (a, w) in enumerate(zip(got["at"], got["weight"])):
        fill(x[i], stats[i], np.frombuffer(a, np.int16).astype(np.int64), np.frombuffer(w, np.float32), cuts)
    shares = np.array([stand_for[int(c)] for c in y], np.float32)
    return train(x, y, shares / shares.mean(), cuts)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.column(0)
            texts, chars = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            scores = []
            for start in range(0, len(texts), 256):
                part = [(t or "", c) for t, c in zip(texts[start : start + 256], chars[start : start + 256])]
                scores.append(model.score(model.inputs(part)).astype(np.float64))
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([kept, pa.array(scores, pa.float64())], ["_kept", "score"])

    return run


def score(docs: DataFrame, model: Model, text: str = "text", chars: str = "n_chars", keep: list[str] | None = None) -> DataFrame:
    """Add ``score``, 0 to 1, to the columns ``keep`` (all, if not given).

    Every row is scored over its whole text, by itself: repeated rows repeat, null texts count as empty, a null length
    is read off the text, an empty table stays empty. A column named score is replaced.
    """
    own = [c for c in (keep or docs.columns) if c != "score"]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("_kept"),
        F.col(f"`{text}`").cast("string").alias("_text"),
        F.col(f"`{chars}`").cast("long").alias("_chars"),
    )
    shape = StructType([rows.schema["_kept"], StructField("score", DoubleType())])
    return rows.mapInArrow(_score(model), shape).select("_kept.*", "score")
