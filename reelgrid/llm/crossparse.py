"""Language identification by cross-parsing: the language whose sample spells a text in the fewest phrases.

A suffix automaton of each language's sample accepts just the passages of that sample. A text is parsed greedily: each
phrase is the longest passage found in the sample from where the last one ended, or a single unknown letter. Phrases
times the bits of naming a place in the sample, by letter, estimate how badly the language's sample explains the text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from reelgrid.llm.shared import pin

#: Letters of a language's sample, at most; it is made of up to PIECES pieces of PIECE characters, PER_TEXT of a text.
SAMPLE, PIECES, PIECE, PER_TEXT = 40_000, 512, 400, 4
#: Letters parsed as one; no phrase crosses the end of such a stretch, so stretches of all texts are parsed side by side.
STRETCH = 1024
#: Stretches parsed side by side, and characters that are turned into letters at once (or one whole text).
LANES, CHARACTERS = 2048, 1 << 21
#: Letters from which on more text doesn't make a prediction surer.
SURE = 20

#: Letters by number: not a letter, the border between two pieces, a letter no sample has; then those of all samples.
GAP, BORDER, UNKNOWN, FIRST = 0, 1, 2, 3
_CODES = 0x110000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter or a mark that belongs to one."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(_CODES)), bool, _CODES)


def spell(texts: list[str], numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letters of lower-cased texts, one after the other, and how many each text has.

    ``numbers`` gives each code point its letter. A run of other characters counts as one gap; a text starts with a gap
    and has none at its end; a text without letters has nothing.
    """
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    found = numbers[codes]
    gap = found == GAP
    keep = ~gap
    keep[:-1] |= gap[:-1] & ~gap[1:]
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lowered])])
    before = np.concatenate([[0], np.cumsum(keep)])
    return found[keep], np.diff(before[starts])


def automaton(letters: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The steps (from, letter, to) of the suffix automaton of a sequence; state 0 is its start."""
    steps: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in letters:
        new = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(steps)
                steps.append(dict(steps[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    size = [len(s) for s in steps]
    origin = np.repeat(np.arange(len(steps)), size)
    letter = np.fromiter((c for s in steps for c in s), np.int64, len(origin))
    target = np.fromiter((t for s in steps for t in s.values()), np.int64, len(origin))
    return origin, letter, target


def packed(origin: np.ndarray, letter: np.ndarray, target: np.ndarray, letters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps as arrays: the step of a state by a letter is at ``base[state] + letter`` if ``owner`` there is the state."""
    states = int(origin.max(initial=0)) + 1
    count = np.bincount(origin, minlength=states)
    first = np.concatenate([[0], np.cumsum(count)])
    base = np.zeros(states, np.int64)
    room = 2 * (len(origin) + letters) + 64
    used = bytearray(room)
    low = letters
    for state in np.argsort(-count, kind="stable").tolist():
        if count[state] < 2:
            break
        mine = letter[first[state] : first[state + 1]].tolist()
        tries, at = 0, low
        while True:
            if at + 2 * letters > len(used):
                used.extend(bytes(len(used)))
            if not any(used[at + c] for c in mine):
                break
            at += 1
            tries += 1
        # the dense beginning is left behind
        low = at - 32 if tries > 64 else low
        base[state] = at
        for c in mine:
            used[at + c] = 1
    alone = np.flatnonzero(count == 1)
    own = letter[first[alone]]
    free = np.flatnonzero(np.frombuffer(bytes(used), np.uint8)[letters:] == 0) + letters
    if len(free) < len(alone):
        free = np.concatenate([free, np.arange(len(used), len(used) + len(alone) - len(free))])
    base[alone] = free[: len(alone)] - own
    slots = base[origin] + letter
    size = int(max(slots.max(initial=0), base.max(initial=0) + letters)) + 1
    owner, to = np.full(size, -1, np.int64), np.zeros(size, np.int64)
    owner[slots], to[slots] = origin, target
    return base, owner, to


@dataclass(frozen=True)
class Model:
    """The languages' automata in one table; state 0 is common to all, the beginning of a phrase."""

    languages: list[str]
    alphabet: np.ndarray
    bits: np.ndarray
    base: np.ndarray
    owner: np.ndarray
    to: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, alphabet: np.ndarray, parts: list[tuple[str, int, np.ndarray, np.ndarray, np.ndarray]]) -> Model:
        letters = FIRST + len(alphabet)
        base, owner, to, start = [np.zeros(1, np.int64)], [np.full(letters, -1, np.int64)], [np.zeros(letters, np.int64)], []
        states, slots = 1, letters
        for _, _, b, o, t in parts:
            base.append(b + slots)
            owner.append(np.where(o >= 0, o + states, -1))
            to.append(t + states)
            place = b[0] + np.arange(letters)
            start.append(np.where(o[place] == 0, t[place] + states, 0))
            states, slots = states + len(b), slots + len(o)
        join = lambda arrays: np.concatenate(arrays).astype(np.int32)
        bits = np.log2([n + letters for _, n, *_ in parts]) if parts else np.zeros(0)
        table = np.array(start, np.int32).reshape(len(parts), letters)
        return cls([p[0] for p in parts], alphabet, bits, join(base), join(owner), join(to), table)

    def numbers(self) -> np.ndarray:
        return numbered(self.alphabet)

    def phrases(self, letters: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """How many phrases each text needs, by language."""
        pieces = -(-lengths // STRETCH)
        text = np.repeat(np.arange(len(lengths)), pieces)
        within = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(np.cumsum(lengths) - lengths, pieces) + within * STRETCH
        size = np.minimum(lengths[text] - within * STRETCH, STRETCH)
        found = np.zeros((len(self.languages), len(text)), np.int32)
        order = np.argsort(-size, kind="stable")
        for lanes in np.array_split(order, range(LANES, len(order), LANES)):
            if len(lanes):
                found[:, lanes] = self._side_by_side(letters, begin[lanes], size[lanes])
        total = np.zeros((len(self.languages), len(lengths)), np.int64)
        for language in range(len(self.languages)):
            total[language] = np.bincount(text, weights=found[language], minlength=len(lengths))
        return total

    def _side_by_side(self, letters: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Phrases of stretches, the longest first."""
        state = np.zeros((len(self.languages), len(begin)), np.int32)
        count = np.zeros(state.shape, np.int32)
        active = np.searchsorted(-size, -np.arange(size[0]), side="left")
        for step, n in enumerate(active.tolist()):
            c = letters[begin[:n] + step]
            here = state[:, :n]
            slot = self.base[here] + c
            goes = self.owner[slot] == here
            state[:, :n] = np.where(goes, self.to[slot], self.start[:, c])
            count[:, :n] += ~goes
        return count

    def predict(self, texts: list[str | None], numbers: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language of each text and how sure that is."""
        letters, lengths = spell([t or "" for t in texts], numbers)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        cost = self.phrases(letters, lengths) * self.bits[:, None] / np.maximum(lengths, 1)
        best = cost.argmin(0)
        apart = np.minimum((cost - cost.min(0)) * np.minimum(lengths, SURE), 60)
        sure = 1 / np.exp2(-apart).sum(0)
        names = [self.languages[b] if n else "und" for b, n in zip(best.tolist(), lengths.tolist())]
        return names, np.where(lengths > 0, sure, 0.0)


def numbered(alphabet: np.ndarray) -> np.ndarray:
    """The letter number of every code point."""
    numbers = np.where(_letters(), UNKNOWN, GAP).astype(np.int32)
    numbers[alphabet] = FIRST + np.arange(len(alphabet))
    return numbers


def sample_of(rows: pd.DataFrame, numbers: np.ndarray) -> np.ndarray:
    """The letters of a language's distinct pieces, with a border after each; up to SAMPLE of them."""
    rows = rows.sort_values(["rank", "piece"]).drop_duplicates("piece")
    letters, lengths = spell(rows["piece"].tolist(), numbers)
    out, count = [], 0
    for part, inner in zip(np.split(letters, np.cumsum(lengths)[:-1]), rows["inner"]):
        if len(part) == 0:
            continue
        # a piece from within a text needn't start between two words
        out += [part[1:] if inner else part, np.array([BORDER])]
        count += len(part)
        if count >= SAMPLE:
            break
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _alphabets(rows: pd.DataFrame) -> pd.DataFrame:
    known = _letters()
    codes = sorted({ord(c) for t in rows["piece"] for c in t.lower() if known[ord(c)]})
    return pd.DataFrame({"code": pd.Series(codes, dtype="int64")})


def _automata(alphabet: np.ndarray):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        letters = sample_of(rows, numbered(alphabet))
        if not len(letters):
            return pd.DataFrame({"lang": [], "size": [], "base": [], "owner": [], "target": []})
        arrays = packed(*automaton(letters.tolist()), FIRST + len(alphabet))
        made = dict(zip(("base", "owner", "target"), ([a.astype(np.int32).tobytes()] for a in arrays)))
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "size": [len(letters)], **made})

    return run


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", learn: Column | None = None) -> Model:
    """Learn the languages of the rows of ``docs`` for which ``learn`` holds and language and text are not null.

    Each text offers up to PER_TEXT pieces spread over it; a language's sample are PIECES of them by a hash of
    ``key``, without repeats, up to SAMPLE letters. A language without a letter isn't learned. One task builds one language's automaton.
    """
    rows = docs.filter(learn) if learn is not None else docs
    rows = rows.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.filter("lang is not null and text rlike '[\\\\p{L}]'")
    many = F.least(F.lit(PER_TEXT), F.ceil(F.length("text") / PIECE)).cast("int")
    rows = rows.withColumn("n", F.explode(F.sequence(F.lit(0), many - 1))).select(
        "lang", F.xxhash64("key", "n").alias("order"), (F.col("n") > 0).alias("inner"), F.expr(f"substring(text, cast(n * (length(text) div {PER_TEXT}) as int) + 1, {PIECE})").alias("piece")
    )
    order = Window.partitionBy("lang").orderBy("order", "piece", "inner")
    pieces = pin(rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= PIECES).drop("order"))
    own = pieces.groupBy("lang")
    codes = own.applyInPandas(_alphabets, "code long").distinct().collect()
    alphabet = np.array(sorted(r["code"] for r in codes), np.int64)
    made = own.applyInPandas(_automata(alphabet), "lang string, size long, base binary, owner binary, target binary").collect()
    whole = lambda raw: np.frombuffer(raw, np.int32).astype(np.int64)
    parts = [(r["lang"], r["size"], whole(r["base"]), whole(r["owner"]), whole(r["target"])) for r in made]
    return Model.of(alphabet, sorted(parts, key=lambda p: p[0]))


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = model.numbers()
        for batch in batches:
            begin, size = 0, 0
            lengths = [len(t) if t else 0 for t in batch.column(1).to_pylist()]
            for end, length in enumerate(lengths, 1):
                size += length
                if size >= CHARACTERS or end == len(lengths):
                    part = batch.slice(begin, end - begin)
                    names, sure = model.predict(part.column(1).to_pylist(), numbers)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(names, pa.string()), pa.array(sure, pa.float64())], ["_kept", "lang_pred", "score"]
                    )
                    begin, size = end, 0

    return run


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``score``, 0 to 1, to the columns ``keep`` (all, if not given).

    Every row is read whole and by itself: repeated rows repeat, an empty table stays empty. Texts that are null or
    have no letter are ``und`` with score 0, and so are all where no language was learned. Languages that explain a text
    equally well are taken by name. Columns named like the results are replaced.
    """
    own = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_kept"), F.col(f"`{text}`").cast("string").alias("_text"))
    shape = StructType([rows.schema["_kept"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(_predict(model), shape).select("_kept.*", "lang_pred", "score")
