"""Documents packed into blocks of word numbers, the unit in which corpus counts are asked for and handed back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words after which a block is full.
BLOCK_WORDS = 1 << 20

_SHAPE = "block long, ids array<long>, held array<boolean>, lengths binary, vocabulary binary, spelt binary, words binary"


def squeeze(values: np.ndarray) -> bytes:
    """Whole numbers as compressed bytes, places of equal worth side by side."""
    kind = np.dtype(values.dtype)
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, kind.itemsize).T
    raw = np.ascontiguousarray(planes).tobytes()
    return np.int64(len(raw)).tobytes() + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def _text(raw: bytes) -> bytes:
    return np.int64(len(raw)).tobytes() + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def spelt_words(data: bytes) -> list[bytes]:
    """The words of a block's ``spelt``, in the order of its vocabulary."""
    size = int(np.frombuffer(data[:8], np.int64)[0])
    return pa.decompress(data[8:], size, "zstd", asbytes=True).split(b" ") if size else []


def unsqueeze(data: bytes, kind: type) -> np.ndarray:
    size = int(np.frombuffer(data[:8], np.int64)[0])
    if not size:
        return np.empty(0, kind)
    raw = pa.decompress(data[8:], size, "zstd", asbytes=True)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def _pack(lower: bool, spelt: bool, full: int):
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        place: dict[bytes, int] = {}
        ids, held, lengths, words, count = [], [], [], [], 0

        def block():
            texts = list(place)
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, texts), np.uint64, len(texts))
            order = np.argsort(hashes, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            numbers = rank[np.concatenate(words)] if count else np.empty(0, np.int64)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([held], pa.list_(pa.bool_())),
                    pa.array([squeeze(np.array(lengths, np.int64))]),
                    pa.array([squeeze(hashes[order])]),
                    pa.array([_text(b" ".join(texts[i] for i in order)) if spelt else b""]),
                    pa.array([squeeze(numbers.astype(np.uint32))]),
                ],
                [c.split()[0] for c in _SHAPE.split(", ")],
            )

        for batch in batches:
            for key, out, text in zip(*(batch.column(c).to_pylist() for c in ("id", "held", "text"))):
                raw = (text or "").encode()
                tokens = (raw.lower() if lower else raw).split()
                ids.append(key)
                held.append(out)
                lengths.append(len(tokens))
                if tokens:
                    words.append(np.fromiter((place.setdefault(w, len(place)) for w in tokens), np.int64, len(tokens)))
                count += len(tokens)
                if count >= full or len(ids) >= full:
                    yield block()
                    number += 1
                    place, ids, held, lengths, words, count = {}, [], [], [], [], 0
        if ids:
            yield block()

    return run


def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one; the blocks of a batch aren't copied together."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(n)[i].as_py() for n, name in enumerate(batch.schema.names)}


def packed(docs: DataFrame, text: str, key: str, held: Column | None = None, lower: bool = False, full: int = BLOCK_WORDS) -> DataFrame:
    """Rows of (block, ids, held, lengths, vocabulary, spelt, words) for the words, apart at ASCII white space.

    ``vocabulary`` holds the sorted 64-bit hashes of a block's different words, ``words`` the places in it of all its
    words, document after document. ``spelt`` has the words themselves if ``held`` isn't given. Documents stay in the
    task that reads them and a longer document than a block is one block.
    """
    rows = docs.select(
        F.col(f"`{key}`").cast("long").alias("id"),
        (F.lit(False) if held is None else held).alias("held"),
        F.col(f"`{text}`").cast("string").alias("text"),
    )
    return rows.mapInArrow(_pack(lower, held is None, full), _SHAPE)
