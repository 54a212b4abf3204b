"""Chat formatting with loss masks aligned by offsets."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template: a turn is TURN role TEXT text END and a line feed.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Characters of whole turns that are rendered and encoded at once; a longer conversation goes on in the next piece.
PIECE = 1 << 20

_PIECES = (
    "conv_id long, piece int, formatted string, token_ids array<int>, loss array<boolean>, "
    "starts array<int>, ends array<int>"
)
_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    """Take every control string apart: a backslash is doubled and one is put between < and |."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def _encoder(tokenizer_json: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(tokenizer_json)
    tokenizer.add_special_tokens([TURN, TEXT, END])
    return tokenizer


def _render(turns: list[tuple[str, str]], trained: str) -> tuple[str, list[tuple[int, int]]]:
    """The text of the turns and the spans in it that are learnt."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == trained and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def _mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens lie in a span: by binary search of each token's start among the sorted spans."""
    if not spans:
        return np.zeros(len(starts), bool)
    begin, end = np.array(spans).T
    at = np.searchsorted(begin, starts, "right") - 1
    return (at >= 0) & (ends <= end[np.maximum(at, 0)]) & (ends > starts)


def _format(tokenizer_json: str, trained: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_json)

        def piece(conv, number, turns):
            formatted, spans = _render(turns, trained)
            encoded = encoder.encode(formatted, add_special_tokens=False)
            offsets = np.array(encoded.offsets, np.int32).reshape(-1, 2)
            loss = _mask(offsets[:, 0], offsets[:, 1], spans)
            return (conv, number, formatted, encoded.ids, loss, offsets[:, 0], offsets[:, 1])

        def out(rows):
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_())] + [pa.list_(pa.int32())] * 2
            names = [c.split()[0] for c in _PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows), kinds)], names)

        turns: list[tuple[str, str]] = []
        conv, number, held, begun, rows, done = None, 0, 0, False, [], 0
        for batch in batches:
            for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text"))):
                if begun and (c != conv or held > PIECE):
                    rows.append(piece(conv, number, turns))
                    number, turns, done, held = (number + 1 if c == conv else 0), [], done + held, 0
                    if done > PIECE:
                        yield out(rows)
                        rows, done = [], 0
                conv, begun = c, True
                turns.append((role or "", text or ""))
                held += len(text or "") + 1
        if turns:
            rows.append(piece(conv, number, turns))
        if rows:
            yield out(rows)

    return run


def format_conversations(
    turns: DataFrame, tokenizer_path: str = "/opt/tokenizers/byte_bpe_50k.json", trained: str = "assistant"
) -> DataFrame:
    """Render conversations (conv_id, turn, role, text), encode them with offsets and mask what is learnt.

    Each row is a piece of a conversation: the ``formatted`` text, its ``token_ids``, the characters of each token
    (``starts``, ``ends``) and ``loss``, true for tokens inside a text of the ``trained`` role. Turn marks are special
    tokens, so no token crosses a text's border and a conversation's pieces are what it would be encoded to as one; a
    conversation has one piece unless it is longer than ``PIECE`` characters. The pieces of a conversation follow each
    other in one partition, which is all that a conversation with very many turns needs in memory.

    Turns go by ``turn`` (null first), equal ones by role and text; repeated rows stay. A null text or role is empty, a
    null conv_id is a conversation of its own, a conversation of empty texts has no loss, an empty table has no rows.
    Further columns are ignored. ``tokenizer_path`` is read once, on the driver.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer_json = file.read()
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.drop("turn").mapInArrow(_format(tokenizer_json, trained), _PIECES)


_ONE_TURN = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END) + "\n", re.DOTALL)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, begun = None, False
    turns = chars = learnt = 0
    said, loss = hashlib.sha256(), hashlib.sha256()
    names = [c.split()[0] for c in _READ.split(", ")]
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            if begun and row["piece"] == 0:
                rows.append((conv, turns, said.hexdigest(), learnt, loss.hexdigest(), chars))
                turns = chars = learnt = 0
                said, loss = hashlib.sha256(), hashlib.sha256()
            conv, begun, text = row["conv_id"], True, row["formatted"]
            chars += len(text)
            for role, body in _ONE_TURN.findall(text):
                turns += 1
                said.update(f"{unescape(role)}\n{unescape(body)}\n".encode())
            # neighbouring tokens under the mask make one stretch; the bytes of one character share its place
            stretch: list[int] = []
            for start, end, learn in zip(row["starts"], row["ends"], row["loss"]):
                if learn and stretch and start <= stretch[1]:
                    stretch[1] = end
                    continue
                if stretch:
                    body = unescape(text[stretch[0] : stretch[1]])
                    learnt += len(body)
                    loss.update(body.encode())
                stretch = [start, end] if learn else []
            if stretch:
                body = unescape(text[stretch[0] : stretch[1]])
                learnt += len(body)
                loss.update(body.encode())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(v)) if i else pa.array(list(v), pa.int64()) for i, v in enumerate(zip(*rows))], names)
    if begun:
        last = (conv, turns, said.hexdigest(), learnt, loss.hexdigest(), chars)
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) if i == 0 else pa.array([v]) for i, v in enumerate(last)], names)


def read_back(pieces: DataFrame) -> DataFrame:
    """Parse formatted pieces, as :func:`format_conversations` returns them, into digests of what they hold."""
    return pieces.mapInArrow(_read, _READ)
