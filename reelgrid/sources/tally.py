"""Tally messages as they come off the wire: datagrams and framed byte streams to one row per display."""

from __future__ import annotations

import re
from collections.abc import Iterator
from struct import Struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StructField

from reelgrid.plans.fold import Machine, Rows, fold_timeline

# Fixed values of the protocol: an escape byte before a mark opens or closes a packet, before itself it is data. A
# packet is its length (of what follows), version, flags and screen, then records of display, control and a sized text.
ESCAPE, OPEN, CLOSE = b"\xfe", b"\xfe\x02", b"\xfe\x03"
HEADER, RECORD, SIZE = Struct("<HBBH"), Struct("<HH"), Struct("<H")
WIDE_TEXT, NO_DISPLAYS, NOT_A_DISPLAY = 1, 2, 0x8000
DISPLAY = "screen int, display int, lh int, rh int, txt int, brightness int, label string, error string"

_PAIRS = re.compile(rb"[^\xfe]+|\xfe.", re.DOTALL)
_NOT_WIDE = re.compile("[\ud800-\udfff]")


def split_framed(raw: bytes) -> tuple[list[bytes], bytes]:
    """The packets of a framed byte stream, and its end from where a later piece has to go on.

    The stream is cut at its marks and the escapes between two marks are taken out. What follows an opening mark is a
    packet as soon as it has the length it states, or else when the next mark comes.
    """
    units = _PAIRS.findall(raw)
    loose = raw[sum(map(len, units)) :]  # an escape byte whose partner is still to come
    marks = [n for n, unit in enumerate(units) if unit in (OPEN, CLOSE)]
    packets: list[bytes] = []
    for mark, following in zip(marks, [*marks[1:], None]):
        if units[mark] == CLOSE:
            continue
        between = units[mark + 1 : following]
        body = b"".join(ESCAPE if u == ESCAPE * 2 else b"" if u[:1] == ESCAPE else u for u in between)
        stated = SIZE.unpack_from(body)[0] + SIZE.size if len(body) >= SIZE.size else None
        if stated is not None and len(body) >= stated:
            packets.append(body[:stated])
        elif following is None:
            return packets, OPEN + b"".join(between) + loose
        elif body:
            packets.append(body)
    return packets, loose


def _label(raw: bytes, wide: bool) -> str:
    if wide:
        text = raw[: len(raw) & ~1].decode("utf-16-le", "surrogatepass")
        return _NOT_WIDE.sub("\ufffd", text).replace("\0", "")
    return raw.decode("ascii", "replace").rstrip("\0")


class Damaged(ValueError):
    """A packet that ends before what it announces; the argument names the part that is cut off."""


def _records(body: memoryview) -> Iterator[tuple[int, int, memoryview]]:
    """(display, control, text) of each record that describes a display."""
    while len(body) >= RECORD.size:
        (display, control), body = RECORD.unpack_from(body), body[RECORD.size :]
        shown = not control & NOT_A_DISPLAY
        if len(body) < SIZE.size:
            raise Damaged("length" if shown else "control-length")
        (size,), body = SIZE.unpack_from(body), body[SIZE.size :]
        if shown and size > len(body):
            raise Damaged("text")
        if shown:
            yield display, control, body[:size]
        body = body[size:]


def displays(packet: bytes) -> list[tuple]:
    """Rows of one packet; a damaged packet ends with a row that names the problem."""
    rows: list[tuple] = []
    try:
        if len(packet) < HEADER.size:
            raise Damaged("short")
        length, _, flags, screen = HEADER.unpack_from(packet)
        whole = memoryview(packet)[: length + SIZE.size]
        if len(whole) < length + SIZE.size:
            raise Damaged("pbc")
        for display, control, text in () if flags & NO_DISPLAYS else _records(whole[HEADER.size :]):
            rh, txt, lh, brightness = (control >> bits & 3 for bits in (0, 2, 4, 6))
            rows.append((screen, display, lh, rh, txt, brightness, _label(bytes(text), bool(flags & WIDE_TEXT)), None))
    except Damaged as problem:
        rows.append((*[None] * 7, str(problem)))
    return rows


def _displays_of(frame: DataFrame, keys: list[str], column: str, packets_of) -> DataFrame:
    """One row per display of the packets that ``packets_of`` finds in a cell, with its keys, in one pass."""
    names = [part.split()[0] for part in DISPLAY.split(", ")]
    schema = ", ".join(f"{k} {frame.schema[k].dataType.simpleString()}" for k in keys) + ", " + DISPLAY

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (*key, *row)
                for *key, cell in batch[[*keys, column]].itertuples(index=False, name=None)
                for packet in packets_of(bytes(cell))
                for row in displays(packet)
            ]
            out = pd.DataFrame(rows, columns=[*keys, *names])
            yield out.astype({n: "Int32" for n in names[:6]})

    return frame.select(*keys, column).mapInPandas(parse, schema)


def parse_packets(packets: DataFrame, keys: list[str], column: str = "packet") -> DataFrame:
    """One row per display of each packet, with its keys; damaged packets give a row with ``error``."""
    return _displays_of(packets, keys, column, lambda packet: [packet])


def datagram_displays(datagrams: DataFrame, keys: list[str], column: str = "data") -> DataFrame:
    """One row per display of each datagram, which is a packet or, behind an opening mark, framed ones."""
    return _displays_of(datagrams, keys, column, lambda data: split_framed(data)[0] if data.startswith(OPEN) else [data])


def framing_machine(column: str) -> Machine:
    """Packets of consecutive pieces; the state is the open end of the last one.

    The bytes after a mark don't depend on what came before it. Where no mark has come, the bytes so far are the effect;
    once they outgrow the longest packet, an earlier one is complete and only a last escape byte stays open.
    """
    longest = 0xFFFF + SIZE.size

    def step(state: str | None, rows: Rows) -> tuple[Rows, str]:
        found, left = [], bytes.fromhex(state or "")
        for piece in rows[column]:
            packets, left = split_framed(left + bytes(piece))
            found.append(packets)
        return {"packets": found}, left.hex()

    def extend(effect: tuple | None, rows: Rows) -> tuple:
        head, state = effect or (b"", None)
        if state is not None:
            return b"", step(state, rows)[1]
        head += b"".join(map(bytes, rows[column]))
        # an escape byte before may take the first byte that isn't one along; after that all cut alike
        sure = head.lstrip(ESCAPE)[1:]
        units = _PAIRS.findall(sure)
        if any(unit in (OPEN, CLOSE) for unit in units):
            return b"", split_framed(sure)[1].hex()
        if sum(len(u) if u[:1] != ESCAPE else u == ESCAPE * 2 for u in units) >= longest:
            return b"", sure[sum(map(len, units)) :].hex()
        return head, None

    def enter(effect: tuple, state: str) -> str:
        head, after = effect
        return after if after is not None else split_framed(bytes.fromhex(state) + head)[1].hex()

    return Machine(step, extend, enter)


def stream_packets(pieces: DataFrame, connection: str, order: str, column: str = "data") -> DataFrame:
    """Packets of byte streams that arrive in pieces; a packet may span pieces, so its open end is the folded state."""

    machine = framing_machine(column)
    found = fold_timeline(
        pieces.select(connection, order, column), [connection], [order], machine, [StructField("packets", ArrayType(BinaryType()))]
    )
    return found.select(connection, order, F.posexplode("packets").alias("nth", "packet"))
