"""Transport of a channel: commands folded into mode, speed, position, marks, angle and settings.

Two folds follow each other. The first one tells how the channel moves: its mode, the grains it played and the ramp in
force. From these the way between two commands is an expression: the rounded steps of a linear ramp, at most as many as
the ramp has grains, and equal steps after it. The second fold moves three registers, the position and the two marks.
Both have small effects, so a channel that keeps its state for long is still walked in chunks side by side.
"""

from __future__ import annotations

import json
import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField

from reelgrid.plans.fold import Machine, Rows, fold_timeline
from reelgrid.plans.ordered import CHUNK
from reelgrid.plans.session import pinned

LIVE, PLAYING, PAUSED = 0, 1, 2
MODES = ("live", "playing", "paused")
#: The angle of a channel that shows clips of the library instead of a camera; going live leaves it for the first one.
LIBRARY = 0
# What each setting of a channel may be.
SETTINGS = {
    "motion": ("repeat", "blend", "interpolate"),
    "audio": ("mute", "stretch", "follow"),
    "timecode": ("output", "source"),
}
_START = {"mode": LIVE, "in": False, "out": False, "grain": None, "played": 0, "from": 1.0, "to": 1.0, "since": 0, "angle": 1, "set": {}}

TRANSPORT_FIELDS = [
    StructField("mode", StringType()), StructField("position_ns", LongType()), StructField("speed", DoubleType()),
    StructField("in_ns", LongType()), StructField("out_ns", LongType()), StructField("angle", IntegerType()),
    StructField("locked", BooleanType()), *[StructField(name, StringType()) for name in SETTINGS],
]


def whole(value: float) -> int:
    """The nearest whole number, halves away from zero."""
    return int(math.copysign(math.floor(abs(value) + 0.5), value))


def mode_after(command: str, mode: int, mark_in: bool, mark_out: bool) -> int:
    """The mode a command leaves a channel in; going to a mark that isn't set does nothing."""
    if command == "play":
        return PLAYING
    if command == "live":
        return LIVE
    if command in ("pause", "scrub_frames", "scrub_seconds") or (command == "goto_in" and mark_in) or (command == "goto_out" and mark_out):
        return PAUSED
    if command == "stop" and mode == PLAYING or command == "seek" and mode == LIVE:
        return PAUSED
    return mode


def ramped(start: float, target: float, steps: int, ramp: int) -> float:
    """The speed of the last of some steps since a speed was asked for."""
    if ramp == 0 or steps > ramp:
        return target
    return start + (target - start) * steps / ramp


def _asked(argument: float) -> float:
    return max(-1.0, min(2.0, argument))


def _setting(command: str, argument: float, choice: str | None):
    """The setting a command changes and its value, or None."""
    if command == "lock" and argument is not None:
        return "locked", argument != 0
    if choice is not None and choice in SETTINGS.get(command, ()):
        return command, choice
    return None


def _angle(command: str, argument: float, angle: int, cameras: int) -> int:
    if command == "angle" and 1 <= argument <= cameras:
        return int(argument)
    if command == "library":
        return LIBRARY
    return 1 if command == "live" and angle == LIBRARY else angle


def drive_machine(cameras: int, ramp: int) -> Machine:
    """How a channel moves: mode, grains played before and by each command, the ramp in force, angle and settings."""

    def step(state: str | None, rows: Rows) -> tuple[Rows, str]:
        s = json.loads(state) if state else {**_START, "set": {}}
        out: Rows = {f.name: [] for f in DRIVE_FIELDS}
        for grain, command, argument, choice in zip(rows["grain"], rows["command"], rows["argument"], rows["choice"], strict=True):
            before = s["played"]
            if s["mode"] == PLAYING:
                s["played"] += grain - s["grain"]
            found = {"_was_live": s["mode"] == LIVE, "_p0": before, "_p1": s["played"], "_from": s["from"], "_to": s["to"], "_since": s["since"]}
            found["_known"] = {"goto_in": s["in"], "goto_out": s["out"]}.get(command, True)
            s["grain"] = grain
            s["mode"] = mode_after(command, s["mode"], s["in"], s["out"])
            if command in ("mark_in", "mark_out"):
                s[command[5:]] = True
            if command == "speed" and argument is not None:
                s["from"] = ramped(s["from"], s["to"], s["played"] - s["since"], ramp)
                s["to"], s["since"] = _asked(argument), s["played"]
            s["angle"] = _angle(command, argument, s["angle"], cameras)
            if changed := _setting(command, argument, choice):
                s["set"][changed[0]] = changed[1]
            found |= {"mode": MODES[s["mode"]], "angle": s["angle"], "speed": ramped(s["from"], s["to"], s["played"] - s["since"], ramp)}
            found |= {name: s["set"].get(name) for name in ("locked", *SETTINGS)}
            for name, value in found.items():
                out[name].append(value)
        return out, json.dumps(s)

    # What rows do depends on few things before them: the mode and whether there are marks. For each of these cases a
    # way is (mode, mark in, mark out, grains played, grains at the first speed, slope and shift of the speed since, its
    # target, its grains). Angle and settings are the same in all cases.
    cases = list(product(range(3), (False, True), (False, True)))

    def moved(way: tuple, gap: int, command: str, argument: float) -> tuple:
        mode, mark_in, mark_out, played, first, slope, shift, target, since = way
        if mode == PLAYING:
            played += gap
        if command == "speed" and argument is not None:
            if first is None:
                first, slope, shift = played, 1.0, 0.0
            else:
                done = played - since
                slope = 0.0 if ramp == 0 or done > ramp else slope + (0.0 - slope) * done / ramp
                shift = ramped(shift, target, done, ramp)
            target, since = _asked(argument), played
        mode = mode_after(command, mode, mark_in, mark_out)
        return mode, mark_in or command == "mark_in", mark_out or command == "mark_out", played, first, slope, shift, target, since

    def extend(effect: dict | None, rows: Rows) -> dict:
        grains = rows["grain"]
        if effect is None:
            ways = [(*case, 0, None, 0.0, 0.0, 0.0, 0) for case in cases]
            effect = {"first": grains[0], "last": grains[0], "ways": ways, "at": list(range(len(ways))), "angle": None, "left": False, "set": {}}
        ways, at, last = effect["ways"], effect["at"], effect["last"]
        for grain, command, argument, choice in zip(grains, rows["command"], rows["argument"], rows["choice"], strict=True):
            found = [moved(way, grain - last, command, argument) for way in ways]
            distinct = dict.fromkeys(found)
            if len(distinct) < len(ways):
                # cases that have become the same go on together
                number = {way: n for n, way in enumerate(distinct)}
                at = [number[found[a]] for a in at]
                found = list(distinct)
            ways, last = found, grain
            effect["left"] |= command == "live" and effect["angle"] is None
            before = effect["angle"]
            after = _angle(command, argument, -1 if before is None else before, cameras)
            effect["angle"] = None if after == -1 else after
            if changed := _setting(command, argument, choice):
                effect["set"][changed[0]] = changed[1]
        return effect | {"ways": ways, "at": at, "last": last}

    def enter(effect: dict, state: str) -> str:
        s = json.loads(state)
        case = (s["mode"], s["in"], s["out"])
        gap = effect["first"] - s["grain"] if s["mode"] == PLAYING else 0
        mode, mark_in, mark_out, played, first, slope, shift, target, since = effect["ways"][effect["at"][cases.index(case)]]
        begin = s["played"] + gap
        if first is not None:
            start = ramped(s["from"], s["to"], begin + first - s["since"], ramp)
            s |= {"from": slope * start + shift, "to": target, "since": begin + since}
        angle = effect["angle"] if effect["angle"] is not None else 1 if effect["left"] and s["angle"] == LIBRARY else s["angle"]
        s |= {"mode": mode, "in": mark_in, "out": mark_out, "grain": effect["last"], "played": begin + played, "angle": angle}
        return json.dumps(s | {"set": s["set"] | effect["set"]})

    return Machine(step, extend, enter)


DRIVE_FIELDS = [
    *TRANSPORT_FIELDS[:1], *TRANSPORT_FIELDS[2:3], *TRANSPORT_FIELDS[5:],
    StructField("_was_live", BooleanType()), StructField("_known", BooleanType()), StructField("_p0", LongType()),
    StructField("_p1", LongType()), StructField("_from", DoubleType()), StructField("_to", DoubleType()), StructField("_since", LongType()),
]
MARK_FIELDS = [TRANSPORT_FIELDS[1], *TRANSPORT_FIELDS[3:5]]


def way(start: Column, target: Column, done: Column, until: Column, ramp: int, period_ns: int) -> Column:
    """The rounded steps from ``done`` to ``until`` grains after a speed was asked for, added up."""
    per = F.lit(float(period_ns))
    even = F.round(target * per).cast("long") * (until - F.greatest(done, F.least(until, F.lit(ramp).cast("long"))))
    if ramp == 0:
        return even
    last = F.least(until, F.lit(ramp).cast("long"))
    steps = F.when(last > done, F.sequence(done + 1, last)).otherwise(F.array().cast("array<bigint>"))
    return even + F.aggregate(steps, F.lit(0).cast("long"), lambda total, j: total + F.round((start + (target - start) * j / ramp) * per).cast("long"))


def way_of(start: float, target: float, done: int, until: int, ramp: int, period_ns: int) -> int:
    """:func:`way` for one command of a stream."""
    last = min(until, ramp)
    ramping = sum(whole(ramped(start, target, j, ramp) * period_ns) for j in range(done + 1, last + 1))
    return ramping + whole(target * period_ns) * (until - max(done, last))


def mark_step(state: str | None, rows: Rows) -> tuple[Rows, str]:
    """Position and marks: each row moves the position by ``_by`` or sets it to ``_at``, then its command acts."""
    position, mark_in, mark_out = json.loads(state) if state else (0, None, None)
    out: Rows = {"position_ns": [], "in_ns": [], "out_ns": []}
    for by, at, command, known in zip(rows["_by"], rows["_at"], rows["command"], rows["_known"], strict=True):
        position = at if at is not None else position + by
        if command == "mark_in":
            mark_in = max(0, position)
        elif command == "mark_out":
            mark_out = max(0, position)
        elif command == "goto_in" and known and mark_in is not None:
            position = mark_in
        elif command == "goto_out" and known and mark_out is not None:
            position = mark_out
        for values, value in zip(out.values(), (position, mark_in, mark_out)):
            values.append(value)
    return out, json.dumps([position, mark_in, mark_out])


def _mark_extend(effect: list | None, rows: Rows) -> list:
    # each register is an earlier one (by number, None for none) plus a shift, at least a floor
    position, mark_in, mark_out = effect or [(0, 0, None), (1, 0, None), (2, 0, None)]
    for by, at, command, known in zip(rows["_by"], rows["_at"], rows["command"], rows["_known"], strict=True):
        if at is not None:
            position = (None, at, None)
        elif by:
            source, shift, floor = position
            position = (source, shift + by, None if floor is None else floor + by)
        if command in ("mark_in", "mark_out"):
            source, shift, floor = position
            mark = (None, max(0, shift), None) if source is None else (source, shift, max(0, floor or 0))
            mark_in, mark_out = (mark, mark_out) if command == "mark_in" else (mark_in, mark)
        elif command == "goto_in" and known:
            position = mark_in
        elif command == "goto_out" and known:
            position = mark_out
    return [position, mark_in, mark_out]


def _mark_enter(effect: list, state: str) -> str:
    before = json.loads(state)

    def value(source: int | None, shift: int, floor: int | None) -> int | None:
        if source is None:
            return shift
        if before[source] is None:
            return None
        found = before[source] + shift
        return found if floor is None else max(floor, found)

    return json.dumps([value(*register) for register in effect])


MARKS = Machine(mark_step, _mark_extend, _mark_enter)


def transport_step(period_ns: int, delay_ns: int, cameras: int, ramp: int = 0):
    """Step of :func:`transport_fold` for streams: both folds in one."""
    drive = drive_machine(cameras, ramp).step

    def step(state: str | None, rows: Rows) -> tuple[Rows, str]:
        before = json.loads(state) if state else [None, None]
        rows = {"choice": [None] * len(rows["grain"]), **rows}
        found, driven = drive(before[0], rows)
        moves: Rows = {"_by": [], "_at": [], "command": rows["command"], "_known": found["_known"]}
        for n, command in enumerate(rows["command"]):
            start, target, since = found["_from"][n], found["_to"][n], found["_since"][n]
            by = way_of(start, target, found["_p0"][n] - since, found["_p1"][n] - since, ramp, period_ns)
            at = rows["tai_ns"][n] - delay_ns if found["_was_live"][n] else None
            argument = rows["argument"][n]
            if command == "seek":
                at = rows["to_ns"][n]
            elif command in ("scrub_frames", "scrub_seconds"):
                scrub = int(argument) * period_ns if command == "scrub_frames" else whole(argument * 1e9)
                by, at = by + scrub, None if at is None else at + scrub
            moves["_by"].append(by)
            moves["_at"].append(at)
        placed, marked = mark_step(before[1], moves)
        return {**{f.name: found[f.name] for f in TRANSPORT_FIELDS if f.name in found}, **placed}, json.dumps([driven, marked])

    return step


def transport_fold(commands: DataFrame, order: list[str], period_ns: int, delay_ns: int, cameras: int, ramp: int = 0) -> DataFrame:
    """State of each channel after each command: mode, position, speed, marks, angle, lock and settings.

    Between two commands a playing channel moves by its speed each grain and a live one follows the output time. A new
    speed is reached in ``ramp`` grains that are played. A command has a ``grain``, its output time ``tai_ns``, a name,
    an argument, for a seek ``to_ns`` (never null) and, if there is such a column, a ``choice`` for settings. ``lock``
    takes 0 or 1; ``library`` shows the library until an angle is chosen or the channel goes live. Unknown names and
    arguments out of range change nothing.
    """
    choice = F.col("choice") if "choice" in commands.columns else F.lit(None).cast("string")
    columns = ["channel", *dict.fromkeys([*order, "grain", "tai_ns"])]
    rows = commands.select(*columns, "command", "argument", "to_ns", choice.alias("choice"))
    keep = [c for c in dict.fromkeys([*columns, "command", "argument", "to_ns"]) if c not in ("channel", *order)]
    driven = fold_timeline(rows, ["channel"], order, drive_machine(cameras, ramp), DRIVE_FIELDS, keep=keep, keep_chunk=True)
    scrub = (
        F.when(F.col("command") == "scrub_frames", F.col("argument").cast("long") * period_ns)
        .when(F.col("command") == "scrub_seconds", F.round(F.col("argument") * 1e9).cast("long"))
        .otherwise(F.lit(0).cast("long"))
    )
    since = F.col("_since")
    by = way(F.col("_from"), F.col("_to"), F.col("_p0") - since, F.col("_p1") - since, ramp, period_ns)
    at = F.when(F.col("command") == "seek", F.col("to_ns")).when(F.col("_was_live"), F.col("tai_ns") - delay_ns + scrub)
    own = [f.name for f in DRIVE_FIELDS if not f.name.startswith("_")]
    moves = driven.select("channel", *order, "command", "_known", (by + scrub).alias("_by"), at.alias("_at"), *own, CHUNK)
    placed = fold_timeline(pinned(moves), ["channel"], order, MARKS, MARK_FIELDS, keep=own)
    return placed.select("channel", *order, *[f.name for f in TRANSPORT_FIELDS])


