"""The life of a channel's shot: clicks, transport, the end of a clip and tallies as one finite automaton.

A shot is idle, cued, playing, paused or ended, its channel is live or not and its tally was red or not: twenty states.
An event is a row of a table from state to state, so what a run of events does is such a table too, and tables of
neighbouring runs give the table of both. Only a click looks further, at the shot it names.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField

from reelgrid.plans.fold import Machine, Rows, fold_timeline

IDLE, CUED, PLAYING, PAUSED, ENDED = range(5)
NAMES = ("idle", "cued", "playing", "paused", "ended")
# What a click makes of each state, with and without playing at the first click.
CLICKED = {False: (CUED, PLAYING, PAUSED, PLAYING, CUED), True: (PLAYING, PLAYING, PAUSED, PLAYING, PLAYING)}
# The state a clip's end leads to; other ends leave the shot ended.
FINISHED = {"loop": PLAYING, "next": PLAYING, "next-cued": CUED}

SHOT_FIELDS = [
    StructField("shot", StringType()), StructField("state", StringType()), StructField("live", BooleanType()),
    StructField("played", BooleanType()), StructField("plays", LongType()),
]


def after(event: str, mode: int, live: bool, red: bool, detail: str | None = None, armed: bool = True) -> tuple[int, bool, bool]:
    """State, live and red after an event other than a click."""
    if event == "play":
        return PLAYING, False, red
    if event == "pause":
        return PAUSED, False, red
    if event == "live":
        return IDLE, True, red
    if event == "stop":
        return mode if live else ENDED, live, red
    if event == "finish" and mode == PLAYING and not live:
        return FINISHED.get(detail, ENDED), detail == "return-to-live", red
    if event == "red":
        rises = armed and not red and not live and mode in (CUED, PAUSED)
        return PLAYING if rises else mode, live, True
    if event == "not-red":
        return mode, live, False
    return mode, live, red


def _code(mode: int, live: bool, red: bool) -> int:
    return mode * 4 + live * 2 + red


def shot_machine(armed: bool = True, play_first: bool = False) -> Machine:
    """Events with ``event``, the shot ``clicked`` and, for a finish, its ``ending``."""
    states = [(mode, live, red) for mode in range(5) for live in (False, True) for red in (False, True)]
    tables: dict[tuple, list[int]] = {}

    def table(event: str, detail: str | None) -> list[int]:
        key = event, detail if detail in FINISHED or detail == "return-to-live" else None
        if key not in tables:
            tables[key] = [_code(*after(event, *state, key[1], armed)) for state in states]
        return tables[key]

    def plays(event: str, before: int, code: int) -> bool:
        return event == "red" and states[code][0] == PLAYING and states[before][0] != PLAYING

    # a click on the shot itself, and one on another shot, leave live
    own = [_code(CLICKED[play_first][mode], False, red) for mode, _, red in states]
    other = [_code(CLICKED[play_first][IDLE], False, red) for _, _, red in states]

    def step(state: str | None, rows: Rows) -> tuple[Rows, str]:
        shot, code, count = json.loads(state) if state else (None, 0, 0)
        out: Rows = {f.name: [] for f in SHOT_FIELDS}
        for event, clicked, ending in zip(rows["event"], rows["clicked"], rows["ending"], strict=True):
            played = False
            if event == "click":
                code = own[code] if clicked == shot else other[code]
                shot = clicked
            else:
                before, code = code, table(event, ending)[code]
                played = plays(event, before, code)
                count += played
            mode, live, _ = states[code]
            for values, value in zip(out.values(), (shot, NAMES[mode], live, played, count)):
                values.append(value)
        return out, json.dumps([shot, code, count])

    def extend(effect: dict | None, rows: Rows) -> dict:
        fresh = lambda: [list(range(len(states))), [0] * len(states)]
        # tables before and after the first click, each with the plays by tally
        effect = effect or {"early": fresh(), "first": None, "late": fresh(), "shot": None}
        for event, clicked, ending in zip(rows["event"], rows["clicked"], rows["ending"], strict=True):
            codes, counts = effect["late" if effect["first"] else "early"]
            if event == "click" and not effect["first"]:
                effect |= {"first": [clicked], "shot": clicked}
                continue
            if event == "click":
                codes[:] = [(own if clicked == effect["shot"] else other)[c] for c in codes]
                effect["shot"] = clicked
                continue
            to = table(event, ending)
            if event == "red":
                counts[:] = [n + plays(event, c, to[c]) for n, c in zip(counts, codes)]
            codes[:] = [to[c] for c in codes]
        return effect

    def enter(effect: dict, state: str) -> str:
        shot, code, count = json.loads(state)
        codes, counts = effect["early"]
        code, count = codes[code], count + counts[code]
        if effect["first"]:
            code = own[code] if effect["first"][0] == shot else other[code]
            codes, counts = effect["late"]
            code, count, shot = codes[code], count + counts[code], effect["shot"]
        return json.dumps([shot, code, count])

    return Machine(step, extend, enter)


def shot_life(events: DataFrame, order: list[str], armed: bool = True, play_first: bool = False) -> DataFrame:
    """The shot of each channel after each event.

    ``events``: channel, the order, ``event`` and for clicks ``shot``, for finishes ``ending``. A click cues a shot, plays
    a cued or paused one and pauses a playing one; another shot starts over; with ``play_first`` the first click plays.
    play, pause, stop (not while live) and live act as on the transport. A playing shot that finishes loops, plays or
    cues the next entry, goes live or ends. Where ``armed``, the rising edge of red plays a cued or paused shot of a
    channel that isn't live; ``played`` marks it, ``plays`` counts such plays so far.
    """
    return fold_timeline(machine_events(events, order), ["channel"], order, shot_machine(armed, play_first), SHOT_FIELDS)


def machine_events(events: DataFrame, order: list[str]) -> DataFrame:
    """Events under the names the machine reads; its ``shot`` is the one after the event."""
    return events.select("channel", *order, "event", F.col("shot").alias("clicked"), "ending")


def tally_events(rows: DataFrame, *columns: str) -> DataFrame:
    """Events of rows with a clicked ``shot`` or else a tally that is ``red`` or not."""
    event = F.when(F.col("shot").isNotNull(), "click").when(F.col("red"), "red").otherwise("not-red")
    return rows.select("channel", *columns, event.alias("event"), "shot", F.lit(None).cast("string").alias("ending"))


def tally_plays(rows: DataFrame, order: list[str], armed: bool = True) -> DataFrame:
    """Shots started by a tally, from clicks (``shot``) and tallies (``red``) of each channel."""
    found = shot_life(tally_events(rows, *order), order, armed)
    return found.select("channel", *order, "state", "played")


def tally_counts(displays: DataFrame, plays: DataFrame) -> DataFrame:
    """Counters of tallies: displays that came, those that were damaged, and plays of each channel.

    ``displays`` has an ``error`` where a packet was damaged; ``plays`` is what :func:`shot_life` gives.
    """
    came = displays.agg(F.count("*").alias("tally_rows_total"), F.count("error").alias("tally_errors_total"))
    long = came.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in came.columns]), F.array(*came.columns))).alias("name", "value"))
    per = plays.groupBy("channel").agg(F.count_if("played").alias("value"))
    return long.select("name", F.lit(None).cast("int").alias("channel"), "value").unionByName(
        per.select(F.lit("tally_plays_total").alias("name"), F.col("channel").cast("int"), "value")
    )
