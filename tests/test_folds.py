"""Machines against a plain walk of the rows, with keys cut into many chunks, and their effects by themselves."""

import json
import random

import pytest

from reelgrid.operators import ingest, shots, signal, timeline, transport
from reelgrid.plans.lines import Line
from reelgrid.sources import tally

COMMANDS = ["play", "live", "pause", "stop", "seek", "scrub_frames", "scrub_seconds", "speed", "angle", "mark_in", "mark_out", "goto_in",
            "goto_out", "lock", "motion", "audio", "timecode", "library", "nothing"]
CHOICES = {"motion": "blend", "audio": "follow", "timecode": "source"}


def commands(rng, size):
    rows, grain = [], 0
    for _ in range(size):
        grain += rng.choice([1, 1, 2, 3, 40])
        command = rng.choice(COMMANDS)
        argument = rng.choice([-1.0, 0.0, 0.37, 1.0, 2.0, 3.0, -4.0])
        rows.append((grain, grain * 20, command, argument, rng.randrange(1000), CHOICES.get(command) if rng.random() < 0.7 else "x"))
    return rows


def ticked(rows, period, delay, cameras, ramp):
    """Grain by grain: a playing channel takes a step each grain, ramping to the speed asked for."""
    live, playing, pos, speed, target, start, left = True, False, 0, 1.0, 1.0, 1.0, 0
    marks, angle, settings, now, out = {"in": None, "out": None}, 1, {}, None, []
    for grain, tai, command, argument, to_ns, choice in rows:
        for _ in range(grain - now if now is not None else 0):
            if playing:
                if left > 0:
                    speed, left = start + (target - start) * (ramp - left + 1) / ramp, left - 1
                else:
                    speed = target
                pos += transport.whole(speed * period)
        now = grain
        if live:
            pos = tai - delay
        if command == "play":
            live, playing = False, True
        elif command == "live":
            live, playing, angle = True, False, angle or 1
        elif command == "pause":
            live = playing = False
        elif command == "stop":
            playing = False
        elif command == "seek":
            live, pos = False, to_ns
        elif command == "scrub_frames":
            live, playing, pos = False, False, pos + int(argument) * period
        elif command == "scrub_seconds":
            live, playing, pos = False, False, pos + transport.whole(argument * 1e9)
        elif command == "speed":
            start, target, left = speed, max(-1.0, min(2.0, argument)), ramp
            speed = target if ramp == 0 else speed
        elif command == "angle" and 1 <= argument <= cameras:
            angle = int(argument)
        elif command == "library":
            angle = 0
        elif command in ("mark_in", "mark_out"):
            marks[command[5:]] = max(0, pos)
        elif command in ("goto_in", "goto_out") and marks[command[5:]] is not None:
            live, playing, pos = False, False, marks[command[5:]]
        elif command == "lock":
            settings["locked"] = argument != 0
        elif command in CHOICES and choice == CHOICES[command]:
            settings[command] = choice
        mode = "live" if live else "playing" if playing else "paused"
        out.append((mode, pos, round(speed, 9), marks["in"], marks["out"], angle, *(settings.get(s) for s in ("locked", "motion", "audio", "timecode"))))
    return out


@pytest.mark.parametrize("ramp", [0, 3, 7])
def test_transport_grain_by_grain(spark, ramp):
    rng = random.Random(ramp)
    # nine tenths of the rows belong to one channel
    keys = {1: commands(rng, 900), 2: commands(rng, 60), 3: commands(rng, 40)}
    # a long stretch in which only the ramp goes on, and one that keeps marks
    keys[1] += [(keys[1][-1][0] + 1 + i, 0, "nothing" if i % 7 else "speed", 0.1 * (i % 23), 0, None) for i in range(300)]
    rows = [(c, *r) for c, own in keys.items() for r in own]
    df = spark.createDataFrame(rows, "channel int, grain long, tai_ns long, command string, argument double, to_ns long, choice string")
    found = transport.transport_fold(df.repartition(5), ["grain"], 20, 40, 4, ramp)
    got = {}
    for r in found.orderBy("channel", "grain").collect():
        got.setdefault(r.channel, []).append((r.mode, r.position_ns, round(r.speed, 9), r.in_ns, r.out_ns, r.angle, r.locked, r.motion, r.audio, r.timecode))
    for channel, own in keys.items():
        want = ticked(own, 20, 40, 4, ramp)
        assert got[channel] == want
        # the step of a stream, in three parts, gives the same
        step, state, streamed = transport.transport_step(20, 40, 4, ramp), None, []
        for part in (own[:7], own[7:30], own[30:]):
            columns = dict(zip(("grain", "tai_ns", "command", "argument", "to_ns", "choice"), map(list, zip(*part))))
            values, state = step(state, columns)
            streamed += [(m, p, round(s, 9), i, o, a, *rest) for m, p, s, i, o, a, *rest in zip(*(values[f.name] for f in transport.TRANSPORT_FIELDS))]
        assert streamed == want


def effects_agree(machine, columns, rows, states, parts=(1, 2, 5)):
    """For any state before some rows: stepping through them ends where their effect does, however they are cut."""
    for state in states:
        _, after = machine.step(state, {c: [r[n] for r in rows] for n, c in enumerate(columns)})
        for many in parts:
            effect = None
            for i in range(0, len(rows), max(1, len(rows) // many)):
                part = rows[i : i + max(1, len(rows) // many)]
                effect = machine.extend(effect, {c: [r[n] for r in part] for n, c in enumerate(columns)})
            entered = machine.enter(effect, state)
            yield json.loads(after), json.loads(entered) if entered else None


@pytest.mark.parametrize("pieces", [2, 32])
def test_effect_of_a_clock(monkeypatch, pieces):
    monkeypatch.setattr(ingest, "CLOCK_PIECES", pieces)
    rng, known = random.Random(5), 0
    machine = ingest.clock_machine(40)
    for trial in range(200):
        at, rows = 0, []
        for _ in range(rng.randrange(1, 30)):
            at += rng.randrange(-60, 200)
            rows.append((max(0, at) if rng.random() < 0.4 else -1, rng.choice([0, 0, 0, 40, 25])))
        states = [json.dumps([rng.randrange(0, 3000), rng.choice([1, 40, 77])]) for _ in range(5)]
        for want, got in effects_agree(machine, ["start_ns", "duration_ns"], rows, states):
            assert got is None or want == got, (trial, rows)
            known += got is not None
    assert known >= 1500


def test_effect_of_a_clock_stays_small():
    machine = ingest.clock_machine(40)
    bent = [(100 * i if i % 3 == 0 else -1, 0) for i in range(1500)]
    for rows in ([(-1, 0)] * 1500, [(40 * i, 0) for i in range(1500)], bent, [*bent, (10**9, 25), (-1, 0)]):
        effect = machine.extend(None, {"start_ns": [r[0] for r in rows], "duration_ns": [r[1] for r in rows]})
        assert len(effect[3] or ()) <= 32
        state = json.dumps([1234, 40])
        found = machine.enter(effect, state)
        assert (found is None) == (rows is bent)
        assert found is None or found == machine.step(state, {"start_ns": [r[0] for r in rows], "duration_ns": [r[1] for r in rows]})[1]


def test_clock_of_one_long_file(spark):
    rows = [(1, i, 100 * i if i % 3 == 0 else -1, 0) for i in range(2000)] + [(2, i, -1, 0) for i in range(2000)] + [(3, 0, 7, 0)]
    found = ingest.source_clock(spark.createDataFrame(rows, "file int, n long, start_ns long, duration_ns long").repartition(3), 40)
    got = {(r.file, r.n): (r.at_ns, r.length_ns) for r in found.collect()}
    step, state, now = ingest.clock_machine(40).step, None, None
    for file, n, at, duration in rows:
        state = state if file == now else None
        values, state = step(state, {"start_ns": [at], "duration_ns": [duration]})
        now = file
        assert got[file, n] == (values["at_ns"][0], values["length_ns"][0])


def test_effect_of_shots():
    rng = random.Random(6)
    events = ["click", "click", "play", "pause", "stop", "live", "finish", "red", "not-red"]
    for armed in (True, False):
        for play_first in (True, False):
            machine = shots.shot_machine(armed, play_first)
            for _ in range(40):
                row = lambda: (rng.choice(events), rng.choice("ab"), rng.choice(["loop", "next", "next-cued", "freeze", "return-to-live"]))
                rows = [row() for _ in range(rng.randrange(1, 25))]
                states = [json.dumps([rng.choice(["a", "b", None]), code, 3]) for code in range(20)]
                for want, got in effects_agree(machine, ["event", "clicked", "ending"], rows, states):
                    assert want == got


def test_effect_of_a_ramp():
    rng = random.Random(7)
    for ramp in (0, 4):
        machine = timeline._ramp_machine(ramp)
        for _ in range(100):
            n, rows = 50, []
            for _ in range(rng.randrange(1, 20)):
                n += rng.randrange(1, 8)
                rows.append((rng.uniform(-1, 2), n))
            states = [json.dumps([rng.uniform(-1, 2), rng.uniform(-1, 2), rng.randrange(40, 50)]) for _ in range(4)]
            for want, got in effects_agree(machine, ["_to", "_n"], rows, states):
                assert want == pytest.approx(got, abs=1e-12)


def test_effect_of_joins():
    rng = random.Random(8)
    for _ in range(200):
        rows = [(rng.randrange(1, 60), rng.randrange(0, 50), rng.randrange(0, 30)) for _ in range(rng.randrange(1, 15))]
        for want, got in effects_agree(timeline.JOINS, ["_grains", "_frames", "_plan"], rows, [str(f) for f in (-5, 0, 1, 7, 40, 200)]):
            assert want == got


def test_effect_of_a_bed():
    rng = random.Random(9)
    machine = signal.bed_machine(12, -10.0, 1.5, 0.75)
    for _ in range(200):
        at, rows = 100, []
        for _ in range(rng.randrange(1, 15)):
            at += rng.randrange(1, 9)
            rows.append((at, rng.random() < 0.5, rng.random() < 0.5, rng.random() < 0.08))
        states = [json.dumps([rng.random() < 0.5, rng.random() < 0.5, rng.randrange(90, 100), fade, -rng.uniform(0, 10), rng.randrange(99)]) for fade in (0, 1, 5, 12)]
        for want, got in effects_agree(machine, ["_i", "wanted", "ducked", "restart"], rows, states):
            assert want == pytest.approx(got, abs=1e-9)


def test_effect_of_framing():
    rng = random.Random(10)
    machine = tally.framing_machine("data")
    packet = b"\x06\x00abcd\xfe\xfe"
    for _ in range(400):
        parts = [rng.choice([b"\xfe", b"\xfe\xfe", b"\xfe\x02", b"\xfe\x03", b"\x02", b"\x03", b"ab", b"\xfe\x07", packet]) for _ in range(rng.randrange(1, 9))]
        states = [s.hex() for s in (b"", b"\xfe", b"\xfe\x02", b"\xfe\x02\x09\x00abc", b"\xfe\x02\x09\x00ab\xfe")]
        for state in states:
            _, after = machine.step(state, {"data": parts})
            for cut in (1, 2, 8):
                effect = None
                for i in range(0, len(parts), cut):
                    effect = machine.extend(effect, {"data": parts[i : i + cut]})
                assert machine.enter(effect, state) == after, (parts, state)
    # without a mark the effect is bounded by the longest packet
    effect = None
    for _ in range(40):
        effect = machine.extend(effect, {"data": [b"x" * 10_000]})
    assert effect == (b"", "")


def test_lines_follow_lines():
    rng = random.Random(11)
    draw = lambda: Line(rng.choice([1, -1]), rng.randrange(-9, 9), *sorted(rng.sample(range(-20, 20), 2)))
    for _ in range(300):
        first, second = draw(), draw()
        for x in range(-30, 30):
            assert first.then(second)(x) == second(first(x))


def test_shots_of_one_hot_channel(spark):
    rng = random.Random(12)
    kinds = ["click", "red", "not-red", "pause", "play", "finish", "live", "stop"]
    rows = [(1 if rng.random() < 0.9 else 2, n, rng.choice(kinds), rng.choice("ab"), rng.choice(["loop", "next-cued", "black"])) for n in range(2500)]
    df = spark.createDataFrame(rows, "channel int, n long, event string, shot string, ending string")
    got = {(r.channel, r.n): (r.shot, r.state, r.live, r.played, r.plays) for r in shots.shot_life(df, ["n"]).collect()}
    names = dict(zip(("idle", "cued", "playing", "paused", "ended"), range(5)))
    now = {}
    for channel, n, event, shot, ending in rows:
        own, mode, live, red, plays = now.get(channel, (None, "idle", False, False, 0))
        played = False
        if event == "click":
            mode = {"idle": "cued", "ended": "cued", "cued": "playing", "paused": "playing", "playing": "paused"}[mode if shot == own else "idle"]
            own, live = shot, False
        elif event == "red":
            played = not red and not live and mode in ("cued", "paused")
            mode, red, plays = "playing" if played else mode, True, plays + played
        elif event == "not-red":
            red = False
        elif event == "finish" and mode == "playing" and not live:
            mode = {"loop": "playing", "next-cued": "cued"}.get(ending, "ended")
        elif event in ("play", "pause"):
            mode, live = {"play": "playing", "pause": "paused"}[event], False
        elif event == "live":
            mode, live = "idle", True
        elif event == "stop" and not live:
            mode = "ended"
        assert mode in names
        now[channel] = own, mode, live, red, plays
        assert got[channel, n] == (own, mode, live, played, plays)
