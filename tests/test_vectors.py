"""Fixed input and output values of single operators."""

import math
import uuid

import pytest
from pyspark.sql import functions as F

from reelgrid.functions import identity, playout, timebase
from reelgrid.operators import documents as catalogue
from reelgrid.operators import catalog, ingest, joins, lookahead, shots, signal, store, timeline
from reelgrid.sources import documents, tally

MS = 1_000_000
SECOND = 1_000_000_000


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).orderBy(*columns).collect()]


def test_index_and_period(spark):
    assert value(spark, timebase.ts_to_index(F.lit(0), 50, 1)) == 0
    first = value(spark, timebase.index_to_ts(F.lit(1), 30000, 1001))
    assert value(spark, timebase.ts_to_index(F.lit(first), 30000, 1001)) == 1
    assert value(spark, timebase.frame_period_ns(50, 1)) == 20 * MS
    assert value(spark, timebase.ts_to_index(F.lit(5), 0, 1)) is None
    big = 1_767_225_600_123_456_789
    assert value(spark, timebase.ts_to_index(F.lit(big), 60000, 1001)) == (big * 60000 + 500_000_000 * 1001) // (10**9 * 1001)


def test_timecode_round_trip(spark):
    at = (((13 * 60) + 7) * 60 + 42) * SECOND + 31 * 20 * MS
    assert value(spark, timebase.timecode(F.lit(at), 50, 1)) == "13:07:42:31"
    assert value(spark, timebase.timecode(F.lit(at), 50, 1, True)) == "13:07:42;31"


def test_cadence(spark):
    assert value(spark, timebase.samples_for_frame(F.lit(7), 50, 1)) == 960
    assert value(spark, timebase.samples_until(F.lit(5), 30000, 1001)) == 8008
    assert value(spark, timebase.samples_until(F.lit(5), 60000, 1001)) == 4004


def test_rate_and_format_tokens(spark):
    tokens = spark.createDataFrame([("1080i25",), ("1080i25bff",), ("720p5994",), ("1081x1080p50",), ("1280x720i25",), ("abc",)], "t string")
    found = {r.t: r for r in timebase.parse_formats(tokens, "t").collect()}
    assert (found["1080i25"].width, found["1080i25"].interlaced, found["1080i25"].num) == (1920, True, 25)
    assert (found["720p5994"].num, found["720p5994"].den) == (60000, 1001)
    assert [found[t].error for t in ("1080i25bff", "1081x1080p50", "1280x720i25", "abc")] == ["bff", "format", "interlaced", "no_mode"]


def test_uuid_matches_the_standard(spark):
    for name in ("studio/node", "studio/in/1/audio", ""):
        assert value(spark, identity.uuid_v5(F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_storage_estimate(spark):
    assert 60e9 < value(spark, timebase.bytes_per_hour(F.lit(1920), F.lit(1080), F.lit(92), 50)) < 80e9


def test_speed_ramp(spark):
    ticks = spark.createDataFrame([(1, 1, None), (1, 2, 0.5), (1, 3, None), (1, 4, None), (1, 5, None)], "channel int, grain long, target double")
    speeds = [r.speed for r in timeline.speed_ramp(ticks, 3).orderBy("grain").collect()]
    assert speeds == pytest.approx([1, 0.8333333, 0.6666667, 0.5, 0.5])


@pytest.mark.parametrize(
    "position,motion,factor,kind,a,phase",
    [(5 * MS, "interpolate", 3, "interpolate", 0, 0.75), (400_000, "interpolate", 3, "repeat", 0, 0.0), (5 * MS, "repeat", 3, "repeat", 1, 0.0)],
)
def test_pick(spark, position, motion, factor, kind, a, phase):
    given = spark.createDataFrame([(position,)], "p long")
    pick = timeline.with_pick(given, "k", "p", 20 * MS, F.lit(factor), F.lit(1), 0.1, F.lit(motion)).first().k
    assert (pick.kind, pick.a) == (kind, a)
    assert pick.phase == pytest.approx(phase)


def test_phases(spark):
    grains = spark.createDataFrame([(1, 0, 0, 1000, True, 10, 0), (1, 0, 2, 1000, True, 12, 1)], "camera int, house_index long, phase int, tai_ns long, present boolean, payload_id long, seq long")
    found = rows(ingest.phase_interleave(grains, 3, 30000, "seq"), "time_ns", "payload_id", "repeated", "missing")
    assert found == [(1000, 10, False, 1), (11000, 10, True, 1), (21000, 12, False, 1)]


def test_drops(spark):
    history = 50 * 20 * MS
    events = spark.createDataFrame(
        [(1, SECOND, "wait"), (1, SECOND + 5 * MS, "late"), (2, SECOND, "wait"), (2, SECOND + history, "late"), (3, 5, "late"), (4, 1, "wait"), (4, 2, "read"), (4, 3, "late")],
        "camera int, tai_ns long, event string",
    )
    assert rows(ingest.drop_classify(events, history, ["tai_ns"]), "camera", "dropped") == [(1, False), (2, True), (3, True), (4, True)]


def test_stall(spark):
    events = spark.createDataFrame([(1, SECOND, "recorded"), (1, 8 * SECOND, "recorded")], "camera int, tai_ns long, event string")
    found = rows(ingest.input_stalls(events, 2 * SECOND, F.lit(9 * SECOND)), "tai_ns", "change", "reason", "gap_ns")
    assert found == [(3 * SECOND, "stopped", "no_grains", None), (8 * SECOND, "resumed", None, 7 * SECOND)]


@pytest.fixture(scope="module")
def recorded(spark):
    return spark.createDataFrame([(1, i * SECOND // 2, 10) for i in range(1, 21)], "camera int, tai_ns long, payload_bytes int")


def test_segments_and_retention(spark, recorded):
    segments = store.segment_stats(store.segment_assign(recorded, SECOND, ["payload_bytes"])).cache()
    spans = [(a / SECOND, b / SECOND) for a, b in rows(segments, "first_ns", "last_ns")]
    assert spans == [(0.5, 1.5), (2, 3), (3.5, 4.5), (5, 6), (6.5, 7.5), (8, 9), (9.5, 10)]
    one = spark.createDataFrame([(1, SECOND, SECOND)], "camera int, begin_ns long, end_ns long")
    kept = store.retention(segments, one, 3 * SECOND).filter("not expired")
    assert (kept.count(), kept.agg(F.sum("frames")).first()[0]) == (4, 11)
    assert store.retention(segments, one.limit(0), 3 * SECOND).filter("not expired").count() == 3
    held = store.protected_bytes(segments, one).first()
    assert held.protected_bytes == 8 + 3 * (16 + 2 + 8)


def test_lookups(spark, recorded):
    probes = spark.createDataFrame([(1, 1, 3 * SECOND // 2 + 1), (2, 1, 6 * SECOND), (3, 1, 7 * SECOND // 4), (4, 2, 5)], "probe long, camera int, at_ns long")
    near = {r.probe: r.frame and r.frame.tai_ns for r in joins.nearest_frame(probes, recorded).collect()}
    assert near == {1: 3 * SECOND // 2, 2: 6 * SECOND, 3: 3 * SECOND // 2, 4: None}
    early = recorded.filter(F.col("tai_ns") <= 3 * SECOND // 2)
    assert joins.at_or_before(probes, early).filter("probe = 2").first().frame.tai_ns == 3 * SECOND // 2
    assert joins.after(probes, recorded).filter("probe = 2").first().frame.tai_ns == 13 * SECOND // 2


def test_release_keeps_an_equal_range(spark):
    held = spark.createDataFrame([(1, 10, 20), (1, 10, 20), (1, 30, 25)], "camera int, begin_ns long, end_ns long")
    gone = spark.createDataFrame([(1, 20, 10), (1, 25, 30)], "camera int, begin_ns long, end_ns long")
    assert rows(store.range_release(held, gone), "begin_ns", "end_ns", "holders") == [(10, 20, 1)]


@pytest.mark.parametrize("args,left", [((0, 2000, 1.0), 2000), ((1000, 2000, 0.5), 2000), ((2100, 2000, 1.0), 0), ((0, 2000, 0.0), None)])
def test_clip_remaining(spark, args, left):
    assert value(spark, playout.clip_remaining(*map(F.lit, args))) == left


def entries(spark, present, ends=None, autos=None, loop=False):
    data = [("p", i, f"c{i}", 0, 100 * MS * (i + 1), 1.0, (ends or ["next"] * 9)[i], (autos or [True] * 9)[i], "cut", 0, 0, bool(x), loop) for i, x in enumerate(present)]
    return spark.createDataFrame(data, "playlist string, position long, clip_id string, in_ns long, out_ns long, speed double, end_action string, auto_advance boolean, transition string, transition_frames int, audio_frames int, present boolean, loop boolean")


def test_idle_next(spark):
    found = dict(rows(timeline.idle_next(entries(spark, [1, 0, 1])), "position", "next_position"))
    assert (found[0], found[2]) == (2, 0)
    assert {n for _, n in rows(timeline.idle_next(entries(spark, [0, 0])), "position", "next_position")} == {None}


def test_remaining_stops_and_loops(spark):
    given = entries(spark, [1, 0, 1, 1], ["next", "loop", "next", "freeze"]).withColumn("left_ns", F.lit(10 * MS))
    found = dict(rows(timeline.playlist_remaining(given, 20 * MS), "position", "remaining_ns"))
    assert found == {0: 710 * MS, 1: None, 2: 410 * MS, 3: 10 * MS}
    loop = entries(spark, [1, 1], ["next", "loop"]).withColumn("left_ns", F.lit(10 * MS))
    assert dict(rows(timeline.playlist_remaining(loop, 20 * MS), "position", "remaining_ns"))[0] is None


def test_unroll_counts_grains(spark):
    found = rows(timeline.playlist_unroll(entries(spark, [1, 0, 1, 1], ["next", "next", "next", "freeze"]), 20 * MS), "position", "start_grain", "grains", "outcome")
    # 100 ms are five grains; the first entry starts one step in, so it shows four.
    assert found == [(0, 0, 4, "next"), (2, 4, 15, "next"), (3, 19, 20, "freeze")]


def test_end_action_wraps(spark):
    found = timeline.end_action(entries(spark, [1, 1, 0], ["next", "freeze", "next"], loop=True)).filter("position = 1").first()
    assert (found.action, found.next_position, found.plays_on) == ("next", 0, True)


def test_shots(spark):
    clicks = spark.createDataFrame([(1, i, s) for i, s in enumerate("aaabaa")], "channel int, grain long, shot string")
    states = [r.state for r in timeline.shot_states(clicks).orderBy("grain").collect()]
    assert states == ["cued", "playing", "paused", "cued", "cued", "playing"]
    first = [r.state for r in timeline.shot_states(clicks, play_first=True).orderBy("grain").collect()]
    assert first == ["playing", "paused", "playing", "playing", "playing", "paused"]


def test_mix(spark):
    weights = [value(spark, playout.mix_weight(F.lit(k), F.lit(25))) for k in (0, 12, 24, -1, 25)]
    assert weights == pytest.approx([1 / 26, 0.5, 25 / 26, 0, 1])
    assert value(spark, playout.blend_sample(F.lit(200), F.lit(800), F.lit(512))) == 500
    assert value(spark, playout.blend_sample(F.lit(1023), F.lit(0), F.lit(39))) == 984


@pytest.mark.parametrize(
    "transition,frames,audio,plan", [("cut", 0, -1, (0, 2)), ("mix", 0, -1, (25, 25)), ("mix", 10, -1, (10, 10)), ("mix", 10, 0, (10, 0)), ("mix", 10, 30, (10, 30)), ("cut", 0, 5, (0, 5))]
)
def test_transition_plan(spark, transition, frames, audio, plan):
    found = value(spark, playout.transition_frames(F.lit(transition), F.lit(frames), F.lit(audio)))
    assert (found.video, found.audio, found.length) == (*plan, max(plan))


def test_crossfade_keeps_power(spark):
    gains = spark.range(100).select(playout.crossfade_gains(F.col("id"), F.lit(100)).alias("g")).collect()
    assert all(abs(r.g["out"] ** 2 + r.g["in"] ** 2 - 1) < 1e-6 for r in gains)
    outs = [r.g["out"] for r in gains]
    assert max(abs(a - b) for a, b in zip(outs, outs[1:])) <= math.pi / 200


def test_duck_fades_edges(spark):
    samples = spark.createDataFrame([(1, n, n < 4800) for n in range(9600)], "channel int, n long, ducked boolean")
    gains = {r.n: r.gain_db for r in signal.duck_ramp(samples, "channel", -12.0, 4800, 4800).collect()}
    assert (gains[4799], gains[7199], gains[9599]) == pytest.approx((-12, -6, 0))
    assert value(spark, playout.end_fade(F.lit(500), F.lit(1000))) == 0.5
    assert value(spark, playout.edge_gain(F.lit(0), F.lit(48000))) == pytest.approx(0.5 / 240)


@pytest.mark.parametrize(
    "num,den,count,step,end,order",
    [(50, 1, 50, 40 * MS, 40 * MS, [i // 2 for i in range(100)]), (25, 1, 100, 20 * MS, 20 * MS, list(range(0, 100, 2))), (25, 1, 1, 0, 40 * MS, [0])],
)
def test_rate_conversion(spark, num, den, count, step, end, order):
    source = spark.createDataFrame([("f", n, n * step, end) for n in range(count)], "file string, n long, start_ns long, duration_ns long")
    shown = rows(ingest.rate_convert(source, num, den), "house_frame", "n")
    assert [n for _, n in shown] == order


def test_rate_conversion_keeps_durations(spark):
    ntsc = spark.createDataFrame([("f", n, n * 1001 * SECOND // 30000, 1001 * SECOND // 30000) for n in range(300)], "file string, n long, start_ns long, duration_ns long")
    assert ingest.rate_convert(ntsc, 25, 1).count() == 250
    pal = spark.createDataFrame([("f", n, n * 40 * MS, 40 * MS) for n in range(250)], "file string, n long, start_ns long, duration_ns long")
    assert ingest.rate_convert(pal, 30000, 1001).count() == 300


def test_source_clock(spark):
    given = [(0, 40), (-1, 0), (80, 0), (-1, 0), (100, 40), (160, 20)]
    frames = spark.createDataFrame([("f", n, s * MS if s > 0 else s, d * MS) for n, (s, d) in enumerate(given)], "file string, n long, start_ns long, duration_ns long")
    found = ingest.source_clock(frames, 40 * MS).orderBy("n").collect()
    assert [r.at_ns // MS for r in found] == [0, 40, 80, 120, 120, 160]
    assert (found[-1].at_ns + found[-1].length_ns) // MS == 180


def test_demands(spark):
    state = "state long, position_ns long, speed double, playing boolean, motion string"
    half = spark.createDataFrame([(1, 0, 0.5, True, "interpolate"), (2, 200 * MS, -0.5, True, "interpolate")], state)
    assert rows(lookahead.pair_demand(half, 20 * MS, 0.1).filter("state = 1"), "a", "b", "first") == [(0, 1, 1), (1, 2, 3), (2, 3, 5), (3, 4, 7)]
    assert rows(lookahead.pair_demand(half, 20 * MS, 0.1).filter("state = 2"), F.col("first"), "a") == [(1, 9), (3, 8), (5, 7), (7, 6)]
    whole = spark.createDataFrame([(1, 200 * MS, 1.0, True, "repeat"), (2, 200 * MS, 2.0, True, "repeat"), (3, 200 * MS, -1.0, True, "repeat")], state)
    one = lookahead.source(F.lit(1), F.col("position_ns"), F.col("speed"), F.col("playing"), F.lit("repeat"))
    planned = lookahead.decode_plan(whole, F.array(one), 20 * MS, 0.1, 2)
    numbered = lookahead.frame_demand(planned).withColumn("frame", F.col("frame_ns") / (20 * MS))
    assert rows(numbered, "state", "place", "frame") == [(1, 1, 11), (1, 2, 12), (2, 1, 12), (2, 2, 14), (3, 1, 9), (3, 2, 8)]


@pytest.mark.parametrize(
    "definition,reason,woven",
    [
        ('{"interlace_mode":"interlaced_tff","grain_rate":{"numerator":25,"denominator":1}}', None, True),
        ('{"interlace_mode":"interlaced_bff","grain_rate":{"numerator":25}}', "interlaced_bff", False),
        ('{"interlace_mode":"interlaced_tff","grain_rate":{"numerator":30000,"denominator":1001}}', "interlaced_rate", False),
        ('{"interlace_mode":"progressive","grain_rate":{"numerator":50,"denominator":1}}', "rate", False),
        ('{"grain_rate":{"numerator":25,"denominator":1},"frame_width":1280,"frame_height":720}', "raster", False),
        ("", None, False),
    ],
)
def test_flow(spark, definition, reason, woven):
    flows = documents.with_flow(spark.range(1), F.lit(definition)).select(documents.flow_compat(1920, 1080, 25, 1, True).alias("f"))
    assert tuple(flows.first().f) == (reason, woven)


def test_fields_round_trip(spark):
    fields = spark.createDataFrame([(42, [1, 3, 5, 7], True), (43, [2, 4, 6, 8], True), (44, [9, 9, 9, 9], True)], "grain long, luma array<int>, valid boolean")
    woven = ingest.field_weave(fields, 1, 4)
    assert woven.first().luma == list(range(1, 9))
    assert woven.select(ingest.field_of(F.col("luma"), 1, 1, 8).alias("f")).first().f == [2, 4, 6, 8]
    assert ingest.field_weave(fields, 1, 4, top_first=False).first().luma == [2, 1, 4, 3, 6, 5, 8, 7]


def test_tally_text_and_errors():
    def packet(flags, body):
        inner = bytes([0, flags]) + (3).to_bytes(2, "little") + body
        return len(inner).to_bytes(2, "little") + inner

    def display(index, control, text):
        return index.to_bytes(2, "little") + control.to_bytes(2, "little") + len(text).to_bytes(2, "little") + text

    special = (9).to_bytes(2, "little") + (0x8000).to_bytes(2, "little") + (2).to_bytes(2, "little") + b"xx"
    wide = "Å".encode("utf-16-le") + b"\x00\xd8" + "z".encode("utf-16-le")
    good = packet(1, special + display(4, 0b11_01_10_01, wide))
    assert tally.displays(good) == [(3, 4, 1, 1, 2, 3, "Å�z", None)]
    assert tally.displays(packet(0, display(1, 0, b"A\xffB\0\0")))[0][6] == "A�B"
    assert tally.displays(good[:-3])[0][7] == "pbc" and tally.displays(b"\x01")[0][7] == "short"
    assert tally.displays(packet(0, display(1, 0, b"abc")[:-2]))[0][7] == "text"
    assert tally.displays(packet(2, display(1, 0, b"abc"))) == []


def test_tally_framing():
    body = bytes([4, 0, 0xFE, 2, 9, 9])
    framed = bytes([0xFE, 2]) + body.replace(b"\xfe", b"\xfe\xfe") + bytes([0xFE, 3])
    packets, left = [], b""
    for at in range(0, len(framed) * 2, 3):
        found, left = tally.split_framed(left + (framed + framed)[at : at + 3])
        packets += found
    assert packets == [body, body]
    # a mark ends a packet that is too short, bytes after the stated length and outside of packets go
    short, long = b"\x09\x00ab", b"\x01\x00abc"
    assert tally.split_framed(b"zz\xfe\x02" + short + b"\xfe\x02" + long + b"\xfe\x03\xfe\xfe\xfe\x02\xfe\x03\xfe") == ([short, b"\x01\x00a"], b"\xfe")
    assert tally.split_framed(b"\xfe\x02\x02") == ([], b"\xfe\x02\x02")
    assert tally.split_framed(b"\xfe\x02\x02\x00\xfe\x07a\xfe\xfe") == ([b"\x02\x00a\xfe"], b"")


def test_tally_colour_and_display(spark):
    assert value(spark, playout.tally_effective(F.lit(1), F.lit(2), F.lit(3))) == 3
    assert value(spark, playout.tally_effective(F.lit(1), F.lit(2), F.lit(0))) == 2
    shown = spark.createDataFrame([(0, 0), (0, 3)], "screen int, display int")
    assert rows(joins.display_channel(shown, ""), "display", "channel") == [(0, 1), (3, 4)]
    assert rows(joins.display_channel(shown, "2:4,3:1"), "display", "channel") == [(3, 1)]


def test_tally_plays_on_the_edge(spark):
    given = [("a", False), (None, True), (None, True), (None, False), ("a", False), (None, True)]
    events = spark.createDataFrame([(1, i, s, r) for i, (s, r) in enumerate(given)], "channel int, grain long, shot string, red boolean")
    assert [r.played for r in shots.tally_plays(events, ["grain"]).orderBy("grain").collect()] == [False, True, False, False, False, True]


def test_sound(spark):
    block = spark.createDataFrame([([1.0] * 2000,)], "pcm array<double>")
    sizes = block.select(*[F.size(signal.audio_follow("pcm", F.lit(s))).alias(f"s{i}") for i, s in enumerate((2.0, 0.5))]).first()
    assert tuple(sizes) == (1000, 4000)
    fade = block.select(playout.gain_ramp("pcm", F.lit(1.0), F.lit(0.5)).alias("g")).first().g
    assert (fade[0], fade[-1]) == (1.0, 0.5)


def test_picture_quality(spark):
    def blob(cx):
        return [math.exp(-((x - cx) ** 2 + (y - 16) ** 2) / 72) for y in range(32) for x in range(64)]

    pairs = spark.createDataFrame([(1, blob(24), blob(24)), (2, blob(20), blob(24)), (3, blob(24), blob(24.01))], "id int, a array<double>, b array<double>")
    quality = {r.id: r.p for r in pairs.select("id", signal.psnr("a", "b", 1.0).alias("p")).collect()}
    assert quality[1] == 99 and quality[2] < 40 < quality[3]
    similar = dict(rows(signal.ssim(pairs, ["id"], 64, 32, 1.0), "id", "ssim"))
    assert similar[1] == pytest.approx(1) and similar[2] < 0.95 < similar[3]


def test_rules(spark):
    given = spark.createDataFrame([(0.0,), (1.0,), (2.5,)], "speed double").selectExpr("speed", "'blend' motion", "'mute' audio", "'live' end_action", "1L in_ns", "2L out_ns")
    assert [r.p for r in given.select("speed", catalog.clip_rule().alias("p")).orderBy("speed").collect()] == ["speed:range", None, "speed:range"]


def test_decode_plan_of_several_sources(spark):
    def plan(*sources, following=None, grains=2):
        given = [lookahead.source(c, int(at * 20 * MS), v, True, motion, until_ns=until, both=both) for c, at, v, motion, until, both in sources]
        after = F.array(*[F.struct(F.lit(c).alias("camera"), F.lit(f * 20 * MS).alias("frame_ns")) for c, f in following]) if following else None
        row = lookahead.decode_plan(spark.range(1), F.array(*given), 20 * MS, 0.1, grains, after).first()
        return [[(f.camera, f.frame_ns // (20 * MS)) for f in frames] for frames in (row.plan, row.keep)]

    assert plan((1, 10, 1.0, "repeat", None, True)) == [[(1, 11), (1, 12)], [(1, 10)]]
    assert plan((1, 10.5, 0.5, "interpolate", None, True)) == [[(1, 12)], [(1, 10), (1, 11)]]
    assert plan((1, 10.5, 0.5, "interpolate", None, False))[1] == []
    ends = (1, 10, 1.0, "repeat", 11 * 20 * MS, True)
    assert plan(ends, following=[(0, 500), (0, 501)])[0] == [(1, 11), (0, 500), (0, 501)]
    assert plan(ends, following=[(1, 2), (1, 3)])[0] == [(1, 11), (1, 2), (1, 3)]
    mix = (0, 500, 1.0, "repeat", None, True), (1, 20, 1.0, "repeat", 21 * 20 * MS, True)
    assert plan(*mix) == [[(0, 501), (1, 21), (0, 502)], [(0, 500), (1, 20)]]
    first = spark.range(1).select(lookahead.opening(F.lit(2), F.lit(40 * MS), F.lit(0.5), 20 * MS, 0.1).alias("o")).first().o
    assert [(f.camera, f.frame_ns // (20 * MS)) for f in first] == [(2, 2), (2, 3), (2, 4), (2, 5)]


def test_pairs_are_recorded(spark):
    df = spark.sql(f"select 1 state, {10 * 20 * MS + 10 * MS}L position_ns, 1.0D speed, true playing, {12 * 20 * MS}L newest")
    found = lookahead.pair_demand(df, 20 * MS, 0.1, recorded="newest")
    assert "Exchange" not in found._jdf.queryExecution().toString()
    assert rows(found, "a", "b", "first", "last") == [(11, 12, 1, 1)]


def test_all_pairs_of_every_state_are_asked_for(spark):
    import __spark_entry__ as contract

    folder = "/root/testdata/sf0.001"
    at = spark.read.parquet(f"{folder}/events.parquet").selectExpr("event_id state", "event_id % 20 ms", "(event_id % 7 - 2) / 4.0D speed", "event_id % 5 <> 0 playing")
    most = contract.queries()["pair_demand"](spark, folder).join(at, "state").filter("playing and speed = 1.0 and ms between 3 and 17").groupBy("state").count()
    assert {r["count"] for r in most.collect()} == {8}


def test_pairs_are_not_interpreted_node_by_node(spark):
    import __spark_entry__ as contract

    text = contract.queries()["pair_demand"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in text and "Exchange" not in text


@pytest.mark.parametrize("name", ["pair_demand", "frame_demand"])
def test_demands_are_computed_once(spark, name):
    import __spark_entry__ as contract

    text = contract.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert text.count("ArrowEvalPython") == 1


def test_unknown_places_ask_for_pairs_at_0(spark):
    state = "state long, position_ns long, speed double, playing boolean, motion string"
    given = [(1, None, 1.0, True, None), (2, 30 * MS, None, True, None), (3, 30 * MS, 0.0, False, None), (4, 30 * MS, 0.5, None, None)]
    found = lookahead.pair_demand(spark.createDataFrame(given, state), 20 * MS, 0.1)
    assert rows(found, "state", "a", "b", "first", "last") == [(3, 1, 2, 1, 8), (4, 1, 2, 1, 1), (4, 2, 3, 3, 3), (4, 3, 4, 5, 5), (4, 4, 5, 7, 7)]


@pytest.mark.parametrize("position,speed,reason", [(0, 1e15, "too great"), (0, -1e13, "too great"), (2**63 - 5, 1.0, "overflow"), (4 * 10**18, 4e10, "overflow")])
def test_places_that_64_bits_do_not_hold_are_errors(spark, position, speed, reason):
    state = "state long, position_ns long, speed double, playing boolean"
    asked = lambda *given: lookahead.pair_demand(spark.createDataFrame([given], state), 20 * MS, 0.1).collect()
    with pytest.raises(Exception, match=reason):
        asked(1, position, speed, True)
    assert asked(1, None, speed, True) == []


def test_plans_are_not_interpreted_node_by_node(spark):
    import __spark_entry__ as contract

    text = contract.queries()["frame_demand"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # what is left are the first frames of the next clip; frames that nobody asks for are not kept
    assert text.count("lambdafunction") <= 6 and "needed(" in text and "shown_now(" not in text and "Exchange" not in text


def test_plan_without_sources_or_cameras(spark):
    none = F.array().cast("array<struct<camera:int,position_ns:bigint,speed:double,playing:boolean,motion:string,factor:int,until_ns:bigint,grains:int,both:boolean>>")
    row = lookahead.decode_plan(spark.range(1), none, 20 * MS, 0.1, 2).first()
    assert (row.plan, row.keep) == ([], [])
    unknown = lookahead.source(None, F.lit(40 * MS), 1.0, True, None)
    row = lookahead.decode_plan(spark.range(1), F.array(unknown), 20 * MS, 0.1, 2).first()
    assert [tuple(f) for f in row.plan] == [(None, 60 * MS), (None, 80 * MS)] and [tuple(f) for f in row.keep] == [(None, 40 * MS)]


def test_playlists_are_read_leniently(spark):
    texts = [
        '{"id":"p1","name":"n","loop":true,"entries":[{"clip_id":"c","end":"odd","transition":"mix","transition_frames":999,"own_audio":false}],"aux":{"source":"a","duck_db":-6}}',
        '{"id":"p2","aux":{"source":"a","level_db":13}}', '{"name":"no id"}', '{"id":"p3","entries":[{}]}', "not json",
    ]
    given = spark.createDataFrame([(t,) for t in texts], "document string")
    lists = {r.id: r for r in catalogue.import_playlists(given).collect()}
    assert set(lists) == {"p1", "p2", "p3"} and lists["p1"].loop and lists["p2"].name == ""
    assert tuple(lists["p1"].aux) == ("a", 0.0, True, 50, -6.0, 200, 500)
    assert tuple(lists["p2"].aux) == tuple(lists["p3"].aux) == ("", 0.0, True, 50, -12.0, 200, 500)
    entries = {r.playlist: r for r in catalogue.import_entries(given).collect()}
    assert (entries["p1"].end_action, entries["p1"].transition, entries["p1"].transition_frames, entries["p1"].own_audio) == ("next", "cut", 0, True)
    assert (entries["p3"].clip_id, entries["p3"].speed, entries["p3"].auto_advance, entries["p3"].audio_frames) == ("", 1.0, True, -1)
    settings = spark.createDataFrame([('{"key":"k","value":"v"}',), ('{"key":"","value":"v"}',), ('{"value":"v"}',)], "document string")
    assert [tuple(r) for r in catalogue.import_settings(settings).collect()] == [("k", "v")]


def test_pictures_without_a_window(spark):
    row = spark.createDataFrame([(1, [1] * 63, [2] * 63), (2, [], [])], "id int, a array<int>, b array<int>")
    assert sorted((r.id, r.ssim) for r in signal.ssim(row, ["id"], 7, 9, 1023.0).collect()) == [(1, 0.0), (2, 0.0)]
