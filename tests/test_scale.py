"""Chunked plans against brute force on skewed random data, and the shape of plans."""

import bisect
import json
import random

import pytest
from pyspark.sql import functions as F

from reelgrid import registry
from reelgrid.operators import joins
from reelgrid.plans import greedy
from reelgrid.plans.asof import asof
from reelgrid.plans.fold import Machine, fold_timeline
from reelgrid.plans.intervals import overlap_join, touched
from reelgrid.plans.ordered import (
    following_row,
    last_value,
    next_value,
    over_timeline,
    previous_row,
    running_count,
    running_max,
    running_sum,
)
from reelgrid.registry.tables import Tables
from reelgrid.sources import frames as stored
from reelgrid.testing import compare, open_duckdb
from pyspark.sql.types import LongType, StructField

FOLDER = "/root/testdata/sf0.001"


def skewed(seed, size=3000, keys=7):
    """Nearly all rows belong to one key, and a third of them to one instant."""
    rng = random.Random(seed)
    return [(0 if rng.random() < 0.9 else rng.randrange(keys), 500 if rng.random() < 0.33 else rng.randrange(1000), i) for i in range(size)]


def by_key(rows):
    out = {}
    for row in sorted(rows):
        out.setdefault(row[0], []).append(row)
    return out


def test_running_values(spark):
    rows = [(k, t, i, (i * 7) % 11 if i % 3 else None) for k, t, i in skewed(1)]
    df = spark.createDataFrame(rows, "k int, t long, i long, v long")
    found = {
        (r.k, r.t, r.i): (r.s, r.m, r.l, r.n, r.p and r.p.i, r.f and r.f.i, r.c)
        for r in over_timeline(
            df, ["k"], ["t", "i"], s=running_sum(F.coalesce("v", F.lit(0))), m=running_max("v", before=True), l=last_value("v"),
            n=next_value("v"), p=previous_row("i"), f=following_row("i"), c=running_count(F.col("v").isNull()),
        ).collect()
    }
    assert len(found) == len(rows)
    for group in by_key(rows).values():
        values = [r[3] for r in group]
        for j, (k, t, i, v) in enumerate(group):
            known = [x for x in values[:j] if x is not None]
            later = [x for x in values[j + 1 :] if x is not None]
            expected = (
                sum(x or 0 for x in values[: j + 1]), max(known, default=None), v if v is not None else (known or [None])[-1],
                (later or [None])[0], group[j - 1][2] if j else None, group[j + 1][2] if j + 1 < len(group) else None,
                sum(x is None for x in values[: j + 1]),
            )
            assert found[k, t, i] == expected


def test_asof_with_hot_instants(spark):
    frames = sorted({(k, t) for k, t, _ in skewed(2, 800)})
    probes = skewed(3)
    left = spark.createDataFrame(probes, "camera int, at_ns long, probe long")
    right = spark.createDataFrame(frames, "camera int, tai_ns long")
    for r in asof(left, right, ["camera"], "at_ns", "tai_ns").collect():
        times = [t for k, t in frames if k == r.camera]
        j = bisect.bisect_right(times, r.at_ns)
        assert (r.before and r.before.tai_ns) == (times[j - 1] if j else None)
        assert (r.after and r.after.tai_ns) == (times[j] if j < len(times) else None)


@pytest.mark.parametrize("backwards", [False, True])
def test_asof_takes_the_greatest_of_equal_frames(spark, backwards):
    # every instant is recorded several times; the order in which the rows are read must not matter
    frames = sorted({(k, t // 20 * 20, i) for k, t, i in skewed(9, 800)}, reverse=backwards)
    probes = skewed(10, 600)
    left = spark.createDataFrame(probes, "camera int, at_ns long, probe long")
    right = spark.createDataFrame(frames, "camera int, tai_ns long, event_id long").repartition(5, "event_id")
    greatest = {(k, t): i for k, t, i in sorted(frames)}
    before = {r.probe: r.frame and r.frame.event_id for r in joins.at_or_before(left, right, columns=["event_id"]).collect()}
    after = {r.probe: r.frame and r.frame.event_id for r in joins.after(left, right, columns=["event_id"]).collect()}
    for k, at, probe in probes:
        times = sorted({t for c, t, _ in frames if c == k})
        j = bisect.bisect_right(times, at)
        assert before[probe] == (greatest[k, times[j - 1]] if j else None)
        assert after[probe] == (greatest[k, times[j]] if j < len(times) else None)


@pytest.mark.parametrize("backwards", [False, True])
def test_asof_in_order_takes_the_first_row_after(spark, backwards):
    # every instant is recorded several times, some by more frames than one chunk has
    frames = sorted({(k, t // 20 * 20, i) for k, t, i in skewed(9, 800)}, reverse=backwards)
    probes = skewed(10, 600)
    left = spark.createDataFrame(probes, "camera int, at_ns long, probe long")
    right = spark.createDataFrame(frames, "camera int, tai_ns long, event_id long").repartition(5, "event_id")
    least, greatest = {(k, t): i for k, t, i in sorted(frames, reverse=True)}, {(k, t): i for k, t, i in sorted(frames)}
    both = {r.probe: r for r in asof(left, right, ["camera"], "at_ns", "tai_ns", ["event_id"], in_order=True).collect()}
    for k, at, probe in probes:
        times = sorted({t for c, t, _ in frames if c == k})
        j = bisect.bisect_right(times, at)
        before, after = both[probe].before, both[probe].after
        assert (before and before.event_id) == (greatest[k, times[j - 1]] if j else None)
        assert (after and after.event_id) == (least[k, times[j]] if j < len(times) else None)


@pytest.mark.parametrize("name", ["asof_before", "asof_after", "nearest_frame", "nearest_audio"])
def test_equal_instants_as_in_the_sql(spark, tmp_path, name):
    # a table short enough for DuckDB to keep equal instants in the order of the file, with one thread from run to run
    duck = open_duckdb("/root/testdata/sf0.01")
    duck.execute("set threads=1")
    duck.execute(f"copy (select * replace (date_trunc('minute', ts) as ts) from events order by event_id) to '{tmp_path}/events.parquet' (format parquet)")
    duck.execute(f"create or replace view events as select * from '{tmp_path}/events.parquet'")
    assert len(duck.execute("select user_id % 4, ts from events group by all having count(*) > 1").fetchall()) > 100
    registry.load()
    assert compare(registry.QUERIES[name](spark, str(tmp_path)), duck, registry.ORACLES[name]) is None


def test_nearest_takes_the_greatest_of_equal_frames(spark):
    frames = [(1, t, n) for t in (100, 200, 300) for n in (7, 9, 8)]
    right = spark.createDataFrame(frames, "camera int, tai_ns long, event_id long")
    left = spark.createDataFrame([(n, 1, at) for n, at in enumerate((50, 100, 149, 151, 299, 400))], "probe long, camera int, at_ns long")
    shown = joins.shown_frames(left, right, 50, 1).orderBy("probe").collect()
    assert [(r.frame_ns, r.frame_id) for r in shown] == [(100, 9), (100, 9), (100, 9), (200, 9), (300, 9), (300, 9)]


def test_touched_and_overlap(spark):
    rng = random.Random(4)
    spans = [(k, t, t + rng.randrange(20), i) for k, t, i in skewed(5, 600)]
    ranges = [(k, t, t + rng.randrange(-30, 30)) for k, t, _ in skewed(6, 60)]
    left = spark.createDataFrame(spans, "k int, a long, b long, i long")
    right = spark.createDataFrame(ranges, "k int, begin_ns long, end_ns long")
    hit = {r.i: r.touched for r in touched(left, right, ["k"], "a", "b").collect()}
    pairs = {(i, n) for k, a, b, i in spans for n, (rk, x, y) in enumerate(ranges) if rk == k and a <= max(x, y) and b >= min(x, y)}
    assert {i for i, flag in hit.items() if flag} == {i for i, _ in pairs} and len(hit) == len(spans)
    numbered = spark.createDataFrame([(k, min(x, y), max(x, y), n) for n, (k, x, y) in enumerate(ranges)], "k int, x long, y long, n long")
    joined = overlap_join(left, numbered, ["k"], ("a", "b"), ("x", "y")).select("i", "n").collect()
    assert len(joined) == len(pairs) and {tuple(r) for r in joined} == pairs


def test_overlap_lists_are_short_for_any_length(spark):
    spans = [(1, 7 * 10**17 + d, 7 * 10**17 + d + 10**n, n) for n in range(0, 18, 3) for d in (-(10**15), 0, 10**9)]
    left = spark.createDataFrame(spans, "k int, a long, b long, i long")
    right = left.selectExpr("k", "a x", "b y", "concat(i, ':', a) n")
    found = overlap_join(left, right, ["k"], ("a", "b"), ("x", "y")).selectExpr("a", "b", "n").collect()
    want = [(a, b, f"{j}:{x}") for _, a, b, _ in spans for _, x, y, j in spans if a <= y and b >= x]
    assert sorted(tuple(r) for r in found) == sorted(want)


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize(("chunks", "fan", "length"), [(8, 8, 13), (16, 2, 13), (16, 3, 400), (16, 2, 5000), (1, 8, 13)])
def test_greedy_groups(spark, monkeypatch, inclusive, chunks, fan, length):
    # lengths of 400 and 5000 are longer than a chunk
    monkeypatch.setattr(greedy, "FAN", fan)
    rows = skewed(7)
    df = spark.createDataFrame(rows, "k int, t long, i long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", chunks)
    try:
        found = {(r.k, r.t): (r.group_first, r.group_no) for r in greedy.greedy_groups(df, ["k"], "t", length, inclusive).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for k, group in by_key({(k, t) for k, t, _ in rows}).items():
        first, number = None, -1
        for _, t in group:
            if first is None or (t >= first + length if inclusive else t > first + length):
                first, number = t, number + 1
            assert found[k, t] == (first, number)


def test_fold_with_a_state_that_never_forgets(spark):
    rows = skewed(8, 2000)
    df = spark.createDataFrame(rows, "k int, t long, i long")

    def step(state, data):
        total, out = int(json.loads(state)) if state else 0, []
        for t in data["t"]:
            total = (total * 3 + t) % 1_000_003
            out.append(total)
        return {"x": out}, json.dumps(total)

    def extend(effect, data):
        factor, shift = effect or (1, 0)
        for t in data["t"]:
            factor, shift = factor * 3 % 1_000_003, (shift * 3 + t) % 1_000_003
        return factor, shift

    def enter(effect, state):
        return json.dumps((effect[0] * int(json.loads(state)) + effect[1]) % 1_000_003)

    machine = Machine(step, extend, enter)
    found = {(r.k, r.t, r.i): r.x for r in fold_timeline(df, ["k"], ["t", "i"], machine, [StructField("x", LongType())]).collect()}
    for k, group in by_key(rows).items():
        total = 0
        for _, t, i in group:
            total = (total * 3 + t) % 1_000_003
            assert found[k, t, i] == total
    assert len(found) == len(rows)


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("chunks", [4, 16, 48])
def test_a_kept_state_needs_few_jobs(spark, chunks):
    from reelgrid.operators.transport import transport_fold

    rows = [(c, g, g * 20, "mark_in" if g == 5 else "pause", 0.0, 0) for c in (1, 2) for g in range(400)]
    commands = spark.createDataFrame(rows, "channel int, grain long, tai_ns long, command string, argument double, to_ns long")
    before, group = spark.conf.get("spark.sql.shuffle.partitions"), f"kept {chunks}"
    spark.conf.set("spark.sql.shuffle.partitions", chunks)
    spark.sparkContext.setJobGroup(group, "")
    try:
        found = transport_fold(commands, ["grain"], 20, 40, 4)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        assert jobs <= 12
        assert {(r.grain >= 5, r.in_ns) for r in found.collect()} == {(False, None), (True, 0)}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_no_nested_loops_or_whole_key_windows(spark):
    import __spark_entry__ as contract

    for name in ("nearest_frame", "protect_mark", "interval_overlap", "playlist_remaining", "angle_align", "pair_demand"):
        text = plan(contract.queries()[name](spark, FOLDER))
        assert "NestedLoop" not in text and "CartesianProduct" not in text, name


def test_rate_conversion_moves_its_frames_once(spark):
    import __spark_entry__ as contract

    read = contract.queries()["rate_convert"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert read.count("Relation [") == 2 and read.count("RepartitionById") <= 1, read


def test_scan_prunes_and_pushes_down(spark, tmp_path):
    path = str(tmp_path / "frames")
    stored.write_frames(Tables(spark, FOLDER).frames, path)
    table = stored.read_frames(spark, path)
    day = 19_730 * stored.DAY_NS
    text = plan(stored.scan_frames(table, [1], day, day + stored.DAY_NS).select("tai_ns", "payload_bytes"))
    scan = next(line for line in text.splitlines() if "FileScan parquet" in line)
    assert "PushedFilters: [IsNotNull(tai_ns)" in scan and "camera" in scan.split("PartitionFilters")[1]
    assert "ReadSchema: struct<tai_ns:bigint,payload_bytes:bigint>" in scan
    bounds = plan(stored.frame_bounds(table))
    assert "ReadSchema: struct<tai_ns:bigint>" in bounds
