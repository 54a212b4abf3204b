"""Streams: results don't depend on how the input arrives, state is written when it is due, sinks can be retried."""

import itertools

import pytest
from pyspark.sql import functions as F

from reelgrid.registry import ORACLES, load, q_streams
from reelgrid.registry.q_playout import SPEED_GRAINS, shot_events, transport_commands
from reelgrid.registry.q_sources import fresh_folder
from reelgrid.registry.tables import Tables
from reelgrid.sources.frames import frame_bounds
from reelgrid.streaming import jobs, state
from reelgrid.testing import compare, open_duckdb

FOLDER = "/root/testdata/sf0.001"
load()

BUILDS = {
    "shot_stream": lambda s: jobs.shot_stream(shot_events(s), ["grain"]),
    "transport_stream": lambda s: jobs.transport_stream(transport_commands(s), ["grain"], 20_000_000, 40_000_000, 4, SPEED_GRAINS),
}


@pytest.mark.parametrize("triggers", [1, 10])
@pytest.mark.parametrize("name", list(BUILDS))
def test_any_number_of_triggers(spark, name, triggers):
    found = q_streams.run(Tables(spark, FOLDER), BUILDS[name], triggers=triggers)
    assert compare(found, open_duckdb(FOLDER), ORACLES[name]) is None


GRAINS = "camera int, house_index long, phase int, present boolean, tai_ns long, payload_id long"
SECOND = 1_000_000_000


def test_house_grains_are_written_when_due(spark):
    folder = fresh_folder(spark, "due")
    row = lambda camera, house, phase, n: (camera, house, phase, True, house * SECOND, n)
    arrivals = [
        # house 1 is complete at once, house 2 opens; camera 2 stays in house 1
        [row(1, 1, 0, 1), row(1, 1, 1, 2), row(1, 2, 0, 3), row(2, 1, 1, 4)],
        # a phase of the written house; house 3 closes house 2
        [row(1, 1, 1, 5), row(1, 3, 1, 6)],
        # a third camera moves event time on
        [row(3, 60, 0, 7)],
        # nothing new for cameras 1 and 2, but their ends have passed
        [row(3, 61, 0, 8)],
    ]
    seen = []

    def more():
        for n, rows in enumerate(arrivals):
            spark.createDataFrame(rows, GRAINS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            if n:
                yield

    arriving = more()
    first = next(arriving, None)
    assert first is None
    stream = jobs.files(spark, f"{folder}/in", spark.createDataFrame([], GRAINS).schema, 1)
    timed = stream.withColumn("ts", F.timestamp_micros(F.expr("(house_index + 1) * 1000000"))).withWatermark("ts", "10 seconds")
    houses = state.house_stream(timed, 2, SECOND, "payload_id")
    for _ in itertools.chain([None], arriving):
        rows = jobs.run_to_table(houses, folder).collect()
        seen.append(sorted((r.camera, r.house_index, r.reason, r._p0.payload_id, r._p1.payload_id) for r in rows))
    late, full, following = (1, 1, "late", None, 5), (1, 1, "full", 1, 2), (1, 2, "next", 3, None)
    assert seen[0] == sorted([full, late, following])
    assert seen[-1] == sorted([full, late, following, (1, 3, "timer", None, 6), (2, 1, "timer", None, 4), (3, 60, "next", 7, None)])


def test_snapshots_hold_all_rows_so_far(spark):
    live = q_streams.Streamed(spark, FOLDER, triggers=4)
    folder, frames, sizes = fresh_folder(spark, "snapshots"), live.frames, []
    total = Tables(spark, FOLDER).frames.count()
    for n, _ in enumerate(itertools.chain([None], live.rest())):
        jobs.snapshot_sink(frames, folder, frame_bounds, jobs.merged_bounds, every=None).awaitTermination()
        sizes.append(spark.read.parquet(f"{folder}/snapshot={n}").agg(F.sum("frames")).first()[0])
    assert sizes == sorted(sizes) and sizes[0] < total == sizes[-1]
    whole = {r.camera: tuple(r) for r in frame_bounds(Tables(spark, FOLDER).frames).collect()}
    assert {r.camera: tuple(r)[:4] for r in spark.read.parquet(f"{folder}/snapshot=3").collect()} == whole


def test_a_changed_dimension_counts_from_the_next_trigger(spark):
    live = q_streams.Streamed(spark, FOLDER, triggers=2, even=True)
    folder, names = fresh_folder(spark, "dimension"), iter("ab")
    tally = live.tally.select("event_id", "display")
    for _ in itertools.chain([None], live.rest()):
        name = next(names)
        side = lambda s: s.range(3).selectExpr("cast(id as int) display", f"'{name}' name")
        jobs.with_dimension(tally, folder, side, lambda rows, other: rows.join(other, "display")).trigger(availableNow=True).start().awaitTermination()
    rows = sorted((r.event_id, r.name) for r in spark.read.parquet(f"{folder}/rows").collect())
    found = [name for _, name in rows]
    assert found == sorted(found) and set(found) == {"a", "b"}
    assert len(rows) == Tables(spark, FOLDER).tally.count()


def test_stalls_of_many_arrivals_are_one_query(spark, monkeypatch):
    import os

    from reelgrid.registry import QUERIES, load, q_streams

    load()
    real, starts = q_streams.jobs.run_to_table, []

    def counted(stream, folder, mode="append", more=()):
        told = [0]

        def walked():
            for _ in more:
                told[0] += 1
                yield

        found = real(stream, folder, mode, walked())
        starts.append((1 + told[0], len([n for n in os.listdir(f"{folder.removeprefix('file:')}/checkpoint/commits") if n.isdigit()])))
        return found

    monkeypatch.setattr(q_streams.jobs, "run_to_table", counted)
    QUERIES["input_stall_stream"](spark, "/root/testdata/sf0.001").count()
    (queries, triggers), = starts
    assert queries == 1 and triggers >= q_streams.TRIGGERS
