"""Streaming forms of the operators: late frames, phases, rates, sessions, repeats and a status snapshot."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from itertools import accumulate, chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from reelgrid.operators.ingest import interleaved, last_writes
from reelgrid.operators.shots import SHOT_FIELDS, machine_events, shot_machine, tally_events
from reelgrid.operators.transport import TRANSPORT_FIELDS, transport_step
from reelgrid.plans.fold import Rows
from reelgrid.streaming.state import fold_stream


#: Rows of a dimension up to which it is broadcast to a micro-batch.
DIMENSION_ROWS = 50_000


def files(spark: SparkSession, path: str, schema: StructType, per_trigger: int) -> DataFrame:
    """A stream over Parquet files, oldest first; a trigger, and so a key's rows in it, is ``per_trigger`` files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def event_time(rows: DataFrame, delay: str, column: str = "tai_ns") -> DataFrame:
    """Add the watermarked microsecond ``ts`` of a nanosecond instant; the instant itself stays exact."""
    return rows.withColumn("ts", F.timestamp_micros(F.expr(f"{column} div 1000"))).withWatermark("ts", delay)


def run_to_table(stream: DataFrame, folder: str, mode: str = "append", more: Iterable[None] = ()) -> DataFrame:
    """Process what is there and return the rows written; ``folder`` must be reachable by every executor.

    ``more`` adds files as it is walked; after each step the stream goes on from where it stopped.
    """
    for _ in chain([None], more):
        sink = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
        query = sink.trigger(availableNow=True).start(f"{folder}/rows")
        query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def append_step(state: str | None, rows: Rows) -> tuple[Rows, str]:
    """Frames newer than all before them are accepted; the newest instant is the state."""
    newest = list(accumulate(rows["tai_ns"], max, initial=int(state) if state else -1))
    return {"accepted": [at > before for at, before in zip(rows["tai_ns"], newest, strict=False)]}, str(newest[-1])


def ordered_append_stream(frames: DataFrame, order: list[str]) -> DataFrame:
    """Late-frame rejection relative to each camera, which no global watermark can express."""
    return fold_stream(frames, ["camera"], order, append_step, [StructField("accepted", BooleanType())])


def log_limit_step(interval_ns: int):
    """First event at once, then one line per interval with the count since; rows without a line give 0."""

    def step(state: str | None, rows: Rows) -> tuple[Rows, str]:
        logged, waiting = (int(v) for v in state.split(",")) if state else (-1, 0)
        lines = []
        for at in rows["tai_ns"]:
            waiting += 1
            due = logged < 0 or at >= logged + interval_ns
            lines.append(waiting if due else 0)
            logged, waiting = (at, 0) if due else (logged, waiting)
        return {"events": lines}, f"{logged},{waiting}"

    return step


def log_limit_stream(events: DataFrame, key: str, interval_ns: int) -> DataFrame:
    lines = fold_stream(events, [key], ["tai_ns"], log_limit_step(interval_ns), [StructField("events", LongType())])
    return lines.filter("events > 0")


def shot_stream(events: DataFrame, order: list[str], armed: bool = True, play_first: bool = False) -> DataFrame:
    """The life of shots on a stream."""
    return fold_stream(machine_events(events, order), ["channel"], order, shot_machine(armed, play_first).step, SHOT_FIELDS)


def tally_play_stream(rows: DataFrame, order: list[str]) -> DataFrame:
    return shot_stream(tally_events(rows, *order), order).select("channel", *order, "state", "played")


def transport_stream(commands: DataFrame, order: list[str], period_ns: int, delay_ns: int, cameras: int, ramp: int = 0) -> DataFrame:
    return fold_stream(commands, ["channel"], order, transport_step(period_ns, delay_ns, cameras, ramp), TRANSPORT_FIELDS)


def phase_stream(grains: DataFrame, phases: int, house_ns: int, order: str, window: str, delay: str) -> DataFrame:
    """Interleaved phases of a stream: a house grain is written when the watermark has passed its window.

    The window is that of the house grain's start, so phases that arrive on both sides of an edge stay together.
    """
    start = F.timestamp_micros(F.expr(f"house_index * {house_ns} div 1000"))
    spans = grains.withColumn("_start", start).withWatermark("_start", delay).withColumn("_w", F.window("_start", window))
    return interleaved(spans.groupBy("camera", "house_index", "_w").agg(*last_writes(phases, order)), phases, house_ns)


def rate_stream(frames: DataFrame, window: str, slide: str, value: Column) -> DataFrame:
    """Frames and bytes per camera over a sliding window."""
    return frames.groupBy("camera", F.window("ts", window, slide).alias("_w")).agg(
        F.count("*").alias("frames"), F.sum(value).alias("bytes")
    ).select("camera", F.unix_micros("_w.start").alias("start_us"), "frames", "bytes")


def connected_stream(frames: DataFrame, stall: str) -> DataFrame:
    """Runs of frames between stalls."""
    return frames.groupBy("camera", F.session_window("ts", stall).alias("_s")).agg(F.count("*").alias("frames")).select(
        "camera", F.unix_micros("_s.start").alias("start_us"), "frames"
    )


def unsupported_step(state: str | None, rows: Rows) -> tuple[Rows, str]:
    """A reason is news unless the check before it had one for the same flow; that check is the state."""
    before = json.loads(state) if state else [None, None]
    news = []
    for flow, reason in zip(rows["flow"], rows["reason"], strict=True):
        news.append(reason is not None and (before[1] is None or before[0] != flow))
        before = [flow, reason]
    return {"news": news}, json.dumps(before)


def unsupported_stream(checks: DataFrame, order: list[str]) -> DataFrame:
    """The reports of :func:`~reelgrid.operators.ingest.unsupported_once` on a stream."""
    names = {"_flow": StringType(), "_reason": StringType(), "news": BooleanType()}

    def step(state: str | None, rows: Rows) -> tuple[Rows, str]:
        found, after = unsupported_step(state, rows)
        return {"_flow": rows["flow"], "_reason": rows["reason"], **found}, after

    told = fold_stream(checks, ["camera"], order, step, [StructField(n, t) for n, t in names.items()])
    return told.filter("news").select("camera", *order, F.col("_flow").alias("flow"), F.col("_reason").alias("reason"))


def snapshot_sink(
    stream: DataFrame, folder: str, summarise: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame], every: str | None = "1 second"
):
    """Keep a snapshot of all rows so far: ``folder/snapshot=n`` after micro-batch ``n``.

    ``summarise`` gives one row per key of a micro-batch; ``merge`` makes one of the rows of two summaries by key. Each
    snapshot is the one before and the micro-batch's summary, so a batch that is tried again makes the same snapshot
    again. The one before stays for that; older ones go.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, path = batch.sparkSession, lambda n: f"{folder}/snapshot={n}"
        now = summarise(batch)
        if number > 0:
            before = spark.read.schema(now.schema).parquet(path(number - 1))
            now = merge(before.unionByName(now))
        now.write.mode("overwrite").parquet(path(number))
        old = spark._jvm.org.apache.hadoop.fs.Path(path(number - 2))
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    sink = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/_checkpoint")
    return (sink.trigger(processingTime=every) if every else sink.trigger(availableNow=True)).start()


def merged_bounds(rows: DataFrame) -> DataFrame:
    """Bounds of cameras from several summaries of them."""
    return rows.groupBy("camera").agg(
        F.min("oldest_ns").alias("oldest_ns"), F.max("newest_ns").alias("newest_ns"), F.sum("frames").alias("frames")
    )


def with_dimension(stream: DataFrame, folder: str, read: Callable[[SparkSession], DataFrame], join: Callable[[DataFrame, DataFrame], DataFrame]):
    """Join each micro-batch with a dimension as it is then, and append the rows to ``folder/rows``.

    The dimension is read anew for each batch, so its changes count from the next trigger on. It is broadcast only if
    its size allows; a batch that is tried again replaces its own rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        side = read(batch.sparkSession)
        if side.limit(DIMENSION_ROWS + 1).count() <= DIMENSION_ROWS:
            side = F.broadcast(side)
        join(batch, side).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/_checkpoint")
