"""Keyed state on streams: the folds of the batch operators, and timers for inputs that fall silent."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from reelgrid.plans.fold import Step


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(rows: DataFrame) -> DataFrame:
    """Keyed state of this kind needs the RocksDB store; it also keeps large states out of the heap."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return rows


class FoldProcessor(StatefulProcessor):
    """Runs a batch step over the rows of a key in each micro-batch, in their own order."""

    def __init__(self, keys: list[str], order: list[str], step: Step, output: list[StructField]):
        self.keys, self.order, self.step, self.output = keys, order, step, output

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # One trigger's rows of one key; the source's per-trigger limit bounds them.
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order).reset_index(drop=True)
        before = self.state.get()[0] if self.state.exists() else None
        plain = {c: [None if v is None or v != v else v for v in batch[c].tolist()] for c in batch.columns}
        found, after = self.step(before, plain)
        self.state.update((after,))
        # Nullable integers: a float column would round today's instants.
        kinds = {LongType: "Int64", IntegerType: "Int32"}
        out = {f.name: pd.array(found[f.name], dtype=kinds.get(type(f.dataType), "object")) for f in self.output}
        yield pd.concat([batch[[*self.keys, *self.order]], pd.DataFrame(out)], axis=1)

    def close(self) -> None:
        pass


def fold_stream(rows: DataFrame, keys: list[str], order: list[str], step: Step, output: list[StructField]) -> DataFrame:
    """The streaming twin of the batch fold: same step, state kept per key between triggers."""
    fields = [*[rows.schema[c] for c in [*keys, *order]], *output]
    return use_rocksdb(rows).groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=FoldProcessor(keys, order, step, output),
        outputStructType=StructType(fields),
        outputMode="append",
        timeMode="none",
    )


class StallProcessor(StatefulProcessor):
    """Reports an input that recorded nothing for ``timeout_ns`` of event time, and its return."""

    def __init__(self, timeout_ns: int):
        self.timeout_ns = timeout_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "value string")

    def _event(self, key, tai_ns: int, change: str, reason: str | None, gap: int | None) -> pd.DataFrame:
        row = {"camera": [key[0]], "tai_ns": [tai_ns], "change": [change], "reason": [reason]}
        return pd.DataFrame(row).assign(gap_ns=pd.array([gap], dtype="Int64"))

    def _watch(self, last: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((last + self.timeout_ns) // 1_000_000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # One trigger's rows of one key; the source's per-trigger limit bounds them.
        batch = pd.concat(list(rows), ignore_index=True).sort_values("tai_ns", kind="stable")
        now = self._now()
        for tai, event in zip(batch["tai_ns"].tolist(), batch["event"].tolist(), strict=True):
            due = None if now["last"] is None or now["stopped"] else now["last"] + self.timeout_ns
            if due is not None and (tai > due or (tai == due and event == "recorded")):
                yield self._event(key, due, "stopped", self._reason(now), None)
                now["stopped"] = True
            if event == "recorded":
                if now["stopped"]:
                    yield self._event(key, tai, "resumed", None, tai - now["last"])
                now |= {"last": tai, "stopped": False, "skipped": False}
            elif event == "connect" and now["last"] is None:
                now |= {"last": tai, "skipped": False}
            elif event == "skipped":
                now["skipped"] = True
            if event != "connect":
                now["open"] = event != "closed"
        self.state.update((json.dumps(now),))
        if now["last"] is not None and not now["stopped"]:
            self._watch(now["last"])

    def _now(self) -> dict:
        """The last recorded instant or the connection, whether it is stopped, the flow open, a grain unusable since."""
        fresh = {"last": None, "stopped": False, "open": False, "skipped": False}
        return json.loads(self.state.get()[0]) if self.state.exists() else fresh

    def _reason(self, now: dict) -> str:
        return "flow_missing" if not now["open"] else "invalid_grains" if now["skipped"] else "no_grains"

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = self._now()
        if now["last"] is not None and not now["stopped"]:
            yield self._event(key, now["last"] + self.timeout_ns, "stopped", self._reason(now), None)
            self.state.update((json.dumps(now | {"stopped": True}),))

    def close(self) -> None:
        pass


STALL_SCHEMA = StructType(
    [
        StructField("camera", LongType()),
        StructField("tai_ns", LongType()),
        StructField("change", StringType()),
        StructField("reason", StringType()),
        StructField("gap_ns", LongType()),
    ]
)


def stall_stream(events: DataFrame, timeout_ns: int) -> DataFrame:
    """Stops and returns of each camera; ``events`` has camera, tai_ns, event and a watermarked ``ts``."""
    schema = StructType([events.schema["camera"], *STALL_SCHEMA.fields[1:]])
    return use_rocksdb(events).groupBy("camera").transformWithStateInPandas(
        statefulProcessor=StallProcessor(timeout_ns), outputStructType=schema, outputMode="append", timeMode="eventTime"
    )


class HouseProcessor(StatefulProcessor):
    """Collects the phases of a camera's house grain and writes it as soon as it is complete.

    A grain is complete when all its phases are there, when a later one opens, or when event time has passed its end.
    A phase that comes after its grain was written is told as late.
    """

    def __init__(self, phases: int, house_ns: int, order: str):
        self.phases, self.house_ns, self.order = phases, house_ns, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("house", "value string")

    def _row(self, camera: int, house: int, reason: str, found: dict) -> dict:
        row = {"camera": camera, "house_index": house, "reason": reason}
        for k in range(self.phases):
            row[f"t{k}"], row[f"payload{k}"] = found.get(str(k), (None, None))
        return row

    def _out(self, rows: list[dict]) -> pd.DataFrame:
        whole = [c for k in range(self.phases) for c in (f"t{k}", f"payload{k}")]
        out = pd.DataFrame(rows, columns=["camera", "house_index", "reason", *whole])
        return out.astype(dict.fromkeys(whole, "Int64"))

    def _watch(self, house: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if house is not None:
            self.handle.registerTimer((house + 1) * self.house_ns // 1_000_000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # One trigger's rows of one camera; the source's per-trigger limit bounds them.
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        now = json.loads(self.state.get()[0]) if self.state.exists() else {"open": None, "done": -1, "found": {}}
        out = []
        columns = (batch[c].tolist() for c in ("house_index", "phase", "present", "tai_ns", "payload_id"))
        for house, phase, present, tai, payload in zip(*columns, strict=True):
            if house <= now["done"]:
                out.append(self._row(key[0], house, "late", {str(phase): (tai, payload)}))
                continue
            if now["open"] is not None and house > now["open"]:
                out.append(self._row(key[0], now["open"], "next", now["found"]))
                now = {"open": None, "done": now["open"], "found": {}}
            now["open"] = house
            if present:
                now["found"][str(phase)] = (tai, payload)
            else:
                now["found"].pop(str(phase), None)
            if len(now["found"]) == self.phases:
                out.append(self._row(key[0], house, "full", now["found"]))
                now = {"open": None, "done": house, "found": {}}
        self.state.update((json.dumps(now),))
        self._watch(now["open"])
        yield self._out(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = json.loads(self.state.get()[0])
        if now["open"] is not None:
            self.state.update((json.dumps({"open": None, "done": now["open"], "found": {}}),))
            yield self._out([self._row(key[0], now["open"], "timer", now["found"])])

    def close(self) -> None:
        pass


def house_stream(grains: DataFrame, phases: int, house_ns: int, order: str) -> DataFrame:
    """House grains of each camera with the ``reason`` they were written, and late phases.

    ``grains``: camera, house_index (not older than the one before but for late phases), phase, present, tai_ns,
    payload_id, the order and a watermarked ``ts``. ``_p0`` on are the phases as structs, null where one is missing.
    """
    names = [c for k in range(phases) for c in (f"t{k}", f"payload{k}")]
    fields = [grains.schema["camera"], StructField("house_index", LongType()), StructField("reason", StringType())]
    written = use_rocksdb(grains).groupBy("camera").transformWithStateInPandas(
        statefulProcessor=HouseProcessor(phases, house_ns, order),
        outputStructType=StructType([*fields, *[StructField(n, LongType()) for n in names]]),
        outputMode="append",
        timeMode="eventTime",
    )
    phase = lambda k: F.struct(F.col(f"t{k}").isNotNull().alias("present"), F.col(f"t{k}").alias("t"), F.col(f"payload{k}").alias("payload_id"))
    return written.select("camera", "house_index", "reason", *[phase(k).alias(f"_p{k}") for k in range(phases)])
