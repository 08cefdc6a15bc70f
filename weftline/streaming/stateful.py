"""Event logs as streams with state: numbering, the fold of a run's state, and sinks that may write a batch again.

State is kept by run in the state store, which is checkpointed with the stream: after a restart a stream goes on
where it was. State of runs that have ended goes by the watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from weftline.operators.keyed import KeyedTable
from weftline.shipping import ship
from weftline.streaming.events import STATUS

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RUN_STATE = "last_seq long, status string, progress double, current_node string, current_message string, warnings long, error string, timeline long, nodes map<string, string>"


def schema_of(events: DataFrame, columns: list[str], more: str) -> StructType:
    """These columns of events and further ones."""
    out = StructType([events.schema[c] for c in columns])
    for f in StructType.fromDDL(more):
        out = out.add(f)
    return out


def with_state(events: DataFrame, key: list[str], processor: StatefulProcessor, out: StructType, mode: str = "update", timed: bool = False) -> DataFrame:
    """The stream that the processor makes of each key's events."""
    spark = events.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)  # the only store with several kinds of state
    return events.groupBy(*key).transformWithState(processor, out, mode, "EventTime" if timed else "None")


class Numbering(StatefulProcessor):
    """Gives a run's events the next numbers in the order of (ts, event), and progress that never goes back.

    Rows are (run, event, ts, progress, ...); what else they have goes with them. The counter of a run goes `keep` milliseconds
    after its latest event.
    """

    def __init__(self, columns: list[str], event: str, keep: int):
        self.columns, self.event, self.keep = columns, event, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "seq long, progress double, timer long")

    def handleInputRows(self, key, rows, timerValues):
        seq, progress, timer = self.count.get() or (0, 0.0, None)
        due = timer or 0
        for r in sorted(rows, key=lambda r: (r["ts"], r[self.event])):
            seq, progress = seq + 1, min(100.0, max(progress, 0.0 if r["progress"] is None else r["progress"]))
            due = max(due, int(r["ts"].timestamp() * 1000) + self.keep)
            yield Row(**{c: progress if c == "progress" else r[c] for c in self.columns}, seq=seq)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.count.update((seq, progress, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.count.clear()
        yield from ()


def numbered(events: DataFrame, late: str, keep: int, run: str = "run_id", event: str = "event_id") -> DataFrame:
    """A stream of (run, event, ts, progress, ...) with seq, from 1 in each run, and progress clamped.

    Events that come again within the delay `late` of the watermark, or later than that, are dropped; a late event within the
    delay gets the next number.
    """
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark([run, event])
    return with_state(once, [run], Numbering(events.columns, event, keep), schema_of(events, events.columns, "seq long"), "append", timed=True)


class RunFold(StatefulProcessor):
    """`events.run_state` as a stream: a run's scalars in one value, its nodes in a map. Events are (run, seq, type, node, message, progress)."""

    def __init__(self, run: str = "run_id"):
        self.run = run

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "last_seq long, status string, progress double, current_node string, current_message string, warnings long, error string, timeline long")
        self.nodes = handle.getMapState("nodes", "node string", "state string")

    def handleInputRows(self, key, rows, timerValues):
        seq, status, progress, node, message, warnings, error, timeline = self.head.get() or (0, None, 0.0, None, None, 0, None, 0)
        known = seq
        for r in sorted(rows, key=lambda r: (r["seq"], *((r[c] is not None, r[c]) for c in ("type", "node", "message", "progress")))):
            if r["seq"] <= seq:
                continue  # seen before, or late
            seq, kind, says = r["seq"], r["type"], r["message"] is not None
            progress = min(100.0, max(progress, 0.0 if r["progress"] is None else r["progress"]))
            status = STATUS.get(kind, status)
            if kind == "node_started":
                if r["node"] is not None:
                    self.nodes.updateValue((r["node"],), ("running",))
                node, message = r["node"] if r["node"] is not None else node, r["message"]
            elif kind == "node_completed":
                if r["node"] is not None:
                    self.nodes.updateValue((r["node"],), ("done",))
                if r["node"] == node:
                    node = message = None
            elif kind == "progress" and says:
                message = r["message"]
            elif kind == "warning":
                warnings += 1
            elif kind == "error":
                error = r["message"] or ""
            elif kind == "run_completed":
                progress = 100.0
            timeline += kind in ("run_started", "node_started", "node_completed", "warning", "error", "run_completed", "run_cancelled") or (kind == "progress" and says)
        self.head.update((seq, status, progress, node, message, warnings, error, timeline))
        if seq > known:
            nodes = {k[0]: v[0] for k, v in self.nodes.iterator()}
            yield Row(**{self.run: key[0]}, last_seq=seq, status=status, progress=progress, current_node=node, current_message=message, warnings=warnings, error=error, timeline=timeline, nodes=nodes or None)


def run_states(events: DataFrame, run: str = "run_id") -> DataFrame:
    """A stream of the states of runs, a row whenever a batch has news of a run."""
    return with_state(events, [run], RunFold(run), schema_of(events, [run], RUN_STATE))


def into_folders(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: each batch is a partition `batch=n`, written anew if the batch comes again."""

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return write


def into_table(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: rows of the keyed table at path are replaced, so a batch that comes again changes nothing."""

    def write(batch: DataFrame, n: int) -> None:
        KeyedTable(batch.sparkSession, path).upsert(batch)

    return write


def drained(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> int:
    """Runs the stream from its checkpoint until it has no more input; the number of batches that it has run so far.

    A new stream's state has a partition for each core at most: each is a store of its own and a task in every batch.
    """
    spark, setting = stream.sparkSession, "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(min(int(before), spark.sparkContext.defaultParallelism)))
    try:
        query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return 0 if query.lastProgress is None else query.lastProgress["batchId"] + 1


def files_of(spark: SparkSession, schema: StructType, path: str, most: int | None = 1) -> DataFrame:
    """The files under path as a stream, `most` files a batch, the oldest first; without it a batch is whatever is there."""
    reader = spark.readStream.schema(schema).option("latestFirst", "false")
    return (reader if most is None else reader.option("maxFilesPerTrigger", most)).parquet(path)
