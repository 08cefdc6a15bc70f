"""Event logs: replay, merging of two sources, running progress and the fold of a run's events into its state.

Events are rows (run_id, seq, type, ...); seq grows by one in each run. A late or repeated event is
one whose seq was seen before. The batch forms and the streaming fold give the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# The status that an event sets, and the part of an import's progress that each stage has.
STATUS = {"run_started": "running", "error": "failed", "run_completed": "succeeded", "run_cancelled": "cancelled"}
IMPORT_BANDS = {"reading": (0, 5), "chunking": (5, 15), "tagging": (15, 70), "embedding": (70, 90), "indexing": (90, 100)}
STATE = "seq long, progress double, events long, last_type string"


def sequenced(events: DataFrame, run: str, *order: str) -> DataFrame:
    """Adds seq, from 1 in each run."""
    return events.withColumn("seq", F.row_number().over(W.partitionBy(run).orderBy(*order)).cast("long"))


def replayed(events: DataFrame, since: Column, seq: str = "seq") -> DataFrame:
    return events.filter(F.col(seq) > since)


def merged(stream: DataFrame, stored: DataFrame, run: str = "run_id", seq: str = "seq") -> DataFrame:
    """Both sources, each (run, seq) once; the stream's row is preferred."""
    both = stream.withColumn("_p", F.lit(0)).unionByName(stored.withColumn("_p", F.lit(1)))
    rest = [c for c in both.columns if c not in (run, seq, "_p")]
    return both.groupBy(run, seq).agg(F.min_by(F.struct(*rest), "_p").alias("_s")).select(run, seq, "_s.*")


def running_progress(events: DataFrame, run: str = "run_id", seq: str = "seq", progress: str = "progress") -> DataFrame:
    """Progress that never goes back, at most 100, with one decimal."""
    w = W.partitionBy(run).orderBy(seq).rowsBetween(W.unboundedPreceding, 0)
    return events.withColumn(progress, F.least(F.lit(100.0), F.bround(F.max(progress).over(w), 1)))


def in_band(start: Column, end: Column, fraction: Column) -> Column:
    """A fraction of a node's work as progress of the whole; the last point is left for the node's end."""
    return F.bround(start + (end - 1.0 - start) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), fraction)), 1)


def folded(events: DataFrame, run: str = "run_id") -> DataFrame:
    """run, seq, progress, events, last_type: the state after all of a run's events."""
    once = events.groupBy(run, "seq").agg(F.min("type").alias("type"), F.max("progress").alias("progress"))
    return once.groupBy(run).agg(F.max("seq").alias("seq"), F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.max("progress"))).alias("progress"), F.count("*").alias("events"), F.max_by("type", "seq").alias("last_type"))


def run_state(log: DataFrame, run: str = "run_id") -> DataFrame:
    """run, last_seq, status, progress, nodes, current_node, current_message, warnings, error and timeline (a length) after a run's events.

    log has (run, seq, type, node, message, progress); repeats of a seq count once. A node is current from its start to its
    first end after that, and the message goes with it; an end of a node that is not current leaves both. A start without
    a node leaves the node. A run's end sets its status, and its completion the progress to 100.
    """
    once = log.groupBy(run, "seq").agg(F.min(F.struct("type", "node", "message", "progress")).alias("e")).select(run, "seq", "e.*")
    started, completed = F.col("type") == "node_started", F.col("type") == "node_completed"
    before = W.partitionBy(run).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    opens = started & F.col("node").isNotNull()
    ends = completed & (F.col("node") == F.col("_running"))
    told = once.withColumns({"_running": F.last(F.when(opens, F.col("node")), ignorenulls=True).over(before), "_opened": F.last(F.when(opens, F.col("seq")), ignorenulls=True).over(before)})
    told = told.withColumn("_ended", F.last(F.when(ends, F.col("seq")), ignorenulls=True).over(before))
    told = told.withColumn("_current", F.when(F.col("_ended").isNull() | (F.col("_ended") < F.col("_opened")), F.col("_running")))
    leaves = completed & F.col("node").eqNullSafe(F.col("_current"))
    says = (F.col("type") == "progress") & F.col("message").isNotNull()
    last = lambda value, when: F.max_by(F.when(when, value), F.when(when, F.col("seq")))
    status = F.create_map(*(F.lit(x) for pair in STATUS.items() for x in pair))[F.col("type")]
    now = F.struct(F.when(started, F.coalesce("node", "_current")).alias("node"), F.when(started | says, F.col("message")).alias("message"))
    pushed = F.col("type").isin("run_started", "node_started", "node_completed", "warning", "error", "run_completed", "run_cancelled") | says
    whole = told.groupBy(run).agg(
        F.max("seq").alias("last_seq"),
        last(status, status.isNotNull()).alias("status"),
        F.when(F.max(F.col("type") == "run_completed"), 100.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(F.max("progress"), F.lit(0.0))))).alias("progress"),
        last(now["node"], started | leaves).alias("current_node"),
        last(now["message"], started | says | leaves).alias("current_message"),
        F.sum((F.col("type") == "warning").cast("int")).cast("long").alias("warnings"),
        last(F.coalesce("message", F.lit("")), F.col("type") == "error").alias("error"),
        F.sum(pushed.cast("int")).cast("long").alias("timeline"),
    )
    states = told.filter((started | completed) & F.col("node").isNotNull()).groupBy(run, "node").agg(F.max_by(F.when(started, "running").otherwise("done"), "seq").alias("state"))
    return whole.join(states.groupBy(run).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("node", "state")))).alias("nodes")), run, "left")


def stage_progress(stage: Column, fraction: Column) -> Column:
    """The whole progress of an import whose stage is done to this fraction, rounded down; null for an unknown stage."""
    bands = F.create_map(*(x for name, (low, high) in IMPORT_BANDS.items() for x in (F.lit(name), F.struct(F.lit(low).alias("low"), F.lit(high).alias("high")))))
    band = F.element_at(bands, stage)
    return F.floor(band["low"] + (band["high"] - band["low"]) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), fraction)))


def text_of(deltas: DataFrame, by: tuple[str, ...], seq: str = "seq", text: str = "text") -> DataFrame:
    """The pieces of each section, joined in the order of seq."""
    return deltas.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, text))), lambda x: x[text]), "").alias("text"))


def fold_stream(events: DataFrame, run: str = "run_id") -> DataFrame:
    """The streaming fold: state by run, events with a seq not above the last one seen are dropped."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, progress, n, last = state.get if state.exists else (0, 0.0, 0, None)
        seen, top, highest = set(), seq, progress
        for rows in batches:
            new = rows[rows["seq"] > seq]
            if len(new):
                highest = max(highest, float(new["progress"].max()))
                seen.update(new["seq"].tolist())
                if int(new["seq"].max()) >= top:
                    top = int(new["seq"].max())
                    last = new.loc[new["seq"] == top, "type"].min()
        seq, progress, n = top, min(100.0, highest), n + len(seen)
        state.update((seq, progress, n, last))
        yield pd.DataFrame({run: [key[0]], "seq": [seq], "progress": [progress], "events": [n], "last_type": [last]})

    kind = events.schema[run].dataType.simpleString()
    return events.select(run, "seq", "type", "progress").groupBy(run).applyInPandasWithState(step, f"{run} {kind}, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)
