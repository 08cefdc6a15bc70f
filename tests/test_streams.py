"""Streams with state: restarts, batches that come again, and state that goes."""

import pytest
from pyspark.sql import functions as F

from weftline.operators.keyed import KeyedTable
from weftline.plans import streams
from weftline.streaming import sessions as A
from weftline.streaming import stateful as S
from weftline.streaming.events import run_state, sequenced

AGENT = "session string, seq long, type string, call_id string, name string, args string, round long, tools long, ok boolean, summary string, reason string, text string, message string, data_message string, turn long, rounds long, tool_calls long"


def event(seq, kind, session="s", **more):
    names = [x.split()[0] for x in AGENT.split(", ")]
    return tuple({"session": session, "seq": seq, "type": kind, **more}.get(n) for n in names)


TURN = [
    event(1, "delta", text="before any turn"),
    event(2, "agent_started", turn=1),
    event(3, "agent_thinking", round=1, tools=2),
    event(4, "agent_tool_call", call_id="a", name="search", args="{1}", round=1),
    event(5, "agent_tool_call", call_id="a", name="other", args="{2}", round=9),
    event(6, "agent_tool_result", call_id="b", name="late", ok=False, summary="no", reason="refused"),
    event(7, "agent_tool_result", call_id="a", name="search", ok=True, summary="found"),
    event(8, "delta", text="It was "),
    event(9, "error", message="pipe"),
    event(10, "delta", text="night."),
    event(11, "agent_tool_call", call_id="", name="nobody"),
]


def folded(spark, events):
    r = A.agent_state(spark.createDataFrame(events, AGENT)).first().asDict(recursive=True)
    r["cards"] = [tuple(c.values()) for c in r["cards"]]
    return r


def test_agent_fold(spark):
    r = folded(spark, TURN)
    assert (r["status"], r["story"], r["streaming"], r["rounds"], r["tool_calls"], r["warnings"], r["last_seq"]) == ("running", "It was night.", True, 1, 1, ["pipe"], 11)
    assert r["cards"] == [("a", "search", "{1}", 1, True, "found", None), ("b", "late", "", 1, False, "no", "refused")]
    r = folded(spark, [*TURN, event(12, "agent_completed", rounds=4, tool_calls=7), event(13, "delta", text="too late"), event(14, "agent_tool_result", call_id="c", ok=True)])
    assert (r["status"], r["story"], r["streaming"], r["live_stage"], r["rounds"], r["tool_calls"]) == ("idle", "It was night.", False, A.READING, 4, 8) and len(r["cards"]) == 3
    r = folded(spark, [*TURN, event(12, "error", data_message="broken"), event(13, "delta", text="x")])
    assert (r["status"], r["error"], r["story"]) == ("failed", "broken", "It was night.")
    r = folded(spark, [*TURN, event(12, "agent_started", turn=2)])
    assert (r["story"], r["cards"], r["warnings"], r["turn"], r["rounds"], r["live_stage"]) == ("", [], [], 2, 1, A.PREPARING)


def drain(spark, events, at, make, sink, n):
    """The stream after each of n parts, started anew for each."""
    for k in range(n):
        events(k).coalesce(1).write.mode("append").parquet(f"file://{at}/in")
        S.drained(make(S.files_of(spark, events(k).schema, f"file://{at}/in")), sink, f"file://{at}/progress", "update")


@pytest.mark.parametrize("cut", [4, 9])
def test_agent_stream_is_the_batch(spark, tmp_path, cut):
    more = [event(12, "agent_completed", rounds=2), event(13, "agent_started", turn=2), event(14, "delta", text="new")]
    every = [*TURN, *more, *(event(k, "delta", "other", text="x") for k in range(1, 5)), event(5, "agent_cancelled", "other")]
    log = spark.createDataFrame(every, AGENT)
    schema = S.schema_of(log, ["session"], A.STATE)
    t = KeyedTable.create(spark, f"file://{tmp_path}/t", schema, ("session",), buckets=2)
    parts = [log.filter(F.col("seq") <= cut), log.filter(F.col("seq") > cut - 3)]  # the last rows of the first part come again
    drain(spark, lambda k: parts[k], tmp_path, lambda s: S.with_state(s, ["session"], A.AgentFold(), schema), S.into_table(t.path), 2)
    wanted = A.agent_state(log).select(*schema.names)
    assert sorted(map(str, t.read().collect())) == sorted(map(str, wanted.collect()))
    assert t.read().filter("session = 's'").first()["story"] == "new"


def test_a_batch_written_again_changes_nothing(spark, tmp_path):
    write = S.into_folders(f"file://{tmp_path}/out")
    a, b = (spark.createDataFrame([(k, "x")], "seq long, v string") for k in (1, 2))
    for batch, n in ((a, 0), (b, 1), (b, 1), (a, 0)):
        write(batch, n)
    assert sorted(r["seq"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [1, 2]


def test_numbers_are_kept_and_go_with_the_watermark(spark, tmp_path):
    hour = 3600
    ddl = "run_id string, event_id long, ts timestamp, progress double"
    row = lambda run, i, at, p=None: (run, i, at, p)
    parts = [
        [row("a", 1, 0, 10.0), row("a", 2, 60, 5.0), row("b", 1, 0, 400.0)],
        [row("a", 2, 60, 5.0), row("a", 3, 120, 50.0), row("a", 4, 30)],  # one again, one late within the delay
        [row("c", 1, 100 * hour)],  # the watermark goes far on
        [row("c", 2, 101 * hour), row("b", 1, 0, 400.0)],  # too late: dropped
        [row("b", 2, 102 * hour, 1.0)],  # the run's counter is gone
    ]
    frames = [spark.createDataFrame(p, "run_id string, event_id long, t long, progress double").selectExpr("run_id", "event_id", "timestamp_seconds(t + 1000000) as ts", "progress") for p in parts]
    assert frames[0].schema.simpleString() == spark.createDataFrame([], ddl).schema.simpleString()
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        S.drained(S.numbered(S.files_of(spark, f.schema, f"file://{tmp_path}/in"), "10 minutes", 5 * hour * 1000), S.into_folders(f"file://{tmp_path}/out"), f"file://{tmp_path}/progress")
    got = sorted((r["run_id"], r["event_id"], r["seq"], r["progress"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    assert got == [("a", 1, 1, 10.0), ("a", 2, 2, 10.0), ("a", 3, 4, 50.0), ("a", 4, 3, 10.0), ("b", 1, 1, 100.0), ("b", 2, 1, 1.0), ("c", 1, 1, 0.0), ("c", 2, 2, 0.0)]


def test_run_stream_is_the_batch(spark, folder, tmp_path):
    log = streams._run_log(spark, folder)
    t = KeyedTable.create(spark, f"file://{tmp_path}/t", S.schema_of(log, ["run_id"], S.RUN_STATE), ("run_id",), buckets=2)
    parts = [log.filter("seq <= 7"), log.filter("seq > 4")]
    drain(spark, lambda k: parts[k], tmp_path, S.run_states, S.into_table(t.path), 2)
    assert sorted(map(str, t.read().collect())) == sorted(map(str, run_state(log).select(*t.schema.names).collect()))


def test_card_prefers_the_live_event(spark):
    calls = spark.createDataFrame([("s", "a", "n", "{}"), ("s", "b", "n", "{}"), ("s", "c", "n", "{}"), ("s", "d", "n", "{}")], "session string, call_id string, name string, args string")
    replies = spark.createDataFrame([("s", "a", 1, "reply"), ("s", "b", 1, "old"), ("s", "b", 2, "new"), ("s", "d", 1, "")], "session string, call_id string, seq long, text string")
    live = spark.createDataFrame([("s", "a", "live", "{1}", 3, None, None)], "session string, call_id string, name string, args string, round long, ok boolean, summary string")
    got = {r["call_id"]: (r["origin"], r["name"], r["ok"], r["preview"]) for r in A.tool_cards(calls, replies, live).collect()}
    assert got == {"a": ("live", "live", None, None), "b": ("reply", "n", True, "new"), "c": ("open", "n", None, None), "d": ("open", "n", None, None)}


def test_a_node_ends_once(spark, tmp_path):
    """A second end of a node leaves the message told since, an end without a node where none is current does not."""
    rows = [
        ("a", 1, "node_started", "x", "m1", None), ("a", 2, "node_completed", "x", None, None), ("a", 3, "progress", "x", "m3", None), ("a", 4, "node_completed", "x", None, None),
        ("b", 1, "node_started", "x", "m1", None), ("b", 2, "node_started", None, "m2", None), ("b", 3, "node_completed", "y", None, None),
        ("c", 1, "progress", None, "m1", None), ("c", 2, "node_completed", None, None, None),
        ("d", 1, "node_started", "x", "m1", None), ("d", 2, "node_completed", "x", None, None), ("d", 3, "node_started", "x", "m3", None),
    ]
    log = spark.createDataFrame(rows, "run_id string, seq long, type string, node string, message string, progress double")
    got = {r["run_id"]: (r["current_node"], r["current_message"]) for r in run_state(log).collect()}
    assert got == {"a": (None, "m3"), "b": ("x", "m2"), "c": (None, None), "d": ("x", "m3")}
    t = KeyedTable.create(spark, f"file://{tmp_path}/t", S.schema_of(log, ["run_id"], S.RUN_STATE), ("run_id",), buckets=2)
    drain(spark, lambda k: log, tmp_path, S.run_states, S.into_table(t.path), 1)
    assert sorted(map(str, t.read().collect())) == sorted(map(str, run_state(log).select(*t.schema.names).collect()))


def test_a_part_is_written_by_all_tasks(spark, monkeypatch):
    """The log of a part is no single task's work; a part is read whole before the next is there."""
    seen = []
    monkeypatch.setattr(S, "drained", lambda stream, *_: seen.append(stream))
    log = spark.range(0, 1000, 1, 4)
    path = streams.in_parts(log, [F.col("id") % 2 == 1], F.lit(False), lambda s: s, None, "update")
    assert len(seen) == 2 and len(spark.read.parquet(path).inputFiles()) == 8
    assert spark.read.parquet(path).count() == 1000
