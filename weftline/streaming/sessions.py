"""The fold of an agent's session: its draft, its tool cards and its counters after a log of events.

A log has (session, seq, type, call_id, name, args, round, tools, ok, summary, reason, text, message, data_message, turn,
rounds, tool_calls); of a seq that is there twice one row counts, and rows with a seq not above one that was folded are late
and dropped. A turn begins with agent_started: it empties the draft and the cards. Of a call the first event makes the card,
whether it is the call or its result; results attach to it, the last one stays. Text is taken while the turn runs only.

`agent_state` is the batch form, aggregates and windows over one shuffle by session; `AgentFold` is the same as state of a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The status that an event sets, reasons of calls that were not made, how many warnings are kept, and what a session shows as its stage.
STATUS = {"agent_started": "running", "agent_completed": "idle", "agent_cancelled": "cancelled"}
NOT_MADE = ("refused", "bad_arguments")
WARNINGS_KEPT = 50
PREPARING, DECIDING, WRITING = "正在准备材料…", "第 {} 轮：模型正在决定下一步…", "第 {} 轮：正在写正文…"
CALLING, READING, FAILED = "正在调用 {}…", "正在读查到的材料…", "工具 {} 没有成功…"
LOST = "事件流中断"

_CARD = ("call_id", "name", "args", "round", "ok", "summary", "reason")
CARD = "struct<call_id string, name string, args string, round long, ok boolean, summary string, reason string>"
STATE = f"last_seq long, status string, live_stage string, story string, streaming boolean, turn long, rounds long, tool_calls long, error string, warnings array<string>, cards array<{CARD}>"
_FIELDS = ("type", "call_id", "name", "args", "round", "tools", "ok", "summary", "reason", "text", "message", "data_message", "turn", "rounds", "tool_calls")


def _said(pattern: str, x: Column) -> Column:
    before, after = pattern.split("{}")
    return F.concat(F.lit(before), x.cast("string"), F.lit(after))


def agent_state(log: DataFrame, session: str = "session") -> DataFrame:
    """session and STATE after all of its events; draft and cards are a session's own and bounded by what it shows."""
    once = log.groupBy(session, "seq").agg(F.min(F.struct(*_FIELDS)).alias("e")).select(session, "seq", "e.*")
    kind = F.col("type")
    started, failed = kind == "agent_started", (kind == "error") & (F.coalesce("data_message", F.lit("")) != "")
    status = F.when(failed, "failed").otherwise(F.create_map(*(F.lit(x) for pair in STATUS.items() for x in pair))[kind])
    so_far = W.partitionBy(session).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(session).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    calls = kind.isin("agent_tool_call", "agent_tool_result") & (F.coalesce("call_id", F.lit("")) != "")
    result = calls & (kind == "agent_tool_result")
    # a completed turn tells its counts, from which they go on
    sets = lambda c: (kind == "agent_completed") & F.col(c).isNotNull()
    made = result & ~F.coalesce(F.col("reason").isin(*NOT_MADE), F.lit(False))
    known = once.withColumns(
        {
            "_turn": F.sum(started.cast("long")).over(so_far),
            "_status": F.last(status, ignorenulls=True).over(before),
            "_g": F.sum(sets("rounds").cast("long")).over(so_far),
            "_gt": F.sum(sets("tool_calls").cast("long")).over(so_far),
        }
    )
    in_group = W.partitionBy(session, "_g").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    thought = F.when(kind == "agent_thinking", F.col("round")).when(sets("rounds"), F.col("rounds"))
    known = known.withColumn("_rounds", F.coalesce(F.max(thought).over(in_group), F.lit(0)))
    known = known.withColumn("_before", F.coalesce(F.lag("_rounds").over(W.partitionBy(session).orderBy("seq")), F.lit(0)))
    taken = (kind == "delta") & F.coalesce(F.col("_status") == "running", F.lit(False)) & (F.coalesce("text", F.lit("")) != "")
    last = F.max("_turn").over(W.partitionBy(session))
    known = known.withColumns({"_now": F.col("_turn") == last, "_counts": F.col("_gt") == F.max("_gt").over(W.partitionBy(session))})
    round_told = F.coalesce("round", "_before")
    stage = (
        F.when(started, PREPARING)
        .when(kind == "agent_thinking", F.when(F.coalesce("tools", F.lit(0)) > 0, _said(DECIDING, round_told)).otherwise(_said(WRITING, round_told)))
        .when(calls & (kind == "agent_tool_call"), _said(CALLING, F.coalesce("name", F.lit(""))))
        .when(result, F.when(F.coalesce("ok", F.lit(False)), READING).otherwise(_said(FAILED, F.coalesce("name", F.lit("")))))
    )
    ends = status.isNotNull() & ~started
    newest = lambda value, when: F.max_by(F.when(when, F.struct(value.alias("v"))), F.when(when, F.col("seq")))["v"]
    warns = (kind == "error") & ~failed & F.col("_now")
    lines = lambda value, when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("seq", value.alias("v"))))), lambda x: x["v"])
    whole = known.groupBy(session).agg(
        F.max("seq").alias("last_seq"),
        F.coalesce(newest(status, status.isNotNull()), F.lit("none")).alias("status"),
        newest(stage, stage.isNotNull() | ends).alias("live_stage"),
        F.array_join(lines(F.col("text"), taken & F.col("_now")), "").alias("story"),
        F.coalesce(newest(taken, taken | status.isNotNull()), F.lit(False)).alias("streaming"),
        F.coalesce(newest(F.col("turn"), (started | (kind == "agent_completed")) & F.col("turn").isNotNull()), F.lit(0)).alias("turn"),
        F.max_by("_rounds", "seq").alias("rounds"),
        (F.coalesce(F.max(F.when(sets("tool_calls") & F.col("_counts"), F.col("tool_calls"))), F.lit(0)) + F.sum((made & F.col("_counts")).cast("long"))).alias("tool_calls"),
        newest(F.when(failed, F.col("data_message")), started | failed).alias("error"),
        lines(F.coalesce("message", F.lit(LOST)), warns).alias("warnings"),
    )
    whole = whole.withColumn("warnings", F.slice("warnings", F.greatest(F.lit(1), F.size("warnings") - WARNINGS_KEPT + 1), WARNINGS_KEPT))
    text = lambda c: F.coalesce(c, F.lit(""))
    first = F.struct(text("name").alias("name"), F.when(kind == "agent_tool_call", text("args")).otherwise("").alias("args"), F.when(kind == "agent_tool_call", round_told).otherwise(F.col("_before")).alias("round"))
    told = F.struct(F.coalesce("ok", F.lit(False)).alias("ok"), text("summary").alias("summary"), F.nullif("reason", F.lit("")).alias("reason"))
    cards = known.filter(calls & F.col("_now")).groupBy(session, "call_id").agg(F.min("seq").alias("place"), F.min_by(first, "seq").alias("f"), F.max_by(F.when(result, told), F.when(result, F.col("seq"))).alias("r"))
    card = F.struct("call_id", "f.name", "f.args", "f.round", "r.ok", "r.summary", "r.reason")
    shown = cards.groupBy(session).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", card.alias("card")))), lambda x: x["card"]).alias("cards"))
    return whole.join(shown, session, "left").withColumn("cards", F.coalesce("cards", F.array().cast(f"array<{CARD}>")))


def tool_cards(calls: DataFrame, replies: DataFrame, live: DataFrame, session: str = "session") -> DataFrame:
    """session, call_id, name, args, round, ok, summary, preview and origin of every call of the messages.

    A call is shown by its live card if there is one, even if that has no result yet; otherwise with the tool's reply
    among the messages (call_id, text; of several the last by seq), and with neither it is open.
    """
    reply = replies.groupBy(session, "call_id").agg(F.max_by("text", "seq").alias("_reply"))
    seen = live.select(session, "call_id", F.struct("name", "args", "round", "ok", "summary").alias("_live"))
    both = calls.select(session, "call_id", "name", "args").join(seen, [session, "call_id"], "left").join(reply, [session, "call_id"], "left")
    is_live, answered = F.col("_live").isNotNull(), F.coalesce("_reply", F.lit("")) != ""
    pick = lambda c, other: F.when(is_live, F.col(f"_live.{c}")).otherwise(other).alias(c)
    return both.select(
        session, "call_id", pick("name", F.col("name")), pick("args", F.col("args")), pick("round", F.lit(0).cast("long")), pick("ok", F.when(answered, F.lit(True))), pick("summary", F.when(answered, F.lit(""))),
        F.when(~is_live & answered, F.col("_reply")).alias("preview"), F.when(is_live, "live").when(answered, "reply").otherwise("open").alias("origin"),
    )


class AgentFold(StatefulProcessor):
    """agent_state of a stream: counters in one value, cards by call id in a map, the draft's pieces in a list.

    Gives a session's STATE after each batch that has new events of it. With `keep` (milliseconds) a session's state goes
    that long after its latest event by the watermark.
    """

    def __init__(self, keep: int | None = None, session: str = "session"):
        self.keep, self.session = keep, session

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "last_seq long, status string, live_stage string, streaming boolean, turn long, rounds long, tool_calls long, error string, warnings array<string>, timer long")
        self.cards = handle.getMapState("cards", "call_id string", "place long, name string, args string, round long, ok boolean, summary string, reason string")
        self.draft = handle.getListState("draft", "text string")

    def handleInputRows(self, key, rows, timerValues):
        held = self.head.get()
        s = dict(zip(("last_seq", "status", "live_stage", "streaming", "turn", "rounds", "tool_calls", "error", "warnings", "timer"), held or (0, "none", None, False, 0, 0, 0, None, [], None)))
        s["warnings"] = list(s["warnings"] or [])
        # the fields that tell one row of a repeated seq from another are in the order of _FIELDS, nulls first
        ordered = sorted(rows, key=lambda r: (r["seq"], *((r[c] is not None, r[c]) for c in _FIELDS)))
        known = s["last_seq"]
        latest = None
        for r in ordered:
            if self.keep is not None:
                latest = max(latest or r["ts"], r["ts"])
            if r["seq"] > s["last_seq"]:
                s["last_seq"] = r["seq"]
                self._step(s, r)
        if self.keep is not None and latest is not None:
            due = int(latest.timestamp() * 1000) + self.keep
            if s["timer"] is None or due > s["timer"]:
                if s["timer"] is not None:
                    self.handle.deleteTimer(s["timer"])
                self.handle.registerTimer(due)
                s["timer"] = due
        self.head.update(tuple(s.values()))
        if s["last_seq"] > known:
            cards = sorted(((v[0], Row(**dict(zip(_CARD, (k[0], *v[1:]))))) for k, v in self.cards.iterator()), key=lambda x: x[0])
            told = {c: s[c] for c in ("last_seq", "status", "live_stage", "streaming", "turn", "rounds", "tool_calls", "error", "warnings")}
            yield Row(**{self.session: key[0]}, **told, story="".join(x[0] for x in self.draft.get()), cards=[c for _, c in cards])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        for state in (self.head, self.cards, self.draft):
            state.clear()
        yield from ()

    def _step(self, s: dict, r: Row) -> None:
        kind = r["type"]
        told = lambda c, other: other if r[c] is None else r[c]
        if kind == "agent_started":
            s |= {"status": "running", "live_stage": PREPARING, "streaming": False, "error": None, "warnings": [], "turn": told("turn", s["turn"])}
            self.cards.clear()
            self.draft.clear()
        elif kind == "agent_thinking":
            at = told("round", s["rounds"])
            s |= {"rounds": max(s["rounds"], at), "live_stage": (DECIDING if told("tools", 0) > 0 else WRITING).format(at)}
        elif kind in ("agent_tool_call", "agent_tool_result") and r["call_id"]:
            self._call(s, r, kind == "agent_tool_result", told)
        elif kind == "delta" and s["status"] == "running" and r["text"]:
            self.draft.appendValue((r["text"],))
            s["streaming"] = True
        elif kind == "agent_completed":
            s |= {"status": "idle", "streaming": False, "live_stage": None, **{c: told(c, s[c]) for c in ("rounds", "tool_calls", "turn")}}
        elif kind == "agent_cancelled":
            s |= {"status": "cancelled", "streaming": False, "live_stage": None}
        elif kind == "error" and r["data_message"]:
            s |= {"status": "failed", "streaming": False, "live_stage": None, "error": r["data_message"]}
        elif kind == "error":
            s["warnings"] = [*s["warnings"], told("message", LOST)][-WARNINGS_KEPT:]

    def _call(self, s: dict, r: Row, result: bool, told) -> None:
        at, name = (r["call_id"],), r["name"] or ""
        card = self.cards.getValue(at) if self.cards.containsKey(at) else None
        if card is None:
            card = (r["seq"], name, "" if result else r["args"] or "", s["rounds"] if result else told("round", s["rounds"]), None, None, None)
            self.cards.updateValue(at, card)
        if result:
            self.cards.updateValue(at, (*card[:4], bool(r["ok"]), r["summary"] or "", r["reason"] or None))
            s["tool_calls"] += r["reason"] not in NOT_MADE
            s["live_stage"] = READING if r["ok"] else FAILED.format(name)
        else:
            s["live_stage"] = CALLING.format(name)
