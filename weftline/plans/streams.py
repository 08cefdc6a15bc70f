"""Queries of the streams: the given events come in parts, the stream stops after the first and goes on from its checkpoint."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.keyed import KeyedTable
from weftline.operators.storage import stored
from weftline.plans.persist import _TYPES
from weftline.plans.persist import ORACLE_SQL as _PERSIST
from weftline.plans.stored import scratch
from weftline.sources.tables import table
from weftline.streaming import sessions as A
from weftline.streaming import stateful as S
from weftline.streaming.events import sequenced

#: Milliseconds of a day.
_DAY = 86_400_000
_KINDS = ["agent_started"] * 2 + ["agent_thinking"] * 4 + ["agent_tool_call"] * 5 + ["agent_tool_result"] * 4 + ["delta"] * 5 + ["agent_completed", "error", "agent_cancelled"]


def in_parts(log: DataFrame, cuts: Sequence[Column], again: Column, make, sink, mode: str) -> str:
    """Writes log in parts, each with rows of the part before that come again, and lets the stream read each, stop, and go on after a restart.

    A part is one batch, of as many files as there are tasks.
    """
    spark, at = log.sparkSession, scratch(log.sparkSession, "parts")
    checkpoint = scratch(spark, "progress")
    part = F.lit(0)
    for c in cuts:
        part = part + c.cast("int")
    log = stored(log.withColumn("_part", part), "log")
    for k in range(len(cuts) + 1):
        rows = log.filter((F.col("_part") == k) | ((F.col("_part") == k - 1) & again)).drop("_part")
        rows.write.mode("append").parquet(at)
        S.drained(make(S.files_of(spark, rows.schema, at, None)), sink, checkpoint, mode)
    return at


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def event_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users, some sent twice, numbered by a stream and kept by a sink that may write a batch again."""
    e = _events(spark, sf_dir)
    log = e.select(F.col("user_id").alias("run_id"), "event_id", "ts", (F.floor(F.col("value") % 110 * 4) / 4).alias("progress"))
    first, second = e.select(F.expr("percentile(unix_micros(ts), array(0.3, 0.7))").alias("p")).first()["p"]
    cuts = [F.unix_micros("ts") > int(x) for x in (first, second)]
    out = scratch(spark, "numbered")
    in_parts(log, cuts, F.col("progress") > 30, lambda s: S.numbered(s, "1 hour", 400 * _DAY), S.into_folders(out), "append")
    return spark.read.parquet(out).select("run_id", "event_id", "seq", F.round("progress", 6).alias("progress"))


def _run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*(F.lit(t) for t in _TYPES))
    e = sequenced(_events(spark, sf_dir).select(F.col("user_id").alias("run_id"), "event_id", "event_type", "value"), "run_id", "event_id")
    message = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("m"), F.col("event_id").cast("string")))
    return e.select("run_id", "seq", kinds[(F.col("event_id") % len(_TYPES)).cast("int")].alias("type"), F.col("event_type").alias("node"), message.alias("message"), F.when(F.col("event_id") % 2 == 0, F.floor(F.col("value")) % 120).cast("double").alias("progress"))


def _nodes() -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries("nodes")), lambda x: F.concat(x["key"], F.lit(":"), x["value"])), ",").alias("nodes")


def run_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The client's fold of all event types as a stream into a keyed table, with events that come again."""
    log = _run_log(spark, sf_dir)
    states = KeyedTable.create(spark, scratch(spark, "states"), S.schema_of(log, ["run_id"], S.RUN_STATE), ("run_id",), buckets=8)
    in_parts(log, [F.col("seq") > 10, F.col("seq") > 25], F.col("type") == "warning", S.run_states, S.into_table(states.path), "update")
    return states.read().withColumn("nodes", _nodes())


def agent_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as those of agents' sessions."""
    e = sequenced(_events(spark, sf_dir).select(F.col("user_id").alias("session"), "event_id", "event_type", "value"), "session", "event_id")
    i = F.col("event_id")
    kinds = F.array(*(F.lit(x) for x in _KINDS))
    named = lambda letter: F.concat(F.lit(letter), i.cast("string"))
    reasons = F.array(F.lit("refused"), F.lit("bad_arguments"), F.lit("timeout"))
    return e.select(
        "session", "seq", kinds[((i * 7 + F.floor(i / 11)) % len(_KINDS)).cast("int")].alias("type"), F.when(i % 31 != 0, F.concat(F.lit("c"), (i % 6).cast("string"))).alias("call_id"), F.col("event_type").alias("name"),
        F.concat(F.lit('{"v":'), F.floor("value").cast("string"), F.lit("}")).alias("args"), F.when(i % 5 != 0, i % 9).alias("round"), F.when(i % 4 != 0, i % 3).alias("tools"), (i % 4 != 0).alias("ok"), named("s").alias("summary"),
        F.when(i % 13 < 3, reasons[(i % 13).cast("int") % 3]).alias("reason"), F.when(i % 17 != 0, F.concat(named("t"), F.lit(" "))).alias("text"), F.when(i % 3 != 0, named("m")).alias("message"), F.when(i % 2 == 0, named("d")).alias("data_message"),
        F.when(i % 4 != 3, i % 4).alias("turn"), F.when(i % 7 < 3, i % 7).alias("rounds"), F.when(i % 3 == 0, i % 8).alias("tool_calls"),
    )


def _shown(states: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    card = lambda c: F.concat_ws("/", *(text(c[x]) for x in ("call_id", "name", "args", "round", "ok", "summary", "reason")))
    return states.select("session", "last_seq", "status", "live_stage", F.md5("story").alias("story"), "streaming", "turn", "rounds", "tool_calls", "error", F.array_join("warnings", "|").alias("warnings"), F.array_join(F.transform("cards", card), "|").alias("cards"))


def agent_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every session after all of its events, of which some come twice."""
    log = agent_log(spark, sf_dir)
    return _shown(A.agent_state(log.unionByName(log.filter("type = 'agent_tool_result'"))))


def agent_fold_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream in three parts with a restart."""
    log = agent_log(spark, sf_dir)
    schema = S.schema_of(log, ["session"], A.STATE)
    states = KeyedTable.create(spark, scratch(spark, "sessions"), schema, ("session",), buckets=8)
    make = lambda s: S.with_state(s, ["session"], A.AgentFold(), schema)
    in_parts(log, [F.col("seq") > 10, F.col("seq") > 25], F.col("type") == "agent_tool_result", make, S.into_table(states.path), "update")
    return _shown(states.read())


def transcript_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call of the sessions as the messages tell it, with the live card where the stream has it, else with the tool's reply."""
    log = agent_log(spark, sf_dir)
    calls = log.filter("type = 'agent_tool_call' and call_id is not null").groupBy("session", "call_id").agg(F.min_by(F.struct("name", "args"), "seq").alias("c")).select("session", "call_id", "c.*")
    replies = log.filter("type = 'agent_tool_result' and call_id is not null").select("session", "call_id", "seq", F.col("summary").alias("text"))
    cards = A.agent_state(log).select("session", F.explode("cards").alias("card")).select("session", "card.*")
    return A.tool_cards(calls, replies, cards)


QUERIES = {f.__name__: f for f in (event_sink, run_state_stream, agent_fold, agent_fold_stream, transcript_cards)}

_RUN_STATE = _PERSIST["run_state"]
_K = len(_KINDS)
_AGENT = f"""e0 as (select user_id as session, event_id as i, event_type as name, value, row_number() over (partition by user_id order by event_id) as seq from events),
  e as (select session, seq, name, {_KINDS}[(i * 7 + i // 11) % {_K} + 1] as type, case when i % 31 <> 0 then 'c' || i % 6 end as call_id, '{{"v":' || floor(value)::bigint || '}}' as args, case when i % 5 <> 0 then i % 9 end as round,
    case when i % 4 <> 0 then i % 3 end as tools, i % 4 <> 0 as ok, 's' || i as summary, case when i % 13 < 3 then ['refused', 'bad_arguments', 'timeout'][i % 13 + 1] end as reason, case when i % 17 <> 0 then 't' || i || ' ' end as text,
    case when i % 3 <> 0 then 'm' || i end as message, case when i % 2 = 0 then 'd' || i end as data_message, case when i % 4 <> 3 then i % 4 end as turn, case when i % 7 < 3 then i % 7 end as rounds, case when i % 3 = 0 then i % 8 end as tool_calls from e0),
  s as (select *, case when type = 'agent_started' then 'running' when type = 'agent_completed' then 'idle' when type = 'agent_cancelled' then 'cancelled' when type = 'error' and data_message is not null then 'failed' end as st,
    type in ('agent_tool_call', 'agent_tool_result') and call_id is not null as is_call from e),
  w as (select *, sum((type = 'agent_started')::int) over q as t, last_value(st ignore nulls) over (partition by session order by seq rows between unbounded preceding and 1 preceding) as was,
    sum((type = 'agent_completed' and rounds is not null)::int) over q as g, sum((type = 'agent_completed' and tool_calls is not null)::int) over q as h from s window q as (partition by session order by seq)),
  r as (select *, coalesce(max(case when type = 'agent_thinking' then round when type = 'agent_completed' then rounds end) over (partition by session, g order by seq), 0) as now_rounds from w),
  b as (select *, coalesce(lag(now_rounds) over (partition by session order by seq), 0) as had, t = max(t) over (partition by session) as cur, h = max(h) over (partition by session) as counting, type = 'delta' and coalesce(was = 'running', false) and text is not null as taken from r),
  cards as (select session, call_id, min(seq) as place, arg_min(name, seq) as name, arg_min(case when type = 'agent_tool_call' then args else '' end, seq) as args, arg_min(case when type = 'agent_tool_call' then coalesce(round, had) else had end, seq) as round,
    arg_max(ok, seq) filter (type = 'agent_tool_result') as ok, arg_max(summary, seq) filter (type = 'agent_tool_result') as summary, (arg_max({{'v': reason}}, seq) filter (type = 'agent_tool_result')).v as reason from b where is_call and cur group by 1, 2)"""
_FOLD = f"""with {_AGENT}, c as (select session, string_agg(call_id || '/' || name || '/' || args || '/' || round || '/' || coalesce(ok::varchar, '-') || '/' || coalesce(summary, '-') || '/' || coalesce(reason, '-'), '|' order by place) as cards from cards group by 1),
  k as (select session, max(seq) as last_seq, coalesce(arg_max(st, seq) filter (st is not null), 'none') as status,
    (arg_max({{'v': case when type = 'agent_started' then '{A.PREPARING}' when type = 'agent_thinking' then '第 ' || coalesce(round, had) || case when coalesce(tools, 0) > 0 then ' 轮：模型正在决定下一步…' else ' 轮：正在写正文…' end
      when type = 'agent_tool_call' then '正在调用 ' || name || '…' when type = 'agent_tool_result' then case when ok then '{A.READING}' else '工具 ' || name || ' 没有成功…' end end}}, seq) filter (st is not null or type = 'agent_thinking' or is_call)).v as live_stage,
    md5(coalesce(string_agg(text, '' order by seq) filter (taken and cur), '')) as story, coalesce(arg_max(taken, seq) filter (taken or st is not null), false) as streaming,
    coalesce(arg_max(turn, seq) filter (type in ('agent_started', 'agent_completed') and turn is not null), 0) as turn, arg_max(now_rounds, seq) as rounds,
    (coalesce(max(tool_calls) filter (type = 'agent_completed' and counting), 0) + count(*) filter (is_call and type = 'agent_tool_result' and counting and (reason is null or reason = 'timeout')))::bigint as tool_calls,
    (arg_max({{'v': case when type = 'error' then data_message end}}, seq) filter (type = 'agent_started' or st = 'failed')).v as error,
    array_to_string(list_slice(coalesce(list(coalesce(message, '{A.LOST}') order by seq) filter (type = 'error' and data_message is null and cur), []), -{A.WARNINGS_KEPT}, -1), '|') as warnings from b group by 1)
  select k.*, coalesce(cards, '') as cards from k left join c using (session)"""
ORACLE_SQL = {
    "run_state_stream": _RUN_STATE,
    "event_sink": """select user_id as run_id, event_id, row_number() over w as seq, round(least(100.0, greatest(0.0, max(floor((value % 110) * 4) / 4) over w)), 6) as progress from events window w as (partition by user_id order by ts, event_id)""",
    "agent_fold": _FOLD,
    "agent_fold_stream": _FOLD,
    "transcript_cards": f"""with {_AGENT}, calls as (select session, call_id, arg_min(name, seq) as name, arg_min(args, seq) as args from e where type = 'agent_tool_call' and call_id is not null group by 1, 2),
      replies as (select session, call_id, arg_max(summary, seq) as reply from e where type = 'agent_tool_result' and call_id is not null group by 1, 2)
      select session, call_id, coalesce(l.name, c.name) as name, coalesce(l.args, c.args) as args, coalesce(l.round, 0) as round, case when l.name is not null then l.ok when reply is not null then true end as ok,
        case when l.name is not null then l.summary when reply is not null then '' end as summary, case when l.name is null then reply end as preview, case when l.name is not null then 'live' when reply is not null then 'reply' else 'open' end as origin
      from calls c left join cards l using (session, call_id) left join replies using (session, call_id)""",
}
