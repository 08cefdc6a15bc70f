"""Queries of a run's tables: sinks, versions, reads by run, the whole snapshot, the fold of partial results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import payload as J
from weftline.operators import incremental as I
from weftline.operators import persist as P
from weftline.plans.cleaning import _KEY
from weftline.sources.tables import table
from weftline.streaming import events as E
from weftline.streaming.events import sequenced

_LINE = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("comment_id"), "role", "text")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "run_id")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "run_id")


def persist_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third conversation is stored anew with its even turns; the others keep their rows."""
    t = _turns(spark, sf_dir)
    old = t.select("run_id", "comment_id", F.lit("old").alias("text_hash"), F.lit("someone").alias("author_id"))
    new = P.comment_rows(t.filter("run_id % 3 = 0 and comment_id % 2 = 0"))
    return P.replaced(old, new).select("run_id", "comment_id", "text_hash", "author_id")


def persist_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles are clusters of the turns but every fifth; a later cluster lists turn 1 again."""
    t = _turns(spark, sf_dir)
    roles = t.filter("comment_id % 5 != 0").groupBy("run_id", F.col("role").alias("cluster_key")).agg(F.collect_list("comment_id").alias("comment_ids")).withColumn("order_index", F.lit(0))
    late = t.select("run_id").distinct().select("run_id", F.lit("late").alias("cluster_key"), F.array(F.lit(1).cast("bigint"), F.lit(999).cast("bigint")).alias("comment_ids"), F.lit(9).alias("order_index"))
    return P.with_cluster(t, roles.unionByName(late)).select("run_id", "comment_id", "cluster_key")


def persist_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("key"), "o_custkey", "o_orderpriority")
    old = o.filter("run_id % 2 = 0").select("run_id", "key", (F.col("o_custkey") % 5 + 1).alias("version"), F.col("o_orderpriority").alias("content"), (F.col("run_id") % 4 == 0).alias("edited"), (F.col("o_custkey") % 2 == 0).alias("stale"))
    new = o.filter("run_id % 3 = 0").select("run_id", "key", F.when(F.col("o_custkey") % 3 == 0, 7).alias("version"), F.lit("new").alias("content"))
    return P.versioned(old, new, ("run_id", "key"))


def delete_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that four tables keep once a third of the runs is deleted from them."""
    l = _lines(spark, sf_dir)
    gone = _runs(spark, sf_dir).filter("run_id % 3 = 0")
    tables = {"comments": l, "clusters": l.select("run_id", "l_returnflag").distinct(), "evidence": l.select("run_id", "l_partkey"), "reasoning": l.filter("l_linenumber <= 2")}
    out = None
    for name, rows in tables.items():
        kept = P.without_runs(rows, gone).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = kept if out is None else out.unionByName(kept)
    return out


def event_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 30 stream entries of each run."""
    e = sequenced(table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "event_id"), "run_id", "event_id")
    return P.stream_tail(e, 30).select("run_id", "event_id", "entry_id")


def _read(rows: Callable[[SparkSession, str], DataFrame], *order: str) -> Callable[[SparkSession, str], DataFrame]:
    """The rows with their place in the run; a name with a minus before it is in falling order."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return P.listed(rows(spark, sf_dir), *(F.desc(c[1:]) if c[0] == "-" else F.col(c) for c in order))

    return query


def _comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("run_id", "comment_id", F.length("text").alias("likes"))


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy("run_id", F.col("l_returnflag").alias("cluster_key")).agg(F.min("l_linenumber").alias("order_index"), F.count("*").alias("size"))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("run_id", "l_partkey", "l_extendedprice")


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("run_id", *_LINE)


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select("run_id", F.explode(F.array("o_orderstatus", "o_orderpriority")).alias("key"))


def sections_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir).filter("run_id % 7 = 1")


def video_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return _runs(spark, sf_dir).filter("run_id % 7 = 1").join(c, "o_custkey", "left").select("run_id", "c_name")


def profile_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).filter("run_id % 7 = 1").select("run_id", "o_orderpriority", "o_totalprice")


def whole_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with all its child tables, lists written as text."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("video"))
    runs = _runs(spark, sf_dir).join(c, "o_custkey", "left").select("run_id", "video", F.col("o_orderpriority").alias("profile"))
    l, line = _lines(spark, sf_dir), [F.col(x) for x in _LINE]
    children = {
        "comments": (l, [-F.col("l_quantity"), *line], ["l_linenumber"]),
        "clusters": (_clusters(spark, sf_dir), [F.col("order_index"), F.col("cluster_key")], ["cluster_key"]),
        "evidence": (l, [-F.col("l_extendedprice"), F.col("l_partkey")], ["l_partkey"]),
        "reasoning": (l.filter("l_returnflag != 'N'"), line, ["l_suppkey"]),
        "sections": (_sections(spark, sf_dir), [F.col("key")], ["key"]),
    }
    s = P.snapshot(runs, children)
    text = lambda c: F.array_join(F.transform(c, lambda x: x[children[c][2][0]].cast("string")), ",").alias(c)
    return s.select("run_id", "video", "profile", *(text(c) for c in children))


def snapshot_over_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "run_id")
    stored = o.filter("run_id % 3 != 0").select("run_id", F.when(F.col("o_orderstatus") == "F", "succeeded").otherwise("running").alias("status"), (F.col("o_custkey") % 130).cast("double").alias("progress"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderpriority")).alias("profile"))
    live = o.filter("run_id % 2 = 0").select("run_id", F.when(F.col("o_custkey") % 4 == 0, "failed").otherwise("running").alias("status"), (F.col("run_id") % 110).cast("double").alias("progress"), F.lit("live").alias("profile"))
    return P.over_live(stored, live, ("profile",))


def partial_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as partial results of eight kinds, a quarter of them sent twice."""
    kinds = F.array(*(F.lit(k) for k in ("video", "comment_stats", "clusters", "profile", "evidence", "reasoning", "comment_page", "sections")))
    e = sequenced(table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "event_id", "event_type", "value"), "run_id", "event_id")
    log = e.select("run_id", "seq", kinds[(F.col("event_id") % 8).cast("int")].alias("kind"), F.col("event_type").alias("key"), F.col("event_id").cast("string").alias("payload"))
    f = P.partial_fold(log.unionByName(log.filter("seq % 4 = 0")), ("video", "comment_stats", "clusters", "profile"), ("evidence", "reasoning"))
    sections = F.array_join(F.transform(F.map_entries("sections"), lambda x: F.concat(x["key"], F.lit(":"), x["value"])), ",")
    return f.select("run_id", "video", "comment_stats", "clusters", "profile", F.array_join("evidence", ",").alias("evidence"), F.array_join("reasoning", ",").alias("reasoning"), "comments", sections.alias("sections"))


_TYPES = ("run_started", "node_started", "progress", "node_completed", "partial", "delta", "warning", "progress", "error", "node_started", "run_cancelled", "node_completed", "run_completed")


def run_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of all types of a run's log; a quarter of them are sent twice."""
    kinds = F.array(*(F.lit(t) for t in _TYPES))
    e = sequenced(table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "event_id", "event_type", "value"), "run_id", "event_id")
    message = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("m"), F.col("event_id").cast("string")))
    log = e.select("run_id", "seq", kinds[(F.col("event_id") % len(_TYPES)).cast("int")].alias("type"), F.col("event_type").alias("node"), message.alias("message"), F.when(F.col("event_id") % 2 == 0, F.floor(F.col("value")) % 120).cast("double").alias("progress"))
    nodes = F.array_join(F.transform(F.map_entries("nodes"), lambda x: F.concat(x["key"], F.lit(":"), x["value"])), ",")
    return E.run_state(log.unionByName(log.filter("seq % 4 = 0"))).withColumn("nodes", nodes)


def import_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a step of an import."""
    stages = F.array(*(F.lit(x) for x in (*E.IMPORT_BANDS, "none")))
    return table(spark, sf_dir, "events").select("event_id", E.stage_progress(stages[(F.col("event_id") % 6).cast("int")], (F.col("event_id") % 13 - 1) / 10).alias("progress"))


def event_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events after a position, in order, as agents read them."""
    e = sequenced(table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "event_id", "event_type"), "run_id", "event_id")
    return P.listed(E.replayed(e, F.col("run_id") % 30), "seq")


def fixture_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as one JSON document each, with a video and a list of comments, and back to rows."""
    c = table(spark, sf_dir, "conversations")
    comments = F.array_sort(F.collect_list(F.struct(F.col("turn").alias("comment_id"), F.struct("role", F.length("text").alias("likes")).alias("stats"), "text")))
    doc = F.to_json(F.struct(F.struct(F.concat(F.lit("video "), F.col("conv_id").cast("string")).alias("title"), F.count("*").alias("n")).alias("video"), comments.alias("comments")))
    v = c.groupBy("conv_id").agg(doc.alias("doc")).select("conv_id", F.parse_json("doc").alias("v"))
    each = v.select("conv_id", J.dug(F.col("v"), "video.title", "string").alias("title"), J.dug(F.col("v"), "video.n", "bigint").alias("n"), F.explode(J.dug(F.col("v"), "comments", "array<variant>")).alias("c"))
    return each.select("conv_id", "title", "n", J.dug(F.col("c"), "comment_id", "bigint").alias("turn"), J.dug(F.col("c"), "stats.role", "string").alias("role"), J.dug(F.col("c"), "stats.likes", "bigint").alias("likes"), F.md5(J.dug(F.col("c"), "text", "string")).alias("digest"))


def remote_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of orders as a service gives them, numbers as text and some missing."""
    o = table(spark, sf_dir, "orders")
    stats = F.struct(F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_custkey")).cast("string")).alias("likes"), F.when(F.col("o_orderkey") % 4 == 0, "many").alias("shares"))
    v = o.select("o_orderkey", F.parse_json(F.to_json(F.struct(F.struct(F.col("o_orderpriority").alias("title"), stats.alias("stats")).alias("detail")))).alias("v"))
    row = J.unwrapped(F.col("v"), ("detail",))
    return v.select("o_orderkey", J.first_present(row, "name", "title").alias("title"), J.first_present(row, "stats.likes", kind="bigint").alias("likes"), J.first_present(row, "stats.shares", kind="bigint").alias("shares"))


def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of chunks, one for each or the query ends."""
    e = table(spark, sf_dir, "embeddings")
    c = I.complete(e.select("vec_id", "label"), e.select("vec_id", F.col("embedding").alias("vector")), "vec_id")
    return c.select("vec_id", "label", F.size("vector").alias("dim"))


def expanded_poems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 60 texts, in the order of their sources, that are not known yet."""
    d = table(spark, sf_dir, "documents").select(F.md5(F.coalesce("text", F.lit(""))).alias("chunk_id"), "source", "doc_id")
    return I.taken(d, d.filter("doc_id % 2 = 0"), "chunk_id", ("source", "doc_id"), 60).select("chunk_id", "source", "doc_id")


QUERIES = {f.__name__: f for f in (persist_comments, persist_clusters, persist_sections, delete_run, event_tail, sections_by_run, video_by_run, profile_by_run, whole_snapshot, snapshot_over_live, partial_fold, run_state, import_progress, event_range, fixture_comments, remote_row, embedded_chunks, expanded_poems)} | {
    "comments_by_run": _read(_comments, "-likes", "comment_id"),
    "clusters_by_run": _read(_clusters, "order_index", "cluster_key"),
    "evidence_by_run": _read(_evidence, "-l_extendedprice", "l_partkey"),
    "steps_by_run": _read(_steps, *_LINE),
}

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_CLUSTERS = "select l_orderkey as run_id, l_returnflag as cluster_key, min(l_linenumber) as order_index, count(*) as size from lineitem group by 1, 2"
_LOG = "l as (select user_id as run_id, event_id, event_type, event_id % 8 as k, row_number() over (partition by user_id order by event_id) as seq from events)"
_STATE = f"""e0 as (select user_id as run_id, event_id, event_type as node, row_number() over (partition by user_id order by event_id) as seq, {list(_TYPES)}[event_id % {len(_TYPES)} + 1] as type,
    case when event_id % 3 <> 0 then 'm' || event_id end as message, case when event_id % 2 = 0 then floor(value)::bigint % 120 end as progress from events),
  e1 as (select *, last_value(case when type = 'node_started' then node end ignore nulls) over w as running, last_value(case when type = 'node_started' and node is not null then seq end ignore nulls) over w as opened
    from e0 window w as (partition by run_id order by seq rows between unbounded preceding and 1 preceding)),
  e2 as (select *, last_value(case when type = 'node_completed' and node = running then seq end ignore nulls) over (partition by run_id order by seq rows between unbounded preceding and 1 preceding) as ended from e1),
  e as (select *, case when ended is null or ended < opened then running end as now from e2),
  f as (select *, type = 'node_started' as s, type = 'node_completed' and node is not distinct from now as l, type = 'progress' and message is not null as p from e)"""
ORACLE_SQL = {
    "run_state": f"""with {_STATE}, n as (select run_id, node, arg_max(case when s then 'running' else 'done' end, seq) as st from f where type in ('node_started', 'node_completed') group by 1, 2), k as (select run_id, string_agg(node || ':' || st, ',' order by node) as nodes from n group by 1),
      g as (select run_id, max(seq) as last_seq, arg_max(case type when 'run_started' then 'running' when 'error' then 'failed' when 'run_completed' then 'succeeded' else 'cancelled' end, seq) filter (type in ('run_started', 'error', 'run_completed', 'run_cancelled')) as status,
        (case when bool_or(type = 'run_completed') then 100 else least(100, greatest(0, coalesce(max(progress), 0))) end)::double as progress,
        (arg_max({{'v': case when s then coalesce(node, now) end}}, seq) filter (s or l)).v as current_node, (arg_max({{'v': case when s or p then message end}}, seq) filter (s or p or l)).v as current_message,
        count(*) filter (type = 'warning') as warnings, arg_max(coalesce(message, ''), seq) filter (type = 'error') as error, count(*) filter (type not in ('partial', 'delta', 'progress') or p) as timeline from f group by 1)
      select g.*, nodes from g left join k using (run_id)""",
    "import_progress": """with b as (select event_id, [0, 5, 15, 70, 90, null][event_id % 6 + 1] as low, [5, 15, 70, 90, 100, null][event_id % 6 + 1] as high, least(1.0, greatest(0.0, (event_id % 13 - 1) / 10))::double as r from events)
      select event_id, floor(low + (high - low) * r)::bigint as progress from b""",
    "event_range": """with e as (select user_id as run_id, event_id, event_type, row_number() over (partition by user_id order by event_id) as seq from events)
      select *, row_number() over (partition by run_id order by seq) as place from e where seq > run_id % 30""",
    "fixture_comments": "select conv_id, 'video ' || conv_id as title, count(*) over (partition by conv_id) as n, turn, role, length(text)::bigint as likes, md5(text) as digest from conversations",
    "remote_row": "select o_orderkey, o_orderpriority as title, case when o_orderkey % 3 <> 0 then o_custkey end as likes, null::bigint as shares from orders",
    "embedded_chunks": "select vec_id, label, len(embedding) as dim from embeddings",
    "expanded_poems": """with d as (select md5(coalesce(text, '')) as chunk_id, source, doc_id from documents), n as (select chunk_id, min((source, doc_id)) as s from d where chunk_id not in (select chunk_id from d where doc_id % 2 = 0) group by 1)
      select chunk_id, s[1] as source, s[2] as doc_id from n order by s limit 60""",
    "persist_comments": f"""select conv_id as run_id, turn as comment_id, case when conv_id % 3 = 0 then {_KEY.replace("(body,", "(text,")} else 'old' end as text_hash, case when conv_id % 3 <> 0 then 'someone' end as author_id
      from conversations where conv_id % 3 <> 0 or turn % 2 = 0""",
    "persist_clusters": "select conv_id as run_id, turn as comment_id, case when turn = 1 then 'late' when turn % 5 <> 0 then role end as cluster_key from conversations",
    "persist_sections": """select o_orderkey as run_id, o_orderstatus as key,
        (case when o_orderkey % 2 <> 0 then (case when o_custkey % 3 = 0 then 7 else 1 end) when o_orderkey % 3 <> 0 or o_orderkey % 4 = 0 then o_custkey % 5 + 1 else (case when o_custkey % 3 = 0 then 8 else o_custkey % 5 + 2 end) end)::bigint as version,
        case when o_orderkey % 3 = 0 then 'new' else o_orderpriority end as content, o_orderkey % 4 = 0 as edited, (o_orderkey % 2 = 0 and (o_orderkey % 3 <> 0 or o_orderkey % 4 = 0) and o_custkey % 2 = 0) as stale
      from orders where o_orderkey % 2 = 0 or o_orderkey % 3 = 0""",
    "delete_run": """with l as (select * from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 3 = 0))
      select 'comments' as name, count(*) as n from l union all select 'clusters', count(distinct (l_orderkey, l_returnflag)) from l union all select 'evidence', count(*) from l union all select 'reasoning', count(*) from l where l_linenumber <= 2""",
    "event_tail": """select run_id, event_id, seq || '-0' as entry_id from (select user_id as run_id, event_id, row_number() over (partition by user_id order by event_id) as seq, row_number() over (partition by user_id order by event_id desc) as back from events) where back <= 30""",
    "sections_by_run": "select o_orderkey as run_id, unnest([o_orderstatus, o_orderpriority]) as key from orders where o_orderkey % 7 = 1",
    "video_by_run": "select o_orderkey as run_id, c_name from orders left join customer on c_custkey = o_custkey where o_orderkey % 7 = 1",
    "profile_by_run": "select o_orderkey as run_id, o_orderpriority, o_totalprice from orders where o_orderkey % 7 = 1",
    "whole_snapshot": f"""with c as (select l_orderkey as run_id, string_agg(l_linenumber::varchar, ',' order by l_quantity desc, {_ORDER}) as comments, string_agg(l_partkey::varchar, ',' order by l_extendedprice desc, l_partkey) as evidence,
        coalesce(string_agg(l_suppkey::varchar, ',' order by {_ORDER}) filter (l_returnflag <> 'N'), '') as reasoning from lineitem group by 1),
      k as (select run_id, string_agg(cluster_key, ',' order by order_index, cluster_key) as clusters from ({_CLUSTERS}) group by 1)
      select o_orderkey as run_id, c_name as video, o_orderpriority as profile, coalesce(comments, '') as comments, coalesce(clusters, '') as clusters, coalesce(evidence, '') as evidence, coalesce(reasoning, '') as reasoning,
        least(o_orderstatus, o_orderpriority) || ',' || greatest(o_orderstatus, o_orderpriority) as sections
      from orders left join customer on c_custkey = o_custkey left join c on c.run_id = o_orderkey left join k on k.run_id = o_orderkey""",
    "snapshot_over_live": """with s as (select o_orderkey as run_id, case when o_orderstatus = 'F' then 'succeeded' else 'running' end as status, o_custkey % 130 as progress, case when o_custkey % 2 = 0 then o_orderpriority end as profile from orders where o_orderkey % 3 <> 0),
      l as (select o_orderkey as run_id, case when o_custkey % 4 = 0 then 'failed' else 'running' end as status, o_orderkey % 110 as progress, 'live' as profile from orders where o_orderkey % 2 = 0)
      select run_id, case when l.status = 'failed' then 'failed' else coalesce(s.status, l.status) end as status, least(100.0, greatest(coalesce(s.progress, 0), coalesce(l.progress, 0)))::double as progress, coalesce(s.profile, l.profile) as profile from s full join l using (run_id)""",
    "partial_fold": f"""with {_LOG}, s as (select run_id, string_agg(event_type || ':' || p, ',' order by event_type) as sections from (select run_id, event_type, arg_max(event_id, seq) as p from l where k = 7 group by 1, 2) group by 1),
      f as (select run_id, {', '.join(f"(arg_max(event_id, seq) filter (k = {i}))::varchar as {c}" for i, c in enumerate(("video", "comment_stats", "clusters", "profile")))},
        {', '.join(f"coalesce(string_agg(event_id::varchar, ',' order by seq) filter (k = {i}), '') as {c}" for i, c in ((4, "evidence"), (5, "reasoning")))}, count(distinct event_type) filter (k = 6) as comments from l group by 1)
      select f.*, sections from f left join s using (run_id)""",
    "comments_by_run": "select conv_id as run_id, turn as comment_id, length(text)::bigint as likes, row_number() over (partition by conv_id order by length(text) desc, turn) as place from conversations",
    "clusters_by_run": f"select *, row_number() over (partition by run_id order by order_index, cluster_key) as place from ({_CLUSTERS})",
    "evidence_by_run": "select l_orderkey as run_id, l_partkey, l_extendedprice, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_partkey) as place from lineitem",
    "steps_by_run": f"select l_orderkey as run_id, {_ORDER}, row_number() over (partition by l_orderkey order by {_ORDER}) as place from lineitem",
}
