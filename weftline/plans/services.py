"""Queries of incremental maintenance, event logs, lists and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators import incremental as I
from weftline.sources.tables import table
from weftline.streaming import events as E

FILES = ("src0", "src1", "src2")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_file"), F.col("lang").alias("library"), I.content_hash(F.col("text"), "hash", 64).alias("content_hash"))


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry as an earlier run left it: a third not yet there, some with other texts, some without a source, some of chunks that are gone."""
    c = _chunks(spark, sf_dir).filter("chunk_id % 3 != 0").withColumn("content_hash", F.when(F.col("chunk_id") % 5 == 0, F.md5("content_hash")).otherwise(F.col("content_hash")))
    gone = c.filter("chunk_id % 4 = 0").withColumn("chunk_id", F.col("chunk_id") + 1_000_000_000)
    return c.unionByName(gone).withColumn("source_file", F.when(F.col("chunk_id") % 7 != 0, F.col("source_file")))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("chunk_id", "content_hash")


def registry_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.diff(_chunks(spark, sf_dir), _registry(spark, sf_dir)).select("chunk_id", "action")


def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.diff(_chunks(spark, sf_dir), _registry(spark, sf_dir)).groupBy("library", "action").agg(F.count("*").alias("n"))


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.orphans(_registry(spark, sf_dir), _chunks(spark, sf_dir), FILES).select("chunk_id", "source_file")


def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = I.diff(_chunks(spark, sf_dir), _registry(spark, sf_dir)).filter("action != 'skipped'")
    return I.upserted(_registry(spark, sf_dir), new, ("chunk_id",)).select("chunk_id", "source_file", "content_hash")


def delete_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _registry(spark, sf_dir)
    return I.deleted(r, r.filter(F.col("source_file") == "src3"), "chunk_id").select("chunk_id", "library")


def null_safe_not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.imported(_registry(spark, sf_dir), FILES).groupBy("library").agg(F.count("*").alias("n"))


def sources_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _registry(spark, sf_dir).filter(F.col("source_file").isNotNull() & ~F.col("source_file").isin(*FILES))
    return r.groupBy("source_file", "library").agg(F.count("*").alias("n"), F.max("chunk_id").alias("latest"))


def cached_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache that holds half of the distinct texts; the misses are computed."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("word"))
    cache = d.filter(F.crc32("word") % 2 == 0).select("word").distinct().withColumn("digest", F.md5("word"))
    return I.cached(d, cache, F.md5, "word", "digest").select("doc_id", "digest")


def keep_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    new = e.filter("event_id % 2 = 0").select("user_id", "event_type").distinct().withColumn("pinned", F.col("user_id") % 9 == 0)
    prior = e.filter("event_id % 5 = 0").select("user_id", "event_type").distinct().withColumn("pinned", F.col("user_id") % 2 == 0)
    return I.pinned(new, prior, ("user_id", "event_type")).select("user_id", "event_type", "pinned")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "event_id", F.col("event_type").alias("type"), (F.floor((F.col("value") % 110) * 4) / 4).alias("progress"))
    return E.sequenced(e, "run_id", "event_id")


def replay_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.replayed(_log(spark, sf_dir), F.col("run_id") % 20).select("run_id", "seq", "type")


def last_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"))
    top = _log(spark, sf_dir).groupBy("run_id").agg(F.max("seq").alias("seq"))
    return users.join(top, "run_id", "left").select("run_id", F.coalesce("seq", F.lit(0)).alias("seq"))


def replay_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir).select("run_id", "seq", "type")
    stream = log.filter("seq % 3 != 0").withColumn("origin", F.lit("stream"))
    kept = log.filter("seq % 2 = 0 or seq % 3 = 0").withColumn("origin", F.lit("table"))
    return E.merged(stream, kept)


def running_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.running_progress(_log(spark, sf_dir)).select("run_id", "seq", F.round("progress", 1).alias("progress"))


def fold_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    f = E.folded(log.unionByName(log.filter("seq % 4 = 0")))
    return f.withColumn("progress", F.round("progress", 6))


def fold_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each run from the streaming fold over the log, written in files and read as a stream until it ends."""
    from weftline.operators.storage import shared_dir, stored

    log = stored(_log(spark, sf_dir).select("run_id", "seq", "type", "progress"), "log")
    at = f"{shared_dir(spark)}/fold-{log.inputFiles()[0].rstrip('/').split('/')[-2]}"
    stream = E.fold_stream(spark.readStream.schema(log.schema).parquet(log.inputFiles()[0].rsplit("/", 1)[0]))

    def save(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/{n}")

    query = stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{at}-progress").trigger(availableNow=True).start()
    query.awaitTermination()
    states = spark.read.parquet(f"{at}/*")
    return states.groupBy("run_id").agg(F.max_by(F.struct("seq", F.round("progress", 6).alias("progress"), "events", "last_type"), "seq").alias("s")).select("run_id", "s.*")


def text_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "role", F.col("turn").alias("seq"), "text")
    return E.text_of(c, ("conv_id", "role")).select("conv_id", "role", F.md5("text").alias("digest"), F.length("text").alias("n"))


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's turn with the next assistant's turn, if there is one."""
    c = table(spark, sf_dir, "conversations")
    after = F.lead(F.struct("role", "turn", "text")).over(W.partitionBy("conv_id").orderBy("turn"))
    u = c.withColumn("next", after).filter(F.col("role") == "user")
    reply = F.when(F.col("next.role") == "assistant", F.length("next.text"))
    return u.select("conv_id", "turn", F.length("text").alias("asked"), F.coalesce(reply, F.lit(0)).alias("answered"))


def session_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("m"))
    return c.select("conv_id", F.size("m").alias("messages"), F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"))


def turn_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns since the last user's turn, and one."""
    c = table(spark, sf_dir, "conversations")
    last = c.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("last"))
    n = F.sum(F.when((F.col("role") == "assistant") & (F.col("turn") > F.coalesce("last", F.lit(-1))), 1).otherwise(0))
    return c.join(last, "conv_id").groupBy("conv_id").agg((n + 1).alias("round"))


def list_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of ten orders, newest first."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return o.offset(20).limit(10).select("o_orderkey", "o_orderstatus")


def paged_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's turns in pages of three, longest first."""
    w = W.partitionBy("conv_id").orderBy(F.desc(F.length("text")), "turn")
    c = table(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(w) - 1)
    total = F.count("*").over(W.partitionBy("conv_id"))
    return c.select("conv_id", "turn", F.floor(F.col("n") / 3).alias("page"), (total > (F.floor(F.col("n") / 3) + 1) * 3).alias("has_more"))


def latest_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's newest finished order, with a cut of its priority text."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F")
    best = o.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderpriority"), F.struct("o_orderdate", "o_orderkey")).alias("b"))
    return best.select("o_custkey", "b.o_orderkey", F.substring("b.o_orderpriority", 3, 4).alias("cut"), (F.length("b.o_orderpriority") > 6).alias("truncated"))


def timeline_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("seq")))
    return _log(spark, sf_dir).withColumn("_n", last).filter("_n <= 20").select("run_id", "seq", "type")


def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that were open at start-up become failed."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.when(F.col("o_orderstatus").isin("O", "P"), "failed").otherwise("done").alias("status"))


def run_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with its lines in order, as one row."""
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("lines"))
    o = table(spark, sf_dir, "orders").join(l, "o_orderkey", "left")
    return o.select("o_orderkey", F.coalesce(F.size("lines"), F.lit(0)).alias("n"), F.coalesce(F.array_join(F.transform("lines", lambda x: x["l_partkey"].cast("string")), ","), F.lit("")).alias("parts"))


def url_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, id and page of links; only hosts under the given domains are resolved."""
    p = table(spark, sf_dir, "pages")
    host = F.lower(F.parse_url("url", F.lit("HOST")))
    known = host.rlike(r"(^|\.)example\.(com|org|net)$")
    return p.select("page_id", host.alias("host"), F.when(known, F.nullif(F.regexp_extract("url", r"/(\d+)(?:\.html|/)?(?:[?#]|$)", 1), F.lit(""))).alias("id"), F.parse_url("url", F.lit("QUERY"), F.lit("page")).alias("page"))


QUERIES = {
    f.__name__: f
    for f in (
        content_hash, registry_diff, ingest_stats, orphans, registry_upsert, delete_source, null_safe_not_in, sources_summary, cached_values, keep_pins,
        replay_since, last_seq, replay_merge, running_progress, fold_events, fold_stream, text_deltas, transcript, session_detail, turn_round,
        list_runs, paged_scan, latest_success, timeline_tail, reconcile, run_snapshot, url_ids,
    )
}

_C = "c as (select doc_id as chunk_id, source as source_file, lang as library, sha256(text || chr(0) || 'hash' || chr(0) || '64') as content_hash from documents)"
_R = f"""{_C}, r0 as (select chunk_id, source_file, library, case when chunk_id % 5 = 0 then md5(content_hash) else content_hash end as content_hash from c where chunk_id % 3 <> 0),
  r1 as (select * from r0 union all select chunk_id + 1000000000, source_file, library, content_hash from r0 where chunk_id % 4 = 0),
  r as (select chunk_id, case when chunk_id % 7 <> 0 then source_file end as source_file, library, content_hash from r1),
  d as (select c.*, case when r.content_hash is null then 'added' when r.content_hash <> c.content_hash then 'updated' else 'skipped' end as action from c left join r using (chunk_id))"""
_LOG = "log as (select user_id as run_id, event_type as type, floor((value % 110) * 4) / 4 as progress, row_number() over (partition by user_id order by event_id) as seq from events)"
_IN = "('src0', 'src1', 'src2')"
_FOLD = f"with {_LOG} select run_id, max(seq) as seq, round(least(100.0, greatest(0.0, max(progress))), 6) as progress, count(*) as events, arg_max(type, seq) as last_type from log group by 1"
ORACLE_SQL = {
    "content_hash": f"with {_C} select chunk_id, content_hash from c",
    "registry_diff": f"with {_R} select chunk_id, action from d",
    "ingest_stats": f"with {_R} select library, action, count(*) as n from d group by 1, 2",
    "orphans": f"with {_R} select chunk_id, source_file from r where source_file in {_IN} and chunk_id not in (select chunk_id from c)",
    "registry_upsert": f"with {_R}, n as (select * from d where action <> 'skipped') select chunk_id, source_file, content_hash from r where chunk_id not in (select chunk_id from n) union all select chunk_id, source_file, content_hash from n",
    "delete_source": f"with {_R} select chunk_id, library from r where source_file is distinct from 'src3'",
    "null_safe_not_in": f"with {_R} select library, count(*) as n from r where source_file is null or source_file not in {_IN} group by 1",
    "sources_summary": f"with {_R} select source_file, library, count(*) as n, max(chunk_id) as latest from r where source_file is not null and source_file not in {_IN} group by 1, 2",
    "cached_values": "select doc_id, md5(text) as digest from documents",
    "keep_pins": """with n as (select distinct user_id, event_type from events where event_id % 2 = 0), p as (select distinct user_id, event_type from events where event_id % 5 = 0 and user_id % 2 = 0)
      select user_id, event_type, user_id % 9 = 0 or (user_id, event_type) in (select (user_id, event_type) from p) as pinned from n""",
    "replay_since": f"with {_LOG} select run_id, seq, type from log where seq > run_id % 20",
    "last_seq": f"with {_LOG} select c_custkey as run_id, coalesce(max(seq), 0) as seq from customer left join log on run_id = c_custkey group by 1",
    "replay_merge": f"with {_LOG} select run_id, seq, type, case when seq % 3 <> 0 then 'stream' else 'table' end as origin from log",
    "running_progress": f"with {_LOG} select run_id, seq, round(least(100.0, round_even((max(progress) over (partition by run_id order by seq))::decimal(18, 6), 1)::double), 1) as progress from log",
    "fold_events": _FOLD,
    "fold_stream": _FOLD,
    "text_deltas": "select conv_id, role, md5(string_agg(text, '' order by turn)) as digest, sum(length(text))::bigint as n from conversations group by 1, 2",
    "transcript": """with c as (select *, lead(role) over w as r, lead(text) over w as t from conversations window w as (partition by conv_id order by turn))
      select conv_id, turn, length(text)::bigint as asked, (case when r = 'assistant' then length(t) else 0 end)::bigint as answered from c where role = 'user'""",
    "session_detail": "select conv_id, count(*)::bigint as messages, string_agg(role, ',' order by turn) as roles from conversations group by 1",
    "turn_round": """with l as (select conv_id, coalesce(max(turn) filter (role = 'user'), -1) as last from conversations group by 1)
      select conv_id, count(*) filter (role = 'assistant' and turn > last) + 1 as round from conversations join l using (conv_id) group by 1""",
    "list_runs": "select o_orderkey, o_orderstatus from orders order by o_orderdate desc, o_orderkey limit 10 offset 20",
    "paged_scan": """with n as (select conv_id, turn, row_number() over (partition by conv_id order by length(text) desc, turn) - 1 as n, count(*) over (partition by conv_id) as t from conversations)
      select conv_id, turn, n // 3 as page, t > (n // 3 + 1) * 3 as has_more from n""",
    "latest_success": """with b as (select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) as p from orders where o_orderstatus = 'F' group by 1)
      select o_custkey, o_orderkey, substr(p, 3, 4) as cut, length(p) > 6 as truncated from b""",
    "timeline_tail": f"with {_LOG} select run_id, seq, type from (select *, row_number() over (partition by run_id order by seq desc) as n from log) where n <= 20",
    "reconcile": "select o_orderkey, case when o_orderstatus in ('O', 'P') then 'failed' else 'done' end as status from orders",
    "run_snapshot": """select o_orderkey, count(l_partkey)::bigint as n, coalesce(string_agg(l_partkey::varchar, ',' order by l_linenumber, l_partkey), '') as parts from orders left join lineitem on l_orderkey = o_orderkey group by 1""",
    "url_ids": """with h as (select page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) as host from pages)
      select page_id, host, case when regexp_matches(host, '(^|\\.)example\\.(com|org|net)$') then nullif(regexp_extract(url, '/(\\d+)(?:\\.html|/)?(?:[?#]|$)', 1), '') end as id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') as page from h""",
}
