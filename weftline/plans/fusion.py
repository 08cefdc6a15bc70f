"""Queries of fusion, quotas, query building, evidence, confidence and weighted distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators import fusion as R
from weftline.sources.tables import table


def _rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts ranked by quantity for each return flag, as rankings of one library for each line status."""
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("library"), F.col("l_returnflag").alias("ranking"), F.col("l_partkey").alias("chunk_id")).agg(F.sum("l_quantity").alias("q"))
    rank = F.row_number().over(W.partitionBy("library", "ranking").orderBy(F.desc("q"), "chunk_id"))
    return sums.withColumn("rank", rank).select("library", "ranking", "chunk_id", "rank")


def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fused(_rankings(spark, sf_dir), ("library",)).select("library", "chunk_id", "score", "best", "position")


def best_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _rankings(spark, sf_dir).select("chunk_id", "rank", F.concat(F.lit("q"), "ranking").alias("query_id"))
    return R.best_hits(hits)


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each nation as candidates of three libraries, by price."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    library = F.when(F.col("o_orderstatus") == "F", "psychology").when(F.col("o_orderstatus") == "O", "literature").otherwise("poetry")
    rows = o.select(F.col("c_nationkey").alias("run_id"), library.alias("library"), F.col("o_orderkey").alias("chunk_id"), "o_totalprice")
    return rows.withColumn("position", F.row_number().over(W.partitionBy("run_id", "library").orderBy(F.desc("o_totalprice"), "chunk_id"))).drop("o_totalprice")


def quota_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _ranked(spark, sf_dir).filter(~((F.col("library") == "psychology") & (F.col("position") > 1 + F.col("run_id") % 4)))
    return R.allocated(cut, R.QUOTAS["quick"], 8, ("run_id",)).select("run_id", "library", "chunk_id", "rank_in_library", "quota_slot")


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types of a user group as clusters: size is the number of events, tags come from the type and the users."""
    e = table(spark, sf_dir, "events").withColumn("run_id", F.col("user_id") % 10)
    c = e.groupBy("run_id", F.col("event_type").alias("cluster_key")).agg(F.count("*").alias("size"), F.min("event_id").alias("first"))
    order = F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("size"), "first")) - 1
    return c.select(
        "run_id", "cluster_key", "size", order.alias("order_index"), (F.col("size") % 7 == 0).alias("is_noise"), F.upper("cluster_key").alias("label"),
        F.array("cluster_key", F.concat(F.lit("topic "), F.col("size") % 3)).alias("topic_tags"), F.array(F.lit("x"), F.concat(F.lit("need"), F.col("size") % 2)).alias("need_tags"),
        F.array(F.concat(F.lit("mood"), F.col("size") % 4), F.concat(F.lit("mood"), F.col("size") % 5)).alias("emotion_tags"), F.array(F.concat(F.lit("kw "), "cluster_key")).alias("keywords"),
    )


def build_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _clusters(spark, sf_dir)
    profile = c.groupBy("run_id").agg(F.concat(F.lit("tension "), F.max("label")).alias("core_tension"), F.lit("summary").alias("summary")).withColumn("emotions", F.array(F.lit("mood0"), F.lit("mood1"))).withColumn("needs", F.array(F.lit("need0")))
    return R.built_queries(c, profile, "standard").select("run_id", "id", "library", "text", "cluster_key", "weight")


def graph_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.graph_queries(_clusters(spark, sf_dir), 3).select("run_id", "n", "text", "cluster_key", F.round("weight", 6).alias("weight"))


def weighted_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _clusters(spark, sf_dir)
    tags = c.select("run_id", "cluster_key", F.col("order_index").alias("pos"), F.explode(F.create_map(F.lit("emotion"), "emotion_tags", F.lit("topic"), "topic_tags", F.lit("need"), "need_tags")).alias("dimension", "labels"))
    return R.distribution(tags, c).select("run_id", "dimension", "label", "value", "cluster_key", "rank")


def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's line parts as cited evidence, its suppliers' nations as allusions."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 50).alias("cited"), F.collect_set(F.col("l_suppkey") % 3).alias("allu"))
    psychology = F.when(F.col("l_orderkey") % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("l_orderkey") % 40))
    pool = F.when(F.col("l_orderkey") % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.lit(0).cast("bigint")))
    evidence = F.slice("cited", 1, (F.col("l_orderkey") % 2 + 1).cast("int"))
    said = F.when(F.col("l_orderkey") % 7 != 0, "because").otherwise(" ")
    one = F.when(F.size("cited") == 1, evidence).otherwise(F.col("cited"))
    allusions = F.filter("allu", lambda x: x == 0)
    return l.select("l_orderkey", R.confidence(one, allusions, said, psychology, pool).alias("confidence"))


QUERIES = {f.__name__: f for f in (rrf_fuse, best_hit, quota_backfill, build_queries, graph_queries, weighted_distribution, confidence)}

_RANKINGS = """r as (select * from (select l_linestatus as library, l_returnflag as ranking, l_partkey as chunk_id,
  row_number() over (partition by l_linestatus, l_returnflag order by sum(l_quantity) desc, l_partkey) as rank from lineitem group by 1, 2, 3))"""
_CLUSTERS = """c0 as (select user_id % 10 as run_id, event_type as cluster_key, count(*) as size, min(event_id) as first from events group by 1, 2),
  c as (select *, row_number() over (partition by run_id order by size desc, first) - 1 as order_index, size % 7 = 0 as is_noise, upper(cluster_key) as label,
    [cluster_key, 'topic ' || (size % 3)] as topic_tags, ['x', 'need' || (size % 2)] as need_tags, ['mood' || (size % 4), 'mood' || (size % 5)] as emotion_tags, ['kw ' || cluster_key] as keywords from c0),
  t as (select *, 2.0::double * size / max(size) over (partition by run_id) as w, row_number() over (partition by run_id order by size desc, order_index) as tn from c where not is_noise and size >= 3)"""
ORACLE_SQL = {
    "rrf_fuse": f"""with {_RANKINGS}, s as (select library, chunk_id, round(sum(1.0::double / (60 + rank)), 12) as s, min(rank) as best from r group by 1, 2)
      select library, chunk_id, round(s, 6) as score, best, row_number() over (partition by library order by s desc, best, chunk_id) as position from s""",
    "best_hit": f"with {_RANKINGS} select chunk_id, min(rank) as rank, arg_min('q' || ranking, (rank, 'q' || ranking)) as query_id from r group by 1",
    "quota_backfill": """with o as (select c_nationkey as run_id, case o_orderstatus when 'F' then 'psychology' when 'O' then 'literature' else 'poetry' end as library, o_orderkey as chunk_id, o_totalprice from orders join customer on o_custkey = c_custkey),
      p as (select *, row_number() over (partition by run_id, library order by o_totalprice desc, chunk_id) as pos from o),
      q as (select *, case library when 'psychology' then 3 when 'literature' then 2 else 1 end as q, case library when 'psychology' then 1 when 'literature' then 2 else 3 end as o from p where not (library = 'psychology' and pos > 1 + run_id % 4)),
      n as (select *, pos <= q as base, row_number() over (partition by run_id order by (pos <= q) desc, case when pos <= q then 0 else pos - q end, o, pos) as n from q),
      f as (select *, row_number() over (partition by run_id order by o, pos) as f from n where base or n <= 8)
      select run_id::bigint as run_id, library, chunk_id, pos - 1 as rank_in_library, case when base then pos - 1 end as quota_slot from f where f <= 8""",
    "build_queries": f"""with {_CLUSTERS},
      raw as (select run_id, label || ' ' || array_to_string(topic_tags, ' ') || ' ' || array_to_string(list_filter(need_tags, lambda x: length(x) > 1), ' ') as text, 'psychology' as library, cluster_key, round(w, 3) as weight, tn * 2 as seq from t
        union all select run_id, array_to_string(list_distinct_in_order, ' ') || ' ' || keywords[1], 'literature', cluster_key, round(w * 0.9, 3), tn * 2 + 1 from (select *, case when emotion_tags[1] = emotion_tags[2] then emotion_tags[1:1] else emotion_tags end as list_distinct_in_order from t)
        union all select run_id, 'tension ' || max(label) || ' summary', 'psychology', null, 3.0, 1000000000 from c group by 1
        union all select distinct run_id, 'mood0 mood1 need0', 'poetry', null, 2.5, 1000000001 from c),
      u as (select *, row_number() over (partition by run_id, library, text order by seq) as f from raw),
      n as (select *, row_number() over (partition by run_id order by weight desc, coalesce(cluster_key, ''), text) as n from u where f = 1)
      select run_id, 'q' || n as id, library, text, cluster_key, weight from n where n <= 8""",
    "graph_queries": f"""with {_CLUSTERS}, e as (select run_id, cluster_key, w, tn, unnest(emotion_tags) as text, generate_subscripts(emotion_tags, 1) as p from t),
      f as (select *, row_number() over (partition by run_id, text order by tn, p) as f from e), n as (select *, row_number() over (partition by run_id order by tn, p) as n from f where f = 1)
      select run_id, n, text, cluster_key, round(w * 0.8, 6) as weight from n where n <= 3""",
    "weighted_distribution": f"""with {_CLUSTERS}, e as (select distinct run_id, cluster_key, size, order_index, 'emotion' as dimension, unnest(emotion_tags) as label from c
        union all select distinct run_id, cluster_key, size, order_index, 'topic', unnest(topic_tags) from c union all select distinct run_id, cluster_key, size, order_index, 'need', unnest(need_tags) from c),
      s as (select run_id, dimension, label, sum(size)::bigint as value, arg_min(cluster_key, order_index) as cluster_key from e group by 1, 2, 3)
      select * from (select *, row_number() over (partition by run_id, dimension order by value desc, label) as rank from s) where rank <= 6""",
    "confidence": """with l as (select l_orderkey, list(distinct l_partkey % 50) as cited, list(distinct l_suppkey % 3) as allu from lineitem group by 1),
      x as (select l_orderkey, least(1.0, len(cited) / 2.0) as s,
        case when l_orderkey % 3 <> 0 and list_min(cited) <= l_orderkey % 40 and l_orderkey % 7 <> 0 then 1.0 when l_orderkey % 3 = 0 then 0.5 else 0.0 end as m,
        case when list_contains(allu, 0) then 1.0 when l_orderkey % 5 = 0 then 0.5 else 0.0 end as a from l)
      select l_orderkey, round_even((0.55 * s + 0.30 * m + 0.15 * a)::decimal(18, 9), 3)::double as confidence from x""",
}
