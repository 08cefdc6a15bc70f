"""Queries from chosen chunks to evidence, and of what a run shows without a model's answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import evidence as E
from weftline.sources.tables import table

EMOTIONS = ("click", "error", "view")


def _text(c: str) -> Column:
    return F.array_join(c, ",").alias(c)


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' event types as clusters of a run: their tags, keywords and sizes from the events themselves."""
    e = table(spark, sf_dir, "events")
    g = e.groupBy(F.col("user_id").alias("run_id"), F.col("event_type").alias("cluster_key")).agg(F.count("*").alias("size"), F.min("event_id").alias("order_index"), F.max("event_id").alias("top"))
    key = F.when(F.col("cluster_key") == "view", "tail").otherwise(F.col("cluster_key"))
    words = F.when(F.col("top") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit(""), F.col("cluster_key"), (F.col("top") % 7).cast("string"), F.lit("more")))
    emotion = F.array(F.col("cluster_key"), F.lit("none of these"), F.lit("view"))
    return g.withColumns({"is_noise": F.col("cluster_key") == "error", "keywords": words, "emotion_tags": emotion, "topic_tags": F.array((F.col("top") % 5).cast("string")), "need_tags": F.array("cluster_key"), "cluster_key": key})


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answers for two of three clusters, and one for a cluster that no run has."""
    c = _clusters(spark, sf_dir).filter("size % 3 != 0")
    label = F.when(F.col("size") % 2 == 0, F.concat(F.lit(" L"), "cluster_key")).otherwise(" ")
    known = c.select("run_id", "cluster_key", label.alias("label"), F.concat(F.lit("S "), F.col("size").cast("string")).alias("summary"), F.array(F.lit("view"), "cluster_key", F.lit("odd"), F.lit("view")).alias("emotion"), F.array(F.lit("a"), F.lit("b<"), F.lit("c"), F.lit("d"), F.lit("e")).alias("topic"), F.array("cluster_key", F.lit("x"), F.lit("y")).alias("need"))
    return known.unionByName(known.withColumn("cluster_key", F.lit("cluster_0")))


def cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = E.labelled(_clusters(spark, sf_dir), _answers(spark, sf_dir), EMOTIONS)
    return l.select("run_id", "cluster_key", "label", "summary", "label_source", _text("emotion_tags"), _text("topic_tags"), _text("need_tags"))


def filled_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _clusters(spark, sf_dir).withColumn("tags", F.col("emotion_tags"))
    f = E.filled_tags(c, _answers(spark, sf_dir).withColumn("tags", F.col("topic")))
    return f.select("run_id", "cluster_key", _text("tags"))


def raw_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), (F.col("l_partkey") % 3).alias("representative"))
    return E.raw_counts(m, "representative")


def fallback_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and their profiles by rule; runs without clusters have an empty one."""
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"))
    p = E.with_empty_profile(runs, E.fallback_profile(_clusters(spark, sf_dir), EMOTIONS))
    return p.select("run_id", _text("emotion"), _text("topic"), _text("need"), "core_tension", "model")


def fallback_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _clusters(spark, sf_dir).withColumns({"summary": F.when(F.col("size") % 2 == 0, F.concat(F.lit("S"), F.col("size").cast("string"))).otherwise(" "), "label": F.when(F.col("size") % 5 != 0, F.col("cluster_key"))})
    return E.fallback_steps(c)


def merged_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    first = p.select(F.col("p_partkey").alias("chunk_id"), F.col("p_brand").alias("work"), F.col("p_type").alias("author"))
    second = p.filter("p_partkey % 3 != 0").select(F.col("p_partkey").alias("chunk_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("work"), F.lit(None).cast("string").alias("author"))
    return E.merged_payload(first, second, "chunk_id", ("work", "author"))


def graph_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the graph with the whole text of documents, where these are known."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").alias("chunk_id"), F.substring("text", 1, 60).alias("snippet"))
    texts = d.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("chunk_id"), "text")
    return E.with_text(rows, texts).select("chunk_id", F.length("text").alias("n"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as hits of a run's queries."""
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return l.select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("chunk_id"), F.col("l_linenumber").alias("rank"), F.col("l_suppkey").alias("query_id"), F.when(F.col("l_returnflag") == "R", "graph").otherwise("vector").alias("path"), F.when(F.col("l_linestatus") == "F", "psychology").otherwise("poetry").alias("library"), F.when(F.col("p_size") > 5, F.col("p_brand")).otherwise(" ").alias("concept"))


def top_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.top_concepts(_hits(spark, sf_dir))


def graph_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts of runs through types of parts to the parts that have them."""
    p = table(spark, sf_dir, "part")
    imagery = p.groupBy(F.col("p_brand").alias("concept"), F.col("p_type").alias("imagery")).agg(F.count("*").alias("strength"))
    mentions = p.select(F.col("p_type").alias("imagery"), F.col("p_partkey").alias("chunk_id"), F.col("p_retailprice").alias("weight"))
    concepts = E.top_concepts(_hits(spark, sf_dir))
    return E.graph_pass(concepts, imagery, mentions)


def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of an order as its evidence; parts without a payload give none."""
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("chunk_id")).agg(F.min("l_linenumber").alias("n"))
    selected = l.select("run_id", "chunk_id", (F.col("n") * 1_000_000 + F.col("chunk_id")).alias("place"), F.lit("poetry").alias("library"), F.col("n").alias("rank_in_library"), F.when(F.col("n") > 2, F.col("n")).alias("quota_slot"))
    hits = l.filter("chunk_id % 5 != 0").select("run_id", "chunk_id", F.col("n").alias("query_id"), F.when(F.col("chunk_id") % 7 == 0, "graph").otherwise("vector").alias("path"), F.when(F.col("chunk_id") % 3 != 0, (F.col("chunk_id") % 100) / 100).alias("vector_score"), F.when(F.col("n") % 2 == 0, "c1").alias("cluster_key"), F.when(F.col("chunk_id") % 11 == 0, "the sea").alias("concept_bridge"))
    scores = l.filter("chunk_id % 4 != 0").select("run_id", "chunk_id", (1 / (F.col("n") + 60)).alias("score"))
    p = table(spark, sf_dir, "part").filter("p_partkey % 13 != 0")
    payload = p.select(F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias("text"), F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).alias("work"), F.when(F.col("p_size") % 4 == 0, F.lit("T")).alias("title"), F.lit(" ch ").alias("chapter"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("author"), F.when(F.col("p_size") % 5 == 0, F.lit("src")).alias("source"), F.lit("").alias("origin"), F.when(F.col("p_size") % 7 != 0, F.array("p_type", "p_brand")).otherwise(F.array().cast("array<string>")).alias("imagery"))
    return E.projected(selected, hits, scores, payload)


def evidence_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    e = d.select(F.when(F.col("doc_id") % 9 != 0, F.col("doc_id")).alias("chunk_id"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("kind"), F.col("source").alias("title"), F.lit(None).cast("string").alias("source"), F.col("lang").alias("author"), "text")
    return E.brief(e)


def evidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "run_id")
    return E.counts_by(l, "l_returnflag", ("A", "N", "R"))


def source_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    chosen = F.when(F.col("o_orderkey") % 3 == 0, "text").when(F.col("o_orderkey") % 3 == 1, "nonsense")
    external = F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise("")
    return o.select("o_orderkey", E.source_kind({"video": "", "text": ""}, chosen, external).alias("kind"))


QUERIES = {
    f.__name__: f
    for f in (
        cluster_labels, filled_tags, raw_counts, fallback_profile, fallback_steps, merged_payload, graph_texts, top_concepts, graph_pass, evidence_rows, evidence_brief, evidence_counts, source_kind,
    )
}

_CLUSTER = """g as (select user_id as run_id, event_type as t, count(*) as size, min(event_id) as order_index, max(event_id) as top from events group by 1, 2),
  c as (select *, case when t = 'view' then 'tail' else t end as cluster_key, t = 'error' as is_noise from g)"""
_HITS = """h as (select l_orderkey as run_id, l_linenumber as rank, l_suppkey as query_id, p_brand as concept from lineitem join part on l_partkey = p_partkey where l_returnflag <> 'R' and l_linestatus = 'F' and p_size > 5),
  b as (select run_id, concept, min((rank, query_id)) as h from h group by 1, 2), top as (select run_id, row_number() over (partition by run_id order by h, concept) as place, concept from b qualify place <= 2)"""
_FALLBACK = "case when is_noise then '边缘声音' when cluster_key = 'tail' then '其他·长尾' when top % 3 <> 0 then t || '·' || (top % 7) else '未命名的一组（' || size || ' 条）' end"
ORACLE_SQL = {
    "cluster_labels": f"""with {_CLUSTER} select run_id, cluster_key, case when size % 3 <> 0 and size % 2 = 0 then 'L' || cluster_key else {_FALLBACK} end as label, case when size % 3 <> 0 then 'S ' || size end as summary,
      case when size % 3 <> 0 then 'model' else 'fallback' end as label_source,
      case when size % 3 = 0 then t || ',none of these,view' when cluster_key in ('click', 'error') then 'view,' || cluster_key else 'view' end as emotion_tags,
      case when size % 3 = 0 then (top % 5)::varchar else 'a,c,d' end as topic_tags, case when size % 3 = 0 then t else cluster_key || ',x' end as need_tags from c""",
    "filled_tags": f"with {_CLUSTER} select run_id, cluster_key, case when size % 3 <> 0 then 'a,b<,c,d,e' else t || ',none of these,view' end as tags from c",
    "raw_counts": "select l_orderkey as run_id, l_partkey % 3 as representative, count(*) as raw_count from lineitem group by 1, 2",
    "fallback_profile": f"""with {_CLUSTER}, u as (select run_id, x, min(order_index * 10 + k) as p from (select run_id, order_index, unnest([t, 'view']) as x, unnest([1, 2]) as k from c) where x in ('click', 'error', 'view') group by 1, 2),
      e as (select run_id, array_to_string(list(x order by p)[1:3], ',') as emotion from u group by 1),
      o as (select run_id, array_to_string(list(x order by p)[1:3], ',') as topic from (select run_id, (top % 5)::varchar as x, min(order_index) as p from c group by 1, 2) group by 1),
      n as (select run_id, array_to_string(list(t order by order_index)[1:2], ',') as need from c group by 1)
      select c_custkey as run_id, coalesce(emotion, '') as emotion, coalesce(topic, '') as topic, coalesce(need, '') as need, null::varchar as core_tension, case when n.run_id is null then 'none' else 'fallback' end as model
      from customer left join n on n.run_id = c_custkey left join e on e.run_id = c_custkey left join o on o.run_id = c_custkey""",
    "fallback_steps": f"""with {_CLUSTER}, p as (select *, case when size % 2 = 0 then 'S' || size when size % 5 <> 0 then cluster_key end as phenomenon from c where not is_noise)
      select run_id, row_number() over (partition by run_id order by order_index, cluster_key) as step_index, phenomenon from p where phenomenon is not null qualify step_index <= 5""",
    "merged_payload": "select p_partkey as chunk_id, case when p_size % 2 = 0 then p_name else p_brand end as work, p_type as author from part where p_partkey % 3 <> 0",
    "graph_texts": "select doc_id as chunk_id, length(case when doc_id % 2 = 0 then text else left(text, 60) end)::bigint as n from documents",
    "top_concepts": f"with {_HITS} select run_id, place, concept from top",
    "graph_pass": f"""with {_HITS}, i as (select p_brand as concept, p_type as imagery, row_number() over (partition by p_brand order by count(*) desc, p_type) as i from part group by 1, 2 qualify i <= 3),
      m as (select p_type as imagery, p_partkey as chunk_id, row_number() over (partition by p_type order by p_retailprice desc, p_partkey) as m from part qualify m <= 6)
      select run_id, concept, chunk_id, row_number() over (partition by run_id, concept order by p) as place from (select run_id, concept, chunk_id, min((i, m)) as p from top join i using (concept) join m using (imagery) group by 1, 2, 3)""",
    "evidence_rows": """with l as (select l_orderkey as run_id, l_partkey as k, min(l_linenumber) as n from lineitem group by 1, 2),
      p as (select p_partkey as k, p_name, case when p_size % 3 = 0 then p_brand when p_size % 4 = 0 then 'T' end as w, case when p_size % 2 = 0 then p_type end as author, case when p_size % 5 = 0 then 'src' end as source, case when p_size % 7 <> 0 then p_type || '、' || p_brand else '' end as im from part where p_partkey % 13 <> 0),
      j as (select *, row_number() over (partition by run_id order by n * 1000000 + k) as rank, k % 5 <> 0 as hit from l join p using (k))
      select run_id, rank, 'e' || rank as ev_id, k as chunk_id, 'poetry' as library, coalesce(w, 'ch') as title, case when author is not null and w is not null then author || '·' || w else coalesce(w, source) end as source, left(p_name, 400) as text,
        case when k % 4 <> 0 then round(1 / (n + 60.0)::double, 6) else 0.0 end as score, case when hit and k % 7 = 0 then 'graph' else 'vector' end as path,
        case when hit and k % 11 = 0 then '概念桥：the sea → 意象' when hit and k % 7 = 0 then '图谱：情绪 → 意象 → 语料' when not hit or k % 3 = 0 then '向量检索'
          else '向量相似 0.' || lpad((k % 100)::varchar, 2, '0') || case when im <> '' then '｜意象：' || im else '' end end as match_reason,
        case when hit and n % 2 = 0 then 'c1' end as cluster_key, n + 1 as rank_in_library, case when n > 2 then n end as quota_slot from j""",
    "evidence_brief": "select doc_id as id, case when doc_id % 2 = 0 then lang else '' end as kind, source as title, null::varchar as source, lang as author, rtrim(left(trim(coalesce(text, '')), 400)) as text from documents where doc_id % 9 <> 0",
    "evidence_counts": "select l_orderkey as run_id, count(*) filter (l_returnflag = 'A') as A, count(*) filter (l_returnflag = 'N') as N, count(*) filter (l_returnflag = 'R') as R from lineitem group by 1",
    "source_kind": "select o_orderkey, case when o_orderkey % 3 = 0 then 'text' when o_custkey % 2 = 0 then 'video' else 'text' end as kind from orders",
}
