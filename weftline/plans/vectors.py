"""Queries of vector search, semantic dedup, embeddings, and graph reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.text import one_line
from weftline.functions.vectors import dot, hashed_embedding, norm, normalised
from weftline.operators import graph as G
from weftline.operators import vectors as V
from weftline.operators.index import VectorIndex
from weftline.plans.stored import scratch
from weftline.sources.tables import table

THRESHOLD = 0.45


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"), F.col("label").alias("library"))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("library"))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.top_k(_queries(spark, sf_dir).drop("library"), _chunks(spark, sf_dir).drop("library"), 8)


def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.top_k(_queries(spark, sf_dir), _chunks(spark, sf_dir), 8, library=True)


def _index(spark: SparkSession, sf_dir: str, rows: DataFrame) -> VectorIndex:
    return VectorIndex.build(rows, scratch(spark, "index"), 64)


def indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of a stored index in its exact mode: of a query's library all lists, and no other library's files."""
    q = _queries(spark, sf_dir)
    return _index(spark, sf_dir, _chunks(spark, sf_dir)).search(q, 8, library=True)


def indexed_topk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact search through all libraries of a stored index."""
    return _index(spark, sf_dir, _chunks(spark, sf_dir)).search(_queries(spark, sf_dir).drop("library"), 8)


def l2_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _chunks(spark, sf_dir).withColumn("u", normalised(F.transform("v", lambda x: x * 3)))
    return u.select("chunk_id", F.round(F.col("u")[0], 6).alias("first"), F.round(norm(F.col("u")), 6).alias("norm"))


def semantic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.similar_pairs(_chunks(spark, sf_dir), THRESHOLD, ("library",), "chunk_id").select("a", "b", F.round("similarity", 6).alias("similarity"))


def semantic_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chunks(spark, sf_dir).withColumn("likes", F.col("chunk_id") % 7)
    return V.semantic_dedup(rows, THRESHOLD, "likes", ("library",), "chunk_id").select("chunk_id", "representative", "is_representative")


def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns embedded by hashed n-grams: first components, norm, and the cosine to the next turn of the conversation."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", hashed_embedding(F.col("text"), 64).alias("v"))
    then = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("v").alias("w"))
    b = c.join(then, ["conv_id", "turn"], "left")
    return b.select("conv_id", "turn", *(F.round(F.col("v")[k], 6).alias(f"v{k}") for k in range(4)), F.round(norm(F.col("v")), 6).alias("norm"), F.round(dot(F.col("v"), F.col("w")), 6).alias("next"))


def fetch_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the hits of a search; hits without a text are dropped."""
    hits = vector_topk(spark, sf_dir)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), one_line(F.col("text"), 60).alias("snippet"))
    joined = hits.join(d, "chunk_id")
    return joined.withColumn("new_rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).select("query_id", "new_rank", "chunk_id", "snippet")


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_suppkey").alias("imagery")).distinct()


def _associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.col("s_suppkey").alias("imagery"), F.col("n_name").alias("emotion"), F.round(F.abs("s_acctbal") / 10000, 4).alias("weight"))


def chunks_by_emotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as emotions, suppliers as imagery, orders as chunks; each nation's 12 of largest weight."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("emotion"))
    found = G.chunks_by_emotion(_mentions(spark, sf_dir), _associations(spark, sf_dir), nations)
    rank = F.row_number().over(W.partitionBy("emotion").orderBy(F.desc("weight"), "chunk_id"))
    return found.withColumn("rank", rank).filter("rank <= 12")


def chunks_by_imagery(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mentions(spark, sf_dir).withColumn("rank", F.row_number().over(W.partitionBy("imagery").orderBy("chunk_id"))).filter("rank <= 12")
    return m.select("imagery", "chunk_id", "rank", F.lit(0.8).alias("weight"))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("concept"), F.col("p_brand").alias("imagery"))


def _concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_type").alias("query")).union(p.select(F.split("p_type", " ").getItem(0))).union(p.select(F.lit(" "))).distinct()


def imagery_by_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.imagery_by_concept(_evidence(spark, sf_dir), _concepts(spark, sf_dir))


def imagery_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.imagery_by_concept(_evidence(spark, sf_dir), _concepts(spark, sf_dir), fuzzy=True)


def derived_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    chunks = d.select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.array("lang", "source", "lang").alias("imagery"), F.array("source").alias("emotion"),
        F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("character"), F.col("source").alias("work"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("concept"),
    )
    return G.derived_edges(chunks)


def merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_returnflag").alias("relation"), F.col("l_suppkey").alias("target"), F.when(F.col("l_linenumber") > 1, F.col("l_discount")).alias("weight"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount").alias("pos"))
    return G.merged_edges(l, "pos").select("source", "relation", "target", F.round("weight", 6).alias("weight"))


QUERIES = {f.__name__: f for f in (vector_topk, vector_topk_filtered, indexed_topk, indexed_topk_all, l2_normalise, semantic_pairs, semantic_dedup, hash_embed, fetch_by_ids, chunks_by_emotion, chunks_by_imagery, imagery_by_concept, imagery_fuzzy, derived_edges, merged_edges)}

_TOP = """p as (select q.vec_id as query_id, c.vec_id as chunk_id, round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 9) as score from embeddings q, embeddings c where q.vec_id % 100 = 0 {}),
  t as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from p)"""
_PAIRS = f"p as (select a.vec_id as a, b.vec_id as b, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as s from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id), e as (select a, b, s from p where s > {THRESHOLD})"
_FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_CONCEPTS = "c as (select distinct p_type as query from part union select distinct string_split(p_type, ' ')[1] from part)"
ORACLE_SQL = {
    "vector_topk": f"with {_TOP.format('')} select query_id, rank, chunk_id, score from t where rank <= 8",
    "vector_topk_filtered": f"with {_TOP.format('and q.label = c.label')} select query_id, rank, chunk_id, score from t where rank <= 8",
    "indexed_topk": f"with {_TOP.format('and q.label = c.label')} select query_id, rank, chunk_id, score from t where rank <= 8",
    "indexed_topk_all": f"with {_TOP.format('')} select query_id, rank, chunk_id, score from t where rank <= 8",
    "l2_normalise": "select vec_id as chunk_id, round(embedding[1]::double / sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as first, 1.0::double as norm from embeddings",
    "semantic_pairs": f"with {_PAIRS} select a, b, round(s, 6) as similarity from e",
    "semantic_dedup": f"""with recursive {_PAIRS}, g as (select a, b from e union select b, a from e), r as (select vec_id as n, vec_id as m from embeddings union select r.n, g.b from r join g on r.m = g.a),
      l as (select n, min(m) as c from r group by 1), b as (select c, arg_min(n, (-(n % 7), n)) as representative from l group by 1)
      select n as chunk_id, representative, n = representative as is_representative from l join b using (c)""",
    "fetch_by_ids": f"""with {_TOP.format('')} select query_id, row_number() over (partition by query_id order by rank) as new_rank, chunk_id, case when length({_FLAT}) > 60 then left({_FLAT}, 60) || '…' else {_FLAT} end as snippet
      from t join documents on doc_id = chunk_id where rank <= 8""",
    "chunks_by_emotion": """with m as (select distinct l_orderkey as chunk_id, l_suppkey from lineitem), w as (select n_name as emotion, chunk_id, max(round(abs(s_acctbal) / 10000, 4)) as weight from m join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1, 2)
      select * from (select *, row_number() over (partition by emotion order by weight desc, chunk_id) as rank from w) where rank <= 12""",
    "chunks_by_imagery": "select imagery, chunk_id, rank, 0.8::double as weight from (select l_suppkey as imagery, l_orderkey as chunk_id, row_number() over (partition by l_suppkey order by l_orderkey) as rank from (select distinct l_suppkey, l_orderkey from lineitem)) where rank <= 12",
    "imagery_by_concept": f"with {_CONCEPTS} select query, p_brand as imagery, count(*) as strength from part join c on p_type = query group by 1, 2",
    "imagery_fuzzy": f"with {_CONCEPTS} select query, p_brand as imagery, count(*) as strength from part join c on contains(p_type, query) or contains(query, p_type) group by 1, 2",
    "derived_edges": """with e as (select distinct doc_id::varchar as src, 'MENTIONS_IMAGERY' as relation, unnest([lang, source]) as dst from documents union select doc_id::varchar, 'EVOKES_EMOTION', source from documents
      union select lang, 'FEATURES_CHARACTER', doc_id::varchar from documents where doc_id % 2 = 0 union select source, 'HAS_CHUNK', doc_id::varchar from documents union select lang, 'HAS_CONCEPT', doc_id::varchar from documents where doc_id % 3 = 0)
      select src, relation, dst from e where src is not null and dst is not null""",
    "merged_edges": "select l_partkey as source, l_returnflag as relation, l_suppkey as target, round(arg_max(case when l_linenumber > 1 then l_discount else 1.0 end, (l_orderkey, l_linenumber, l_extendedprice, l_discount)), 6) as weight from lineitem group by 1, 2, 3",
}
