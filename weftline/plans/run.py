"""An analysis run as one chain of tables: comments, clusters, profile, queries, evidence.

All tables hold any number of runs, told apart by run_id; steps are lazy but for the clusters, which are
written once because four later steps read them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.lexical import lexicon_tags
from weftline.functions.vectors import hashed_embedding
from weftline.operators import clustering, comments, evidence, fusion, graph, keyphrases, vectors
from weftline.operators.storage import stored
from weftline.plans.lexical import LEXICON
from weftline.sources.tables import table

DIM, QUERY_TOP, MOST_GRAPH_QUERIES = 64, 8, 3
#: Neighbouring conversations of one run, so that more rows make more runs and no larger ones.
RUN_CONVERSATIONS = 10


@dataclass
class Run:
    comments: DataFrame
    stats: DataFrame
    clusters: DataFrame
    queries: DataFrame
    evidence: DataFrame


def analyse(raw: DataFrame, chunks: DataFrame, depth: str = "standard", mentions: DataFrame | None = None, associations: DataFrame | None = None) -> Run:
    """raw has (run_id, id, text, likes), chunks (chunk_id, library, text, v) and what is known of where they are from.

    With mentions (imagery, chunk_id) and associations (emotion, imagery, weight) the graph is read too.
    """
    told = comments.marked_duplicates(comments.flagged(raw), "likes", "id", ("run_id",))
    usable = comments.clusterable(told).select("run_id", "id", "body", "likes", hashed_embedding(F.col("body"), DIM).alias("v"))
    labels = clustering.density_labels(usable, "run_id", likes="likes")
    member = stored(usable.drop("v").join(labels.select("run_id", "id", "label", "is_survivor"), ["run_id", "id"]), "members")
    rows = clustering.cluster_rows(member.withColumnRenamed("body", "text"))
    words = keyphrases.keyphrases_across(member.filter("label >= 0").withColumn("g", F.concat_ws("/", "run_id", "label")), "g", "id", "body")
    named = rows.withColumn("g", F.concat_ws("/", "run_id", F.regexp_replace("cluster_key", "^c", ""))).join(words, "g", "left").drop("g")
    empty = F.array().cast("array<string>")
    clusters = stored(named.withColumn("keywords", F.coalesce("phrases", empty)).drop("phrases").withColumn("label", F.array_join(F.slice("keywords", 1, 2), " ")).withColumns({"topic_tags": F.slice("keywords", 1, 3), "need_tags": empty, "emotion_tags": F.slice("keywords", 1, 1)}), "clusters")
    tags = clusters.select("run_id", "cluster_key", F.col("order_index").alias("pos"), F.lit("emotion").alias("dimension"), F.col("emotion_tags").alias("labels"))
    shares = fusion.distribution(tags, clusters)
    profile = shares.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias("emotions")).withColumns({"core_tension": F.array_join(F.slice("emotions", 1, 2), " / "), "summary": F.lit(None).cast("string"), "needs": empty})
    queries = stored(fusion.built_queries(clusters, profile, depth).withColumn("query_id", F.concat_ws("-", "run_id", "id")), "queries")
    hits = vectors.top_k(queries.select("query_id", "library", hashed_embedding(F.col("text"), DIM).alias("q")), chunks.select("chunk_id", "library", "v"), QUERY_TOP, library=True)
    found = hits.join(queries.select("query_id", "run_id", "library", "cluster_key"), "query_id").select("run_id", "library", "query_id", "chunk_id", "rank", F.col("score").alias("vector_score"), "cluster_key", F.lit("vector").alias("path"))
    if mentions is not None:
        found = found.unionByName(graph_hits(clusters, chunks, mentions, associations))
    found = stored(found, "hits")
    ranked = fusion.fused(found, ("run_id", "library"), ranking="query_id")
    quota = fusion.QUOTAS[depth]
    picked = fusion.allocated(ranked, quota, sum(quota), ("run_id",))
    place = F.row_number().over(W.partitionBy("run_id").orderBy(fusion.library_order(F.col("library")), "position"))
    best = found.groupBy("run_id", "chunk_id").agg(F.min(F.struct("rank", "query_id", "path", "vector_score", "cluster_key")).alias("h"))
    best = best.select("run_id", "chunk_id", "h.query_id", "h.path", F.when(F.col("h.path") == "vector", F.col("h.vector_score")).alias("vector_score"), "h.cluster_key", F.lit(None).cast("string").alias("concept_bridge"))
    names = ("work", "title", "chapter", "author", "source", "origin")
    payload = chunks.select("chunk_id", "text", *(F.col(c) if c in chunks.columns else F.lit(None).cast("string").alias(c) for c in names), F.col("imagery") if "imagery" in chunks.columns else empty.alias("imagery"))
    selected = picked.select("run_id", "chunk_id", place.alias("place"), "library", "rank_in_library", "quota_slot")
    return Run(told, comments.tally(told, ("run_id",)), clusters, queries, evidence.projected(selected, best, picked.select("run_id", "chunk_id", "score"), payload))


def graph_hits(clusters: DataFrame, chunks: DataFrame, mentions: DataFrame, associations: DataFrame) -> DataFrame:
    """Hits of the themes' emotions: through the imagery associated with them to the chunks that mention it."""
    asked = fusion.graph_queries(clusters, MOST_GRAPH_QUERIES).select("run_id", F.col("text").alias("emotion"), "cluster_key", F.concat_ws("-g", "run_id", "n").alias("query_id"))
    rows = graph.chunks_by_emotion(mentions, associations, asked.select("emotion").distinct())
    rank = F.row_number().over(W.partitionBy("emotion").orderBy(F.desc("weight"), "chunk_id"))
    some = rows.withColumn("rank", rank).filter(F.col("rank") <= evidence.GRAPH_TOP).join(chunks.select("chunk_id", "library"), "chunk_id")
    return asked.join(some, "emotion").select("run_id", "library", "query_id", "chunk_id", "rank", F.lit(None).cast("double").alias("vector_score"), "cluster_key", F.lit("graph").alias("path"))


def analysis_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations, RUN_CONVERSATIONS to a run, as runs of comments, benchmark passages as chunks: the evidence of every run."""
    c = table(spark, sf_dir, "conversations")
    raw = c.select(F.floor(F.col("conv_id") / RUN_CONVERSATIONS).alias("run_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", F.length("text").alias("likes"))
    b = table(spark, sf_dir, "benchmark")
    chunks = b.select(F.col("item_id").alias("chunk_id"), F.element_at(F.array(*(F.lit(x) for x in fusion.LIBRARIES)), (F.col("item_id") % 3 + 1).cast("int")).alias("library"), "text", hashed_embedding(F.col("text"), DIM).alias("v"))
    chunks = stored(chunks.withColumn("imagery", lexicon_tags(F.col("text"), LEXICON, 3)).withColumn("source", F.lit("benchmark")), "chunks")
    mentions = chunks.select("chunk_id", F.explode("imagery").alias("imagery"))
    # words that turns use often, as emotions; the imagery whose name they hold is theirs
    words = c.select(F.explode(F.array_distinct(F.flatten(F.transform(F.split("text", " "), lambda w: F.transform(F.sequence(F.lit(2), F.least(F.lit(4), F.greatest(F.lit(2), F.length(w)))), lambda n: F.substring(w, 1, n)))))).alias("emotion"))
    often = words.filter("emotion != ''").groupBy("emotion").agg(F.count("*").alias("n"))
    held = F.filter(F.array(*(F.lit(x) for x in LEXICON)), lambda x: F.contains(x, F.substring("emotion", 1, 2)))
    associations = often.select("emotion", F.explode(held).alias("imagery"), F.log1p("n").alias("weight"))
    return analyse(raw, chunks, mentions=mentions, associations=associations).evidence


QUERIES = {"analysis_run": analysis_run}
ORACLE_SQL: dict[str, str] = {}
