"""Edge tables derived from chunks, and short traversals over them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import one_line
from weftline.operators.containment import held

# Node types and relations that an edge may have.
NODE_TYPES = ("Imagery", "Emotion", "Character", "Concept", "Chunk", "Work")
RELATIONS = ("ASSOCIATED_WITH", "CO_OCCURS", "FEATURES_CHARACTER", "EVIDENCED_BY")


def derived_edges(chunks: DataFrame) -> DataFrame:
    """src, relation, dst of chunks (chunk_id, imagery, emotion, character, work, concept), each once."""

    def listed(c: str, relation: str) -> DataFrame:
        return chunks.select(F.col("chunk_id").cast("string").alias("src"), F.lit(relation).alias("relation"), F.explode(c).alias("dst"))

    def single(c: str, relation: str) -> DataFrame:
        return chunks.filter(F.col(c).isNotNull()).select(F.col(c).alias("src"), F.lit(relation).alias("relation"), F.col("chunk_id").cast("string").alias("dst"))

    parts = [listed("imagery", "MENTIONS_IMAGERY"), listed("emotion", "EVOKES_EMOTION"), single("character", "FEATURES_CHARACTER"), single("work", "HAS_CHUNK"), single("concept", "HAS_CONCEPT")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def merged_edges(edges: DataFrame, position: str) -> DataFrame:
    """One edge for each (source, relation, target); the last one's weight stays."""
    return edges.groupBy("source", "relation", "target").agg(F.max_by(F.coalesce("weight", F.lit(1.0)), position).alias("weight"))


def chunks_by_emotion(mentions: DataFrame, associations: DataFrame, emotions: DataFrame) -> DataFrame:
    """emotion, chunk_id, weight: chunks that mention an imagery associated with the emotion, with the largest weight."""
    path = emotions.join(associations, "emotion").join(mentions, "imagery")
    return path.groupBy("emotion", "chunk_id").agg(F.max("weight").alias("weight"))


def chunk_nodes(chunks: DataFrame) -> DataFrame:
    """chunks with a snippet of their text, each chunk_id once."""
    return chunks.dropDuplicates(["chunk_id"]).withColumn("snippet", one_line(F.col("text"), 60))


def work_nodes(chunks: DataFrame, position: str) -> DataFrame:
    """work, author: what a work's first chunk says stays."""
    return chunks.filter("work is not null").groupBy("work").agg(F.min_by("author", position).alias("author"))


def concept_edges(chunks: DataFrame) -> DataFrame:
    """src, dst from concepts to psychology's chunks."""
    return chunks.filter((F.col("library") == "psychology") & F.col("concept").isNotNull()).select(F.col("concept").alias("src"), F.col("chunk_id").alias("dst")).distinct()


def without_chunks(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """edges (src, relation, dst) but those that begin or end at one of the chunks; the nodes at the other ends stay."""
    ids = chunks.select(F.col("chunk_id").cast("string").alias("_id")).distinct()
    return edges.join(ids, edges["src"] == ids["_id"], "left_anti").join(ids, edges["dst"] == ids["_id"], "left_anti")


def label_counts(nodes: Mapping[str, DataFrame]) -> DataFrame:
    """name, n: the distinct nodes of each label."""
    out = None
    for name, rows in nodes.items():
        one = rows.distinct().agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def imagery_by_concept(evidence: DataFrame, concepts: DataFrame, fuzzy: bool = False) -> DataFrame:
    """query, imagery, strength: paths from concepts that equal the query or, if fuzzy, hold it or are held by it; see containment."""
    wanted = concepts.filter(F.trim("query") != "").select("query").distinct()
    if not fuzzy:
        return evidence.join(wanted, F.col("concept") == F.col("query")).groupBy("query", "imagery").agg(F.count("*").alias("strength"))
    names = evidence.filter("concept is not null").select("concept").distinct()
    named, asked = (lambda name, df, c: df.select(F.col(c).alias(name))), ("query", "concept")
    holds = held(named("name", wanted, "query"), named("text", names, "concept")).toDF(*asked)
    inside = held(named("name", names, "concept"), named("text", wanted, "query")).select(F.col("text").alias("query"), F.col("name").alias("concept"))
    match = holds.union(inside).distinct()
    return evidence.join(match, "concept").groupBy("query", "imagery").agg(F.count("*").alias("strength"))
