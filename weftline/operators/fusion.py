"""Rank fusion, quotas with backfill, retrieval queries, evidence and confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.text import joined

# Smoothing of reciprocal ranks, queries and quotas by depth, libraries in their order of
# priority, weights of the global queries and of a confidence, and the least size of a theme.
RRF_K = 60
MAX_QUERIES = {"quick": 4, "standard": 8, "deep": 12}
QUOTAS = {"quick": (3, 2, 1), "standard": (6, 4, 3), "deep": (9, 6, 5)}
LIBRARIES = ("psychology", "literature", "poetry")
TENSION_WEIGHT, GLOBAL_WEIGHT, LITERATURE_SHARE, GRAPH_SHARE = 3.0, 2.5, 0.9, 0.8
CONFIDENCE, FULL_SUPPORT, THEME_SIZE = (0.55, 0.30, 0.15), 2, 3


def library_order(c: Column) -> Column:
    return F.array_position(F.array(*(F.lit(x) for x in LIBRARIES)), c).cast("int")


def fused(rankings: DataFrame, by: Sequence[str] = (), ranking: str = "ranking", item: str = "chunk_id", rank: str = "rank", k: int = RRF_K) -> DataFrame:
    """by, item, score, best and position: sum of 1 / (k + rank) over rankings, an item counting once in each, at its first rank.

    Blank items keep their rank and give nothing. Order: score, then best rank, then item. Scores are
    compared at 12 digits, so that the order of addition doesn't matter, and given at 6.
    """
    once = rankings.filter(F.col(item).isNotNull() & (F.col(item).cast("string") != "")).groupBy(*by, ranking, item).agg(F.min(rank).alias("r"))
    summed = once.groupBy(*by, item).agg(F.round(F.sum(1 / (k + F.col("r"))), 12).alias("s"), F.min("r").alias("best"))
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("s"), "best", item))
    return summed.withColumn("position", place).withColumn("score", F.round("s", 6)).drop("s")


def allocated(ranked: DataFrame, quota: Sequence[int], cap: int, by: Sequence[str] = (), library: str = "library", position: str = "position") -> DataFrame:
    """Rows that the quotas take, in the order of (library, position), with quota_slot; null where a row fills up.

    The first `quota` rows of each library, then, in rounds by priority, one row of each library that has a quota
    and rows left, until there are `cap`. position counts from 1 in each library.
    """
    limit = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in zip(LIBRARIES, quota) for x in pair)), F.col(library)), F.lit(0))
    rows = ranked.withColumn("_o", library_order(F.col(library))).withColumn("_q", limit).filter("_q > 0").withColumn("_base", F.col(position) <= F.col("_q"))
    order = W.partitionBy(*by).orderBy(F.desc("_base"), F.when(F.col("_base"), 0).otherwise(F.col(position) - F.col("_q")), "_o", position)
    picked = rows.withColumn("_n", F.row_number().over(order)).withColumn("_kept", F.sum(F.col("_base").cast("int")).over(W.partitionBy(*by)))
    # the quotas are taken in full; only what fills up stops at the cap, and the result is cut to it at its end
    taken = picked.filter(F.col("_base") | (F.col("_n") <= cap))
    final = F.row_number().over(W.partitionBy(*by).orderBy("_o", position))
    out = taken.withColumn("_final", final).filter(F.col("_final") <= cap)
    return out.withColumn("quota_slot", F.when(F.col("_base"), F.col(position) - 1)).withColumn("rank_in_library", F.col(position) - 1).drop("_o", "_q", "_base", "_n", "_kept", "_final")


def best_hits(hits: DataFrame, by: Sequence[str] = ("chunk_id",), rank: str = "rank", query: str = "query_id") -> DataFrame:
    """The hit of lowest rank of each chunk; equal ranks go to the smaller query id as a string."""
    return hits.groupBy(*by).agg(F.min(F.struct(F.col(rank).alias("rank"), F.col(query).cast("string").alias("query_id"))).alias("h")).select(*by, "h.rank", "h.query_id")


def themes(clusters: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Clusters that are themes, with their weight: twice their share of the largest one's size."""
    real = clusters.filter(~F.coalesce(F.col("is_noise"), F.lit(False)) & (F.col("size") >= THEME_SIZE))
    return real.withColumn("theme_weight", 2.0 * F.col("size") / F.max("size").over(W.partitionBy(*by)))


def finalised(queries: DataFrame, depth: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct (path, library, text), the first wins; ordered by weight, path, cluster and text; capped; numbered q1, q2 and so on."""
    first = F.row_number().over(W.partitionBy(*by, "path", "library", "text").orderBy("seq"))
    order = W.partitionBy(*by).orderBy(F.desc("weight"), "path", F.coalesce("cluster_key", F.lit("")), "text")
    kept = queries.withColumn("_f", first).filter("_f = 1").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= MAX_QUERIES.get(depth, MAX_QUERIES["standard"]))
    return kept.withColumn("id", F.concat(F.lit("q"), F.col("n"))).drop("_f", "seq")


def built_queries(clusters: DataFrame, profile: DataFrame, depth: str = "standard", enabled: Sequence[str] = LIBRARIES, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Two queries for each theme and two for the whole, as rows (by, text, library, cluster_key, path, kind, weight, n, id)."""
    order = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("size"), "order_index"))
    t = themes(clusters, by).withColumn("_t", order)

    def part(df: DataFrame, library: str, text: Column, key: Column, weight: Column, seq: Column) -> DataFrame:
        return df.select(*by, text.alias("text"), F.lit(library).alias("library"), key.alias("cluster_key"), F.lit("vector").alias("path"), F.round(weight, 3).alias("weight"), seq.alias("seq"))

    key, none = F.col("cluster_key"), F.lit(None).cast("string")
    one = part(t, "psychology", joined(F.array("label"), F.col("topic_tags"), F.col("need_tags")), key, F.col("theme_weight"), F.col("_t") * 2)
    two = part(t, "literature", joined(F.col("emotion_tags"), F.col("keywords")), key, F.col("theme_weight") * LITERATURE_SHARE, F.col("_t") * 2 + 1)
    late = F.lit(1_000_000_000)
    three = part(profile, "psychology", joined(F.array("core_tension"), F.array("summary")), none, F.lit(TENSION_WEIGHT), late)
    four = part(profile.filter(F.size("emotions") > 0), "poetry", joined(F.slice("emotions", 1, 2), F.slice("needs", 1, 1)), none, F.lit(GLOBAL_WEIGHT), late + 1)
    rows = one.union(two).union(three).union(four).filter((F.col("text") != "") & F.col("library").isin(*enabled))
    return finalised(rows, depth, by).withColumn("kind", F.col("library"))


def graph_queries(clusters: DataFrame, limit: int, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """A query for each distinct emotion of the themes, larger themes first; the first theme that has it owns it."""
    order = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("size"), "order_index"))
    each = themes(clusters, by).withColumn("_t", order).select(*by, "cluster_key", "theme_weight", "_t", F.posexplode("emotion_tags").alias("_p", "text"))
    first = each.withColumn("_f", F.row_number().over(W.partitionBy(*by, "text").orderBy("_t", "_p"))).filter("_f = 1 and text is not null")
    n = F.row_number().over(W.partitionBy(*by).orderBy("_t", "_p"))
    return first.withColumn("n", n).filter(F.col("n") <= limit).select(*by, "text", "cluster_key", F.lit("graph").alias("path"), (F.col("theme_weight") * GRAPH_SHARE).alias("weight"), "n")


def confidence(evidence: Column, allusions: Column, mechanism: Column, psychology: Column, allusion_pool: Column) -> Column:
    """0.55 support + 0.30 mechanism + 0.15 allusion; what the pool cannot give counts half. Arguments are arrays of ids and a text."""
    support = F.least(F.lit(1.0), F.size(evidence) / FULL_SUPPORT)
    cited = F.arrays_overlap(evidence, psychology) & (F.trim(mechanism) != "")
    mech = F.when(cited, 1.0).when(F.size(psychology) == 0, 0.5).otherwise(0.0)
    allu = F.when(F.size(allusions) > 0, 1.0).when(F.size(allusion_pool) == 0, 0.5).otherwise(0.0)
    # written out to 9 digits first: the sum of the weights is a hair off at halves
    return F.bround(F.round(CONFIDENCE[0] * support + CONFIDENCE[1] * mech + CONFIDENCE[2] * allu, 9), 3)


def distribution(tags: DataFrame, clusters: DataFrame, by: Sequence[str] = ("run_id",), top: int = 6) -> DataFrame:
    """by, dimension, label, value, cluster_key: the sizes of the clusters that have a label, each once; the first of them owns it.

    tags has (by, cluster_key, pos, dimension, labels); clusters has (by, cluster_key, size).
    """
    each = tags.select(*by, "cluster_key", "pos", "dimension", F.explode(F.array_distinct("labels")).alias("label"))
    sized = each.join(clusters.select(*by, "cluster_key", "size"), [*by, "cluster_key"], "left").withColumn("size", F.coalesce("size", F.lit(0)))
    summed = sized.groupBy(*by, "dimension", "label").agg(F.sum("size").alias("value"), F.min_by("cluster_key", "pos").alias("cluster_key"))
    rank = F.row_number().over(W.partitionBy(*by, "dimension").orderBy(F.desc("value"), "label"))
    return summed.withColumn("rank", rank).filter(F.col("rank") <= top)
