"""From chosen chunks to evidence, and what a run shows when a model gave nothing: labels, profiles and steps by rule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.text import clean_tags, clean_text
from weftline.operators.storage import stored

# Names of clusters without keywords, characters of an evidence's text, chunks of a graph query, imagery
# of a concept, concepts of a run, steps of a fallback, and the caps of tags by dimension.
NOISE_LABEL, TAIL_LABEL, TAIL_KEY = "边缘声音", "其他·长尾", "tail"
TEXT_CHARS, GRAPH_TOP, BRIDGE_IMAGERY, MOST_CONCEPTS, MOST_STEPS = 400, 6, 3, 2, 5
TAG_CAPS = {"emotion": 3, "topic": 3, "need": 2}


def fallback_label() -> Column:
    """A name for a cluster (cluster_key, is_noise, keywords, size) out of what it has."""
    words = F.slice(F.filter("keywords", lambda k: k.isNotNull() & (k != "")), 1, 2)
    some = F.concat(F.lit("未命名的一组（"), F.col("size").cast("string"), F.lit(" 条）"))
    return F.when(F.col("is_noise"), NOISE_LABEL).when(F.col("cluster_key") == TAIL_KEY, TAIL_LABEL).when(F.size(words) > 0, F.array_join(words, "·")).otherwise(some)


def labelled(clusters: DataFrame, answers: DataFrame, emotions: Sequence[str], by: Sequence[str] = ("run_id",)) -> DataFrame:
    """clusters with what a model answered: label, summary and tags, cleaned and capped, emotions of the closed set only; without an answer the fallback's name.

    answers has (by, cluster_key, label, summary, emotion, topic, need).
    """
    a = answers.select(*by, "cluster_key", F.struct("label", "summary", *TAG_CAPS).alias("_a"))
    both = clusters.join(a, [*by, "cluster_key"], "left")
    told = F.col("_a").isNotNull()
    closed = F.array(*(F.lit(e) for e in emotions))
    tags = {f"{d}_tags": F.when(told, clean_tags(F.coalesce(f"_a.{d}", F.array().cast("array<string>")), closed if d == "emotion" else None, cap)).otherwise(F.col(f"{d}_tags")) for d, cap in TAG_CAPS.items()}
    label = F.coalesce(F.nullif(clean_text(F.col("_a.label"), 40), F.lit("")), fallback_label())
    summary = F.nullif(clean_text(F.col("_a.summary"), 200), F.lit(""))
    return both.withColumns({**tags, "label": label, "summary": summary, "label_source": F.when(told, "model").otherwise("fallback")}).drop("_a")


def filled_tags(clusters: DataFrame, produced: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """by, cluster_key, tags of every cluster: what was produced for it, else its own; what was produced for no cluster of the run goes."""
    return clusters.select(*by, "cluster_key", F.col("tags").alias("_own")).join(produced.select(*by, "cluster_key", "tags"), [*by, "cluster_key"], "left").select(*by, "cluster_key", F.coalesce("tags", "_own").alias("tags"))


def raw_counts(member: DataFrame, representative: str, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """How many rows each representative stands for, itself included."""
    return member.groupBy(*by, representative).agg(F.count("*").alias("raw_count"))


def fallback_profile(clusters: DataFrame, emotions: Sequence[str], by: Sequence[str] = ("run_id",)) -> DataFrame:
    """One row for each run: the clusters' own tags, distinct in the clusters' order and capped; no tension, model fallback."""
    closed = F.array(*(F.lit(e) for e in emotions))
    lists = F.array_sort(F.collect_list(F.struct("order_index", "cluster_key", *(f"{d}_tags" for d in TAG_CAPS))))
    every = clusters.groupBy(*by).agg(lists.alias("_c"))
    flat = lambda d: F.flatten(F.transform("_c", lambda c: F.coalesce(c[f"{d}_tags"], F.array().cast("array<string>"))))
    tags = {d: clean_tags(flat(d), closed if d == "emotion" else None, cap) for d, cap in TAG_CAPS.items()}
    return every.withColumns({**tags, "core_tension": F.lit(None).cast("string"), "model": F.lit("fallback")}).drop("_c")


def with_empty_profile(runs: DataFrame, profiles: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """A profile for every run; one that has none gets empty lists and the model none."""
    out = runs.select(*by).join(profiles, list(by), "left")
    return out.withColumns({**{d: F.coalesce(d, F.array().cast("array<string>")) for d in TAG_CAPS}, "model": F.coalesce("model", F.lit("none"))})


def fallback_steps(clusters: DataFrame, by: Sequence[str] = ("run_id",), most: int = MOST_STEPS) -> DataFrame:
    """by, step_index, phenomenon: the summaries, else the labels, of the first clusters that are no noise and have either."""
    text = F.coalesce(F.nullif(F.trim("summary"), F.lit("")), F.nullif(F.trim("label"), F.lit("")))
    n = F.row_number().over(W.partitionBy(*by).orderBy("order_index", "cluster_key"))
    return clusters.filter(~F.coalesce("is_noise", F.lit(False))).withColumn("phenomenon", text).filter("phenomenon is not null").withColumn("step_index", n).filter(F.col("step_index") <= most).select(*by, "step_index", "phenomenon")


def merged_payload(first: DataFrame, second: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key and fields: the second's where it has a row and a value, else the first's. Only keys of the second stay: what can't be fetched is no evidence."""
    a = first.select(key, *(F.col(c).alias(f"_{c}") for c in fields))
    return second.join(a, key, "left").select(key, *(F.coalesce(c, f"_{c}").alias(c) for c in fields))


def with_text(rows: DataFrame, texts: DataFrame, key: str = "chunk_id") -> DataFrame:
    """rows (key, snippet) with the whole text where it is known, else the snippet."""
    return rows.join(texts.select(key, "text"), key, "left").withColumn("text", F.coalesce("text", "snippet"))


def top_concepts(hits: DataFrame, by: Sequence[str] = ("run_id",), most: int = MOST_CONCEPTS) -> DataFrame:
    """by, place, concept: distinct concepts of psychology's vector hits (path, library, rank, query_id, concept), best hit first."""
    ok = hits.filter((F.col("path") == "vector") & (F.col("library") == "psychology") & (F.trim(F.coalesce("concept", F.lit(""))) != ""))
    best = ok.groupBy(*by, F.trim("concept").alias("concept")).agg(F.min(F.struct("rank", "query_id")).alias("h"))
    return best.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy("h", "concept"))).filter(F.col("place") <= most).select(*by, "place", "concept")


def graph_pass(concepts: DataFrame, imagery: DataFrame, mentions: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """by, concept, chunk_id, place: a concept's strongest imagery lead to the chunks that mention it, each chunk once.

    imagery has (concept, imagery, strength), mentions (imagery, chunk_id, weight); the first BRIDGE_IMAGERY imagery of a
    concept and the first GRAPH_TOP chunks of each imagery count.
    """
    strong = imagery.withColumn("_i", F.row_number().over(W.partitionBy("concept").orderBy(F.desc("strength"), "imagery"))).filter(F.col("_i") <= BRIDGE_IMAGERY)
    lead = strong.select("imagery").distinct()
    some = mentions.join(lead, "imagery", "left_semi").withColumn("_m", F.row_number().over(W.partitionBy("imagery").orderBy(F.desc("weight"), "chunk_id"))).filter(F.col("_m") <= GRAPH_TOP)
    # where a concept leads is the same in every run, so it is told once for each concept, and the runs' rows are not dealt out again
    once = strong.join(some, "imagery").groupBy("concept", "chunk_id").agg(F.min(F.struct("_i", "_m")).alias("_p"))
    leads = stored(once.withColumn("place", F.row_number().over(W.partitionBy("concept").orderBy("_p"))).drop("_p"), "leads")
    return concepts.select(*by, "concept").distinct().join(leads, "concept").select(*by, "concept", "chunk_id", "place")


def match_reason() -> Column:
    """Why a row (path, concept_bridge, vector_score, imagery) was chosen, in one line."""
    words = F.array_join(F.slice("imagery", 1, 3), "、")
    near = F.concat(F.lit("向量相似 "), F.format_string("%.2f", F.col("vector_score")))
    return (
        F.when(F.coalesce("concept_bridge", F.lit("")) != "", F.concat(F.lit("概念桥："), "concept_bridge", F.lit(" → 意象")))
        .when(F.col("path") == "graph", F.lit("图谱：情绪 → 意象 → 语料"))
        .when(F.col("vector_score").isNull(), F.lit("向量检索"))
        .when(F.size("imagery") > 0, F.concat(near, F.lit("｜意象："), words))
        .otherwise(near)
    )


def source_of() -> Column:
    """Where a row (author, work, title, source, origin) is from: author and work, else the first of what there is; null without any."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    work = F.coalesce(blank("work"), blank("title"))
    return F.when(blank("author").isNotNull() & work.isNotNull(), F.concat("author", F.lit("·"), work)).otherwise(F.coalesce(work, blank("source"), blank("origin")))


def projected(selected: DataFrame, hits: DataFrame, scores: DataFrame, payload: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Evidence of the selected chunks (by, place, chunk_id, library, rank_in_library, quota_slot): their best hit, fused score and payload.

    hits has (by, chunk_id, query_id, path, vector_score, cluster_key, concept_bridge), scores (by, chunk_id, score), payload
    (chunk_id, text, work, title, chapter, author, source, origin, imagery). Without a payload a chunk is no evidence; ranks have no gaps.
    """
    key = [*by, "chunk_id"]
    e = selected.join(payload, "chunk_id").join(hits, key, "left").join(scores, key, "left")
    rank = F.row_number().over(W.partitionBy(*by).orderBy("place"))
    e = e.withColumns({"rank": rank, "path": F.coalesce("path", F.lit("vector")), "score": F.round(F.coalesce("score", F.lit(0.0)), 6)})
    named = F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in ("work", "title", "chapter")))
    return e.select(
        *by,
        "rank",
        F.concat(F.lit("e"), F.col("rank").cast("string")).alias("ev_id"),
        "chunk_id",
        "library",
        named.alias("title"),
        source_of().alias("source"),
        F.substring(F.coalesce("text", F.lit("")), 1, TEXT_CHARS).alias("text"),
        "score",
        "path",
        match_reason().alias("match_reason"),
        "cluster_key",
        (F.col("rank_in_library") + 1).alias("rank_in_library"),
        "quota_slot",
    )


def brief(evidence: DataFrame, limit: int = TEXT_CHARS) -> DataFrame:
    """id, kind, title, source, author and the cut text of evidence that has a chunk_id."""
    has = evidence.filter(F.coalesce(F.col("chunk_id").cast("string"), F.lit("")) != "")
    return has.select(F.col("chunk_id").alias("id"), F.coalesce("kind", F.lit("")).alias("kind"), "title", "source", "author", clean_text(F.coalesce("text", F.lit("")), limit).alias("text"))


def counts_by(rows: DataFrame, column: str, values: Sequence[str], by: Sequence[str] = ("run_id",)) -> DataFrame:
    """One row for each run with the number of rows of every value."""
    return rows.groupBy(*by).agg(*(F.sum((F.col(column) == v).cast("int")).cast("long").alias(v) for v in values))


def source_kind(kinds: Mapping[str, str], chosen: Column, external_id: Column) -> Column:
    """The kind that a run names, if it is known; else text without an external id, and the default with one."""
    return F.coalesce(F.when(chosen.isin(*kinds), chosen), F.when(F.coalesce(external_id, F.lit("")) == "", "text").otherwise(next(k for k in kinds if k != "text")))
