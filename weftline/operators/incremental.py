"""Keeping tables current: content hashes, registry diffs, upserts, deletes, orphans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(text: Column, model: str, dim: int) -> Column:
    return F.sha2(F.concat_ws("\u0000", text, F.lit(model), F.lit(str(dim))), 256)


def diff(chunks: DataFrame, registry: DataFrame, key: str = "chunk_id", digest: str = "content_hash", force: bool = False) -> DataFrame:
    """chunks with action: added, updated or skipped; force makes all added."""
    known = registry.select(key, F.col(digest).alias("_known"))
    action = F.lit("added") if force else F.when(F.col("_known").isNull(), "added").when(F.col("_known") != F.col(digest), "updated").otherwise("skipped")
    return chunks.join(known, key, "left").withColumn("action", action).drop("_known")


def upserted(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """The old rows that no new one replaces, and the new ones."""
    return old.join(new.select(*key), list(key), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def deleted(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_anti")


def orphans(registry: DataFrame, corpus: DataFrame, corpus_files: Sequence[str], key: str = "chunk_id", source: str = "source_file") -> DataFrame:
    """Registry rows of corpus files whose chunk is no longer in the corpus."""
    return registry.filter(F.col(source).isin(*corpus_files)).join(corpus.select(key), key, "left_anti")


def imported(registry: DataFrame, corpus_files: Sequence[str], source: str = "source_file") -> DataFrame:
    """Rows that no corpus file gave; a missing source counts as imported."""
    return registry.filter(F.col(source).isNull() | ~F.col(source).isin(*corpus_files))


def cached(texts: DataFrame, cache: DataFrame, compute, key: str, value: str) -> DataFrame:
    """texts with value from the cache, or computed once for each distinct miss."""
    misses = texts.select(key).distinct().join(cache.select(key), key, "left_anti")
    return texts.join(cache.select(key, value).unionByName(misses.withColumn(value, compute(F.col(key)))), key)


def pinned(evidence: DataFrame, prior: DataFrame, key: Sequence[str]) -> DataFrame:
    """evidence whose pinned flag also keeps what was pinned before."""
    was = prior.filter("pinned").select(*key).distinct().withColumn("_was", F.lit(True))
    return evidence.join(was, list(key), "left").withColumn("pinned", F.coalesce("_was", F.lit(False)) | F.col("pinned")).drop("_was")


def of_dimension(rows: DataFrame, vector: str, dim: int) -> DataFrame:
    """rows; a vector of another number of dimensions ends the query."""
    size = F.size(vector)
    wrong = F.raise_error(F.format_string("a vector has %d dimensions, not %d", size, F.lit(dim))).cast("boolean")
    return rows.filter(F.when(F.col(vector).isNull() | (size == dim), True).otherwise(wrong))


def unseen(rows: DataFrame, seen: DataFrame, key: str, order: Column) -> DataFrame:
    """Rows whose key was not seen before, of equal keys the first."""
    fresh = rows.join(seen.select(key).distinct(), key, "left_anti")
    rest = [c for c in rows.columns if c != key]
    return fresh.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_s")).select(key, "_s.*")


def complete(chunks: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """chunks with their vectors; a chunk without exactly one ends the query."""
    one = vectors.groupBy(key).agg(F.count("*").alias("_n"), F.first("vector").alias("vector"))
    n = F.coalesce("_n", F.lit(0))
    wrong = F.raise_error(F.format_string("%d vectors for one chunk", n)).cast("boolean")
    return chunks.join(one, key, "left").filter(F.when(n == 1, True).otherwise(wrong)).drop("_n")


def taken(rows: DataFrame, known: DataFrame, key: str, priority: Sequence[str], count: int) -> DataFrame:
    """The first `count` rows in the order of priority whose key is not known, each key once."""
    return unseen(rows, known, key, F.struct(*priority)).orderBy(*priority).limit(count)
