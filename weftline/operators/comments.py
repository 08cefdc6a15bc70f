"""Cleaning of comments: every row is flagged, none is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.text import fingerprint, is_ad, is_spam, normalise, visible


def flagged(comments: DataFrame, text: str = "text", compose: bool = True) -> DataFrame:
    """Adds body, dedup_key, is_ad, is_spam and filter_reason. Precedence: empty, then ad, then spam. Texts are NFKC first unless compose is off."""
    body = F.col("body")
    reason = F.when(~visible(body), "empty").when(is_ad(body), "ad").when(is_spam(body), "spam")
    told = comments.withColumn("body", normalise(F.col(text), compose)).withColumn("filter_reason", reason).withColumn("dedup_key", fingerprint(body))
    return told.withColumn("is_ad", F.col("filter_reason").eqNullSafe("ad")).withColumn("is_spam", F.coalesce(F.col("filter_reason").isin("empty", "spam"), F.lit(False)))


def marked_duplicates(told: DataFrame, likes: str, position: str, within: tuple[str, ...] = ()) -> DataFrame:
    """Adds is_duplicate: of unflagged rows with one key the most liked stays, the earliest among equals.

    The winner is an aggregate of each key, joined back, so a key with most of the rows is no window's load. told is
    read twice: where its flags were not written before, store them first.
    """
    order = F.struct((-F.coalesce(F.col(likes), F.lit(0))).alias("l"), F.col(position).alias("p"))
    # not a filter, which would be moved below the projection that makes filter_reason and repeat its patterns
    best = told.groupBy(*within, "dedup_key").agg(F.min(F.when(F.col("filter_reason").isNull(), order)).alias("_best"))
    joined = told.join(best, [*within, "dedup_key"], "left")
    dup = F.col("filter_reason").isNull() & (F.col("_best") < order)
    return joined.withColumn("is_duplicate", F.coalesce(dup, F.lit(False))).drop("_best").withColumn("filter_reason", F.when(F.col("is_duplicate"), "duplicate").otherwise(F.col("filter_reason")))


def tally(told: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """total, kept, ads, spam, duplicates, empty; each row counts once: duplicate, then ad, then empty or spam, then kept."""

    def n(c: Column) -> Column:
        return F.sum(F.when(c, 1).otherwise(0)).cast("long")

    dup, ad, empty = F.col("is_duplicate"), F.col("is_ad"), F.col("filter_reason").eqNullSafe("empty")
    rest = ~dup & ~ad
    spam = rest & F.col("is_spam")
    return told.groupBy(*by).agg(
        F.count("*").alias("total"),
        n(rest & ~F.col("is_spam")).alias("kept"),
        n(~dup & ad).alias("ads"),
        n(spam & ~empty).alias("spam"),
        n(dup).alias("duplicates"),
        n(spam & empty).alias("empty"),
    )


def visible_rows(told: DataFrame) -> DataFrame:
    return told.filter(~F.col("is_ad") & ~F.col("is_spam") & ~F.col("is_duplicate"))


def clusterable(told: DataFrame) -> DataFrame:
    return visible_rows(told).filter(F.col("body") != "")
