"""Keyphrases of one document and of a group of short texts.

A text's n-grams are counted by arrays where the text is read. Of a key that has one row, of at most LONG bytes, the phrases
are picked there too. The other keys, and groups, are never collected: their counts are added up by key and gram, of each key
the best `most` are taken by a limited window, and the phrases are picked from those. A key whose phrases are not yet
`k`, although it has more grams, is picked anew from four times as many, round by round; so the
result is that of the whole list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.grams import PART, counted, phrased
from weftline.functions.lexical import gram_score, uncontained
from weftline.operators.storage import stored
from weftline.shipping import ship

#: Grams of a key that are looked at in the first round.
MOST = 64
#: UTF-8 bytes of the longest text whose phrases are picked where it is read.
LONG = 1 << 20


def _kinds(df: DataFrame, *columns: str) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def gram_rows(df: DataFrame, *keys: str, text: str, part: int = PART) -> DataFrame:
    """keys, gram, n: a row for each n-gram of each text. Of texts of more than `part` characters several, with a part of the occurrences each."""
    ship(df.sparkSession)
    return df.filter(F.col(text).isNotNull()).select(*keys, text).mapInArrow(lambda batches: counted(batches, part), f"{_kinds(df, *keys)}, gram string, n long")


def frequencies(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, gram, n: occurrences of each n-gram in each document."""
    return gram_rows(df, key, text=text).groupBy(key, "gram").agg(F.sum("n").alias("n"))


def picked(scored: DataFrame, by: Sequence[str], k: int, most: int = MOST) -> DataFrame:
    """by, phrases: of scored (by, gram, score) the first k by score, length and name that neither hold nor are held by one before them."""
    by = list(by)
    scored = stored(scored.select(*by, "gram", F.round("score", 9).alias("score")), "grams")
    order = W.partitionBy(*by).orderBy(F.desc("score"), F.desc(F.length("gram")), "gram")
    sizes = scored.groupBy(*by).agg(F.count("*").alias("_rows"))
    left, done = sizes, None
    while True:
        best = scored.join(left.select(*by), by, "left_semi") if done is not None else scored
        best = best.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= most)
        # at most `most` short strings a key
        lists = best.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_place", "gram"))).alias("_l"))
        now = stored(lists.join(left, by).select(*by, uncontained(F.transform("_l", lambda x: x["gram"]), k).alias("phrases"), "_rows"), "phrases")
        open_ = (F.size("phrases") < k) & (F.col("_rows") > most)
        ready = now.filter(~open_).select(*by, "phrases")
        done = ready if done is None else done.unionByName(ready)
        left = now.filter(open_).select(*by, "_rows")
        if left.isEmpty():
            return done
        most *= 4


def keyphrases(df: DataFrame, key: str, text: str, k: int = 6, most: int = MOST, long: int = LONG) -> DataFrame:
    """key, phrases: by score, length and name, none that holds another."""
    ship(df.sparkSession)
    df = df.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text)
    several = df.groupBy(key).agg(F.count("*").alias("_rows"), F.max(F.octet_length(text)).alias("_long")).filter((F.col("_rows") > 1) | (F.col("_long") > long))
    apart = stored(several.select(key), "apart")
    each = lambda rows: rows.select(key, text).mapInArrow(lambda batches: phrased(batches, k), f"{_kinds(df, key)}, phrases array<string>")
    if apart.isEmpty():
        return each(df)
    counts = frequencies(df.join(apart, key, "left_semi"), key, text)
    return each(df.join(apart, key, "left_anti")).unionByName(picked(counts.withColumn("score", gram_score(F.col("gram"), F.col("n"))), (key,), k, most))


def keyphrases_across(df: DataFrame, group: str, key: str, text: str, k: int = 5, least: int = 2, most: int = MOST) -> DataFrame:
    """group, phrases: an n-gram counts the texts that have it, and needs `least` of them."""
    n = gram_rows(df, group, key, text=text).select(group, key, "gram").distinct().groupBy(group, "gram").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return picked(n.withColumn("score", gram_score(F.col("gram"), F.col("n"))), (group,), k, most)
