"""Which texts hold which others: a join on q-grams instead of all pairs or all substrings.

A text holds a name only if it has all of the name's q-grams. So each name is looked for by one of
them, the one that the fewest texts have, and what meets is verified. A text gives its distinct
q-grams of 1 to Q characters, which is linear in its length; a name gives one row.

Names and texts that meet in groups only, small ones, need none of that: each name of a group is
looked for in each of its texts, which is a fraction of what their q-grams take. Groups of more than
PAIRS pairs or texts go by q-grams.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.storage import stored

#: Characters of the longest q-gram.
Q = 3
#: Characters of a text whose q-grams are made at a time.
WINDOW = 64
#: Pairs of a name and a text, and texts, that a group may have to be looked through without q-grams.
PAIRS = 4096


def windows(text: Column, size: int, overlap: int) -> Column:
    """The text in pieces of `size` characters, each with the first `overlap` characters of the next; in one pass over the text."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{1,{size + overlap}}})).{{1,{size}}}"), F.lit(1))
    return F.when(F.length(text).between(1, size), F.array(text)).otherwise(pieces)


def grams(text: Column, q: int = Q) -> Column:
    """The distinct q-grams of 1 to q characters of a short text."""
    n = F.length(text)
    of = lambda k: F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.substring(text, i, F.lit(k)))
    return F.array_distinct(F.concat(*(F.when(n >= k, of(k)).otherwise(F.array().cast("array<string>")) for k in range(1, q + 1))))


def _longest(text: Column, q: int) -> Column:
    """The distinct q-grams of a name; a shorter name is its own."""
    n = F.length(text)
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - (q - 1))), lambda i: F.substring(text, i, F.lit(q)))
    return F.array_distinct(each)


def _by_grams(names: DataFrame, texts: DataFrame, by: list[str], q: int) -> DataFrame:
    texts = texts.select(*by, "text").distinct()
    pieces = texts.select(*by, "text", F.xxhash64("text").alias("_at"), F.explode(windows(F.col("text"), WINDOW, q - 1)).alias("_w"))
    # the text itself stays behind: what is counted and met is its hash
    each = pieces.select(*by, "_at", F.explode(grams(F.col("_w"), q)).alias("_gram")).distinct()
    asked = names.select(*by, "name", F.explode(_longest(F.col("name"), q)).alias("_gram"))
    wanted = each.join(asked.select(*by, "_gram").distinct(), [*by, "_gram"], "left_semi")
    rare = wanted.groupBy(*by, "_gram").agg(F.count("*").alias("_n"))
    # a name with a q-gram that no text has is held by none
    key = asked.join(rare, [*by, "_gram"], "left").groupBy(*by, "name").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("g"))).alias("_k")).filter("_k.n > 0")
    met = key.select(*by, "name", F.col("_k.g").alias("_gram")).join(wanted, [*by, "_gram"]).select(*by, "name", "_at")
    found = met.join(texts.withColumn("_at", F.xxhash64("text")), [*by, "_at"])
    return found.filter(F.contains("text", "name")).select(*by, "name", "text")


def held(names: DataFrame, texts: DataFrame, by: Sequence[str] = (), q: int = Q, pairs: int = PAIRS) -> DataFrame:
    """by, name, text of all pairs in which the text holds the name; names (by, name) and texts (by, text) are taken once each, null and empty names hold nowhere."""
    by = list(by)
    names = names.filter(F.col("name") != "").select(*by, "name").distinct()
    texts = texts.filter(F.col("text").isNotNull()).select(*by, "text")
    if not by:
        return _by_grams(names, texts, by, q)
    asked, there = names.groupBy(*by).agg(F.count("*").alias("_names")), texts.groupBy(*by).agg(F.count("*").alias("_texts"))
    sized = there.join(asked, by, "left").filter((F.col("_texts") > pairs) | (F.col("_names") * F.col("_texts") > pairs))
    large = stored(sized.select(*by, F.col("_names").isNotNull().alias("_named")), "groups")
    if large.isEmpty():
        return names.join(texts, by).filter(F.contains("text", "name")).select(*by, "name", "text").distinct()
    apart = large.select(*by)
    few = names.join(apart, by, "left_anti").join(texts.join(apart, by, "left_anti"), by).filter(F.contains("text", "name"))
    many = _by_grams(names.join(apart, by, "left_semi"), texts.join(large.filter("_named").select(*by), by, "left_semi"), by, q)
    return few.select(*by, "name", "text").distinct().unionByName(many)
