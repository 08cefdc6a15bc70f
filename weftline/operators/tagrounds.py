"""Tagging in rounds: what a model answers for a batch is taken as a whole or asked for again in halves, down to single rows.

Each round is a few joins over all batches that are still open. A part of a batch is accepted if exactly the rows asked for
came back, the answer was not cut off, no row has another one's quote, and at least one row is itself valid. Other parts
of more than one row are split in halves and asked for again. What no round could tell goes to the rules; if more than
half of the batches have such rows, nothing is taken at all.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.storage import stored
from weftline.operators.tagging import FORBIDDEN, LONGEST_TAG, accepted

# Types that a library's chunks may have, how many tags of a kind are kept, and the share of failed batches that ends a tagging.
TYPE_SETS = {"psychology": ("论述", "实证", "综述", "评论"), "literature": ("散文", "议论", "史传", "小说", "诗词"), "poetry": ("诗", "词", "曲", "赋")}
MOST_KEYWORDS, MOST_IMAGERY, MOST_EMOTION, EMOTIONS_READ = 6, 3, 3, 32
MOST_FAILED = 0.5
#: Why something of an answer is not taken.
REASONS = ("kind", "length", "character", "foreign", "no quote", "quote", "emotion", "type", "imagery")


class TaggingFailed(RuntimeError):
    """Too many batches failed; nothing was taken."""


def _text(v: Column, path: str = "$") -> Column:
    """The string at a path of a variant; null for anything else."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def _list(v: Column, path: str) -> Column:
    """The list at a path; a string is a list of itself, anything else is empty."""
    x = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(x) == "STRING", F.array(x)).otherwise(F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>")))


def _refusal(tag: Column, text: Column) -> Column:
    """Why a tag is not taken, or null; tag is a string, null where it was none."""
    t = F.trim(tag)
    return F.when(t.isNull(), "kind").when((t == "") | (F.length(t) > LONGEST_TAG), "length").when(t.rlike(FORBIDDEN), "character").when(~F.contains(text, t), "foreign")


def validated(answers: DataFrame, emotions: Sequence[str]) -> DataFrame:
    """answers (library, text, item) with tags, null where the quote tells that the item is not the text's, and reasons of what was not taken."""
    text, item = F.col("text"), F.col("item")
    quote = F.trim(_text(item, "$.quote"))
    identity = F.when(F.coalesce(quote, F.lit("")) == "", "no quote").when(~F.contains(text, quote), "quote")
    a = answers.withColumns({"_quote": quote, "_identity": identity, "_kind": F.coalesce(F.trim(_text(item, "$.type")), F.lit("")), "_concept": F.coalesce(F.trim(_text(item, "$.concept")), F.lit(""))})
    a = a.withColumns({f"_{c}": F.transform(_list(item, f"$.{c}"), lambda x: _text(x)) for c in ("keywords", "imagery", "emotion")})
    kept = lambda c, most: F.slice(F.array_distinct(F.transform(F.filter(c, lambda t: _refusal(t, text).isNull()), lambda t: F.trim(t))), 1, most)
    told = F.slice(F.filter(F.transform("_emotion", lambda t: F.trim(t)), lambda t: t.isNotNull() & (t != "") & (F.length(t) <= LONGEST_TAG) & ~t.rlike(FORBIDDEN)), 1, EMOTIONS_READ)
    closed = F.array(*(F.lit(x) for x in emotions))
    types = F.create_map(*(x for lib, names in TYPE_SETS.items() for x in (F.lit(lib), F.array(*(F.lit(n) for n in names)))))
    fits = F.coalesce(F.array_contains(types[F.col("library")], F.col("_kind")), F.lit(False))
    mind = F.col("library") == "psychology"
    pictures = kept(F.col("_imagery"), MOST_IMAGERY)
    tags = F.struct(
        F.col("_quote").alias("quote"),
        F.when(F.col("_concept").rlike(FORBIDDEN), "").otherwise(F.col("_concept")).alias("concept"),
        kept(F.col("_keywords"), MOST_KEYWORDS).alias("keywords"),
        F.when(mind, F.array().cast("array<string>")).otherwise(pictures).alias("imagery"),
        F.slice(F.array_distinct(F.filter(told, lambda t: F.array_contains(closed, t))), 1, MOST_EMOTION).alias("emotion"),
        F.when(fits, F.col("_kind")).otherwise("").alias("type"),
    )
    none = F.array().cast("array<string>")
    once = lambda when, name: F.when(when, F.array(F.lit(name))).otherwise(none)
    reasons = F.concat(
        F.transform(F.filter(told, lambda t: ~F.array_contains(closed, t)), lambda t: F.lit("emotion")),
        once((F.col("_kind") != "") & ~fits, "type"),
        once(F.col("_concept").rlike(FORBIDDEN), "character"),
        *(F.filter(F.transform(c, lambda t: _refusal(t, text)), lambda r: r.isNotNull()) for c in ("_keywords", "_imagery")),
        F.when(mind, F.transform(pictures, lambda t: F.lit("imagery"))).otherwise(none),
    )
    bad = F.col("_identity").isNotNull()
    out = a.withColumns({"tags": F.when(~bad, tags), "reasons": F.when(bad, F.array("_identity")).otherwise(reasons)})
    return out.select(*answers.columns, "tags", "reasons")


def in_rounds(texts: DataFrame, ask: Callable[[DataFrame, int], DataFrame], emotions: Sequence[str], partial: bool = False) -> tuple[DataFrame, DataFrame]:
    """Tags of texts (batch, i, library, text), and the parts that failed.

    ask(parts, round) answers (part, i, item, cut) for rows (part, i, library, text): item a variant, cut whether the part's answer was
    cut off. The first result has (batch, i, round, tags, reasons) of every row of an accepted part, tags null where the row must go to the rules;
    the second (batch, part, rows, round) of every single row that no round could tell. Unless partial, more than MOST_FAILED of the
    batches with rows to go to the rules end the job.
    """
    batches = texts.select("batch").distinct().count()
    open_ = stored(texts.select("batch", F.col("batch").cast("string").alias("part"), "i", "library", "text"), "parts")
    done = failed = None
    n = 0
    while True:
        answers = stored(ask(open_.drop("batch"), n), "answers")
        quotes = answers.select("part", "i", F.coalesce(_text(F.col("item"), "$.quote"), F.lit("")).alias("quote"))
        whole = accepted(open_.select("part", "i", "text"), quotes, "part").join(answers.filter("cut").select("part").distinct(), "part", "left_anti")
        told = validated(answers.join(whole, "part", "left_semi").join(open_, ["part", "i"]), emotions)
        some = told.withColumn("_any", F.max(F.col("tags").isNotNull()).over(W.partitionBy("part"))).filter("_any")  # a part is a batch at most
        now = stored(some.select("batch", "part", "i", F.lit(n).alias("round"), "tags", "reasons"), "told")
        done = now if done is None else done.unionByName(now)
        rest = open_.join(now.select("part").distinct(), "part", "left_anti")
        sized = rest.withColumns({"_n": F.count("*").over(W.partitionBy("part")), "_k": F.row_number().over(W.partitionBy("part").orderBy("i"))})
        single = sized.filter("_n = 1").select("batch", "part", "i", F.lit(n).alias("round"))
        failed = single if failed is None else failed.unionByName(single)
        halves = sized.filter("_n > 1").withColumn("part", F.concat("part", F.when(F.col("_k") <= F.floor(F.col("_n") / 2), ".0").otherwise(".1")))
        open_ = stored(halves.drop("_n", "_k"), "parts")
        if open_.isEmpty():
            break
        n += 1
    lost = done.filter("tags is null").select("batch").union(failed.select("batch")).distinct().count()
    if not partial and lost > MOST_FAILED * batches:
        raise TaggingFailed(f"{lost} of {batches} batches failed; nothing was taken")
    return done.drop("part"), failed


def refusals(done: DataFrame, most: int) -> DataFrame:
    """reason, n: the most frequent reasons, ties by name."""
    return done.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(most)
