"""Tags of chunks: what a model returned is checked against the texts, and rules fill in where it can't be used."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.lexical import NOUN_ENDINGS, lexicon_tags
from weftline.operators.containment import held
from weftline.operators.storage import stored

# Emotions that tags may name beside those of the lexicon, characters that no tag holds, types of a
# library's chunks, the name of a chunk without any, and limits.
MORE_EMOTIONS = ("悲悯", "无常", "豁达", "虚无", "释然", "自怜", "思念", "怅惘", "回忆", "希冀", "离愁", "恐惧", "荒诞", "疏离", "平静")
FORBIDDEN = "[｜《》〈〉：、\\n\\r\\t]"
TYPES = {"psychology": "论述", "literature": "散文", "poetry": "诗"}
UNNAMED = "未命名概念"
LONGEST_TAG, QUOTE_CHARS, MOST_TAGS, MOST_REASONS = 20, 40, 3, 4


def closed_emotions(lexicon: Mapping[str, Sequence[str]]) -> tuple[str, ...]:
    """The names that an emotion tag may have: the lexicon's, and those the corpus has beside."""
    return (*lexicon, *(x for x in MORE_EMOTIONS if x not in lexicon))


def first_sentence(text: Column, limit: int = QUOTE_CHARS) -> Column:
    """The first sentence with its mark, or the whole text, cut."""
    found = F.regexp_extract(text, "[^。！？；…!?;]+[。！？；…!?;]?", 0)
    return F.trim(F.substring(F.when(found != "", found).otherwise(text), 1, limit))


def concept(keyphrases: Column, hint: Column, work: Column) -> Column:
    """The first keyphrase with a noun's ending, else the first one, else the hint, else the work's first eight characters; never empty."""
    endings = "(?:" + "|".join(NOUN_ENDINGS) + ")$"
    noun = F.get(F.filter(keyphrases, lambda k: k.rlike(endings)), F.lit(0))
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(noun, F.get(keyphrases, F.lit(0)), blank(hint), blank(F.substring(work, 1, 8)), F.lit(UNNAMED))


def lexical_tags(df: DataFrame, imagery: Mapping[str, Sequence[str]], emotion: Mapping[str, Sequence[str]]) -> DataFrame:
    """df (library, text, keyphrases, hint, work) with quote, imagery, emotion, concept, type and source; psychology has no imagery, the others no concept."""
    mind = F.col("library") == "psychology"
    none = F.array().cast("array<string>")
    kinds = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))
    return df.withColumns(
        {
            "quote": first_sentence(F.col("text")),
            "imagery": F.when(mind, none).otherwise(lexicon_tags(F.col("text"), imagery, MOST_TAGS)),
            "emotion": lexicon_tags(F.col("text"), emotion, MOST_TAGS),
            "concept": F.when(mind, concept(F.col("keyphrases"), F.col("hint"), F.col("work"))),
            "type": F.element_at(kinds, F.col("library")),
            "source": F.lit("lexical"),
        }
    )


def empty_tags() -> Column:
    """Whether a row's tags give nothing to find it by: psychology needs a concept, others imagery or emotion."""
    return F.when(F.col("library") == "psychology", F.coalesce("concept", F.lit("")) == "").otherwise((F.size("imagery") <= 0) & (F.size("emotion") <= 0))


def refusal(tag: Column, text: Column) -> Column:
    """Why a tag isn't taken: length, character or foreign (not in the text); null where it is."""
    t = F.trim(tag)
    return F.when(t.isNull() | (t == "") | (F.length(t) > LONGEST_TAG), "length").when(t.rlike(FORBIDDEN), "character").when(~F.contains(text, t), "foreign")


def valid_tags(tags: Column, text: Column, limit: int = MOST_TAGS) -> Column:
    """Trimmed tags that nothing speaks against, distinct in order, capped."""
    return F.slice(F.array_distinct(F.transform(F.filter(tags, lambda t: refusal(t, text).isNull()), lambda t: F.trim(t))), 1, limit)


def refused(df: DataFrame, tags: str, text: str, most: int = MOST_REASONS) -> DataFrame:
    """The most frequent reasons for which tags were not taken: reason, n."""
    each = df.select(F.explode(tags).alias("tag"), F.col(text).alias("text")).select(refusal(F.col("tag"), F.col("text")).alias("reason"))
    return each.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(most)


def _placed(texts: DataFrame, returned: DataFrame, batch: str, key: str, **more: Column) -> DataFrame:
    """Returned rows of texts (and more of them and their text), their quote trimmed, and whether their text has it; without the texts, which every further step would have to move."""
    both = returned.join(texts.select(batch, key, "text"), [batch, key])
    return stored(both.select(batch, key, F.trim("quote").alias("quote"), F.contains("text", F.trim("quote")).alias("_own"), *(c.alias(n) for n, c in more.items())), "placed")


def _misplaced(texts: DataFrame, placed: DataFrame, batch: str, key: str) -> DataFrame:
    lost = placed.filter((F.col("quote") != "") & ~F.col("_own")).select(batch, key, "quote")
    # the own text does not hold it, so whatever text of the batch does is another one's
    found = held(lost.select(batch, F.col("quote").alias("name")), texts.select(batch, "text"), [batch]).select(batch, F.col("name").alias("quote")).distinct()
    return lost.join(found, [batch, "quote"], "left_semi").select(batch, key, "quote").distinct()


def _accepted(texts: DataFrame, returned: DataFrame, placed: DataFrame, batch: str, key: str) -> DataFrame:
    asked = texts.groupBy(batch).agg(F.sort_array(F.collect_set(key)).alias("_asked"))
    came = returned.groupBy(batch).agg(F.sort_array(F.collect_set(key)).alias("_came"))
    same = asked.join(came, batch).filter(F.col("_asked") == F.col("_came")).select(batch)
    return same.join(_misplaced(texts, placed, batch, key).select(batch).distinct(), batch, "left_anti")


def misplaced(texts: DataFrame, returned: DataFrame, batch: str = "batch", key: str = "i") -> DataFrame:
    """Rows of returned (batch, i, quote), quotes trimmed, whose quote is not in their own text but in another one of their batch, whatever the size of a batch."""
    return _misplaced(texts, _placed(texts, returned, batch, key), batch, key)


def accepted(texts: DataFrame, returned: DataFrame, batch: str = "batch", key: str = "i") -> DataFrame:
    """Batches that can be taken as a whole: exactly the rows asked for came back, and none has another one's quote."""
    return _accepted(texts, returned, _placed(texts, returned, batch, key), batch, key)


def tagged(texts: DataFrame, returned: DataFrame, fallback: DataFrame, batch: str = "batch", key: str = "i") -> DataFrame:
    """batch, i, quote, tags, source: of accepted batches the rows whose quote is in their text, all others from the rules.

    returned has (batch, i, quote, tags), fallback has the same for every text.
    """
    placed = _placed(texts, returned, batch, key, tags=valid_tags(F.col("tags"), F.col("text")))
    good = placed.join(_accepted(texts, returned, placed, batch, key), batch, "left_semi")
    model = good.filter((F.col("quote") != "") & F.col("_own")).select(batch, key, "quote", "tags", F.lit("llm").alias("source"))
    rest = fallback.join(model.select(batch, key), [batch, key], "left_anti").select(batch, key, "quote", "tags", F.lit("lexical").alias("source"))
    return model.unionByName(rest)


def assembled(pieces: DataFrame, chunk_id: Column, position: str) -> DataFrame:
    """Chunks of pieces with tags: those whose tags are empty go, of pieces with the same id the first stays."""
    kept = pieces.filter(~empty_tags()).withColumn("chunk_id", chunk_id)
    first = kept.groupBy("chunk_id").agg(F.min(position).alias(position))
    return kept.join(first, ["chunk_id", position], "left_semi")
