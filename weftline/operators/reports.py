"""Operators of a run's last steps: cited prose, reasoning steps, representative texts, turns of a session."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from weftline.functions.lexical import ATTEMPT
from weftline.functions.text import filter_ids
from weftline.shipping import arrow_udf

# Citations of a text and steps of a run at most, the coverage that passes, texts of a cluster and their length.
MOST_CITATIONS, MOST_STEPS, PASSES, SHOWN, SHOWN_CHARS = 40, 5, 0.6, 3, 120
_UNCLOSED = re.compile(r"\[\s*\[\s*ev\s*:[^\]]*\]?", re.I)
CITED = StructType().add("clean", StringType()).add("cited", ArrayType(StringType())).add("total", LongType()).add("dropped", ArrayType(StringType()))


def cited(text: Column, pool: Column, most: int = MOST_CITATIONS) -> Column:
    """struct<clean, cited, total, dropped>: ids of the pool become [^1], [^2] and so on; all other markers, unclosed ones too, go and count."""
    attempt = re.compile(ATTEMPT)

    @arrow_udf(CITED)
    def run(text: pa.Array, pool: pa.Array) -> pa.Array:
        out = []
        for t, ids in zip(text.to_pylist(), pool.to_pylist()):
            known, used, dropped = set(ids or ()), [], []

            def number(m: re.Match) -> str:
                if m[1] not in known or len(used) >= most:
                    dropped.append(m[1])
                    return ""
                used.append(m[1])
                return f"[^{len(used)}]"

            clean = attempt.sub(number, t or "")
            dropped += [x.strip() for x in _UNCLOSED.findall(clean)]
            out.append({"clean": _UNCLOSED.sub("", clean), "cited": used, "total": len(used) + len(dropped), "dropped": dropped})
        return pa.array(out, pa.struct([("clean", pa.string()), ("cited", pa.list_(pa.string())), ("total", pa.int64()), ("dropped", pa.list_(pa.string()))]))

    return run(text, pool)


def steps(raw: DataFrame, by: Sequence[str], pool: Column, allusions: Column, limit: int = 8) -> DataFrame:
    """The first MOST_STEPS rows (by, pos, phenomenon, evidence_ids, allusion_ids) of each run, without those that have no phenomenon.

    Evidence is in the pool, allusions are in theirs and no evidence; both distinct, in order, at most `limit`.
    """
    first = raw.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy("pos"))).filter((F.col("_n") <= MOST_STEPS) & (F.trim("phenomenon") != ""))
    evidence, lost = filter_ids(F.col("evidence_ids"), pool, limit)
    allusion, _ = filter_ids(F.col("allusion_ids"), allusions, limit)
    out = first.withColumns({"evidence": evidence, "lost": F.size(lost).cast("long"), "allusion": F.array_except(allusion, evidence)})
    return out.withColumn("step_index", F.row_number().over(W.partitionBy(*by).orderBy("pos")))


def representatives(clusters: DataFrame, texts: DataFrame, by: Sequence[str], limit: int = SHOWN) -> DataFrame:
    """by, cluster_key, texts: of the representative ids in order those that have a text; keywords if none has.

    clusters has (by, cluster_key, ids, keywords), texts has (by, id, text).
    """
    each = clusters.select(*by, "cluster_key", F.posexplode("ids").alias("pos", "id")).join(texts, [*by, "id"])
    found = each.filter("text != ''").groupBy(*by, "cluster_key").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.substring("text", 1, SHOWN_CHARS).alias("t")))), lambda x: x["t"]), 1, limit).alias("texts"))
    return clusters.join(found, [*by, "cluster_key"], "left").select(*by, "cluster_key", F.coalesce("texts", F.slice("keywords", 1, limit)).alias("texts"))


def better_draft(first: Column, second: Column) -> Column:
    """1 if the second draft is kept: where the first's coverage doesn't pass and the second's is higher."""
    return F.when((first < PASSES) & (second > first), 1).otherwise(0)


def captions(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """citations (evidence_id, marker) with a caption out of the evidence's source and author, null where there is none."""
    return citations.join(evidence, "evidence_id", "left").withColumn("caption", F.nullif(F.concat_ws("·", "author", "source"), F.lit("")))


def continued(messages: DataFrame, last: DataFrame, session: str, order: str) -> DataFrame:
    """messages with seq: they go on after the session's last seq, 0 where it has none."""
    n = F.row_number().over(W.partitionBy(session).orderBy(order))
    return messages.join(last, session, "left").withColumn("seq", F.coalesce("last_seq", F.lit(0)) + n).drop("last_seq")


def names_of_works(text: Column) -> Column:
    """Distinct names in 《》, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("《([^》]+)》"), F.lit(1)))


def anchor(line: Column) -> Column:
    """The last four letters of a line's last clause, without the speaker and what is in parentheses."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(line, F.lit("")), r"^[^：:]{1,12}[：:]\s*", ""), r"[（(][^）)]*[）)]", "")
    clauses = F.filter(F.split(bare, "[，。！？；、,.!?;\\s]+"), lambda c: F.trim(c) != "")
    tail = F.coalesce(F.get(clauses, F.size(clauses) - 1), bare)
    return F.right(F.regexp_replace(tail, r"[^\p{L}\p{N}]", ""), F.lit(4))


def payload(df: DataFrame, *columns: str) -> Column:
    """JSON without null and empty fields."""
    return F.to_json(F.struct(*(F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns)))
