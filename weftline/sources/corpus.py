"""Corpus files: one JSON object a line, three dialects that become one chunk table, and weighted edges.

Blank lines and lines that begin with // are skipped. Wrong rows are told with file and line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.graph import NODE_TYPES, RELATIONS

# Fields that each library's rows must have, the shortest text, and the fields of a dialect by those of a chunk.
REQUIRED = {
    "psychology": ("chunk_id", "discipline", "concept", "source", "author", "text"),
    "literature": ("chunk_id", "book", "character", "imagery", "emotion", "text"),
    "poetry": ("chunk_id", "poem_title", "author", "dynasty", "imagery", "emotion", "text"),
}
SHORTEST = 8
WORK = {"psychology": "source", "literature": "book", "poetry": "poem_title"}
_TEXTS = ("chunk_id", "text", "type", "author", "chapter", "character", "dynasty", "discipline", "concept", "context", "source", "book", "poem_title", "year")
_LISTS = ("imagery", "emotion", "keywords")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line and value of every line; lines are counted in parallel and added up by part."""
    raw = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_i"), "value")
    parts = raw.groupBy("file", "_at").agg(F.count("*").alias("n"), F.min("_i").alias("_first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("file", "_at", "_first", before.alias("_before"))
    return raw.join(starts, ["file", "_at"]).select("file", (F.col("_i") - F.col("_first") + F.col("_before") + 1).alias("line"), "value")


def objects(lines: DataFrame) -> DataFrame:
    """file, line, value and obj (a variant, null where the line is no JSON object)."""
    real = lines.withColumn("value", F.trim("value")).filter((F.col("value") != "") & ~F.col("value").startswith("//"))
    obj = F.try_parse_json("value")
    return real.withColumn("obj", F.when(F.schema_of_variant(obj).startswith("OBJECT"), obj))


def _text(name: str) -> Column:
    return F.try_variant_get("obj", f"$.{name}", "string")


def _list(name: str) -> Column:
    """A list of strings; a lone string is a list of one."""
    one = F.try_variant_get("obj", f"$.{name}", "string")
    return F.coalesce(F.try_variant_get("obj", f"$.{name}", "array<string>"), F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))


def _work(library: str) -> Column:
    bare = F.regexp_replace(_text(WORK[library]), "^《|》$", "")
    return F.split(F.split(bare, "·").getItem(0), "》").getItem(0) if library == "psychology" else bare


def chunks(lines: DataFrame, library: str) -> DataFrame:
    """The library's chunks, with error: what is wrong with the row, null if nothing is."""
    o = objects(lines)
    missing = F.filter(F.array(*(F.when(F.coalesce(F.trim(_text(f)), F.lit("")) == "", F.lit(f)) for f in REQUIRED[library])), lambda x: x.isNotNull())
    same = F.count("*").over(W.partitionBy("chunk_id")) > 1
    rows = o.select("file", "line", F.lit(library).alias("library"), *(_text(f).alias(f) for f in _TEXTS), *(_list(f).alias(f) for f in _LISTS), F.col("obj").isNull().alias("_bad"), missing.alias("_missing"), _work(library).alias("work"))
    what = (
        F.when(F.col("_bad"), "no JSON object")
        .when(F.size("_missing") > 0, F.concat(F.lit("missing "), F.array_join("_missing", ", ")))
        .when(~F.contains("chunk_id", F.lit(":")), "chunk_id without a colon")
        .when(F.length("text") < SHORTEST, "text is too short")
        .when(same, "chunk_id is not unique")
    )
    return rows.withColumn("error", F.when(what.isNotNull(), F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit(" "), what))).drop("_bad", "_missing")


def load(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The chunks of all libraries; the first wrong row, or an id that two libraries have, stops it."""
    parts = [chunks(numbered_lines(spark, p), library) for library, p in paths.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    wrong = out.filter("error is not null").orderBy("file", "line").select("error").first()
    if wrong:
        raise ValueError(wrong["error"])
    twice = out.groupBy("chunk_id").agg(F.countDistinct("library").alias("n")).filter("n > 1").orderBy("chunk_id").first()
    if twice:
        raise ValueError(f"{twice['chunk_id']} is in more than one library")
    return out.drop("error", "file", "line")


def edges(lines: DataFrame) -> DataFrame:
    """source, source_type, target, target_type, relation, weight (1.0 where absent) and error."""
    rows = objects(lines).select("file", "line", *(_text(c).alias(c) for c in ("source", "source_type", "target", "target_type", "relation")), F.coalesce(F.try_variant_get("obj", "$.weight", "double"), F.lit(1.0)).alias("weight"))
    what = F.when(~F.col("source_type").isin(*NODE_TYPES) | ~F.col("target_type").isin(*NODE_TYPES), "unknown node type").when(~F.col("relation").isin(*RELATIONS), "unknown relation").when(F.col("source").isNull() | F.col("target").isNull(), "missing end")
    return rows.withColumn("error", F.when(what.isNotNull(), F.concat_ws(" ", F.concat_ws(":", "file", "line"), what)))
