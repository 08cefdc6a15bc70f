"""Text sources: items of a pasted text, and files of unknown encoding."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weftline.shipping import arrow_udf

# The longest item, the id's form, and the encodings in the order in which they are tried.
ITEM_CHARS, ITEM_ID, ENCODINGS = 2000, "txt-%04d", ("utf-8-sig", "utf-8", "gb18030")
_SEPARATOR = {"line": "\n", "paragraph": "\n[ \t]*\n+"}


def parts(text: Column, mode: str = "line") -> Column:
    """The text's lines or paragraphs, stripped, without empty ones."""
    unix = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    stripped = F.transform(F.split(unix, _SEPARATOR[mode]), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    return F.filter(stripped, lambda p: p != "")


def split_items(df: DataFrame, key: str, text: str, mode: str, limit: int) -> DataFrame:
    """key, item_id, body of the first `limit` items of each row; ids sort as numbers do."""
    items = df.select(key, F.posexplode(F.slice(parts(F.col(text), mode), 1, max(0, limit))).alias("i", "item"))
    return items.select(key, F.format_string(ITEM_ID, F.col("i") + 1).alias("item_id"), F.substring("item", 1, ITEM_CHARS).alias("body"), (F.length("item") > ITEM_CHARS).alias("truncated"))


def split_warnings(df: DataFrame, key: str, text: str, mode: str, limit: int) -> DataFrame:
    """key, total, kept, dropped, cut and warnings of each row's split: empty_text, text_truncated (more items than the limit), text_item_truncated (items that were cut)."""
    found = df.select(key, parts(F.col(text), mode).alias("_p"))
    shown = F.slice("_p", 1, max(0, limit))
    told = found.select(key, F.size("_p").alias("total"), F.size(shown).alias("kept"), F.size(F.filter(shown, lambda p: F.length(p) > ITEM_CHARS)).alias("cut"))
    dropped = F.col("total") - F.col("kept")
    codes = F.array_compact(F.array(F.when(F.col("kept") == 0, "empty_text"), F.when(dropped > 0, "text_truncated"), F.when(F.col("cut") > 0, "text_item_truncated")))
    return told.select(key, "total", "kept", dropped.alias("dropped"), "cut", codes.alias("warnings"))


def decode_bytes(content: bytes | None) -> str | None:
    """The text of a file's bytes, by the first encoding that reads them whole; null if none does."""
    for e in ENCODINGS if content is not None else ():
        try:
            return content.removeprefix(b"\xef\xbb\xbf").decode(e)
        except UnicodeDecodeError:
            continue
    return None


@arrow_udf(StringType())
def decoded(content: pa.Array) -> pa.Array:
    return pa.array([decode_bytes(x.as_py()) for x in content], pa.string())


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, is_zip and text of each file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", (F.substring("content", 1, 2) == F.lit(b"PK")).alias("is_zip"), decoded("content").alias("text"))
