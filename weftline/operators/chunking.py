"""Long texts cut into pieces: paragraphs, sentences packed to a target length, hard cuts as the last resort.

No text is lost: the bodies of a text's pieces, without white space, are the text without white space.
The cleaning is built-in expressions; the packing depends on what came before, so it is a small Python
function over Arrow batches, one text at a time.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from weftline.functions.lexical import cjk_share, lossless
from weftline.shipping import arrow_udf, ship, sliced, slices

# Lengths of pieces and of the overlap, the shortest text, the marks that end a sentence or a clause,
# the lengths of streamed deltas, and the prefix of each library's ids.
TARGET, MOST, LEAST, OVERLAP, SHORTEST = 350, 600, 60, 80, 8
FOREIGN, CUTS, SHORT_TEXT = 0.3, 0.2, 200
SENTENCE_END, CLAUSE_END = "。！？；…!?;", "，、,"
DELTA_SIZE, DELTA_FLOOR, DELTA_END = 40, 12, "。！？…；\n"
PREFIX = {"psychology": "psy", "literature": "lit", "poetry": "poem"}

_CJK = re.compile("[㐀-䶿一-鿿　-〿＀-￯]")
PIECE = StructType().add("paragraph", IntegerType()).add("text", StringType()).add("body", StringType()).add("hard", BooleanType())


def ended(text: str, marks: str) -> list[str]:
    """Parts that end with a run of marks, and what is left."""
    return re.findall(f"[^{re.escape(marks)}]*[{re.escape(marks)}]+|[^{re.escape(marks)}]+$", text)


def paragraphs(text: str) -> Iterator[str]:
    """Parts between empty lines; broken lines are put together, with a space only between two that aren't Chinese."""
    for block in text.split("\n\n"):
        whole = ""
        for line in filter(None, block.split("\n")):
            gap = " " if whole and not (_CJK.match(whole[-1]) or _CJK.match(line[0])) else ""
            whole += gap + line
        if whole:
            yield whole


def _units(paragraph: str, most: int, overlap: int) -> Iterator[tuple[str, int, bool]]:
    """(body, characters of the text before it to show again, whether it was cut hard), none longer than most."""
    for sentence in ended(paragraph, SENTENCE_END):
        for part in [sentence] if len(sentence) <= most else ended(sentence, CLAUSE_END):
            if len(part) <= most:
                yield part, 0, False
            else:
                for at in range(0, len(part), most):
                    yield part[at : at + most], min(at, overlap), True


def packed(units: Iterable[tuple[str, int, bool]], target: int, most: int) -> list[list[tuple[str, int, bool]]]:
    """Units in groups that end once they reach the target, and before they would pass the most."""
    out: list[list[tuple[str, int, bool]]] = []
    size = most + 1
    for unit in units:
        if size >= target or size + len(unit[0]) > most:
            out.append([])
            size = 0
        out[-1].append(unit)
        size += len(unit[0])
    return out


def pieces(text: str, target: int = TARGET, most: int = MOST, least: int = LEAST, overlap: int = OVERLAP) -> list[tuple[int, str, str, bool]]:
    """(paragraph, text, body, hard) of a cleaned text; a text differs from its body by the overlap before a hard cut."""
    if len(text) < SHORTEST:
        return []
    out: list[tuple[int, str, str, bool]] = []
    for n, paragraph in enumerate(paragraphs(text)):
        if len(paragraph) <= most:
            out.append((n, paragraph, paragraph, False))
            continue
        groups = packed(_units(paragraph, most, overlap), target, most)
        if len(groups) > 1:
            last, before = (sum(len(u[0]) for u in g) for g in (groups[-1], groups[-2]))
            if last < least and last + before <= most:
                tail = groups.pop()
                groups[-1] += tail
        at = 0
        for group in groups:
            shown = ""
            for body, again, _ in group:
                shown += paragraph[at - again : at] + body
                at += len(body)
            out.append((n, shown, "".join(u[0] for u in group), any(u[2] for u in group)))
    return out


def cut(df: DataFrame, key: str, text: str, target: int = TARGET, most: int = MOST) -> DataFrame:
    """key, piece, paragraph, text, body, hard; texts under SHORTEST characters have no piece."""

    clean = df.select(key, lossless(F.col(text)).alias("_t"))
    ship(df.sparkSession)
    kinds = pa.schema([("piece", pa.int32()), ("paragraph", pa.int32()), ("text", pa.string()), ("body", pa.string()), ("hard", pa.bool_())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices((batch["_t"],)):
                part = batch.slice(at, n)
                rows = [(k, m, *p) for k, t in enumerate(part["_t"].to_pylist()) for m, p in enumerate(pieces(t, target, most) if t is not None else [])]
                place, *columns = zip(*rows) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays([part[key].take(pa.array(place, pa.int64())), *(pa.array(c, f.type) for c, f in zip(columns, kinds))], [key, *kinds.names])

    return clean.mapInArrow(split, StructType([clean.schema[key], StructField("piece", IntegerType()), *PIECE.fields]))


def split_reports(df: DataFrame, key: str, text: str, target: int = TARGET, most: int = MOST) -> DataFrame:
    """key, n_chars, pieces, hard, cjk, warnings and error: what a user is told of a split before anything is kept.

    warnings are `foreign` (a small share of Chinese characters), `cuts` (many pieces cut within a sentence) and `short`;
    error is `empty` for a text under SHORTEST characters, which has no piece and no warnings.
    """

    @arrow_udf("struct<pieces int, hard int>")
    @sliced
    def counted(batch: pa.Array) -> pa.Array:
        every = [pieces(t, target, most) for t in batch.to_pylist()]
        return pa.array([{"pieces": len(x), "hard": sum(p[3] for p in x)} for x in every], pa.struct([("pieces", pa.int32()), ("hard", pa.int32())]))

    clean = df.select(key, lossless(F.col(text)).alias("_t"))
    told = clean.select(key, F.length("_t").alias("n_chars"), cjk_share(F.col("_t")).alias("cjk"), counted("_t").alias("_c")).select(key, "n_chars", "_c.pieces", "_c.hard", "cjk")
    empty = F.col("pieces") == 0
    warnings = F.array_compact(F.array(F.when(F.col("cjk") < FOREIGN, "foreign"), F.when((F.col("hard") > 0) & (F.col("hard") > F.col("pieces") * CUTS), "cuts"), F.when(F.col("n_chars") < SHORT_TEXT, "short")))
    return told.withColumns({"warnings": F.when(empty, F.array().cast("array<string>")).otherwise(warnings), "error": F.when(empty, "empty")})


def deltas(text: str, size: int = DELTA_SIZE, floor: int = DELTA_FLOOR) -> list[str]:
    """The text in small parts that end at a mark or at `size`; no mark between a pair of ** ends one."""
    out, start, bold = [], 0, 0
    for i, c in enumerate(text):
        n = i + 1 - start
        bold = text.count("**", start, i + 1) % 2
        if n >= size or (n >= floor and c in DELTA_END and not bold):
            out.append(text[start : i + 1])
            start = i + 1
    return out + ([text[start:]] if start < len(text) else [])


def streamed(text: Column, size: int = DELTA_SIZE, floor: int = DELTA_FLOOR) -> Column:
    @arrow_udf(ArrayType(StringType()))
    @sliced
    def split(batch: pa.Array) -> pa.Array:
        return pa.array([deltas(t or "", size, floor) for t in batch.to_pylist()], pa.list_(pa.string()))

    return split(text)


def chunk_ids(library: Column, work: Column, body: Column) -> Column:
    """An id that depends on the library, the work's name and the body alone."""

    @arrow_udf(StringType())
    @sliced
    def make(library: pa.Array, work: pa.Array, body: pa.Array) -> pa.Array:
        out = []
        for lib, w, b in zip(library.to_pylist(), work.to_pylist(), body.to_pylist()):
            name = re.sub(r"[《》〈〉\s]", "", unicodedata.normalize("NFKC", w or ""))
            out.append(f"{PREFIX.get(lib, lib)}:imp:{hashlib.blake2b(chr(0).join((lib, name, b)).encode(), digest_size=16).hexdigest()}")
        return pa.array(out, pa.string())

    return make(library, work, body)
