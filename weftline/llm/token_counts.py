"""Token counts: batch encoding in Arrow functions that return lengths only.

A task's texts go to the library in batches of about BATCH_BYTES of UTF-8, whatever
the number of texts. A text longer than LONG_BYTES is split at safe boundaries: before
an ASCII white-space character that follows a character other than white space.
Byte-level BPE never joins across such a place, so the lengths of the parts add up
to the length of the text; a long text counts as several items and batches stay
balanced. Only a stretch without white space can make a part longer than that.

Null and empty texts have 0 bytes and 0 tokens. Repeated rows give repeated
results, an empty table an empty one; other columns are not touched.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import table
from weftline.shipping import arrow_udf

#: Bytes in one batch of the library, and in a part of a text.
BATCH_BYTES, LONG_BYTES = 1 << 20, 1 << 16

_SAFE = re.compile(r"(?<=\S)(?=[ \t\n\r\f\v])")
ADJOINING = re.compile(r"\s ")
_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The library's tokenizer, without truncation and padding, one per process."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def pieces(text: str) -> list[str]:
    """The text's pieces, as small as safe boundaries make them; together they are the text."""
    if not text:
        return []
    if ADJOINING.search(text):
        return _SAFE.split(text)
    first, *rest = text.split(" ")
    return ([first] if first else []) + [" " + x for x in rest]


def parts(text: str, most: int) -> Iterator[str]:
    """The text cut at the first safe boundary after every `most` characters."""
    at = 0
    while len(text) - at > most:
        cut = _SAFE.search(text, at + most)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def batched(items: Iterable[tuple[int, str, int]], most: int = BATCH_BYTES) -> Iterator[tuple[list[int], list[str]]]:
    """Batches of (owner, text, bytes) items, in order, each of about `most` bytes: owners and texts."""
    owners: list[int] = []
    texts: list[str] = []
    size = 0
    for owner, text, n in items:
        if texts and size + n > most:
            yield owners, texts
            owners, texts, size = [], [], 0
        owners.append(owner)
        texts.append(text)
        size += n
    if texts:
        yield owners, texts


def encode_batches(t, items: list[str]) -> Iterator[tuple[str, object]]:
    """(text, encoding) of each item, encoded in batches of about BATCH_BYTES."""
    for _, batch in batched((0, x, len(x.encode())) for x in items):
        yield from zip(batch, t.encode_batch_fast(batch, add_special_tokens=False))


def count_tokens(path: str, texts: pa.Array, batch_bytes: int = BATCH_BYTES, long_bytes: int = LONG_BYTES) -> np.ndarray:
    """The number of tokens of each text."""
    t = tokenizer(path)
    out = np.zeros(len(texts), np.int64)

    def items() -> Iterator[tuple[int, str, int]]:
        for k, (text, n) in enumerate(zip(texts, pc.binary_length(texts).to_pylist())):
            if not n:
                continue
            x = text.as_py()
            if n <= long_bytes:
                yield k, x, n
            else:
                # characters of as many bytes as long_bytes on average
                for part in parts(x, max(1, long_bytes * len(x) // n)):
                    yield k, part, len(part.encode())

    for owners, batch in batched(items(), batch_bytes):
        lengths = [len(e) for e in t.encode_batch_fast(batch, add_special_tokens=False)]
        np.add.at(out, owners, lengths)
    return out


def token_count(text: Column | str, path: str) -> Column:
    """Tokens of each text, long; path is a file of the tokenizers library with byte-level BPE."""

    @arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array(count_tokens(path, a), pa.int64())

    return count(text)


def token_counts(df: DataFrame, path: str, limit: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, n_tokens and over_limit (more than `limit` tokens) of every row."""
    return df.select(
        key,
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        token_count(F.col(text), path).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 512)
