"""Column functions over arrays of numbers, and the hashed n-gram embedding."""

from __future__ import annotations

import hashlib
import math
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from weftline.shipping import arrow_udf, slices

# Weights of character n-grams by length, and the norm under which a vector is empty.
GRAM_WEIGHTS, EMPTY_NORM = ((1, 0.5), (2, 1.0), (3, 0.8)), 1e-12
#: Bytes of texts, and n-grams of them, that are embedded at a time, and n-grams whose hashes a task keeps at most, but for those of one piece.
PIECE, KNOWN_GRAMS = 1 << 18, 1 << 18


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """Of length one; zero vectors stay."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def _hashed(gram: str, dim: int) -> int:
    """Twice the gram's place, one more if it is added."""
    h = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "big")
    return h % dim << 1 | h >> 63


def _embedded(texts: pa.Array, dim: int, known: dict[int, int]) -> pa.Array:
    """A vector for each text. A gram is known by its characters' numbers, from 1 on and of 21 bits each."""
    bare = ["".join(unicodedata.normalize("NFKC", x or "").lower().split()) for x in texts.to_pylist()]
    chars = np.frombuffer("".join(bare).encode("utf-32-le"), np.uint32)
    of = np.repeat(np.arange(len(bare)), [*map(len, bare)])
    sums = np.zeros(len(bare) * dim)
    for n, weight in GRAM_WEIGHTS:
        for at in range(0, len(chars) - n + 1, PIECE):
            end = min(len(chars) - n + 1, at + PIECE)
            code = np.zeros(end - at, np.int64)
            for k in range(n):
                code = code << 21 | (chars[at + k : end + k].astype(np.int64) + 1)
            text = of[at:end]
            whole = text == of[at + n - 1 : end + n - 1]
            each = pa.array(code[whole]).dictionary_encode()
            if len(known) > KNOWN_GRAMS:
                known.clear()
            found = each.dictionary.to_pylist()
            for c in found:
                if c not in known:
                    known[c] = _hashed("".join(chr((c >> 21 * k & 0x1FFFFF) - 1) for k in reversed(range(n))), dim)
            told = np.fromiter(map(known.__getitem__, found), np.int64, len(found))[each.indices.to_numpy()]
            # one after the other, in the order of the text: sums of floats depend on it
            np.add.at(sums, text[whole] * dim + (told >> 1), np.where(told & 1, weight, -weight))
    vectors = sums.reshape(len(bare), dim)
    size = np.array([math.sqrt(sum(x * x for x in v)) for v in vectors.tolist()])
    empty = size < EMPTY_NORM
    vectors /= np.where(empty, 1, size)[:, None]
    vectors[empty] = [1.0] + [0.0] * (dim - 1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(bare) + 1, dtype=np.int32) * dim), pa.array(vectors.reshape(-1)))


def hashed_embedding(text: Column, dim: int) -> Column:
    """Signed, weighted counts of character n-grams in `dim` buckets, of length one; an empty text is the first unit vector."""
    known: dict[int, int] = {}

    @arrow_udf(ArrayType(DoubleType()))
    def embed(batch: pa.Array) -> pa.Array:
        parts = [_embedded(batch.slice(at, n), dim, known) for at, n in slices((batch,), PIECE)]
        return pa.concat_arrays([pa.array([], pa.list_(pa.float64())), *parts])

    return embed(text)
