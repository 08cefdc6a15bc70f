"""MinHash near-dedup with sequential Bayesian verification.

1. Each text gives its number of distinct word shingles, a digest of the set and
   a signature of BANDS x ROWS minhashes. Texts with equal sets form a class, which
   goes on as one node, so exact copies never meet each other.
2. Bands put classes into buckets. In each bucket every class is first compared
   with the bucket's leader alone, its smallest id, which is more often the text that
   others were copied from; after the links found are joined into
   components, only classes of one bucket that are still in different
   components are compared with each other, and of these only pairs that a bound
   allows: each set has a map of MAP_BITS bits, one for each residue that a hash of
   the set has; where two maps differ, the sets do, so p differing bits leave a
   similarity of (a + b - p) / (a + b + p) at most for sets of a and b shingles. The
   bound is part of the join, so a large group of texts that are alike, but not
   enough, gives few pairs, and no link is lost. A bucket of more than PART classes is
   compared part by part, each two parts in a group of their own.
3. A pair's signatures are compared batch by batch. With a uniform prior, the
   posterior that the similarity reaches the threshold after m of n matches is
   P(Binomial(n + 1, threshold) <= m); a pair is dropped as soon as that is under
   MISS. Survivors are confirmed on their full shingle sets.

At similarity 0.8 a pair shares no band with probability 5e-5 and is dropped by
the bounds with at most about 5 * MISS.

Null and empty texts and texts of white space have an empty set and are linked
with nothing: their component is their own id. Rows that share a doc_id but not their
text are linked each by its own text, and only so. Rows with a null doc_id keep to
themselves: component_id is null and kept is true. Ties need no rule: the smallest id
stands for a component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import stored, struct_array, table
from weftline.operators.components import components
from weftline.shipping import arrow_udf

BANDS, ROWS = 25, 5
#: Posterior under which a pair is dropped.
MISS = 1e-6
#: Minhashes compared at a time, and bits in a set's map.
STEP, MAP_BITS = 25, 1024
#: Classes of a bucket that are compared in one group.
PART = 2_000
_CHUNK = 4096  # shingles hashed together

_U = np.uint64


@lru_cache(1)
def _seeds() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240601)
    n = BANDS * ROWS
    return r.integers(1, 2**63, n, dtype=np.uint64) * _U(2) + _U(1), r.integers(0, 2**63, n, dtype=np.uint64)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; A-Z lower-cased, words between ASCII white space."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    h = np.full(max(1, n - width + 1), min(n, width), np.uint64)
    for k in range(min(n, width)):
        h = (h ^ w[k : k + len(h)]) * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    return np.unique(h ^ (h >> _U(29)))


def signature(hashes: np.ndarray) -> np.ndarray:
    a, b = _seeds()
    out = np.full(len(a), 2**32 - 1, np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        out = np.minimum(out, ((hashes[at : at + _CHUNK, None] * a + b) >> _U(32)).min(0))
    return out.astype("<u4")


def bit_map(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(MAP_BITS, bool)
    bits[(hashes % _U(MAP_BITS)).astype(np.int64)] = True
    return np.packbits(bits).view(">i8").astype(np.int64)


def sketch(text: Column | str, width: int) -> Column:
    """struct<n_shingles, set_key, sig, bits>; all but the first are null for an empty set."""

    @arrow_udf("n_shingles long, set_key binary, sig binary, bits array<long>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            n, key, sig, bits = [], [], [], []
            for x in batch:
                h = shingles(x.as_py(), width)
                n.append(len(h))
                key.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                sig.append(signature(h).tobytes() if len(h) else None)
                bits.append(bit_map(h) if len(h) else None)
            yield struct_array(n_shingles=pa.array(n, pa.int64()), set_key=pa.array(key, pa.binary()), sig=pa.array(sig, pa.binary()), bits=pa.array(bits, pa.list_(pa.int64())))

    return run(text)


@lru_cache(8)
def least_matches(threshold: float, miss: float, n: int) -> int:
    """The fewest matches of n with which a pair goes on."""
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n + 1


def passes(a: Column | str, b: Column | str, threshold: float, miss: float = MISS) -> Column:
    """Whether the pair outlives every batch of its signatures."""

    @arrow_udf("boolean")
    def test(left: pa.Array, right: pa.Array) -> pa.Array:
        n = BANDS * ROWS
        x = np.frombuffer(b"".join(left.to_pylist()), "<u4").reshape(-1, n)
        y = np.frombuffer(b"".join(right.to_pylist()), "<u4").reshape(-1, n)
        alive = np.arange(len(x))
        matches = np.zeros(len(x), int)
        for at in range(0, n, STEP):
            matches[alive] += (x[alive, at : at + STEP] == y[alive, at : at + STEP]).sum(1)
            alive = alive[matches[alive] >= least_matches(threshold, miss, min(n, at + STEP))]
        out = np.zeros(len(x), bool)
        out[alive] = True
        return pa.array(out)

    return test(a, b)


def linked(a: Column | str, b: Column | str, percent: int) -> Column:
    """Whether 100 * intersection >= percent * union, on the full sets."""

    @arrow_udf("boolean")
    def test(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(100 * both >= percent * (len(p) + len(q) - both))
        return pa.array(out, pa.bool_())

    return test(a, b)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text)."""
    return labelled(docs, width, percent).select("doc_id", "n_shingles", "component_id", (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"))


def labelled(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, component and component_id of every row of docs (doc_id, text).

    component tells components apart, those with the same smallest id too; it is null where nothing can be linked.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    told = stored(docs.select("doc_id", "text_key", sketch("text", width).alias("s")).select("doc_id", "text_key", "s.*"), "sketches")
    real = told.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    # rows of equal sets have equal signatures
    sigs = real.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("least"), F.first(F.struct("sig", "n_shingles", "bits")).alias("s"))
    sigs = stored(sigs.select("set_key", F.col("least.doc_id").alias("node"), "least", "s.*"), "signatures")
    rows, nodes = sigs.agg(F.count("*"), F.count_distinct("node")).first()
    if rows != nodes:  # an id with two texts: classes go by their digests
        sigs = sigs.withColumn("node", F.col("set_key"))
    bands = F.array(*(F.xxhash64(F.lit(b), F.substring("sig", 4 * ROWS * b + 1, 4 * ROWS)) for b in range(BANDS)))
    banded = sigs.select("node", F.explode(bands).alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("leader")).filter("n > 1").drop("n")
    bucket = stored(banded.join(shared, "band"), "buckets")

    wanted = bucket.select("node").distinct().join(sigs.select("node", "least.*"), "node")
    texts = docs.join(wanted, ["doc_id", "text_key"]).select("node", shingle_set("text", width).alias("shingles"))
    sets = stored(texts.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are links."""
        left, right = (sigs.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
        likely = pairs.join(left, "a").join(right, "b").filter(passes("sig_a", "sig_b", percent / 100)).select("a", "b")
        left, right = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
        return stored(likely.join(left, "a").join(right, "b").filter(linked("set_a", "set_b", percent)).select("a", "b"), "links")

    first = confirmed(bucket.filter("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct())
    label = components(first)
    placed = stored(bucket.select("band", "node").join(label, "node", "left").select("band", "node", F.coalesce("component", "node").alias("c")), "placed")
    open_ = placed.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min("node").alias("leader"), F.ceil(F.count("*") / PART).cast("int").alias("parts")).filter("low != high").select("band", "leader", "parts")
    words = range(MAP_BITS // 64)
    maps = sigs.select("node", "n_shingles", *(F.col("bits")[k].alias(f"w{k}") for k in words))
    each = placed.join(open_, "band").join(maps, "node").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # each two parts of a bucket meet in one group: (their lower, their upper) part
    as_left = each.select("*", F.explode(F.sequence("part", F.col("parts") - 1)).alias("upper")).withColumn("lower", F.col("part"))
    as_right = each.select("*", F.explode(F.sequence(F.lit(0), "part")).alias("lower")).withColumn("upper", F.col("part"))
    left, right = (df.select(*(F.col(c).alias(f"{c}_{x}") for c in ("band", "lower", "upper", "leader", "node", "c", "n_shingles", *(f"w{k}" for k in words)))) for x, df in (("a", as_left), ("b", as_right)))
    differ = sum((F.bit_count(F.col(f"w{k}_a").bitwiseXOR(F.col(f"w{k}_b"))) for k in words), F.lit(0))
    both = F.col("n_shingles_a") + F.col("n_shingles_b")
    met = (F.col("band_a") == F.col("band_b")) & (F.col("lower_a") == F.col("lower_b")) & (F.col("upper_a") == F.col("upper_b"))
    new = (F.col("c_a") != F.col("c_b")) & ((F.col("lower_a") != F.col("upper_a")) | (F.col("node_a") < F.col("node_b"))) & (F.col("node_a") != F.col("leader_a")) & (F.col("node_b") != F.col("leader_b"))
    rest = left.join(right, met & new & (100 * (both - differ) >= percent * (both + differ))).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    label = components(first.union(confirmed(rest)))

    named = sigs.select("set_key", "node", F.col("least.doc_id").alias("id")).join(label, "node", "left").select("set_key", "id", F.coalesce("component", "node").alias("component"))
    lowest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = named.join(lowest, "component").select("set_key", F.col("component").alias("_component"), F.col("component_id").alias("_id"))
    out = told.drop("sig", "bits").join(named, "set_key", "left")
    known = F.col("doc_id").isNotNull()
    return out.select("doc_id", "text_key", "n_shingles", F.when(known, F.col("_component")).alias("component"), F.when(known, F.coalesce("_id", "doc_id")).alias("component_id"))


def shingle_set(text: Column | str, width: int) -> Column:
    """The distinct shingles' hashes, sorted, 8 bytes each."""

    @arrow_udf("binary")
    def run(batch: pa.Array) -> pa.Array:
        return pa.array([shingles(x.as_py(), width).tobytes() for x in batch], pa.binary())

    return run(text)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)
