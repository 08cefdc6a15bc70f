"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of BLOCK_ROWS documents in a fixed pseudo-random
order. With weight w its i-th block (from 0) is released at slot floor(i / w) and
due by slot ceil((i + 1) / w); every slot goes to the released block with the
earliest deadline. Times are compared in whole numbers in exactly the proportions of
the weights, nothing is rounded to a period; until the first source ends, each source
has had less than one block more or less than its weight's share of the slots, however
many slots there are and however small the weight. When a source ends, the others go
on with their weights in proportion, as a new phase. No document is dropped or repeated.

The driver deals the slots from weights and numbers of blocks and sends whose each slot
is, one byte for BLOCK_ROWS documents with up to 256 sources and two bytes with more.

Documents are numbered inside (source, bucket) groups of about BUCKET_ROWS rows
and by running totals of the buckets, so a source with most of the rows is no
task's whole load.

A null source is a source of its own. Without given weights a source's is the
square root of its rows, which lifts small sources. Sources with no or no positive
weight come after all others, in equal parts. Rows that share a doc_id are
documents each; the order among equal ones means nothing. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import cached_property
from math import lcm, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.common import table
from weftline.shipping import arrow_udf

BLOCK_ROWS, BUCKET_ROWS, PERIOD = 64, 8_192, 1_000


@dataclass
class Schedule:
    """Whose each slot is, as places in names, with the fewest bytes a slot that hold the sources."""

    names: list
    order: np.ndarray

    @cached_property
    def slots(self) -> tuple[np.ndarray, np.ndarray]:
        """The slots source by source, and where those of each source begin."""
        return np.argsort(self.order, kind="stable"), np.cumsum(np.bincount(self.order, minlength=len(self.names))) - np.bincount(self.order, minlength=len(self.names))

    def slot_of(self, source: np.ndarray, block: np.ndarray) -> np.ndarray:
        """The slot of each block of the sources at these places in names."""
        slots, first = self.slots
        return slots[first[source] + block]


def whole(weights: list) -> list[int]:
    """Whole numbers in exactly the proportions of the weights; 0 for no and no positive weight."""
    parts = [Fraction(w) if w and w > 0 else Fraction(0) for w in weights]
    scale = lcm(*(x.denominator for x in parts))
    return [int(x * scale) for x in parts]


def deal(left: list[int], share: list[int]) -> Iterator[int]:
    """The source of each slot until no blocks are left."""
    left = list(left)
    while any(left):
        weight = {k: share[k] for k, n in enumerate(left) if n and share[k]} or {k: 1 for k, n in enumerate(left) if n}
        total = sum(weight.values())
        done = dict.fromkeys(weight, 0)
        release = [(0, k) for k in weight]
        ready: list = []
        now = 0
        while True:
            while release and release[0][0] <= now:
                _, k = heapq.heappop(release)
                heapq.heappush(ready, (-(-(done[k] + 1) * total // weight[k]), k))
            _, k = heapq.heappop(ready)
            yield k
            now += 1
            done[k] += 1
            left[k] -= 1
            if not left[k]:
                break
            heapq.heappush(release, (done[k] * total // weight[k], k))


def schedule(blocks: dict, weights: dict) -> Schedule:
    names = sorted(blocks, key=lambda s: (s is None, s))
    n = [blocks[s] for s in names]
    order = deal(n, whole([weights.get(s) for s in names]))
    return Schedule(names, np.fromiter(order, np.min_scalar_type(max(0, len(names) - 1)), sum(n)))


def mixed(docs: DataFrame, weights: dict | None = None, source: str = "source", key: str = "doc_id", block_rows: int = BLOCK_ROWS, period: int = PERIOD) -> DataFrame:
    """docs with source_block (its block within the source), mix_slot and mix_pos; sorted by mix_pos, docs are the mixture.

    Columns of docs that have these three names are replaced. period has no effect any more: weights are kept exactly.
    """
    spark = docs.sparkSession
    docs = docs.drop("source_block", "mix_slot", "mix_pos")
    own = {x: next(n for n in (f"mix_{x}" + "_" * k for k in range(1, 99)) if n not in docs.columns) for x in ("h", "bucket", "n", "s", "b", "start", "in")}
    total = docs.count()
    buckets = max(1, -(-total // BUCKET_ROWS))
    # all columns, so that rows without an id and rows that share one are dealt out too
    every = [f.name for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    dealt = docs.withColumn(own["h"], F.xxhash64(key, *every)).withColumn(own["bucket"], F.pmod(own["h"], F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy(source, own["bucket"]).agg(F.count("*").alias(own["n"]))
    before = F.sum(own["n"]).over(W.partitionBy(source).orderBy(own["bucket"]).rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select(F.col(source).alias(own["s"]), F.col(own["bucket"]).alias(own["b"]), F.coalesce(before, F.lit(0)).alias(own["start"]))
    rows = {r[0]: r[1] for r in docs.groupBy(source).agg(F.count("*")).collect()}  # a row for each source
    plan = schedule({s: -(-n // block_rows) for s, n in rows.items()}, {s: sqrt(n) for s, n in rows.items()} if weights is None else weights)
    place = {s: k for k, s in enumerate(plan.names)}
    shared = spark.sparkContext.broadcast(plan)  # a byte or two a block

    @arrow_udf("long")
    def slot(of: pa.Array, block: pa.Array) -> pa.Array:
        named = of.dictionary_encode(null_encoding="encode")
        places = np.array([place[s] for s in named.dictionary.to_pylist()], np.int64)
        return pa.array(shared.value.slot_of(places[named.indices.to_numpy()], block.to_numpy(zero_copy_only=False)), pa.int64())

    within = F.row_number().over(W.partitionBy(source, own["bucket"]).orderBy(own["h"], key)) - 1
    numbered = dealt.withColumn(own["n"], within).join(starts, F.col(source).eqNullSafe(F.col(own["s"])) & (F.col(own["bucket"]) == F.col(own["b"])))
    index = F.col(own["start"]) + F.col(own["n"])
    placed = numbered.withColumn("source_block", F.floor(index / block_rows).cast("long")).withColumn(own["in"], index % block_rows)
    placed = placed.withColumn("mix_slot", slot(source, "source_block")).withColumn("mix_pos", F.col("mix_slot") * block_rows + F.col(own["in"]))
    return placed.select(*docs.columns, "source_block", "mix_slot", "mix_pos")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents").select("doc_id", "source"))
