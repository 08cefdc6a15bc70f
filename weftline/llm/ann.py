"""Approximate nearest neighbours by cosine: probed lists with an adaptive dimension scan.

1. Centroids are fitted by k-means on a bounded sample (SAMPLE vectors); there are
   at most MOST_LISTS of them, so they can go to every task. Every vector is
   assigned to its nearest centroid. How many lists a query probes is measured on
   the sample: as many as hold the share AIM of the sample's true neighbours. Vectors
   in clusters need few lists, vectors close to random more than half.
2. A query's nearest list is scanned first; the k-th distance found there goes
   with it as a bound to its other lists.
3. Vectors are turned by one random rotation and kept in column blocks of BLOCK
   dimensions. In a list a query first scores a few vectors exactly; then block by
   block the partial squared distance, scaled to all dimensions, is tested against
   the k-th distance so far: a candidate whose scaled distance exceeds it by the
   factor 1 + EPSILON / sqrt(dimensions seen) is abandoned. Survivors get their
   exact cosine in double precision from the original vectors, summed row by row, so
   that equal vectors have equal scores wherever they are.
4. A list is dealt into parts of about PART rows and the queries that probe it into
   groups of about PART, so no list, however large, is one task's load. Each part
   gives its best k for a query; the best k of these are the result.

Vectors that are null, empty, zero, of another length than most, or that hold null
or non-finite components take no part, as query or candidate. With fewer than k
candidates all are returned. Ties go to the smaller vec_id. Repeated rows are
candidates each; a query's own row is told by vec_id, so rows that share its id
are not its candidates. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.common import sampled, stored, table
from weftline.shipping import ship

#: Vectors that the centroids are fitted on at most; lists at most; the share of true neighbours to have in the probed lists.
SAMPLE, MOST_LISTS, AIM = 20_000, 256, 0.97
#: Vectors of the sample whose neighbours are looked up to set the number of probes.
TRIED = 500
#: Dimensions in a column block, factor of the test, and rows in a part.
BLOCK, EPSILON, PART = 16, 2.1, 8_192
ROUNDS = 10


def usable(vector: str, dims: int) -> Column:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) == dims) & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _matrix(a: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # neither overflow nor underflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit_centroids(x: np.ndarray, lists: int, seed: int = 3) -> np.ndarray:
    """Spherical k-means of unit vectors; an empty list takes the vector farthest from its centroid."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), min(lists, len(x)), replace=False))].copy()
    for _ in range(ROUNDS):
        near = x @ c.T
        at = near.argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        far = np.argsort(near.max(1))
        for k, j in enumerate(np.flatnonzero(np.bincount(at, minlength=len(c)) == 0)):
            sums[j] = x[far[k]]
        length = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), c)
    return c


def rotation(dims: int, seed: int = 5) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))[0]


def lists_to_probe(x: np.ndarray, centroids: np.ndarray, k: int, aim: float = AIM) -> int:
    """The fewest lists, nearest first, that hold the share `aim` of the k nearest of some of the sample's unit vectors."""
    at = (x @ centroids.T).argmax(1)
    ask = np.random.default_rng(9).choice(len(x), min(TRIED, len(x)), replace=False)
    k = min(k, len(x) - 1)
    if k < 1:
        return 1
    turns = np.zeros(len(centroids), np.int64)
    for some in np.array_split(ask, -(-len(ask) // 50)):
        near = x[some] @ x.T
        near[np.arange(len(some)), some] = -2
        best = np.argpartition(-near, k - 1, 1)[:, :k]
        order = np.argsort(-(x[some] @ centroids.T), 1, kind="stable")
        turn = np.empty_like(order)
        np.put_along_axis(turn, order, np.arange(order.shape[1])[None, :], 1)
        turns += np.bincount(np.take_along_axis(turn, at[best], 1).ravel(), minlength=len(turns))
    return int(np.searchsorted(np.cumsum(turns), aim * turns.sum())) + 1


def adaptive_scan(q: np.ndarray, x: np.ndarray, keep: int, block: int = BLOCK, epsilon: float = EPSILON, bound: float = 5.0) -> np.ndarray:
    """Positions in x (rotated unit vectors) that the tests leave for the rotated unit query q: of those with a squared
    distance of `bound` at most, the nearest `keep` are among them."""
    n, dims = x.shape
    if n <= keep:
        return np.arange(n)
    first = min(n, max(4 * keep, 64))
    bound = min(bound + 1e-9, np.partition(((x[:first] - q) ** 2).sum(1), keep - 1)[keep - 1])
    alive = np.arange(n)
    partial = np.zeros(n)
    for at in range(0, dims, block):
        end = min(dims, at + block)
        partial = partial + ((x[alive, at:end] - q[at:end]) ** 2).sum(1)
        if end < dims:
            # a rotated vector's first dimensions are a random sample of its length
            fine = partial * (dims / end) <= bound * (1 + epsilon / np.sqrt(end)) ** 2
        else:
            fine = partial <= bound + 1e-9
        alive, partial = alive[fine], partial[fine]
        if end < dims and len(alive) > 8 * keep:
            best = alive[np.argpartition(partial, keep - 1)[:keep]]
            bound = min(bound, ((x[best] - q) ** 2).sum(1).max())
    return alive


def nearest(vectors: DataFrame, queries: DataFrame, k: int, lists: int | None = None, probes: int | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of queries among the rows of vectors but its own id."""
    spark = vectors.sparkSession
    ship(spark)
    size = vectors.filter(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = size["d"] if size else 0
    base = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter(usable("v", max(1, dims)) & F.col("vec_id").isNotNull())
    ask = queries.select(F.col(key).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("q")).filter(usable("q", max(1, dims)) & F.col("query_id").isNotNull())
    n = base.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    part = min(1.0, SAMPLE / n)
    some = base.filter(sampled(part, "vec_id", "v"))
    sample = some.orderBy("vec_id").select("v").toArrow()
    sample = sample if len(sample) else base.orderBy("vec_id").limit(1).select("v").toArrow()
    lists = lists or int(min(MOST_LISTS, max(1, n // 16)))
    unit = _unit(_matrix(sample["v"], dims))
    centroids = fit_centroids(unit, lists)
    lists = len(centroids)
    probes = max(1, min(lists, probes or lists_to_probe(unit, centroids, k)))
    shared = spark.sparkContext.broadcast((centroids, rotation(dims)))  # MOST_LISTS vectors at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = (_unit(_matrix(b["v"], dims)) @ shared.value[0].T).argmax(1)
                yield pa.RecordBatch.from_pydict({"vec_id": b["vec_id"], "v": b["v"], "list": pa.array(at.astype(np.int32))})

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = _unit(_matrix(b["q"], dims)) @ shared.value[0].T
                at = np.argsort(-near, 1, kind="stable")[:, :probes].astype(np.int32)
                yield pa.RecordBatch.from_pydict({"query_id": b["query_id"], "q": b["q"], "lists": pa.array(list(at), pa.list_(pa.int32()))})

    placed = stored(base.mapInArrow(assign, "vec_id long, v array<double>, list int"), "lists")
    parts = placed.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))  # a row for each list
    asked = stored(ask.mapInArrow(probe, "query_id long, q array<double>, lists array<int>"), "queries")
    ask_n = asked.count()

    def scan(asks, rows):
        out = []
        if len(asks) and len(rows):
            x, ids = _unit(_matrix(rows["v"], dims)), rows["vec_id"].to_numpy()
            turned = x @ shared.value[1]
            q = _unit(_matrix(asks["q"], dims))
            for qid, one, q_turned, least in zip(asks["query_id"].to_pylist(), q, q @ shared.value[1], asks["least"].to_pylist()):
                found = adaptive_scan(q_turned, turned, k + int((ids == qid).sum()), bound=5.0 if least is None else 2 - 2 * least)
                found = found[ids[found] != qid]
                cos = (x[found] * one).sum(1)
                best = np.lexsort((ids[found], -cos))[:k]
                out += [(qid, int(ids[found[j]]), float(cos[j])) for j in best]
        cols = list(zip(*out)) if out else ((), (), ())
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    def scanned(asks: DataFrame, share: float) -> DataFrame:
        """query_id, vec_id, score: the best k of each part for each (query_id, q, list, least)."""
        groups = int(max(1, -(-ask_n * share // (lists * PART))))
        load = placed.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
        load = load.select("list", "part", "vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
        asks = asks.join(F.broadcast(parts), "list").withColumn("group", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(groups)).cast("int"))
        asks = asks.select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "group", "query_id", "q", "least")
        by = ("list", "part", "group")
        return asks.groupBy(*by).cogroup(load.groupBy(*by)).applyInArrow(scan, "query_id long, vec_id long, score double")

    def ranked(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)

    first = stored(ranked(scanned(asked.select("query_id", "q", F.col("lists")[0].alias("list"), F.lit(None).cast("double").alias("least")), 1)), "nearest")
    if probes > 1:
        bounds = first.filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        others = asked.select("query_id", "q", F.explode(F.slice("lists", 2, probes)).alias("list")).join(bounds, "query_id", "left")
        first = ranked(first.drop("rank").unionByName(scanned(others, probes - 1)))
    if probes < lists:
        # queries whose lists hold fewer than k candidates look into all others too
        first = stored(first, "probed")
        enough = first.filter(F.col("rank") == k).select("query_id")
        poor = asked.join(enough, "query_id", "left_anti")
        rest = F.array_except(F.sequence(F.lit(0), F.lit(lists - 1)), "lists")
        others = poor.select("query_id", "q", F.explode(rest).alias("list"), F.lit(None).cast("double").alias("least"))
        first = ranked(first.drop("rank").unionByName(scanned(others, 1)))
    return first.select("query_id", "rank", "vec_id", "score")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return nearest(v, v.filter("vec_id % 50 = 0"), 5)
