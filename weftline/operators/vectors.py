"""Exact vector search and semantic dedup, by products of blocks of vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.components import components
from weftline.shipping import ship

#: Vectors in a block of rows, and of queries.
BLOCK, QUERY_BLOCK = 4_096, 1_024


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of length one, as rows; zero vectors stay."""
    a = column.combine_chunks()
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    x = a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1)
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(size > 0, size, 1)


def top_k(queries: DataFrame, chunks: DataFrame, k: int, library: bool = False) -> DataFrame:
    """query_id, rank, chunk_id, score: the k chunks of highest cosine; with library only those of the query's library.

    queries (query_id, q, library) are a stated set, chunks (chunk_id, v, library) all rows; both come in blocks, as many
    as their rows need. A pair of blocks keeps its best k for each query before the best of all are taken.
    """
    ship(chunks.sparkSession)
    by = ["library"] if library else []
    parts, groups = max(1, -(-chunks.count() // BLOCK)), max(1, -(-queries.count() // QUERY_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = chunks.filter("v is not null").select(*by, "chunk_id", "v", F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int").alias("part"), every(groups).alias("group"))
    q = queries.filter("q is not null").select(*by, "query_id", "q", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("group"), every(parts).alias("part"))

    def best(asks: pa.Table, rows: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if len(asks) and len(rows):
            ids = np.array(rows["chunk_id"].to_pylist(), object)
            order = np.argsort(ids, kind="stable")
            scores = np.round(_unit(asks["q"]) @ _unit(rows["v"].take(pa.array(order))).T, 9)
            for name, s in zip(asks["query_id"].to_pylist(), scores):
                least = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -2.0
                some = np.flatnonzero(s >= least)
                some = some[np.argsort(-s[some], kind="stable")][:k]
                for out, x in zip(found, ([name] * len(some), ids[order[some]].tolist(), s[some].tolist())):
                    out.extend(x)
        return pa.table({"query_id": pa.array(found[0], asks.schema.field("query_id").type), "chunk_id": pa.array(found[1], rows.schema.field("chunk_id").type), "score": pa.array(found[2], pa.float64())})

    kinds = ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n, df in (("query_id", queries), ("chunk_id", chunks)))
    some = q.groupBy(*by, "part", "group").cogroup(c.groupBy(*by, "part", "group")).applyInArrow(best, f"{kinds}, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return some.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def similar_pairs(rows: DataFrame, threshold: float, by: Sequence[str] = (), key: str = "id", vector: str = "v") -> DataFrame:
    """by, a, b, similarity of the pairs a < b of one group whose cosine is over the threshold (not equal to it).

    A group's rows fall into blocks of about BLOCK, as many as it has rows for, and each two blocks are multiplied in a task
    of their own, so a large group is many tasks; only pairs over the threshold leave them.
    """
    ship(rows.sparkSession)
    by = list(by)
    unit = rows.filter(F.col(vector).isNotNull()).select(*by, F.col(key).alias("id"), F.col(vector).alias("v"))
    sizes = unit.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    sized = (unit.join(sizes, by) if by else unit.crossJoin(sizes)).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))  # without groups sizes is one row
    left = sized.select(*by, "id", "v", F.col("part").alias("lower"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("upper"))
    right = sized.select(*(F.col(c).alias(c) for c in (*by, "id", "v")), F.explode(F.sequence(F.lit(0), "part")).alias("lower"), F.col("part").alias("upper"))
    fields = rows.select(*by).schema.fields

    def product(key_: tuple, one: pa.Table, two: pa.Table) -> pa.Table:
        a = b = np.zeros(0, object)
        score = np.zeros(0)
        if len(one) and len(two):
            x, y = np.array(one["id"].to_pylist(), object), np.array(two["id"].to_pylist(), object)
            s = _unit(one["v"]) @ _unit(two["v"]).T
            at, to = np.nonzero(s > threshold)
            keep = x[at] < y[to] if key_[-2].as_py() == key_[-1].as_py() else np.ones(len(at), bool)
            at, to = at[keep], to[keep]
            swap = x[at] > y[to]
            a, b, score = np.where(swap, y[to], x[at]), np.where(swap, x[at], y[to]), s[at, to]
        kind = one.schema.field("id").type
        groups = {f.name: pa.array([k.as_py()] * len(a), one.schema.field(f.name).type) for f, k in zip(fields, key_)}
        return pa.table({**groups, "a": pa.array(a.tolist(), kind), "b": pa.array(b.tolist(), kind), "similarity": pa.array(score)})

    kind = rows.schema[key].dataType.simpleString()
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"a {kind}", f"b {kind}", "similarity double"])
    return left.groupBy(*by, "lower", "upper").cogroup(right.groupBy(*by, "lower", "upper")).applyInArrow(product, schema)


def semantic_dedup(rows: DataFrame, threshold: float, likes: str, by: Sequence[str] = (), key: str = "id", vector: str = "v") -> DataFrame:
    """key, component, representative, is_representative: groups of alike rows; the most liked one stands for a group, then the smallest key."""
    label = components(similar_pairs(rows, threshold, by, key, vector))
    each = rows.join(label.withColumnRenamed("node", key), key, "left").withColumn("component", F.coalesce("component", key))
    best = each.groupBy("component").agg(F.min(F.struct((-F.col(likes)).alias("l"), F.col(key).alias("k"))).alias("b")).select("component", F.col("b.k").alias("representative"))
    return each.join(best, "component").select(key, "component", "representative", (F.col(key) == F.col("representative")).alias("is_representative"))
