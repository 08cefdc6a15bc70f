"""A stored vector index: vectors in lists around centroids, partitioned by library and list.

The table is a folder with `data/library=.../list=.../*.parquet`, `centroids` and `index.json`. A
search finds each query's nearest lists on the driver's side of the plan, as the
distinct (library, list) pairs of all queries, so that only their partitions are read; vectors are
read from their one place and never copied, the queries (a stated set) go to them. A list that has
many rows is dealt out in parts. With all lists probed a search is exact.

Centroids come from at most SAMPLE vectors, picked by a hash, whatever the number of rows; the number of lists
grows with the square root of the rows up to what the sample can tell apart. All rows are indexed.

Null, zero and non-finite vectors are not indexed; a vector of another number of dimensions ends the job. A null library is a
library of its own. Rows that share an id are rows each. Ties of a score go to the smaller id.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.incremental import of_dimension
from weftline.operators.keyed import Folder
from weftline.operators.storage import stored
from weftline.operators.vectors import _unit
from weftline.shipping import arrow_udf, ship

#: Vectors that centroids are fitted on, vectors of the sample for each list at least, rounds of the fit, and rows of a list that a task looks at together.
SAMPLE, A_LIST, ROUNDS, PART = 20_000, 16, 12, 50_000
#: The partition of a null library.
NONE = "__none__"


def fitted(sample: np.ndarray, lists: int) -> np.ndarray:
    """Spherical k-means: centroids of length one, begun from evenly spaced vectors of the sample."""
    centre = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(ROUNDS):
        nearest = np.argmax(sample @ centre.T, axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, nearest, sample)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        centre = np.where(size > 0, sums / np.where(size > 0, size, 1), centre)
    return centre


class VectorIndex:
    """An index in the folder `path`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        told = json.loads(Folder(spark, path).read("index.json"))
        self.dim, self.lists, self.key, self.schema = told["dim"], told["lists"], told["key"], told["schema"]
        rows = spark.read.parquet(f"{self.path}/centroids").orderBy("list").collect()  # a row for each list
        self.centre = np.array([r["centre"] for r in rows], np.float64).reshape(len(rows), -1)
        self.sizes = {(r["library"], r["list"]): r["n"] for r in spark.read.parquet(f"{self.path}/sizes").collect()}  # a row for each partition

    @classmethod
    def build(cls, rows: DataFrame, path: str, dim: int, lists: int | None = None) -> VectorIndex:
        """The index of rows (chunk_id, library, v) in a folder that is not there yet."""
        spark = rows.sparkSession
        ship(spark)
        usable = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
        kept = of_dimension(rows.select("chunk_id", F.coalesce(F.col("library").cast("string"), F.lit(NONE)).alias("library"), "v"), "v", dim).filter(usable)
        n = kept.count()
        # about twice as many as are wanted, so that no task sends more than its part of them
        share = min(1.0, 2 * SAMPLE / max(1, n))
        some = kept.filter(F.xxhash64("v") <= F.lit(min(2**63 - 1, int(share * 2**64) - 2**63))).select("v", F.xxhash64("v", "chunk_id").alias("h"))
        sample = np.array([r["v"] for r in some.dropDuplicates(["h"]).orderBy("h").limit(SAMPLE).collect()], np.float64).reshape(-1, dim)
        sample /= np.sqrt((sample * sample).sum(1, keepdims=True))
        lists = lists or int(max(1, min(round(n**0.5), len(sample) // A_LIST)))
        centre = fitted(sample, lists) if len(sample) else np.zeros((1, dim))
        lists = len(centre)
        shared = spark.sparkContext.broadcast(centre)  # SAMPLE / A_LIST vectors at most

        @arrow_udf("int")
        def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for a in batches:
                yield pa.array(np.argmax(_unit(pa.chunked_array([a])) @ shared.value.T, axis=1) if len(a) else [], pa.int32())

        placed = kept.withColumn("list", nearest("v"))
        placed.hint("rebalance", "library", "list").write.partitionBy("library", "list").parquet(f"{path}/data")
        key = rows.schema["chunk_id"].dataType.simpleString()
        schema = f"chunk_id {key}, v {rows.schema['v'].dataType.simpleString()}, library string, list int"  # told, so that libraries named by numbers stay texts
        back = spark.read.schema(schema).parquet(f"{path}/data") if n else placed
        back.groupBy("library", "list").agg(F.count("*").alias("n")).write.parquet(f"{path}/sizes")
        spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centre)], "list int, centre array<double>").write.parquet(f"{path}/centroids")
        Folder(spark, path).create("index.json", json.dumps({"dim": dim, "lists": lists, "key": key, "schema": schema}))
        return cls(spark, path)

    def probed(self, queries: DataFrame, probes: int, library: bool) -> DataFrame:
        """query_id, q, library, list: each query at its nearest lists, of its library or of all of them."""
        centre, probes = self.centre, min(probes, self.lists)

        @arrow_udf("array<int>")
        def near(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for a in batches:
                if not len(a):
                    yield pa.array([], pa.list_(pa.int32()))
                    continue
                scores = _unit(pa.chunked_array([a])) @ centre.T
                yield pa.array(np.argsort(-scores, axis=1, kind="stable")[:, :probes].tolist(), pa.list_(pa.int32()))

        libraries = F.array(F.coalesce(F.col("library").cast("string"), F.lit(NONE))) if library else F.array(*(F.lit(x) for x in sorted({x for x, _ in self.sizes}) or [NONE]))
        asked = of_dimension(queries.filter("q is not null"), "q", self.dim)
        return asked.select("query_id", "q", F.explode(libraries).alias("library"), near("q").alias("_near")).withColumn("list", F.explode("_near")).drop("_near")

    def partitions(self, pairs: set[tuple[str, int]]) -> DataFrame:
        """The rows of these (library, list) pairs; other partitions are not read."""
        condition = F.lit(False)
        for name in sorted({x for x, _ in pairs}):
            condition = condition | ((F.col("library") == name) & F.col("list").isin(*sorted(k for x, k in pairs if x == name)))
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/data").filter(condition)

    def search(self, queries: DataFrame, k: int, probes: int | None = None, library: bool = False) -> DataFrame:
        """query_id, rank, chunk_id, score: the k rows of highest cosine in each query's nearest `probes` lists; all lists without probes, which is exact.

        queries (query_id, q, library) are a stated set; with library only rows of the query's library are looked at.
        """
        ship(self.spark)
        asked = stored(self.probed(queries, probes or self.lists, library), "probes")
        pairs = {(r["library"], r["list"]) for r in asked.select("library", "list").distinct().collect()} & set(self.sizes)  # partitions at most
        kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {self.key}, score double"
        if not pairs:
            return self.spark.createDataFrame([], kinds).select("query_id", F.lit(0).alias("rank"), "chunk_id", "score")
        parts = self.spark.createDataFrame([(x, n, -(-self.sizes[x, n] // PART)) for x, n in pairs], "library string, list int, parts int")
        rows = self.partitions(pairs).join(F.broadcast(parts), ["library", "list"]).withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int"))
        asks = asked.join(F.broadcast(parts), ["library", "list"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

        def best(asks: pa.Table, rows: pa.Table) -> pa.Table:
            found: tuple[list, list, list] = ([], [], [])
            if len(asks) and len(rows):
                rows = rows.take(pc.sort_indices(rows["chunk_id"]))
                ids = rows["chunk_id"].to_pylist()
                scores = np.round(_unit(asks["q"]) @ _unit(rows["v"]).T, 9)
                for name, s in zip(asks["query_id"].to_pylist(), scores):
                    least = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -2.0
                    some = np.flatnonzero(s >= least)
                    some = some[np.argsort(-s[some], kind="stable")][:k].tolist()
                    found[0].extend([name] * len(some)), found[1].extend(ids[x] for x in some), found[2].extend(s[some].tolist())
            return pa.table({"query_id": pa.array(found[0], asks.schema.field("query_id").type), "chunk_id": pa.array(found[1], rows.schema.field("chunk_id").type), "score": pa.array(found[2], pa.float64())})

        by = ("library", "list", "part")
        some = asks.select(*by, "query_id", "q").groupBy(*by).cogroup(rows.select(*by, "chunk_id", "v").groupBy(*by)).applyInArrow(best, kinds)
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
        return some.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")
