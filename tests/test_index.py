"""The stored vector index: what it reads, its recall, and odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators.index import VectorIndex
from weftline.operators.vectors import top_k


def clustered(spark, n, seed=3, dim=16):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(40, dim))
    v = middle[rng.integers(0, 40, n)] + 0.4 * rng.normal(size=(n, dim))
    return spark.createDataFrame([(k, "ab"[k % 2], x.tolist()) for k, x in enumerate(v)], "chunk_id long, library string, v array<double>")


def test_recall_and_pruning(spark, tmp_path):
    rows = clustered(spark, 3000)
    index = VectorIndex.build(rows, f"file://{tmp_path}/i", 16)
    assert 40 <= index.lists <= 60
    q = rows.filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("v").alias("q"), "library")
    exact = {(r["query_id"], r["chunk_id"]) for r in top_k(q, rows, 10, library=True).collect()}
    found = index.search(q, 10, probes=8, library=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in [x for x in plan.split("\n") if "/data" in x][0]
    assert len(exact & {(r["query_id"], r["chunk_id"]) for r in found.collect()}) >= 0.9 * len(exact)
    one = index.search(q.filter("library = 'a' and query_id = 0"), 10, probes=2, library=True)
    pairs = index.probed(q.filter("query_id = 0"), 2, True).select("library", "list").collect()
    read = [r[0] for r in index.partitions({(r["library"], r["list"]) for r in pairs}).select(F.input_file_name()).distinct().collect()]
    assert read and all("library=a" in f for f in read) and {int(f.split("list=")[1].split("/")[0]) for f in read} <= {r["list"] for r in pairs}
    assert one.count() == 10
    # with all lists a search is exact, whatever the parts of a list
    whole = sorted(map(tuple, index.search(q, 10, library=True).collect()))
    assert whole == sorted(map(tuple, top_k(q, rows, 10, library=True).collect()))
    assert VectorIndex(spark, index.path).lists == index.lists


def test_large_lists_are_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("weftline.operators.index.PART", 64)
    rows = clustered(spark, 400).withColumn("library", F.lit("a"))
    same = rows.withColumn("v", F.when(F.col("chunk_id") % 3 == 0, F.array(*(F.lit(1.0) for _ in range(16)))).otherwise(F.col("v")))
    q = same.filter("chunk_id < 5").select(F.col("chunk_id").alias("query_id"), F.col("v").alias("q"))
    index = VectorIndex.build(same, f"file://{tmp_path}/i", 16)
    assert sorted(map(tuple, index.search(q, 7).collect())) == sorted(map(tuple, top_k(q, same.drop("library"), 7).collect()))


def test_odd_vectors(spark, tmp_path):
    ddl = "chunk_id long, library string, v array<double>, rank int"
    rows = [(1, None, [1.0, 0.0], 0), (1, None, [1.0, 0.0], 0), (2, "x", None, 0), (3, "x", [0.0, 0.0], 0), (4, "x", [float("nan"), 1.0], 0), (5, "x", [None, 1.0], 0), (6, "x", [0.0, 2.0], 0), (7, "x", [float("inf"), 1.0], 0)]
    index = VectorIndex.build(spark.createDataFrame(rows, ddl), f"file://{tmp_path}/i", 2)
    q = spark.createDataFrame([(1, None, [1.0, 0.1]), (2, "x", [1.0, 0.1]), (3, "none", [1.0, 0.0]), (4, "x", None)], "query_id long, library string, q array<double>")
    assert sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in index.search(q, 3, library=True).collect()) == [(1, 1, 1), (1, 2, 1), (2, 1, 6)]
    assert sorted((r["query_id"], r["chunk_id"]) for r in index.search(q.filter("query_id = 3"), 3).collect()) == [(3, 1), (3, 1), (3, 6)]
    with pytest.raises(Exception, match="dimensions"):
        VectorIndex.build(spark.createDataFrame([(1, "x", [1.0])], "chunk_id long, library string, v array<double>"), f"file://{tmp_path}/j", 2)
    none = VectorIndex.build(spark.createDataFrame([], ddl), f"file://{tmp_path}/k", 2)
    assert none.search(q, 3).count() == 0
