"""Keyed tables: what is written, which files stay, and what a job that dies leaves."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weftline.operators import keyed
from weftline.operators.keyed import Conflict, KeyedTable
from weftline.operators.persist import versioned


def made(spark, path, ddl="k long, v string", key=("k",), **more):
    return KeyedTable.create(spark, f"file://{path}", spark.createDataFrame([], ddl).schema, key, buckets=4, **more)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def files(path):
    return {str(p.relative_to(path)) for p in Path(path).rglob("*.parquet")}


def test_upserts_rewrite_touched_buckets_only(spark, tmp_path):
    t = made(spark, tmp_path / "t")
    assert t.version == 0 and rows(t.read()) == []
    first = spark.range(40).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    assert t.upsert(first) == 1
    before = files(tmp_path / "t")
    one = spark.createDataFrame([(7, "b"), (100, "n")], "k long, v string").filter("k = 7")
    assert t.upsert(one) == 2
    bucket = one.select(t._bucket()).first()[0]
    current = {f.split("/data/")[-1] for f in t.read().inputFiles()}
    kept = {f.removeprefix("data/") for f in before if f"_bucket={bucket}/" not in f}
    assert kept <= current and all(f"_bucket={bucket}/" in f for f in current - kept)
    assert rows(t.read()) == sorted([(k, "b" if k == 7 else "a") for k in range(40)], key=repr)
    assert rows(t.read(1)) == rows(first)
    assert t.upsert(one.limit(0)) == 2  # nothing to do, no version
    found = t.lookup(spark.createDataFrame([(7,), (8,), (999,)], "k long"))
    assert rows(found) == [(7, "b"), (8, "a")]
    wanted = {r[0] for r in spark.createDataFrame([(7,), (8,), (999,)], "k long").select(t._bucket()).collect()}
    assert {int(f.split("_bucket=")[1].split("/")[0]) for f in found.inputFiles()} <= wanted


def test_a_dead_job_leaves_the_version_before(spark, tmp_path, monkeypatch):
    t = made(spark, tmp_path / "t")
    t.upsert(spark.createDataFrame([(1, "a"), (2, "a")], "k long, v string"))
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_committed", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            t.upsert(spark.createDataFrame([(1, "b")], "k long, v string"))
    again = KeyedTable(spark, t.path)
    assert again.version == 1 and rows(again.read()) == [(1, "a"), (2, "a")]
    # a version whose file was not finished is none
    (tmp_path / "t/versions/0000000002.json").write_text('{"buckets": {"0"')
    assert again.version == 1 and again.upsert(spark.createDataFrame([(1, "c")], "k long, v string")) == 3
    assert rows(again.read()) == [(1, "c"), (2, "a")]
    assert again.vacuum() == 2 and rows(again.read()) == [(1, "c"), (2, "a")] and again.versions() == [3]
    assert files(tmp_path / "t") == {f"data/{f.split('/data/')[-1]}" for f in again.read().inputFiles()}


def test_only_one_of_two_writers_wins(spark, tmp_path, monkeypatch):
    a, b = made(spark, tmp_path / "t"), KeyedTable(spark, f"file://{tmp_path}/t")
    a.upsert(spark.createDataFrame([(1, "a")], "k long, v string"))
    real = KeyedTable._written

    def slow(self, df, write):
        monkeypatch.setattr(KeyedTable, "_written", real)
        a.upsert(spark.createDataFrame([(2, "a")], "k long, v string"))
        real(self, df, write)

    monkeypatch.setattr(KeyedTable, "_written", slow)
    with pytest.raises(Conflict):
        b.upsert(spark.createDataFrame([(1, "b")], "k long, v string"))
    assert rows(a.read()) == [(1, "a"), (2, "a")]


def test_keys_are_checked(spark, tmp_path):
    t = made(spark, tmp_path / "t", "k long, v string, w array<float>", dimensions={"w": 2})
    good = "k long, v string, w array<float>, extra int"
    for bad, what in (([(None, "a", [1.0, 2.0], 1)], "key is null"), ([(1, "a", [1.0, 2.0], 1), (1, "b", [1.0, 2.0], 1)], "there twice"), ([(1, "a", [1.0], 1)], "dimensions")):
        with pytest.raises(Exception, match=what):
            t.upsert(spark.createDataFrame(bad, good))
    assert t.version == 0
    t.upsert(spark.createDataFrame([(1, "a", [1.0, 2.0], 1), (1, "b", None, 2), (2, None, None, 5)], good), F.col("extra"))
    assert rows(t.read()) == [(1, "b", None), (2, None, None)]
    with pytest.raises(Conflict):
        made(spark, tmp_path / "t")


def test_runs_are_replaced_and_deleted(spark, tmp_path):
    t = made(spark, tmp_path / "t", "run string, n int, v string", ("run", "n"), by=("run",))
    t.upsert(spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("b", 1, "x")], "run string, n int, v string"))
    t.replace(spark.createDataFrame([("a", 3, "y")], "run string, n int, v string"))
    assert rows(t.read()) == [("a", 3, "y"), ("b", 1, "x")]
    t.delete(spark.createDataFrame([("b",), ("none",)], "run string"))
    assert rows(t.read()) == [("a", 3, "y")]
    t.delete(spark.createDataFrame([("a", 3)], "run string, n int"))
    assert rows(t.read()) == []
    t.upsert(spark.createDataFrame([("c", 1, "z")], "run string, n int, v string"))
    t.clear()
    assert rows(t.read()) == [] and rows(t.read(t.version - 1)) == [("c", 1, "z")]


def test_sections_keep_versions(spark, tmp_path):
    ddl = "run_id long, key string, version long, content string, edited boolean, stale boolean"
    t = made(spark, tmp_path / "t", ddl, ("run_id", "key"), by=("run_id",))
    how = lambda old, new: versioned(old, new, ("run_id", "key"))
    t.merge(spark.createDataFrame([(1, "a", None, "one", False, True), (1, "b", 4, "one", False, True)], ddl), how)
    t.merge(spark.createDataFrame([(1, "a", None, "two", False, True)], ddl), how)
    assert rows(t.read()) == [(1, "a", 2, "two", False, False), (1, "b", 4, "one", False, False)]


def test_a_hot_bucket_is_several_files(spark, tmp_path):
    """A bucket with most rows is written by several tasks."""
    t = made(spark, tmp_path / "t", "run long, n long, v string", ("run", "n"), by=("run",))
    big = spark.range(60_000).select(F.lit(1).cast("long").alias("run"), F.col("id").alias("n"), F.sha2(F.col("id").cast("string"), 512).alias("v"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        t.upsert(big)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert t.read().count() == 60_000 and len(files(tmp_path / "t")) > 1
