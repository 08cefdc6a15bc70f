from pyspark.sql import functions as F

from weftline.operators import fusion as R


def test_rrf(spark):
    rows = [("r1", "a", 1), ("r1", "b", 2), ("r2", "a", 1), ("r2", "c", 2), ("r2", "b", 3), ("r2", "b", 4), ("r2", "", 5)]
    got = [(r["chunk_id"], r["score"]) for r in R.fused(spark.createDataFrame(rows, "ranking string, chunk_id string, rank int")).orderBy("position").collect()]
    assert got == [("a", round(2 / 61, 6)), ("b", round(1 / 62 + 1 / 63, 6)), ("c", round(1 / 62, 6))]


def test_rrf_order(spark):
    rows = [("1", "a", 1), ("1", "b", 2), ("1", "c", 3), ("2", "b", 1), ("2", "a", 2)]
    assert [r["chunk_id"] for r in R.fused(spark.createDataFrame(rows, "ranking string, chunk_id string, rank int")).orderBy("position").collect()] == ["a", "b", "c"]


def ranked(spark, psychology=(), literature=(), poetry=()):
    rows = [(lib, c, i) for lib, cs in zip(R.LIBRARIES, (psychology, literature, poetry)) for i, c in enumerate(cs, 1)]
    return spark.createDataFrame(rows, "library string, chunk_id string, position int")


def picked(df):
    return [(r["chunk_id"], r["quota_slot"]) for r in df.orderBy(R.library_order(F.col("library")), "position").collect()]


def test_quota(spark):
    assert picked(R.allocated(ranked(spark, ["p1", "p2", "p3"], ["l1"], ["o1"]), (2, 1, 1), 4)) == [("p1", 0), ("p2", 1), ("l1", 0), ("o1", 0)]


def test_backfill(spark):
    assert picked(R.allocated(ranked(spark, ["p1", "p2"], ["l1", "l2", "l3"]), (3, 2, 1), 6)) == [("p1", 0), ("p2", 1), ("l1", 0), ("l2", 1), ("l3", None)]


def test_zero_quota(spark):
    assert picked(R.allocated(ranked(spark, ["p1"], ["l1"], ["o1"]), (1, 0, 0), 3)) == [("p1", 0)]


def loop(ranked, quota, cap):
    """Quotas and rounds one row at a time."""
    at, out = [0, 0, 0], [[], [], []]
    for k in range(3):
        while len(out[k]) < quota[k] and at[k] < len(ranked[k]):
            out[k].append((ranked[k][at[k]], len(out[k])))
            at[k] += 1
    going = True
    while going and sum(map(len, out)) < cap:
        going = False
        for k in range(3):
            if sum(map(len, out)) < cap and quota[k] and at[k] < len(ranked[k]):
                out[k].append((ranked[k][at[k]], None))
                at[k] += 1
                going = True
    return (out[0] + out[1] + out[2])[:cap]


def test_quota_equals_the_loop(spark):
    import random

    random.seed(3)
    for _ in range(6):
        lists = [[f"{n}{i}" for i in range(random.randint(0, 5))] for n in "plo"]
        quota, cap = [random.randint(0, 3) for _ in range(3)], random.randint(1, 8)
        assert picked(R.allocated(ranked(spark, *lists), quota, cap)) == loop(lists, quota, cap), (lists, quota, cap)


def test_confidence(spark):
    ids = "array<string>"
    rows = [(["p"], ["a"], "m", ["p"], ["a"]), (["p", "q"], [], "m", ["p", "q"], []), ([], [], "", ["p"], ["a"])]
    df = spark.createDataFrame(rows, f"e {ids}, al {ids}, m string, ps {ids}, ap {ids}")
    got = [r["c"] for r in df.select(R.confidence(*(F.col(c) for c in ("e", "al", "m", "ps", "ap"))).alias("c")).collect()]
    assert got == [0.725, 0.925, 0.0]


def test_distribution(spark):
    clusters = spark.createDataFrame([(1, "c0", 22), (1, "c1", 4), (1, "c2", 3)], "run_id int, cluster_key string, size int")
    tags = spark.createDataFrame([(1, "c0", 0, "emotion", ["倦怠", "倦怠"]), (1, "c1", 1, "emotion", ["倦怠"]), (1, "c2", 2, "emotion", ["哀伤"])], "run_id int, cluster_key string, pos int, dimension string, labels array<string>")
    got = [(r["label"], r["value"], r["cluster_key"]) for r in R.distribution(tags, clusters).orderBy("rank").collect()]
    assert got == [("倦怠", 26, "c0"), ("哀伤", 3, "c2")]


def test_graph_queries(spark):
    rows = [(1, "c0", 10, 0, False, ["哀伤"]), (1, "c1", 8, 1, False, ["哀伤"]), (1, "c2", 6, 2, False, ["倦怠"]), (1, "n", 9, 3, True, ["x"])]
    df = spark.createDataFrame(rows, "run_id int, cluster_key string, size int, order_index int, is_noise boolean, emotion_tags array<string>")
    assert [r["text"] for r in R.graph_queries(df, 5).orderBy("n").collect()] == ["哀伤", "倦怠"]
