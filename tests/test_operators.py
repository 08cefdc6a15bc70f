import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from weftline.functions import lexical as L
from weftline.functions.vectors import hashed_embedding, norm
from weftline.operators import chunking as K
from weftline.operators import clustering as C
from weftline.operators import incremental as I
from weftline.operators.components import components
from weftline.operators.vectors import semantic_dedup
from weftline.shipping import SLICE_BYTES, sliced, slices
from weftline.sources.markup import html_to_text
from weftline.streaming import events as E


def test_chunks_lose_nothing():
    texts = ["第一段。" * 200, "没有标点" * 400, "a, b; c! " * 300, "短。\n\n" + "长句，" * 300 + "\n折行\n接着"]
    for t in texts:
        got = K.pieces(t)
        assert "".join("".join(p[2].split()) for p in got) == "".join(t.split())
        assert all(len(p[2]) <= K.MOST for p in got)
    hard = K.pieces("无" * 1300)
    assert [len(p[2]) for p in hard] == [600, 600, 100] and [len(p[1]) for p in hard] == [600, 680, 180]
    assert K.pieces("太短") == []


def test_ended():
    assert K.ended("甲。乙？！丙", K.SENTENCE_END) == ["甲。", "乙？！", "丙"]


def test_deltas():
    for t in ("", "一二三四五六七八九十一二。好", "**粗体文字粗体文字粗体。文字**后面", "x" * 100):
        assert "".join(K.deltas(t)) == t
    assert K.deltas("一二三四五六七八九十一二。好")[0] == "一二三四五六七八九十一二。"


def test_chunk_table_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "足够长的一段话在这里。")], "id int, text string")
    assert [r["id"] for r in K.cut(df, "id", "text").collect()] == [3]


def test_keyphrase_fold(spark):
    df = spark.createDataFrame([(["abcd", "abc", "xy", "xyz", "pq"],)], "g array<string>")
    assert df.select(L.uncontained(F.col("g"), 2).alias("x")).first()["x"] == ["abcd", "xy"]


def test_markers_and_coverage(spark):
    df = spark.createDataFrame([("甲[[ev:a1]]乙[[ EV: b 2 ]]",)], "t string")
    r = df.select(L.markers(F.col("t")).alias("m"), L.attempts(F.col("t")).alias("a")).first()
    assert r["m"] == ["a1"] and r["a"] == ["a1", "b 2"]
    pairs = spark.createDataFrame([(9, 9), (3, 9), (1, 2), (0, 3), (0, 0)], "v int, n int")
    assert [r["c"] for r in pairs.select(L.coverage(F.col("v"), F.col("n")).alias("c")).collect()] == [1.0, 0.3333, 0.5, 0.0, 0.0]


def test_embedding(spark):
    df = spark.createDataFrame([("你好",), ("你 好",), ("",), (None,)], "t string")
    rows = df.select(hashed_embedding(F.col("t"), 32).alias("v"), norm(hashed_embedding(F.col("t"), 32)).alias("n")).collect()
    assert rows[0]["v"] == rows[1]["v"] and all(abs(r["n"] - 1) < 1e-9 for r in rows) and rows[2]["v"][0] == 1.0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(40, 41), (41, 40), (50, 50)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 31)} | {40: 40, 41: 40}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_semantic_dedup(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 9), (3, [0.0, 1.0], 0), (4, [0.99, 0.02], 9)]
    got = {r["id"]: r["representative"] for r in semantic_dedup(spark.createDataFrame(rows, "id long, v array<double>, likes int"), 0.95, "likes").collect()}
    assert got == {1: 2, 2: 2, 3: 3, 4: 2}


def blobs(sizes, seed=1):
    rng = np.random.default_rng(seed)
    x = np.vstack([np.eye(8)[k] + 0.22 * rng.normal(size=(n, 8)) / np.sqrt(8) for k, n in enumerate(sizes)])
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def test_hdbscan_blobs():
    labels = C.hdbscan(blobs([10, 10, 10]), C.density_size(30))
    assert sorted(np.bincount(labels[labels >= 0]).tolist()) == [10, 10, 10]
    assert (C.hdbscan(blobs([2]), 3) == -1).all()


def test_density_labels_of_few_rows(spark):
    df = spark.createDataFrame([(1, i, [float(i), 1.0]) for i in range(11)], "run_id int, id int, v array<double>")
    got = C.density_labels(df, "run_id").collect()
    assert {r["method"] for r in got} == {"none"} and {r["label"] for r in got} == {0}


def test_density_labels_fall_back_to_kmeans(spark):
    """No theme, a single theme of a large run, and rows alike that count for the theme of the one that stands for them."""
    far = np.eye(16)  # all equally far: density finds nothing
    wide = np.random.default_rng(2).normal(size=(30, 64))
    two = np.vstack([blobs([14, 14]), np.repeat(np.eye(8)[7:], 6, 0)])
    rows = [(r, i, v.tolist(), i % 5) for r, x in ((1, far), (2, wide), (3, two)) for i, v in enumerate(x)]
    got = C.density_labels(spark.createDataFrame(rows, "run_id int, id int, v array<double>, likes int"), "run_id", likes="likes").toPandas()
    method = got.groupby("run_id").method.first()
    assert method[1] == "kmeans" and method[2] == "kmeans"
    themes = got[got.label >= 0].groupby(["run_id", "label"]).size()
    assert themes[1].max() >= C.THEME_SIZE and len(themes[2]) >= 1
    assert got.groupby("run_id").size().to_dict() == {1: 16, 2: 30, 3: 34}
    same = got[(got.run_id == 3) & (got.id >= 28)]
    assert same.label.nunique() == 1 and same.is_survivor.sum() <= 1


def test_single_theme_is_split(monkeypatch):
    x, raw = blobs([15, 15]), np.ones(30, int)
    monkeypatch.setattr(C, "hdbscan", lambda x, size: np.zeros(len(x), int))
    label, method = C.themes_of(x, raw)
    assert method == "kmeans" and len({*label.tolist()} - {-1}) >= 2
    assert C.themes_of(x[:19], raw[:19])[1] == "hdbscan"
    # clusters too small for a theme: with fewer than two themes left, k-means
    monkeypatch.setattr(C, "hdbscan", lambda x, size: np.array([0] * 10 + [1] * 2 + [-1] * (len(x) - 12)))
    assert C.themes_of(x[:18], raw[:18])[1] == "kmeans"


def test_alike():
    x = np.array([[1, 0], [0.999, 0.04], [0, 1], [0.98, 0.2], [0.9, 0.43]])
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    assert C.alike(x, np.array([1, 0, 0, 9, 9])).tolist() == [3, 3, 2, 3, 3]  # 0 and 4 only by way of 3


def test_registry(spark):
    c = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "chunk_id string, content_hash string")
    r = spark.createDataFrame([("a", "1"), ("b", "x"), ("z", "9")], "chunk_id string, content_hash string")
    assert {x["chunk_id"]: x["action"] for x in I.diff(c, r).collect()} == {"a": "skipped", "b": "updated", "c": "added"}
    assert {x["action"] for x in I.diff(c, r, force=True).collect()} == {"added"}
    assert {tuple(x) for x in I.upserted(r, c, ("chunk_id",)).collect()} == {("a", "1"), ("b", "2"), ("c", "3"), ("z", "9")}


def test_events(spark):
    e = spark.createDataFrame([(1, 1, "a", 42.0), (1, 2, "b", 17.0), (1, 2, "b", 17.0), (1, 3, "c", 130.0)], "run_id int, seq long, type string, progress double")
    f = E.folded(e).first()
    assert (f["seq"], f["progress"], f["events"], f["last_type"]) == (3, 100.0, 3, "c")
    assert [r["progress"] for r in E.running_progress(e.dropDuplicates()).orderBy("seq").collect()] == [42.0, 42.0, 100.0]
    assert [r["seq"] for r in E.replayed(e.dropDuplicates(), F.lit(1)).orderBy("seq").collect()] == [2, 3]


def test_html():
    assert html_to_text("<title>t</title><p>a&amp;b<br>c</p><script>x</script><div>d  e</div>") == "a&b\nc\n\nd e"


def test_slices_bound_what_a_function_holds(spark):
    """A batch of many long texts reaches a function in slices, a text of more alone; the results are those of the whole batch."""
    texts = pa.array(["a" * 1000] * 5000 + [None, "b" * (SLICE_BYTES + 1), ""])
    parts = list(slices((texts,)))
    assert sum(n for _, n in parts) == len(texts) and all(n == 1 or sum(len(x or "") for x in texts.slice(at, n).to_pylist()) <= SLICE_BYTES for at, n in parts)
    seen = []

    @sliced
    def lengths(a: pa.Array) -> pa.Array:
        seen.append(len(a))
        return pa.array([None if x is None else len(x) for x in a.to_pylist()], pa.int64())

    assert lengths(texts).to_pylist() == [None if x is None else len(x) for x in texts.to_pylist()] and len(seen) == len(parts) > 2
    assert lengths(texts.slice(0, 0)).to_pylist() == []
    long = spark.createDataFrame([(k, "Ein Satz. " * 40_000) for k in range(3)] + [(3, None), (4, "kurz")], "k long, t string")
    got = K.cut(long, "k", "t").groupBy("k").agg(F.sum(F.length("body")).alias("n"), F.countDistinct("piece").alias("m"), F.count("*").alias("c")).collect()
    assert {r["k"] for r in got} == {0, 1, 2} and len({(r["n"], r["m"], r["c"]) for r in got}) == 1 and all(r["m"] == r["c"] for r in got)
