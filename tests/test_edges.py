"""Where an operator must stop, and rows that are null, empty or repeated."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import payload as J
from weftline.operators import evidence as E
from weftline.operators import incremental as I
from weftline.operators import persist as P
from weftline.operators import tagging as T
from weftline.operators import vectors as V


def test_wrong_vectors_end_the_query(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0])], "id int, vector array<double>")
    assert I.of_dimension(rows.filter("id < 3"), "vector", 2).count() == 2
    with pytest.raises(Exception, match="has 1 dimensions, not 2"):
        I.of_dimension(rows, "vector", 2).collect()
    assert I.complete(rows.filter("id = 1").select("id"), rows, "id").count() == 1
    with pytest.raises(Exception, match="0 vectors for one chunk"):
        I.complete(rows.select("id"), rows.filter("id = 1"), "id").collect()


def test_payloads(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first()["c"]
    p = lambda s: F.parse_json(F.lit(s))
    assert one(J.first_present(p('{"a": 0, "b": 5}'), "x", "a", "b", kind="int")) == 0
    assert one(J.first_present(p('{"a": {"b": false}}'), "a.b", kind="boolean")) is False
    assert one(F.to_json(J.first_list(p('{"data": {"items": []}, "items": [1]}'), ("data", "items")))) == "[1]"
    assert one(F.to_json(J.first_list(p('{"data": {"list": {"x": 1}}}'), ("data", "list")))) == "[]"
    assert one(J.failure(p('{"success": false}'))) == "no reason given" and one(J.failure(p('{"success": true}'))) is None and one(J.failure(p("[]"))) is None
    with pytest.raises(Exception, match="busy"):
        spark.range(1).select(F.to_json(J.checked(p('{"success": false, "error": "busy"}')))).collect()
    for text, value in (('{"a":1}', 1), ('```json\n{"a":2}\n```', 2), ('so {"a":{"b":1},"a2":2} it', None), ("", None), (None, None), ('{"a":', None), ('x {"a": 4} y', 4)):
        assert one(F.try_variant_get(J.repaired(F.lit(text).cast("string")), "$.a", "int")) == value


def test_tags(spark):
    df = spark.createDataFrame([("月落乌啼霜满天。江枫渔火", ["月落 ", "江：枫", "无此", "月落", "霜满天", "江枫", "渔火", None])], "text string, tags array<string>")
    assert df.select(T.valid_tags(F.col("tags"), F.col("text"))).first()[0] == ["月落", "霜满天", "江枫"]
    assert df.select(T.first_sentence(F.col("text"))).first()[0] == "月落乌啼霜满天。"
    assert {r["reason"]: r["n"] for r in T.refused(df, "tags", "text").collect()} == {"character": 1, "foreign": 1, "length": 1}
    name = lambda k, h, w: df.select(T.concept(F.array(*(F.lit(x) for x in k)).cast("array<string>"), F.lit(h), F.lit(w))).first()[0]
    assert [name(["大地", "存在主义"], "", ""), name(["大地"], "h", ""), name([], "h", "w"), name([], "", "一二三四五六七八九"), name([], "", "")] == ["存在主义", "大地", "h", "一二三四五六七八", T.UNNAMED]
    assert len(T.closed_emotions({"平静": [], "喜": []})) == 16


def test_sections_and_snapshots(spark):
    old = spark.createDataFrame([(1, "a", 3, "x", True, True), (1, "b", 3, "x", False, True), (2, "a", 1, "x", False, False)], "run_id int, key string, version int, content string, edited boolean, stale boolean")
    new = spark.createDataFrame([(1, "a", None, "n"), (1, "b", None, "n"), (3, "c", None, "n")], "run_id int, key string, version int, content string")
    got = {(r["run_id"], r["key"]): (r["version"], r["content"], r["stale"]) for r in P.versioned(old, new, ("run_id", "key")).collect()}
    assert got == {(1, "a"): (3, "n", True), (1, "b"): (4, "n", False), (2, "a"): (1, "x", False), (3, "c"): (1, "n", False)}
    state = "run_id int, status string, progress double, profile string"
    s = P.over_live(spark.createDataFrame([(1, "running", 40.0, None), (2, "succeeded", 200.0, "p")], state), spark.createDataFrame([(1, "succeeded", 100.0, "live"), (3, "running", 5.0, None)], state), ("profile",))
    assert {r["run_id"]: (r["status"], r["progress"], r["profile"]) for r in s.collect()} == {1: ("succeeded", 100.0, "live"), 2: ("succeeded", 100.0, "p"), 3: ("running", 5.0, None)}


def test_labels(spark):
    c = spark.createDataFrame([("c0", False, ["", "甲", "乙", "丙"], 4), ("tail", False, ["x"], 2), ("n", True, ["x"], 2), ("c1", False, [], 7)], "cluster_key string, is_noise boolean, keywords array<string>, size int")
    assert {r["cluster_key"]: r["l"] for r in c.select("cluster_key", E.fallback_label().alias("l")).collect()} == {"c0": "甲·乙", "tail": E.TAIL_LABEL, "n": E.NOISE_LABEL, "c1": "未命名的一组（7 条）"}


def test_vectors_without_length_and_ties(spark):
    rows = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(6)] + [(6, [0.0, 0.0]), (7, None)], "chunk_id int, v array<double>")
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, None)], "query_id int, q array<double>")
    assert [(r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in V.top_k(q, rows, 3).orderBy("rank").collect()] == [(1, 1, 0, 1.0), (1, 2, 1, 1.0), (1, 3, 2, 1.0)]
    assert V.similar_pairs(rows, 0.5, key="chunk_id").count() == 15 and V.similar_pairs(rows.limit(0), 0.5, key="chunk_id").count() == 0
    assert V.top_k(q, rows.limit(0), 3).count() == 0


def test_a_run_is_joined_to_what_its_concepts_lead_to(spark):
    """Where a concept leads is told before the runs' rows meet it: these are neither grouped nor ranked again, and each run has the same places."""
    concepts = spark.createDataFrame([(r, c) for r in range(20) for c in ("a", "b", None)] + [(1, "a")], "run_id int, concept string")
    imagery = spark.createDataFrame([("a", "x", 3), ("a", "y", 3), ("b", "y", 1), ("a", "z", 2), ("a", "w", 1)], "concept string, imagery string, strength int")
    mentions = spark.createDataFrame([("x", 1, 2.0), ("y", 1, 9.0), ("y", 2, 9.0), ("z", 3, 1.0), ("w", 4, 1.0)], "imagery string, chunk_id int, weight double")
    got = E.graph_pass(concepts, imagery, mentions)
    rows = {(r["run_id"], r["concept"]): [] for r in got.collect()}
    for r in got.orderBy("place").collect():
        rows[r["run_id"], r["concept"]].append(r["chunk_id"])
    assert rows == {(r, c): x for r in range(20) for c, x in (("a", [1, 2, 3]), ("b", [1, 2]))}
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
