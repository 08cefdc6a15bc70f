"""Tagging in rounds: halves, reasons, and the end of a job in which too much failed."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import tagrounds as R
from weftline.operators.containment import held

TEXTS = {k: f"text number {k} of the batch with its own words w{k}" for k in range(8)}


def rows(spark, library="literature"):
    return spark.createDataFrame([(1, k, library, t) for k, t in TEXTS.items()], "batch long, i int, library string, text string")


def model(spark, items, asked=None, cut=()):
    """Answers from a table of items by i; parts that hold an i of `cut` are cut off."""
    given = spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False)) for k, v in items.items()], "i int, json string").select("i", F.parse_json("json").alias("item"))

    def ask(parts, n):
        if asked is not None:
            asked.append(sorted((r["part"], r["i"]) for r in parts.collect()))
        off = parts.filter(F.col("i").isin(*cut)).select("part").distinct().withColumn("cut", F.lit(True)) if cut else None
        out = parts.join(given, "i").select("part", "i", "item")
        return out.withColumn("cut", F.lit(False)) if off is None else out.join(off, "part", "left").withColumn("cut", F.coalesce("cut", F.lit(False)))

    return ask


def quoted(k, **more):
    return {"quote": f"number {k}", "imagery": [f"w{k}"], "emotion": ["平静"], **more}


def test_halves_until_it_is_told(spark):
    asked = []
    items = {k: quoted(k) for k in TEXTS if k != 5}
    done, failed = R.in_rounds(rows(spark), model(spark, items, asked), ("平静",), partial=True)
    assert {(r["i"], r["round"]) for r in done.collect()} == {(0, 1), (1, 1), (2, 1), (3, 1), (6, 2), (7, 2), (4, 3)}
    assert [(r["part"], r["i"], r["round"]) for r in failed.collect()] == [("1.1.0.1", 5, 3)]
    assert [len(x) for x in asked] == [8, 8, 4, 2] and {p for p, _ in asked[2]} == {"1.1.0", "1.1.1"}


def test_misplaced_cut_off_and_abort(spark):
    """A quote of another row, or an answer that was cut off, spoils its part; more than half of the batches failing ends it."""
    items = {k: quoted(k) for k in TEXTS} | {2: quoted(3)}
    done, failed = R.in_rounds(rows(spark), model(spark, items), ("平静",), partial=True)
    told = {r["i"]: (r["round"], r["tags"] is not None) for r in done.collect()}
    assert told[7] == (1, True) and told[3] == (3, True) and 2 not in told and [r["i"] for r in failed.collect()] == [2]
    done, failed = R.in_rounds(rows(spark), model(spark, {k: quoted(k) for k in TEXTS}, cut=(0,)), ("平静",), partial=True)
    assert {r["i"] for r in done.collect()} == set(range(1, 8)) and [r["i"] for r in failed.collect()] == [0]
    with pytest.raises(R.TaggingFailed, match="1 of 1"):
        R.in_rounds(rows(spark), model(spark, {}), ("平静",))
    done, failed = R.in_rounds(rows(spark).limit(0), model(spark, {0: {}}), ("平静",))
    assert done.count() == failed.count() == 0


def test_reasons(spark):
    """All nine reasons, and what stays of an answer."""
    text = "落花流水春去也，天上人间。the moon over the river"
    cases = {
        1: ({"quote": "落花流水", "keywords": ["落花", 5, " moon ", "x" * 21, "a：b", "不在", "落花", ""], "imagery": "春", "emotion": ["平静", "狂喜", 7, "平静"], "type": "诗词", "concept": "c《"}, "literature"),
        2: ({"quote": " "}, "poetry"), 3: ({"quote": "elsewhere", "keywords": [1]}, "poetry"), 4: ({"quote": "the moon", "imagery": ["moon", "river", "花", "水"], "type": "诗", "concept": " 无常 "}, "psychology"), 5: ([1], "poetry"),
        6: ({"quote": "the moon", "type": 5, "imagery": ["moon", "river", "花", "水"], "keywords": {"a": 1}}, "poetry"),
    }
    df = spark.createDataFrame([(k, lib, text, json.dumps(x, ensure_ascii=False)) for k, (x, lib) in cases.items()], "k int, library string, text string, json string").select("k", "library", "text", F.parse_json("json").alias("item"))
    got = {r["k"]: (r["tags"] and tuple(r["tags"]), sorted(r["reasons"])) for r in R.validated(df, ("平静",)).select("k", "tags", "reasons").collect()}
    assert got[1] == (("落花流水", "", ["落花", "moon"], ["春"], ["平静"], "诗词"), ["character", "character", "emotion", "foreign", "kind", "length", "length"])
    assert got[2] == (None, ["no quote"]) and got[3] == (None, ["quote"]) and got[5] == (None, ["no quote"])
    assert got[4] == (("the moon", "无常", [], [], [], ""), ["imagery"] * 3 + ["type"])
    assert got[6] == (("the moon", "", [], ["moon", "river", "花"], [], ""), [])
    assert {x for _, r in got.values() for x in r} == set(R.REASONS)


def test_small_groups_are_looked_through(spark):
    """Names are looked for in the texts of their group, by q-grams in large ones; both give what all pairs give."""
    words = ["moon", "river", "on", "the river", "zz", "", None]
    names = [(g, w) for g in range(5) for w in words]
    texts = [(g, f"{g} the moon over {'the river' if k % 2 else 'a riven bank'} {k % (g + 1)}") for g in range(6) for k in range(4 * g)] + [(1, None)]
    n, t = spark.createDataFrame(names, "g int, name string"), spark.createDataFrame(texts, "g int, text string")
    want = sorted({(g, w, x) for g, w in names for h, x in texts if g == h and w and x and w in x})
    for pairs in (4096, 30, 0):
        assert sorted(tuple(r) for r in held(n, t, ["g"], pairs=pairs).collect()) == want
    assert "Generate" not in held(n, t, ["g"])._jdf.queryExecution().executedPlan().toString()
