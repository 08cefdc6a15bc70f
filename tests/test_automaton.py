"""The automaton against str.find, form by form."""

import time

import numpy as np
from pyspark.sql import functions as F

from weftline.functions import automaton as A
from weftline.functions import lexical as L

TEXTS = ["abcabcab", "", None, "aaaa", "xabyabcx", "漢字かな交じり文 漢字", "😀a😀", "ushers", "b" * 2000 + "abc", "ab" * 3000, "\x00a퟿"]


def brute(texts, forms):
    return [(k, f, x.find(f) + 1) for k, x in enumerate(texts) if x for f in sorted({f for f in forms if f}) if f in x]


def places(machine, texts):
    t, f, p = machine.places(texts)
    return [(a, machine.forms[b], c) for a, b, c in zip(t.tolist(), f.tolist(), p.tolist())]


def test_places(monkeypatch):
    forms = ["a", "ab", "abc", "bc", "aa", "aaa", "he", "she", "his", "hers", "漢字", "字", "かな交", "😀a", "b" * 700, "", "ab", "zz", "abab" * 20]
    for segment, together in ((512, 1 << 20), (7, 50), (1, 1)):
        monkeypatch.setattr(A, "SEGMENT", segment)
        monkeypatch.setattr(A, "TOGETHER", together)
        assert places(A.Automaton(forms), TEXTS) == brute(TEXTS, forms)
    assert places(A.Automaton([]), TEXTS) == [] and places(A.Automaton(["a"]), []) == []


def test_random_forms():
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("abcd"), n))
    forms, texts = [word(n) for n in rng.integers(1, 7, 200)], [word(n) for n in rng.integers(0, 1500, 60)]
    assert places(A.Automaton(forms), texts) == brute(texts, forms)


def test_tags_and_scores_are_those_of_single_searches(spark, folder):
    """Five thousand forms, and a small lexicon against the functions that search form by form; the plan does not grow."""
    d = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    small = {"x": ["the ", "und "], "y": ["der ", "the "], "z": ["que", ""], "none": []}
    both = d.select("doc_id", A.tags(F.col("text"), small, 2).alias("a"), A.scores(F.col("text"), small).alias("s"))
    found = {r["doc_id"]: r for r in both.collect()}
    bare = {t: [f for f in forms if f] or ["\u0001\u0002"] for t, forms in small.items()}
    for r in d.select("doc_id", L.lexicon_tags(F.coalesce("text", F.lit("")), bare, 2).alias("a"), L.lexicon_scores(F.coalesce("text", F.lit("")), bare).alias("s")).collect():
        assert found[r["doc_id"]]["a"] == r["a"] and [tuple(x) for x in found[r["doc_id"]]["s"]] == [tuple(x) for x in r["s"]]
    texts = [r["text"] or "" for r in d.collect()]
    words = sorted({w for x in texts for w in x.split() if len(w) > 2})[:5000]
    large = {w[:3]: [] for w in words}
    for w in words:
        large[w[:3]].append(w)
    tagged = d.select("text", A.tags(F.col("text"), large, 4).alias("a"))
    assert len(tagged._jdf.queryExecution().executedPlan().toString()) < 2000
    began = time.perf_counter()
    for r in tagged.collect():
        x = r["text"] or ""
        first = sorted((min(x.find(f) for f in forms if f in x), t) for t, forms in large.items() if any(f in x for f in forms))
        assert r["a"] == [t for _, t in first[:4]]
    assert time.perf_counter() - began < 120
    assert d.limit(0).select(A.tags(F.col("text"), small, 2)).count() == 0
