"""Importance resampling against plain Python: every feature, bucket, weight, score and rank."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from weftline.llm import importance
from weftline.llm.registry import QUERIES

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    low = bytes(c + 32 if 65 <= c < 91 else c for c in (text or "").encode())
    words = WORD.findall(low)
    return len(words), [b" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)]


def brute(docs, target, percent=5, least=20):
    """Rows of (doc_id, n_features, weight, score, rank)."""
    s, t = (Counter(zlib.crc32(f) % 10000 for x in texts for f in features(x)[1]) for texts in ([x for _, x in docs], target))
    S, T = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    rows = []
    for i, x in docs:
        n, of = features(x)
        weight = sum(gain[zlib.crc32(f) % 10000] for f in of)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(of), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    part = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(part[: percent * len(part) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=repr)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=repr)


TEXTS = [None, "", "  ...  ", "One", "one TWO", "a_b c-d e.f", "\x00x\x7fy", "Ünïcödé 漢字 😀 ok", "ÀÉ àé", "z" * 5000 + " tail", "the cat sat on the mat " * 40, "x1 22 3c " * 9, "word " * 3000]


def test_equal_to_brute_force(spark):
    docs = [(k, x) for k, x in enumerate(TEXTS * 4)] + [(1000 + k, f"the cat number{k} sat on {k * k} mats and saw nothing else but the mat of the other cat today again") for k in range(200)]
    target = ["the mat of the other cat", None, "", "saw nothing else"]
    df = spark.createDataFrame([(i, x, 9) for i, x in docs], "doc_id long, text string, score int").repartition(5)
    goal = spark.createDataFrame([(x,) for x in target], "text string")
    expected = brute(docs, target)
    assert rows_of(importance.resampled(df, goal)) == expected
    assert sum(r[4] is not None for r in expected) == 5 * sum(features(x)[0] >= 20 for _, x in docs) // 100 > 0
    # neither blocks nor the head change a row
    assert rows_of(importance.resampled(df, goal, block_bytes=200)) == expected
    assert rows_of(importance.resampled(df, goal, head=importance.Head([], []))) == expected
    assert rows_of(importance.resampled(df, goal, head=importance.Head([b"the", b"cat", b"mat", b"x" * 40], [(b"the", b"cat"), (b"the", b"dog")]))) == expected


def test_ties_repeats_and_empty_tables(spark):
    text = "a b c d e f g h i j k l m n o p q r s t u"
    docs = [(1, text)] * 60 + [(None, text)] * 2 + [(2, text)] * 38
    got = rows_of(importance.resampled(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame([], "text string")))
    assert got == brute(docs, []) and sorted(r[4] for r in got if r[4]) == [1, 2, 3, 4, 5]
    none = importance.resampled(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(text,)], "text string"))
    assert none.count() == 0
    # ties go to the smaller id
    scored = spark.createDataFrame([(k, 5, True) for k in range(50, 0, -1)], "doc_id long, score long, in boolean").repartition(6)
    assert {r["doc_id"]: r["rank"] for r in importance.ranked(scored, scored["in"], 10).collect() if r["rank"]} == {k: k for k in range(1, 6)}


def test_states_carry_over():
    """A run's state from its parts' states is the CRC of its bytes."""
    w = importance.Words(pa.chunked_array([["ab cd ef ab cd", None, "ef ab " + "q" * 50 + " ab cd"]]))
    for head in (importance.Head([], []), importance.Head([b"ab", b"cd"], []), importance.Head([b"ab", b"cd", b"ef"], [(b"ab", b"cd"), (b"cd", b"ef")])):
        one, (_, two), (_, three) = head.crcs(w)
        q = "q" * 50
        assert one.tolist() == [zlib.crc32(x.encode()) for x in f"ab cd ef ab cd ef ab {q} ab cd".split()]
        assert two.tolist() == [zlib.crc32(x.encode()) for x in ("ab cd", "cd ef", "ef ab", "ab cd", "ef ab", f"ab {q}", f"{q} ab", "ab cd")]
        assert three.tolist() == [zlib.crc32(x.encode()) for x in ("ab cd ef", "cd ef ab", "ef ab cd", f"ef ab {q}", f"ab {q} ab", f"{q} ab cd")]


def test_head_holds_frequent_words(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.5, 200)) for _ in range(200)]
    head = importance.frequent(spark.createDataFrame([(x,) for x in texts], "text string").repartition(3), words=50, pairs=20)
    count = Counter(w for x in texts for w in x.split())
    held = {x.decode() for x in head.words.to_pylist()}
    assert 30 <= len(held) <= 50 and {w for w, _ in count.most_common(30)} <= held
    assert 5 <= len(head.pair) - 1 <= 20


def test_query(spark, folder):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    df = QUERIES["op11_importance"](spark, folder)
    assert [t for _, t in df.dtypes] == ["bigint"] * 5
    assert rows_of(df) == brute(docs, target)
