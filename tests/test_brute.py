"""Queries that SQL can't tell, against plain Python over the whole given tables."""

import math
import re
import unicodedata
import hashlib
from collections import Counter, defaultdict
from hashlib import blake2b

import numpy as np

from pyspark.sql import functions as F

from weftline.functions import lexical as L
from weftline.operators import clustering
from weftline.operators import keyphrases as K
from weftline.operators.containment import WINDOW, Q, held, windows
from weftline.operators.containment import grams as grams_of
from weftline.registry import QUERIES


def rows(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet").collect()


def grams(text):
    out = []
    for run in re.split(L.RUN_BREAK, text):
        for n in range(2, 5):
            out += [run[i : i + n] for i in range(len(run) - n + 1)]
    return Counter(g for g in out if g[0] not in L.NOT_FIRST and g[-1] not in L.NOT_LAST and g not in L.STOP_WORDS)


def picked(counts, k):
    noun = lambda g: 1.8 if g.endswith(tuple(L.NOUN_ENDINGS)) else 1.0
    kept = []
    for g in sorted(counts, key=lambda g: (-round(math.log1p(counts[g]) * len(g) ** 1.2 * noun(g), 9), -len(g), g)):
        if len(kept) < k and not any(g in x or x in g for x in kept):
            kept.append(g)
    return "|".join(kept)


def test_keyphrases(spark, folder):
    turns = rows(spark, folder, "conversations")
    got = {r["doc_id"]: r["phrases"] for r in QUERIES["keyphrases"](spark, folder).collect()}
    for r in rows(spark, folder, "documents"):
        assert got.get(r["doc_id"], "") == picked(grams(r["text"] or ""), 6), r["doc_id"]
    across = {r["conv_id"]: r["phrases"] for r in QUERIES["keyphrases_across"](spark, folder).collect()}
    by = defaultdict(Counter)
    for r in turns:
        by[r["conv_id"]].update(grams(r["text"]).keys())
    for conv, counts in by.items():
        assert across.get(conv, "") == picked({g: n for g, n in counts.items() if n >= 2}, 5)


def test_keyphrases_need_more_than_the_first(spark):
    """Of grams that all hold each other only one is taken, so more are looked at, round by round; long runs are cut without a loss."""
    texts = {1: "ab" * 300 + " cd " + "ef" * 5, 2: "a", 3: "", 4: None, 5: "xyz" * 1000, 6: "".join(chr(0x4E00 + k % 900) for k in range(5000))}
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    got = {r["id"]: "|".join(r["phrases"]) for r in K.keyphrases(df, "id", "text", most=2).collect()}
    assert got == {i: picked(grams(t), 6) for i, t in texts.items() if t and grams(t)}
    counted = {(r["id"], r["gram"]): r["n"] for r in K.frequencies(df, "id", "text").collect()}
    assert counted == {(i, g): n for i, t in texts.items() if t for g, n in grams(t).items()}
    assert K.keyphrases(df.limit(0), "id", "text").count() == 0


def test_held_is_brute_force(spark):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcä漢😀 "), n))
    names = [word(n) for n in rng.integers(1, 9, 150)] + ["", None, "a", "z", "aa"]
    texts = [word(n) for n in rng.integers(0, 300, 80)] + ["", None, "a", names[0] + names[1], "z" * 200 + "ab"]
    by = lambda values: [(k % 2, x) for k, x in enumerate(values)]
    got = {(r["g"], r["name"], r["text"]) for r in held(spark.createDataFrame(by(names), "g int, name string"), spark.createDataFrame(by(texts), "g int, text string"), ["g"]).collect()}
    assert got == {(g, n, t) for g, n in by(names) for h, t in by(texts) if g == h and n and t is not None and n in t}
    # what is made before the check grows with the length of a text, not with its square
    for size in (1000, 4000):
        text = spark.createDataFrame([("".join(chr(0x4E00 + k) for k in range(size)),)], "text string")
        made = text.select(F.explode(windows(F.col("text"), WINDOW, Q - 1)).alias("w")).select(F.explode(grams_of(F.col("w"))).alias("g")).distinct().count()
        assert made <= 3 * size


def test_hash_embed(spark, folder):
    def embed(text):
        chars = "".join(unicodedata.normalize("NFKC", text).lower().split())
        v = np.zeros(64)
        for n, weight in ((1, 0.5), (2, 1.0), (3, 0.8)):
            for i in range(len(chars) - n + 1):
                h = int.from_bytes(blake2b(chars[i : i + n].encode(), digest_size=8).digest(), "big")
                v[h % 64] += weight if h >= 1 << 63 else -weight
        return v / np.linalg.norm(v) if v.any() else np.eye(64)[0]

    vectors = {(r["conv_id"], r["turn"]): embed(r["text"]) for r in rows(spark, folder, "conversations")}
    got = QUERIES["hash_embed"](spark, folder).collect()
    assert len(got) == len(vectors)
    for r in got:
        v, w = vectors[r["conv_id"], r["turn"]], vectors.get((r["conv_id"], r["turn"] + 1))
        assert np.allclose([r[f"v{k}"] for k in range(4)], v[:4], atol=2e-6) and abs(r["norm"] - 1) < 1e-6
        assert r["next"] is None if w is None else abs(r["next"] - v @ w) < 2e-6


def test_chunk_pieces(spark, folder):
    """Pieces keep every character, stay within the bounds, and end where a paragraph or a full group of sentences does."""
    texts = {r["doc_id"]: r["text"] or "" for r in rows(spark, folder, "documents")}
    got = defaultdict(list)
    for r in QUERIES["chunk_pieces"](spark, folder).orderBy("doc_id", "piece").collect():
        got[r["doc_id"]].append(r)
    for d, text in texts.items():
        clean = re.sub(r"\n{3,}", "\n\n", "\n".join(re.sub(r"[ \t　]+", " ", x).strip(" ") for x in re.sub("\r\n?", "\n", text).split("\n"))).strip()
        blocks = [" ".join(b.split("\n")) for b in clean.split("\n\n") if b] if len(clean) >= 8 else []
        by = defaultdict(list)
        for r in got.get(d, []):
            by[r["paragraph"]].append(r["length"])
        assert [sum(by[k]) for k in sorted(by)] == [len(b) for b in blocks]
        for k, b in enumerate(blocks):
            if len(b) <= 600:
                assert by[k] == [len(b)]
                continue
            ends = np.cumsum(by[k])
            for at, size in zip(ends[:-1], by[k][:-1]):
                assert size <= 600 and (b[at - 1] in "。！？；…!?;.，、,：: \n" or size == 600)


def test_kmeans_and_density_find_blobs(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    points = [(0, axis * 40 + i, [float(x) for x in np.eye(8)[axis] + rng.normal(0, 0.05, 8)], axis) for axis in range(4) for i in range(40)]
    df = spark.createDataFrame(points, "run_id int, id long, v array<double>, axis int")
    told = clustering.kmeans(df, 4).groupBy("axis", "label").count().collect()
    assert len(told) == 4 and all(r["count"] == 40 for r in told) and len({r["label"] for r in told}) == 4
    labels = clustering.density_labels(df.select("run_id", "id", "v"), "run_id").join(df.select("id", "axis"), "id").filter(F.col("label") >= 0)
    found = labels.groupBy("axis").agg(F.count_distinct("label").alias("n")).collect()
    assert len(found) == 4 and all(r["n"] == 1 for r in found)


def test_kmeans_sizes(spark, folder):
    got = QUERIES["kmeans_sizes"](spark, folder).collect()
    assert sorted(r["label"] for r in got) == list(range(5)) and sum(r["n"] for r in got) == len(rows(spark, folder, "embeddings"))
    assert all(0 < r["fit"] <= 1 for r in got)


def test_chunk_ids(spark, folder):
    got = QUERIES["chunk_ids"](spark, folder).first()
    assert got["ids"] == got["bodies"] > 0


def test_html_blocks(spark, folder):
    from weftline.sources.markup import html_to_text

    digests = {r["page_id"]: r["digest"] for r in QUERIES["html_blocks"](spark, folder).collect()}
    pages = {r["page_id"]: r["html"] for r in rows(spark, folder, "pages")}
    assert digests == {p: hashlib.md5(html_to_text(h).encode()).hexdigest() for p, h in pages.items()}
    golden = {
        "<head><title>t</title></head><p>A &amp; b<br/>c</p><script>x('</p>')</script><ruby>漢<rt>kan</rt></ruby>!": "A & b\nc\n\n漢!",
        "<table><tr><th>Year</th><th>Cost</th></tr><tr><td>1</td><td>2</td></tr></table>": "Year\n\nCost\n\n1\n\n2",
        "<figure><img/><figcaption>A cat.</figcaption></figure>Text": "A cat.\n\nText",
        "<ul><li>a<li>b</ul><footer>c</footer>d": "a\n\nbcd",
        "a&nbsp;&nbsp; b\t\tc\u3000d": "a b c\u3000d",
        "<p>a<b>b</b>c<p>d<br><br><br><br>e": "abc\n\nd\n\ne",
        "<rt>x<rp>(</rp>y</rt>z<p": "z",
        "1 < 2 <!-- <p>no</p> --> 3": "1 < 2 3",
        "<style>p{}</style ><dl><dt>k<dd>v</dl>": "k\n\nv",
    }
    assert {x: html_to_text(x) for x in golden} == golden


def test_analysis_run(spark, folder):
    """Evidence of every run: ranks without gaps in the order of libraries, each chunk once, within the quotas, whole texts and reasons that fit."""
    texts = {r["item_id"]: r["text"] for r in rows(spark, folder, "benchmark")}
    order = {"psychology": 0, "literature": 1, "poetry": 2}
    by = defaultdict(list)
    for r in QUERIES["analysis_run"](spark, folder).collect():
        by[r["run_id"]].append(r)
    assert by
    for run in by.values():
        run.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in run] == list(range(1, len(run) + 1)) and [r["ev_id"] for r in run] == [f"e{r['rank']}" for r in run]
        assert [order[r["library"]] for r in run] == sorted(order[r["library"]] for r in run)
        assert len({r["chunk_id"] for r in run}) == len(run) <= 13
        for r in run:
            assert r["text"] == texts[r["chunk_id"]][:400] and r["library"] == list(order)[r["chunk_id"] % 3] and 0 < r["score"] < 1
            assert r["match_reason"].startswith("图谱" if r["path"] == "graph" else "向量") and r["source"] == "benchmark"
    assert {r["path"] for run in by.values() for r in run} == {"vector", "graph"}


def test_split_reports(spark):
    """Warnings of a split at their limits, and the error of a text that is too short."""
    from weftline.operators import chunking

    texts = {1: None, 2: "短文只有七个字", 3: "海上生明月。" * 40, 4: "x" * 5000, 5: "天涯共此时。" * 20 + "word " * 60, 6: "海" * 300, 7: "明月几时有？" * 200 + "海" * 700, 8: "ab"}
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    got = {r["id"]: r for r in chunking.split_reports(df, "id", "text").collect()}
    for i, t in texts.items():
        every = chunking.pieces(re.sub("[ \t]+", " ", t or "").strip())
        hard, n = sum(p[3] for p in every), len(re.sub("[ \t]+", " ", t or "").strip())
        assert (got[i]["pieces"], got[i]["hard"], got[i]["n_chars"]) == (len(every), hard, n)
        assert (got[i]["error"] is not None) == (n < 8) and ("cuts" in got[i]["warnings"]) == (hard > 0.2 * len(every)) and ("short" in got[i]["warnings"]) == (8 <= n < 200)
    assert got[4]["warnings"] == ["foreign", "cuts"] and got[3]["warnings"] == [] and got[5]["warnings"] == ["foreign"] and got[1]["warnings"] == []
