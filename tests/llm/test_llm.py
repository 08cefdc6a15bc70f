"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, and against brute force."""

import hashlib
import html
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import ann, bpe, html_labels, html_text, language, lm, mixing, near_dedup, quality, simhash, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a", "don't  stop \n\n now", "<|endoftext|> x<|endoftext|>", "Ünïcödé 漢字 😀    y", "tab\tand\r\nline ", "x" * 3000, "word " * 5000, "１２ 3", "à b \x1c c"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", f"s{i % 2}", 7) for i, t in enumerate(ODD)] + [(3, "a", "en", "s1", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, score int")


def test_token_counts(odd, none):
    t = Tokenizer.from_file(PATH)
    for r in token_counts.token_counts(odd, PATH, 512).collect():
        x = ODD[r["doc_id"]] or ""
        assert r["n_tokens"] == len(t.encode(x, add_special_tokens=False).ids), repr(x[:30])
        assert r["n_bytes"] == len(x.encode()) and r["over_limit"] == (r["n_tokens"] > 512)
    assert token_counts.token_counts(odd, PATH, 1).count() == len(ODD) + 1
    assert token_counts.token_counts(none, PATH, 1).count() == 0
    for x in ODD:
        assert "".join(token_counts.pieces(x or "")) == (x or "")


def test_token_batches():
    """Batches are balanced by bytes, and only long texts are cut, at safe boundaries."""
    texts = ["ab c" * 10, "漢字 かな" * 30, "x" * 500, "", None, "word  two\n three\t" * 200, "😀 " * 100]
    t = Tokenizer.from_file(PATH)
    expected = [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]
    for batch, long in ((1 << 20, 1 << 16), (300, 100), (64, 7), (1, 1)):
        assert token_counts.count_tokens(PATH, pa.array(texts), batch, long).tolist() == expected
    items = [(k, x, len(x.encode())) for k, x in enumerate(texts) if x]
    got = list(token_counts.batched(items, 1000))
    assert [o for owners, _ in got for o in owners] == [k for k, _, _ in items]
    assert all(sum(len(x.encode()) for x in b) <= 1000 or len(b) == 1 for _, b in got)
    long = "one two  three\n\nfour " * 500
    cut = list(token_counts.parts(long, 100))
    assert "".join(cut) == long and all(100 <= len(x) <= 110 for x in cut[:-1]) and all(not a[-1].isspace() and b[0].isspace() for a, b in zip(cut, cut[1:]))


def test_bpe(odd, none):
    t = Tokenizer.from_file(PATH)
    got = bpe.encoded(odd, PATH, keep=("source", "score"), texts=True, block_bytes=4000).collect()
    assert len(got) == len(ODD) + 1 and got[0].asDict().keys() >= {"source", "score"}
    for r in got:
        ids = t.encode(ODD[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == t.decode(ids, skip_special_tokens=False)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert bpe.encoded(none, PATH).count() == 0


def test_bpe_clashing_columns_and_shuffled_rows(spark, odd):
    """Kept columns give way to results of their name; documents out of a shuffle are written first."""
    expected = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in bpe.encoded(odd, PATH).collect())
    clash = odd.withColumns({"n_tokens": F.lit(-1), "ids_sha256": F.lit("x"), "sizes": F.lit(9), "_text": F.lit("y"), "block": F.lit(7), "data": F.lit(1)})
    got = bpe.encoded(clash.repartition(3, "source"), PATH, keep=("n_tokens", "ids_sha256", "sizes", "block", "data", "doc_id", "text", "text"))
    assert got.columns == ["doc_id", "sizes", "block", "data", "text", "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = got.collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in rows) == expected and {(r["sizes"], r["block"], r["data"]) for r in rows} == {(9, 7, 1)}
    assert "hashpartitioning(source" not in got._jdf.queryExecution().executedPlan().toString()


def test_clashing_columns(spark, odd):
    """Extra columns with the names of results change nothing."""
    clash = odd.withColumns({c: F.lit("clash") for c in ("n_bytes", "n_tokens", "over_limit", "held_out", "lang_pred", "predicted", "component", "text_key", "n_shingles")})
    plain, other = (sorted(map(str, token_counts.token_counts(df, PATH, 512).collect())) for df in (odd, clash))
    assert plain == other
    plain, other = (sorted((r["doc_id"], r["component"]) for r in near_dedup.labelled(df).select("doc_id", "component").collect() if r["component"] is not None) for df in (odd, clash))
    assert plain == other
    pages = spark.createDataFrame([(1, "<p>A page with a few words in it and no more than that at all.</p>", "x", 5)], "page_id int, html string, text string, n_chars int")
    assert pages.select("text", html_text.extracted("html").alias("t")).first()["text"] == "x"
    model = language.train(spark.createDataFrame([(k, ("the cat and the dog", "der hund und die katze")[k % 2] * 5, ("en", "de")[k % 2]) for k in range(40)], "doc_id long, text string, lang string"))
    plain, other = (sorted((r["doc_id"], str(r["l"])) for r in df.select("doc_id", language.language("text", model).alias("l")).collect()) for df in (odd, clash))
    assert plain == other
    machine = quality.train(spark.createDataFrame([(k, good(k) if k % 2 else junk(k)) for k in range(60)], "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int"))
    plain, other = (sorted((r["doc_id"], r["q"]) for r in df.select("doc_id", quality.quality_score("text", machine).alias("q")).collect()) for df in (odd, clash))
    assert plain == other


def test_simhash(spark, odd, none):
    rows = simhash.edited_documents(odd).collect()
    assert len(rows) == len(ODD) + 1
    for r in rows:
        x, y = ODD[r["doc_id"]] or "", ODD[(r["doc_id"] + 1) % len(ODD)] or ""
        k = len(x) // 4
        assert r["edited"] == x[: len(x) - k] + y[:k]
    texts = spark.createDataFrame([(1, "the same words here"), (2, "The  same words here"), (3, "quite other things are said"), (4, ""), (5, " ")], "k long, text string")
    f = {r["k"]: (r["hi"], r["lo"]) for r in simhash.fingerprints(texts).collect()}
    assert f[1] == f[2] != f[3] and f[4] == f[5] == (0, 0)
    assert simhash.edited_documents(none).count() == 0
    nulls = spark.createDataFrame([(None, "abcdefgh"), (5, "12345678"), (2_000_000, "x")], "doc_id long, text string")
    assert {r["doc_id"]: r["edited"] for r in simhash.edited_documents(nulls).collect()} == {None: "abcdef12", 5: "123456x", 2_000_000: "x"}


def test_simhash_search_finds_all(spark):
    rng = np.random.default_rng(1)
    base = [int.from_bytes(rng.bytes(16), "big") for _ in range(12)]
    fps = {b ^ sum(1 << int(k) for k in rng.choice(128, n, replace=False)) for b in base for n in (0, 1, 3, 5, 6, 7, 9, 12)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    split = lambda x: (signed(x >> 64), signed(x & (2**64 - 1)))
    df = spark.createDataFrame([split(x) for x in fps], "hi long, lo long")
    q = spark.createDataFrame([split(x) for x in base], "q_hi long, q_lo long")
    got = {((r["q_hi"], r["q_lo"]), (r["hi"], r["lo"])) for r in simhash.within(q, df, 6).collect()}
    assert got == {(split(b), split(x)) for b in base for x in fps if (b ^ x).bit_count() <= 6}


def brute_fingerprint(text):
    """128 votes, one by one; the hash is Spark's xxhash64."""
    h = lambda parts: __import__("functools").reduce(lambda seed, p: xxhash.xxh64_intdigest(p, seed), parts, 42)
    w = re.split(r"\s+", text.lower(), flags=re.A)
    w = [x for x in w if x] or [""]
    pairs = list(zip(w, w[1:])) or [(w[0], "")]
    votes, total = [0] * 128, 0
    for a, b in pairs:
        weight = min(simhash.LONGEST, len(a) + len(b))
        total += weight
        for half, bits in enumerate((h((a.encode(), b.encode())), h((b.encode(), (1).to_bytes(4, "little"), a.encode())))):
            for k in range(64):
                votes[64 * (1 - half) + k] += weight * (bits >> k & 1)
    return sum(1 << k for k, v in enumerate(votes) if 2 * v > total)


def test_simhash_query_is_brute_force(spark, none):
    rng = np.random.default_rng(8)
    words = [f"W{int(x)}" for x in rng.integers(0, 400, 500)]
    texts = {}
    for i in range(150):
        base = list(words[(i // 3) * 7 : (i // 3) * 7 + 60])
        if i % 3:
            base[int(rng.integers(0, 60))] = f"x{i % 2}"
        texts[i * 2] = " ".join(base)
    texts |= {400: None, 401: "", 402: "one", 500: "a  b\n c" * 50, 600: texts[100]}
    order = sorted(texts)
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in texts.items()], "doc_id long, text string, salt int, k int")
    got = {r["doc_id"]: r for r in simhash.fingerprint_report(docs).collect()}
    assert len(got) == len(texts)
    x = {d: texts[d] or "" for d in order}
    fp = {d: brute_fingerprint(x[d]) for d in order}
    like = lambda a, b: max(0.0, math.cos(math.pi * (a ^ b).bit_count() / 128))
    near = 0
    for d, then in zip(order, order[1:] + order[:1]):
        n = len(x[d]) // 4
        edited = x[d][: len(x[d]) - n] + x[then][:n]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(x[d]), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (f"{fp[d]:032x}", f"{brute_fingerprint(edited):032x}")
        assert math.isclose(r["near_edited"], like(fp[d], brute_fingerprint(edited)), abs_tol=1e-12)
        assert math.isclose(r["near_next"], like(fp[d], fp[then]), abs_tol=1e-12)
        within = sum((fp[d] ^ fp[e]).bit_count() <= simhash.RADIUS for e in order if e != d)
        assert r["n_within"] == (within if d % 100 == 0 else None)
        near += within if d % 100 == 0 else 0
    assert near > 0
    assert simhash.fingerprint_report(none).count() == 0


def test_simhash_hot_ids(spark):
    """Most rows share an id or have none: each has its own result, and the next document is one of the next id's."""
    rows = [(None, f"null {i} text here") for i in range(300)] + [(5, f"five {i} other words") for i in range(300)] + [(9, "nine is the last of them")]
    got = simhash.fingerprint_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 601 and Counter(r["doc_id"] for r in got) == {None: 300, 5: 300, 9: 1}
    edits = {hashlib.sha256((t[: len(t) - len(t) // 4] + "nine is the last of them"[: len(t) // 4]).encode()).hexdigest() for d, t in rows if d == 5}
    assert {r["edited_sha256"] for r in got if r["doc_id"] == 5} == edits
    assert {r["fingerprint"] for r in got} == {f"{brute_fingerprint(t):032x}" for _, t in rows}


def test_next_ids(spark):
    ids = sorted({int(x) for x in np.random.default_rng(2).integers(-5_000_000, 5_000_000, 300)})
    df = spark.createDataFrame([(i,) for i in ids], "k long")
    assert {r["k"]: r["next_k"] for r in simhash.following(df, ids[0], ids[-1]).collect()} == dict(zip(ids, ids[1:] + ids[:1]))


PAGES = {
    "<body><nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>One  two<br>three</p><p>x</p></article><footer>Long footer with many words that says nothing at all about it</footer>": "T & U One two three x",
    "<main><p>Kept text.</p><form>Name <input> and a longer sentence about sending</form><aside>Aside words in a row of ten or more for sure here</aside><p>End</main>": "Kept text. End",
    "<article><p>Body <script>var a='<p>no</p>'</script>goes on.</p><div class='comment-list'><p>First! I think that this is a very long comment by a reader.</p></div></article>": "Body goes on.",
    "<article><div class='ad-slot'>Buy now and save a lot of money with this fine offer today</div><p>Real.</p><!-- <p>hidden</p> --><style>p{}</style></article>": "Real.",
    "": "",
    "<p": "",
    "<nav><a href=1>only</a> <a href=2>links</a></nav>": "",
}


def test_html(spark):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(PAGES)] + [(99, None)], "page_id int, html string")
    got = {r["page_id"]: r["t"] for r in df.select("page_id", html_text.extracted("html").alias("t")).collect()}
    assert got == {i: t for i, t in enumerate(PAGES.values())} | {99: ""}


def test_html_marked_inline_elements():
    """A marked inline element takes no words of its paragraph with it, wherever it stands and however long it is."""
    a = "The river rose by two metres in the night and the old bridge was closed to all traffic before dawn."
    b = "Engineers of the county said that the piers had held and that the road would open again within a week."
    note = "Measured at the gauge below the weir, which has been read twice a day by the same family since the spring of the great flood, as the yearbook of the county tells at length on its first pages."
    tree = html_text.trained()
    for inner in ('<sup class="footnote-ref">1</sup>', '<span class="notice">soon</span>', '<a class="related" href="/w">the warden</a>', '<span class="tag">x <span>y</span> z</span>', f'<span class="footnote">{note}</span>', '<b class="top"><i class="meta">u</b>'):
        got = html_text.main_text(f"<html><body><article><h1>Flood</h1><p>{a}{inner} {b}</p><p>{b} {a}</p></article></body></html>", tree)
        assert got.count(a) == got.count(b) == 2, (inner, got)
    # in the middle of a sentence a link's words are words of the sentence
    got = html_text.main_text(f'<article><p>{a} See <a class="related" href="/w">the report</a> for more. {b}</p></article>', tree)
    assert got == f"{a} See the report for more. {b}"
    # marked words on their own are against content, without a word of what stands around them
    found = html_text.blocks(f'<article><p>{a}</p><div><span class="share">Share this</span></div><div>12 May <span class="reply-link">Anna B. Smith</span></div></article>')
    assert [(f[0], f[4][3]) for f in found] == [(a, 0), ("Share this", 1), ("12 May", 0), ("Anna B. Smith", 1)]


LONG = ["Rain fell on the hills for the whole of the week, and by Friday the lower fields stood under a foot of brown water.", "The fire brigade used two boats to bring the sheep to the higher ground, which took them until well after dark.", "A spokesman for the county said that the drains along the main road had been cleared in the autumn, as they are every year."]
HELD_OUT = {
    # names of what encloses the article do not speak against it
    f"<body><div class='layout has-sidebar'><article><h1>Floods</h1><p>{LONG[0]}</p><p>Short.</p></article></div></body>": f"Floods {LONG[0]} Short.",
    f"<body><div class='top-story'><article><h1>Floods</h1><p>{LONG[0]}</p></article></div></body>": f"Floods {LONG[0]}",
    f"<form id='aspnetForm'><div class='page sidebar-right'><h1>Floods</h1><p>{LONG[0]}</p><p>{LONG[1]}</p></div></form>": f"Floods {LONG[0]} {LONG[1]}",
    # lists of links go, single links and lists of text stay
    f"<article><h1>Floods</h1><p>{LONG[0]}</p><ul><li><a href=1>Older news</a></li><li><a href=2>Weather maps</a></li><li><a href=3>Road closures</a></li><li><a href=4>Contact</a></li></ul><p>{LONG[1]}</p></article>": f"Floods {LONG[0]} {LONG[1]}",
    f"<article><h1>Floods</h1><p>{LONG[0]}</p><ul><li>one boat</li><li>two ropes</li><li>a <a href=x>lamp</a> and oil</li></ul><p>{LONG[1]}</p></article>": f"Floods {LONG[0]} one boat two ropes a lamp and oil {LONG[1]}",
    # what is none of the listed kinds stays
    f"<article><h1>Floods</h1><p class='byline'>By Ann Lee</p><p>{LONG[0]}</p><p>Flow is <math><mi>Q</mi><mo>=</mo><mi>v</mi><mi>A</mi></math> here.</p><p class='tags'>Rivers, weather</p><p>All rights reserved.</p></article>": f"Floods By Ann Lee {LONG[0]} Flow is Q=vA here. Rivers, weather All rights reserved.",
    # neither a main part nor names
    f"<body><ul><li><a href=1>Home</a></li><li><a href=2>Sport</a></li><li><a href=3>Jobs</a></li></ul><h1>Floods in the valley</h1><p>{LONG[0]}</p><p>They waited.</p><p>{LONG[1]}</p><p>{LONG[2]}</p><p>Sign up to our newsletter for more stories like this one.</p></body>": f"Floods in the valley {LONG[0]} They waited. {LONG[1]} {LONG[2]}",
    f"<body><div><a href=1>Home</a> <a href=2>Sport</a> <a href=3>Jobs</a></div><h1>Floods</h1><div>{LONG[2]}</div><div>{LONG[1]}</div><div>{LONG[0]}</div><div><a href=1>Next</a> <a href=2>Back</a></div></body>": f"Floods {LONG[2]} {LONG[1]} {LONG[0]}",
    # a comment may be an article of its own
    f"<article class='post'><h1>Floods</h1><p>{LONG[0]}</p></article><div><article class='comment'><p>I saw it from my window and it was worse than that, I can tell you.</p></article></div>": f"Floods {LONG[0]}",
}


TALE = ["The day began early at the bakery by the canal, where the ovens had been lit since three in the morning.", "By noon the queue went round the corner and the last loaves were shared out among those who had waited longest."]
SPOKEN = {
    f"<article><h1>Title</h1><p>{TALE[0]}</p><p>Bake the cookies for ten minutes until they are brown at the edges and let them cool.</p></article>": f"Title {TALE[0]} Bake the cookies for ten minutes until they are brown at the edges and let them cool.",
    f"<article><h1>Title</h1><p>{TALE[0]}</p><p>Voters must register before the first of May at the town hall.</p><p>{TALE[1]}</p></article>": f"Title {TALE[0]} Voters must register before the first of May at the town hall. {TALE[1]}",
    f"<main><div class='ad-free-content'><p>{TALE[0]}</p><p>{TALE[1]}</p></div></main>": f"{TALE[0]} {TALE[1]}",
    f"<div id='content'><div class='legal-analysis'><p>{TALE[0]}</p><p>{TALE[1]}</p></div></div>": f"{TALE[0]} {TALE[1]}",
    f"<article><p>{TALE[0]}</p><p class='text-comment'>{TALE[1]}</p></article>": f"{TALE[0]} {TALE[1]}",
    f"<article><h1>Title</h1><p>{TALE[0]}</p><p>{TALE[1]}</p><section><h2>Comments</h2><article><p>I was there too and it was as they say.</p></article><article><p>Lovely!</p></article></section></article>": f"Title {TALE[0]} {TALE[1]}",
    f"<article><h1>Title</h1><p>{TALE[0]}</p><p>{TALE[1]}</p><h3>Other stories</h3><ul><li><a href=1>A new bridge</a></li><li><a href=2>The old mill</a></li><li><a href=3>Ten walks</a></li></ul></article>": f"Title {TALE[0]} {TALE[1]}",
    f"<article><h1>Title</h1><p>{TALE[0]}</p><div class='comments-area'><p>I was there too and it was as they say.</p></div><div class='ad-slot'><p>Buy shoes today and pay only half of what they cost.</p></div><p>{TALE[1]}</p></article>": f"Title {TALE[0]} {TALE[1]}",
}


def test_html_words_alone_do_not_decide():
    """Words of calls and names that sound like a frame's take no text out of an article, at any length; others' articles go."""
    tree = html_text.trained()
    for page, text in SPOKEN.items():
        assert html_text.main_text(page, tree) == text, page
    call = "Subscribe to our newsletter and sign up to the list, the town said in its letter to all who live here"
    kept = [html_text.main_text(f"<article><h1>T</h1><p>{TALE[0]}</p><p>{call}{' and more' * n}.</p><p>{TALE[1]}</p></article>", tree).count(call) for n in (0, 5, 12, 13, 14, 25, 60)]
    assert len(set(kept)) == 1


def test_html_held_out():
    """Pages that are not in the labelled table."""
    tree = html_text.trained()
    for page, text in HELD_OUT.items():
        assert html_text.main_text(page, tree) == text
    used: set = set()
    todo = [tree]
    while todo:
        node = todo.pop()
        if len(node) > 1:
            used.add(html_text.FEATURES[node[0]])
            todo += node[2:]
    assert {"words", "link_density", "prev_words", "next_words", "next_link_density"} <= used
    wrong = [k != y for page, marks in html_labels.LABELLED_PAGES for f, content in [html_text.labelled(page, marks)] for k, y in zip(html_text.classify(tree, html_text.features(f)), content)]
    assert np.mean(wrong) < 0.02


def test_html_odd_pages(spark):
    rows = [(1, None, "u", 3), (2, "<article>" + f"<p>{LONG[0]}</p>" * 20_000 + "</article>", "u", 3), (3, "<article><p>" + "<div>" * 3000 + LONG[1], "u", 3), (3, f"<article>{LONG[2]}</article>", "u", 3), (4, "<article><p>&lt;b&gt; &#x41;&nbsp;\n\t x</p></article>", "u", 3)]
    df = spark.createDataFrame(rows, "page_id int, html string, text string, n_chars int")
    got = sorted((r["page_id"], r["t"]) for r in df.select("page_id", html_text.extracted("html").alias("t")).collect())
    assert got == [(1, ""), (2, " ".join([LONG[0]] * 20_000)), (3, LONG[2]), (3, LONG[1]), (4, "<b> A x")]
    assert df.limit(0).select(html_text.extracted("html")).count() == 0


def junk(i):
    return " ".join(f"w{j % 17}###" for j in range(i % 30 + 20))


def good(i):
    return " ".join(("the", "sun", "rose", "over", "hills", "and")[(i * j) % 6] for j in range(i % 30 + 20)) + "."


def test_quality(spark, none):
    rows = [(i, junk(i) if i % 3 == 0 else good(i)) for i in range(300)] + [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i % 3 == 0 else 1) for i in range(300)] + [(1000, None)], "doc_id long, quality int")
    m = quality.train(docs, labels)
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", quality.quality_score("text", m).alias("s")).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 3 != 0) for i in held]) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001]
    # linear time and pair by pair are one
    i, x = m.values(*quality.featurise(good(5)))
    pairs = sum(x[a] * x[b] * (m.v[i[a]] @ m.v[i[b]]) for a in range(len(i)) for b in range(a))
    z = m.bias + x @ m.w[i] + pairs
    assert abs(m.score(good(5)) - 1 / (1 + math.exp(-z))) < 1e-9
    one = quality.train(docs, labels.filter("quality = 1"))
    assert one.score("x") > 0.9 and quality.train(none, labels).score("x") == 0.5


def test_language(spark, odd, none):
    rows = [(i, "the cat and the dog were in the house with that thing", "en") for i in range(20)] + [(i, "der hund und die katze sind nicht ein haus auf dem berg", "de") for i in range(20, 40)]
    docs = spark.createDataFrame(rows + [(90, None, "en"), (91, "12 34 .", None), (92, "", "xx")], "doc_id long, text string, lang string")
    m = language.train(docs)
    assert set(m.names) <= {"de", "en", "xx"}
    got = {r["doc_id"]: (r["l"]["lang_pred"], r["l"]["score"]) for r in docs.select("doc_id", language.language("text", m).alias("l")).collect()}
    assert all(got[i][0] == ("en" if i < 20 else "de") for i in range(40))
    assert got[90] == got[91] == got[92] == ("und", 0.0)
    both = m.predict("the cat and the dog were in the house with that thing " * 3 + "der hund und die katze sind nicht ein haus auf dem berg " * 2)
    assert both[0] == "en" and 0.4 < both[1] < 0.9 and min(s for n, s in zip(m.names, both[2]) if n in ("de", "en")) > 0.2
    assert language.train(none).predict("word") == ("und", 0.0, [])


def brute_components(texts, width, percent):
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return {d: (len(sets[d]), root[d], root[d] == d) for d in sets}


def test_near_duplicates(spark, none):
    rng = np.random.default_rng(5)
    texts = {}
    for g in range(12):
        base = [f"w{int(x)}" for x in rng.integers(0, 900, int(rng.integers(3, 120)))]
        for _ in range(6):
            w = list(base)
            for k in rng.integers(0, len(w), int(rng.integers(0, 4))):
                w[k] = f"n{int(rng.integers(0, 10**6))}"
            texts[len(texts)] = "  ".join(w).upper() if rng.random() < 0.3 else " ".join(w)
    texts |= {100: None, 101: "", 102: " \n", 103: "one", 104: "ONE", 105: "one two"}
    docs = spark.createDataFrame([(d, t, 1) for d, t in texts.items()] + [(103, "one", 1), (None, "one", 1)], "doc_id long, text string, rep int")
    for width, percent in ((4, 80), (5, 80)):
        rows = near_dedup.near_duplicates(docs, width, percent).collect()
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows}
        assert len(rows) == len(texts) + 2 and got.pop(None) == (1, None, True)
        assert got == brute_components(texts, width, percent)
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_duplicates_repeated_ids(spark):
    """Rows that share an id are linked each by its own text; a large bucket is compared part by part."""
    words = [f"w{i}" for i in range(60)]
    first, second = " ".join(words[:50]), " ".join(f"x{i}" for i in range(50))
    near = second.replace("x7 ", "y ")
    docs = spark.createDataFrame([(1, first), (1, second), (2, near), (3, first), (1, second)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs, 4, 80).collect())
    assert got == [(1, 1, True)] * 3 + [(2, 1, False), (3, 1, False)]
    assert near_dedup.labelled(docs, 4, 80).select("component").distinct().count() == 2


def test_near_duplicates_in_parts(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PART", 3)
    rng = np.random.default_rng(9)
    texts = {}
    for g in range(3):
        base = [f"g{g}w{int(x)}" for x in rng.integers(0, 900, 60)]
        for _ in range(12):
            w = list(base)
            for k in rng.integers(0, len(w), int(rng.integers(0, 5))):
                w[k] = f"n{int(rng.integers(0, 10**6))}"
            texts[len(texts)] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs, 5, 80).collect()}
    assert got == brute_components(texts, 5, 80)


def test_bounds_lose_no_link():
    a, b = near_dedup.shingles("a b c d e f g h", 4), near_dedup.shingles("a b c d e f g x", 4)
    differ = sum(int(x).bit_count() for x in near_dedup.bit_map(a).view(np.uint64) ^ near_dedup.bit_map(b).view(np.uint64))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert (len(a) + len(b) - differ) / (len(a) + len(b) + differ) >= true
    for n in (25, 125):
        m = near_dedup.least_matches(0.8, 1e-6, n)
        assert sum(math.comb(n + 1, k) * 0.8**k * 0.2 ** (n + 1 - k) for k in range(m)) < 1e-6


def test_language_learns_rare_ones(spark):
    rows = [(i, "the sun rose over hills", "en") for i in range(6000)] + [(7000 + i, "солнце взошло над холмами", "ru") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, sample_rows=60)
    assert model.names == ["en", "ru"] and model.predict("солнце над холмами")[0] == "ru"
    # the most frequent trigrams were counted once a document: the common language keeps to its part of the bound
    assert 20 < (model.p[0].max() / model.p[0].min() - 1) * language.SMOOTH < 120


def test_mixing(spark, none):
    rows = [(i, "a" if i < 700 else "b" if i < 1000 else None) for i in range(1100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mixed(docs, {"a": 3, "b": 1, None: 1}, block_rows=10, period=20).collect()
    assert len({r["doc_id"] for r in got}) == 1100 and len({r["mix_pos"] for r in got}) == 1100
    slots = sorted({(r["mix_slot"], r["source"]) for r in got}, key=lambda x: x[0])
    assert [s for s, _ in slots] == list(range(110))
    left, seen = {"a": 70, "b": 30, None: 10}, Counter()
    for n, (_, s) in enumerate(slots, 1):
        seen[s] += 1
        if any(seen[x] == left[x] for x in left):
            break
        for x, share in (("a", 0.6), ("b", 0.2), (None, 0.2)):
            assert abs(seen[x] - n * share) < 1
    assert mixing.mixed(none).count() == 0
    assert {r["source"] for r in mixing.mixed(docs, {"a": 1}, block_rows=10).filter("mix_slot < 70").collect()} == {"a"}


def test_mixing_without_ids_and_with_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    rows = [(None if i % 2 else 7, f"text {i}", "a" if i < 800 else "b", i, i, "h") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_pos long, mix_slot long, mix_h_ string")
    got = mixing.mixed(docs, block_rows=10)
    assert sorted(got.columns) == sorted(["doc_id", "text", "source", "mix_h_", "source_block", "mix_slot", "mix_pos"])
    rows = got.collect()
    assert len({r["text"] for r in rows}) == len(rows) == 1000 and sorted(r["mix_pos"] for r in rows) == list(range(1000))


def test_mixing_two_thirds():
    """Weights 2/3 and 1/3 over 300,000 blocks: less than one block from the target at any time."""
    from fractions import Fraction

    plan = mixing.schedule({"a": 200_000, "b": 100_000}, {"a": Fraction(2, 3), "b": Fraction(1, 3)})
    n = np.arange(1, 300_001)
    off = np.cumsum(plan.order == 0) * 3 - 2 * n
    assert abs(off).max() < 3


def test_mixing_keeps_exact_weights():
    """Weights that divide no period, over many slots; and sources far smaller than a slot in a thousand."""
    uneven = {"a": math.sqrt(2), "b": math.pi, "c": 0.1, None: 1 / 3}
    tiny = {"big": 1e6} | {f"t{i:04}": 1.0 + i / 7 for i in range(1500)}
    for weights, blocks in ((uneven, dict.fromkeys(uneven, 30_000)), (tiny, {"big": 20_000} | {s: 3 for s in tiny if s != "big"})):
        plan = mixing.schedule(blocks, weights)
        assert Counter(plan.names[k] for k in plan.order) == blocks
        total = sum(weights.values())
        last = min(int(np.flatnonzero(plan.order == k)[-1]) for k in range(len(plan.names)))
        for k, s in enumerate(plan.names):
            off = np.cumsum(plan.order == k)[:last] - np.arange(1, last + 1) * (weights[s] / total)
            assert abs(off).max(initial=0) < 1 + 1e-6, s
        slots = plan.slot_of(np.repeat(np.arange(len(plan.names)), [blocks[s] for s in plan.names]), np.concatenate([np.arange(blocks[s]) for s in plan.names]))
        assert sorted(slots.tolist()) == list(range(len(plan.order)))


def test_ann(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16))
    rows = [(i, [float(np.float32(v)) for v in r], 1) for i, r in enumerate(x)]
    bad = [(1000, None, 1), (1050, [0.0] * 16, 1), (1100, [float("nan")] + [1.0] * 15, 1), (1150, [None] + [1.0] * 15, 1), (1200, [1.0], 1), (1250, [], 1)]
    df = spark.createDataFrame(rows + bad + [(601, rows[0][1], 1)], "vec_id long, embedding array<float>, rank int")
    got = ann.nearest(df, df.filter("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect()
    assert {r["query_id"] for r in got} == set(range(0, 600, 50)) and len(got) == 12 * 5
    assert got[0]["vec_id"] == 601 and abs(got[0]["score"] - 1) < 1e-12
    u = np.array([r[1] for r in rows])
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    hits = 0
    for q in range(0, 600, 50):
        s = u @ u[q]
        s[q] = -9
        best = set(np.argsort(-s)[:5].tolist())
        hits += len(best & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hits >= 0.9 * 59
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>, rank int")
    assert ann.nearest(few, few, 5).count() == 6
    assert ann.nearest(few.limit(0), few.limit(0), 5).count() == 0


def test_ann_query_recall_and_ties(spark, folder):
    """The registered query with its own parameters against brute force on the given table, and equal vectors by id."""
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in rows if r["embedding"] is not None}
    ids = sorted(i for i, v in x.items() if np.isfinite(v).all() and v.any())
    u = np.array([x[i] / np.sqrt((x[i] ** 2).sum()) for i in ids])
    got: dict = {}
    for r in ann.op8_ann(spark, folder).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for at, i in enumerate(ids):
        if i % 50 == 0:
            s = u @ u[at]
            s[at] = -9
            best = {ids[j] for j in np.argsort(-s, kind="stable")[:5]}
            assert [r for r, _, _ in sorted(got[i])] == [1, 2, 3, 4, 5]
            assert all(abs(score - u[ids.index(v)] @ u[at]) < 1e-12 for _, v, score in got[i])
            hits += len(best & {v for _, v, _ in got[i]})
            total += 5
    assert hits >= 0.9 * total
    same = spark.createDataFrame([(i, [1.0, 2.0, 3.0 + (i > 40)]) for i in range(60)], "vec_id long, embedding array<double>")
    got = ann.nearest(same, same.filter("vec_id = 0"), 5).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 3, 4, 5]


def test_lm(spark, none):
    texts = [(i, ["a b c a b", "A B  d", None, "", "zz a\tb c", "b a b c d e " * 40, "q%d r%d s%d a b" % (i, i, i), " \n "][i % 8]) for i in range(48)]
    docs = spark.createDataFrame([(*t, 1.0, 3) for t in texts] + [(None, "a b c", 1.0, 3), (7, "a b", 2.0, 3)], "doc_id long, text string, score double, block int")
    texts = texts + [(None, "a b c"), (7, "a b")]
    train = F.col("doc_id") % 5 != 1
    got = lm.lm_scores(docs, train, block_bytes=300).collect()
    assert len(got) == len(texts)
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    c = Counter()
    for i, t in texts:
        if i is not None and i % 5 != 1:
            s = ["<s>", *words(t), "</s>"]
            c.update((w,) for w in s)
            c.update(zip(s, s[1:]))
            c.update(zip(s, s[1:], s[2:]))
    n = sum(k for g, k in c.items() if len(g) == 1 and g != ("<s>",))
    v = sum(len(g) == 1 and g != ("<s>",) for g in c)
    p = lambda w: (c[w,] + 0.5) / (n + 0.5 * (v + 1))
    p2 = lambda u, w: (c[u, w] + lm.K[0] * p(w)) / (c[u,] + lm.K[0])
    p3 = lambda t, u, w: (c[t, u, w] + lm.K[1] * p2(u, w)) / (c[t, u] + lm.K[1])
    brute = {}
    for i, t in texts:
        s = ["<s>", *words(t), "</s>"]
        base = sum(math.log10(p(w)) for w in s[1:])
        score = math.log10(p2(s[0], s[1])) + sum(math.log10(p3(*g)) for g in zip(s, s[1:], s[2:]))
        brute.setdefault(i, []).append((len(s) - 1, sum(c[w,] > 0 for w in s[1:]), n, base, score))
    for r in got:
        mine = (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"])
        assert any(mine[:3] == x[:3] and math.isclose(mine[3], x[3], rel_tol=1e-9) and math.isclose(mine[4], x[4], rel_tol=1e-9) for x in brute[r["doc_id"]]), (mine, brute[r["doc_id"]])
    # after any context the probabilities of all words, known and unknown, make one
    known = [g[0] for g in c if len(g) == 1 and g != ("<s>",)] + ["unknown"]
    for context in (("a", "b"), ("<s>", "a"), ("b", "e"), ("unknown", "a")):
        assert math.isclose(sum(p3(*context, w) for w in known), 1)
    assert lm.lm_scores(none, F.lit(True)).count() == 0
    assert lm.lm_scores(docs, F.lit(False)).first()["train_tokens"] == 0


def test_lm_segments_and_frequent_words():
    """A text read in segments has the same probability, whatever their length; the automaton follows failure arcs."""
    texts = pa.array(["the cat sat on the mat and the cat ran", "the the the " * 50, "new words only here", "the cat", ""])
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(5), pa.int64()), "text": texts, "train": pa.array([True, True, False, False, True])})
    words, at, sizes = lm.words_of(texts)
    keys = lm.hashed(words.to_pylist())
    order = np.argsort(keys)
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(2, 2 + len(order))
    data = lm.ipc(pa.table({"doc_id": batch["doc_id"], "train": batch["train"], "sizes": pa.array(sizes)}))
    row = pa.table({"data": [data], "n": [len(keys)], "words": [lm.squeezed(keys[order])], "places": [lm.planes(place[at])]})
    b = lm.Block(row)
    b.triples()
    a = lm.Automaton(b, b.c1, b.c2, b.c3, int(b.c1.sum()), int(np.count_nonzero(b.c1)))
    whole = lm.traversed(b, a)
    for segment in (1, 2, 3, 7, 64):
        assert np.allclose(lm.traversed(b, a, segment), whole, rtol=1e-12)
    # "new" was never read: from the beginning's state the failure arc leads to the empty context
    state, score = a.read(np.array([a.word_state[lm.START]]), np.array([place[words.to_pylist().index("new")]]))
    assert state[0] == 0 and math.isclose(score[0], a.failure[1 + lm.START] + a.p1[place[words.to_pylist().index("new")]])


def held_out(doc_id, fold=0):
    return zlib.crc32(str(doc_id).encode()) % 5 == fold


def test_html_query(spark, folder):
    """The text of every given page is that of its article, white space aside."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = html_text.op3_html_text(spark, folder).collect()
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    for r in got:
        article = re.search(r"(?s)<article[^>]*>(.*)</article>", pages[r["page_id"]])
        assert "".join(r["text"].split()) == "".join(html.unescape(re.sub("<[^>]*>", " ", article[1])).split()) and r["n_chars"] == len(r["text"])


def test_quality_query(spark):
    at = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in quality.op5_quality(spark, at).collect()}
    assert all(r["held_out"] == held_out(d) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for d, r in got.items())
    right = [got[d]["predicted"] == q for d, q in labels.items() if held_out(d) and q is not None]
    assert len(got) == 1000 and np.mean(right) > 0.95


def test_language_query(spark):
    at = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in language.op9_language(spark, at).collect()}
    assert set(got) == set(docs) and all(r["held_out"] == held_out(d) and 0 <= r["score"] <= 1 for d, r in got.items())
    seen = [(got[d]["lang_pred"], r["lang"]) for d, r in docs.items() if held_out(d) and r["lang"] and re.search(r"[^\W\d_]", r["text"] or "")]
    assert np.mean([a == b for a, b in seen]) > 0.97


def test_mixture_is_brute_force_em():
    """Proportions of two languages by expectation-maximisation written out term by term."""
    rng = np.random.default_rng(11)
    p = rng.dirichlet(np.ones(40), 2)
    counts = np.bincount(np.concatenate([rng.choice(40, 700, p=p[0]), rng.choice(40, 300, p=p[1])]), minlength=40).astype(float)
    got = language.Languages(["a", "b"], p).mixture(np.arange(40), counts)
    share = [0.5, 0.5]
    for _ in range(2000):
        new = [0.0, 0.0]
        for g in range(40):
            total = sum(share[k] * p[k, g] for k in range(2))
            for k in range(2):
                new[k] += counts[g] / counts.sum() * share[k] * p[k, g] / total
        share = new
    assert np.allclose(got, share, atol=2e-3) and abs(got[0] - 0.7) < 0.06


def test_pipeline_is_brute_force(spark, folder):
    """Every stage's rows by plain Python over all rows of the stage before."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = language.train(docs)
    told = {d: model.predict(r["text"]) for d, r in rows.items()}
    rows = {d: r for d, r in rows.items() if told[d][0] != "und" and told[d][1] >= language.LEAST_SHARE}
    machine = quality.train(docs.filter(F.col("doc_id").isin(list(rows))), spark.read.parquet(f"{folder}/labels.parquet"))
    rows = {d: r for d, r in rows.items() if machine.score(r["text"]) >= quality.THRESHOLD}
    label = brute_components({d: r["text"] for d, r in rows.items()}, 5, 80)
    rows = {d: r for d, r in rows.items() if label[d][2]}
    got = {r["doc_id"]: r for r in P.run(spark, folder).collect()}
    assert set(got) == set(rows)
    t = Tokenizer.from_file(PATH)
    for d, r in got.items():
        ids = t.encode(rows[d]["text"] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r["source"] == rows[d]["source"]
    # at each slot before a source ends, sources have their share of the slots but for less than one block
    order = [got[d]["source"] for d in sorted(got, key=lambda d: got[d]["mix_pos"])]
    slots = [s for _, s in sorted({(r["mix_pos"] // mixing.BLOCK_ROWS, r["source"]) for r in got.values()})]
    n = Counter(order)
    share = {s: math.sqrt(k) for s, k in n.items()}
    left, seen = {s: -(-k // mixing.BLOCK_ROWS) for s, k in n.items()}, Counter()
    assert Counter(slots) == left
    for at, s in enumerate(slots, 1):
        seen[s] += 1
        assert all(abs(seen[x] - at * share[x] / sum(share.values())) < 1 + 1e-9 for x in n)
        if any(seen[x] == left[x] for x in n):
            break


def test_pipeline_on_odd_rows(spark, folder, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, further columns, and no rows at all."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 60")
    odd = spark.createDataFrame([(None, None, None, None, None), (5, "", None, None, 0), (6, None, "en", None, None), (7, "word and the that " * 30_000, "en", None, 1), (None, "the cat and the dog were in the house. " * 5, "en", "s", 1)], docs.schema)
    some = docs.union(odd).union(docs.limit(20)).withColumns({"_t": F.lit(1), "score": F.lit("x"), "mix_pos": F.lit(9)})
    for rows in (some, some.limit(0)):
        seen = rows
        for k, (_, stage) in enumerate(P.STAGES):
            out = stage(spark, seen, folder)
            if k + 1 < len(P.STAGES):
                assert set(rows.columns) <= set(out.columns)
                seen = P.stored(out, "odd")
        n = seen.count()
        assert out.count() == n and seen.filter("doc_id is not null").groupBy("doc_id", "text").count().filter("count > 1").count() == 0
        assert rows is not some or n > 0


def test_pipeline(spark, folder):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = docs
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, seen, folder)
        if k + 1 < len(P.STAGES):
            assert set(docs.columns) <= set(out.columns)
            seen = P.stored(out, "test")
            assert seen.select("doc_id").distinct().count() == seen.count() > 0
    rows = out.collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in seen.collect()} and len({r["mix_pos"] for r in rows}) == len(rows)
