"""N-grams by arrays: the rules of lexical, letters of all widths, and texts that are cut, repeated or longer than what one task picks from."""

import math
import re
from collections import Counter

import numpy as np

from weftline.functions import grams as G
from weftline.functions import lexical as L
from weftline.operators import keyphrases as K


def plain(text):
    each = [run[i : i + n] for run in re.split(L.RUN_BREAK, text, flags=re.ASCII) for n in range(L.SHORTEST, L.LONGEST + 1) for i in range(len(run) - n + 1)]
    return Counter(g for g in each if g[0] not in L.NOT_FIRST and g[-1] not in L.NOT_LAST and g not in L.STOP_WORDS)


def best(counts, k):
    noun = lambda g: 1.8 if re.search("(?:" + "|".join(L.NOUN_ENDINGS) + ")[\x85\u2028\u2029]?$", g) else 1.0
    kept = []
    for g in sorted(counts, key=lambda g: (-round(math.log1p(counts[g]) * len(g) ** 1.2 * noun(g), 9), -len(g), g)):
        if len(kept) < k and not any(g in x or x in g for x in kept):
            kept.append(g)
    return kept


def texts():
    rng = np.random.default_rng(2)
    some = ["".join(rng.choice(list("自由意志主义论的了个我们,。 \n一定ab"), n)) for n in rng.integers(0, 400, 40)]
    every = "".join(chr(c) for c in rng.permutation(np.r_[0x4E00:0x9FFF, 0xAC00:0xD7A3, 0x20000:0x2A000]))  # too many letters to be packed side by side
    return [*some, "", "a", "理论\u2028 x理论\u2029 存在\x85 x\0y\0\0 é\xa0é　é 😀😀ab😀😀", "ab" * 300, every, every[::-1] + every[:50]]


def test_counts_and_phrases_equal_plain_python():
    every = texts()
    for some in (every[:43], every[43:], every):
        g = G.Grams(some)
        got = [Counter() for _ in some]
        for t, name, n in zip(g.text.tolist(), g.names().to_pylist(), g.n.tolist()):
            assert name not in got[t]
            got[t][name] = n
        assert got == [plain(t) for t in some]
        assert g.phrases(len(some), 6) == [best(plain(t), 6) for t in some]


def test_no_text_leaves_its_task_but_repeated_and_long_ones(spark):
    """All n-grams of all texts went through a shuffle."""
    every = [(k, t) for k, t in enumerate(texts()[:44])]
    df = spark.createDataFrame([*every, (3, every[5][1]), (None, "some words"), (99, None)], "id int, text string").repartition(3)
    want = {k: plain(t) for k, t in every}
    want[3] = want[3] + want[5]
    for long in (100, K.LONG):
        got = {r["id"]: r["phrases"] for r in K.keyphrases(df, "id", "text", most=4, long=long).collect()}
        assert got == {k: best(c, 6) for k, c in want.items() if c}
    once = K.keyphrases(df.filter("id <> 3"), "id", "text")
    assert "Exchange hashpartitioning(id" not in once._jdf.queryExecution().executedPlan().toString()
    for part in (7, 1 << 18):
        rows = K.gram_rows(df, "id", text="text", part=part).groupBy("id", "gram").sum("n").filter("id is not null").collect()
        assert {(r["id"], r["gram"]): r["sum(n)"] for r in rows} == {(k, g): n for k, c in want.items() for g, n in c.items()}
