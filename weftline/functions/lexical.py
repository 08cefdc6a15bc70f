"""Column functions that turn texts into features: n-grams, lexicon tags, scores, citations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lengths of n-grams, characters and words that an n-gram may not begin with, end with or be,
# noun endings and the factors of a score.
SHORTEST, LONGEST = 2, 4
RUN_BREAK = r"[。！？；…，、,.!?;:：\s「」『』“”‘’（）()《》〈〉【】\[\]—–\-]+"
NOT_FIRST = "的了着过是在和与而也就都还又很把被从对为以之其所以因故乃且夫盖若则虽但或及于乎焉矣兮者们个每该一二两这那几并"
NOT_LAST = "的了着过是而也就都还又很把被之其所以因故乃且夫盖若则虽但或及于乎焉矣兮个每该"
STOP_WORDS = (
    "这个", "那个", "我们", "你们", "他们", "它们", "什么", "怎么", "因为", "所以", "但是", "如果", "已经", "可以", "这样", "那样",
    "一个", "一种", "一些", "就是", "不是", "没有", "这些", "那些", "自己", "以及", "并且", "或者", "而且", "然后", "于是", "对于",
    "关于", "由于", "通过", "根据", "时候", "地方", "东西", "问题", "情况", "方面", "一定的", "某种",
)
NOUN_ENDINGS = (
    "主义", "论", "学", "性", "化", "观", "关系", "存在", "自由", "时间", "意义", "结构", "现象", "经验", "意识", "概念",
    "价值", "主体", "客体", "理性", "意志", "情感", "认知", "精神", "世界", "真理", "本质", "语言", "权力", "制度", "实践", "状态",
    "过程", "能力", "理论", "模型", "机制",
)
LENGTH_POWER, NOUN_FACTOR = 1.2, 1.8
MARKER = r"\[\s*\[\s*ev\s*:\s*([^\s\[\]]+?)\s*\]\s*\]"
ATTEMPT = r"(?i)\[\s*\[\s*ev\s*:\s*([^\]]*?)\s*\]\s*\]"


def gram_score(gram: Column, count: Column) -> Column:
    noun = F.when(gram.rlike("(?:" + "|".join(NOUN_ENDINGS) + ")$"), NOUN_FACTOR).otherwise(1.0)
    return F.log1p(count) * F.pow(F.length(gram), F.lit(LENGTH_POWER)) * noun


def uncontained(ranked: Column, k: int) -> Column:
    """The first k of an ordered list of strings that neither hold nor are held by one before them."""
    clash = lambda kept, g: F.exists(kept, lambda x: F.contains(x, g) | F.contains(g, x))
    return F.aggregate(ranked, F.array().cast("array<string>"), lambda kept, g: F.when((F.size(kept) >= k) | clash(kept, g), kept).otherwise(F.concat(kept, F.array(g))))


def lexicon_tags(text: Column, lexicon: Mapping[str, Sequence[str]], limit: int) -> Column:
    """Tags with a form in the text, by the first place of any form, then by name."""
    found = []
    for tag, forms in lexicon.items():
        first = F.array_min(F.filter(F.array(*(F.instr(text, f) for f in forms)), lambda p: p > 0))
        found.append(F.struct(first.alias("p"), F.lit(tag).alias("t")))
    hits = F.array_sort(F.filter(F.array(*found), lambda x: x["p"].isNotNull()))
    return F.transform(F.slice(hits, 1, limit), lambda x: x["t"])


def lexicon_scores(text: Column, lexicon: Mapping[str, Sequence[str]]) -> Column:
    """Labels with a word in the text, as (label, score): 1 + 0.35 letters for each word that is there; best first."""
    rows = []
    for label, words in lexicon.items():
        s = sum((F.when(F.contains(text, F.lit(w)), 1 + 0.35 * len(w)).otherwise(0.0) for w in words), F.lit(0.0))
        rows.append(F.struct((-s).alias("n"), F.lit(label).alias("label")))
    hits = F.array_sort(F.filter(F.array(*rows), lambda x: x["n"] < 0))
    return F.transform(hits, lambda x: F.struct(x["label"].alias("label"), F.round(-x["n"], 6).alias("score")))


def markers(text: Column) -> Column:
    """Ids of the well-formed citation markers, in order, repeats included."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MARKER), F.lit(1))


def attempts(text: Column) -> Column:
    """Ids of everything that looks like a closed marker, malformed ones too."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ATTEMPT), F.lit(1))


def coverage(valid: Column, total: Column) -> Column:
    return F.when(total > 0, F.bround(valid / total, 4)).otherwise(0.0)


def cjk_share(text: Column, first: int = 4000) -> Column:
    """The share of Chinese characters and marks in the text's beginning."""
    some = F.substring(text, 1, first)
    return F.when(F.length(some) > 0, F.length(F.regexp_replace(some, r"[^\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]", "")) / F.length(some)).otherwise(0.0)


def lossless(text: Column) -> Column:
    """Line ends made one, zero-width characters dropped, blanks collapsed, lines stripped, one empty line at most."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    for pattern, by in ((r"[\x{200B}-\x{200F}\x{2028}\x{2029}\x{FEFF}]", ""), (r"[ \t\x{3000}]+", " "), (r"(?m)^ | $", ""), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")):
        t = F.regexp_replace(t, pattern, by)
    return t
