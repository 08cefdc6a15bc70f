"""Column functions for cleaning short texts. All are built-in expressions but NFKC, for which Spark has none."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from weftline.shipping import arrow_udf, slices

# Patterns and limits that define what is an advertisement, spam or visible content.
ZERO_WIDTH = r"[\x{200B}-\x{200F}\x{2060}\x{FEFF}\x{AD}]"
_EMOJI = r"\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{2B00}-\x{2BFF}\x{FE0F}\x{200D}"
EMOJI = f"[{_EMOJI}]+"
URL = r"(?:https?://|www\.)[^\s，。、）)】\]]+"
MENTION = r"@[\p{L}\p{N}_\x{4E00}-\x{9FFF}\-.]+"
STRONG = r"加\s*(?:我|一下)?\s*(?:微信|vx|v信|威信|薇信|wx|v\b|q\b|qq)|[加+＋]\s*v(?![a-z])|(?:微信|vx|wx|qq)\s*[:：]?\s*[a-z0-9_-]{5,}|私\s*(?:我|聊|信)|(?:看|点)\s*(?:我)?\s*主页|(?:点|戳)\s*(?:击)?\s*(?:下方)?\s*(?:链接|小黄车|购物车|橱窗)|(?:领|抢)\s*(?:取|购)?\s*(?:优惠券|福利|红包|免费)|(?:加|进)\s*(?:群|粉丝群)|(?:刷单|代购|招代理|招兼职|日结|包邮|现货|批发|一手货源)|主页\s*(?:简介|签名)?\s*(?:自取|有链接|看简介|领取)|月\s*入\s*\d+\s*[w万k]|(?:0|零)\s*基础\s*(?:转行|学|做|也能|月入)|名额\s*(?:只剩|有限|不多)|1[3-9]\d{9}|q\s*q?\s*[:：]?\s*\d{6,}"
WEAK = ("优惠券", "限时", "秒杀", "福利价", "橱窗", "小黄车", "一手货源", "招代理", "返还现金", "免费送", "点击购买", "链接在下方")
WEAK_LEAST, LONG_DIGITS, RUN = 2, 8, 10
CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"


def _composed(text: pa.Array) -> pa.Array:
    """The texts in NFKC; what is so already stays the same array."""
    old = text.to_pylist()
    if all(x is None or x.isascii() or unicodedata.is_normalized("NFKC", x) for x in old):
        return text
    return pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in old], text.type)


@arrow_udf(StringType())
def nfkc(text: pa.Array) -> pa.Array:
    parts = [_composed(text.slice(at, n)) for at, n in slices((text,))]
    return pa.concat_arrays(parts) if len(parts) > 1 else parts[0] if parts else text


def normalise(text: Column, compose: bool = False) -> Column:
    """Without zero-width characters, white space collapsed, stripped; compose adds NFKC. Null becomes empty."""
    t = F.coalesce(text, F.lit(""))
    t = nfkc(t) if compose else t
    return F.trim(F.regexp_replace(F.regexp_replace(t, ZERO_WIDTH, ""), r"(?U)\s+", " "))


def visible(body: Column) -> Column:
    """Has a letter or digit that is no emoji."""
    return body.rlike(rf"[\p{{L}}\p{{N}}&&[^{_EMOJI}]]")


def fingerprint(body: Column) -> Column:
    """Digest of what is left without links, mentions, emoji, punctuation and white space."""
    bare = body
    # emoji, and all that is no letter or digit, go in one pass
    for pattern in ("(?i)" + URL, MENTION, rf"[^\p{{L}}\p{{N}}&&[^{_EMOJI}]]+"):
        bare = F.regexp_replace(bare, pattern, "")
    return F.md5(bare)


def is_ad(body: Column) -> Column:
    digits = body.rlike(rf"\p{{Nd}}{{{LONG_DIGITS},}}") & body.rlike(r"\p{L}")  # digits and punctuation alone are spam
    # all weak words are Chinese
    weak = body.rlike(f"[{CJK}]") & (F.size(F.array_distinct(F.regexp_extract_all(body, F.lit("(" + "|".join(WEAK) + ")"), F.lit(1)))) >= WEAK_LEAST)
    # every strong pattern holds one of these; most texts have none, and the rest is not tried on them
    may = body.rlike(rf"(?=[{CJK}\p{{Nd}}+＋vVwWqQ])(?:[{CJK}]|\p{{Nd}}{{6}}|[+＋]\p{{IsWhite_Space}}*[vV]|[vVwW][xX]|[qQ][qQ])")
    return (body != "") & (body.rlike("(?i)" + URL) | (may & body.rlike("(?iU)" + STRONG)) | digits | weak)


def _runs(texts: pa.Array) -> list[bool]:
    """Whether each text has RUN equal characters in a row that are not Chinese."""
    each = texts.to_pylist()
    size = np.array([0 if x is None else len(x) for x in each], np.int64)
    chars = np.frombuffer("".join(x or "" for x in each).encode("utf-32-le"), np.uint32)
    # places where a character differs from the one before, or a text begins: between two of them all are equal
    new = np.ones(len(chars), bool)
    new[1:] = chars[1:] != chars[:-1]
    begin = np.cumsum(size) - size
    new[begin[size > 0]] = True
    at = np.flatnonzero(new)
    long = at[np.diff(at, append=len(chars)) >= RUN]
    found = np.zeros(len(each), bool)
    c = chars[long]
    long = long[~(((c >= 0x3400) & (c <= 0x4DBF)) | ((c >= 0x4E00) & (c <= 0x9FFF)) | ((c >= 0xF900) & (c <= 0xFAFF)))]
    found[np.searchsorted(begin + size, long, "right")] = True
    return found.tolist()


@arrow_udf(BooleanType())
def has_run(text: pa.Array) -> pa.Array:
    return pa.array([x for at, n in slices((text,)) for x in _runs(text.slice(at, n))], pa.bool_())


def is_spam(body: Column) -> Column:
    return (body == "") | ~visible(body) | has_run(body)


def one_line(text: Column, limit: int, tail: str = "…") -> Column:
    """White space collapsed, cut at `limit` characters with a tail."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit(tail))).otherwise(flat)


def title(text: Column, limit: int = 18) -> Column:
    """The first line, cut."""
    first = F.trim(F.split(F.trim(text), "\n").getItem(0))
    return F.when(F.length(first) > limit, F.concat(F.substring(first, 1, limit), F.lit("…"))).otherwise(first)


def clean_text(text: Column, limit: int) -> Column:
    return F.rtrim(F.substring(F.trim(text), 1, limit))


def clean_tags(tags: Column, allowed: Column | None = None, limit: int = 3, longest: int = 20) -> Column:
    """Trimmed, at most `longest` characters, without control or markup characters, in the closed set, distinct in order, capped."""
    kept = F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t.isNotNull() & (t != "") & (F.length(t) <= longest) & ~t.rlike(r"[\x00-\x1F<>\[\]{}|`]"))
    kept = F.filter(kept, lambda t: F.array_contains(allowed, t)) if allowed is not None else kept
    return F.slice(F.array_distinct(kept), 1, limit)


def filter_ids(ids: Column, pool: Column, limit: int) -> tuple[Column, Column]:
    """(kept, dropped): ids in the pool, distinct in order, then limited; and those that are not."""
    return F.slice(F.array_intersect(ids, pool), 1, limit), F.filter(ids, lambda x: ~F.array_contains(pool, x))


def string_or_null(v: Column) -> Column:
    return F.nullif(F.trim(v), F.lit(""))


def to_long(v: Column) -> Column:
    """A whole number, or null for anything else, booleans too."""
    return F.when(~F.lower(F.trim(v)).isin("true", "false"), v.try_cast("bigint"))


def to_time(v: Column) -> Column:
    """Digits are an epoch, in milliseconds from 1e11 on; anything else is tried as an ISO time."""
    n = v.try_cast("bigint")
    return F.when(n > 100_000_000_000, F.timestamp_millis(n)).when(n.isNotNull(), F.timestamp_seconds(n)).otherwise(v.try_cast("timestamp"))


def safe_filename(raw: Column, default: str = "upload.txt") -> Column:
    base = F.substring_index(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\\", "/"), "/", -1)
    bare = F.substring(F.trim(F.regexp_replace(base, r'[\x00-\x1F<>:"|?*]', "")), 1, 200)
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit(default))


def joined(*parts: Column) -> Column:
    """Query text from strings and lists of strings: white space collapsed, words under two characters dropped, distinct in order."""
    lists = F.flatten(F.array(*parts))
    words = F.filter(F.transform(lists, lambda w: F.trim(F.regexp_replace(w, r"(?U)\s+", " "))), lambda w: w.isNotNull() & (F.length(w) >= 2))
    return F.array_join(F.array_distinct(words), " ")
