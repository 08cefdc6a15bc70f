"""HTML extraction: a page becomes a flat list of text blocks; each is described by its
word count and link density, those of its neighbours, the words that ask the reader to do
something, and where it stands; a decision tree trained on a small labelled table of
blocks says whether it is content.

Names of elements (class, id, role) speak for their own blocks only, not for an article
or a main part inside them: inside one, names count from there on; from the page's title on
the elements that hold it are frames of the page, whatever their names. A name speaks
against content by its last word that tells something (post-comments, but not
legal-analysis); what it names must be less than nearly all of the part around it. An article
within an article is another's. Calls to the reader (subscribe to our...) count outside the main part, and
inside it as far as a block is made of links.

An inline element whose name speaks against content (a share link, a reply button)
speaks against its own words only: as part of a longer text they stay in its block,
otherwise they are a block after it.

The blocks of a page are read in one pass over its markup. Rows are independent:
no shuffle, and memory is that of SOME pages.

Null and empty html, and pages without content, give the empty text. Broken
markup (missing end tags, cut-off tags or references) is read as browsers do in
spirit: an unknown tag ends nothing, an open element ends with the page.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import table
from weftline.llm.html_labels import LABELLED_PAGES
from weftline.shipping import arrow_udf

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
#: Elements whose whole content is no text of the page.
_UNSEEN = {"script", "style", "noscript", "template", "title", "textarea", "select", "svg", "annotation", "annotation-xml", "iframe", "object", "canvas", "audio", "video", "button"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"} | {"math", "semantics", "mstyle", "mrow", "mi", "mn", "mo", "ms", "mtext", "mspace", "msub", "msup", "msubsup", "mfrac", "msqrt", "mroot", "munder", "mover", "munderover", "mpadded", "mphantom"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_FRAME = {"nav": "menu", "header": "frame", "footer": "frame", "aside": "frame", "form": "form", "dialog": "frame", "menu": "menu", "fieldset": "form"}
_MAIN = {"article": 2, "main": 1}
#: Words in class, id, role or aria-label that speak against content: as the last word of a name that tells something, or anywhere in it.
_AGAINST_LAST = re.compile(
    r"(?:ad|ads|adv|advert\w*|banner\w*|cookies?|consent|gdpr|notices?|popup|modal|newsletters?|subscri\w*|comments?|commentlist|respon[sd]\w*|disqus|reply|replies|discussion|sidebars?|widgets?|shares?|sharing"
    r"|nav|navbar|navigation|menus?|breadcrumbs?|pagination|pager|footers?|masthead|login|signup|search\w*|toolbar|copyright|legal|alert|header|skip\w*|complementary|contentinfo)"
)
_AGAINST_ANY = re.compile(r"(?:sponsor\w*|promo\w*|related|recommend\w*|social\w*|outbrain|taboola|advert\w*)")
#: Words of a name that tell nothing of what it holds, and those before which a name speaks of something else.
_VAGUE = re.compile(r"(?:list\w*|box\w*|container\w*|wrap\w*|area|section\w*|blocks?|slots?|bar|buttons?|links?|left|right|top|bottom|inner|outer|items?|body|form|panel|row|col\w*|content|text|title|icons?|main|primary|secondary|\d+)?")
_WITHOUT = re.compile(r"(?:has|with|no|non|without|hide|is)")
_COMMENTS = re.compile(r"(?i)(?<![a-z])(?:comment|respon[sd]|disqus|repl(?:y|ies)|discussion)")
#: Names of an article element that is none of the page's own: a comment, or a pointer to another page.
_OTHER = re.compile(r"(?i)(?<![a-z])(comment\w*|repl(?:y|ies)|related|teaser\w*|promo\w*|sponsor\w*|advert\w*|ad|ads)(?![a-z])")
#: What sites ask of a reader, in so many words, and words of the site's own affairs.
_CALLS = re.compile(
    r"\b(?:subscribe (?:to our|to the|now|today|for)|(?:our|free|weekly|daily) newsletter|newsletter by|sign up (?:to|for)|sign in|log ?in|register (?:now|here|to (?:read|comment|continue))|(?:use|uses|using|accept|store) (?:all |of )?cookies|cookie (?:policy|settings|notice)"
    r"|sponsored (?:by|content|post)|click here|follow us|share (?:this|on) (?:story|article|page|post|every|all|facebook|twitter)|our (?:many )?partners|abonnez|abonnieren|anmelden|suscríbe\w*|publicidad|publicité|anzeige)\b|^advertisement\b"
)
_LEGAL = re.compile(r"\b(?:privacy|copyright|all rights reserved|terms (?:of use|and conditions)|powered by|imprint|datenschutz\w*|impressum|confidentialité|privacidad)\b")
_FOR = re.compile(r"(?i)(?<![a-z])(article\w*|post\w*|entry\w*|story\w*|content(?!info)\w*|main|body|text|prose|hentry)(?![a-z])")
_SPACE = re.compile(r"\s+")
_NAMES = re.compile(r"""(?i)(?:^|\s)(class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")

FEATURES = ("words", "link_density", "prev_words", "prev_link_density", "next_words", "next_link_density", "calls", "legal", "in_main", "in_frame", "named_for", "named_against", "heading", "list_item", "page_has_main", "text_after")
#: Pages that are classified at a time.
SOME = 64
#: Words that are told apart in text_after.
AFTER = 30
#: An element of several blocks whose name speaks against it is none of the page's frames where it holds this share of the words of the part around it.
WHOLE = 0.9
#: Elements of single lines and paragraphs: what is named against it must be named by that word alone.
_LINES = {"p", "li", "dt", "dd", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figcaption"}


@lru_cache(1 << 14)
def _against(name: str, alone: bool) -> bool:
    """Whether a name, say of a class, speaks against what it names; alone: only if it is that one word."""
    words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
    if alone or not words:
        return len(words) == 1 and bool(_AGAINST_LAST.fullmatch(words[0]) or _AGAINST_ANY.fullmatch(words[0]))
    if _WITHOUT.fullmatch(words[0]):
        return False
    while len(words) > 1 and _VAGUE.fullmatch(words[-1]):
        words.pop()
    if words[-1] == "header" and any(_FOR.fullmatch(w) for w in words[:-1]):
        return False
    return bool(_AGAINST_LAST.fullmatch(words[-1])) or any(_AGAINST_ANY.fullmatch(w) for w in words)


def _element(name: str, attrs: str) -> tuple[int, int, int, int, bool]:
    """main, frame, for, against of one element, and whether its name speaks of readers' comments."""
    told = [(k.lower(), v.strip("\"'")) for k, v in _NAMES.findall(attrs)] if "=" in attrs else []
    names = " ".join(v for _, v in told)
    spaced = re.sub(r"([a-z])([A-Z])", r"\1 \2", names).replace("_", " ")
    named_for = int(bool(names and _FOR.search(spaced)))
    if name in _MAIN:
        other = bool(names and _OTHER.search(spaced))
        return 0 if other else _MAIN[name], 0, named_for, int(other), other
    against = name not in ("body", "html") and any(_against(x, name in _LINES) for k, v in told for x in ([v] if k == "aria-label" else v.split()))
    return 0, int(name in _FRAME), named_for, int(against), bool(against and _COMMENTS.search(spaced))


def blocks(page: str) -> list[tuple[str, int, int, str, tuple[int, int, int, int]]]:
    """(text, words, words in links, element, (main, frame, for, against) of what encloses it), in page order."""
    out: list = []
    stack: list[tuple[str, tuple[int, int, int, int, bool], int]] = []  # name, what it says, its number
    parts: list[tuple[str, bool, tuple[int, int, tuple]]] = []  # text, in a link, (against, for, elements against) of what encloses it
    scope: dict[int, int] = {}  # of each element that is named against: the part around it
    comments: set[int] = set()
    inside: dict[int, int] = {}  # words outside links in each element
    held: dict[int, int] = {}  # blocks in each element
    at = numbers = 0
    in_link = False

    def inner() -> list:
        """What encloses the text, from the innermost article or main part on."""
        k = max((i for i, (_, m, _) in enumerate(stack) if m[0]), default=0)
        return stack[k:]

    def block(texts: list[str], links: list[str], named_for: int, against: tuple) -> None:
        text = _SPACE.sub(" ", "".join(texts)).strip()
        if text:
            main = max((m[0] for _, m, _ in stack), default=0)
            # what stands inside an article's own header is no page frame
            frame = sum(m[1] for n, m, _ in inner() if not (n == "header" and main == 2))
            words, linked = text.count(" ") + 1, len(" ".join(links).split())
            for number in {0, *(k for _, _, k in stack), *against}:
                inside[number] = inside.get(number, 0) + max(0, words - linked)
                held[number] = held.get(number, 0) + 1
            out.append((text, words, linked, next((n for n, _, _ in reversed(stack) if n not in _INLINE), "body"), (main, frame, named_for, against)))

    def flush() -> None:
        if marks := {m for text, _, m in parts if text.strip()}:
            own = min(marks)
            texts, links = [t for t, _, _ in parts], [t for t, x, _ in parts if x]
            marked = [(t, x) for t, x, m in parts if m[0] > own[0]]
            words = sum(len(t.split()) for t, _ in marked)
            if 2 * words < sum(len(t.split()) for t in texts):
                block(texts, links, *own[1:])  # marked words within a longer text are words of it
            else:
                block([t if m[0] <= own[0] else " " for t, _, m in parts], [t for t, x, m in parts if x and m[0] <= own[0]], *own[1:])
                block([t for t, _ in marked], [t for t, x in marked if x], *max(marks)[1:])
        parts.clear()

    def add(raw: str) -> None:
        text = _html.unescape(raw) if "&" in raw else raw
        around = inner()
        against = tuple(k for _, m, k in around if m[3])
        parts.append((text, in_link, (len(against), int(any(m[2] for _, m, _ in around)), against)))

    def push(name: str, e: tuple[int, int, int, int, bool]) -> None:
        nonlocal numbers
        numbers += 1
        if name == "article" and any(m[0] == 2 for _, m, _ in stack):
            e = (0, 0, e[2], 1, e[4])  # an article within the article is another's: a comment, or a pointer to a page
        if e[3]:
            scope[numbers] = next((k for _, m, k in reversed(stack) if m[0] or m[2]), 0)
            if e[4]:
                comments.add(numbers)
        stack.append((name, e, numbers))

    n = len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attrs = m[1] or m[4], m[3] or m[6] or ""
        if name in _UNSEEN:
            if not closing and not attrs.endswith("/"):
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = end.end() if end else n
            if name not in _INLINE:
                parts.append((" ", False, (0, 0)))
            continue
        if name == "br":
            parts.append((" ", False, (0, 0)))
            continue
        if name in _INLINE:
            if name == "a":
                in_link = not closing
            if closing:
                k = len(stack) - 1
                while k >= 0 and stack[k][0] in _INLINE and stack[k][0] != name:
                    k -= 1
                if k >= 0 and stack[k][0] == name:
                    del stack[k:]
            elif name not in _VOID:
                e = _element(name, attrs) if "=" in attrs else (0, 0, 0, 0, False)
                if e[3] or stack and stack[-1][0] == name:  # one more of the name, for the end tags to match
                    push(name, e)
            continue
        flush()
        in_link = in_link and not closing
        if closing:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if k is not None:
                del stack[k:]
        elif name not in _VOID and not attrs.endswith("/"):
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option", "h1", "h2", "h3", "h4", "h5", "h6"):
                while stack and stack[-1][0] in ("p", *_INLINE):  # a paragraph ends where the next block begins
                    stack.pop()
                if stack and stack[-1][0] == name == "li":
                    stack.pop()
            push(name, _element(name, attrs))
            if stack[-1][1][0] or name == "h1" and not any(n == "article" and m[3] for n, m, _ in stack):
                # what holds the title or the main part is a frame of the page, whatever its name, and a form round it none
                stack[:-1] = [(n, (e[0], 0 if n == "form" else e[1], 0, 0, False), k) for n, e, k in stack[:-1]]
    flush()
    # a name against what is nearly all of the part around it says nothing, unless it names comments
    void = {k for k, around in scope.items() if k not in comments and held.get(k, 0) > 1 and inside.get(k, 0) >= WHOLE * max(1, inside.get(around, 0))}
    return [(*b, (m[0], m[1], m[2], sum(k not in void for k in m[3]))) for *b, m in out]


def features(found: list) -> np.ndarray:
    n = len(found)
    x = np.zeros((n, len(FEATURES)))
    if not n:
        return x
    words = np.array([b[1] for b in found], float)
    density = np.array([b[2] for b in found], float) / words
    x[:, 0], x[:, 1] = words, density
    x[1:, 2], x[1:, 3] = words[:-1], density[:-1]
    x[:-1, 4], x[:-1, 5] = words[1:], density[1:]
    state = np.array([b[4] for b in found])
    # inside a main part a call alone says nothing: it counts as far as the block is made of links
    weight = np.where(state[:, 0] > 0, density, 1)
    x[:, 6] = [min(3, len(_CALLS.findall(b[0].lower()))) * 10 / (b[1] + 10) * w if w else 0 for b, w in zip(found, weight)]
    x[:, 7] = [min(3, len(_LEGAL.findall(b[0].lower()))) * 10 / (b[1] + 10) for b in found]
    x[:, 8:12] = state
    x[:, 12] = [b[3] in ("h1", "h2", "h3", "h4", "h5", "h6") for b in found]
    x[:, 13] = [b[3] in ("li", "dt", "dd", "td", "th") for b in found]
    x[:, 14] = state[:, 0].max()
    # words outside links, frames and what is named against that follow, in the main part if the heading is in it: one before what is named against, and with none after that, heads something else
    text = words * (1 - density) * ((state[:, 1] == 0) & (state[:, 3] == 0))
    main = state[:, 0] > 0
    for here, of in ((~main, text), (main, text * main)):
        x[here, 15] = np.minimum(AFTER, of.sum() - np.cumsum(of))[here]
    x[(x[:, 12] == 0) | (np.append(state[1:, 3], 0) == 0), 15] = AFTER
    return x


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = 14, least: int = 1) -> tuple:
    """A classification tree by Gini impurity: (feature, threshold, below, above), or the share of content at a leaf.

    Ties go to the earlier feature and the lower threshold.
    """
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return (share,)
    best = (2 * share * (1 - share) * len(y) - 1e-9, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            a, b = y[low], y[~low]
            if min(len(a), len(b)) < least:
                continue
            g = sum(2 * s.mean() * (1 - s.mean()) * len(s) for s in (a, b))
            if g < best[0] - 1e-12:
                best = (g, f, float(t))
    if best[1] is None:
        return (share,)
    low = x[:, best[1]] <= best[2]
    return (best[1], best[2], fit_tree(x[low], y[low], depth - 1, least), fit_tree(x[~low], y[~low], depth - 1, least))


def classify(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0] >= 0.5)
    low = x[:, tree[0]] <= tree[1]
    out = np.zeros(len(x), bool)
    out[low], out[~low] = classify(tree[2], x[low]), classify(tree[3], x[~low])
    return out


def labelled(page: str, marks: list[str]) -> tuple[list, np.ndarray]:
    """The page's blocks without the marks, and whether each is content."""
    found = blocks(page)
    content = np.array([any(m in b[0] for m in marks) for b in found], float)
    plain = []
    for text, words, links, *rest in found:
        bare = " ".join(w for w in text.split() if w not in marks)
        plain.append((bare, max(1, bare.count(" ") + 1), min(links, bare.count(" ") + 1), *rest))
    return plain, content


@lru_cache(1)
def trained() -> tuple:
    """The tree for the labelled pages: every block of theirs is a row of the table."""
    table = [labelled(page, marks) for page, marks in LABELLED_PAGES]
    return fit_tree(np.vstack([features(f) for f, _ in table]), np.concatenate([y for _, y in table]))


def main_texts(pages: list[str | None], tree: tuple) -> list[str]:
    found = [blocks(x or "") for x in pages]
    keep = iter(classify(tree, np.vstack([np.zeros((0, len(FEATURES))), *map(features, found)])))
    return [" ".join(b[0] for b in each if next(keep)) for each in found]


def main_text(page: str | None, tree: tuple) -> str:
    return main_texts([page], tree)[0]


def extracted(html: Column | str) -> Column:
    """The main text of each page, a string and never null."""
    tree = trained()

    @arrow_udf("string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array([text for k in range(0, len(a), SOME) for text in main_texts(a.slice(k, SOME).to_pylist(), tree)], pa.string())

    return extract(html)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", extracted("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
