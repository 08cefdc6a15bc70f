"""The n-grams of texts by arrays: counts of each text's n-grams and its keyphrases, some texts at a time.

Characters become numbers in the order of their code points, an n-gram one number with the place of its text above it.
So sorted numbers bring equal n-grams of a text together, in the order of texts and of n-grams. The rules are those of
lexical: runs end at punctuation, and what may be a keyphrase.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

from weftline.functions.lexical import LENGTH_POWER, LONGEST, NOT_FIRST, NOT_LAST, NOUN_ENDINGS, NOUN_FACTOR, RUN_BREAK, SHORTEST, STOP_WORDS
from weftline.shipping import slices

#: Characters of texts that are looked at together.
PART = 1 << 18
_BREAKS = re.compile(RUN_BREAK, re.ASCII)
#: What a regular expression's $ may stand before, although the text ends after it.
_LINE_ENDS = "\x85\u2028\u2029"


def _marked(ids: np.ndarray, marks: Sequence[str]) -> np.ndarray:
    """Which characters, by number, are of the marks."""
    return np.isin(ids, np.array([ord(c) for c in marks], np.uint32))


class Grams:
    """The n-grams of some texts, each once for a text: text, length, chars (numbers of its characters), noun and n (occurrences), by length, text and name."""

    def __init__(self, texts: Sequence[str], tails: Sequence[int] | None = None):
        """tails: characters at each text's end that begin no n-gram, where the text goes on in another piece."""
        codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        seen = np.zeros(0x110000, bool)
        seen[codes] = True
        self.letters = np.flatnonzero(seen).astype(np.uint32)
        number = np.zeros(0x110000, np.int32)
        number[self.letters] = np.arange(len(self.letters), dtype=np.int32)
        c = number[codes].astype(np.int64)
        bits = max(1, int(len(self.letters) - 1).bit_length())
        letters = self.letters
        breaks = np.array([_BREAKS.match(chr(x)) is not None for x in letters.tolist()], bool)[c]
        first, last = ~_marked(letters, NOT_FIRST)[c], ~_marked(letters, NOT_LAST)[c]
        place = {chr(x): k for k, x in enumerate(letters.tolist())}
        ends = np.zeros(len(c), bool), np.zeros(len(c), bool)  # a noun's ending of one and of two characters ends here
        for e in NOUN_ENDINGS:
            if all(x in place for x in e):
                here = c == place[e[-1]]
                if len(e) == 2:
                    here[1:] &= c[:-1] == place[e[0]]
                    here[0] = False
                ends[len(e) - 1][here] = True
        closing = _marked(letters, _LINE_ENDS)[c] if any(x in place for x in _LINE_ENDS) else None
        if tails is not None:
            for end, tail in zip(np.cumsum(sizes).tolist(), tails):
                if tail:
                    first[end - 1 - tail : end] = False
        of = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
        text_bits = max(1, int(len(texts)).bit_length())
        pairs = None
        if text_bits + LONGEST * bits + 1 > 63:  # too many letters to stand side by side: pairs are numbered
            pairs, pair = np.unique((c[:-1] << bits) | c[1:], return_inverse=True)
            pair_bits = max(1, int(len(pairs) - 1).bit_length())
        out: dict[str, list[np.ndarray]] = {"text": [], "length": [], "noun": [], "n": []}
        self.chars: list[np.ndarray] = []
        whole = ~breaks
        for n in range(2, LONGEST + 1):
            whole = whole[: len(c) - n + 1] & ~breaks[n - 1 :]
            if n < SHORTEST:
                continue
            at = np.flatnonzero(whole & first[: len(whole)] & last[n - 1 :])
            if pairs is None:
                key = c[at]
                for k in range(1, n):
                    key = (key << bits) | c[at + k]
                shift = n * bits
            else:
                key, shift = pair[at], pair_bits
                if n > 2:
                    key, shift = (key << (bits if n == 3 else pair_bits)) | (c[at + 2] if n == 3 else pair[at + 2]), shift + (bits if n == 3 else pair_bits)
            noun = (ends[0] | ends[1])[at + n - 1]
            if closing is not None:
                noun |= closing[at + n - 1] & (ends[0][at + n - 2] | (ends[1][at + n - 2] if n > 2 else False))
            key = (((of[at] << shift) | key) << 1) | noun
            key.sort()
            new = np.flatnonzero(np.diff(key, prepend=-1))
            count = np.diff(new, append=len(key))
            key = key[new]
            noun, key = (key & 1).astype(bool), key >> 1
            text, key = key >> shift, key & ((1 << shift) - 1)
            if pairs is None:
                chars = [(key >> (bits * (n - 1 - k))) & ((1 << bits) - 1) for k in range(n)]
            else:
                two = lambda p: [pairs[p] >> bits, pairs[p] & ((1 << bits) - 1)]
                chars = two(key) if n == 2 else [*two(key >> bits), key & ((1 << bits) - 1)] if n == 3 else [*two(key >> pair_bits), *two(key & ((1 << pair_bits) - 1))]
            keep = np.ones(len(key), bool)
            for w in STOP_WORDS:
                if len(w) == n and all(x in place for x in w):
                    keep &= ~np.logical_and.reduce([x == place[y] for x, y in zip(chars, w)])
            self.chars.append(np.stack([x[keep] for x in chars] + [np.zeros(int(keep.sum()), np.int64)] * (LONGEST - n), 1).astype(np.int32))
            for name, x in zip(out, (text, np.full(len(key), n), noun, count)):
                out[name].append(x[keep])
        self.text, self.length, self.noun, self.n = (np.concatenate(x) for x in out.values())
        self.chars = np.concatenate(self.chars)

    def names(self) -> pa.Array:
        """The n-grams as strings."""
        codes = self.letters[self.chars]
        width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        there = np.arange(LONGEST) < self.length[:, None]
        data = codes[there].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        ends = np.concatenate(([0], np.cumsum(np.where(there, width, 0).sum(1)))).astype(np.int32)
        return pa.StringArray.from_buffers(len(self.n), pa.py_buffer(ends), pa.py_buffer(data))

    def phrases(self, texts: int, k: int) -> list[list[str]]:
        """Of each text the first k by score, length and name that neither hold nor are held by one before them; none where there are no n-grams."""
        # a score depends on the occurrences, the length and the ending only
        kind = self.n * 16 + self.length * 2 + self.noun
        seen = np.zeros(int(kind.max(initial=0)) + 1, bool)
        seen[kind] = True
        each = [(-round(math.log1p(x >> 4) * ((x & 15) >> 1) ** LENGTH_POWER * (NOUN_FACTOR if x & 1 else 1.0), 9), -((x & 15) >> 1), x) for x in np.flatnonzero(seen).tolist()]
        rank, r, before = np.zeros(len(seen), np.int64), -1, None
        for score, size, x in sorted(each):
            r, before = r + ((score, size) != before), (score, size)
            rank[x] = r
        # equal scores and lengths stand in the order of their names already
        bits, high = max(1, len(kind).bit_length()), max(1, (r + 1).bit_length())
        key = (((self.text << high) | rank[kind]) << bits) | np.arange(len(kind))
        key.sort()
        at = key & ((1 << bits) - 1)
        ends = np.searchsorted(key, (np.arange(texts + 1) << (high + bits)))
        out = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            kept: list[str] = []
            while a < b and len(kept) < k:
                some = at[a : min(b, a + 4 * k)]
                for codes, size in zip(self.letters[self.chars[some]].tolist(), self.length[some].tolist()):
                    g = "".join(map(chr, codes[:size]))
                    if not any(g in x or x in g for x in kept):
                        kept.append(g)
                        if len(kept) == k:
                            break
                a += len(some)
            out.append(kept)
        return out


def parts(texts: Sequence[str | None], most: int = PART) -> Iterator[tuple[int, int]]:
    """(first, end) of neighbouring texts of about `most` characters; a longer text is alone."""
    start = size = 0
    for k, t in enumerate(texts):
        n = len(t or "") + 1
        if k > start and size + n > most:
            yield start, k
            start, size = k, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def pieces(text: str, most: int = PART) -> list[tuple[str, int]]:
    """A text in pieces of `most` characters with the first characters of the next, and how many these are."""
    return [(x, max(0, len(x) - most)) for x in (text[k : k + most + LONGEST - 1] for k in range(0, len(text), most))]


def counted(batches: Iterator[pa.RecordBatch], most: int = PART) -> Iterator[pa.RecordBatch]:
    """The keys, gram and n of each text's n-grams; text is the last column. A text longer than `most` tells some n-grams more than once, with a part of their occurrences."""
    for batch in batches:
        for at, size in slices((batch.column(batch.num_columns - 1),)):
            rows = batch.slice(at, size)
            texts = [(k, *p) for k, t in enumerate(rows.column(rows.num_columns - 1).to_pylist()) for p in pieces(t or "", most)]
            for a, b in parts([t for _, t, _ in texts], most):
                g = Grams([t for _, t, _ in texts[a:b]], [tail for *_, tail in texts[a:b]])
                row = np.array([k for k, *_ in texts[a:b]], np.int64)[g.text]
                keys = [c.take(pa.array(row)) for c in rows.columns[:-1]]
                out = pa.RecordBatch.from_arrays([*keys, g.names(), pa.array(g.n, pa.int64())], names=[*rows.schema.names[:-1], "gram", "n"])
                yield from (out.slice(k, 1 << 16) for k in range(0, len(out), 1 << 16))


def phrased(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The keys and phrases of each text that has any; text is the last column."""
    for batch in batches:
        for at, size in slices((batch.column(batch.num_columns - 1),)):
            rows = batch.slice(at, size)
            texts = [t or "" for t in rows.column(rows.num_columns - 1).to_pylist()]
            found = [p for a, b in parts(texts) for p in Grams(texts[a:b]).phrases(b - a, k)]
            some = pa.array([x for x, p in enumerate(found) if p], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(some) for c in rows.columns[:-1]), pa.array([p for p in found if p], pa.list_(pa.string()))], names=[*rows.schema.names[:-1], "phrases"])
