"""Many forms at once: an automaton with goto and failure links finds the first place of every form of a lexicon in one pass over a text.

The automaton is three arrays (sorted arcs, failure links, ends) that are built once from the lexicon and go to the tasks with the
function; the plan has one function whatever the number of forms. Texts are read side by side, cut into
segments that begin as far before their own characters as the longest form reaches.

Null texts have no forms. Empty forms are not looked for; forms that are there twice count once.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Mapping, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column

from weftline.shipping import arrow_udf, sliced

#: Characters of a segment, and of the texts that are read together.
SEGMENT, TOGETHER = 512, 1 << 20


class Automaton:
    """The automaton of these forms."""

    def __init__(self, forms: Sequence[str]):
        self.forms = sorted({f for f in forms if f})
        self.lengths = np.array([len(f) for f in self.forms], np.int64)
        self.longest = int(self.lengths.max()) if self.forms else 1
        self.alphabet = np.unique(np.array([ord(c) for f in self.forms for c in f] or [0], np.uint32))
        self.width = len(self.alphabet) + 1  # the last stands for all other characters
        place = {int(c): k for k, c in enumerate(self.alphabet)}
        arcs: list[dict[int, int]] = [{}]
        ends = [-1]
        for k, form in enumerate(self.forms):
            at = 0
            for c in form:
                at = arcs[at].setdefault(place[ord(c)], len(arcs))
                if at == len(arcs):
                    arcs.append({})
                    ends.append(-1)
            ends[at] = k
        failure, shorter = [0] * len(arcs), [0] * len(arcs)
        queue = deque(arcs[0].values())
        while queue:
            at = queue.popleft()
            shorter[at] = failure[at] if ends[failure[at]] >= 0 else shorter[failure[at]]
            for c, to in arcs[at].items():
                back = failure[at]
                while back and c not in arcs[back]:
                    back = failure[back]
                failure[to] = arcs[back].get(c, 0)
                queue.append(to)
        code = np.array([s * self.width + c for s, x in enumerate(arcs) for c in x], np.int64)
        order = np.argsort(code)
        self.code = np.append(code[order], 2**62)
        self.to = np.append(np.array([t for x in arcs for t in x.values()], np.int64)[order], 0) if len(code) else np.zeros(1, np.int64)
        self.failure, self.shorter, self.ends = (np.array(x, np.int64) for x in (failure, shorter, ends))
        self.root = np.zeros(self.width, np.int64)
        for c, t in arcs[0].items():
            self.root[c] = t
        self.tells = (self.ends >= 0) | (self.shorter > 0)

    @cached_property
    def letters(self) -> np.ndarray:
        """The place of every code point in the alphabet."""
        out = np.full(0x110000, self.width - 1, np.int32)
        out[self.alphabet] = np.arange(len(self.alphabet))
        return out

    def _after(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The states after one more character of each text."""
        out = self.root[c]
        here = np.flatnonzero((state > 0) & (c < self.width - 1))
        at = state[here]
        while len(here):
            code = at * self.width + c[here]
            arc = np.searchsorted(self.code, code)
            fits = self.code[arc] == code
            out[here[fits]] = self.to[arc[fits]]
            rest = ~fits
            here, at = here[rest], self.failure[at[rest]]
            more = at > 0
            here, at = here[more], at[more]
        return out

    def places(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, form, place): the first place, from 1, of each form that a text holds; sorted by text and form."""
        found = [np.zeros((3, 0), np.int64)]
        sizes = [len(x or "") for x in texts]
        start = total = 0
        for k, n in enumerate([*sizes, TOGETHER]):
            if total and total + n > TOGETHER or k == len(sizes):
                found.append(self._read([x or "" for x in texts[start:k]]) + np.array([[start], [0], [0]]))
                start, total = k, 0
            total += n
        text, form, place = np.concatenate(found, axis=1)
        return text, form, place

    def _read(self, texts: list[str]) -> np.ndarray:
        letters = self.letters[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        bounds = np.cumsum([0, *map(len, texts)])
        pieces = -(-np.diff(bounds) // SEGMENT)
        text = np.repeat(np.arange(len(texts)), pieces)
        of = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.maximum(bounds[text], bounds[text] + of * SEGMENT - (self.longest - 1))
        length = np.minimum(bounds[text + 1], bounds[text] + (of + 1) * SEGMENT) - start
        order = np.argsort(-length, kind="stable")
        text, start, length = text[order], start[order], length[order]
        state = np.zeros(len(text), np.int64)
        hits: list[tuple[np.ndarray, np.ndarray, int]] = []
        reading = len(text)
        for step in range(int(length[0]) if len(length) else 0):
            while length[reading - 1] <= step:
                reading -= 1
            state[:reading] = self._after(state[:reading], letters[start[:reading] + step])
            here = np.flatnonzero(self.tells[state[:reading]])
            if len(here):
                hits.append((here, state[here], step))
        if not hits:
            return np.zeros((3, 0), np.int64)
        segment, at = np.concatenate([h for h, _, _ in hits]), np.concatenate([s for _, s, _ in hits])
        end = start[segment] + np.repeat([t for _, _, t in hits], [len(h) for h, _, _ in hits]) + 1 - bounds[text[segment]]
        out = []
        while len(at):
            ended = self.ends[at] >= 0
            form = self.ends[at[ended]]
            out.append(np.stack((text[segment[ended]], form, end[ended] - self.lengths[form] + 1)))
            more = self.shorter[at] > 0  # a shorter form ends at the same place
            segment, end, at = segment[more], end[more], self.shorter[at[more]]
        every = np.concatenate(out, axis=1)
        every = every[:, np.lexsort((every[2], every[1], every[0]))]
        first = np.ones(every.shape[1], bool)
        first[1:] = (every[0, 1:] != every[0, :-1]) | (every[1, 1:] != every[1, :-1])
        return every[:, first]


def _by_text(n: int, text: np.ndarray) -> np.ndarray:
    return np.searchsorted(text, np.arange(n + 1))


def tags(text: Column, lexicon: Mapping[str, Sequence[str]], limit: int) -> Column:
    """Tags with a form in the text, by the first place of any of their forms, then by name; array of strings."""
    machine = Automaton([f for forms in lexicon.values() for f in forms])
    names = sorted(lexicon)
    place = {f: k for k, f in enumerate(machine.forms)}
    pairs = np.array(sorted((place[f], k) for k, t in enumerate(names) for f in set(lexicon[t]) if f), np.int64).reshape(-1, 2)  # a form may speak for several tags
    begin = np.searchsorted(pairs[:, 0], np.arange(len(machine.forms) + 1))

    @sliced
    def one(a: pa.Array) -> pa.Array:
        texts, forms, places = machine.places(a.to_pylist())
        each = np.diff(begin)[forms]
        row = np.repeat(np.arange(len(forms)), each)
        tag = pairs[begin[forms][row] + np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each), 1]
        order = np.lexsort((tag, places[row], texts[row]))
        texts, tag = texts[row][order].tolist(), tag[order].tolist()
        out: list[list[str]] = [[] for _ in range(len(a))]
        for t, k in zip(texts, tag):
            if len(out[t]) < limit and names[k] not in out[t]:
                out[t].append(names[k])
        return pa.array(out, pa.list_(pa.string()))

    @arrow_udf("array<string>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from map(one, batches)

    return find(text)


def scores(text: Column, lexicon: Mapping[str, Sequence[str]]) -> Column:
    """Labels with a word in the text as (label, score): 1 + 0.35 letters for each word that is there; best first, then by label."""
    machine = Automaton([w for words in lexicon.values() for w in words])
    names = sorted(lexicon)
    place = {f: k for k, f in enumerate(machine.forms)}
    pairs = np.array(sorted((place[w], k) for k, t in enumerate(names) for w in set(lexicon[t]) if w), np.int64).reshape(-1, 2)
    begin = np.searchsorted(pairs[:, 0], np.arange(len(machine.forms) + 1))
    kind = pa.list_(pa.struct([("label", pa.string()), ("score", pa.float64())]))

    @sliced
    def one(a: pa.Array) -> pa.Array:
        texts, forms, _ = machine.places(a.to_pylist())
        each = np.diff(begin)[forms]
        row = np.repeat(np.arange(len(forms)), each)
        label = pairs[begin[forms][row] + np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each), 1]
        key, inverse = np.unique(texts[row] * len(names) + label, return_inverse=True)
        sums = np.round(np.bincount(inverse, 1 + 0.35 * machine.lengths[forms[row]], len(key)), 6)
        owner, label = key // max(1, len(names)), key % max(1, len(names))
        order = np.lexsort((label, -sums, owner))
        ends = _by_text(len(a), owner[order])
        labels, values = label[order].tolist(), sums[order].tolist()
        return pa.array([[{"label": names[k], "score": s} for k, s in zip(labels[x:y], values[x:y])] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())], kind)

    @arrow_udf("array<struct<label string, score double>>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from map(one, batches)

    return score(text)
