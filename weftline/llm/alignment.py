"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

A is a byte-level BPE of the tokenizers library and reads a space and the text; B is a
BPE of the sentencepiece library and reads the text, to which it adds that space. Both
give tokens of the same bytes. Where a token of A and one of B end at the same byte, a
group ends; two tokens are linked where their bytes overlap.

Blocks of documents (see blocks) run through one chain of Arrow operations:

1. The distinct words of a block are encoded by both tokenizers, and each text takes its
   words' lists of ids. A word begins with spaces; none of the tokenizers joins across such a
   place. (If B has pieces that do, whole texts are the words.)
2. The lists of the documents are flattened with their parent indices; the token's bytes,
   summed up within each document, give every token's end.
3. A full hash join of A's and B's ends on (document, end) gives every place where a token
   ends. There one token of each side covers the bytes before, so each place is a link, and each
   place of both sides ends a group.
4. Table.group_by counts the id pairs of the block's links. The block keeps its links
   as places in its list of pairs.

Spark adds up the blocks' counts by id pair, finds the largest for each id of B
(bounded by B's vocabulary, so it is broadcast), joins the totals back to the blocks' pairs,
and each block adds up its documents' links. A pair is one row for each block that holds
it, however often it occurs, so no pair is a task's load; texts are read once and never travel.

Texts that are null or empty, or of which the tokens' bytes are not the space and the
text (a text with U+2581, which B takes for a space), have no tokens: zeros, and '' for
groups_sha256. Rows that share an id are documents each. An empty table gives no rows. Other columns do not matter.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.blocks import block_id, from_ipc, from_planes, in_blocks, ipc, planes
from weftline.llm.bpe import id_to_piece
from weftline.llm.common import stored, table
from weftline.shipping import ship

#: Bytes of text in a block, and characters of it that are aligned at a time.
BLOCK_BYTES, SLICE = 6 << 20, 1 << 19
#: Words that are encoded at a time, and that a task remembers.
SOME, REMEMBERED = 1 << 15, 400_000

_ADJOINING = re.compile(r"\s ")
_BETWEEN = re.compile(r"(?<=\S)(?= )")
_BYTE = re.compile(r"<0x([0-9A-Fa-f]{2})>$")
_JOINING = re.compile("[^▁]▁")
_loaded: dict[tuple[str, str], Pair] = {}


class Pair:
    """Both tokenizers, with the bytes of every id."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.joins = any(_JOINING.search(p) for p in pieces)
        self.space = self.b.piece_to_id("▁")
        bytes_b = [bytes([int(_BYTE.match(p)[1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.bytes_a, self.bytes_b = pa.array(id_to_piece(path_a), pa.large_binary()), pa.array(bytes_b, pa.large_binary())
        self.size_a, self.size_b = (pc.binary_length(x).cast(pa.int64()) for x in (self.bytes_a, self.bytes_b))
        n = len(self.bytes_a), len(self.bytes_b)
        #: The ids as text with what follows them: in a group, and at the end of its part of a group.
        self.written = pa.array([f"{i}{end}" for k, ends in zip(n, (",|", ",;")) for end in ends for i in range(k)], pa.large_string())

    def words(self, text: str) -> list[str]:
        """A space and the text, cut at places that neither tokenizer joins across."""
        text = " " + text
        if self.joins:
            return [text]
        if _ADJOINING.search(text):
            return _BETWEEN.split(text)
        return [" " + x for x in text.split(" ")[1:]]

    def ids(self, words: list[str]) -> tuple[pa.Array, pa.Array]:
        """A's and B's ids of each word, of which B adds the first space itself."""
        of_a, of_b = [lists_of([])], [lists_of([])]
        for k in range(0, len(words), SOME):
            some = words[k : k + SOME]
            of_a.append(lists_of([e.ids for e in self.a.encode_batch_fast(some, add_special_tokens=False)]))
            told = self.b.encode([w[1:] for w in some], num_threads=1)
            of_b.append(lists_of([ids if len(w) > 1 else [self.space] for w, ids in zip(some, told)]))
        return pa.concat_arrays(of_a), pa.concat_arrays(of_b)


def lists_of(ids: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)])
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))))


def pair(path_a: str, path_b: str) -> Pair:
    """The tokenizers, loaded once in a process."""
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Pair(path_a, path_b)
    return _loaded[path_a, path_b]


def distinct_words(p: Pair, texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words, the place among them of every word of the texts, and the number of words of each text."""
    odd = np.array([bool(x) and (p.joins or x[0].isspace() or _ADJOINING.search(x) is not None) for x in texts], bool)
    some = np.array([bool(x) for x in texts], bool)
    plain = some & ~odd
    sizes = np.zeros(len(texts), np.int64)
    split = pc.split_pattern(pa.array(texts, pa.large_string()).filter(pa.array(plain)), " ")
    sizes[plain] = np.diff(split.offsets.to_numpy())
    cut = [p.words(x) for x, is_odd in zip(texts, odd) if is_odd]
    sizes[odd] = [len(x) for x in cut]
    first = split.flatten().dictionary_encode()
    second = pa.array([w for x in cut for w in x], pa.large_string()).dictionary_encode()
    named = pa.concat_arrays([pc.binary_join_element_wise(pa.scalar("", pa.large_string()), first.dictionary, pa.scalar(" ", pa.large_string())), second.dictionary]).dictionary_encode()
    place = named.indices.to_numpy(zero_copy_only=False)
    at = np.empty(int(sizes.sum()), np.int32)
    is_odd = np.repeat(odd, sizes)
    at[~is_odd] = place[: len(first.dictionary)][first.indices.to_numpy(zero_copy_only=False)]
    at[is_odd] = place[len(first.dictionary) :][second.indices.to_numpy(zero_copy_only=False)]
    return named.dictionary, at, sizes


class Known:
    """Words of a task's blocks with the ids of both sides, REMEMBERED of them besides a block's own."""

    def __init__(self, p: Pair):
        self.p = p
        self.words, self.sides = pa.array([], pa.large_string()), p.ids([])

    def lists(self, words: pa.Array) -> list[pa.Array]:
        """The ids of these words, of which only those are encoded that are not known."""
        new = words.filter(pc.is_null(pc.index_in(words, value_set=self.words)))
        if len(self.words) + len(new) > REMEMBERED:
            self.__init__(self.p)
            new = words
        self.words = pa.concat_arrays([self.words, new])
        self.sides = tuple(pa.concat_arrays([old, ids]) for old, ids in zip(self.sides, self.p.ids(new.to_pylist())))
        at = pc.index_in(words, value_set=self.words)
        return [ids.take(at) for ids in self.sides]


class Encoded:
    """The ids of both sides of a block's texts: lists of its distinct words, and each text as places of words."""

    def __init__(self, p: Pair, texts: list[str | None], known: Known | None = None):
        words, self.at, sizes = distinct_words(p, texts)
        self.bounds = np.concatenate(([0], np.cumsum(sizes)))
        self.sides = (known or Known(p)).lists(words)

    def ids(self, start: int, end: int) -> Iterator[pa.Array]:
        """A's and B's ids of the texts from start to end: a large list for each text."""
        at, bounds = self.at[self.bounds[start] : self.bounds[end]], self.bounds[start : end + 1] - self.bounds[start]
        for lists in self.sides:
            each = lists.take(pa.array(at))
            ends = np.concatenate(([0], np.cumsum(pc.list_value_length(each).to_numpy(zero_copy_only=False))))
            yield pa.LargeListArray.from_arrays(pa.array(ends[bounds], pa.int64()), each.flatten())


def _bytes_of(ids: pa.Array, each: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The tokens' bytes one after the other, and where each text's begin and end."""
    data = each.take(ids.flatten())
    ends = np.frombuffer(data.buffers()[1], np.int64, len(data) + 1, 8 * data.offset)
    return memoryview(data.buffers()[2] or b"").cast("B"), ends[ids.offsets.to_numpy() - ids.offsets[0].as_py()]


def covering(p: Pair, ids_a: pa.Array, ids_b: pa.Array, texts: list[str | None]) -> np.ndarray:
    """Whether the tokens of both sides are, byte by byte, a space and the text."""
    (data_a, ends_a), (data_b, ends_b) = _bytes_of(ids_a, p.bytes_a), _bytes_of(ids_b, p.bytes_b)
    out = np.zeros(len(texts), bool)
    for k, x in enumerate(texts):
        if x:
            whole = b" " + x.encode()
            out[k] = data_a[ends_a[k] : ends_a[k + 1]] == whole and data_b[ends_b[k] : ends_b[k + 1]] == whole
    return out


def ends(ids: pa.Array, size: pa.Array, side: str) -> pa.Table:
    """doc, end, the token's id and its place among all, of every token; the end is counted from its document's beginning."""
    flat, doc = pc.list_flatten(ids), pc.list_parent_indices(ids)
    sums = pc.cumulative_sum(size.take(flat))
    # what was summed up before each document
    before = pa.concat_arrays([pa.array([0], pa.int64()), sums]).take(pa.array(ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()))
    return pa.table({"doc": doc, "end": pc.subtract(sums, before.take(doc)), side: flat, f"{side}_at": pa.array(np.arange(len(flat)), pa.int64())})


class Aligned:
    """The links and groups of a block's documents."""

    def __init__(self, p: Pair, ids_a: pa.Array, ids_b: pa.Array):
        n = len(ids_a)
        places = ends(ids_a, p.size_a, "a").join(ends(ids_b, p.size_b, "b"), ["doc", "end"], join_type="full outer", use_threads=False)
        doc = places["doc"].to_numpy().astype(np.int64)
        places = places.take(pa.array(np.argsort((doc << 40) + places["end"].to_numpy(), kind="stable"))).combine_chunks()
        both = pc.and_(places["a_at"].is_valid(), places["b_at"].is_valid()).to_numpy()
        doc = places["doc"].to_numpy()
        self.a, self.b = (pc.fill_null_backward(places[c]).to_numpy() for c in ("a", "b"))
        self.n_a, self.n_b = (pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (ids_a, ids_b))
        self.n_links = np.bincount(doc, minlength=n)
        self.n_groups = np.bincount(doc[both], minlength=n)
        self.digests = self._digests(p, places, both)

    def _digests(self, p: Pair, places: pa.Table, both: np.ndarray) -> list[str]:
        """The hash of each document's groups, written out."""
        group = np.cumsum(both) - both
        last_a, last_b = (places[f"{c}_at"].filter(pa.array(both)).to_numpy() + 1 for c in "ab")  # tokens up to each group's end
        out = np.empty(int(self.n_a.sum() + self.n_b.sum()), np.int64)
        base = 0
        for c, other, number in (("a", np.concatenate(([0], last_b)), len(p.bytes_a)), ("b", np.concatenate((last_a, [0])), len(p.bytes_b))):
            here = places[f"{c}_at"].is_valid().to_numpy()
            ids = places[c].filter(pa.array(here)).to_numpy()
            # before a token stand its own side's tokens, and the other side's of the groups before, or, for B, also of its own
            out[places[f"{c}_at"].filter(pa.array(here)).to_numpy() + other[group[here]]] = base + ids + number * both[here]
            base += 2 * number
        written = p.written.take(pa.array(out))
        at = np.frombuffer(written.buffers()[1], np.int64, len(written) + 1, 8 * written.offset)[np.concatenate(([0], np.cumsum(self.n_a + self.n_b)))].tolist()
        data = memoryview(written.buffers()[2] or b"")
        return [hashlib.sha256(data[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(at, at[1:])]


def slices(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    """(start, end) of neighbouring texts of about `most` characters together."""
    start = size = 0
    for k, x in enumerate(texts):
        if k > start and size + len(x or "") > most:
            yield start, k
            start, size = k, 0
        size += len(x or "")
    if start < len(texts):
        yield start, len(texts)


def aligned(p: Pair, texts: list[str | None], most: int = SLICE, known: Known | None = None) -> Iterator[Aligned]:
    """The alignments of these texts, slice by slice."""
    encoded = Encoded(p, texts, known)
    for start, end in slices(texts, most):
        ids_a, ids_b = encoded.ids(start, end)
        fits = pa.array(covering(p, ids_a, ids_b, texts[start:end]))
        yield Aligned(p, *(pc.if_else(fits, ids, pa.scalar([], ids.type)) for ids in (ids_a, ids_b)))


def pairs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct codes, how often each occurs, and the place among them of every one."""
    code = pa.array(codes)
    counts = pa.table({"code": code}).group_by("code", use_threads=False).aggregate([("code", "count")])
    distinct = counts["code"].combine_chunks()
    return distinct.to_numpy(), counts["code_count"].to_numpy(), pc.index_in(code, value_set=distinct).to_numpy(zero_copy_only=False)


def block_rows(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Of each block: its documents, its links as places of pairs, and the pairs with their counts."""
    p = pair(path_a, path_b)
    known, width = Known(p), len(p.bytes_b)
    for place, rows in in_blocks(batches, "text", block_bytes):
        codes, told, digests = [np.zeros(0, np.int64)], [np.zeros((4, 0), np.int64)], []
        for x in aligned(p, rows["text"].to_pylist(), known=known):
            codes.append(x.a.astype(np.int64) * width + x.b)
            told.append(np.stack((x.n_a, x.n_b, x.n_groups, x.n_links)))
            digests += x.digests
        code, n, links = pairs(np.concatenate(codes))
        numbers = np.concatenate(told, axis=1)
        docs = pa.table({"doc_id": rows["doc_id"], **dict(zip(("n_a", "n_b", "n_groups", "n_links"), map(pa.array, numbers))), "groups_sha256": pa.array(digests, pa.string())})
        held = ipc(docs), planes(links)
        lists = {c: pa.array([v], pa.list_(t)) for c, v, t in (("a", code // width, pa.int32()), ("b", code % width, pa.int32()), ("n", n, pa.int64()))}
        yield pa.RecordBatch.from_pydict({"block": pa.array([block_id(place, *held)], pa.int64()), **{c: pa.array([d], pa.binary()) for c, d in zip(("docs", "links"), held)}, **lists})


def aligned_counts(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Of every document doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256; and the corpus-wide counts:
    (a, b, n, best), the id pairs with their links and whether that is the most for b."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    some = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    blocks = stored(some.mapInArrow(lambda batches: block_rows(batches, path_a, path_b, block_bytes), "block long, docs binary, links binary, a array<int>, b array<int>, n array<long>"), "aligned")
    each = blocks.select("block", F.posexplode(F.arrays_zip("a", "b", "n"))).select("block", F.col("pos").alias("place"), "col.a", "col.b", "col.n")
    totals = stored(each.groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    most = totals.groupBy("b").agg(F.max("n").alias("most"))  # a row for each of B's ids at most
    counts = totals.join(F.broadcast(most), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))
    told = each.drop("n").join(counts, ["a", "b"]).select(F.col("block").alias("of"), "place", "n", "best")

    def assemble(row: pa.Table, told: pa.Table) -> pa.Table:
        if len(row) != 1:
            raise RuntimeError("a block's row is not there once")
        docs = from_ipc(row["docs"][0])
        n_links = docs["n_links"].to_numpy()
        bounds = np.concatenate(([0], np.cumsum(n_links)))
        links = from_planes(row["links"][0].as_py(), int(bounds[-1]))
        sums = {}
        for name, column in (("n_best", told["best"].cast(pa.int64())), ("count_sum", told["n"])):
            by_place = np.zeros(len(told), np.int64)
            by_place[told["place"].to_numpy()] = column.to_numpy()
            sums[name] = np.diff(np.concatenate(([0], np.cumsum(by_place[links])))[bounds])
        out = docs.drop_columns(["groups_sha256"])
        for name, x in sums.items():
            out = out.append_column(name, pa.array(x, pa.int64()))
        return out.append_column("groups_sha256", docs["groups_sha256"])

    fields = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    documents = blocks.select("block", "docs", "links").groupBy("block").cogroup(told.groupBy("of")).applyInArrow(assemble, fields)
    return documents, counts


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return aligned_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]
