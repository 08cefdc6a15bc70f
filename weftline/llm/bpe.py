"""BPE encoding and decoding over a table of distinct words.

1. Each block of documents (see blocks) is split into words once: a word is a stretch
   that byte-level BPE never joins with its neighbours (see token_counts.pieces). The
   block keeps its texts as positions in its list of distinct words, which is sorted by
   bucket, a hash of the word, and sends each bucket its part of the list.
2. A bucket's task reads its lists from all blocks one after the other and encodes each
   distinct word once, however many blocks hold it (a word is encoded again only after
   REMEMBERED others of its bucket).
3. The ids come back in the order of the lists, which is that of the positions: the
   block joins them to its texts by position and decodes through the id-to-piece table,
   which has the vocabulary's size whatever the input. Texts themselves never travel.

Null and empty texts have no ids and decode to the empty text. Repeated rows and
repeated ids give a row each. An empty table gives no rows. Other columns are not touched.
Documents that come out of a shuffle are written first, so that an executor may be lost at any time.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.blocks import BLOCK_BYTES, block_id, from_ipc, from_planes, in_blocks, ipc, planes, released
from weftline.llm.common import stored, table, text_bytes
from weftline.shipping import ship
from weftline.llm.token_counts import ADJOINING, encode_batches, pieces, tokenizer

#: A bucket of words for so many bytes of text, and buckets at most, so that a block's lists keep some dozen words
#: each; a bucket's task streams its lists, so it may be of any size.
BUCKET_BYTES, MOST_BUCKETS = 32 << 20, 8_192
#: Words whose ids a bucket's task keeps, at most, and words that are joined at a time.
REMEMBERED, CHUNK = 400_000, 1 << 19
#: Bytes of text that are split at a time.
SPLIT_BYTES = 4 << 20


@lru_cache(4)
def id_to_piece(path: str) -> list[bytes]:
    """The bytes of every id's piece, by id."""
    t = tokenizer(path)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): bytes([b]) for b in plain} | {chr(256 + k): bytes([b]) for k, b in enumerate(others)}
    out = [b""] * t.get_vocab_size(with_added_tokens=True)
    for token, i in t.get_vocab(with_added_tokens=True).items():
        if i >= len(out):
            out.extend([b""] * (i + 1 - len(out)))
        out[i] = b"".join(byte.get(c) or c.encode() for c in token)
    return out


def _encoded_words(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    d = words.cast(pa.large_string()).dictionary_encode()
    return d.dictionary, d.indices.to_numpy(zero_copy_only=False).astype(np.int32, copy=False)


def split_words(texts: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the place in them of every word of the texts, and the number of words of each text."""
    parts = [_split(some) for chunk in texts.chunks for some in _slices(chunk)]
    words, place = _encoded_words(pa.concat_arrays([pa.array([], pa.large_string()), *(w for w, _, _ in parts)]))
    starts = np.cumsum([0, *(len(w) for w, _, _ in parts)])
    at = [place[start : start + len(w)][x] for start, (w, x, _) in zip(starts.tolist(), parts)]
    return words, np.concatenate([np.zeros(0, np.int32), *at]), np.concatenate([np.zeros(0, np.int64), *(n for _, _, n in parts)])


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Neighbouring texts of about SPLIT_BYTES, or one larger text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SPLIT_BYTES, "right")))
        yield texts.slice(at, end - at)
        at = end


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    odd = np.fromiter((ADJOINING.search(x.as_py()) is not None for x in texts), bool, len(texts))
    split = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
    flat = split.flatten()
    sizes = np.zeros(len(texts), np.int64)
    sizes[~odd] = np.diff(split.offsets.to_numpy())
    starts = split.offsets.to_numpy()[:-1] - (split.offsets[0].as_py() if len(split.offsets) else 0)
    # the first word of a text stands without the space that all others begin with
    first, first_at = _encoded_words(flat.take(pa.array(starts)))
    bare, at = _encoded_words(flat)
    at = at.copy()
    at[starts] = len(bare) + first_at
    parts = [pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), bare, pa.scalar("", pa.large_string())), first]
    if odd.any():
        cut = [pieces(x) for x in texts.filter(pa.array(odd)).to_pylist()]
        sizes[odd] = [len(x) for x in cut]
        third, third_at = _encoded_words(pa.array([w for x in cut for w in x], pa.large_string()))
        parts.append(third)
        merged = np.empty(int(sizes.sum()), np.int32)
        where = np.repeat(odd, sizes)
        merged[~where], merged[where] = at, len(bare) + len(first) + third_at
        at = merged
    return pa.concat_arrays(parts), at, sizes


def _block(block: int, rows: pa.Table, buckets: int) -> pa.RecordBatch:
    words, at, sizes = split_words(rows.column(rows.num_columns - 1))
    names = (w for k in range(0, len(words), 1 << 14) for w in words.slice(k, 1 << 14).to_pylist())
    bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in names), np.int64, len(words))
    used = np.zeros(len(words), bool)
    used[at] = True
    order = pc.sort_indices(words).to_numpy()
    order = order[used[order]]
    order = order[np.argsort(bucket[order], kind="stable")]
    new = np.zeros(len(words), np.int32)
    new[order] = np.arange(len(order), dtype=np.int32)
    lists, held = words.take(pa.array(order)), bucket[order]
    ends = np.flatnonzero(np.diff(held, append=-1)) + 1
    kinds = [-1, *held[ends - 1].tolist()]
    data = [ipc(rows.remove_column(rows.num_columns - 1).append_column("sizes", pa.array(sizes)))]
    data += [ipc(pa.table({"words": lists.slice(start, end - start).cast(pa.string())})) for start, end in zip([0, *ends[:-1].tolist()], ends.tolist())]
    spots = planes(new[at])
    ids = pa.array([block_id(block, data[0], spots)] * len(kinds), pa.int64())
    return pa.RecordBatch.from_pydict({"block": ids, "bucket": pa.array(kinds, pa.int32()), "data": pa.array(data, pa.binary()), "words": pa.array([spots] + [None] * (len(kinds) - 1), pa.binary())})


def block_rows(batches: Iterator[pa.RecordBatch], text: str, buckets: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Of each block: its rows with their words' positions (bucket -1), and each bucket's words in the order of the positions."""
    for block, rows in in_blocks(batches, text, block_bytes):
        yield _block(block, rows, buckets)
        del rows
        released()


def encoded_words(lists: DataFrame, path: str, buckets: int) -> DataFrame:
    """(block, bucket, data): a list of ids for each word, in the words' order; each distinct word is encoded once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        known: dict[str, bytes] = {"": b""}  # ids as four bytes each
        for batch in batches:
            for block, bucket, data in zip(*(batch.column(c) for c in ("block", "bucket", "data"))):
                words = from_ipc(data)["words"].to_pylist()
                if len(known) > REMEMBERED:
                    known = {"": b""}
                for w, e in encode_batches(t, [w for w in words if w not in known]):
                    known[w] = array("i", e.ids).tobytes()
                each = [known[w] for w in words]
                ends = np.cumsum([0, *map(len, each)]) // 4
                ids = ipc(pa.table({"ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(each), np.int32)))}))
                yield pa.RecordBatch.from_pydict({"block": pa.array([block.as_py()], pa.int64()), "bucket": pa.array([bucket.as_py()], pa.int32()), "data": pa.array([ids], pa.binary())})
        known.clear()
        released()

    return lists.repartition(buckets, "bucket").mapInArrow(encode, "block long, bucket int, data binary")


def _lists(ids: pa.Table) -> pa.LargeListArray:
    """The ids of a block's words, in the order of the words' places."""
    each = [x["ids"].combine_chunks() for x in map(from_ipc, ids.sort_by("bucket")["data"])]
    return pa.concat_arrays([pa.array([], pa.list_(pa.int32())), *each]).cast(pa.large_list(pa.int32()))


def _written(lists: pa.LargeListArray) -> pa.Array:
    """Each list as text, with a comma before each number."""
    joined = pc.binary_join(pa.ListArray.from_arrays(lists.offsets.cast(pa.int32()), lists.values.cast(pa.string())), ",").cast(pa.large_string())
    comma = pa.array(["", ","], pa.large_string()).take(pa.array((np.diff(lists.offsets.to_numpy()) > 0).astype(np.int8)))
    return pc.binary_join_element_wise(comma, joined, pa.scalar("", pa.large_string())).cast(pa.large_binary())


def _read(lists: pa.LargeListArray, path: str) -> pa.Array:
    """The bytes that each list of ids decodes to."""
    each = pa.array(id_to_piece(path), pa.large_binary()).take(lists.values)
    ends = np.frombuffer(each.buffers()[1], np.int64, len(each) + 1, 8 * each.offset)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends[lists.offsets.to_numpy()]), each.buffers()[2]])


class _Joined:
    """The words' bytes at these positions, one after the other."""

    def __init__(self, each: pa.Array, at: np.ndarray):
        taken = each.take(pa.array(at))
        self.ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, 8 * taken.offset)
        self.bytes = memoryview(taken.buffers()[2] or b"")

    def part(self, start: int, end: int) -> memoryview:
        return self.bytes[self.ends[start] : self.ends[end]]


def settled(docs: DataFrame) -> DataFrame:
    """docs, written first if they come out of a shuffle: a lost task then reads its rows in the same order again, and makes the same blocks."""
    return stored(docs, "docs") if "Exchange" in docs._jdf.queryExecution().sparkPlan().toString() or "Exchange" in docs._jdf.queryExecution().executedPlan().toString() else docs


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), texts: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """key, the columns to keep, n_tokens, ids_sha256 and decoded_sha256 of each row; with texts also ids (array<int>) and decoded.

    A column to keep that has the name of a result, or of the key, gives way to it.
    """
    ship(docs.sparkSession)
    docs = settled(docs.select(*{c: None for c in (key, *keep, text)}))
    size = text_bytes(docs, text)
    buckets = int(min(MOST_BUCKETS, max(1, -(-size // min(BUCKET_BYTES, 2 * block_bytes)))))
    fields = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "array<int>", "decoded": "string"} if texts else {})
    keep = tuple(c for c in dict.fromkeys(keep) if c != key and c not in fields)
    blocks = docs.select(key, *keep, F.col(text).alias("_text")).mapInArrow(lambda batches: block_rows(batches, "_text", buckets, block_bytes), "block long, bucket int, data binary, words binary").groupBy("block")
    # one shuffle of the blocks serves the lists and the assembly
    lists = blocks.applyInArrow(lambda rows: rows.filter(pc.greater_equal(rows["bucket"], 0)).drop_columns(["words"]), "block long, bucket int, data binary")
    found = encoded_words(lists, path, buckets)

    def assemble(rows: pa.Table, ids: pa.Table) -> pa.Table:
        out = joined(rows, ids)
        released()
        return out

    def joined(rows: pa.Table, ids: pa.Table) -> pa.Table:
        mine = rows.filter(pc.less(rows["bucket"], 0))
        if len(mine) != 1 or len(ids) != len(rows) - 1:
            raise RuntimeError("a block was read anew with its rows in another order")
        rows = from_ipc(mine["data"][0])
        sizes = rows.column(rows.num_columns - 1).to_numpy()
        rows = rows.remove_column(rows.num_columns - 1)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        at = from_planes(mine["words"][0].as_py(), int(ends[-1]))
        lists = _lists(ids)
        written, read = _written(lists), _read(lists, path)
        tokens = np.diff(lists.offsets.to_numpy())
        n_tokens = np.zeros(len(sizes), np.int64)
        digests = [(hashlib.sha256(), hashlib.sha256()) for _ in range(len(sizes))]
        begun = np.zeros(len(sizes), bool)
        for a in range(0, len(at), CHUNK):
            b = min(len(at), a + CHUNK)
            ids_text, bytes_text = _Joined(written, at[a:b]), _Joined(read, at[a:b])
            before = np.concatenate(([0], np.cumsum(tokens[at[a:b]])))
            for k in range(int(np.searchsorted(ends, a, "right")) - 1, int(np.searchsorted(ends, b, "left"))):
                start, end = max(a, int(ends[k])) - a, min(b, int(ends[k + 1])) - a
                if end > start:
                    n_tokens[k] += before[end] - before[start]
                    part = ids_text.part(start, end)
                    digests[k][0].update(part if begun[k] else part[1:])
                    begun[k] |= len(part) > 0
                    digests[k][1].update(str(bytes_text.part(start, end), "utf-8", "replace").encode())
        out: dict[str, pa.Array] = {"n_tokens": pa.array(n_tokens, pa.int64())}
        out |= {c: pa.array([d[k].hexdigest() for d in digests], pa.string()) for k, c in enumerate(("ids_sha256", "decoded_sha256"))}
        if texts:
            whole = lists.take(pa.array(at)).flatten() if len(at) else pa.array([], pa.int32())
            of = np.concatenate(([0], np.cumsum(n_tokens)))
            out["ids"] = pa.array([whole.slice(of[k], n_tokens[k]).to_pylist() for k in range(len(sizes))], pa.list_(pa.int32()))
            whole_bytes = _Joined(read, at)
            out["decoded"] = pa.array([str(whole_bytes.part(int(ends[k]), int(ends[k + 1])), "utf-8", "replace") for k in range(len(sizes))], pa.string())
        for c, v in out.items():
            rows = rows.append_column(c, v)
        return rows

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (key, *keep)]
    return blocks.cogroup(found.groupBy("block")).applyInArrow(assemble, ", ".join([*kinds, *(f"{c} {t}" for c, t in fields.items())]))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
