"""Importance resampling towards a target distribution, with a head-tail vocabulary.

A text's features are all runs of one to three consecutive words. A feature's bucket is the
crc32 of its words joined by spaces, modulo BUCKETS. A bucket's gain is how much more often the
target's texts fall into it than the corpus's; a document's weight is the sum of its
features' gains, and the documents with the highest weight plus Gumbel noise are drawn.

Buckets are found in two ways that give the same numbers:

* The head: at most HEAD_WORDS frequent words and HEAD_PAIRS frequent pairs of them, broadcast. A
  word has its CRC state, that of the word with a space before it, and its length; since a CRC
  of joined parts is the first part's state carried over the second's length, xor the second's
  state, a run of head words continues from state to state by table look-ups. A frequent pair
  has its state in the table, and runs of three continue from there.
* The tail: a feature with any other word takes the CRC of its bytes directly.

Which words are in the head therefore matters for speed only. A word or pair that makes up 1 /
HEAVY of all has that share in at least one block of the corpus, so each block proposes
those that reach it there, at most HEAVY of them, and Spark adds the proposals up. Words of more
than LONGEST bytes stay in the tail, so the broadcast has a bound of some 7 MB.

Bucket totals cover all texts: each task adds up one array of BUCKETS counts, and only these
arrays are shuffled. Texts stay where they are read. Ranks come from a sort by ranges and the
numbers of rows before each range; no task sees more than its range.

Null texts and texts without words have no features and weight 0. Rows that share a
doc_id are documents each; equal ones get the ranks of their places in any order. A null id counts as the
empty text for its noise and stands before all others in a tie. An empty corpus gives no rows, an empty target counts as no features. Other
columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.blocks import in_blocks
from weftline.llm.common import stored, table
from weftline.shipping import ship

BUCKETS = 10_000
HEAD_WORDS, HEAD_PAIRS, LONGEST = 1 << 16, 1 << 16, 32
#: A word or pair with a share of 1 / HEAVY of a block is proposed for the head, if it is there at least twice.
HEAVY = 1 << 18
#: Steps of the counts, for a doubling, by which the head is cut.
STEPS = 16
#: Bytes of text that a task looks at together.
BLOCK_BYTES = 4 << 20
#: Drawn documents: PERCENT of those with at least LEAST_WORDS words; the noise's seed.
PERCENT, LEAST_WORDS, SEED = 5, 20, 42

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_SPACE = 32


class Words:
    """The words of a block's texts: joined by one space each, with where each begins, its length, and the words of each text."""

    def __init__(self, texts: pa.ChunkedArray):
        whole = pc.fill_null(texts, "").cast(pa.large_string()).combine_chunks()
        if isinstance(whole, pa.ChunkedArray):
            whole = whole.chunk(0) if whole.num_chunks else pa.array([], pa.large_string())
        ends = np.frombuffer(whole.buffers()[1], np.int64, len(whole) + 1, 8 * whole.offset) if len(whole) else np.zeros(1, np.int64)
        raw = np.frombuffer(whole.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(whole) else np.zeros(0, np.uint8)
        bounds = ends - ends[0]
        low = _LOWER[raw]
        inside = _WORD[low]
        before = np.zeros(len(low) + 1, bool)
        before[1:] = inside
        before[bounds] = False  # a text begins and the one before it ends
        after = np.zeros(len(low) + 1, bool)
        after[:-1] = inside
        after[bounds] = False
        starts = np.flatnonzero(inside & ~before[:-1])
        self.length = np.flatnonzero(inside & ~after[1:]) + 1 - starts
        n = len(starts)
        compact = low[inside]
        joined = np.full(len(compact) + n, _SPACE, np.uint8)
        joined[np.arange(len(compact)) + np.repeat(np.arange(n), self.length)] = compact
        self.joined = joined.tobytes()
        self.at = np.cumsum(self.length + 1) - (self.length + 1)
        self.of_text = np.searchsorted(starts, bounds)  # the first word of each text, and the number of words
        offsets = pa.py_buffer(np.concatenate(([0], np.cumsum(self.length))).astype(np.int64))
        named = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, offsets, pa.py_buffer(compact)]).dictionary_encode()
        self.names, self.name = named.dictionary, named.indices.to_numpy(zero_copy_only=False)
        left = np.repeat(self.of_text[1:], np.diff(self.of_text)) - np.arange(n)  # words from here to the text's end
        self.follows = left > 1, left > 2

    def direct(self, first: np.ndarray, words: int) -> np.ndarray:
        """CRCs of the runs of so many words that begin at these, from their bytes."""
        last = first + words - 1
        data = self.joined
        return np.fromiter((crc32(data[a:b]) for a, b in zip(self.at[first].tolist(), (self.at[last] + self.length[last]).tolist())), np.uint32, len(first))


@lru_cache(1)
def carry() -> np.ndarray:
    """For each number of bytes, place and value of a state's byte: the state's part after as many bytes; flat."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    step = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    out = [step]
    for _ in range(LONGEST + 1):
        step = (step >> 8) ^ one[step & 255]
        out.append(step)
    return np.stack(out).reshape(-1)


def carried(state: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The states after so many more bytes, as far as they depend on the states."""
    t, base = carry(), size.astype(np.int64) << 10
    out = t[base + (state & 255)]
    for k in (1, 2, 3):
        out ^= t[base + (k << 8) + ((state >> (8 * k)) & 255)]
    return out


class Head:
    """The frequent words with their states, and the frequent pairs of them with theirs."""

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]]):
        words = sorted(w for w in set(words) if len(w) <= LONGEST)
        place = {w: k for k, w in enumerate(words)}
        self.words = pa.array(words, pa.large_binary())
        self.state = np.array([crc32(w) for w in words] + [0], np.uint32)  # the last stands for words of the tail
        self.spaced = np.array([crc32(b" " + w) for w in words] + [0], np.uint32)
        self.size = np.array([len(w) + 1 for w in words] + [0], np.int64)
        known = sorted((place[a] * len(words) + place[b], crc32(a + b" " + b)) for a, b in set(pairs) if a in place and b in place)
        self.pair = np.array([*(c for c, _ in known), 2**62], np.int64)
        self.pair_state = np.array([*(s for _, s in known), 0], np.uint32)

    def crcs(self, w: Words) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """CRCs of all words, and of the runs of two and of three words, each with where it begins."""
        n = len(self.words)
        found = pc.index_in(w.names, value_set=self.words)
        tail = pc.is_null(found).to_numpy(zero_copy_only=False)
        place = pc.fill_null(found, n).to_numpy(zero_copy_only=False).astype(np.int64)
        state = self.state[place]
        state[tail] = [crc32(x.as_buffer()) for x in w.names.filter(pa.array(tail))]
        place, one = place[w.name], state[w.name]
        is_head = place < n
        two = np.zeros(len(one), np.uint32)
        begins = np.flatnonzero(w.follows[0])
        by_state = is_head[begins] & is_head[begins + 1]
        at = begins[by_state]
        code = place[at] * n + place[at + 1]
        row = np.searchsorted(self.pair, code)
        frequent = self.pair[row] == code
        two[at[frequent]] = self.pair_state[row[frequent]]
        rest = at[~frequent]
        two[rest] = carried(one[rest], self.size[place[rest + 1]]) ^ self.spaced[place[rest + 1]]
        direct = begins[~by_state]
        two[direct] = w.direct(direct, 2)
        begins3 = np.flatnonzero(w.follows[1])
        three = np.zeros(len(begins3), np.uint32)
        by_state = is_head[begins3] & is_head[begins3 + 1] & is_head[begins3 + 2]
        at = begins3[by_state]
        three[by_state] = carried(two[at], self.size[place[at + 2]]) ^ self.spaced[place[at + 2]]
        three[~by_state] = w.direct(begins3[~by_state], 3)
        return one, (begins, two[begins]), (begins3, three)


def proposals(batches: Iterator[pa.RecordBatch], block_bytes: int, heavy: int) -> Iterator[pa.RecordBatch]:
    """Each block's frequent words (second null) and pairs."""
    for _, rows in in_blocks(batches, "text", block_bytes):
        w = Words(rows["text"])
        least = max(2, -(-len(w.name) // heavy))
        first, second, number = [], [], []
        count = np.bincount(w.name, minlength=len(w.names))
        short = pc.binary_length(w.names).to_numpy(zero_copy_only=False) <= LONGEST
        often = np.flatnonzero((count >= least) & short)
        names = w.names.take(pa.array(often))
        first.append(names), second.append(pa.nulls(len(often), pa.large_binary())), number.append(count[often])
        at = np.flatnonzero(w.follows[0])
        fits = (count >= least) & short
        at = at[fits[w.name[at]] & fits[w.name[at + 1]]]
        code, count = np.unique(w.name[at].astype(np.int64) * len(w.names) + w.name[at + 1], return_counts=True)
        code, count = code[count >= least], count[count >= least]
        first.append(w.names.take(pa.array(code // max(1, len(w.names))))), second.append(w.names.take(pa.array(code % max(1, len(w.names))))), number.append(count)
        yield pa.RecordBatch.from_pydict({"first": pa.concat_arrays(first).cast(pa.binary()), "second": pa.concat_arrays(second).cast(pa.binary()), "n": pa.array(np.concatenate(number), pa.int64())})


def frequent(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES, words: int = HEAD_WORDS, pairs: int = HEAD_PAIRS, heavy: int = HEAVY) -> Head:
    """The head of a corpus."""
    proposed = docs.select(F.col(text).alias("text")).mapInArrow(lambda batches: proposals(batches, block_bytes, heavy), "first binary, second binary, n long")
    added = stored(proposed.groupBy("first", "second").agg(F.sum("n").alias("n")), "heads")

    def top(rows: DataFrame, most: int) -> list:
        """The rows with the largest n, `most` at most: a step of n that would not fit as a whole stays out."""
        step = F.floor(F.log2("n") * STEPS)
        least, room = None, most
        for r in rows.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).orderBy(F.desc("step")).collect():  # 64 * STEPS rows at most
            if (room := room - r["rows"]) < 0:
                break
            least = r["step"]
        return [] if least is None else rows.filter(step >= least).collect()

    return Head([bytes(r["first"]) for r in top(added.filter("second is null"), words)], [(bytes(r["first"]), bytes(r["second"])) for r in top(added.filter("second is not null"), pairs)])


def bucket_totals(texts: DataFrame, head, text: str = "text", block_bytes: int = BLOCK_BYTES) -> np.ndarray:
    """The number of features in each bucket, over all texts; head is a broadcast Head."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for _, rows in in_blocks(batches, "text", block_bytes):
            one, (_, two), (_, three) = head.value.crcs(Words(rows["text"]))
            for crcs in (one, two, three):
                sums += np.bincount(crcs % BUCKETS, minlength=BUCKETS)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int32()), "n": pa.array(sums[used], pa.int64())})

    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in texts.select(F.col(text).alias("text")).mapInArrow(add, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():  # BUCKETS rows at most
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the buckets' smoothed shares in the target over those in the corpus)."""
    every, wanted = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log(float(t + 1) * every / (float(s + 1) * wanted))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weights(docs: DataFrame, head, gain: np.ndarray, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_features and weight of every document."""
    kind = docs.schema[key].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in in_blocks(batches, "text", block_bytes):
            w = Words(rows["text"])
            one, (at2, two), (at3, three) = head.value.crcs(w)
            each = gain[one % BUCKETS]
            each[at2] += gain[two % BUCKETS]
            each[at3] += gain[three % BUCKETS]
            sums, n = np.concatenate(([0], np.cumsum(each))), np.diff(w.of_text)
            features = n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0)
            yield from pa.table({"doc_id": rows["doc_id"], "n_words": pa.array(n, pa.int64()), "n_features": pa.array(features, pa.int64()), "weight": pa.array(np.diff(sums[w.of_text]), pa.int64())}).to_batches()

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(key: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln(u))) with u in (0, 1) from a hash of the key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, takes_part: Column, percent: int = PERCENT) -> DataFrame:
    """scored (doc_id, score, ...) with rank: 1, 2, 3... for the floor(percent * N / 100) highest scores of the N rows that take part."""
    order = [F.col("_part").desc(), F.col("score").desc(), F.col("doc_id")]
    placed = scored.withColumn("_part", F.coalesce(takes_part, F.lit(False))).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    placed = stored(placed.withColumns({"_range": F.shiftright("_row", 33).cast("int"), "_row": F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))}), "ranges")
    sizes = sorted(placed.groupBy("_range").agg(F.count("*"), F.sum(F.col("_part").cast("long"))).collect())  # a row for each partition
    drawn = percent * sum(r[2] for r in sizes) // 100
    starts = np.cumsum([0, *(r[1] for r in sizes)]).tolist()
    before = placed.sparkSession.createDataFrame([(r[0], s) for r, s in zip(sizes, starts)], "_range int, _start long")
    rank = F.col("_start") + F.col("_row") + 1
    return placed.join(F.broadcast(before), "_range").withColumn("rank", F.when(F.col("_part") & (rank <= drawn), rank)).drop("_part", "_row", "_range", "_start")


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, block_bytes: int = BLOCK_BYTES, head: Head | None = None) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null where not drawn) of every document."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(head or frequent(docs, text, block_bytes))
    gain = gains(bucket_totals(docs, shared, text, block_bytes), bucket_totals(target, shared, target_text, block_bytes))
    scored = weights(docs, shared, gain, key, text, block_bytes).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    # written, since the sort by ranges reads its rows twice
    return ranked(stored(scored, "weights"), F.col("n_words") >= least_words, percent)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select(F.col("doc_id").cast("long").alias("doc_id"), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


OP11_SQL = r"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
texts AS (SELECT doc_id, false AS goal, coalesce(text, '') AS text FROM documents UNION ALL SELECT NULL, true, coalesce(text, '') FROM benchmark),
numbered AS (SELECT row_number() OVER () AS r, doc_id, goal, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
words AS (SELECT r, goal, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM numbered),
runs AS (SELECT r, goal, a, lead(a) OVER q AS b, lead(a, 2) OVER q AS c FROM words WINDOW q AS (PARTITION BY r ORDER BY i)),
features AS (SELECT r, goal, a AS f FROM runs UNION ALL SELECT r, goal, a || ' ' || b FROM runs WHERE b IS NOT NULL UNION ALL SELECT r, goal, a || ' ' || b || ' ' || c FROM runs WHERE c IS NOT NULL),
hexed AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM features)),
crcs AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(h), 2), lambda k: ('0x' || substr(h, k, 2))::BIGINT)), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM hexed, tab),
placed AS (SELECT r, goal, bucket, count(*) AS n FROM features JOIN crcs USING (f) GROUP BY ALL),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (NOT goal), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (goal), 0)::DOUBLE AS t FROM placed GROUP BY 1),
totals AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM sums),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM sums, totals),
weighed AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM placed JOIN gains USING (bucket) WHERE NOT goal GROUP BY 1),
scored AS (SELECT doc_id, len(w) >= 20 AS part, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM numbered LEFT JOIN weighed USING (r) WHERE NOT goal),
ranked AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY score DESC, doc_id) AS place, count(*) FILTER (part) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN part AND place <= 5 * n // 100 THEN place END AS rank FROM ranked
"""
