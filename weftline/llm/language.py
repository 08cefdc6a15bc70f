"""Language ID by multilingual mixture inference.

Each language has a smoothed distribution over hashed character trigrams,
counted by Spark over a bounded sample of labelled documents (SAMPLE_ROWS).
A document is a mixture of languages: expectation-maximisation estimates its
proportions from the trigram likelihoods, and a penalised likelihood picks the
set of languages, dropping one at a time while that raises
log-likelihood - PENALTY * (languages) * log(trigrams) / 2.
The prediction is the language with the largest share; the score is that share,
shrunk for short texts. Every text is read whole.

Null texts and texts without a letter are `und` with score 0. With no learned
language every text is `und`. Equal shares go to the first name in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import remainder, struct_array, table
from weftline.shipping import arrow_udf, ship

#: Labelled documents that the model learns from at most.
SAMPLE_ROWS = 20_000
BUCKETS, SMOOTH, PENALTY, ROUNDS, SETTLED = 1 << 16, 0.5, 3.0, 25, 1e-3
UNKNOWN = "und"
#: Shares under this are not enough for a document to count as written in a language.
LEAST_SHARE = 0.35


@lru_cache(1)
def _letters() -> np.ndarray:
    """The lower-cased code point of each letter, and the space's for everything else."""
    return np.fromiter((c if chr(c).isalpha() else 32 for c in range(0x110000)), np.uint64, 0x110000)


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the trigrams of the lower-cased letters, with one space for all that lies between words."""
    code = _letters()[np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)]
    gap = code == 32
    code = code[np.concatenate(([True], ~(gap[1:] & gap[:-1])))]
    if len(code) < 3:
        return np.zeros(0, np.int64), np.zeros(0)
    h = code[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ code[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ code[2:] * np.uint64(0x165667B19E3779F9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    b, n = np.unique((h >> np.uint64(48)).astype(np.int64), return_counts=True)
    return b, n.astype(float)


@dataclass
class Languages:
    names: list[str]
    p: np.ndarray  # probability, languages x buckets

    def mixture(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The share of each language."""
        p = self.p[:, buckets]
        part = counts / counts.sum()

        def em(use: list[int], share: np.ndarray) -> tuple[np.ndarray, float]:
            q = p[use]
            for _ in range(ROUNDS if len(use) > 1 else 0):
                new = share * (q @ (part / (share @ q)))
                moved = abs(new - share).max()
                share = new
                if moved < SETTLED:
                    break
            return share, float(counts @ np.log(share @ q))

        alive = list(range(len(self.names)))
        share, best = em(alive, np.full(len(alive), 1 / len(alive)))
        cost = PENALTY * np.log(max(2.0, counts.sum())) / 2
        while len(alive) > 1:
            k = int(share.argmin())
            rest, start = alive[:k] + alive[k + 1 :], np.append(share[:k], share[k + 1 :]) + 1e-9
            new, here = em(rest, start / start.sum())
            if here + cost < best:
                break
            alive, share, best = rest, new, here
        out = np.zeros(len(self.names))
        out[alive] = share
        return out

    def predict(self, text: str | None) -> tuple[str, float, list[float]]:
        b, n = trigrams(text or "")
        if not len(b) or not self.names:
            return UNKNOWN, 0.0, [0.0] * len(self.names)
        share = self.mixture(b, n)
        k = int(np.argmax(np.round(share, 9)))
        return self.names[k], float(min(1.0, share[k]) * n.sum() / (n.sum() + 1)), share.tolist()


def train(docs: DataFrame, lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Languages:
    """Counts over at most about `sample_rows` documents outside the held-out fold that have a language.

    Every language has an equal bound; those with fewer documents have all of them and leave the rest to the others.
    """
    ship(docs.sparkSession)
    known = docs.filter(F.col(lang).isNotNull() & F.col("text").isNotNull() & (remainder() != 0))
    sizes = sorted(known.groupBy(F.col(lang).alias("lang")).count().collect(), key=lambda r: r["count"])
    left, bound = sample_rows, 1.0
    for k, r in enumerate(sizes):
        bound = max(1.0, left / (len(sizes) - k))
        left -= min(r["count"], bound)
    whole = F.lit(True)
    if sizes and sizes[-1]["count"] > bound:
        parts = {r["lang"]: bound / r["count"] for r in sizes if r["count"] > bound}
        part = F.create_map(*(F.lit(x) for pair in parts.items() for x in pair))[F.col(lang)]
        # the share of all hashes, as in sampled(), with a share for each language
        whole = part.isNull() | (F.xxhash64("doc_id") <= (part * F.lit(2.0**64) - F.lit(2.0**63)).cast("long"))
    chosen = known.filter(whole).select(F.col(lang).alias("lang"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, text in zip(batch["lang"].to_pylist(), batch["text"]):
                b, n = trigrams(text.as_py())
                totals.setdefault(name, np.zeros(BUCKETS))[b] += n
        for name, t in totals.items():
            b = np.flatnonzero(t)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(b), pa.string()), "bucket": pa.array(b.astype(np.int32)), "n": pa.array(t[b])})

    rows = chosen.mapInArrow(count, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(rows["lang"].to_pylist()))
    counts = np.full((len(names), BUCKETS), SMOOTH)
    where = {x: k for k, x in enumerate(names)}
    if names:
        counts[[where[x] for x in rows["lang"].to_pylist()], rows["bucket"].to_numpy()] += rows["n"].to_numpy()
    return Languages(names, counts / counts.sum(1, keepdims=True))


def language(text: Column | str, model: Languages) -> Column:
    """struct<lang_pred, score, shares>; shares are in the order of the model's names."""
    shared = SparkSession.active().sparkContext.broadcast(model)  # languages x BUCKETS numbers, whatever the input

    @arrow_udf("lang_pred string, score double, shares array<double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            got = [shared.value.predict(x.as_py()) for x in a]
            yield struct_array(lang_pred=pa.array([g[0] for g in got], pa.string()), score=pa.array([g[1] for g in got], pa.float64()), shares=pa.array([g[2] for g in got], pa.list_(pa.float64())))

    return predict(text)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    return docs.select("doc_id", (remainder() == 0).alias("held_out"), language("text", model).alias("l")).select("doc_id", "held_out", "l.lang_pred", "l.score")
