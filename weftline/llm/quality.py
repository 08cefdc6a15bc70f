"""Quality classifier: a factorisation machine over hashed words, statistics of
structure and metadata (the text's own size).

    score = sigmoid(b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

The second sum is the sum-of-squares identity, so a text is scored in time
linear in its features. Labels are learned from a bounded sample of labelled
rows (SAMPLE_ROWS, spread evenly by a hash of the id); Spark extracts their
features, the small matrix is fitted on the driver. Every text is scored whole.

Null and empty texts have only the bias and the empty statistics, and get a
score too. Labels that are null are not learned from; without both labels the
model is constant: the share of ones, or 0.5. Ties and repeated rows need no
rule, since rows are independent.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import remainder, sampled, struct_array, table
from weftline.shipping import arrow_udf

#: Labelled rows that the fit uses at most.
SAMPLE_ROWS = 8_000
BUCKETS, FACTORS, EPOCHS, BATCH, RATE = 1 << 14, 8, 8, 128, 0.02
#: Scores from this one on predict label 1.
THRESHOLD = 0.3

_KIND = np.zeros(256, np.uint8)  # 0 other ASCII, 1 upper, 2 lower, 3 digit, 4 white space, 5 beyond ASCII, 6 sentence marks
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 5
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[[ord(c) for c in ".,;:'?-"]] = 6
STATISTICS = ("empty", "size", "words", "upper", "lower", "digit", "space", "beyond", "marks", "symbols", "odd_ends", "distinct", "repeats", "lone_symbols", "shouted", "worst_symbols", "worst_repeats", "length", "lines", "line_repeats", "common")
_SEGMENT = 40  # words


def _shares(flags: np.ndarray) -> tuple[float, float]:
    """Mean of the flags, and the highest mean of any segment of words."""
    if len(flags) == 0:
        return 0.0, 0.0
    starts = np.arange(0, max(1, len(flags) - _SEGMENT // 2), _SEGMENT)
    sums = np.add.reduceat(flags.astype(np.float64), starts)
    return float(flags.mean()), float((sums / np.diff(np.append(starts, len(flags)))).max())


def featurise(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the distinct words, and the statistics, each between 0 and about 1."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    stats = np.zeros(len(STATISTICS))
    if not n:
        stats[0] = 1
        return np.zeros(0, np.int64), stats
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=7) / len(raw)
    distinct = set(words)
    odd = {w: not (_KIND[w[-1]] in (1, 2, 3, 5, 6)) for w in distinct}
    odd_flags = np.fromiter(map(odd.__getitem__, words), bool, n)
    same = np.zeros(n, bool)
    same[1:] = np.fromiter(map(bytes.__eq__, words, words[1:]), bool, n - 1)
    odd_mean, odd_worst = _shares(odd_flags)
    same_mean, same_worst = _shares(same)
    lines = raw.split(b"\n")
    stats[1:] = (
        np.log1p(len(raw)) / 12,
        np.log1p(n) / 10,
        kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[0],
        odd_mean,
        len(distinct) / n,
        same_mean,
        sum(1 for w in words if len(w) == 1 and _KIND[w[0]] == 0) / n,
        sum(1 for w in distinct if w.isupper() and len(w) > 2) / len(distinct),
        odd_worst,
        same_worst,
        min(1.0, len(raw) / n / 20),
        np.log1p(len(lines)) / 8,
        1 - len(set(lines)) / len(lines),
        sum(1 for w in distinct if len(w) < 4) / len(distinct),
    )
    return np.unique(np.fromiter((zlib.crc32(w.lower()) % BUCKETS for w in distinct), np.int64, len(distinct))), stats


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def values(self, words: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices and values of a text's features; the words together have length 1."""
        x = np.empty(len(words) + len(stats))
        x[: len(words)] = 1 / np.sqrt(max(1, len(words)))
        x[len(words) :] = np.clip((stats - self.mean) / self.scale, -5, 5) / np.sqrt(len(stats))
        return np.concatenate([words, BUCKETS + np.arange(len(stats))]), x

    def score(self, text: str | None) -> float:
        i, x = self.values(*featurise(text))
        xv = x @ self.v[i]
        z = self.bias + x @ self.w[i] + 0.5 * float(xv @ xv - (x * x) @ (self.v[i] ** 2).sum(1))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> Machine:
    """Adagrad on the log loss, both labels with equal weight in all."""
    d = BUCKETS + len(STATISTICS)
    y = np.array([r[2] for r in rows], float)
    share = y.mean() if len(y) else 0.5
    stats = np.array([r[1] for r in rows]) if rows else np.zeros((1, len(STATISTICS)))
    scale = stats.std(0)
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(d), rng.normal(0, 0.05, (d, FACTORS)), stats.mean(0), np.where(scale > 1e-6, scale, 1.0))
    if share in (0.0, 1.0) or not rows:
        m.v[:] = 0
        m.bias = float(np.clip(np.log((share + 1e-3) / (1 - share + 1e-3)), -7, 7)) if rows else 0.0
        return m
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    each = [m.values(r[0], r[1]) for r in rows]
    gw, gv, gb = np.full(d, 1e-4), np.full((d, FACTORS), 1e-4), 1e-4
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            pick = order[at : at + BATCH]
            idx = np.concatenate([each[k][0] for k in pick])
            x = np.concatenate([each[k][1] for k in pick])
            starts = np.cumsum([0, *(len(each[k][0]) for k in pick[:-1])])
            row = np.repeat(np.arange(len(pick)), [len(each[k][0]) for k in pick])
            vx = m.v[idx] * x[:, None]
            s = np.add.reduceat(vx, starts)
            z = m.bias + np.add.reduceat(m.w[idx] * x, starts) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
            g = weight[pick] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)
            used, inverse = np.unique(idx, return_inverse=True)
            dw = np.bincount(inverse, g[row] * x, len(used)) + 1e-6 * m.w[used]
            dv = np.stack([np.bincount(inverse, g[row] * x * (s[row, f] - vx[:, f]), len(used)) for f in range(FACTORS)], 1) + 1e-6 * m.v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += g.sum() ** 2
            m.w[used] -= 10 * RATE * dw / np.sqrt(gw[used])
            m.v[used] -= RATE * dv / np.sqrt(gv[used])
            m.bias -= 5 * RATE * g.sum() / np.sqrt(gb)
    return m


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Machine:
    """Fits on at most about `sample_rows` of the labelled documents outside the held-out fold."""
    known = labels.filter(F.col("quality").isNotNull() & (remainder() != 0)).select("doc_id", "quality")
    n = known.count()
    part = min(1.0, sample_rows / max(1, n))
    chosen = known.filter(sampled(part, "doc_id"))

    @arrow_udf("words array<int>, stats array<double>")
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            got = [featurise(x.as_py()) for x in a]
            yield struct_array(words=pa.array([g[0] for g in got], pa.list_(pa.int32())), stats=pa.array([g[1] for g in got], pa.list_(pa.float64())))

    wanted = docs.filter(remainder() != 0).filter(sampled(part, "doc_id"))
    rows = wanted.select("doc_id", features("text").alias("f")).join(chosen, "doc_id").select("doc_id", "f.words", "f.stats", "quality").toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    return fit([(w.values.to_numpy().astype(np.int64), s.values.to_numpy(), int(q)) for w, s, q in zip(rows["words"], rows["stats"], rows["quality"].to_pylist())])


def quality_score(text: Column | str, machine: Machine) -> Column:
    """The machine's probability of label 1, between 0 and 1."""
    sc = SparkSession.active().sparkContext
    shared = sc.broadcast(machine)  # BUCKETS x FACTORS numbers, whatever the input

    @arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array([shared.value.score(x.as_py()) for x in a], pa.float64())

    return score(text)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = train(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", (remainder() == 0).alias("held_out"), quality_score("text", machine).alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
