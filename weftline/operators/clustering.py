"""Clusters of one run's comments: density clustering, k-means, the gate on themes, and cluster rows.

A run holds at most some thousand comments, so a run's vectors are one group's load; all steps that
count or rank are DataFrame aggregates over all runs at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.shipping import ship

# Sizes and shares that decide about themes.
FEWEST, THEME_SIZE, THEMES_KEPT, NOISE_SHARE, SPLIT_AT = 12, 3, 2, 0.15, 20
SIZE_FLOOR, SIZE_CEILING, SIZE_RETRY, MIN_SAMPLES, MOST_CLUSTERS = 3, 8, 2, 2, 5
STORED_IDS, SHOWN_TEXTS, SHOWN_CHARS = 5, 3, 120
#: Comments whose cosine is over this say the same.
ALIKE = 0.95


def kmeans_k(n: Column, most: int = MOST_CLUSTERS) -> Column:
    return F.greatest(F.lit(2), F.least(F.lit(most), F.bround(n / 10, 0).cast("int")))


def density_size(n: int) -> int:
    """The least size of a density cluster for n points; halves round to even."""
    return max(SIZE_FLOOR, min(SIZE_CEILING, round(n / 20)))


def kmeans(rows: DataFrame, k: int, vector: str = "v", seed: int = 0) -> DataFrame:
    """rows with label."""
    ready = rows.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="label", maxIter=30).fit(ready).transform(ready).drop("_v")


def local_tree(reach: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, length) of the minimum spanning tree of points with these pairwise lengths; a < b, ties by the ends' ids."""
    n = len(ids)
    free = np.ones(n, bool)
    free[0] = False
    best, parent = reach[0].copy(), np.zeros(n, np.int64)
    low, high = np.minimum(ids, ids[0]), np.maximum(ids, ids[0])
    out = []
    for _ in range(n - 1):
        some = np.flatnonzero(free)
        near = some[best[some] == best[some].min()]
        j = near[np.lexsort((high[near], low[near]))[0]] if len(near) > 1 else near[0]
        out.append((parent[j], j))
        free[j] = False
        lo, hi = np.minimum(ids, ids[j]), np.maximum(ids, ids[j])
        nearer = free & ((reach[j] < best) | ((reach[j] == best) & ((lo < low) | ((lo == low) & (hi < high)))))
        best[nearer], parent[nearer], low[nearer], high[nearer] = reach[j][nearer], j, lo[nearer], hi[nearer]
    a, b = np.array(out, np.int64).reshape(-1, 2).T
    return np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b]), reach[a, b]


def hdbscan(x: np.ndarray, size: int, min_samples: int = MIN_SAMPLES) -> np.ndarray:
    """Labels of unit vectors, -1 for noise: spanning tree of mutual reachability, condensed by `size`, clusters by excess of mass."""
    n = len(x)
    if n < max(2, size):
        return np.full(n, -1)
    d = np.maximum(0, np.round(1 - x @ x.T, 12))
    core = np.partition(d, min(min_samples, n - 1), 1)[:, min(min_samples, n - 1)]
    a, b, length = local_tree(np.maximum(d, np.maximum(core[:, None], core)), np.arange(n))
    return tree_labels(n, list(zip(length.tolist(), a.tolist(), b.tolist())), size)


def tree_labels(n: int, edges: list[tuple[float, int, int]], size: int) -> np.ndarray:
    """Labels of the points of a spanning tree, -1 for noise: merges from the closest, condensed by `size`, clusters by excess of mass.

    Merges of one length are one merge of several parts, so the labels do not depend on which of several shortest trees it is.
    """
    root = list(range(2 * n - 1))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    children: dict[int, list[int]] = {}
    height, count = {}, dict.fromkeys(range(n), 1)
    for k, (w, a, b) in enumerate(sorted(edges)):
        p, q, new = find(a), find(b), n + k
        root[p] = root[q] = new
        parts, more = (children.pop(s) if height.get(s) == w else [s] for s in (p, q))
        if len(parts) < len(more):
            parts, more = more, parts
        parts.extend(more)
        children[new], height[new], count[new] = parts, w, count[p] + count[q]

    def points(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            a = todo.pop()
            if a < n:
                out.append(a)
            else:
                todo += children[a]
        return out

    # condensed clusters: a split counts only where both sides have the size
    clusters: list[dict] = []
    todo: list[tuple[int, int, float]] = [(2 * n - 2, -1, 0.0)]
    while todo:
        node, above, birth = todo.pop()
        c = {"parent": above, "members": points(node), "mass": 0.0, "kids": []}
        clusters.append(c)
        me = len(clusters) - 1
        if above >= 0:
            clusters[above]["kids"].append(me)
        while node >= n:
            lam = 1 / max(height[node], 1e-12)
            big = [s for s in children[node] if count[s] >= size]
            if len(big) > 1:
                c["mass"] += count[node] * (lam - birth)
                todo += [(s, me, lam) for s in big]
                break
            c["mass"] += sum(count[s] for s in children[node] if count[s] < size) * (lam - birth)
            if not big:
                break
            node = big[0]
    chosen = [False] * len(clusters)
    for i in reversed(range(len(clusters))):
        c = clusters[i]
        below = sum(clusters[k]["mass"] for k in c["kids"])
        if i and (not c["kids"] or c["mass"] >= below):
            chosen[i] = True
            stack = list(c["kids"])
            while stack:
                k = stack.pop()
                chosen[k] = False
                stack += clusters[k]["kids"]
        elif c["kids"]:
            c["mass"] = max(c["mass"], below) if i == 0 else below
    labels = np.full(n, -1)
    order = sorted((i for i, yes in enumerate(chosen) if yes), key=lambda i: min(clusters[i]["members"]))
    for k, i in enumerate(order):
        labels[clusters[i]["members"]] = k
    return labels


def split(x: np.ndarray, k: int, seed: int = 0, starts: int = 10, rounds: int = 300) -> np.ndarray:
    """k-means labels of unit vectors, the best of several seeded starts; numbered by their first members."""
    k = max(1, min(k, len(x)))
    rng = np.random.default_rng(seed)
    best, least = np.zeros(len(x), int), np.inf
    for _ in range(starts if k > 1 else 0):
        centre = x[[rng.integers(len(x))]]
        while len(centre) < k:
            far = ((x[:, None] - centre[None]) ** 2).sum(2).min(1)
            centre = np.vstack([centre, x[rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else len(centre)]])
        label = None
        for _ in range(rounds):
            d = ((x[:, None] - centre[None]) ** 2).sum(2)
            new = d.argmin(1)
            if label is not None and (new == label).all():
                break
            label = new
            for j in range(k):
                mine = label == j
                centre[j] = x[mine].mean(0) if mine.any() else x[d.min(1).argmax()]
        cost = d.min(1).sum()
        if cost < least - 1e-12:
            best, least = label, cost
    first = {}
    return np.array([first.setdefault(j, len(first)) for j in best.tolist()], int)


def alike(x: np.ndarray, likes: np.ndarray, block: int = 256) -> np.ndarray:
    """The representative of each row: of those that a chain of cosines over ALIKE links, the most liked, then the first."""
    of = np.full(len(x), -1)
    for i in range(len(x)):
        if of[i] >= 0:
            continue
        of[i] = i
        group, todo = [i], [i]
        while todo:
            near = np.flatnonzero((x[todo[:block]] @ x.T > ALIKE).any(0) & (of < 0))
            of[near] = i
            group += near.tolist()
            todo = todo[block:] + near.tolist()
        of[group] = min(group, key=lambda j: (-likes[j], j))
    return of


def themes_of(x: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, str]:
    """Labels and method: density clustering, once more with a smaller size if it finds no theme; k-means if there is still none,
    if a run of SPLIT_AT comments has a single one, or if clusters were too small for themes and fewer than THEMES_KEPT stay.

    raw holds how many comments each row stands for; a theme has THEME_SIZE comments.
    """
    k = max(2, min(MOST_CLUSTERS, round(len(x) / 10)))

    def gate(label: np.ndarray) -> tuple[np.ndarray, int, bool]:
        sizes = np.bincount(label[label >= 0], weights=raw[label >= 0], minlength=1)
        kept = np.where((label >= 0) & (sizes[np.maximum(label, 0)] < THEME_SIZE), -1, label)
        return kept, int((sizes >= THEME_SIZE).sum()), bool((kept != label).any())

    label, themes, demoted = gate(hdbscan(x, density_size(len(x))))
    if themes == 0:
        label, themes, demoted = gate(hdbscan(x, SIZE_RETRY))
        again = themes == 0
    else:
        again = themes == 1 and raw.sum() >= SPLIT_AT
    if again or (demoted and themes < THEMES_KEPT):
        return gate(split(x, k))[0], "kmeans"
    return label, "hdbscan"


def density_labels(rows: DataFrame, by: str, key: str = "id", vector: str = "v", likes: str | None = None) -> DataFrame:
    """by, key, label, method, is_survivor of each run's rows: one cluster under FEWEST rows, else themes_of() the rows that stand for those alike.

    Rows alike have the label of the one that stands for them, which is_survivor marks. The labels are those of themes, -1 is noise.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x = np.array(pdf[vector].tolist(), float)
        x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
        stands = np.arange(len(x))
        if len(x) < FEWEST:
            label, method = np.zeros(len(x), int), "none"
        else:
            stands = alike(x, np.zeros(len(x)) if likes is None else pdf[likes].fillna(0).to_numpy(float))
            kept, of, raw = np.unique(stands, return_inverse=True, return_counts=True)
            label, method = themes_of(x[kept], raw)
            label = label[of]
        return pd.DataFrame({by: pdf[by], key: pdf[key], "label": label, "method": method, "is_survivor": stands == np.arange(len(x))})

    ship(rows.sparkSession)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (by, key)}
    return rows.select(by, key, vector, *([likes] if likes else [])).groupBy(by).applyInPandas(fit, f"{by} {kinds[by]}, {key} {kinds[key]}, label int, method string, is_survivor boolean")


def theme_gate(labels: DataFrame, by: Sequence[str] = ("run_id",), raw: str = "raw_count") -> DataFrame:
    """labels with those of clusters of fewer than THEME_SIZE comments, duplicates counted, turned to -1, and what each row's was before."""
    sizes = labels.groupBy(*by, "label").agg(F.sum(raw).alias("_n"))
    return labels.join(sizes, [*by, "label"]).withColumn("was", F.col("label")).withColumn("label", F.when((F.col("label") >= 0) & (F.col("_n") < THEME_SIZE), -1).otherwise(F.col("label"))).drop("_n")


def theme_count(labels: DataFrame, by: Sequence[str] = ("run_id",), raw: str = "raw_count") -> DataFrame:
    sizes = labels.filter("label >= 0").groupBy(*by, "label").agg(F.sum(raw).alias("n")).filter(F.col("n") >= THEME_SIZE)
    return sizes.groupBy(*by).agg(F.count("*").alias("themes"))


def cluster_rows(members: DataFrame, by: Sequence[str] = ("run_id",), key: str = "id", likes: str = "likes", text: str = "text", most: int = MOST_CLUSTERS) -> DataFrame:
    """A row for each cluster: cluster_key, order_index, size (without duplicates), raw_size, is_noise, ids and texts of its most liked comments.

    members has (by, key, label, is_survivor, likes, text). Larger clusters first; beyond `most` they join the tail;
    noise has a row only if it is more than NOISE_SHARE of the run.
    """
    counted = members.groupBy(*by, "label").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy(*by, F.col("label") >= 0).orderBy(F.desc("n"), "label"))
    total = F.sum("n").over(W.partitionBy(*by))
    name = F.when(F.col("label") < 0, "noise").when(F.col("_r") > most, "tail").otherwise(F.concat(F.lit("c"), "label"))
    named = counted.withColumn("_r", rank).withColumn("_share", F.col("n") / total).withColumn("cluster_key", name).filter((F.col("label") >= 0) | (F.col("_share") > NOISE_SHARE))
    place = F.when(F.col("cluster_key") == "noise", 1_000_001).when(F.col("cluster_key") == "tail", 1_000_000).otherwise(F.col("_r"))
    each = members.join(named.select(*by, "label", "cluster_key", place.alias("_p")), [*by, "label"])
    top = F.row_number().over(W.partitionBy(*by, "cluster_key").orderBy(F.desc(likes), key))
    each = each.withColumn("_top", top)
    listed = lambda c, n: F.transform(F.array_sort(F.collect_list(F.when(F.col("_top") <= n, F.struct("_top", c.alias("x"))))), lambda s: s["x"])
    rows = each.groupBy(*by, "cluster_key").agg(
        F.min("_p").alias("_p"),
        F.sum(F.col("is_survivor").cast("int")).alias("size"),
        F.count("*").alias("raw_size"),
        listed(F.col(key), STORED_IDS).alias("representative_ids"),
        listed(F.substring(text, 1, SHOWN_CHARS), SHOWN_TEXTS).alias("representatives"),
    )
    return rows.withColumn("order_index", F.row_number().over(W.partitionBy(*by).orderBy("_p")) - 1).withColumn("is_noise", F.col("cluster_key") == "noise").drop("_p")
