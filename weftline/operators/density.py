"""Density clustering of runs of any size: the spanning tree of mutual reachability is found block by block.

The nearest points of each point, from all pairs of blocks, give its core distance and NEAR edges. The forest of these edges is
near the tree, and says of any two points it joins what the longest edge of their path is: with the points in the order of the
forest's merges, the longest gap between them. A longer edge than that is not in the tree. So the blocks, now in that order,
give from each of their pairs only the edges that are not longer; between parts that the forest does not join, those
not longer than the shortest of the two parts in the tile and than the parts' own edges. Of these, a pair of blocks keeps its own tree.
The tree of the run is that of the forest and of what is left.

All pairs are measured twice, as exact density needs. A pair of blocks keeps one matrix of TILE * TILE, or of NEAREST rows, at a time; a
run's own tasks keep NEAR edges a row, and the condensed tree of its rows.

Edges are ordered by their length and then by their ends, so that the tree does not depend on the blocks. Null and zero vectors are noise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.clustering import MIN_SAMPLES, density_size, tree_labels
from weftline.operators.storage import stored
from weftline.operators.vectors import _unit
from weftline.shipping import ship

#: Rows of a block, of a side of a matrix within it, and rows whose nearest points are looked for at a time.
BLOCK, TILE, NEAREST = 8_192, 1_024, 256
#: Edges of each point to its nearest ones.
NEAR = 8


def _paired(sized: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """sized (run, part, parts) for each pair of blocks (lower <= upper) of their run, as its lower and as its upper block."""
    left = sized.select("run", *columns, F.col("part").alias("lower"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("upper"))
    right = sized.select(*(F.col(c).alias(c) for c in ("run", *columns)), F.explode(F.sequence(F.lit(0), "part")).alias("lower"), F.col("part").alias("upper"))
    return left, right


def _lengths(s: np.ndarray) -> np.ndarray:
    return np.maximum(0, np.round(1 - s, 12))


def _best(s: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` largest of each row, in no order. What is under the largest of each eighth column is not looked at; with many equal ones all are."""
    n = s.shape[1]
    if most >= n:
        return np.tile(np.arange(n), (len(s), 1))
    if n // 8 > most:
        some = s[:, ::8]
        row, at = np.nonzero(s >= np.partition(some, some.shape[1] - most, 1)[:, some.shape[1] - most, None])
        if len(row) <= 64 * most * len(s):
            order = np.lexsort((-s[row, at], row))
            return at[order][np.searchsorted(row, np.arange(len(s)))[:, None] + np.arange(most)]
    return np.argpartition(s, n - most, 1)[:, n - most :]


def _nearest(x: np.ndarray, y: np.ndarray, most: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places in y and distances of the `most` nearest rows of each row of x, itself left out; in no order."""
    most = min(most, len(y) - same)
    at, far = [np.zeros((0, max(0, most)), np.int64)], [np.zeros((0, max(0, most)))]
    for k in range(0, len(x) if most > 0 else 0, NEAREST):
        s = x[k : k + NEAREST] @ y.T
        if same:
            s[np.arange(len(s)), np.arange(k, k + len(s))] = -np.inf
        best = _best(s, most)
        at.append(best)
        far.append(_lengths(np.take_along_axis(s, best, 1)))
    return np.concatenate(at), np.concatenate(far)


def spanning(a: np.ndarray, b: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Places of the edges of the minimum spanning tree of points 0 to n - 1; ties by the ends. Rounds in which each part takes its shortest way out."""
    order = np.lexsort((b, a, length))
    a, b = a[order], b[order]
    of = np.arange(n)
    taken = np.zeros(len(a), bool)
    live = np.arange(len(a))
    while len(live):
        x, y = of[a[live]], of[b[live]]
        live, x, y = live[x != y], x[x != y], y[x != y]
        if not len(live):
            break
        first = np.full(n, len(a))
        np.minimum.at(first, x, live)
        np.minimum.at(first, y, live)
        chosen = np.unique(first[first < len(a)])
        taken[chosen] = True
        # parts that a chosen edge joins become one: each points at the least it can reach
        u, v = of[a[chosen]], of[b[chosen]]
        to = np.arange(n)
        while True:
            before = to.copy()
            low = np.minimum(to[u], to[v])
            np.minimum.at(to, to[u].copy(), low)
            np.minimum.at(to, to[v].copy(), low)
            to = to[to]
            if (to == before).all():
                break
        of = to[of]
    return order[taken]


def merged(a: np.ndarray, b: np.ndarray, length: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """order, gap, edge, part: the points in the order of a forest's merges; for each place the longest edge between its point and the next
    place's, that edge's place (-1: another part of the forest follows) and the part. Between two places, the path's longest edge is the longest gap."""
    root, size, tail, after = list(range(n)), [1] * n, list(range(n)), [-1] * n
    edge = [-1] * n

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k in np.argsort(length, kind="stable").tolist():
        p, q = find(int(a[k])), find(int(b[k]))
        if size[p] < size[q]:
            p, q = q, p
        # a root is its part's first point
        root[q], after[tail[p]], edge[tail[p]] = p, q, k
        tail[p] = tail[q]
        size[p] += size[q]
    order, part = [], []
    for r in (x for x in range(n) if root[x] == x):
        x = r
        while x >= 0:
            order.append(x)
            part.append(r)
            x = after[x]
    at = np.array([edge[x] for x in order], np.int64)
    gap = np.full(n, np.inf)
    gap[at >= 0] = length[at[at >= 0]]
    return np.array(order, np.int64), gap, at, np.array(part, np.int64)


class _Side:
    """A block's rows in the order of the forest's merges."""

    def __init__(self, rows: pa.Table):
        rows = rows.take(pa.array(np.argsort(rows["pos"].to_numpy(), kind="stable")))
        self.v = _unit(rows["v"])
        self.core, self.gap, self.top, self.part, self.rank = (rows[c].to_numpy() for c in ("core", "gap", "top", "tree", "rank"))
        self.blocks = np.array(rows["blocks"][0].as_py())


def _wanted(x: _Side, y: _Side, i: slice, j: slice, bound: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, length) of a tile's edges that the tree may have, a and b as ranks."""
    s = x.v[i] @ y.v[j].T
    apart = np.isinf(bound)
    if not same and not apart.any():
        at, to = np.nonzero(s >= 1 - 1e-11 - bound)  # only what may fit is rounded
        w = np.maximum(_lengths(s[at, to]), np.maximum(x.core[i][at], y.core[j][to]))
        fits = w <= bound[at, to]
        a, b = x.rank[i][at[fits]], y.rank[j][to[fits]]
        return np.minimum(a, b), np.maximum(a, b), w[fits]
    w = np.maximum(_lengths(s), np.maximum(x.core[i][:, None], y.core[j]))
    if same:
        w[np.tril_indices(len(w))] = np.inf
    if apart.any():
        new = [np.flatnonzero(np.diff(t, prepend=-1)) for t in (x.part[i], y.part[j])]
        least = np.minimum.reduceat(np.minimum.reduceat(w, new[0], 0), new[1], 1)
        least = np.maximum(least, np.maximum(x.top[i][new[0]][:, None], y.top[j][new[1]]))
        of = [np.repeat(np.arange(len(m)), np.diff(m, append=len(t))) for m, t in zip(new, (x.part[i], y.part[j]))]
        bound = np.where(apart, least[of[0]][:, of[1]], bound)
    at, to = np.nonzero((w <= bound) & (w < np.inf))
    a, b = x.rank[i][at], y.rank[j][to]
    return np.minimum(a, b), np.maximum(a, b), w[at, to]


def _tree(a: np.ndarray, b: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    names, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    at = spanning(ends[: len(a)], ends[len(a) :], length, len(names))
    return a[at], b[at], length[at]


def pair_edges(x: _Side, y: _Side, lower: int, upper: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, length) of the edges between two blocks, or within one, that the run's tree may have."""
    same, got = lower == upper, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    suffix = lambda g: np.maximum.accumulate(g[::-1])[::-1]
    prefix = lambda g: np.maximum.accumulate(np.concatenate(([0.0], g[:-1])))
    middle = 0.0 if same else x.blocks[lower + 1 : upper].max(initial=0.0)
    for i in range(0, len(x.core), tile):
        si = slice(i, i + tile)
        for j in range(i if same else 0, len(y.core), tile):
            sj = slice(j, j + tile)
            if same and i == j:
                g = prefix(y.gap[sj])
                inside = np.broadcast_to(np.concatenate(([0.0], y.gap[sj][:-1])), (len(g), len(g)))
                bound = np.maximum.accumulate(np.triu(inside, 1), 1)
            else:
                left = suffix(x.gap[i:j] if same else x.gap[i:])[: len(x.core[si])]
                right = prefix(y.gap[j : j + tile]) if same else prefix(y.gap[: j + tile])[j:]
                bound = np.maximum(left[:, None], np.maximum(middle, right))
            some = _wanted(x, y, si, sj, bound, same and i == j)
            got = tuple(np.concatenate(z) for z in zip(got, some))
            if len(got[0]) > 4 * (len(x.core) + len(y.core)):
                got = _tree(*got)
    return _tree(*got)


def density_labels(df: DataFrame, run: str, key: str = "id", vector: str = "v", size: int | None = None, min_samples: int = MIN_SAMPLES, block: int = BLOCK, most: int = NEAR) -> DataFrame:
    """run, key, label of every row: clusters of each run numbered by their first keys, -1 for noise. size is the least of a cluster, by default density_size of the run's rows."""
    ship(df.sparkSession)
    usable = F.col(vector).isNotNull() & F.exists(vector, lambda x: x != 0)
    rows = stored(df.filter(usable).select(F.col(run).alias("run"), F.col(key).alias("id"), F.col(vector).alias("v")), "points")
    sizes = rows.groupBy("run").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("run", "id")}
    most = max(most, min_samples)
    dealt = rows.join(sizes, "run").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    left, right = _paired(dealt, ["id", "v"])

    def near(key_: tuple, one: pa.Table, two: pa.Table) -> pa.Table:
        same = key_[1].as_py() == key_[2].as_py()
        ids, others, far, ends = [], [], [np.zeros(0)], [np.zeros(1, np.int64)]
        kind = one.schema.field("id").type
        if len(one) and len(two):
            two = one if same else two
            x, y = _unit(one["v"]), _unit(two["v"])
            for (p, v), (q, u) in (((one, x), (two, y)), ((two, y), (one, x)))[: 1 if same else 2]:
                at, d = _nearest(v, u, most, same)
                ids.append(p["id"].combine_chunks())
                others.append(q["id"].combine_chunks().take(pa.array(at.ravel())))
                far.append(d.ravel())
                ends.append(ends[-1][-1] + np.arange(1, len(v) + 1) * d.shape[1])
        names = pa.concat_arrays(ids) if ids else pa.array([], kind)
        each = pa.StructArray.from_arrays([pa.array(np.concatenate(far)), pa.concat_arrays(others) if others else pa.array([], kind)], names=["d", "id"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), each)
        return pa.table({"run": pa.array([key_[0].as_py()] * len(names), one.schema.field("run").type), "id": names, "near": lists})

    pairs = ("run", "lower", "upper")
    told = left.groupBy(*pairs).cogroup(right.groupBy(*pairs)).applyInArrow(near, f"run {kinds['run']}, id {kinds['id']}, near array<struct<d: double, id: {kinds['id']}>>")
    # a few edges from each pair of a row's block
    nearest = told.groupBy("run", "id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, most).alias("n"))
    core = F.coalesce(F.try_element_at(F.slice("n", 1, min_samples), F.lit(-1))["d"], F.lit(0.0))
    nearest = stored(nearest.select("run", "id", core.alias("core"), "n"), "cores")

    def head(key_: tuple, rows_: pa.Table) -> pa.Table:
        names = rows_["id"].to_pylist()
        n = len(names)
        by = sorted(range(n), key=names.__getitem__)
        rank = np.empty(n, np.int64)
        rank[by] = np.arange(n)
        place = dict(zip(names, rank.tolist()))
        cores = np.empty(n)
        cores[rank] = rows_["core"].to_numpy()
        lists = rows_["n"].combine_chunks()
        flat = lists.flatten()
        a = np.repeat(rank, np.diff(lists.offsets.to_numpy()))
        b = np.array([place[x] for x in flat.field("id").to_pylist()], np.int64)
        length = np.maximum(flat.field("d").to_numpy(), np.maximum(cores[a], cores[b]))
        a, b = np.minimum(a, b), np.maximum(a, b)
        at = spanning(a, b, length, n)
        a, b, length = a[at], b[at], length[at]
        order, gap, edge, tree = merged(a, b, length, n)
        top = np.zeros(n)
        np.maximum.at(top, tree, np.where(np.isinf(gap), 0, gap))
        blocks = np.maximum.reduceat(gap, np.arange(0, n, block)).tolist()
        none = np.full(n, -1)
        none[edge >= 0] = a[edge[edge >= 0]]
        upper = np.full(n, -1)
        upper[edge >= 0] = b[edge[edge >= 0]]
        ids = rows_["id"].combine_chunks().take(pa.array(np.array(by, np.int64)[order]))
        return pa.table(
            {
                "run": pa.array([key_[0].as_py()] * n, rows_.schema.field("run").type), "id": ids, "rank": order, "pos": np.arange(n), "core": cores[order], "gap": gap, "tree": tree, "top": top[tree],
                "a": none, "b": upper, "blocks": pa.array([blocks if k % block == 0 else None for k in range(n)], pa.list_(pa.float64())),
            }
        )

    forest = stored(nearest.groupBy("run").applyInArrow(head, f"run {kinds['run']}, id {kinds['id']}, rank long, pos long, core double, gap double, tree long, top double, a long, b long, blocks array<double>"), "forest")
    placed = rows.join(forest, ["run", "id"]).join(sizes, "run").withColumn("part", F.floor(F.col("pos") / block).cast("int"))
    left, right = _paired(placed, ["v", "rank", "pos", "core", "gap", "tree", "top", "blocks"])

    def tree(key_: tuple, one: pa.Table, two: pa.Table) -> pa.Table:
        lower, upper = key_[1].as_py(), key_[2].as_py()
        x = _Side(one)
        a, b, length = pair_edges(x, x if lower == upper else _Side(two), lower, upper)
        return pa.table({"run": pa.array([key_[0].as_py()] * len(a), one.schema.field("run").type), "a": a, "b": b, "length": length})

    more = left.groupBy(*pairs).cogroup(right.groupBy(*pairs)).applyInArrow(tree, f"run {kinds['run']}, a long, b long, length double")
    edges = more.unionByName(forest.filter("a >= 0").select("run", "a", "b", F.col("gap").alias("length")))

    def label(key_: tuple, ids: pa.Table, edges: pa.Table) -> pa.Table:
        names = sorted(ids["id"].to_pylist())
        n = len(names)
        least = density_size(n) if size is None else size
        labels = np.full(n, -1)
        if n >= max(2, least):
            a, b, length = (edges[c].to_numpy() for c in ("a", "b", "length"))
            at = spanning(a, b, length, n)
            labels = tree_labels(n, list(zip(length[at].tolist(), a[at].tolist(), b[at].tolist())), least)
        return pa.table({run: pa.array([key_[0].as_py()] * n, ids.schema.field("run").type), key: pa.array(names, ids.schema.field("id").type), "label": pa.array(labels, pa.int64())})

    found = rows.select(F.col("run").alias("run"), F.col("id").alias("id")).groupBy("run").cogroup(edges.groupBy("run")).applyInArrow(label, f"`{run}` {kinds['run']}, `{key}` {kinds['id']}, label long")
    rest = df.filter(~F.coalesce(usable, F.lit(False))).select(run, key, F.lit(-1).cast("long").alias("label"))
    return found.unionByName(rest)
