"""The most similar vectors of every vector, by a forest of random-projection trees.

The forest is fitted on a bounded sample: each node of a tree projects on the difference of two
random sample vectors and splits in the widest gap near the median of the sample's projections, so
that cells stay balanced whatever the density. Below the depth that the sample can resolve, cells are
split on by random directions at the median of their own sample, so leaves stay small however many
vectors there are. A vector descends to its leaf in the first tree; from every node on its way the
other side goes into a queue that all trees share, with the margin to the split as its priority, and
so do the other trees, with the vector's least margin in the first. The queue is emptied down to a
priority fitted on the sample, each entry descending to a leaf and adding the other sides on its way.
All vectors that come to a leaf, by whatever way, are candidates of each other, ranked by their exact
cosine. search_exact compares given vectors with all rows, in blocks, without an index.

Vectors of one direction form a class. A class is searched once, and keeps the first few of its
members, so that groups of copies of any size neither fill a cell nor hide other neighbours. Copies
of another length differ in the last bits and are classes of their own with a cosine of 1 to each
other; equal cosines, these too, are taken in order of the node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweave.session import cut

#: Rows of the sample that the forest is fitted on, at most.
SAMPLE_ROWS = 40_000
#: Trees, leaves a search takes from the shared queue besides its own on average (and more for each level, as each
#: splits neighbours, and for each beyond the sample's resolution, as it does so blindly), and which part of them is ways into other trees.
TREES = 2
EXTRA_LEAVES = 0.5
EXTRA_A_LEVEL = 0.05
EXTRA_UNFITTED = 0.5
OTHER_TREES = 0.2
#: Vectors a leaf holds, about.
LEAF_ROWS = 4_000
#: Rows of the table for each partition of the leaves' shuffle: their number grows with the table, their size doesn't.
PARTITION_ROWS = 4_000
#: Times a random direction is multiplied by the local covariance, which turns it to where the vectors spread most.
SHARPEN = 2
#: Vectors that descend at once.
BLOCK_ROWS = 8_192
#: Times its size from which a leaf is searched through a forest of its own.
OVERFULL = 3
#: Nodes with changed vectors that may be broadcast; more are joined by a shuffle.
MOVED_BROADCAST = 200_000
#: Candidates of a search, times k + 1, from which cosines to all members are taken at once; step in which near copies are found in an overfull leaf.
MANY = 4
COPY = 1e-4
#: Directions tried at a node, and the middle part of the projections in which it may split.
TRIES = 6
MIDDLE = 0.15


@dataclass
class Tree:
    """Nodes level by level: normals (2**depth - 1, dim) and offsets; below, one direction a level for all cells with an offset a cell.

    A path is the sides taken so far as bits. Levels 0 to depth - 1 are fitted nodes, those from depth on are beyond the sample's resolution.
    """

    depth: int
    normals: np.ndarray
    offsets: np.ndarray
    deeper: np.ndarray  # (levels, dim)
    cell_offsets: np.ndarray  # (2**depth, levels)

    @property
    def levels(self) -> int:
        return self.depth + len(self.deeper)

    def margin(self, x: np.ndarray, level: int, path: np.ndarray) -> np.ndarray:
        """The margin of each vector at its node of a level; the side is 1 where it is over 0."""
        if level < self.depth:
            node = 2**level - 1 + path
            return np.einsum("ij,ij->i", x, self.normals[node]) - self.offsets[node]
        below = level - self.depth
        return x @ self.deeper[below] - self.cell_offsets[path >> below, below]


def fit_tree(sample: np.ndarray, depth: int, rng: np.random.Generator, deeper: int = 0) -> Tree:
    n_nodes = 2**depth - 1
    normals = np.zeros((n_nodes, sample.shape[1]), dtype=np.float32)
    offsets = np.zeros(n_nodes, dtype=np.float32)
    rows: list[np.ndarray] = [np.arange(len(sample))]
    for level in range(depth):
        below: list[np.ndarray] = []
        for i, mine in enumerate(rows):
            node = 2**level - 1 + i
            here = sample[mine]
            spread = here - here.mean(axis=0) if len(mine) else here
            best = (-1.0, None, 0.0, None)
            for _ in range(TRIES):
                normal = rng.standard_normal(sample.shape[1]).astype(np.float32)
                if len(mine) >= 4:
                    for _ in range(SHARPEN):
                        normal = spread.T @ (spread @ normal)
                        normal /= max(float(np.linalg.norm(normal)), 1e-12)
                length = float(np.linalg.norm(normal))
                if length < 1e-6:
                    normal = rng.standard_normal(sample.shape[1]).astype(np.float32)
                    length = float(np.linalg.norm(normal))
                normal = normal / length
                if not len(mine):
                    best = (0.0, normal, 0.0, np.zeros(0))
                    break
                at = here @ normal
                order = np.sort(at)
                lo, hi = int(len(order) * (0.5 - MIDDLE)), int(len(order) * (0.5 + MIDDLE)) + 1
                part = order[lo : hi + 1]
                gaps = np.diff(part)
                g = int(np.argmax(gaps)) if len(gaps) else -1
                wide = float(gaps[g]) if g >= 0 else 0.0
                if wide > best[0]:
                    best = (wide, normal, float(part[g] + part[g + 1]) / 2 if g >= 0 else float(np.median(order)), at)
            normals[node], offsets[node] = best[1], best[2]
            right = best[3] > best[2]
            below += [mine[~right], mine[right]]
        rows = below
    directions = rng.standard_normal((deeper, sample.shape[1])).astype(np.float32)
    if deeper:
        spread = np.concatenate([sample[mine] - sample[mine].mean(axis=0) for mine in rows if len(mine)] or [sample])
        for _ in range(SHARPEN):  # by what vectors of a cell differ in, over all cells
            directions = directions @ spread.T @ spread
            directions /= np.maximum(np.linalg.norm(directions, axis=1, keepdims=True), 1e-12)
    directions /= np.maximum(np.linalg.norm(directions, axis=1, keepdims=True), 1e-12)
    middle = np.zeros((2**depth, deeper), dtype=np.float32)
    for cell, mine in enumerate(rows):
        if len(mine) and deeper:
            middle[cell] = np.median(sample[mine] @ directions.T, axis=0)
    return Tree(depth, normals, offsets, directions, middle)


@dataclass
class Forest:
    """Trees, the priority down to which the shared queue is followed, and what the way into another tree counts beside a margin."""

    trees: list[Tree]
    reach: float = np.inf
    handicap: float = 0.0

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that each vector comes to, its own in the first tree first."""
        parts = [(at, *self._leaves(x[at : at + BLOCK_ROWS])) for at in range(0, max(1, len(x)), BLOCK_ROWS)]
        return np.concatenate([r + at for at, r, _ in parts]), np.concatenate([leaf for _, _, leaf in parts])

    def _leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(x)
        everyone = np.arange(n)
        leaf, least, queue = self._descend(x, 0, 0, everyone, np.zeros(n, dtype=np.int64), np.full(n, np.inf, dtype=np.float32))
        rows, leaves = [everyone], [leaf]
        for t in range(1, len(self.trees)):
            priority = self.handicap - least
            take = np.flatnonzero(priority >= self.reach)
            queue.append((t, 0, take, np.zeros(len(take), dtype=np.int64), priority[take]))
        while queue:  # all entries are at or over the reach; each adds only entries that are, so the order is free
            t, level, row, path, priority = queue.pop()
            if len(row):
                leaf, _, more = self._descend(x, t, level, row, path, priority)
                rows.append(row)
                leaves.append(leaf)
                queue += more
        row, leaf = np.concatenate(rows), np.concatenate(leaves)
        return row, leaf

    def _descend(self, x: np.ndarray, t: int, level: int, row: np.ndarray, path: np.ndarray, priority: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
        """(leaf, least margin on the way, entries for the queue) of vectors from a node of a tree on."""
        tree, more = self.trees[t], []
        least = np.full(len(row), np.inf, dtype=np.float32)
        for at in range(level, tree.levels):
            margin = tree.margin(x[row], at, path)
            side = margin > 0
            size = np.abs(margin)
            other = np.minimum(priority, -size)
            take = np.flatnonzero(other >= self.reach)
            if len(take):
                more.append((t, at + 1, row[take], 2 * path[take] + ~side[take], other[take]))
            least = np.minimum(least, size)
            path = 2 * path + side
        return path + (t << tree.levels), least, more


def fit_forest(sample: np.ndarray, depth: int, trees: int = TREES, extra: float = EXTRA_LEAVES, other: float = OTHER_TREES, seed: int = 7) -> Forest:
    """A forest over unit vectors, of any depth. extra: further leaves a search takes on average, at depth 0, other: the part of them that is ways into other trees."""
    rng = np.random.default_rng(seed)
    fitted = min(depth, int(np.log2(max(1, len(sample) // 4)))) if len(sample) >= 4 else 0
    forest = Forest([fit_tree(sample, fitted, rng, depth - fitted) for _ in range(trees)])
    if not len(sample) or depth < 1:
        return forest
    x = sample[:5000]
    path = np.zeros(len(x), dtype=np.int64)
    sizes = []
    for level in range(depth):
        margin = forest.trees[0].margin(x, level, path)
        sizes.append(np.abs(margin))
        path = 2 * path + (margin > 0)
    every, least = np.sort(np.concatenate(sizes)), np.sort(np.min(sizes, axis=0))
    goal = extra + EXTRA_A_LEVEL * depth + EXTRA_UNFITTED * (depth - fitted)
    low, high = 0.0, goal
    for _ in range(8):  # entries that others add count too, so the part of the goal that is taken at first is found by halving
        try_ = (low + high) / 2
        forest.reach = -float(every[min(len(every) - 1, int(len(x) * try_ * (1 - other)))])
        across = float(least[min(len(least) - 1, int(len(x) * try_ * other / max(1, trees - 1)))])
        forest.handicap = forest.reach + across
        low, high = (try_, high) if len(forest.leaves(x)[0]) <= len(x) * (1 + goal) else (low, try_)
    return forest


# ---------------------------------------------------------------- vectors in Arrow batches


def _rows(vec: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of a list column and the vectors: right length, no null or NaN, not all zero."""
    right = pc.fill_null(pc.equal(pc.list_value_length(vec), dim), False)
    at = np.flatnonzero(right.to_numpy(zero_copy_only=False))
    flat = vec.take(pa.array(at)).flatten()
    x = pc.fill_null(flat.cast(pa.float32()), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return at[good], x[good]


def _unit(x: np.ndarray) -> np.ndarray:
    wide = x.astype(np.float64)
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32) + np.float32(0)


def _direction(x: np.ndarray) -> np.ndarray:
    """A 64-bit number of each direction; two of n directions share one with a chance of about n * n / 2**65."""
    return _numbers(_unit(x))


def _numbers(rows: np.ndarray) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(r.tobytes(), digest_size=8).digest(), "little", signed=True) for r in rows], dtype=np.int64)


def _packed(x: np.ndarray) -> list[bytes]:
    """Each vector's bytes: half precision where that loses nothing, else single."""
    with np.errstate(over="ignore"):
        half = x.astype(np.float16)
    exact = (half.astype(np.float32) == x).all(axis=1)
    return [h.tobytes() if e else r.tobytes() for h, r, e in zip(half, x, exact, strict=True)]


def _unpacked(col: pa.Array, dim: int) -> np.ndarray:
    out = np.empty((len(col), dim), dtype=np.float32)
    for i, b in enumerate(col.to_pylist()):
        out[i] = np.frombuffer(b, dtype=np.float16 if len(b) == 2 * dim else np.float32)
    return out


def _search(member: np.ndarray, member_at: np.ndarray, query: np.ndarray, query_at: np.ndarray, k: int) -> list[tuple[int, list[tuple[float, int]]]]:
    """The k nearest members of each query, equal cosines in order of their place.

    Candidates by one matrix product, all that may be among the first k for its rounding, exactly reranked
    in double precision. member_at is in rising order.
    """
    unit = _unit(member)
    wide = member.astype(np.float64)
    wide /= np.linalg.norm(wide, axis=1, keepdims=True)
    out: list[tuple[int, list[tuple[float, int]]]] = []
    take = min(len(member), k + 1)  # room for the query itself
    error = np.float32(2 * (member.shape[1] + 4) * 2.0**-24)  # of two products of unit vectors in single precision
    for at in range(0, len(query), 512):
        q = query[at : at + 512]
        near = _unit(q) @ unit.T
        least = np.partition(near, len(member) - take, axis=1)[:, len(member) - take] - error
        close = near >= least[:, None]
        many = np.flatnonzero(close.sum(axis=1) > MANY * (k + 1))
        close[many] = False
        row, col = np.nonzero(close)
        ends = np.searchsorted(row, np.arange(len(q) + 1))
        exact = q.astype(np.float64)
        exact /= np.linalg.norm(exact, axis=1, keepdims=True)
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for part in range(0, len(many), 64):
            rows = many[part : part + 64]
            cosines = np.round(exact[rows] @ wide.T, 12)
            last = np.partition(cosines, len(member) - take, axis=1)[:, len(member) - take]
            for i, cos, c in zip(rows.tolist(), cosines, last, strict=True):
                places = np.concatenate([np.flatnonzero(cos > c), np.flatnonzero(cos == c)[:take]])
                best[i] = places, cos[places]
        for i in range(len(q)):
            mine = query_at[at + i]
            if i in best:
                places, cos = best[i]
            else:
                places = col[ends[i] : ends[i + 1]]
                cos = np.round((wide[places] * exact[i]).sum(axis=1), 12)
            order = np.lexsort((member_at[places], -cos))[: k + 1]
            out.append((int(mine), [(float(cos[j]), int(member_at[places[j]])) for j in order if member_at[places[j]] != mine][:k]))
    return out


def _search_leaf(x: np.ndarray, k: int, leaf_rows: int, trees: int, extra: float) -> list[tuple[int, list[tuple[float, int]]]]:
    """The k nearest of every vector of a leaf, by place.

    A leaf far over its size, as near copies can't be split, is searched through a forest of its own.
    """
    places = np.arange(len(x))
    if len(x) <= OVERFULL * leaf_rows:
        return _search(x, places, x, places, k)
    unit = _unit(x)
    rng = np.random.default_rng(len(x))
    row, leaf = fit_forest(unit[rng.permutation(len(x))[:SAMPLE_ROWS]], int(np.ceil(np.log2(len(x) / leaf_rows))), trees, extra).leaves(unit)
    found: dict[int, set[tuple[float, int]]] = {}
    order = np.argsort(leaf, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
        at = np.sort(row[part])
        for q, near in _search(x[at], at, x[at], at, k):
            found.setdefault(q, set()).update(near)
    # the forest parts a large group of near copies by their last bits; each must still meet the first of its group
    for shift in (0.0, 0.5):
        copy = _numbers(np.rint(unit / np.float32(COPY) + np.float32(shift)).astype(np.int32))
        order = np.argsort(copy, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(copy[order])) + 1):
            if len(at) > 1:
                for q, near in _search(x[at[: k + 1]], at[: k + 1], x[at], at, k):
                    found.setdefault(q, set()).update(near)
    return [(q, _first(near, k)) for q, near in found.items()]


def _first(near: set[tuple[float, int]], k: int) -> list[tuple[float, int]]:
    """The first k by cosine and place, each place once."""
    best: dict[int, float] = {}
    for cos, at in near:
        best[at] = max(cos, best.get(at, -2.0))
    return sorted(((cos, at) for at, cos in best.items()), key=lambda s: (-s[0], s[1]))[:k]


def nearest(df: DataFrame, k: int = 5, node: str = "node_id", vec: str = "vec", newest: str | None = "updated_at", dim: int = 384, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS, trees: int = TREES, extra: float = EXTRA_LEAVES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(owner, members, near): node -> direction, direction -> first members, direction -> nearest other directions (d: cosine negated), with all as near as the k-th.

    Rows whose vector is null, of another length, all zero or not finite are left out; of a node's
    rows the newest usable one counts. Extra columns are not read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(node).alias("n"), F.col(vec).alias("v"), (F.col(newest) if newest else F.lit(0)).alias("t")).where("n is not null and v is not null")
    total = df.count()

    def directions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = _rows(b.column(1), dim)
            keep = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(2).take(keep), pa.array(_direction(x))], names=["n", "t", "h"])

    stamp = rows.schema["t"].dataType.simpleString()
    kind = rows.schema["n"].dataType.simpleString()
    owner = cut(rows.mapInArrow(directions, f"n {kind}, t {stamp}, h long").groupBy("n").agg(F.max_by("h", F.struct("t", "h")).alias("h"), F.max("t").alias("t"), (F.min("h") != F.max("h")).alias("moved")))
    members = _members(owner, k)

    fraction = min(1.0, 1.3 * sample_rows / max(1, total))

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, x = _rows(b.column(0), dim)
            yield pa.RecordBatch.from_arrays([pa.array(_packed(x), pa.binary())], names=["v"])

    chosen = rows.where(F.pmod(F.xxhash64("n"), F.lit(1 << 20)) < F.lit(int(fraction * (1 << 20)) + 1))
    sample = _unpacked(chosen.select("v").mapInArrow(pick, "v binary").limit(sample_rows).toArrow().column("v").combine_chunks(), dim)
    depth = max(0, int(np.ceil(np.log2(max(1, total) / leaf_rows))))
    forest = spark.sparkContext.broadcast(fit_forest(_unit(sample) if len(sample) else sample, depth, trees, extra))

    # vectors that a node no longer has must not take a place among the nearest
    moved = owner.where("moved").select("n", F.col("t").alias("last"))
    many = moved.count()
    source = rows
    if many:
        source = rows.join(F.broadcast(moved) if many <= MOVED_BROADCAST else moved, "n", "left").where(F.col("last").isNull() | F.col("t").eqNullSafe(F.col("last")))

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict = {}  # direction -> its first node so far; a direction is sent again if an earlier one turns up
        for b in batches:
            at, x = _rows(b.column(1), dim)
            names = b.column(0).take(pa.array(at))
            h = _direction(x)
            fresh: dict[int, int] = {}
            for i, (value, name) in enumerate(zip(h.tolist(), names.to_pylist(), strict=True)):
                if value not in first or name < first[value]:
                    first[value] = name
                    fresh[value] = i
            send = np.array(sorted(fresh.values()), dtype=np.int64)
            if not len(send):
                continue
            x, h, names = x[send], h[send], names.take(pa.array(send))
            row, leaf = forest.value.leaves(_unit(x))
            packed, places = pa.array(_packed(x), pa.binary()), pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(h[row]), names.take(places), packed.take(places)], names=["leaf", "h", "n", "v"])

    def search(table: pa.Table) -> pa.Table:
        # directions in order of their first node, so that their places decide between equal cosines
        table = table.take(pc.sort_indices(table, [("n", "ascending")]))
        h, first = np.unique(table.column("h").to_numpy(), return_index=True)
        order = np.argsort(first)
        h, first = h[order], first[order]
        x = _unpacked(table.column("v").combine_chunks().take(pa.array(first)), dim)
        found = _search_leaf(x, k, leaf_rows, trees, extra)
        columns = [pa.array(h[[q for q, _ in found]] if found else [], pa.int64())]
        for j in range(k):
            columns.append(pa.array([of[j][0] if j < len(of) else None for _, of in found], pa.float64()))
            columns.append(pa.array([int(h[of[j][1]]) if j < len(of) else None for _, of in found], pa.int64()))
        return pa.table(columns, names=["h", *flat])

    # flat columns: a row of numbers takes half the bytes of a list of structs in the shuffle
    flat = [f"{c}{j}" for j in range(k) for c in "ch"]
    leaves = source.select("n", "v").mapInArrow(route, f"leaf long, h long, n {kind}, v binary")
    spread = max(spark.sparkContext.defaultParallelism, -(-total // PARTITION_ROWS))
    lists = leaves.repartition(spread, "leaf").groupBy("leaf").applyInArrow(search, "h long, " + ", ".join(f"{c} {'double' if c[0] == 'c' else 'long'}" for c in flat))
    one = F.filter(F.array(*[F.struct((-F.col(f"c{j}")).alias("d"), F.col(f"h{j}").alias("h")) for j in range(k)]), lambda s: s["h"].isNotNull())
    near = lists.repartition("h").groupBy("h").agg(F.array_sort(F.flatten(F.collect_list(one))).alias("near"))
    once = near.select("h", F.filter("near", lambda s, i: F.array_position(F.col("near.h"), s["h"]) == i + 1).alias("near"))
    tied = F.filter("near", lambda s: s["d"] <= F.coalesce(F.get("near", F.lit(k - 1))["d"], s["d"]))
    return owner.select("n", "h"), members, once.select("h", tied.alias("near"))


def _members(owner: DataFrame, k: int) -> DataFrame:
    """The first k + 1 members of each direction; only those are ever kept together."""
    ranked = owner.withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("n"))).where(F.col("r") <= k + 1)
    return ranked.groupBy("h").agg(F.array_sort(F.collect_list("n")).alias("ids"))


def nearest_pairs(df: DataFrame, k: int = 5, **how) -> DataFrame:
    """(node_a, node_b): unordered pairs, the smaller first, of which one is among the other's k nearest; each once.

    Equal cosines are taken in order of the node, also between nodes of one direction, whose cosine is
    1, and those of another direction with a cosine of 1.
    """
    owner, members, near = nearest(df, k, **how)
    other = members.select(F.col("h").alias("oh"), F.slice("ids", 1, k).alias("others"))
    wanted = near.select("h", F.explode("near").alias("s")).select("h", F.col("s.d").alias("d"), F.col("s.h").alias("oh"))
    spread = wanted.join(other, "oh").select("h", "d", F.explode("others").alias("o"))
    own = members.select("h", F.lit(-1.0).alias("d"), F.explode("ids").alias("o"))
    # one more than k, as a node isn't its own neighbour
    ranked = spread.unionByName(own).withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("d", "o"))).where(F.col("r") <= k + 1)
    first = ranked.groupBy("h").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "o"))), lambda s: s["o"]).alias("first"))
    pairs = owner.join(first, "h").select("n", F.explode(F.slice(F.array_except("first", F.array("n")), 1, k)).alias("o"))
    return pairs.select(F.least("n", "o").alias("node_a"), F.greatest("n", "o").alias("node_b")).distinct()


def search_exact(df: DataFrame, queries: DataFrame, k: int = 5, node: str = "node_id", vec: str = "vec", newest: str | None = "updated_at", dim: int = 384, block: int = 2_000) -> DataFrame:
    """(node_id, rank, other, cosine): the k most similar nodes of every query, by comparing it with all rows; exact, and as slow as that is.

    Queries (column node) are taken in blocks of a fixed size, whose vectors are broadcast; each
    partition keeps its k best of each query, and only those meet. Equal cosines are taken in order of
    the node. Rows are usable as in nearest; queries without a usable row give nothing.
    """
    spark = df.sparkSession
    kind = df.schema[node].dataType.simpleString()
    rows = df.select(F.col(node).alias("n"), F.col(vec).alias("v"), (F.col(newest) if newest else F.lit(0)).alias("t")).where("n is not null and v is not null")

    def usable(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = _rows(b.column(1), dim)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(2).take(pa.array(at)), pa.array(_packed(x), pa.binary())], names=["n", "t", "v"])

    stamp = rows.schema["t"].dataType.simpleString()
    good = rows.mapInArrow(usable, f"n {kind}, t {stamp}, v binary").groupBy("n").agg(F.max_by("v", F.struct("t", "v")).alias("v"))
    good = cut(good)
    asked = cut(good.join(queries.select(F.col(node).alias("n")).distinct(), "n", "left_semi").withColumn("at", F.monotonically_increasing_id()).repartitionByRange("at"))
    blocks = -(-asked.count() // block)
    best = None
    for turn in range(blocks):
        ask = asked.where(F.pmod(F.xxhash64("n"), F.lit(blocks)) == turn).select("n", "v").orderBy("n").toArrow()
        names, q = ask.column("n").to_pylist(), _unpacked(ask.column("v").combine_chunks(), dim)
        sent = spark.sparkContext.broadcast((names, q / np.maximum(np.linalg.norm(q.astype(np.float64), axis=1, keepdims=True), 1e-300)))

        def compare(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            kept: list[list[tuple[float, object]]] = [[] for _ in names]
            for b in batches:
                others = b.column(0).to_pylist()
                x = _unpacked(b.column(1), dim).astype(np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                cosines = np.round(x @ q.T, 12)
                take = min(len(others), k + 1)
                least = np.partition(cosines, len(others) - take, axis=0)[len(others) - take] if take else None
                for i, name in enumerate(names):
                    hits = [(-float(cosines[j, i]), others[j]) for j in np.flatnonzero(cosines[:, i] >= least[i]) if others[j] != name]
                    kept[i] = sorted(kept[i] + hits)[:k]
            out = [(n, -d, o) for n, near in zip(names, kept, strict=True) for d, o in near]
            yield pa.RecordBatch.from_pylist([{"n": n, "cosine": c, "other": o} for n, c, o in out], schema=wanted)

        wanted = pa.schema([("n", ask.schema.field("n").type), ("cosine", pa.float64()), ("other", ask.schema.field("n").type)])
        part = good.mapInArrow(compare, f"n {kind}, cosine double, other {kind}")
        best = part if best is None else best.unionByName(part)
    if best is None:
        return spark.createDataFrame([], f"{node} {kind}, rank int, other {kind}, cosine double")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("n").orderBy(F.desc("cosine"), "other"))).where(F.col("rank") <= k)
    return ranked.select(F.col("n").alias(node), "rank", "other", "cosine")
