import heapq

import numpy as np
import pytest

from graphweave.llm import neighbours

SCHEMA = "node_id string, vec array<float>, model string, updated_at int, h int"


def brute(rows, k, dim):
    latest = {}
    for n, v, _, t, _ in rows:
        if n is not None and v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and any(v):
            if n not in latest or t >= latest[n][0]:
                latest[n] = (t, v)
    ids = sorted(latest)
    x = np.array([latest[i][1] for i in ids], dtype=np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = set()
    for i in range(len(ids)):
        cos = np.round((x * x[i]).sum(axis=1), 10)
        order = [j for j in np.lexsort((np.arange(len(ids)), -cos)) if j != i][:k]
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in order}
    return out


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 8, dim))
    return (centres[np.arange(n) % (n // 8)] + 0.35 * rng.standard_normal((n, dim))).astype(np.float32)


def test_exact_in_one_leaf_with_dirt(spark):
    dim = 8
    x = vectors(80, dim, 1)
    rows = [(f"n{i:03d}", v.tolist(), "m", 1, 0) for i, v in enumerate(x)]
    rows += [(f"same{i}", x[3].tolist(), "m", 1, 0) for i in range(9)]  # more copies than k
    rows += [(f"long{i}", (x[5] * 4).tolist(), "m", 1, 0) for i in range(2)]
    rows += [("n010", x[10].tolist(), "m", 2, 0), ("n011", x[40].tolist(), "m", 9, 0)]  # repeated, changed
    rows += [("bad1", None, "m", 1, 0), ("bad2", [], "m", 1, 0), ("bad3", [0.0] * dim, "m", 1, 0), ("bad4", [1.0] * 4, "m", 1, 0), ("bad5", [float("nan")] * dim, "m", 1, 0), (None, x[0].tolist(), "m", 1, 0), ("bad6", [None] * dim, "m", 1, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in neighbours.nearest_pairs(df, k=5, dim=dim).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 5, dim)


@pytest.mark.parametrize("leaf_rows, sample_rows", [(6000, 1000), (40, 4)])
def test_copies_of_other_lengths_are_taken_in_order_of_the_node(spark, leaf_rows, sample_rows):
    dim, k = 48, 5
    rng = np.random.default_rng(6)
    x = vectors(160, dim, 5)
    parts = [x, x[7] + 0.05 * rng.standard_normal((6, dim)), *(x[7:8] * f for f in (0.7, 1.3, *rng.uniform(0.5, 2, 198))), *(x[9:10] * f for f in (0.7, 1.3))]
    x = np.concatenate(parts).astype(np.float32)
    copies = {7, *range(166, 366)}
    ids = [f"{i:03d}" for i in rng.permutation(len(x))]
    rows = [(n, v.tolist(), "m", 1, 0) for n, v in zip(ids, x, strict=True)]
    got = [tuple(r) for r in neighbours.nearest_pairs(spark.createDataFrame(rows, SCHEMA), k=k, dim=dim, leaf_rows=leaf_rows, sample_rows=sample_rows).collect()]
    wide = x.astype(np.float64)
    wide /= np.linalg.norm(wide, axis=1, keepdims=True)
    true = set()
    for i in range(len(x)):
        cos = np.round((wide * wide[i]).sum(axis=1), 12)
        assert i not in copies or (cos[sorted(copies)] == 1).all()
        for j in [j for j in sorted(range(len(x)), key=lambda j: (-cos[j], ids[j])) if j != i][:k]:
            true.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    assert len(got) == len(set(got))
    if leaf_rows > len(x):
        assert set(got) == true
    tied = {ids[i] for i in copies}
    assert {p for p in got if set(p) <= tied} == {p for p in true if set(p) <= tied}


def test_recall_over_many_leaves(spark):
    dim = 32
    x = vectors(4000, dim, 2)
    rows = [(f"n{i:05d}", v.tolist(), "m", 1, 0) for i, v in enumerate(x)]
    got = {tuple(r) for r in neighbours.nearest_pairs(spark.createDataFrame(rows, SCHEMA), k=5, dim=dim, leaf_rows=500, sample_rows=1500).collect()}
    true = brute(rows, 5, dim)
    assert len(got & true) / len(true) >= 0.9


def test_recall_where_leaves_are_far_over_their_size(spark):
    dim = 24
    x = vectors(3000, dim, 4)
    rows = [(f"n{i:05d}", v.tolist(), "m", 1, 0) for i, v in enumerate(x)]
    got = {tuple(r) for r in neighbours.nearest_pairs(spark.createDataFrame(rows, SCHEMA), k=5, dim=dim, leaf_rows=150, sample_rows=16).collect()}
    true = brute(rows, 5, dim)
    assert len(got & true) / len(true) >= 0.9


@pytest.mark.parametrize("n", [0, 1, 2])
def test_tiny_tables(spark, n):
    df = spark.createDataFrame([(f"n{i}", [1.0, float(i)], "m", 1, 0) for i in range(n)], SCHEMA)
    assert neighbours.nearest_pairs(df, k=5, dim=2).count() == (1 if n == 2 else 0)


def walk(tree, v):
    path, least = 0, np.inf
    for level in range(tree.levels):
        m = float(tree.margin(v[None], level, np.array([path]))[0])
        path, least = 2 * path + (m > 0), min(least, abs(m))
    return path, least


@pytest.mark.parametrize("depth, sample", [(3, 600), (8, 40)])
def test_the_shared_queue_gives_what_popping_one_entry_after_another_gives(depth, sample):
    """Against a heap of (priority, tree, level, path), popped from the greatest priority down to the reach."""
    x = vectors(600, 16, 3)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = neighbours.fit_forest(x[:sample], depth)
    rows, leaf = forest.leaves(x)
    assert forest.trees[0].levels == depth and (sample == 600) == (forest.trees[0].depth == depth)
    for i in range(0, 600, 50):
        path, least = walk(forest.trees[0], x[i])
        heap = [(-np.inf, 0, 0, 0)] + [(-(forest.handicap - np.float32(least)), t, 0, 0) for t in range(1, len(forest.trees))]
        want = set()
        while heap:
            low, t, level, at = heapq.heappop(heap)
            if -low < forest.reach:
                break
            for step in range(level, depth):
                m = forest.trees[t].margin(x[i : i + 1], step, np.array([at]))[0]
                heapq.heappush(heap, (max(low, float(abs(m))), t, step + 1, 2 * at + int(not m > 0)))
                at = 2 * at + int(m > 0)
            want.add(at + (t << depth))
        got = leaf[rows == i].tolist()
        assert got[0] == path and set(got) == want


def test_the_exact_way(spark):
    dim = 16
    x = vectors(300, dim, 9)
    rows = [(f"n{i:03d}", v.tolist(), "m", 1, 0) for i, v in enumerate(x)] + [(f"same{i}", x[3].tolist(), "m", 1, 0) for i in range(7)] + [("bad", None, "m", 1, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = neighbours.search_exact(df, df.select("node_id"), k=5, dim=dim, block=60).collect()
    assert {(min(r["node_id"], r["other"]), max(r["node_id"], r["other"])) for r in got} == brute(rows, 5, dim)
    assert all(r["rank"] <= 5 for r in got) and len(got) == 5 * 307
    assert neighbours.search_exact(df, df.select("node_id").limit(0), dim=dim).count() == 0


def test_recall_at_depth_8(spark):
    dim = 32
    x = vectors(6000, dim, 12)
    df = spark.createDataFrame([(f"n{i:05d}", v.tolist(), "m", 1, 0) for i, v in enumerate(x)], SCHEMA)
    got = {tuple(r) for r in neighbours.nearest_pairs(df, k=5, dim=dim, leaf_rows=24, sample_rows=2000, extra=3.0).collect()}
    asked = df.where("node_id like '%7'").select("node_id")
    true = [(r["node_id"], r["other"]) for r in neighbours.search_exact(df, asked, k=5, dim=dim).collect()]
    assert len(true) == 3000 and sum((min(p), max(p)) in got for p in true) >= 0.9 * len(true)
