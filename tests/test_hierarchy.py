import random

import pytest

from graphweave.operators import hierarchy

SCHEMA = "source_id string, target_id string, type string, path string"


def brute(links):
    parent = {}
    for c, p in links:
        parent[c] = min(p, parent.get(c, p))
    pairs = set()
    for c in parent:
        seen, at = set(), c
        while at in parent and parent[at] not in seen:
            at = parent[at]
            seen.add(at)
            pairs.add((min(c, at), max(c, at)))
    return parent, pairs


def run(spark, links, extra=()):
    rows = [(c, p, "INHERITS", "x") for c, p in links] + list(extra)
    return hierarchy.hierarchy(hierarchy.tree_links(spark.createDataFrame(rows, SCHEMA)))


@pytest.mark.parametrize("seed", range(3))
def test_random_forests_and_circles(spark, seed):
    rng = random.Random(seed)
    links = []
    for i in range(1, 60):
        if rng.random() < 0.9:
            links.append((f"n{i:02d}", f"n{rng.randrange(0, i if seed else 60):02d}"))
    links += links[:5]
    _, pairs = brute(links)
    trees = run(spark, links)
    got = [tuple(r) for r in hierarchy.unordered_pairs(trees).collect()]
    assert len(got) == len(set(got))
    assert set(got) == pairs


def test_chain_path_depth_and_root(spark):
    n = 40
    trees = {r["node"]: r for r in run(spark, [(f"c{i + 1:03d}", f"c{i:03d}") for i in range(n)]).collect()}
    assert trees["c040"]["depth"] == n and trees["c040"]["root"] == "c000"
    assert list(trees["c040"]["path"]) == [f"c{i:03d}" for i in range(n + 1)]
    assert trees["c000"]["depth"] == 0


def test_circle_and_what_hangs_on_it(spark):
    trees = run(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("y", "x"), ("s", "s")])
    rows = {r["node"]: r for r in trees.collect()}
    assert list(rows["y"]["cycle"]) == ["a", "b", "c"] and not rows["y"]["on_cycle"] and rows["y"]["root"] is None
    assert rows["a"]["on_cycle"] and list(rows["s"]["cycle"]) == ["s"]
    pairs = {tuple(r) for r in hierarchy.unordered_pairs(trees).collect()}
    assert {("a", "a"), ("b", "b"), ("s", "s"), ("a", "b"), ("a", "y"), ("x", "y")} <= pairs
    down = {r["node"]: r["n_descendants"] for r in hierarchy.descendants(trees).collect()}
    assert down["a"] == 5 and down["x"] == 1 and down["y"] == 0 and down["s"] == 1


def test_star_of_many_children(spark):
    trees = run(spark, [(f"k{i}", "base") for i in range(200)])
    assert trees.where("depth = 1 and root = 'base'").count() == 200


def test_null_ends_other_types_two_parents_and_empty(spark):
    extra = [(None, "a", "INHERITS", "x"), ("a", None, "INHERITS", None), ("q", "r", "CALLS", "x"), ("a", None, None, None)]
    trees = run(spark, [("a", "z"), ("a", "b")], extra)
    assert {r["node"]: r["root"] for r in trees.collect()} == {"a": "b", "b": "b"}
    edges = spark.createDataFrame([("a", "z", "INHERITS", "x"), ("a", "b", "INHERITS", "x")], SCHEMA)
    assert [tuple(r) for r in hierarchy.extra_parents(edges).collect()] == [("a", "z")]
    assert run(spark, []).count() == 0
