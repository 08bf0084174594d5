import random
from collections import Counter, defaultdict

import pytest

from graphweave.operators import skew

SCHEMA = "target_id string, type string, source_id string, created_at int, rows int"


def brute(rows):
    n, members = Counter(), defaultdict(set)
    for t, k, s, *_ in rows:
        n[t, k] += 1
        if s is not None:
            members[t, k].add(s)
    return {k: (c, len(members[k])) for k, c in n.items()}


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_profile_equals_brute_force_with_one_key_of_a_third(spark, partitions):
    rng = random.Random(partitions)
    rows = [("hot", "CALLS", f"s{rng.randrange(50)}", i, 0) for i in range(400)]
    rows += [("hot", "CALLS", "same", i, 0) for i in range(200)]
    rows += [(rng.choice(["a", "b", None, ""]), rng.choice(["CALLS", None]), rng.choice(["x", "y", None]), i, 1) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {(r["target_id"], r["type"]): (r["rows"], r["members"]) for r in skew.key_profile(df, partitions=partitions).collect()}
    assert found == brute(rows)


def test_heavy_key_is_split(spark):
    rows = [("hot", "CALLS", f"s{i}", i, 0) for i in range(900)] + [(f"t{i}", "USES", "s", i, 0) for i in range(100)]
    got = {r["target_id"]: r["split_over"] for r in skew.key_profile(spark.createDataFrame(rows, SCHEMA), partitions=6).collect()}
    assert got["hot"] >= 4 and got["t5"] == 1


def test_heavy_keys_share_is_inclusive(spark):
    rows = [("a", "CALLS", "s", i, 0) for i in range(10)] + [(f"b{i}", "CALLS", "s", i, 0) for i in range(990)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r)[:2] for r in skew.heavy_keys(df, 0.01).collect()] == [("a", "CALLS")]


def test_share_is_exact_where_floats_are_not(spark):
    rows = [("a", "CALLS", "s", i, 0) for i in range(7)] + [(f"b{i}", "CALLS", "s", i, 0) for i in range(693)]
    assert skew.heavy_keys(spark.createDataFrame(rows, SCHEMA), 0.01).count() == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert skew.key_profile(df).count() == 0
    assert skew.heavy_keys(df).count() == 0
