import base64
import os
import random

import pytest

from graphweave.llm import packing, tokens

VOCAB = os.path.join(tokens.DEFAULT_FOLDER, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary files here")

TEXTS = ["", None, "Hello world", "<|endoftext|>", "  \n\t x", "don't'll", "né 日本語 👩‍💻", "a" * 5000, "ab" * 3000 + " " * 200, "x\u0000y", "１２3 ½", "\r\n\r\n", "zz" * 20 + "q"]


def reference():
    tiktoken = pytest.importorskip("tiktoken")
    with open(VOCAB, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_reference_and_round_trips():
    enc = reference()
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("abc \n'éß日👍_<|>0") for _ in range(rng.randrange(60))) for _ in range(400)]
    mine = [i for block in tokens.encode_all(VOCAB, texts) for i in block]
    assert mine == [enc.encode_ordinary(t or "") for t in texts]
    assert [enc.decode(i) for i in mine] == [t or "" for t in texts]


def test_rows_of_a_table(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(2, "Hello world", "again")], "doc_id long, text string, ids string")
    got = tokens.encode(df).collect()
    assert len(got) == len(TEXTS) + 1 and {len(r["ids"]) for r in got if r["doc_id"] in (0, 1)} == {0}
    counts = tokens.token_counts(df).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in counts) == sorted((r["doc_id"], len(r["ids"])) for r in got)
    assert tokens.encode(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_exact_and_tight(seed):
    rng = random.Random(seed)
    capacity = [10, 97, 400, 1024][seed]
    histogram = {n: rng.randrange(1, 40) for n in range(1, capacity + 1) if rng.random() < 0.4}
    plan = packing.solve(histogram, capacity)
    assert plan.used == histogram
    filled = {}
    for length, spans in plan.spans.items():
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        for lo, hi, first, copies in spans:
            for k in range((hi - lo) // copies):
                filled[first + k] = filled.get(first + k, 0) + copies * length
    assert len(filled) == plan.containers and max(filled.values()) <= capacity
    # as good as first-fit in falling order of length, but for rounding
    rooms: list[int] = []
    for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        for i, room in enumerate(rooms):
            if room >= n:
                rooms[i] -= n
                break
        else:
            rooms.append(capacity - n)
    assert plan.containers <= len(rooms) * 1.01 + 1


def test_program_covers_heavy_lengths_beside_a_long_tail():
    # longest first lays 176 + 176 and 112 + 112 + 112; only 176 + 112 + 112 is full
    histogram = {n: 1 for n in range(120, 400)} | {176: 100_000, 112: 200_000}
    plan = packing.solve(histogram, 400)
    assert plan.used == histogram
    assert plan.containers <= 1.01 * sum(n * c for n, c in histogram.items()) / 400
    assert plan.by_program >= 0.95 and plan.by_program + plan.repaired + plan.filled == pytest.approx(1)


def longest_first(histogram, capacity):
    """Containers that hold the longest item left and then the longest that fit."""
    left, many = dict(histogram), 0
    while any(left.values()):
        room = capacity
        many += 1
        for n in sorted(left, reverse=True):
            take = min(left[n], room // n)
            left[n] -= take
            room -= take * n
    return many


@pytest.mark.parametrize("capacity", [400, 1024, 2048, 8192])
def test_the_program_lays_nearly_all_and_proves_its_bound(capacity):
    rng = random.Random(capacity)
    histogram: dict[int, int] = {}
    for _ in range(20_000):
        n = min(capacity, max(1, int(rng.lognormvariate(5.3, 1.1))))
        histogram[n] = histogram.get(n, 0) + 1
    plan = packing.solve(histogram, capacity)
    assert plan.used == histogram and plan.by_program >= 0.9
    assert plan.gap <= packing.GAP
    assert plan.bound <= plan.containers <= 1.005 * plan.bound + 1


def test_where_longest_first_wastes_room_the_program_does_not():
    histogram = {176: 300, 112: 600}
    plan = packing.solve(histogram, 400)
    assert longest_first(histogram, 400) >= 340
    assert plan.containers == plan.bound == 300 and plan.gap <= packing.GAP and plan.by_program == pytest.approx(1)


def test_prices_bound_what_volume_does_not():
    # each long item needs a container of its own, whatever the short ones fill
    plan = packing.solve({60: 100, 30: 10}, 100)
    assert plan.containers == plan.bound == 100
    assert packing.solve({}, 10).containers == 0


def test_packing_rows(spark):
    rng = random.Random(5)
    sizes = [rng.choice([0, 3, 7, 7, 7, 12, 40, 100, 101, 205, 350]) for _ in range(500)] + [None, 1000]
    df = spark.createDataFrame([(i, n, 0) for i, n in enumerate(sizes)], "doc_id long, n_tokens int, container int")
    rows = packing.pack(df, {1: 100, 2: 64}).collect()
    for budget, capacity in ((1, 100), (2, 64)):
        mine = [r for r in rows if r["budget_id"] == budget]
        load, whole = {}, {}
        for r in mine:
            whole.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
            if r["container"] is None:
                assert r["length"] == 0
            else:
                load[r["container"]] = load.get(r["container"], 0) + r["length"]
        assert max(load.values()) <= capacity and sorted(load) == list(range(len(load)))
        assert len(whole) == len(sizes)
        for i, n in enumerate(sizes):
            parts = sorted(whole[i])
            assert sum(p[1] for p in parts) == (n or 0) and (len(parts) == 1 or n > capacity)
            assert [p[0] for p in parts] == [k * capacity for k in range(len(parts))]
    assert packing.pack(df.limit(0), {1: 100}).count() == 0 and packing.pack(df, {}).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, {1: 0})
