"""Items of varying length in containers of fixed capacity, with little space unused.

Lengths are a histogram of at most capacity entries, whatever the number of items. The configuration
linear program over it (fewest containers such that the chosen configurations cover every length's
count) is solved by multiplicative weights: each length has a weight, the best configuration
under the current weights comes from a knapsack by dynamic programming, and the weights of the
lengths it covers fall; a length that is covered leaves the program, which ends when none is left.
The prices also bound the program from below, and passes with smaller steps and better prices follow
until the cover is within a part of that bound. Of the fractional solution each configuration gets
its whole containers, and fractions carry over to the next one; the room it leaves, and in the end
what rounding left over, are filled by the same knapsack under the program's prices. The plan names
lengths, not items; it is turned into containers by each item's rank among the items of its length,
so items never leave the executors.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.llm.tokens import token_counts
from graphweave.session import cut, parallelism

#: The program is solved until its cover is within this part of the bound by its prices, or so many passes are over.
GAP = 0.01
PASSES = 6
#: The first pass's step, as a part of a class's demand (each further pass halves it), how fast weights fall with the
#: share covered, the part of a demand that counts as nothing, and the knapsack's steps along the capacity.
STEP = 0.7
FALL = 0.1
OPEN = 1e-6
#: Power of the length that prices start from: long items are the hardest to place.
LONG = 1.2
GRID = 256
#: Times within a pass at which the bound is taken.
BOUNDS = 8


@dataclass
class Plan:
    """Container kinds: spans[length] lists (first rank, past rank, first container, items of the length in each container).

    cover and dual are the value of the program's fractional solution and the bound by its prices, both
    over length classes; bound is what any packing of the items needs at least. by_program, repaired and
    filled are the parts of the items' length in the configurations of the solution, in the room these
    leave when they are made whole, and in configurations priced for what is left in the end.
    """

    capacity: int
    containers: int = 0
    spans: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)
    used: dict[int, int] = field(default_factory=dict)
    cover: float = 0.0
    dual: float = 0.0
    bound: int = 0
    passes: int = 0
    by_program: float = 0.0
    repaired: float = 0.0
    filled: float = 0.0

    @property
    def gap(self) -> float:
        return self.cover / self.dual - 1 if self.dual else 0.0

    def add(self, config: dict[int, int], times: int) -> None:
        for length, copies in config.items():
            at = self.used.get(length, 0)
            self.spans.setdefault(length, []).append((at, at + copies * times, self.containers, copies))
            self.used[length] = at + copies * times
        self.containers += times


def _knapsack(lengths: np.ndarray, values: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """The most valuable multiset of lengths within the capacity (copies of each class, at most its count).

    Copies of a class are split in powers of two, and each part is one vector step along the capacity.
    """
    best = np.zeros(capacity + 1)
    taken: list[tuple[int, int, np.ndarray]] = []
    for i in range(len(lengths)):
        left, part = int(min(most[i], capacity // lengths[i])), 1
        while left > 0:
            part = min(part, left)
            size = int(lengths[i]) * part
            if size > capacity:
                break
            with_it = best[:-size] + values[i] * part
            better = with_it > best[size:] + 1e-12
            best[size:][better] = with_it[better]
            taken.append((i, part, better))
            left -= part
            part *= 2
    copies = np.zeros(len(lengths), dtype=np.int64)
    room = capacity
    for i, part, better in reversed(taken):
        size = int(lengths[i]) * part
        if room >= size and better[room - size]:
            copies[i] += part
            room -= size
    return copies


def _bound(units: np.ndarray, demand: np.ndarray, price: np.ndarray, room: int) -> float:
    """What the prices prove: no configuration is worth more than the best one, so at least so many cover the demand."""
    copies = _knapsack(units, price, np.maximum(1, np.ceil(demand)).astype(np.int64), room)
    return float(demand @ price) / max(float(copies @ price), 1e-300)


def _cover(units: np.ndarray, demand: np.ndarray, price: np.ndarray, room: int, step: float) -> tuple[list[tuple[np.ndarray, float]], float, float, np.ndarray]:
    """(configurations and how often each is taken, their number, the best bound and its prices): one pass of multiplicative weights.

    Together the configurations cover every class's demand, none more than once over. A round raises
    each class of its configuration by at most a step of the demand and closes it when nothing is
    open, so there are at most about 1 / step + 1 rounds a class.
    """
    share = np.zeros(len(units))
    chosen: dict[bytes, tuple[np.ndarray, float]] = {}
    bound, proof, total, due = 0.0, price, 0.0, 1.0
    while True:
        here = np.flatnonzero(share < 1 - OPEN)
        if not len(here):
            return list(chosen.values()), total, bound, proof
        weight = price[here] * np.exp(-FALL * (share[here] - share[here].min()))
        if len(here) <= due * len(units):
            now = _bound(units[here], demand[here], weight, room)
            if now > bound:
                bound, proof = now, np.zeros(len(units))
                proof[here] = weight
            due = len(here) / len(units) - 1 / BOUNDS
        copies = np.ceil((1 - share[here]) * demand[here] - OPEN).astype(np.int64)
        config = np.zeros(len(units), dtype=np.int64)
        config[here] = _knapsack(units[here], weight, np.maximum(copies, 1), room)
        on = config > 0
        # the width of the step: until the scarcest class of the configuration gains a step of its demand or is covered
        times = float((np.minimum(step, 1 - share[on]) * demand[on] / config[on]).min())
        key = config.tobytes()
        chosen[key] = (config, chosen.get(key, (config, 0.0))[1] + times)
        share[on] += config[on] * times / demand[on]
        total += times


def _program(units: np.ndarray, demand: np.ndarray, room: int) -> tuple[list[tuple[np.ndarray, float]], np.ndarray, float, float, np.ndarray, int]:
    """(configurations with their times, prices, cover, bound, prices of the bound, passes) of the configuration program, within GAP of its bound where it can be.

    After a pass each class is priced by what it cost, its part of the containers it lies in by the
    old prices, and the next pass takes half the step.
    """
    price = units.astype(np.float64) ** LONG
    best: tuple[list, np.ndarray, float] | None = None
    # the length itself as the price gives the bound by volume
    proof, step, turn = units.astype(np.float64), STEP, 0
    bound = _bound(units, demand, proof, room)
    while True:
        turn += 1
        configs, total, seen, prices = _cover(units, demand, price, room, step)
        if seen > bound:
            bound, proof = seen, prices
        if best is None or total < best[2]:
            best = configs, price, total
        if best[2] <= (1 + GAP) * bound or turn == PASSES:
            return best[0], best[1], best[2], bound, proof, turn
        cost = np.zeros(len(units))
        for config, times in configs:
            cost += config * price * (times / float(config @ price))
        price = np.sqrt(price / float(demand @ price) * cost / demand / total)
        step /= 2


def solve(histogram: dict[int, int], capacity: int, grid: int = GRID) -> Plan:
    """A plan that lays every item of the histogram (length -> count, 1 <= length <= capacity)."""
    plan = Plan(capacity)
    lengths = np.array(sorted(n for n, c in histogram.items() if c > 0), dtype=np.int64)
    if not len(lengths):
        return plan
    counts = np.array([histogram[int(n)] for n in lengths], dtype=np.int64)
    step = max(1, capacity // grid)
    room = capacity // step
    # classes are the nearest steps; lengths are chosen within a class such that a container's are not over its capacity
    units, member = np.unique(np.clip((lengths + step // 2) // step, 1, room), return_inverse=True)
    demand = np.bincount(member, weights=counts).astype(np.float64)
    configs, price, plan.cover, plan.dual, proof, plan.passes = _program(units, demand, room)
    volume = float(lengths @ counts)
    plan.bound = int(np.ceil(max(volume / capacity, _bound(lengths, counts.astype(np.float64), proof[member], capacity)) - 1e-6))
    packer = _Packer(plan, lengths, counts.copy(), units, member, price, step, room)
    packer.whole(configs)
    packer.rest()
    plan.by_program, plan.repaired, plan.filled = plan.by_program / volume, plan.repaired / volume, plan.filled / volume
    return plan


class _Packer:
    """Turns configurations of classes into containers of lengths that are left."""

    def __init__(self, plan: Plan, lengths: np.ndarray, left: np.ndarray, units: np.ndarray, member: np.ndarray, price: np.ndarray, step: int, room: int):
        self.plan, self.left, self.units, self.price, self.step, self.room = plan, left, units, price, step, room
        self.lengths = lengths.tolist()
        self.member = member
        self.groups = [np.flatnonzero(member == g).tolist() for g in range(len(units))]

    def pick(self, real: dict[int, int], group: int, need: int, spare: int) -> tuple[int, int]:
        """Adds up to so many items of a class, its longest lengths if the spare room allows, else its shortest; (items, their length)."""
        fair = int(self.units[group]) * self.step
        for order in (self.groups[group][::-1], self.groups[group]):
            chosen, want, size = [], need, 0
            for i in order:
                n = min(want, int(self.left[i]) - real.get(i, 0))
                if n > 0:
                    chosen.append((i, n))
                    size += n * self.lengths[i]
                    want -= n
                    if not want:
                        break
            if size - (need - want) * fair <= spare or order is self.groups[group]:
                break
        for i, n in chosen:
            real[i] = real.get(i, 0) + n
        return need - want, size

    def real(self, config: np.ndarray, real: dict[int, int], room: int) -> int:
        """Adds lengths for a configuration within a room; returns what they take."""
        classes = np.flatnonzero(config)
        spare = room - int((config * self.units).sum()) * self.step
        total = 0
        for g in sorted(classes.tolist(), key=lambda g: -int(self.units[g])):
            need = int(config[g])
            n, size = self.pick(real, g, need, spare)
            spare += n * int(self.units[g]) * self.step - size
            total += size
        if total > room:  # only lengths over their class's are left: without the shortest that is enough
            for i in sorted(real):
                while real.get(i, 0) and total > room:
                    real[i] -= 1
                    total -= self.lengths[i]
            for i in [i for i, n in real.items() if not n]:
                del real[i]
        return total

    def top_up(self, real: dict[int, int], room: int) -> int:
        """Adds the configuration that is worth most in the room that is left; returns what it takes."""
        took = 0
        if room >= self.step:
            free = self.left.copy()
            for i, n in real.items():
                free[i] -= n
            most = np.bincount(self.member, weights=free, minlength=len(self.units)).astype(np.int64)
            few = room // self.step
            fit = np.flatnonzero((most > 0) & (self.units <= few))
            if len(fit):
                config = np.zeros(len(self.units), dtype=np.int64)
                config[fit] = _knapsack(self.units[fit], self.price[fit], most[fit], few)
                more: dict[int, int] = {}
                before = self.left
                self.left = free
                took = self.real(config, more, room)
                self.left = before
                for i, n in more.items():
                    real[i] = real.get(i, 0) + n
        return took + self.stretch(real, room - took)

    def stretch(self, real: dict[int, int], room: int) -> int:
        """Under a step of room: an item more, or one for a longer one, whichever leaves least; returns what they take."""
        took = 0
        while room > 0:
            best, swap = 0, (-1, -1)
            for i in (-1, *real):
                size = self.lengths[i] if i >= 0 else 0
                j = bisect.bisect_right(self.lengths, size + room) - 1
                while j >= 0 and self.lengths[j] - size > best:
                    if self.left[j] > real.get(j, 0):
                        best, swap = self.lengths[j] - size, (i, j)
                        break
                    j -= 1
                if best == room:
                    break
            if not best:
                return took
            i, j = swap
            real[j] = real.get(j, 0) + 1
            if i >= 0:
                real[i] -= 1
                if not real[i]:
                    del real[i]
            room -= best
            took += best
        return took

    def put(self, real: dict[int, int], most: int) -> int:
        """Fills so many containers alike, or as many as the lengths allow; returns how many."""
        run = min(most, *(int(self.left[i]) // n for i, n in real.items()))
        for i, n in real.items():
            self.left[i] -= n * run
        self.plan.add({self.lengths[i]: n for i, n in real.items()}, run)
        return run

    def whole(self, configs: list[tuple[np.ndarray, float]]) -> None:
        """Rounds the configurations, the most frequent first, carrying fractions over; what one leaves free is priced anew."""
        carry = 0.5
        for config, times in sorted(configs, key=lambda c: -c[1]):
            carry += times
            todo = int(carry)
            carry -= todo
            while todo > 0:
                real: dict[int, int] = {}
                total = self.real(config, real, self.plan.capacity)
                if not real:
                    break
                more = self.top_up(real, self.plan.capacity - total)
                run = self.put(real, todo)
                self.plan.by_program += total * run
                self.plan.repaired += more * run
                todo -= run

    def rest(self) -> None:
        """What rounding left: each container takes the configuration worth most of what is still there."""
        while self.left.any():
            real: dict[int, int] = {}
            total = self.top_up(real, self.plan.capacity)
            run = self.put(real, int(self.left.sum()))
            self.plan.filled += total * run


def pieces(sizes: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(key, piece, start, length): an item larger than the capacity in parts of the capacity and a rest, all others whole."""
    n = F.greatest(F.lit(1), F.ceil(F.col(size) / F.lit(capacity))).cast("int")
    cutup = sizes.select(F.col(key), F.col(size), F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    start = F.col("piece") * F.lit(capacity)
    return cutup.select(key, "piece", start.alias("start"), F.least(F.lit(capacity), F.col(size) - start).cast("int").alias("length"))


def pack(sizes: DataFrame, capacities: dict[int, int], key: str = "doc_id", size: str = "n_tokens", budget: str = "budget_id") -> DataFrame:
    """(budget, key, piece, start, length, container) of every item for each capacity (budget -> capacity).

    Containers are numbered from 0 within a budget. Only an item larger than the capacity is split,
    into parts of the capacity and a rest. An item of size 0, null or less takes no space; its
    container is null. A capacity below 1 is refused. Repeated keys are items of their own; no
    items give no rows.

    Nothing but histograms (lengths modulo a capacity, at most capacity entries a partition) and plans
    reaches the driver, and one pass over the items places each for all capacities.
    """
    if any(c is None or c < 1 for c in capacities.values()):
        raise ValueError("a capacity must be at least 1")
    spark = sizes.sparkSession
    kind = sizes.schema[key].dataType.simpleString()
    schema = f"b int, k {kind}, piece int, start int, length int, container long"
    if not capacities:
        return spark.createDataFrame([], schema).withColumnsRenamed({"b": budget, "k": key})
    # cut here, else finding the bounds of the ranges would size every item a second time
    clean = cut(sizes.select(F.col(key), F.greatest(F.lit(0), F.coalesce(F.col(size), F.lit(0))).cast("int").alias(size)))
    # items in order of size, so that a partition holds few lengths and ranks come from counts of partitions
    ordered = cut(clean.repartitionByRange(parallelism(spark), size, key).select(F.spark_partition_id().alias("part"), key, size))
    asked = F.explode(F.array(*[F.struct(F.lit(b).alias("b"), F.lit(c).alias("c")) for b, c in sorted(capacities.items())]))
    each = ordered.where(F.col(size) > 0).select("part", size, asked.alias("s")).select("s.b", "part", (F.col(size) % F.col("s.c")).alias("rest"), F.expr(f"{size} div s.c").alias("whole"))
    counted = each.groupBy("b", "part", "rest").agg(F.count(F.lit(1)).alias("n"), F.sum("whole").alias("whole")).orderBy("b", "part", "rest").collect()
    places = [_Places(b, c, [r[1:] for r in counted if r[0] == b]) for b, c in sorted(capacities.items())]
    sent = spark.sparkContext.broadcast(places)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        takers = [p.taker() for p in sent.value]
        for batch in batches:
            parts, lengths = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for p, take in zip(sent.value, takers, strict=True):
                rows, piece, start, length, container = [], [], [], [], []
                for row, n in enumerate(lengths):
                    for k in range(max(1, -(-n // p.capacity))):
                        here = min(p.capacity, n - k * p.capacity)
                        rows.append(row)
                        piece.append(k)
                        start.append(k * p.capacity)
                        length.append(here)
                        container.append(take(parts[row], here) if here else None)
                keys = batch.column(1).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p.budget] * len(rows), pa.int32()), keys, *(pa.array(c, pa.int32()) for c in (piece, start, length)), pa.array(container, pa.int64())],
                    names=["b", "k", "piece", "start", "length", "container"],
                )

    return ordered.select("part", key, size).mapInArrow(run, schema).withColumnsRenamed({"b": budget, "k": key})


class _Places:
    """Where the items of each partition begin among the items of their length, and the plan that ranks are looked up in."""

    def __init__(self, budget: int, capacity: int, counted: list):
        """counted: (partition, length modulo the capacity, items, whole capacities in them) in order."""
        self.budget, self.capacity = budget, capacity
        histogram: dict[int, int] = {}
        self.first: dict[tuple[int, int], int] = {}  # (partition, length) -> rank of its first item
        for part, rest, items, whole in counted:
            if whole:
                self.first.setdefault((part, capacity), histogram.get(capacity, 0))
                histogram[capacity] = histogram.get(capacity, 0) + whole
            if rest:
                self.first[part, rest] = histogram.get(rest, 0)
                histogram[rest] = histogram.get(rest, 0) + items
        self.spans = solve(histogram, capacity).spans

    def taker(self) -> Callable[[int, int], int]:
        """The container of the next item of a partition and length."""
        starts = {n: [s[0] for s in of] for n, of in self.spans.items()}
        ranks: dict[tuple[int, int], int] = {}

        def take(part: int, length: int) -> int:
            rank = ranks.get((part, length))
            if rank is None:
                rank = self.first[part, length]
            ranks[part, length] = rank + 1
            lo, _, container, copies = self.spans[length][bisect.bisect_right(starts[length], rank) - 1]
            return container + (rank - lo) // copies

        return take


def pack_documents(docs: DataFrame, budgets: DataFrame, folder: str | None = None) -> DataFrame:
    """Texts of documents, sized in tokens, for each capacity of token_budgets (a fixed, small table)."""
    capacities = {r["budget_id"]: r["capacity"] for r in budgets.select("budget_id", "capacity").where("capacity is not null").distinct().collect()}
    return pack(token_counts(docs, folder=folder), capacities)
