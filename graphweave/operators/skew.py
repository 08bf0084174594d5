"""Per-key results over keys of very uneven size.

Rows are range-partitioned on the composite key and a secondary order, with bounds from sampled
quantiles. Because the secondary order takes part in the bounds, a heavy key is cut into as many
partitions as its share of the rows asks for. Each partition is sorted and folded in one pass into
one partial state per key. Only the first and the last key of a partition can continue in another
partition, so only those two states are stitched; all others are final where they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweave.session import cut, parallelism

_PARTIAL = "part int, k0 string, k1 string, n long, n_member long, first_member string, last_member string, edge boolean"


def _tagged(name: str):
    """A string that keeps null apart from every value and is never null itself."""
    return F.when(F.col(name).isNull(), F.lit("")).otherwise(F.concat(F.lit("v"), F.col(name).cast("string")))


def _untagged(name: str):
    return F.when(F.col(name) == "", F.lit(None)).otherwise(F.substring(name, 2, 2**31 - 1))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partial state per run of equal keys of a sorted partition; the first and last run are marked."""
    state: list | None = None  # part, k0, k1, n, members, first, last
    first_run = True
    for batch in batches:
        if not batch.num_rows:
            continue
        part, k0, k1, member = (batch.column(i) for i in range(4))

        def moved(a: pa.Array) -> np.ndarray:
            out = np.ones(len(a), dtype=bool)
            out[1:] = pc.not_equal(a.slice(1), a.slice(0, len(a) - 1)).to_numpy(zero_copy_only=False)
            return out

        key_moved = moved(k0) | moved(k1)
        member_moved = key_moved | moved(member)
        counted = member_moved & pc.not_equal(member, "").to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(key_moved)
        ends = np.append(starts[1:], batch.num_rows)
        rows = ends - starts
        members = np.add.reduceat(counted.astype(np.int64), starts)
        out: list[list] = []
        key0, key1 = k0.take(pa.array(starts)).to_pylist(), k1.take(pa.array(starts)).to_pylist()
        low, high = member.take(pa.array(starts)).to_pylist(), member.take(pa.array(ends - 1)).to_pylist()
        at = part[0].as_py()
        for i in range(len(starts)):
            if i == 0 and state and (state[1], state[2]) == (key0[0], key1[0]):
                same = state[6] == low[0] and low[0] != ""
                state[3] += int(rows[0])
                state[4] += int(members[0]) - same
                state[6] = high[0]
                continue
            if state:
                out.append([*state, first_run])
                first_run = False
            state = [at, key0[i], key1[i], int(rows[i]), int(members[i]), low[i], high[i]]
        if out:
            yield _batch(out)
    if state:
        yield _batch([[*state, True]])


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
    names = ["part", "k0", "k1", "n", "n_member", "first_member", "last_member", "edge"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def key_profile(df: DataFrame, key: str = "target_id", kind: str = "type", member: str = "source_id", tie: str | None = "created_at", partitions: int | None = None) -> DataFrame:
    """Rows and distinct members of each (key, kind), the heaviest keys included, with even work.

    Columns: key, kind, rows, members, split_over (partitions that held a part of the key).
    Nulls in key or kind form groups of their own; a null member counts as a row, not as a member.
    Repeated rows count as rows; an empty table gives no rows; extra columns are not read.
    tie: a further order column, so that even one (key, kind, member) of many rows can be cut.
    """
    n = partitions or parallelism(df.sparkSession)
    base = df.select(_tagged(key).alias("k0"), _tagged(kind).alias("k1"), _tagged(member).alias("m"), *([F.col(tie).alias("t")] if tie else []))
    order = ["k0", "k1", "m", *(["t"] if tie else [])]
    ranged = base.repartitionByRange(n, *order).sortWithinPartitions("k0", "k1", "m")
    partial = cut(ranged.select(F.spark_partition_id().alias("part"), "k0", "k1", "m").mapInArrow(_fold, _PARTIAL))
    inner = partial.where("not edge").select("k0", "k1", F.col("n").alias("rows"), F.col("n_member").alias("members"), F.lit(1).alias("split_over"))
    # at most two states a partition are left here
    along = Window.partitionBy("k0", "k1").orderBy("part")
    joined = partial.where("edge").withColumn("before", F.lag("last_member").over(along))
    repeats = F.coalesce((F.col("before") == F.col("first_member")) & (F.col("first_member") != ""), F.lit(False)).cast("long")
    outer = joined.groupBy("k0", "k1").agg(F.sum("n").alias("rows"), F.sum(F.col("n_member") - repeats).alias("members"), F.countDistinct("part").cast("int").alias("split_over"))
    return inner.unionByName(outer).select(_untagged("k0").alias(key), _untagged("k1").alias(kind), "rows", "members", "split_over")


def heavy_keys(df: DataFrame, share: float = 0.01, key: str = "target_id", kind: str = "type", member: str = "source_id", tie: str | None = "created_at", partitions: int | None = None) -> DataFrame:
    """The keys that hold at least the given share of all rows, from the same profile."""
    profile = key_profile(df, key, kind, member, tie, partitions)
    total = profile.agg(F.sum("rows").alias("t")).first()["t"] or 0
    # in whole numbers: 0.01 * 700 is more than 7 in floating point
    return profile.where(F.col("rows") >= F.lit(math.ceil(Fraction(str(share)) * total)))
