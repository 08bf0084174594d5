"""Parent links of unknown depth to whole hierarchies, by tree contraction.

Each round rakes the leaves of what is left of the forest and splices out an independent set of
nodes with one child, so that both bushy and thread-like trees shrink geometrically. Every removed
node is recorded with the node it hung on and the nodes spliced out between. When no tree is left,
the rounds are replayed backwards, which gives each node its root, depth and path by one equi-join
a round. A circle can't be raked away: it shrinks to one node that is its own parent, whose record
names the members.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.session import cut

_RECORD = ["v", "p", "seg"]


def tree_links(edges: DataFrame, child: str = "source_id", parent: str = "target_id", kind: str | None = "INHERITS", kind_col: str = "type") -> DataFrame:
    """Distinct links (v, p). Of several parents of a node the smallest is its tree parent; rows with a null end are no links."""
    rows = edges.where(F.col(kind_col) == kind) if kind is not None else edges
    rows = rows.select(F.col(child).alias("v"), F.col(parent).alias("p")).where("v is not null and p is not null")
    return rows.groupBy("v").agg(F.min("p").alias("p"))


def extra_parents(edges: DataFrame, child: str = "source_id", parent: str = "target_id", kind: str | None = "INHERITS", kind_col: str = "type") -> DataFrame:
    """Links left out of the trees because their child has a smaller parent as well: (node, parent)."""
    rows = edges.where(F.col(kind_col) == kind) if kind is not None else edges
    rows = rows.select(F.col(child).alias("node"), F.col(parent).alias("parent")).where("node is not null and parent is not null").distinct()
    least = rows.groupBy("node").agg(F.min("parent").alias("least"))
    return rows.join(least, "node").where("parent <> least").select("node", "parent")


def _order(name: str, salt: int):
    return F.xxhash64(F.col(name), F.lit(salt))


def _contract(links: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of records, and the core of self-parents that stays."""
    active = cut(links.select("v", "p", F.array().cast("array<string>").alias("seg")))
    rounds: list[DataFrame] = []
    left = active.count()
    turn = 0
    while left:
        turn += 1
        kids = active.groupBy("p").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("only")).withColumnRenamed("p", "v")
        seen = active.join(kids, "v", "left")
        alone = (F.col("c") == 1) & (_order("v", turn) > _order("p", turn)) & (_order("v", turn) > _order("only", turn)) & (F.col("v") != F.col("p"))
        seen = seen.withColumn("splice", F.coalesce(alone, F.lit(False)))
        over = seen.where("splice").select(F.col("only").alias("v"), F.col("p").alias("up"), F.concat("seg", F.array("v")).alias("pre"))
        moved = seen.join(over, "v", "left").select(
            "v",
            F.coalesce("up", "p").alias("p"),
            F.when(F.col("pre").isNull(), F.col("seg")).otherwise(F.concat("pre", "seg")).alias("seg"),
            F.when(F.col("splice"), F.lit(2)).when(F.col("c").isNull(), F.lit(1)).otherwise(F.lit(0)).alias("out"),
        )
        moved = cut(moved)
        active = moved.where("out = 0").select(*_RECORD)
        now = active.count()
        if now < left:
            rounds.append(moved.where("out > 0").select(*_RECORD))
        elif now == left:
            return rounds, active
        left = now
    return rounds, active


def hierarchy(links: DataFrame) -> DataFrame:
    """node, root, depth, path, cycle of each node of the links (v child, p parent).

    path runs from the root to the node itself. In or below a circle there is no root: root is
    null, path starts at the circle's representative, depth is null, and cycle lists the members
    of the circle in order; on_cycle says whether the node is one of them. No links give no rows.
    """
    links = cut(links)
    rounds, core = _contract(links)
    roots = links.select(F.col("p").alias("v")).distinct().join(links.select("v"), "v", "left_anti")
    known = roots.select("v", F.array("v").alias("path"), F.lit(None).cast("array<string>").alias("cycle"))
    circle = core.select("v", F.array("v").alias("path"), F.array_sort(F.concat("seg", F.array("v"))).alias("cycle"))
    known = cut(known.unionByName(circle))
    for record in reversed(rounds):
        found = record.join(known.select(F.col("v").alias("p"), "path", "cycle"), "p").select("v", F.concat("path", "seg", F.array("v")).alias("path"), "cycle")
        known = known.unionByName(cut(found))
    on = F.coalesce(F.array_contains("cycle", F.col("v")), F.lit(False))
    free = F.col("cycle").isNull()
    return known.select(
        F.col("v").alias("node"),
        F.when(free, F.element_at("path", 1)).alias("root"),
        F.when(free, F.size("path") - 1).alias("depth"),
        "path",
        "cycle",
        on.alias("on_cycle"),
    )


def reachable_pairs(trees: DataFrame) -> DataFrame:
    """(node, above): each node with every node that it reaches over one or more parent links."""
    above = F.when(F.col("cycle").isNull(), F.expr("slice(path, 1, size(path) - 1)")).when(F.col("on_cycle"), F.col("cycle")).otherwise(F.array_except(F.array_union("cycle", "path"), F.array("node")))
    return trees.select("node", "on_cycle", F.explode(above).alias("above"))


def unordered_pairs(trees: DataFrame) -> DataFrame:
    """Each unordered pair of nodes of which one reaches the other, once, the smaller first; node_a = node_b on a circle.

    Two nodes reach each other only within one circle, so dropping one direction there leaves each
    pair once and no distinct is needed.
    """
    pairs = reachable_pairs(trees).where("not on_cycle or node <= above")
    return pairs.select(F.least("node", "above").alias("node_a"), F.greatest("node", "above").alias("node_b"))


def descendants(trees: DataFrame) -> DataFrame:
    """node, n_descendants: how many nodes reach it; 0 for leaves. A node on a circle counts itself."""
    counted = reachable_pairs(trees).groupBy(F.col("above").alias("node")).agg(F.count(F.lit(1)).alias("n_descendants"))
    return trees.join(counted, "node", "left").withColumn("n_descendants", F.coalesce("n_descendants", F.lit(0)))
