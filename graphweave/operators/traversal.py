"""Walks over the graph: callers and callees, files that depend on each other, hierarchies, context and neighbourhoods.

All steps are equi-joins composed lazily. The few seeds of a request are limited by contract, so
they are broadcast; everything else is left to the planner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.config import MAX_ROWS
from graphweave.operators.lookup import top_per_group

def _of(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of a set of ids. A semi-join, which the planner moves below the choice of current rows."""
    return nodes.join(ids.select("id").distinct(), "id", "left_semi")


_SIDES = {"callers": ("target_id", "source_id"), "callees": ("source_id", "target_id")}


def seeds(nodes: DataFrame, name: str, n: int = 5, kind: str | None = None) -> DataFrame:
    """The first n ids with a name."""
    hit = nodes.where(F.col("name") == name)
    hit = hit.where(F.col("type") == kind) if kind else hit
    return hit.select("id").orderBy("id").limit(n)


def call_neighbours(nodes: DataFrame, edges: DataFrame, name: str, side: str, limit: int = MAX_ROWS) -> DataFrame:
    """Who calls, or is called by, the first five symbols of a name. A caller of two of them appears twice."""
    near, far = _SIDES[side]
    calls = edges.where("type = 'CALLS'").select(F.col(near).alias("seed"), F.col(far).alias("id"))
    hit = calls.join(F.broadcast(seeds(nodes, name).withColumnRenamed("id", "seed")), "seed")
    found = hit.join(_of(nodes.select("id", "name", "type", "file_path", "start_line"), hit), "id")
    return found.orderBy("file_path", "id", "seed").limit(limit).select("seed", "id", "name", "type", "file_path", "start_line")


def call_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(caller, callee, file_path) names of every call between known symbols."""
    ends = nodes.select("id", "name", "file_path")
    calls = edges.where("type = 'CALLS'").select("source_id", "target_id")
    return (
        calls.join(ends.select(F.col("id").alias("source_id"), F.col("name").alias("caller"), "file_path"), "source_id")
        .join(ends.select(F.col("id").alias("target_id"), F.col("name").alias("callee")), "target_id")
        .select("source_id", "target_id", "caller", "callee", "file_path")
    )


def call_counts(edges: DataFrame) -> DataFrame:
    """(id, callers, callees): calls into and out of each symbol, in one pass over the calls."""
    calls = edges.where("type = 'CALLS'")
    both = calls.select(F.explode(F.array(F.struct(F.col("target_id").alias("id"), F.lit(1).alias("into"), F.lit(0).alias("out")), F.struct(F.col("source_id").alias("id"), F.lit(0).alias("into"), F.lit(1).alias("out")))).alias("s"))
    return both.groupBy("s.id").agg(F.sum("s.into").alias("callers"), F.sum("s.out").alias("callees"))


def file_map(nodes: DataFrame, edges: DataFrame, path: str, limit: int = 60) -> DataFrame:
    """The symbols of a file in order of line, with calls into and out of them."""
    here = nodes.where(F.col("file_path") == path).orderBy("start_line", "id").limit(limit)
    ids = F.broadcast(here.select("id"))
    calls = edges.where("type = 'CALLS'")
    into = calls.join(ids, calls["target_id"] == ids["id"], "left_semi").groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("callers"))
    out = calls.join(ids, calls["source_id"] == ids["id"], "left_semi").groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("callees"))
    return (
        here.select("id", "name", "type", "start_line", "signature")
        .join(into, "id", "left")
        .join(out, "id", "left")
        .select("id", "name", "type", "start_line", "signature", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("callees", F.lit(0)).alias("callees"))
    )


def importees(deps: DataFrame, path: str, limit: int = MAX_ROWS) -> DataFrame:
    return deps.where(F.col("importer") == path).select(F.col("importee").alias("path")).distinct().orderBy("path").limit(limit)


def importers(deps: DataFrame, path: str, limit: int = MAX_ROWS) -> DataFrame:
    return deps.where(F.col("importee") == path).select(F.col("importer").alias("path")).distinct().orderBy("path").limit(limit)


def two_hop_dependents(deps: DataFrame, path: str, mids: int = 5, each: int = 5, limit: int = 10) -> DataFrame:
    """Files that import the first importers of a file, without the importers and the file itself."""
    first = importers(deps, path)
    middle = first.orderBy("path").limit(mids).withColumnRenamed("path", "importee")
    second = top_per_group(deps.join(F.broadcast(middle), "importee").select("importee", "importer").distinct(), ["importee"], ["importer"], each)
    found = second.select(F.col("importer").alias("path")).where(F.col("path") != path).distinct()
    return found.join(F.broadcast(first), "path", "left_anti").orderBy("path").limit(limit)


def context_edges(nodes: DataFrame, edges: DataFrame, path: str, side: str, limit: int = 30) -> DataFrame:
    """Edges of any type between a file's symbols and symbols of other files; side: incoming or outgoing."""
    near, far = ("target_id", "source_id") if side == "incoming" else ("source_id", "target_id")
    here = nodes.where(F.col("file_path") == path).select(F.col("id").alias(near), F.col("name").alias("symbol"))
    there = nodes.where(F.col("file_path") != path).select(F.col("id").alias(far), F.col("name").alias("other"), F.col("file_path").alias("other_file"))
    found = edges.select("source_id", "target_id", "type").join(here, near).join(there, far)
    return found.orderBy("other_file", far, near, "type").limit(limit).select("symbol", "type", "other", "other_file", F.col(far).alias("other_id"), F.col(near).alias("symbol_id"))


def context_symbols(nodes: DataFrame, path: str, cut: int = 120) -> DataFrame:
    rows = nodes.where(F.col("file_path") == path)
    return rows.select("id", "name", "type", "signature", F.substring("docstring", 1, cut).alias("docstring"), F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string")).alias("lines"))


def hierarchy_relations(nodes: DataFrame, edges: DataFrame, name: str, limit: int = MAX_ROWS) -> DataFrame:
    """Parents and children, one level, of the first five classes of a name."""
    first = F.broadcast(seeds(nodes, name, kind="CLASS"))
    links = edges.where("type = 'INHERITS'").select("source_id", "target_id")
    who = nodes.select("id", "name", "file_path")

    def side(near: str, far: str, relation: str) -> DataFrame:
        hit = links.join(first, links[near] == first["id"], "left_semi").select(F.col(near).alias("class_id"), F.col(far).alias("id"))
        return hit.join(_of(who, hit), "id").orderBy("name", "id", "class_id").limit(limit).select(F.lit(relation).alias("relation"), "class_id", "id", "name", "file_path")

    return side("source_id", "target_id", "parent").unionByName(side("target_id", "source_id", "child"))


def hierarchy_methods(nodes: DataFrame, edges: DataFrame, name: str, limit: int = 30) -> DataFrame:
    first = F.broadcast(seeds(nodes, name, kind="CLASS").withColumnRenamed("id", "source_id"))
    held = edges.where(F.col("type").isin("DEFINES", "CONTAINS")).join(first, "source_id").select("source_id", F.col("target_id").alias("id"))
    members = nodes.where(F.col("type").isin("METHOD", "FUNCTION")).select("id", "name", "type", "signature", "start_line")
    return held.join(_of(members, held), "id").orderBy("start_line", "id", "source_id").limit(limit).select(F.col("source_id").alias("class_id"), "id", "name", "type", "signature", "start_line")


def definition_calls(nodes: DataFrame, edges: DataFrame, hits: DataFrame, each: int = 10) -> DataFrame:
    """The first callers and callees (by name, id) of each hit, at most so many a hit and side."""
    calls = edges.where("type = 'CALLS'").select("source_id", "target_id")
    who = nodes.select("id", "name", "type")

    def side(near: str, far: str, relation: str) -> DataFrame:
        found = calls.join(hits.select(F.col("id").alias(near)), near).select(F.col(near).alias("hit"), F.col(far).alias("id")).join(who, "id")
        return top_per_group(found, ["hit"], ["name", "id"], each).select("hit", F.lit(relation).alias("relation"), "id", "name", "type")

    return side("target_id", "source_id", "caller").unionByName(side("source_id", "target_id", "callee"))


def blast_radius(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Distinct callers and callees of a set of symbols: (relation, id, name, file_path). The set may be large."""
    calls = edges.where("type = 'CALLS'").select("source_id", "target_id")
    who = nodes.select("id", "name", "file_path")
    set_ = changed.select("id").distinct()
    callers = calls.join(set_, calls["target_id"] == set_["id"], "left_semi").select(F.lit("caller").alias("relation"), F.col("source_id").alias("id"))
    callees = calls.join(set_, calls["source_id"] == set_["id"], "left_semi").select(F.lit("callee").alias("relation"), F.col("target_id").alias("id"))
    return callers.unionByName(callees).distinct().join(who, "id").select("relation", "id", "name", "file_path")


def file_subgraph(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """Every edge that touches a symbol of the file, once. Two semi-joins, as an OR of both would not be an equi-join."""
    ids = nodes.where(F.col("file_path") == path).select("id")
    rows = edges.select("id", "source_id", "target_id", "type")
    out = rows.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    into = rows.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return out.unionByName(into).distinct()


def induced_subgraph(edges: DataFrame, ids: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Edges whose both ends are in the set, optionally of some types only."""
    rows = edges.where(F.col("type").isin(kinds)) if kinds else edges
    set_ = ids.select("id").distinct()
    rows = rows.select("id", "source_id", "target_id", "type")
    return rows.join(set_.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(set_.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select("id", "source_id", "target_id", "type")


def neighbours(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id): everything one step away from the set in either direction."""
    set_ = ids.select("id")
    out = edges.join(set_.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select(F.col("target_id").alias("id"))
    into = edges.join(set_.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(F.col("source_id").alias("id"))
    return out.unionByName(into).distinct()


def ego_network(edges: DataFrame, root: DataFrame, hops: int) -> DataFrame:
    """(id, depth): the roots and all symbols within so many undirected steps, each at its least depth."""
    seen = root.select("id", F.lit(0).alias("depth"))
    front = seen.select("id")
    for depth in range(1, hops + 1):
        front = neighbours(edges, front).join(seen.select("id"), "id", "left_anti")
        seen = seen.unionByName(front.withColumn("depth", F.lit(depth)))
    return seen
