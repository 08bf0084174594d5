"""Symbol lookups: exact and tiered names, ranked search, listings and path resolution.

Filters come on columns that are the same in all rows of an id (name, type, path), so they are
pushed to the scan before current rows are picked: a qualified name ends in the name, so its last
part filters too. Every limited answer has a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweave.config import MAX_ROWS

BRIEF = ["id", "type", "name", "qualified_name", "file_path", "start_line", "end_line", "signature", "docstring", "language"]


def _dotted(name: str) -> Column:
    return (F.col("qualified_name") == name) | F.endswith("qualified_name", F.lit("." + name))


def _last_part(name: str) -> Column:
    """Holds for every symbol that a name can mean, by the symbol's own name alone."""
    return F.col("name").isNull() | F.endswith("name", F.lit(name.rpartition(".")[2]))


def best_tier(df: DataFrame, tier: Column) -> DataFrame:
    """The rows of the lowest tier that occurs: a fallback that runs only if the better tiers are empty.

    The lowest tier is found by an aggregate and joined back as one broadcast row, so no window
    gathers all rows in one task.
    """
    tiered = df.withColumn("tier", tier).where("tier is not null")
    return tiered.join(F.broadcast(tiered.agg(F.min("tier").alias("tier"))), "tier", "left_semi")


def get_function(nodes: DataFrame, name: str, limit: int = MAX_ROWS) -> DataFrame:
    """Functions, methods and classes of a name; only if there are none, those whose qualified name ends in it."""
    code = nodes.where(F.col("type").isin("FUNCTION", "METHOD", "CLASS")).where(_last_part(name))
    tier = F.when(F.col("name") == name, 0).when(_dotted(name), 1)
    return best_tier(code, tier).orderBy(F.length("qualified_name").asc_nulls_last(), "id").limit(limit).select(*BRIEF)


def get_definition(nodes: DataFrame, name: str, limit: int = 5) -> DataFrame:
    """Any symbol of a name or qualified name: by tier (name, qualified name, its end), then by length."""
    tier = F.when(F.col("name") == name, 0).when(F.col("qualified_name") == name, 1).when(F.endswith("qualified_name", F.lit("." + name)), 2)
    found = nodes.where(_last_part(name)).withColumn("tier", tier).where("tier is not null")
    return found.orderBy("tier", F.length("qualified_name").asc_nulls_last(), "id").limit(limit).select("tier", *BRIEF)


def search_condition(query: str, wildcard: bool = False) -> Column:
    """Whether name or qualified name holds the query, in any letter case."""
    q, low, qlow = query.lower(), F.lower("name"), F.lower("qualified_name")
    if wildcard:
        return low.like(f"%{q}%") | F.coalesce(qlow.like(f"%{q}%"), F.lit(False))
    return F.contains(low, F.lit(q)) | F.coalesce(F.contains(qlow, F.lit(q)), F.lit(False))


def search_symbol(nodes: DataFrame, query: str, kind: str | None = None, limit: int = MAX_ROWS, wildcard: bool = False) -> DataFrame:
    """Symbols whose name or qualified name contains the query, in any letter case.

    rank 0: the name itself, 1: a name that starts with it, 2: a qualified name that ends in it, 3: others.
    wildcard: the query is a LIKE pattern.
    """
    q = query.lower()
    rows = nodes.where(F.col("type") == kind) if kind else nodes
    low, qlow = F.lower("name"), F.lower("qualified_name")
    rank = F.when(low == q, 0).when(F.startswith(low, F.lit(q)), 1).when(F.coalesce(F.endswith(qlow, F.lit("." + q)), F.lit(False)), 2).otherwise(3)
    return rows.where(search_condition(query, wildcard)).withColumn("rank", rank).orderBy("rank", F.length("name"), "id").limit(limit).select("rank", *BRIEF)


def search_simple(nodes: DataFrame, query: str, limit: int = 100) -> DataFrame:
    return nodes.where(search_condition(query)).orderBy(F.length("name"), "id").limit(limit).select(*BRIEF)


def list_nodes(nodes: DataFrame, kind: str | None = None, language: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of symbols by path and line."""
    rows = nodes.where(F.col("type") == kind.upper()) if kind else nodes
    rows = rows.where(F.col("language") == language) if language else rows
    return rows.orderBy("file_path", "start_line", "id").offset(offset).limit(min(limit, 500)).select(*BRIEF)


def list_edges(edges: DataFrame, source: str | None = None, target: str | None = None, kind: str | None = None, limit: int = 2000) -> DataFrame:
    for column, value in (("source_id", source), ("target_id", target), ("type", kind)):
        edges = edges.where(F.col(column) == value) if value else edges
    return edges.orderBy("id").limit(min(limit, 2000)).select("id", "source_id", "target_id", "type", "file_path")


def node_by_id(nodes: DataFrame, node: str) -> DataFrame:
    return nodes.where(F.col("id") == node).select(*BRIEF)


def file_symbols(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where(F.col("file_path") == path).orderBy("start_line", "id").select(*BRIEF)


def resolve_paths(paths: DataFrame, requests: DataFrame) -> DataFrame:
    """(request, path): each requested path as it is, else with turned slashes, else the shortest path that ends in it.

    paths(path) are the known files. Path ends are an index of their own, so that the match is an
    equi-join instead of a comparison of every pair.
    """
    known = paths.where("path is not null").select("path").distinct()
    asked = requests.select("request").distinct().withColumn("turned", F.regexp_replace("request", r"\\", "/"))
    parts = F.split("path", "/")
    ends = known.select("path", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(parts))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("turned")).where("turned <> ''")
    exact = asked.join(known, asked["request"] == known["path"]).select("request", "path", F.lit(0).alias("tier"))
    turned = asked.join(known, asked["turned"] == known["path"]).select("request", "path", F.lit(1).alias("tier"))
    ending = asked.join(ends, "turned").select("request", "path", F.lit(2).alias("tier"))
    every = exact.unionByName(turned).unionByName(ending)
    return every.groupBy("request").agg(F.min_by("path", F.struct("tier", F.length("path"), "path")).alias("path"))


def top_per_group(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    ranked = df.withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("r") <= n).drop("r")
