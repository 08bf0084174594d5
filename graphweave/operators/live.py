"""Current rows of tables that are written by upsert: of each id the newest row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest(df: DataFrame, key: str, *order: str, columns: list[str] | None = None, fixed: frozenset[str] = frozenset()) -> DataFrame:
    """Of each key the row with the greatest order columns. Rows without key are left out.

    Only the wanted columns take part in the shuffle, combined on the map side first, so a key with
    a large share of all rows costs one row a task. Ties are broken by the other columns. fixed are
    columns that the key determines: they are grouped by, so the planner moves filters and semi-joins
    on them and on the key below the aggregate, down to the scan.
    """
    wanted = [c for c in (columns or df.columns) if c != key]
    keys, body = [key, *[c for c in wanted if c in fixed]], [c for c in wanted if c not in fixed]
    rank = [F.col(c) for c in order] + [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in body if c not in order]
    known = df.where(F.col(key).isNotNull())
    if not body:
        return known.select(*keys).distinct()
    best = known.groupBy(*keys).agg(F.max_by(F.struct(*body), F.struct(*rank)).alias("row"))
    return best.select(*keys, "row.*").select(key, *wanted)


#: Columns that an id determines, as it is a hash over them (a name is the end of the qualified name).
NODE_FIXED = frozenset(("type", "name", "file_path"))
EDGE_FIXED = frozenset(("source_id", "target_id", "type"))


def live_nodes(*tables: DataFrame, columns: list[str] | None = None, match: Column | None = None) -> DataFrame:
    """match: a condition on any columns; only ids of which some row meets it are looked at, so the caller's own filter on the
    newest rows must imply it or be applied as well."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    if match is not None:
        rows = rows.join(rows.where(match).select("id").distinct(), "id", "left_semi")
    return newest(rows, "id", "updated_at", columns=columns, fixed=NODE_FIXED)


def live_edges(edges: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return newest(edges, "id", "created_at", columns=columns, fixed=EDGE_FIXED)
