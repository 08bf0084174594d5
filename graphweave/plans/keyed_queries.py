"""Queries of the general large-scale operators: uneven keys and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.operators import hierarchy, skew
from graphweave.sources.tables import table


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return skew.heavy_keys(table(spark, root, "edges"), share=0.01).select("target_id", "type")


def p2_key_profile(spark: SparkSession, root: str) -> DataFrame:
    return skew.key_profile(table(spark, root, "edges")).drop("split_over")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    trees = hierarchy.hierarchy(hierarchy.tree_links(table(spark, root, "edges")))
    return hierarchy.unordered_pairs(trees)


def p3_hierarchy(spark: SparkSession, root: str) -> DataFrame:
    trees = hierarchy.descendants(hierarchy.hierarchy(hierarchy.tree_links(table(spark, root, "edges"))))
    tree = F.col("cycle").isNull()
    return trees.select("node", "root", "depth", F.when(tree, F.concat_ws("/", "path")).alias("path"), F.concat_ws(",", "cycle").alias("cycle"), "on_cycle", "n_descendants")


def extra_parents(spark: SparkSession, root: str) -> DataFrame:
    """Links that are left out of trees, here of CALLS rows, where symbols have many targets."""
    return hierarchy.extra_parents(table(spark, root, "edges"), kind="CALLS")


QUERIES = {"extra_parents": extra_parents, "p2_found": p2_found, "p2_key_profile": p2_key_profile, "p3_found": p3_found, "p3_hierarchy": p3_hierarchy}

_REACH = """WITH RECURSIVE links AS (
  SELECT source_id AS s, min(target_id) AS t FROM edges
  WHERE type = 'INHERITS' AND source_id IS NOT NULL AND target_id IS NOT NULL GROUP BY 1),
reach AS (SELECT s, t FROM links UNION SELECT r.s, l.t FROM reach r JOIN links l ON r.t = l.s)"""

SQL = {
    "extra_parents": """SELECT DISTINCT source_id AS node, target_id AS parent FROM edges WHERE type = 'CALLS' AND source_id IS NOT NULL AND target_id IS NOT NULL
  QUALIFY target_id > min(target_id) OVER (PARTITION BY source_id)""",
    "p2_found": """SELECT target_id, type FROM edges GROUP BY 1, 2
HAVING count(*) >= 0.01 * (SELECT count(*) FROM edges)""",
    "p2_key_profile": """SELECT target_id, type, count(*) AS "rows", count(DISTINCT source_id) AS members FROM edges GROUP BY 1, 2""",
    "p3_found": f"{_REACH} SELECT DISTINCT least(s, t) AS node_a, greatest(s, t) AS node_b FROM reach",
    "p3_hierarchy": f"""{_REACH},
nodes_ AS (SELECT s AS node FROM links UNION SELECT t FROM links),
ring AS (SELECT s AS node FROM reach WHERE s = t),
rings AS (SELECT r.node, string_agg(b.t, ',' ORDER BY b.t) AS members FROM ring r JOIN reach b ON b.s = r.node GROUP BY 1),
below AS (SELECT n.node, coalesce(min(c.members), min(d.members), '') AS cycle FROM nodes_ n
  LEFT JOIN rings c ON c.node = n.node
  LEFT JOIN reach r ON r.s = n.node LEFT JOIN rings d ON d.node = r.t GROUP BY 1),
ups AS (SELECT s AS node, 1 AS k, t FROM links UNION ALL
  SELECT u.node, u.k + 1, l.t FROM ups u JOIN links l ON l.s = u.t JOIN below b ON b.node = u.node AND b.cycle = ''),
up AS (SELECT u.node, max(k) AS depth, string_agg(t, '/' ORDER BY k DESC) AS above, arg_max(t, k) AS root
  FROM ups u JOIN below b ON b.node = u.node WHERE b.cycle = '' GROUP BY 1),
under AS (SELECT t AS node, count(*) AS c FROM reach GROUP BY 1)
SELECT n.node, CASE WHEN n.cycle = '' THEN coalesce(u.root, n.node) END AS root,
  CASE WHEN n.cycle = '' THEN coalesce(u.depth, 0) END::INTEGER AS depth,
  CASE WHEN n.cycle = '' THEN coalesce(u.above || '/', '') || n.node END AS path,
  n.cycle, g.node IS NOT NULL AS on_cycle, coalesce(d.c, 0) AS n_descendants
FROM below n LEFT JOIN up u ON u.node = n.node LEFT JOIN ring g ON g.node = n.node LEFT JOIN under d ON d.node = n.node""",
}
