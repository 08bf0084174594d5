"""Lookups, traversals and counts over the stored graph, each with its SQL.

Requests are taken from the data (the name most functions share, the symbol called most, the file
with most symbols), so that a query asks the same at every scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.operators import live, lookup, stats, traversal
from graphweave.operators.maintain import file_hashes as hashes_of
from graphweave.sources.tables import table


class Graph:
    """The live tables of a folder; columns that a query doesn't name never leave the scan."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def nodes(self, *columns: str, match: Column | None = None) -> DataFrame:
        return live.live_nodes(table(self.spark, self.root, "nodes"), table(self.spark, self.root, "lib_nodes"), columns=list(columns) or None, match=match)

    def edges(self, *columns: str) -> DataFrame:
        return live.live_edges(table(self.spark, self.root, "edges"), columns=list(columns) or None)

    def links(self) -> DataFrame:
        return self.edges("source_id", "target_id", "type")

    def files(self) -> DataFrame:
        return hashes_of(table(self.spark, self.root, "source_files"))

    def deps(self) -> DataFrame:
        from graphweave.operators.build import file_deps

        return file_deps(self.links(), self.nodes("file_path"))

    # requests

    def common_name(self) -> str:
        rows = self.nodes("name", "type").where("type = 'FUNCTION'").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
        return rows.orderBy(F.desc("n"), "name").first()["name"]

    def called_name(self) -> str:
        calls = self.links().where("type = 'CALLS'").groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
        return calls.join(self.nodes("name"), "id").orderBy(F.desc("n"), "id").first()["name"]

    def large_file(self) -> str:
        return self.nodes("file_path").groupBy("file_path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "file_path").first()["file_path"]

    def imported_file(self) -> str:
        return self.deps().groupBy("importee").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "importee").first()["importee"]

    def base_class(self) -> str:
        kids = self.links().where("type = 'INHERITS'").groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
        return kids.join(self.nodes("name"), "id").orderBy(F.desc("n"), "id").first()["name"]


BRIEF = "id, type, name, qualified_name, file_path, start_line, end_line, signature, docstring, language"
LIVE = """n AS (SELECT * FROM (SELECT * FROM nodes UNION ALL BY NAME SELECT * FROM lib_nodes)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, created_at DESC) = 1),
e AS (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC, coalesce(metadata, '') DESC) = 1),
fh AS (SELECT file_path AS path, coalesce(sha256, '') AS sha256, file_size, language FROM source_files
  QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY scanned_at DESC) = 1),
deps AS (SELECT DISTINCT a.file_path AS importer, b.file_path AS importee FROM e JOIN n a ON a.id = e.source_id JOIN n b ON b.id = e.target_id
  WHERE e.type = 'IMPORTS' AND a.file_path <> b.file_path)"""
COMMON = "p AS (SELECT name AS q FROM n WHERE type = 'FUNCTION' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
CALLED = "p AS (SELECT n.name AS q FROM e JOIN n ON n.id = e.target_id WHERE e.type = 'CALLS' GROUP BY n.id, n.name ORDER BY count(*) DESC, n.id LIMIT 1)"
LARGE = "p AS (SELECT file_path AS q FROM n GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
IMPORTED = "p AS (SELECT importee AS q FROM deps GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
BASE = "p AS (SELECT n.name AS q FROM e JOIN n ON n.id = e.target_id WHERE e.type = 'INHERITS' GROUP BY n.id, n.name ORDER BY count(*) DESC, n.id LIMIT 1)"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None, *request: str):
    """Registers a query; its SQL gets the live tables and the request p(q) in front."""

    def add(f):
        QUERIES[name] = lambda spark, root: f(Graph(spark, root))
        if sql is not None:
            SQL[name] = f"WITH RECURSIVE {', '.join([LIVE, *request])} {sql}"
        return f

    return add


# ---------------------------------------------------------------- counts


@query("node_type_counts", "SELECT type, count(*) AS n FROM n GROUP BY 1")
def _(g):
    return stats.type_counts(g.nodes("type"))


@query("edge_type_counts", "SELECT type, count(*) AS n FROM e GROUP BY 1")
def _(g):
    return stats.type_counts(g.edges("type"))


@query("service_stats", "SELECT (SELECT count(*) FROM n) AS symbols, (SELECT count(DISTINCT file_path) FROM n) AS files_with_symbols, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM fh) AS files_hashed")
def _(g):
    return stats.totals(g.nodes("file_path"), g.edges("type"), g.files())


@query("hotspot_files", """, c AS (SELECT target_id AS id, count(*) AS c FROM e WHERE type = 'CALLS' GROUP BY 1)
SELECT file_path, count(*) AS symbols, coalesce(sum(c), 0)::BIGINT AS calls_in FROM n LEFT JOIN c USING (id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(g):
    return stats.hotspot_files(g.nodes("file_path"), g.links())


@query("languages", "SELECT DISTINCT language FROM n WHERE language IS NOT NULL")
def _(g):
    return stats.languages(g.nodes("language"))


@query("last_run", "SELECT * REPLACE (regexp_replace(repo_path, '/+$', '') AS repo_path) FROM index_runs WHERE status = 'COMPLETED' ORDER BY id DESC LIMIT 1")
def _(g):
    return stats.last_run(table(g.spark, g.root, "index_runs"), "COMPLETED")


@query("run_summary", "SELECT regexp_replace(repo_path, '/+$', '') AS repo_path, run_type, status, count(*) AS runs, sum(files_indexed)::BIGINT AS files_indexed, round(avg(duration_ms), 3) AS mean_ms FROM index_runs GROUP BY 1, 2, 3")
def _(g):
    return stats.run_summary(table(g.spark, g.root, "index_runs"))


@query("health", "SELECT 1::BIGINT AS ok")
def _(g):
    return g.spark.range(1).select((F.col("id") + 1).alias("ok"))


# ---------------------------------------------------------------- lookups


@query("get_function", f"""SELECT {BRIEF} FROM n, p WHERE type IN ('FUNCTION', 'METHOD', 'CLASS') AND (name = q OR (NOT EXISTS (SELECT 1 FROM n, p WHERE type IN ('FUNCTION', 'METHOD', 'CLASS') AND name = q)
  AND (qualified_name = q OR ends_with(qualified_name, '.' || q)))) ORDER BY length(qualified_name) NULLS LAST, id LIMIT 20""", COMMON)
def _(g):
    return lookup.get_function(g.nodes(*lookup.BRIEF), g.common_name())


@query("get_function_fallback", f"""SELECT {BRIEF} FROM n, (SELECT 'py.' || q AS f FROM p) WHERE type IN ('FUNCTION', 'METHOD', 'CLASS') AND (qualified_name = f OR ends_with(qualified_name, '.' || f))
  ORDER BY length(qualified_name) NULLS LAST, id LIMIT 20""", "p AS (SELECT name AS q FROM n WHERE type = 'FUNCTION' AND file_path LIKE '%.py' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")
def _(g):
    named = g.nodes("name", "type", "file_path").where("type = 'FUNCTION' and file_path like '%.py'").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return lookup.get_function(g.nodes(*lookup.BRIEF), "py." + named.orderBy(F.desc("n"), "name").first()["name"])


@query("get_definition", f"""SELECT CASE WHEN name = q THEN 0 WHEN qualified_name = q THEN 1 ELSE 2 END AS tier, {BRIEF} FROM n, p
  WHERE name = q OR qualified_name = q OR ends_with(qualified_name, '.' || q) ORDER BY tier, length(qualified_name) NULLS LAST, id LIMIT 5""", COMMON)
def _(g):
    return lookup.get_definition(g.nodes(*lookup.BRIEF), g.common_name())


_RANK = "CASE WHEN lower(name) = w THEN 0 WHEN starts_with(lower(name), w) THEN 1 WHEN ends_with(lower(qualified_name), '.' || w) THEN 2 ELSE 3 END"


@query("search_symbol_ranked", f"""SELECT {_RANK} AS rank, {BRIEF} FROM n, (SELECT lower(q) AS w FROM p) WHERE contains(lower(name), w) OR contains(lower(qualified_name), w) ORDER BY rank, length(name), id LIMIT 20""", COMMON)
def _(g):
    name = g.common_name()
    return lookup.search_symbol(g.nodes(*lookup.BRIEF, match=lookup.search_condition(name)), name)


@query("search_symbol_typed", f"""SELECT {_RANK} AS rank, {BRIEF} FROM n, (SELECT lower(q) AS w FROM p) WHERE type = 'METHOD' AND (contains(lower(name), w) OR contains(lower(qualified_name), w)) ORDER BY rank, length(name), id LIMIT 20""",
       "p AS (SELECT 'schema' AS q)")
def _(g):
    return lookup.search_symbol(g.nodes(*lookup.BRIEF, match=lookup.search_condition("Schema")), "Schema", kind="METHOD")


@query("search_simple", f"SELECT {BRIEF} FROM n WHERE contains(lower(name), 'ledger') OR contains(lower(qualified_name), 'ledger') ORDER BY length(name), id LIMIT 100")
def _(g):
    return lookup.search_simple(g.nodes(*lookup.BRIEF, match=lookup.search_condition("ledger")), "ledger")


@query("list_nodes_page", f"SELECT {BRIEF} FROM n WHERE type = 'METHOD' AND language = 'python' ORDER BY file_path, start_line, id LIMIT 50 OFFSET 25")
def _(g):
    return lookup.list_nodes(g.nodes(*lookup.BRIEF), "method", "python", 50, 25)


@query("node_by_id", f"SELECT {BRIEF} FROM n WHERE id = (SELECT min(id) FROM n)")
def _(g):
    return lookup.node_by_id(g.nodes(*lookup.BRIEF), g.nodes("type").agg(F.min("id").alias("m")).first()["m"])


@query("list_edges", "SELECT id, source_id, target_id, type, file_path FROM e WHERE type = 'INHERITS' ORDER BY id LIMIT 2000")
def _(g):
    return lookup.list_edges(g.edges("source_id", "target_id", "type", "file_path"), kind="INHERITS")


@query("file_symbols", f"SELECT {BRIEF} FROM n, p WHERE file_path = q ORDER BY start_line, id", LARGE)
def _(g):
    return lookup.file_symbols(g.nodes(*lookup.BRIEF), g.large_file())


@query("resolve_path", """, r AS (SELECT DISTINCT CASE WHEN h = 0 THEN path WHEN h = 1 THEN replace(path, '/', '\\') ELSE regexp_extract(path, '[^/]*/[^/]*$') END AS request
  FROM (SELECT path, length(path) % 3 AS h FROM fh)),
m AS (SELECT request, path, CASE WHEN request = path THEN 0 WHEN replace(request, '\\', '/') = path THEN 1 ELSE 2 END AS tier FROM r JOIN fh
  ON request = path OR replace(request, '\\', '/') = path OR ends_with(path, '/' || replace(request, '\\', '/')))
SELECT request, path FROM m QUALIFY row_number() OVER (PARTITION BY request ORDER BY tier, length(path), path) = 1""")
def _(g):
    paths = g.files().select("path")
    kind = F.length("path") % 3
    asked = paths.select(F.when(kind == 0, F.col("path")).when(kind == 1, F.replace("path", F.lit("/"), F.lit("\\"))).otherwise(F.regexp_extract("path", "[^/]*/[^/]*$", 0)).alias("request"))
    return lookup.resolve_paths(paths, asked)


# ---------------------------------------------------------------- traversal


_SEEDS = "s AS (SELECT id FROM n, p WHERE name = q ORDER BY id LIMIT 5)"


@query("get_callers", "SELECT e.target_id AS seed, n.id, n.name, n.type, n.file_path, n.start_line FROM e JOIN s ON s.id = e.target_id JOIN n ON n.id = e.source_id WHERE e.type = 'CALLS' ORDER BY n.file_path, n.id, seed LIMIT 20", CALLED, _SEEDS)
def _(g):
    return traversal.call_neighbours(g.nodes("name", "type", "file_path", "start_line"), g.links(), g.called_name(), "callers")


_CALLER = "p AS (SELECT n.name AS q FROM e JOIN n ON n.id = e.source_id WHERE e.type = 'CALLS' GROUP BY n.id, n.name ORDER BY count(*) DESC, n.id LIMIT 1)"


@query("get_callees", "SELECT e.source_id AS seed, n.id, n.name, n.type, n.file_path, n.start_line FROM e JOIN s ON s.id = e.source_id JOIN n ON n.id = e.target_id WHERE e.type = 'CALLS' ORDER BY n.file_path, n.id, seed LIMIT 20", _CALLER, _SEEDS)
def _(g):
    nodes = g.nodes("name", "type", "file_path", "start_line")
    most = g.links().where("type = 'CALLS'").groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    name = most.join(nodes.select("id", "name"), "id").orderBy(F.desc("n"), "id").first()["name"]
    return traversal.call_neighbours(nodes, g.links(), name, "callees")


@query("call_pairs", "SELECT e.source_id, e.target_id, a.name AS caller, b.name AS callee, a.file_path FROM e JOIN n a ON a.id = e.source_id JOIN n b ON b.id = e.target_id WHERE e.type = 'CALLS'")
def _(g):
    return traversal.call_pairs(g.nodes("name", "file_path"), g.links())


@query("call_counts", "SELECT id, sum(i)::BIGINT AS callers, sum(o)::BIGINT AS callees FROM (SELECT target_id AS id, 1 AS i, 0 AS o FROM e WHERE type = 'CALLS' UNION ALL SELECT source_id, 0, 1 FROM e WHERE type = 'CALLS') GROUP BY 1")
def _(g):
    return traversal.call_counts(g.links())


@query("file_map_counts", """SELECT h.id, h.name, h.type, h.start_line, h.signature, (SELECT count(*) FROM e WHERE e.type = 'CALLS' AND e.target_id = h.id) AS callers, (SELECT count(*) FROM e WHERE e.type = 'CALLS' AND e.source_id = h.id) AS callees
FROM (SELECT n.* FROM n, p WHERE file_path = q ORDER BY start_line, id LIMIT 60) h""", LARGE)
def _(g):
    return traversal.file_map(g.nodes("name", "type", "file_path", "start_line", "signature"), g.links(), g.large_file())


@query("related_imports", "SELECT DISTINCT importee AS path FROM deps, (SELECT importer AS q FROM deps GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) WHERE importer = q ORDER BY 1 LIMIT 20")
def _(g):
    deps = g.deps()
    return traversal.importees(deps, deps.groupBy("importer").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "importer").first()["importer"])


@query("related_importers", "SELECT DISTINCT importer AS path FROM deps, p WHERE importee = q ORDER BY 1 LIMIT 20", IMPORTED)
def _(g):
    return traversal.importers(g.deps(), g.imported_file())


@query("two_hop_dependents", """, f AS (SELECT DISTINCT importer AS path FROM deps, p WHERE importee = q ORDER BY 1 LIMIT 20), m AS (SELECT path FROM f ORDER BY 1 LIMIT 5),
t AS (SELECT importee, importer FROM deps JOIN m ON m.path = importee QUALIFY row_number() OVER (PARTITION BY importee ORDER BY importer) <= 5)
SELECT DISTINCT importer AS path FROM t, p WHERE importer <> q AND importer NOT IN (SELECT path FROM f) ORDER BY 1 LIMIT 10""", IMPORTED)
def _(g):
    return traversal.two_hop_dependents(g.deps(), g.imported_file())


@query("file_dependencies", "SELECT importer, importee FROM deps")
def _(g):
    return g.deps()


@query("context_symbols", "SELECT id, name, type, signature, substr(docstring, 1, 120) AS docstring, concat_ws('-', start_line, end_line) AS lines FROM n, p WHERE file_path = q", LARGE)
def _(g):
    return traversal.context_symbols(g.nodes("name", "type", "file_path", "signature", "docstring", "start_line", "end_line"), g.large_file())


def _context(near: str, far: str) -> str:
    return f"SELECT a.name AS symbol, e.type, b.name AS other, b.file_path AS other_file, b.id AS other_id, a.id AS symbol_id FROM e JOIN n a ON a.id = e.{near} JOIN n b ON b.id = e.{far}, p WHERE a.file_path = q AND b.file_path <> q ORDER BY b.file_path, b.id, a.id, e.type LIMIT 30"


@query("context_incoming", _context("target_id", "source_id"), LARGE)
def _(g):
    return traversal.context_edges(g.nodes("name", "file_path"), g.links(), g.large_file(), "incoming")


@query("context_outgoing", _context("source_id", "target_id"), LARGE)
def _(g):
    return traversal.context_edges(g.nodes("name", "file_path"), g.links(), g.large_file(), "outgoing")


_CLASSES = "s AS (SELECT id FROM n, p WHERE name = q AND type = 'CLASS' ORDER BY id LIMIT 5)"


@query("hierarchy_relations", """SELECT * FROM (SELECT 'parent' AS relation, e.source_id AS class_id, n.id, n.name, n.file_path FROM e JOIN s ON s.id = e.source_id JOIN n ON n.id = e.target_id WHERE e.type = 'INHERITS' ORDER BY n.name, n.id, class_id LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'child' AS relation, e.target_id AS class_id, n.id, n.name, n.file_path FROM e JOIN s ON s.id = e.target_id JOIN n ON n.id = e.source_id WHERE e.type = 'INHERITS' ORDER BY n.name, n.id, class_id LIMIT 20)""", BASE, _CLASSES)
def _(g):
    return traversal.hierarchy_relations(g.nodes("name", "type", "file_path"), g.links(), g.base_class())


@query("hierarchy_methods", "SELECT e.source_id AS class_id, n.id, n.name, n.type, n.signature, n.start_line FROM e JOIN s ON s.id = e.source_id JOIN n ON n.id = e.target_id WHERE e.type IN ('DEFINES', 'CONTAINS') AND n.type IN ('METHOD', 'FUNCTION') ORDER BY n.start_line, n.id, class_id LIMIT 30", BASE, _CLASSES)
def _(g):
    return traversal.hierarchy_methods(g.nodes("name", "type", "signature", "start_line"), g.links(), g.base_class())


@query("definition_calls_topn", """SELECT * FROM (SELECT e.target_id AS hit, 'caller' AS relation, n.id, n.name, n.type FROM e JOIN n ON n.id = e.source_id WHERE e.type = 'CALLS' QUALIFY row_number() OVER (PARTITION BY e.target_id ORDER BY n.name, n.id) <= 10)
UNION ALL SELECT * FROM (SELECT e.source_id AS hit, 'callee' AS relation, n.id, n.name, n.type FROM e JOIN n ON n.id = e.target_id WHERE e.type = 'CALLS' QUALIFY row_number() OVER (PARTITION BY e.source_id ORDER BY n.name, n.id) <= 10)""")
def _(g):
    nodes = g.nodes("name", "type")
    return traversal.definition_calls(nodes, g.links(), nodes.select("id"))


@query("blast_radius", """, c AS (SELECT id FROM n, p WHERE file_path = q AND type <> 'FILE'),
r AS (SELECT DISTINCT 'caller' AS relation, source_id AS id FROM e WHERE type = 'CALLS' AND target_id IN (SELECT id FROM c) UNION SELECT DISTINCT 'callee', target_id FROM e WHERE type = 'CALLS' AND source_id IN (SELECT id FROM c))
SELECT relation, id, name, file_path FROM r JOIN n USING (id)""", LARGE)
def _(g):
    nodes = g.nodes("name", "file_path", "type")
    return traversal.blast_radius(nodes, g.links(), nodes.where((F.col("file_path") == g.large_file()) & (F.col("type") != "FILE")))


@query("file_subgraph", "SELECT id, source_id, target_id, type FROM e WHERE source_id IN (SELECT id FROM n, p WHERE file_path = q) OR target_id IN (SELECT id FROM n, p WHERE file_path = q)", LARGE)
def _(g):
    return traversal.file_subgraph(g.nodes("file_path"), g.links(), g.large_file())


@query("induced_subgraph", "SELECT id, source_id, target_id, type FROM e WHERE type IN ('CALLS', 'USES') AND source_id IN (SELECT id FROM n WHERE type IN ('METHOD', 'VARIABLE')) AND target_id IN (SELECT id FROM n WHERE type IN ('METHOD', 'VARIABLE'))")
def _(g):
    return traversal.induced_subgraph(g.links(), g.nodes("type").where("type in ('METHOD', 'VARIABLE')"), ["CALLS", "USES"])


_EGO = """, root AS (SELECT id FROM n, p WHERE file_path = q AND type = 'FILE'),
both_ AS (SELECT source_id AS a, target_id AS b FROM e UNION SELECT target_id, source_id FROM e),
h1 AS (SELECT DISTINCT b AS id FROM both_ JOIN root ON root.id = a WHERE b NOT IN (SELECT id FROM root)),
h2 AS (SELECT DISTINCT b AS id FROM both_ JOIN h1 ON h1.id = a WHERE b NOT IN (SELECT id FROM root UNION SELECT id FROM h1))
SELECT id, 0 AS depth FROM root UNION ALL SELECT id, 1 FROM h1"""


def _ego(g, hops: int) -> DataFrame:
    root = g.nodes("file_path", "type").where((F.col("file_path") == g.large_file()) & (F.col("type") == "FILE"))
    return traversal.ego_network(g.links(), root, hops)


@query("ego_1hop", _EGO, LARGE)
def _(g):
    return _ego(g, 1)


@query("ego_2hop", _EGO + " UNION ALL SELECT id, 2 FROM h2", LARGE)
def _(g):
    return _ego(g, 2)


@query("neighbour_highlight", "SELECT DISTINCT id FROM (SELECT target_id AS id FROM e JOIN (SELECT id AS r FROM n, p WHERE file_path = q) ON r = source_id UNION ALL SELECT source_id FROM e JOIN (SELECT id AS r FROM n, p WHERE file_path = q) ON r = target_id)", LARGE)
def _(g):
    return traversal.neighbours(g.links(), g.nodes("file_path").where(F.col("file_path") == g.large_file()))
