"""Building, maintaining and rendering: ids, the resolution ladder, differences, upserts, text and the change feed, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave import config
from graphweave.operators import build, diff, live, lookup, maintain, semantic, text, tree
from graphweave.plans.graph_queries import LIVE, Graph
from graphweave.schema import edge_id, node_id
from graphweave.sources import repo
from graphweave.sources.tables import table
from graphweave.streaming import changes

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None, *request: str, live_tables: bool = False):
    def add(f):
        QUERIES[name] = lambda spark, root: f(Graph(spark, root))
        if sql is not None:
            front = ([LIVE] if live_tables else []) + list(request)
            SQL[name] = f"WITH {', '.join(front)} {sql}" if front else sql
        return f

    return add


def _t(g, name: str) -> DataFrame:
    return table(g.spark, g.root, name)


# ---------------------------------------------------------------- ids and edges


@query("node_ids", "SELECT DISTINCT id, substr(sha256(file_path || '::' || qualified_name || '::' || type), 1, 32) AS computed FROM nodes WHERE qualified_name IS NOT NULL")
def _(g):
    return _t(g, "nodes").where("qualified_name is not null").select("id", node_id(F.col("file_path"), F.col("qualified_name"), F.col("type")).alias("computed")).distinct()


@query("edge_ids", "SELECT DISTINCT id, substr(sha256(source_id || '->' || target_id || '::' || type), 1, 32) AS computed FROM edges")
def _(g):
    return _t(g, "edges").select("id", edge_id(F.col("source_id"), F.col("target_id"), F.col("type")).alias("computed")).distinct()


@query("edge_dedup", "SELECT id, source_id, target_id, type, metadata, created_at FROM edges QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC, coalesce(metadata, '') DESC) = 1")
def _(g):
    return live.live_edges(_t(g, "edges"), columns=["source_id", "target_id", "type", "metadata", "created_at"])


#: Raw targets made from the live graph, so that every rung has work: by the target's line the whole
#: qualified name, its end from the file name on, a name behind 'self.', or a name nobody has.
_RAW = """pn AS (SELECT id, type, name, qualified_name, file_path FROM n),
pe AS (SELECT DISTINCT a.qualified_name AS source_qualified, a.file_path, e.type, CASE WHEN e.type NOT IN ('CALLS', 'INHERITS', 'IMPORTS') THEN b.qualified_name
  ELSE CASE b.start_line % 4 WHEN 0 THEN b.qualified_name WHEN 1 THEN regexp_replace(b.qualified_name, '^[^.]*\\.', '') WHEN 2 THEN 'self.' || b.name ELSE 'nosuch.' || b.name || '_x' END END AS target_qualified
  FROM e JOIN n a ON a.id = e.source_id JOIN n b ON b.id = e.target_id WHERE a.qualified_name IS NOT NULL AND b.qualified_name IS NOT NULL),
"""
_RUNGS = """lo AS (SELECT file_path, qualified_name, min(id) AS id FROM pn WHERE qualified_name IS NOT NULL GROUP BY 1, 2),
src AS (SELECT pe.*, lo.id AS source_id, regexp_replace(target_qualified, '^(self|cls)\\.', '') AS wanted FROM pe JOIN lo ON lo.file_path = pe.file_path AND lo.qualified_name = pe.source_qualified),
t0 AS (SELECT s.*, lo.id AS t0 FROM src s LEFT JOIN lo ON lo.file_path = s.file_path AND lo.qualified_name = s.target_qualified),
t1 AS (SELECT t0.*, w.id AS t1 FROM t0 LEFT JOIN (SELECT qualified_name, min(id) AS id FROM lo GROUP BY 1) w ON w.qualified_name = t0.wanted),
ends_ AS (SELECT id, qualified_name, array_to_string(string_split(qualified_name, '.')[i + 1 :], '.') AS suffix FROM (SELECT id, qualified_name, unnest(range(1, len(string_split(qualified_name, '.')))) AS i FROM pn WHERE qualified_name IS NOT NULL)),
t2 AS (SELECT t1.*, w.id AS t2 FROM t1 LEFT JOIN (SELECT suffix, id FROM ends_ QUALIFY row_number() OVER (PARTITION BY suffix ORDER BY length(qualified_name), qualified_name, id) = 1) w ON w.suffix = t1.wanted AND contains(t1.wanted, '.')),
t3 AS (SELECT t2.*, w.id AS t3 FROM t2 LEFT JOIN (SELECT name, min(id) AS id FROM pn WHERE qualified_name IS NOT NULL GROUP BY 1 HAVING count(*) = 1) w ON w.name = string_split(t2.wanted, '.')[-1]),
r AS (SELECT source_id, type, file_path, CASE WHEN t0 IS NOT NULL THEN t0 WHEN type IN ('CALLS', 'INHERITS', 'IMPORTS') THEN coalesce(t1, t2, t3) END AS target_id,
  CASE WHEN t0 IS NOT NULL THEN 0 WHEN t1 IS NOT NULL THEN 1 WHEN t2 IS NOT NULL THEN 2 ELSE 3 END AS rung FROM t3)"""
_PARSED = """pn AS (SELECT DISTINCT substr(sha256(file_path || '::' || qualified_name || '::' || type), 1, 32) AS id, type, name, qualified_name, file_path
  FROM (SELECT unnest(nodes, recursive := true) FROM (SELECT nodes FROM parse_results)) WHERE qualified_name IS NOT NULL AND file_path IS NOT NULL AND type IS NOT NULL),
pe AS (SELECT DISTINCT source_qualified, target_qualified, type, file_path FROM (SELECT unnest(edges, recursive := true) FROM (SELECT edges FROM parse_results)) WHERE source_qualified IS NOT NULL AND target_qualified IS NOT NULL),
"""


def _from_graph(g) -> DataFrame:
    nodes = g.nodes("type", "name", "qualified_name", "file_path", "start_line")
    a = nodes.where("qualified_name is not null").select(F.col("id").alias("source_id"), F.col("qualified_name").alias("source_qualified"), "file_path")
    b = nodes.where("qualified_name is not null").select(F.col("id").alias("target_id"), F.col("qualified_name").alias("q"), F.col("name").alias("b"), (F.col("start_line") % 4).alias("k"))
    k = F.col("k")
    text_ = F.when(~F.col("type").isin(*build.GLOBAL_TYPES) | (k == 0), F.col("q")).when(k == 1, F.regexp_replace("q", r"^[^.]*\.", "")).when(k == 2, F.concat(F.lit("self."), "b")).otherwise(F.concat(F.lit("nosuch."), "b", F.lit("_x")))
    raw = g.links().select("source_id", "target_id", "type").join(a, "source_id").join(b, "target_id").select("source_qualified", text_.alias("target_qualified"), "type", "file_path").distinct()
    return build.resolve_targets(raw, nodes)


def _resolved(g) -> DataFrame:
    results = _t(g, "parse_results")
    return build.resolve_targets(build.parsed_edges(results), build.parsed_nodes(results))


@query("ladder_all", "SELECT source_id, target_id, type, file_path, rung FROM r WHERE target_id IS NOT NULL", _RAW + _RUNGS, live_tables=True)
def _(g):
    return _from_graph(g)


for _rung, _name in enumerate(("ladder_local", "ladder_global_name", "ladder_suffix", "ladder_unique_name")):

    @query(_name, f"SELECT source_id, target_id, type FROM r WHERE target_id IS NOT NULL AND rung = {_rung}", _RAW + _RUNGS, live_tables=True)
    def _(g, rung=_rung):
        return _from_graph(g).where(F.col("rung") == rung).select("source_id", "target_id", "type")


@query("graph_edges", "SELECT substr(sha256(source_id || '->' || target_id || '::' || type), 1, 32) AS id, source_id, target_id, type, min(file_path) AS file_path, count(*) AS attempts FROM r WHERE target_id IS NOT NULL GROUP BY source_id, target_id, type", _PARSED + _RUNGS)
def _(g):
    return build.graph_edges(_resolved(g))


@query("parsed_nodes", "SELECT id, type, name, qualified_name, file_path FROM pn", _PARSED.rstrip(",\n"))
def _(g):
    return build.parsed_nodes(_t(g, "parse_results")).select("id", "type", "name", "qualified_name", "file_path")


_IMPORTS = r"""rp AS (SELECT file_path, max(repo_path) AS repo_path FROM source_files GROUP BY 1),
im AS (SELECT DISTINCT file_path AS importer, repo_path, unnest(import_paths) AS import_path FROM parse_results LEFT JOIN rp USING (file_path)),
s AS (SELECT *, regexp_replace(importer, '/[^/]*$', '') AS folder, starts_with(import_path, './') OR starts_with(import_path, '../') AS slashed, length(regexp_extract(import_path, '^(\.+)', 1)) AS dots FROM im WHERE import_path <> ''),
u AS (SELECT *, CASE WHEN slashed THEN len(string_split(import_path, '../')) - 1 WHEN dots > 0 THEN dots - 1 END AS up,
  CASE WHEN slashed THEN regexp_replace(import_path, '^(\.\.?/)+', '') ELSE replace(regexp_replace(import_path, '^\.+', ''), '.', '/') END AS rest FROM s),
b AS (SELECT importer, import_path, rest, CASE WHEN up IS NOT NULL THEN [array_to_string(string_split(folder, '/')[1 : greatest(0, len(string_split(folder, '/')) - up)], '/')] ELSE [repo_path, repo_path || '/src', folder] END AS bases FROM u),
c AS (SELECT importer, import_path, rest, bases[k] AS base, k - 1 AS b FROM (SELECT *, unnest(range(1, len(bases) + 1)) AS k FROM b) WHERE bases[k] IS NOT NULL),
x AS (SELECT importer, import_path, base || CASE WHEN rest = '' THEN '' ELSE '/' || rest END || ending AS path, b * 100 + e AS priority FROM c,
  (VALUES (0, '.py'), (1, '.ts'), (2, '.tsx'), (3, '.js'), (4, '.jsx'), (5, '/index.py'), (6, '/index.ts'), (7, '/index.tsx'), (8, '/index.js'), (9, '/index.jsx'), (10, '/__init__.py')) t(e, ending))"""


#: Besides the imports as parsed, relative ones made from the files that import each other: up to the nearest folder that
#: holds both, with dots for Python and slashes else.
_RELATIVE = r"""rp AS (SELECT file_path, max(repo_path) AS repo_path FROM source_files GROUP BY 1),
up_ AS (SELECT importer, importee, k, array_to_string(string_split(importer, '/')[1 : len(string_split(importer, '/')) - 1 - k], '/') AS base FROM (SELECT *, unnest(range(0, len(string_split(importer, '/')) - 2)) AS k FROM deps)),
near_ AS (SELECT importer, k, regexp_replace(importee[length(base) + 2 :], '\.[^./]*$', '') AS stem FROM up_ WHERE starts_with(importee, base || '/') QUALIFY row_number() OVER (PARTITION BY importer, importee ORDER BY k) = 1),
im AS (SELECT file_path AS importer, repo_path, unnest(import_paths) AS import_path FROM parse_results LEFT JOIN rp USING (file_path)
  UNION SELECT importer, repo_path, CASE WHEN lower(importer) LIKE '%.py' THEN repeat('.', k::INTEGER + 1) || replace(stem, '/', '.') WHEN k = 0 THEN './' || stem ELSE repeat('../', k::INTEGER) || stem END FROM near_ LEFT JOIN rp ON rp.file_path = importer),
"""


@query("import_resolution", "SELECT importer, import_path, path AS importee FROM x WHERE path IN (SELECT file_path FROM source_files) QUALIFY row_number() OVER (PARTITION BY importer, import_path ORDER BY priority, path) = 1", _RELATIVE + _IMPORTS[_IMPORTS.index("s AS ("):], live_tables=True)
def _(g):
    files = _t(g, "source_files")
    repos = files.groupBy(F.col("file_path").alias("importer")).agg(F.max("repo_path").alias("repo_path"))
    parsed = _t(g, "parse_results").select(F.col("file_path").alias("importer"), F.explode("import_paths").alias("import_path"))
    parts = F.split("importer", "/")
    steps = g.deps().select("importer", "importee", F.explode(F.sequence(F.lit(0), F.size(parts) - 3)).alias("k"))
    base = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1 - F.col("k")), "/")
    near = steps.withColumn("base", base).where(F.startswith("importee", F.concat("base", F.lit("/")))).groupBy("importer", "importee").agg(F.min_by(F.struct("k", "base"), "k").alias("s"))
    stem = F.regexp_replace(F.expr("substring(importee, length(s.base) + 2)"), r"\.[^./]*$", "")
    k = F.col("s.k")
    path = F.when(F.lower("importer").like("%.py"), F.concat(F.expr("repeat('.', s.k + 1)"), F.translate(stem, "/", "."))).when(k == 0, F.concat(F.lit("./"), stem)).otherwise(F.concat(F.expr("repeat('../', s.k)"), stem))
    made = near.select("importer", path.alias("import_path"))
    imports = parsed.unionByName(made).distinct().join(repos, "importer", "left")
    return build.resolve_imports(imports, files.select(F.col("file_path").alias("path")))


#: Imports made from the files that import each other, as dotted paths from the repository or from its src folder.
_MADE = """rp AS (SELECT path AS importer, array_to_string(string_split(path, '/')[1 : 4], '/') AS repo_path FROM fh),
im AS (SELECT DISTINCT importer, repo_path, replace(CASE WHEN length(importee) % 2 = 0 THEN regexp_replace(stem, '^src/', '') ELSE stem END, '/', '.') AS import_path FROM (SELECT *, regexp_replace(importee[length(repo_path) + 2 :], '\\.[^.]*$', '') AS stem FROM deps JOIN rp USING (importer) WHERE starts_with(importee, repo_path || '/'))),
"""


@query("import_resolution_absolute", "SELECT importer, import_path, path AS importee FROM x WHERE path IN (SELECT file_path FROM source_files) QUALIFY row_number() OVER (PARTITION BY importer, import_path ORDER BY priority, path) = 1", _MADE + _IMPORTS[_IMPORTS.index("s AS ("):], live_tables=True)
def _(g):
    repo_ = F.array_join(F.slice(F.split("importer", "/"), 1, 4), "/")
    rows = g.deps().withColumn("repo_path", repo_).where(F.startswith("importee", F.concat("repo_path", F.lit("/"))))
    below = F.expr("substring(importee, length(repo_path) + 2)")
    stem = F.regexp_replace(below, r"\.[^.]*$", "")
    path = F.translate(F.when(F.length("importee") % 2 == 0, F.regexp_replace(stem, "^src/", "")).otherwise(stem), "/", ".")
    return build.resolve_imports(rows.select("importer", "repo_path", path.alias("import_path")).distinct(), _t(g, "source_files").select(F.col("file_path").alias("path")))


@query("build_totals", """SELECT count(*) AS files, coalesce(sum(CASE WHEN trim(error) <> '' THEN 1 ELSE 0 END), 0)::BIGINT AS errors, coalesce(sum(coalesce(len(nodes), 0)), 0)::BIGINT AS symbols, coalesce(sum(coalesce(len(edges), 0)), 0)::BIGINT AS edges FROM parse_results""")
def _(g):
    return maintain.build_totals(_t(g, "parse_results"))


# ---------------------------------------------------------------- scanning rules


@query("language_histogram", """SELECT CASE lower(regexp_extract(file_path, '\\.([^./]+)$', 1)) WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' ELSE 'unknown' END AS language, count(DISTINCT file_path) AS files FROM source_files GROUP BY 1""")
def _(g):
    return repo.language_histogram(_t(g, "source_files"))


_FOLDERS = ", ".join(f"'{d}'" for d in config.IGNORED_FOLDERS)


@query("ignore_rules", rf"""SELECT file_path, NOT (len(list_filter(string_split(file_path, '/')[1 : -2], lambda d: d IN ({_FOLDERS}, 'tools') OR (starts_with(d, '.') AND d NOT IN ('.', '..')))) > 0)
 AND NOT regexp_matches(regexp_extract(file_path, '[^/]*$'), '^.*_1.*$') AS kept FROM (SELECT DISTINCT file_path FROM source_files)""")
def _(g):
    path = F.col("file_path")
    kept = ~repo.ignored_folder(path, (*config.IGNORED_FOLDERS, "tools")) & ~repo.ignored_name(path, ("*_1*",))
    return _t(g, "source_files").select("file_path").distinct().select("file_path", kept.alias("kept"))


@query("wide_language_histogram", """SELECT CASE lower(regexp_extract(file_path, '\\.([^./]+)$', 1)) WHEN 'md' THEN 'unknown' WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' ELSE 'unknown' END AS language, count(DISTINCT file_path) AS files FROM (SELECT file_path FROM source_files UNION SELECT file_path FROM documents WHERE file_path IS NOT NULL) GROUP BY 1""")
def _(g):
    files = _t(g, "source_files").select("file_path").union(_t(g, "documents").where("file_path is not null").select("file_path"))
    return repo.language_histogram(files, config.WIDE_EXTENSIONS)


@query("content_hashes", "SELECT DISTINCT file_path, sha256(content) AS computed FROM source_files WHERE content IS NOT NULL")
def _(g):
    return _t(g, "source_files").where("content is not null").select("file_path", F.sha2("content", 256).alias("computed")).distinct()


# ---------------------------------------------------------------- maintenance

#: The stored state that the maintenance queries start from: every seventh file unknown, every fifth changed since.
_STORED = """st AS (SELECT path, CASE WHEN length(path) % 5 = 0 THEN 'old' ELSE sha256 END AS sha256 FROM fh WHERE length(path) % 7 <> 0),
d AS (SELECT fh.path, CASE WHEN st.path IS NULL THEN 'new' ELSE 'changed' END AS reason FROM fh LEFT JOIN st USING (path) WHERE fh.sha256 <> '' AND (st.path IS NULL OR st.sha256 <> fh.sha256))"""


def _dirty(g) -> DataFrame:
    now = g.files()
    n = F.length("path")
    stored = now.where(n % 7 != 0).select("path", F.when(n % 5 == 0, "old").otherwise(F.col("sha256")).alias("sha256"))
    return maintain.dirty_files(now, stored)


@query("hash_dirty_set", "SELECT path, reason FROM d", _STORED, live_tables=True)
def _(g):
    return _dirty(g)


@query("dirty_expand_one_hop", "SELECT path FROM d UNION SELECT importer FROM deps WHERE importee IN (SELECT path FROM d)", _STORED, live_tables=True)
def _(g):
    return maintain.expand_dirty(_dirty(g), g.deps())


@query("deleted_files", "SELECT path FROM fh WHERE path NOT IN (SELECT path FROM fh WHERE length(path) % 7 <> 0)", live_tables=True)
def _(g):
    now = g.files()
    return maintain.deleted_files(now.where(F.length("path") % 7 != 0), now)


_UPSERT = """nw AS (SELECT id, type, name, file_path, 'changed' AS docstring, TIMESTAMP '2030-01-01' AS created_at, TIMESTAMP '2030-01-01' AS updated_at FROM n WHERE start_line % 3 = 0
  UNION ALL SELECT 'new-' || id, type, name, file_path, docstring, TIMESTAMP '2030-01-01', TIMESTAMP '2030-01-01' FROM n WHERE type = 'CLASS')"""


@query("upsert_nodes", """SELECT n.id, n.type, n.name, n.file_path, n.docstring, n.created_at, n.updated_at FROM n WHERE id NOT IN (SELECT id FROM nw)
UNION ALL SELECT nw.id, nw.type, nw.name, nw.file_path, nw.docstring, coalesce(n.created_at, nw.created_at), nw.updated_at FROM nw LEFT JOIN n USING (id)""", _UPSERT, live_tables=True)
def _(g):
    old = g.nodes("type", "name", "file_path", "docstring", "created_at", "updated_at", "start_line")
    at = F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")
    body = ["id", "type", "name", "file_path", "docstring", "created_at", "updated_at"]
    stamped = old.withColumn("created_at", at).withColumn("updated_at", at)
    new = stamped.where("start_line % 3 = 0").withColumn("docstring", F.lit("changed")).select(*body).unionByName(stamped.where("type = 'CLASS'").withColumn("id", F.concat(F.lit("new-"), "id")).select(*body))
    return maintain.upsert(old.select(*body), new, keep=["created_at"], stamp="updated_at")


_NEW_EDGES = """nw AS (SELECT id, source_id, target_id, type, '{\"n\": 2}' AS metadata, 'moved/' || file_path AS file_path, TIMESTAMP '2030-01-01' AS created_at FROM e WHERE type = 'USES'
  UNION ALL SELECT 'new-' || id, target_id, source_id, 'CALLS', NULL, NULL, TIMESTAMP '2030-01-01' FROM e WHERE type = 'INHERITS')"""


@query("upsert_edges", """SELECT id, source_id, target_id, type, metadata, file_path, created_at FROM e WHERE id NOT IN (SELECT id FROM nw)
UNION ALL SELECT nw.id, nw.source_id, nw.target_id, nw.type, nw.metadata, nw.file_path, coalesce(e.created_at, nw.created_at) FROM nw LEFT JOIN e USING (id)""", _NEW_EDGES, live_tables=True)
def _(g):
    old = g.edges("source_id", "target_id", "type", "metadata", "file_path", "created_at")
    at, none = F.lit("2030-01-01 00:00:00").cast("timestamp_ntz"), F.lit(None).cast("string")
    again = old.where("type = 'USES'").withColumns({"metadata": F.lit('{"n": 2}'), "file_path": F.concat(F.lit("moved/"), "file_path"), "created_at": at})
    swapped = old.where("type = 'INHERITS'").select(F.concat(F.lit("new-"), "id").alias("id"), F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), F.lit("CALLS").alias("type"), none.alias("metadata"), none.alias("file_path"), at.alias("created_at"))
    return maintain.upsert(old, again.unionByName(swapped), keep=["created_at"], stamp="created_at")


@query("upsert_file_hashes", """SELECT path, sha256, file_size FROM fh WHERE length(path) % 4 <> 0 UNION ALL SELECT path, 'x' || sha256, file_size + 1 FROM fh WHERE length(path) % 4 = 0 UNION ALL SELECT path || '.new', sha256, file_size FROM fh WHERE length(path) % 6 = 0""", live_tables=True)
def _(g):
    old = g.files().select("path", "sha256", "file_size")
    n = F.length("path")
    changed = old.where(n % 4 == 0).select("path", F.concat(F.lit("x"), "sha256").alias("sha256"), (F.col("file_size") + 1).alias("file_size"))
    added = old.where(n % 6 == 0).withColumn("path", F.concat("path", F.lit(".new")))
    return maintain.upsert(old, changed.unionByName(added), key="path")


@query("delete_cascade", """, gone AS (SELECT path FROM fh WHERE length(path) % 11 = 0), kn AS (SELECT id FROM n WHERE file_path NOT IN (SELECT path FROM gone))
SELECT id, source_id, target_id, type FROM e WHERE (file_path IS NULL OR file_path NOT IN (SELECT path FROM gone)) AND source_id IN (SELECT id FROM kn) AND target_id IN (SELECT id FROM kn)""".lstrip(", "), "x_ AS (SELECT 1)", live_tables=True)
def _(g):
    gone = g.files().where(F.length("path") % 11 == 0)
    return maintain.delete_files(g.nodes("file_path"), g.edges("source_id", "target_id", "type", "file_path"), gone)[1].select("id", "source_id", "target_id", "type")


SQL["delete_cascade"] = SQL["delete_cascade"].replace("x_ AS (SELECT 1) gone", "gone")


@query("replace_deps", """SELECT importer, importee FROM deps WHERE importer NOT IN (SELECT path FROM fh WHERE length(path) % 2 = 0)
UNION SELECT path, importee FROM fh JOIN (SELECT DISTINCT importer, importee FROM deps) ON importer = path WHERE length(path) % 2 = 0 AND length(importee) % 2 = 0""", live_tables=True)
def _(g):
    deps = g.deps()
    rebuilt = g.files().where(F.length("path") % 2 == 0).select("path")
    return maintain.replace_deps(deps, rebuilt, deps.where((F.length("importer") % 2 == 0) & (F.length("importee") % 2 == 0)))


@query("run_states", """SELECT id, status, "at" FROM (SELECT id, 'RUNNING' AS status, started_at AS "at" FROM index_runs UNION ALL SELECT id, status, completed_at FROM index_runs WHERE completed_at IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY id ORDER BY "at" DESC, status DESC) = 1""")
def _(g):
    runs = _t(g, "index_runs")
    first = runs.select("id", F.lit("RUNNING").alias("status"), F.lit(None).cast("string").alias("error_message"), F.col("started_at").alias("at"))
    last = runs.where("completed_at is not null").select("id", "status", "error_message", F.col("completed_at").alias("at"))
    return maintain.run_states(first.unionByName(last)).select("id", "status", "at")


# ---------------------------------------------------------------- diff


@query("diff_overlap", """, rg AS (SELECT DISTINCT file_path, start_line + 2 AS lo, start_line + 6 AS hi FROM n WHERE type = 'CLASS')
SELECT DISTINCT id, name, type, file_path, start_line, end_line, signature FROM n JOIN rg USING (file_path) WHERE type <> 'FILE' AND start_line <= hi AND end_line >= lo""".lstrip(", "), "y_ AS (SELECT 1)", live_tables=True)
def _(g):
    nodes = g.nodes("name", "type", "file_path", "start_line", "end_line", "signature")
    ranges = nodes.where("type = 'CLASS'").select(F.col("file_path").alias("file"), (F.col("start_line") + 2).alias("start_line"), (F.col("start_line") + 6).alias("end_line"))
    return diff.overlapping(nodes, ranges)


SQL["diff_overlap"] = SQL["diff_overlap"].replace("y_ AS (SELECT 1) rg", "rg")

@query("diff_context", """rg AS (SELECT DISTINCT file_path, start_line + 2 AS lo, start_line + 6 AS hi FROM n WHERE type IN ('CLASS', 'FILE')),
tc AS (SELECT file_path, count(DISTINCT id) AS symbols FROM n JOIN rg USING (file_path) WHERE type <> 'FILE' AND start_line <= hi AND end_line >= lo GROUP BY 1)
SELECT DISTINCT file_path AS file, coalesce(symbols, 0) AS symbols FROM rg LEFT JOIN tc USING (file_path)""", "v_ AS (SELECT 1)", live_tables=True)
def _(g):
    nodes = g.nodes("name", "type", "file_path", "start_line", "end_line", "signature")
    ranges = nodes.where("type in ('CLASS', 'FILE')").select(F.col("file_path").alias("file"), (F.col("start_line") + 2).alias("start_line"), (F.col("start_line") + 6).alias("end_line"))
    return diff.diff_context(nodes, ranges)


SQL["diff_context"] = SQL["diff_context"].replace("v_ AS (SELECT 1) rg AS", "rg AS")

#: Every file's diff made from its symbols' lines, so that the parser has a whole corpus of diffs.
_DIFFS = """df AS (SELECT file_path AS diff_id, 'diff --git a' || file_path || ' b' || file_path || chr(10) || 'index 1..2' || chr(10) || string_agg('@@ -' || start_line || ' +' || start_line || CASE WHEN start_line % 3 = 0 THEN '' ELSE ',' || (start_line % 4) END || ' @@ x', chr(10) ORDER BY start_line, id) AS text FROM n WHERE type <> 'FILE' GROUP BY 1),
ln AS (SELECT diff_id, i, string_split(text, chr(10))[i] AS line FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM df)),
mk AS (SELECT *, last_value(CASE WHEN starts_with(line, 'diff --git ') THEN regexp_extract(line, '^diff --git a/.* b/(.*)$', 1) END IGNORE NULLS) OVER (PARTITION BY diff_id ORDER BY i) AS file FROM ln)"""


@query("diff_hunks", r"""SELECT diff_id, file, regexp_extract(line, '\+(\d+)', 1)::INTEGER AS start_line, (regexp_extract(line, '\+(\d+)', 1)::INTEGER + greatest(1, coalesce(nullif(regexp_extract(line, '\+\d+,(\d+)', 1), '')::INTEGER, 1)) - 1)::INTEGER AS end_line FROM mk WHERE starts_with(line, '@@ ')""", _DIFFS, live_tables=True)
def _(g):
    line = F.col("start_line")
    many = F.when(line % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(","), (line % 4).cast("string")))
    hunk = F.concat(F.lit("@@ -"), line.cast("string"), F.lit(" +"), line.cast("string"), many, F.lit(" @@ x"))
    rows = g.nodes("type", "file_path", "start_line").where("type <> 'FILE'")
    lines = rows.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("start_line", "id", hunk.alias("h")))).alias("hs"))
    head = F.concat(F.lit("diff --git a"), "file_path", F.lit(" b"), "file_path", F.lit("\nindex 1..2\n"))
    return diff.hunks(lines.select(F.col("file_path").alias("diff_id"), F.concat(head, F.array_join(F.transform("hs", lambda s: s["h"]), "\n")).alias("text")))


# ---------------------------------------------------------------- text


@query("snippet", """, l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL)
SELECT doc_id, substr(rtrim(array_to_string(CASE WHEN len(a) <= 10 THEN a ELSE list_concat(a[1:5], ['… (' || (len(a) - 8) || ' more lines)'], a[-3:]) END, chr(10)), ' '), 1, 2000) AS snippet FROM l""".lstrip(", "), "z_ AS (SELECT 1)")
def _(g):
    return _t(g, "documents").where("text is not null").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


SQL["snippet"] = SQL["snippet"].replace("z_ AS (SELECT 1) l AS", "l AS")


@query("embed_text", "SELECT id, concat_ws(' | ', coalesce(CASE WHEN trim(qualified_name, ' ') <> '' THEN qualified_name END, name), CASE WHEN trim(signature, ' ') <> '' THEN signature END, CASE WHEN trim(substr(docstring, 1, 240), ' ') <> '' THEN substr(docstring, 1, 240) END) AS text FROM n", live_tables=True)
def _(g):
    return g.nodes("qualified_name", "name", "signature", "docstring").select("id", text.embedding_text(F.col("qualified_name"), F.col("name"), F.col("signature"), F.col("docstring")).alias("text"))


@query("token_counts", "SELECT doc_id, CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END::INTEGER AS tokens FROM documents")
def _(g):
    return _t(g, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


_LINES = """l AS (SELECT doc_id, i AS line_no, string_split(text, chr(10))[i + 1] AS line FROM (SELECT doc_id, text, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL)),
c AS (SELECT *, CASE WHEN length(line) = 0 THEN 0 ELSE greatest(1, length(line) // 4) END + 1 AS cost FROM l),
w AS (SELECT *, sum(cost) OVER (PARTITION BY doc_id ORDER BY line_no) AS run, sum(length(line) + 1) OVER (PARTITION BY doc_id) - 1 AS chars FROM c),
k AS (SELECT *, CASE WHEN chars = 0 THEN 0 ELSE greatest(1, chars // 4) END <= 400 AS fits FROM w)"""


@query("budget_prefix", "SELECT doc_id, line_no, CASE WHEN fits OR run <= 388 THEN line ELSE substr(line, 1, 1560) END AS line, NOT fits AS cut FROM k WHERE fits OR run <= 388 OR line_no = 0", _LINES)
def _(g):
    lines = _t(g, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return text.budget_lines(lines, "doc_id", "line_no", "line", 400)


@query("short_paths", "SELECT DISTINCT file_path, array_to_string(string_split(file_path, '/')[-3:], '/') AS short FROM n", live_tables=True)
def _(g):
    return g.nodes("file_path").select("file_path", text.short_path(F.col("file_path")).alias("short")).distinct()


@query("dir_tree_counts", """, f AS (SELECT path, coalesce(c, 0) AS c FROM fh LEFT JOIN (SELECT file_path AS path, count(*) AS c FROM n WHERE type <> 'FILE' GROUP BY 1) USING (path)),
x AS (SELECT array_to_string(string_split(path, '/')[1 : i], '/') AS folder, (i - 1)::INTEGER AS depth, c FROM (SELECT *, unnest(range(1, len(string_split(path, '/')))) AS i FROM f))
SELECT folder, depth, count(*) AS files, sum(c)::BIGINT AS symbols FROM x WHERE folder <> '' GROUP BY 1, 2""".lstrip(", "), "w_ AS (SELECT 1)", live_tables=True)
def _(g):
    return tree.folders(g.files().select("path"), g.nodes("type", "file_path"))


SQL["dir_tree_counts"] = SQL["dir_tree_counts"].replace("w_ AS (SELECT 1) f AS", "f AS")


_COLLAPSED = """, ch AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1 : i - 1], '/') AS folder, string_split(path, '/')[i] AS child, i < len(string_split(path, '/')) AS is_folder FROM (SELECT path, unnest(range(2, len(string_split(path, '/')) + 1)) AS i FROM fh)),
single AS (SELECT folder FROM ch WHERE folder <> '' GROUP BY 1 HAVING count(*) = 1 AND bool_and(is_folder)),
stay AS (SELECT DISTINCT folder FROM ch WHERE folder <> '' AND folder NOT IN (SELECT folder FROM single)),
ups AS (SELECT folder, up, array_to_string(string_split(folder, '/')[1 : len(string_split(folder, '/')) - up], '/') AS above FROM (SELECT folder, unnest(range(1, len(string_split(folder, '/')) + 1)) AS up FROM stay)),
stops AS (SELECT folder, min(up) AS up FROM ups WHERE above NOT IN (SELECT folder FROM single) GROUP BY 1)
SELECT folder, array_to_string(string_split(folder, '/')[len(string_split(folder, '/')) - up + 1 :], '/') AS label FROM stops"""


@query("dir_children", """SELECT DISTINCT array_to_string(string_split(path, '/')[1 : i - 1], '/') AS folder, string_split(path, '/')[i] AS child, i < len(string_split(path, '/')) AS is_folder FROM (SELECT path, unnest(range(2, len(string_split(path, '/')) + 1)) AS i FROM fh)""", live_tables=True)
def _(g):
    return tree.children(g.files().select("path"))


@query("dir_collapsed", _COLLAPSED, live_tables=True)
def _(g):
    return tree.collapsed(g.files().select("path"))


# ---------------------------------------------------------------- vectors


_QUERY = "q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"


def _first_vector(g) -> list[float]:
    vectors = _t(g, "embeddings")
    return vectors.agg(F.min_by("embedding", "vec_id").alias("v")).first()["v"]


@query("semantic_topk", "SELECT vec_id, label, round(list_dot_product(embedding::DOUBLE[], v::DOUBLE[]), 4) AS score FROM embeddings, q ORDER BY list_dot_product(embedding::DOUBLE[], v::DOUBLE[]) DESC, vec_id LIMIT 10", _QUERY)
def _(g):
    return semantic.semantic_topk(_t(g, "embeddings"), _first_vector(g), 10)


@query("semantic_topk_typed", "SELECT vec_id, label, round(s, 4) AS score FROM (SELECT vec_id, label, list_dot_product(embedding::DOUBLE[], v::DOUBLE[]) AS s FROM embeddings, q ORDER BY s DESC, vec_id LIMIT 40) WHERE label = 3 ORDER BY s DESC, vec_id LIMIT 10", _QUERY)
def _(g):
    return semantic.semantic_topk(_t(g, "embeddings"), _first_vector(g), 10, kind=3)


@query("stale_embeddings", "SELECT id FROM n WHERE type <> 'FILE' AND id NOT IN (SELECT node_id FROM node_embeddings WHERE model = 'code-mini-384' AND len(vec) > 0)", live_tables=True)
def _(g):
    return semantic.stale(g.nodes("type"), _t(g, "node_embeddings"))


@query("reindex_embeddings", """SELECT id AS node_id, 'hash-384' AS model, 384 AS dimensions, true AS unit FROM n WHERE type <> 'FILE'
  AND id NOT IN (SELECT node_id FROM node_embeddings WHERE model = 'hash-384' AND len(vec) > 0)""", live_tables=True)
def _(g):
    nodes = g.nodes("type", "qualified_name", "name", "signature", "docstring")
    todo = semantic.stale(nodes, _t(g, "node_embeddings"), "hash-384")
    rows = semantic.encode(nodes.join(todo, "id", "left_semi"), "hash-384")
    return rows.select("node_id", "model", F.size("vec").alias("dimensions"), (F.abs(semantic.dot(F.col("vec"), F.col("vec")) - 1) < 1e-5).alias("unit"))


# ---------------------------------------------------------------- change feed


_EVENTS = "ev AS (SELECT user_id, ts, event_type = 'error' AS deleted, event_id FROM events)"


@query("debounce_sessions", """SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS events, arg_max(deleted, (ts, event_id)) AS deleted FROM (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM (
  SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 1800000000 THEN 0 ELSE 1 END AS o FROM ev)) GROUP BY user_id, burst""", _EVENTS)
def _(g):
    ev = _t(g, "events").select("user_id", "ts", (F.col("event_type") == "error").alias("deleted"), "event_id")
    return changes.debounce(ev, 30 * 60 * 1000, key="user_id", tie="event_id")


@query("move_split", """SELECT 'u' || user_id AS path, event_type IN ('purchase', 'error') AS deleted, ts FROM events UNION ALL SELECT 'd' || event_id, false, ts FROM events WHERE event_type = 'purchase'""")
def _(g):
    kind = F.when(F.col("event_type") == "purchase", "moved").when(F.col("event_type") == "error", "deleted").otherwise("modified")
    rows = _t(g, "events").select(kind.alias("kind"), F.concat(F.lit("u"), "user_id").alias("path"), F.concat(F.lit("d"), "event_id").alias("dest"), "ts")
    return changes.split_moves(rows)


@query("relevant_changes", rf"""SELECT DISTINCT file_path AS path FROM source_files WHERE NOT (len(list_filter(string_split(file_path, '/')[1 : -2], lambda d: d IN ({_FOLDERS}) OR (starts_with(d, '.') AND d NOT IN ('.', '..')))) > 0)
 AND lower(regexp_extract(file_path, '\.([^./]+)$', 1)) IN ('py', 'ts', 'tsx', 'js', 'jsx') AND NOT regexp_matches(file_path, '\.min\.js$')""")
def _(g):
    return changes.relevant(_t(g, "source_files").select(F.col("file_path").alias("path"))).distinct()


@query("top_symbols_per_file", "SELECT file_path, id, name, start_line FROM n WHERE type IN ('FUNCTION', 'METHOD') QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY start_line, id) <= 5", live_tables=True)
def _(g):
    rows = g.nodes("type", "file_path", "name", "start_line").where("type in ('FUNCTION', 'METHOD')")
    return lookup.top_per_group(rows.select("file_path", "id", "name", "start_line"), ["file_path"], ["start_line", "id"], 5)


