"""One repository's graph in a folder: indexing, the thirteen tools over it, and their catalogue.

Tools compose frames and collect only their limited rows; nothing larger reaches the driver.
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave import config, schema
from graphweave.extract.registry import parse_files
from graphweave.operators.live import newest
from graphweave.operators import build, diff, lookup, maintain, semantic, stats, traversal
from graphweave.render import count_tokens, render
from graphweave.session import cut
from graphweave.sources import repo
from graphweave.store import BUCKETS, Conflict, Store  # noqa: F401

#: After so long a run that hasn't ended counts as dead.
STUCK_SECONDS = 300
#: Paths that are read one by one; more are found by a scan of the root.
MANY_PATHS = 1_000


#: A diff's answer: files, and ranges and symbols of each, at most.
DIFF_FILES, DIFF_RANGES, DIFF_SYMBOLS = 10, 5, 10


class Busy(RuntimeError):
    """Another run is under way."""


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


class Engine:
    def __init__(self, spark: SparkSession, store: str, repo_path: str | None = None, buckets: int = BUCKETS):
        """buckets: of each table of a new store; the more, the less a small change rewrites. A store must always be opened with the same number."""
        self.spark, self.store, self.repo_path = spark, store.rstrip("/"), repo_path
        self.tables = Store(spark, self.store, buckets)

    def table(self, name: str) -> DataFrame:
        return self.runs() if name == "index_runs" else self.tables.table(name)

    # ------------------------------------------------------------ the log of runs

    def _log(self) -> DataFrame:
        folder = f"{self.store}/index_runs"
        return self.spark.read.schema(schema.INDEX_RUNS).parquet(folder) if self.tables.exists(folder) else self.spark.createDataFrame([], schema.INDEX_RUNS)

    def runs(self) -> DataFrame:
        """Each run's current row: the log has one from its start and one from its end."""
        return newest(self._log(), "id", "completed_at")

    def _append(self, run: dict) -> None:
        columns = [c.split()[0] for c in schema.INDEX_RUNS.split(", ")]
        self.spark.createDataFrame([tuple(run.get(c) for c in columns)], schema.INDEX_RUNS).write.mode("append").parquet(f"{self.store}/index_runs")

    def status(self) -> dict | None:
        """The last run's row."""
        rows = _rows(self.runs().orderBy(F.desc("id")).limit(1))
        return rows[0] if rows else None

    def reset_stuck(self, after: int = STUCK_SECONDS) -> int:
        """Marks runs that began so long ago and haven't ended as failed; returns how many."""
        old = _rows(self.runs().where(F.col("status") == "RUNNING").where(F.col("started_at") <= F.lit(_now() - dt.timedelta(seconds=after))))
        for run in old:
            self._append(run | {"status": "FAILED", "error_message": "ended without a result", "completed_at": _now()})
        return len(old)

    def _run(self, kind: str, root: str, work: Callable[[], dict]) -> dict:
        self.reset_stuck()
        last = self.status()
        if last and last["status"] == "RUNNING":
            raise Busy(f"run {last['id']} is under way since {last['started_at']}")
        began = _now()
        run = {"id": (last["id"] if last else 0) + 1, "run_type": kind, "repo_path": root, "started_at": began, "status": "RUNNING", "error_message": None}
        self._append(run)
        try:
            run |= work()
            run["status"] = "COMPLETED"
        except Exception as bad:
            run |= {"status": "FAILED", "error_message": str(bad)[:2000]}
            raise
        finally:
            run |= {"completed_at": _now(), "duration_ms": int((_now() - began).total_seconds() * 1000)}
            self._append(run)
        return run

    # ------------------------------------------------------------ indexing

    def index(self, root: str, force: bool = False) -> dict:
        """Brings the graph up to date with the files below root and returns the run's audit row.

        Only new and changed files and those that import them are parsed; force parses all. Files
        that are gone lose their rows. Edges are resolved after all nodes are there, so the order of
        files doesn't matter and a second run changes nothing. A store holds one repository: with
        another root it is emptied first. While a run is under way another one is refused.
        """
        root = root.rstrip("/")
        last = stats.last_run(self.runs(), "COMPLETED").first()
        switched = last is not None and (last["repo_path"] or "").rstrip("/") != root
        full = force or switched or not self.tables.has("file_hashes")

        def work() -> dict:
            if switched:
                self.tables.clear()
            files = cut(repo.scan(self.spark, root))
            scanned = maintain.file_hashes(files)
            stored = self.tables.table("file_hashes")
            dirty = maintain.dirty_files(scanned, stored, force).select("path")
            gone = maintain.deleted_files(scanned, stored)
            return self._build(root, files, scanned, dirty, gone) | {"files_scanned": files.count()}

        return self._run("FULL" if full else "INCREMENTAL", root, work)

    def index_paths(self, root: str, changed: list[str], deleted: list[str] = ()) -> dict:
        """As index, for files that are known to have changed or gone: only they and the files that import them are read."""
        root = root.rstrip("/")
        if not self.tables.has("file_hashes"):
            return self.index(root)

        def work() -> dict:
            named = self.spark.createDataFrame([(p,) for p in {*changed, *deleted}], "path string")
            near = named.join(maintain.expand_dirty(named, self.tables.table("file_deps")), "path", "full").select("path").distinct()
            few = [r["path"] for r in near.limit(MANY_PATHS + 1).collect()]
            if len(few) > MANY_PATHS:
                files = repo.scan(self.spark, root).join(near.withColumnRenamed("path", "file_path"), "file_path", "left_semi")
            else:
                there = [p for p in few if self.tables.exists(p)]
                files = repo.read_files(self.spark, root, there)
            files = cut(files)
            scanned = maintain.file_hashes(files)
            stored = self.tables.table("file_hashes").join(named, "path", "left_semi")
            dirty = maintain.dirty_files(scanned.join(named, "path", "left_semi"), stored).select("path")
            return self._build(root, files, scanned, dirty, maintain.deleted_files(scanned, stored)) | {"files_scanned": files.count()}

        return self._run("INCREMENTAL", root, work)

    def _build(self, root: str, files: DataFrame, scanned: DataFrame, dirty: DataFrame, gone: DataFrame) -> dict:
        """Rebuilds the dirty files and their importers, drops those that are gone, and writes the buckets that this touches, all in one version."""
        base = self.tables.version()
        old = {n: self.tables.table(n, version=base) for n in ("nodes", "edges", "file_hashes", "file_deps")}
        gone = cut(gone.select("path"))
        todo = cut(maintain.expand_dirty(dirty.unionByName(gone), old["file_deps"]).join(gone, "path", "left_anti"))
        touched = cut(todo.unionByName(gone).distinct())
        if self.tables.has("file_hashes") and touched.isEmpty() and scanned.join(old["file_hashes"].select("path"), "path", "left_anti").isEmpty():
            return {"files_indexed": 0, "files_skipped": files.count(), "nodes_created": 0, "edges_created": 0}
        parsed = cut(parse_files(files.join(todo.withColumnRenamed("path", "file_path"), "file_path", "left_semi")))
        files_touched = touched.withColumnRenamed("path", "file_path")
        now = F.current_timestamp().cast("timestamp_ntz")
        fresh = build.parsed_nodes(parsed).withColumn("created_at", now).withColumn("updated_at", now)
        before = old["nodes"].join(files_touched, "file_path", "left_semi")
        fresh = fresh.join(before.select("id", F.col("created_at").alias("born")), "id", "left").withColumn("created_at", F.coalesce("born", "created_at"))
        columns = old["nodes"].columns
        fresh = cut(fresh.select(*columns))
        kept = old["nodes"].join(files_touched, "file_path", "left_anti").select(*columns)
        resolved = build.graph_edges(build.resolve_targets(build.parsed_edges(parsed), kept.unionByName(fresh)))
        edges = cut(resolved.select("id", "source_id", "target_id", "type", F.lit("null").alias("metadata"), "file_path", now.alias("created_at")))
        # edges of other files that point to what is no longer there
        lost = cut(before.select("id").join(fresh.select("id"), "id", "left_anti"))
        ends = old["edges"].join(files_touched, "file_path", "left_anti")
        dangling = ends.join(lost.withColumnRenamed("id", "target_id"), "target_id", "left_semi").unionByName(ends.join(lost.withColumnRenamed("id", "source_id"), "source_id", "left_semi"), allowMissingColumns=True)
        imports = parsed.select(F.col("file_path").alias("importer"), F.explode("import_paths").alias("import_path")).distinct().withColumn("repo_path", F.lit(root))
        known = old["file_hashes"].select("path").unionByName(scanned.select("path")).distinct().join(gone, "path", "left_anti")
        found = cut(build.resolve_imports(imports, known).select("importer", "importee").where("importer <> importee").distinct())
        away = old["file_deps"].join(gone.withColumnRenamed("path", "importee"), "importee", "left_semi")
        hashes = cut(scanned.join(touched, "path", "left_semi"))
        new_hashes = cut(hashes.unionByName(scanned.join(old["file_hashes"].select("path"), "path", "left_anti")).distinct())

        def buckets(name: str, *frames: DataFrame) -> set[int]:
            out: set[int] = set()
            for df in frames:  # at most as many numbers as the store has buckets
                out |= {r["b"] for r in df.select(self.tables.bucket(name).alias("b")).distinct().collect()}
            return out

        def replaced(name: str, at: set[int], key: str, rows: DataFrame, drop: DataFrame) -> DataFrame:
            """The old rows of some buckets, without those of the dropped files, with the new ones."""
            left = self.tables.table(name, at, base)
            return left.join(drop.select(F.col("path").alias(key)), key, "left_anti").select(*rows.columns).unionByName(rows)

        at = {
            "nodes": buckets("nodes", files_touched),
            "edges": buckets("edges", files_touched, dangling),
            "file_deps": buckets("file_deps", touched.withColumnRenamed("path", "importer"), away),
            "file_hashes": buckets("file_hashes", touched, new_hashes),
        }
        dead = lost.select("id")
        edge_rows = replaced("edges", at["edges"], "file_path", edges, touched)
        edge_rows = edge_rows.join(dead.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(dead.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
        dep_rows = replaced("file_deps", at["file_deps"], "importer", found, touched).join(gone.withColumnRenamed("path", "importee"), "importee", "left_anti").distinct()
        hash_rows = replaced("file_hashes", at["file_hashes"], "path", new_hashes.select(*old["file_hashes"].columns), touched.unionByName(new_hashes.select("path")))
        changed = {"nodes": replaced("nodes", at["nodes"], "file_path", fresh, touched), "edges": edge_rows, "file_deps": dep_rows, "file_hashes": hash_rows}
        first = not self.tables.has("file_hashes")
        totals = maintain.build_totals(parsed).first()
        counts = {"files_indexed": totals["files"], "files_skipped": max(0, files.count() - totals["files"]), "nodes_created": fresh.count(), "edges_created": edges.count()}
        if first or any(at.values()):
            self.tables.commit({n: (df, None if first else at[n]) for n, df in changed.items()}, base)
        return counts

    # ------------------------------------------------------------ tools

    def _known_path(self, path: str) -> str | None:
        asked = self.spark.createDataFrame([(path,)], "request string")
        found = lookup.resolve_paths(self.table("nodes").select(F.col("file_path").alias("path")), asked).first()
        return found["path"] if found else None

    def get_function(self, name: str) -> dict:
        rows = _rows(lookup.get_function(self.table("nodes"), name))
        return {"name": name, "found": bool(rows), "rows": rows}

    def _calls(self, name: str, side: str) -> dict:
        nodes = self.table("nodes")
        found = not traversal.seeds(nodes, name, 1).isEmpty()
        return {"name": name, "found": found, "rows": _rows(traversal.call_neighbours(nodes, self.table("edges"), name, side)) if found else []}

    def get_callers(self, name: str) -> dict:
        return self._calls(name, "callers")

    def get_callees(self, name: str) -> dict:
        return self._calls(name, "callees")

    def get_file_map(self, path: str) -> dict:
        known = self._known_path(path)
        rows = _rows(traversal.file_map(self.table("nodes"), self.table("edges"), known).orderBy("start_line", "id")) if known else []
        return {"path": known or path, "found": known is not None, "rows": rows}

    def search_symbol(self, query: str, type: str | None = None) -> dict:
        return {"query": query, "rows": _rows(lookup.search_symbol(self.table("nodes"), query, type))}

    def get_related(self, path: str) -> dict:
        known = self._known_path(path)
        if known is None:
            return {"path": path, "found": False}
        deps = self.table("file_deps")
        names = lambda df: [r["path"] for r in df.collect()]
        return {"path": known, "found": True, "imports": names(traversal.importees(deps, known)), "importers": names(traversal.importers(deps, known)), "two_hop": names(traversal.two_hop_dependents(deps, known))}

    def get_context(self, path: str) -> dict:
        known = self._known_path(path)
        if known is None:
            return {"path": path, "found": False}
        nodes, edges = self.table("nodes"), self.table("edges")
        return {
            "path": known,
            "found": True,
            "symbols": _rows(traversal.context_symbols(nodes, known).join(nodes.select("id", "start_line"), "id").orderBy("start_line", "id")),
            "incoming": _rows(traversal.context_edges(nodes, edges, known, "incoming")),
            "outgoing": _rows(traversal.context_edges(nodes, edges, known, "outgoing")),
            "imports": [r["path"] for r in traversal.importees(self.table("file_deps"), known).collect()],
        }

    def get_hierarchy(self, name: str) -> dict:
        nodes, edges = self.table("nodes"), self.table("edges")
        first = _rows(nodes.where((F.col("name") == name) & (F.col("type") == "CLASS")).orderBy("id").limit(1))
        return {
            "name": name,
            "found": bool(first),
            "class": first[0] if first else None,
            "relations": _rows(traversal.hierarchy_relations(nodes, edges, name)),
            "methods": _rows(traversal.hierarchy_methods(nodes, edges, name)),
        }

    def get_stats(self) -> dict:
        nodes, edges = self.table("nodes"), self.table("edges")
        node_types, edge_types = _rows(stats.type_counts(nodes)), _rows(stats.type_counts(edges))
        return {
            "node_types": node_types,
            "edge_types": edge_types,
            "symbols": sum(r["n"] for r in node_types),
            "edges": sum(r["n"] for r in edge_types),
            "files": nodes.select("file_path").distinct().count(),
            "languages": [r["language"] for r in stats.languages(nodes).collect()],
            "hotspots": _rows(stats.hotspot_files(nodes, edges)),
        }

    def get_definition(self, name: str) -> dict:
        nodes = self.table("nodes")
        hits = lookup.get_definition(nodes, name)
        rows = _rows(hits)
        return {"name": name, "found": bool(rows), "rows": rows, "calls": _rows(traversal.definition_calls(nodes, self.table("edges"), hits)) if rows else []}

    def _vectors(self) -> DataFrame:
        return self.tables.table("node_embeddings")

    def search_semantic(self, query: str, k: int = 10, type: str | None = None) -> dict:
        vectors = self._vectors().join(self.table("nodes").select(F.col("id").alias("node_id"), "type"), "node_id")
        best = semantic.semantic_topk(vectors, semantic.hash_vector(query).tolist(), k, type, key="node_id", vec="vec", type_col="type")
        rows = best.drop("type").join(self.table("nodes").withColumnRenamed("id", "node_id"), "node_id").orderBy(F.desc("score"), "node_id")
        return {"query": query, "rows": _rows(rows)}

    def reindex_embeddings(self) -> dict:
        nodes, old = self.table("nodes"), self._vectors()
        todo = semantic.stale(nodes, old, "hash-384")
        new = cut(semantic.encode(nodes.join(todo, "id", "left_semi")))
        live = old.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
        self.tables.commit({"node_embeddings": (maintain.upsert(live.select("node_id", "vec", "model"), new, key="node_id"), None)}, self.tables.version())
        return {"encoded": new.count()}

    def get_diff_context(self, text: str | None = None, ref: str = "HEAD", repo_path: str | None = None) -> dict:
        """Changed files, the symbols their ranges touch, and who calls or is called by those. text: a diff; else git is asked."""
        root = repo_path or self._root()
        if text is None:
            if root is None:
                return {"error": "no repository is known", "files": []}
            try:
                text = repo.git_diff(root, ref)
            except (RuntimeError, OSError, ValueError) as bad:
                return {"error": str(bad), "files": []}
        nodes = self.table("nodes")
        ranges = cut(diff.hunks(repo.diff_frame(self.spark, text)))
        asked = ranges.select(F.col("file").alias("request")).distinct()
        known = lookup.resolve_paths(nodes.select(F.col("file_path").alias("path")), asked)
        placed = cut(ranges.join(known.withColumnRenamed("request", "file"), "file", "left"))
        touched = cut(diff.overlapping(nodes, placed.where("path is not null").select(F.col("path").alias("file"), "start_line", "end_line")))
        radius = _rows(traversal.blast_radius(nodes, self.table("edges"), touched).orderBy("relation", "name", "id").limit(2 * config.MAX_ROWS))
        shown = placed.select("file").distinct().orderBy("file").limit(DIFF_FILES)
        by: dict[str, dict] = {}
        for r in _rows(lookup.top_per_group(placed.join(F.broadcast(shown), "file"), ["file"], ["start_line", "end_line"], DIFF_RANGES).orderBy("file", "start_line")):
            f = by.setdefault(r["file"], {"file": r["path"] or r["file"], "indexed": r["path"] is not None, "ranges": [], "symbols": []})
            f["ranges"].append((r["start_line"], r["end_line"]))
        where = {f["file"]: f for f in by.values()}
        first = lookup.top_per_group(touched.join(F.broadcast(placed.join(F.broadcast(shown), "file").select(F.col("path").alias("file_path")).distinct()), "file_path"), ["file_path"], ["start_line", "id"], DIFF_SYMBOLS)
        for r in _rows(first.orderBy("file_path", "start_line", "id")):
            where[r["file_path"]]["symbols"].append(r)
        return {"files": list(by.values()), "radius": radius}

    def _root(self) -> str | None:
        """The repository: the one given, else the environment's if it is a checkout, else the last run's, else the environment's."""
        named = os.environ.get("GRAPHWEAVE_REPO_PATH")
        if self.repo_path or (named and os.path.isdir(os.path.join(named, ".git"))):
            return self.repo_path or named
        last = stats.last_run(self.runs(), "COMPLETED").first()
        return last["repo_path"] if last else named

    # ------------------------------------------------------------ the service's listings

    def list_nodes(self, type: str | None = None, language: str | None = None, limit: int = 100, offset: int = 0) -> list[dict]:
        return _rows(lookup.list_nodes(self.table("nodes"), type, language, limit, offset))

    def search(self, query: str, limit: int = 100) -> list[dict]:
        return _rows(lookup.search_simple(self.table("nodes"), query, limit))

    def node(self, id: str) -> dict | None:
        rows = _rows(lookup.node_by_id(self.table("nodes"), id))
        return rows[0] if rows else None

    def list_edges(self, source: str | None = None, target: str | None = None, type: str | None = None, limit: int = 2000) -> list[dict]:
        return _rows(lookup.list_edges(self.table("edges"), source, target, type, limit))

    def subgraph(self, path: str, limit: int = 2000) -> dict:
        """A file's symbols and the edges that touch them, at most so many."""
        known = self._known_path(path)
        if known is None:
            return {"path": path, "found": False, "nodes": [], "edges": []}
        nodes, edges = self.table("nodes"), self.table("edges")
        return {"path": known, "found": True, "nodes": _rows(lookup.file_symbols(nodes, known).limit(limit)), "edges": _rows(traversal.file_subgraph(nodes, edges, known).orderBy("id").limit(limit))}

    def call(self, tool: str, budget: int = config.TOKENS_PER_ANSWER, **arguments) -> dict:
        """A tool by name: its raw answer, its text within the budget and the text's tokens."""
        if tool not in CATALOGUE:
            raise KeyError(f"unknown tool {tool!r}")
        missing = [a for a, (_, needed) in CATALOGUE[tool]["arguments"].items() if needed and a not in arguments]
        if missing:
            raise ValueError(f"{tool} needs {', '.join(missing)}")
        raw = getattr(self, tool)(**arguments)
        text = render(tool, raw, budget)
        return {"tool": tool, "raw": raw, "text": text, "tokens_est": count_tokens(text)}


def _tool(description: str, /, **arguments: tuple[str, bool]) -> dict:
    return {"description": description, "arguments": arguments}


CATALOGUE: dict[str, dict] = {
    "get_function": _tool("Find functions, methods and classes by name.", name=("string", True)),
    "get_callers": _tool("List the symbols that call a symbol.", name=("string", True)),
    "get_callees": _tool("List the symbols a symbol calls.", name=("string", True)),
    "get_file_map": _tool("List a file's symbols with calls in and out.", path=("string", True)),
    "search_symbol": _tool("Search symbols by a part of their name.", query=("string", True), type=("symbol type", False)),
    "get_related": _tool("List files linked to a file by imports.", path=("string", True)),
    "get_context": _tool("Show a file's symbols and their links to other files.", path=("string", True)),
    "get_hierarchy": _tool("Show a class with parents, children and methods.", name=("string", True)),
    "get_stats": _tool("Count symbols, edges, files and languages."),
    "get_definition": _tool("Show a symbol's definition with callers and callees.", name=("string", True)),
    "search_semantic": _tool("Search symbols by meaning.", query=("string", True), k=("integer", False), type=("symbol type", False)),
    "reindex_embeddings": _tool("Encode symbols that lack a current vector."),
    "get_diff_context": _tool("Show what a diff touches and who depends on it.", text=("string", False), ref=("string", False), repo_path=("string", False)),
}


#: The types a search can be narrowed to.
SYMBOL_TYPES = ("FUNCTION", "CLASS", "METHOD", "VARIABLE", "TYPE")


def _argument(kind: str) -> dict:
    return {"type": "string", "enum": list(SYMBOL_TYPES)} if kind == "symbol type" else {"type": kind}


def _schema(tool: dict) -> dict:
    return {"type": "object", "properties": {a: _argument(kind) for a, (kind, _) in tool["arguments"].items()}, "required": [a for a, (_, needed) in tool["arguments"].items() if needed]}


def as_functions() -> list[dict]:
    """The catalogue as function declarations with JSON schemas, wrapped by type."""
    return [{"type": "function", "function": {"name": n, "description": t["description"], "parameters": _schema(t)}} for n, t in CATALOGUE.items()]


def as_declarations() -> dict:
    """The catalogue as one list of function declarations."""
    return {"function_declarations": [{"name": n, "description": t["description"], "parameters": _schema(t)} for n, t in CATALOGUE.items()]}


def as_tool_list() -> dict:
    """The catalogue as a list of tools with input schemas."""
    return {"tools": [{"name": n, "description": t["description"], "inputSchema": _schema(t)} for n, t in CATALOGUE.items()]}


def as_commands() -> list[str]:
    """The catalogue as command lines, optional arguments in brackets."""
    show = lambda a, needed: f"<{a}>" if needed else f"[{a}]"
    return [" ".join([n, *(show(a, needed) for a, (_, needed) in t["arguments"].items())]) for n, t in CATALOGUE.items()]
