import datetime as dt
import os

import pytest

from graphweave.operators import build, diff, live, lookup, maintain, semantic, text, traversal, tree
from graphweave.plans import registry
from graphweave.sources import repo
from graphweave.streaming import changes

T0 = dt.datetime(2026, 1, 1)


def test_newest_breaks_ties_and_skips_null_keys(spark):
    rows = [("a", 1, "old"), ("a", 2, "new"), ("a", 2, "nev"), (None, 9, "x"), ("b", None, None)]
    df = spark.createDataFrame(rows, "id string, t int, v string")
    assert {tuple(r) for r in live.newest(df, "id", "t").select("id", "v").collect()} == {("a", "new"), ("b", None)}
    assert live.newest(df.limit(0), "id", "t").count() == 0


def test_ladder(spark):
    nodes = spark.createDataFrame(
        [("1", "FUNCTION", "f", "x.py.f", "x.py"), ("2", "METHOD", "m", "x.py.C.m", "x.py"), ("3", "METHOD", "m", "y.py.D.m", "y.py"), ("4", "FUNCTION", "only", "y.py.only", "y.py"), ("5", "CLASS", "C", "longer.py.C", "longer.py"), ("6", "CLASS", "C", "x.py.C", "x.py")],
        "id string, type string, name string, qualified_name string, file_path string",
    )
    wanted = {"x.py.C.m": ("2", 0), "y.py.only": ("4", 1), "D.m": ("3", 2), "py.C": ("6", 2), "self.only": ("4", 3), "self.m": None, "nosuch": None}
    raw = spark.createDataFrame([("x.py.f", t, "CALLS", "x.py") for t in wanted] + [("x.py.f", "y.py.only", "DEFINES", "x.py")], "source_qualified string, target_qualified string, type string, file_path string")
    got = {(r["target_id"], r["rung"], r["type"]) for r in build.resolve_targets(raw, nodes).collect()}
    assert got == {(*v, "CALLS") for v in wanted.values() if v}


def test_imports_resolve(spark):
    files = spark.createDataFrame([(p,) for p in ("/r/src/a/m.py", "/r/src/a/n.py", "/r/src/top.py", "/r/web/index.ts", "/r/web/x.tsx", "/r/src/a/__init__.py")], "path string")
    asked = {("/r/src/a/m.py", ".n"): "/r/src/a/n.py", ("/r/src/a/m.py", "..top"): "/r/src/top.py", ("/r/src/a/m.py", "a.n"): "/r/src/a/n.py", ("/r/src/a/m.py", "."): "/r/src/a/__init__.py", ("/r/web/x.tsx", "./x"): "/r/web/x.tsx", ("/r/web/x.tsx", "../web"): "/r/web/index.ts", ("/r/web/x.tsx", "react"): None, ("/r/web/x.tsx", "../../../../q"): None}
    imports = spark.createDataFrame([(a, "/r", p) for a, p in asked] + [("/r/web/x.tsx", "/r", "")], "importer string, repo_path string, import_path string")
    got = {(r["importer"], r["import_path"]): r["importee"] for r in build.resolve_imports(imports, files).collect()}
    assert got == {k: v for k, v in asked.items() if v}


def test_dirty_expand_upsert_cascade(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", ""), ("d", "4")], "path string, sha256 string")
    old = spark.createDataFrame([("a", "1"), ("b", "x"), ("e", "5")], "path string, sha256 string")
    assert {tuple(r) for r in maintain.dirty_files(now, old).collect()} == {("b", "changed"), ("d", "new")}
    assert maintain.dirty_files(now, old, force=True).count() == 3
    assert [r[0] for r in maintain.deleted_files(now, old).collect()] == ["e"]
    deps = spark.createDataFrame([("p", "b"), ("q", "p")], "importer string, importee string")
    assert {r[0] for r in maintain.expand_dirty(maintain.dirty_files(now, old), deps).collect()} == {"b", "d", "p"}
    base = spark.createDataFrame([("1", "x", 1), ("2", "y", 1)], "id string, v string, created int")
    new = spark.createDataFrame([("2", "z", 5), ("3", "w", 5), ("3", "v", 6)], "id string, v string, created int")
    got = {tuple(r) for r in maintain.upsert(base, new, keep=["created"], stamp="created").collect()}
    assert got == {("1", "x", 1), ("2", "z", 1), ("3", "v", 6)}
    left = maintain.cascade(base, spark.createDataFrame([("1", "2"), ("1", "9")], "source_id string, target_id string"))
    assert left.count() == 1
    assert {tuple(r) for r in maintain.drop_file_deps(deps, spark.createDataFrame([("p",)], "path string"), rebuilt=True).collect()} == {("q", "p")}
    assert maintain.drop_file_deps(deps, spark.createDataFrame([("p",)], "path string"), rebuilt=False).count() == 0


def test_search_wildcards_and_case(spark):
    nodes = spark.createDataFrame([("1", "FUNCTION", "get_user", "a.get_user", "f", 1, 2, None, None, None), ("2", "FUNCTION", "getXuser", "a.getXuser", "f", 1, 2, None, None, None), ("3", "METHOD", "GET_USER_ID", None, "f", 1, 2, None, None, None)], "id string, type string, name string, qualified_name string, file_path string, start_line int, end_line int, signature string, docstring string, language string")
    assert [(r["id"], r["rank"]) for r in lookup.search_symbol(nodes, "get_user").collect()] == [("1", 0), ("3", 1)]
    assert lookup.search_symbol(nodes, "get_user", wildcard=True).count() == 3
    assert lookup.search_symbol(nodes, "%").count() == 0
    assert lookup.get_function(nodes, "nosuch").count() == 0


def test_ego_and_empty_graph(spark):
    edges = spark.createDataFrame([("1", "a", "b", "CALLS"), ("2", "b", "c", "CALLS"), ("3", "c", "a", "CALLS"), ("4", "d", "c", "USES")], "id string, source_id string, target_id string, type string")
    root = spark.createDataFrame([("a",)], "id string")
    assert {tuple(r) for r in traversal.ego_network(edges, root, 2).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert traversal.ego_network(edges.limit(0), root, 2).count() == 1


def test_diff_hunks(spark):
    body = "diff --git a/x.py b/y.py\n--- a/x.py\n+++ b/y.py\n@@ -1 +10 @@\n+a\n@@ -4,2 +10,3 @@ def f\n@@ -9,1 +10,0 @@\ndiff --git a/r b/s\nrename from r\r\ndiff --git a/q b/q\n@@ -1,2 +5 @@"
    df = spark.createDataFrame([("d", body), ("e", ""), ("f", None)], "diff_id string, text string")
    assert sorted(tuple(r)[1:] for r in diff.hunks(df).collect()) == [("q", 5, 5), ("y.py", 10, 10), ("y.py", 10, 10), ("y.py", 10, 12)]


def test_tree_collapse(spark):
    files = spark.createDataFrame([("/a/b/c/x.py",), ("/a/b/c/d/y.py",), ("/a/b/c/d/z.py",)], "path string")
    got = {r["folder"]: r["label"] for r in tree.collapsed(files).collect()}
    assert got == {"/a/b/c": "a/b/c", "/a/b/c/d": "d"} or got == {"/a/b/c": "/a/b/c", "/a/b/c/d": "d"}


def test_text_columns(spark):
    df = spark.createDataFrame([("q", "n", "", "d" * 300), (None, "n", None, " ")], "q string, n string, s string, d string")
    from pyspark.sql import functions as F

    got = [r[0] for r in df.select(text.embedding_text(F.col("q"), F.col("n"), F.col("s"), F.col("d"))).collect()]
    assert got == ["q | " + "d" * 240, "n"]
    lines = spark.createDataFrame([("k", i, "x" * 40) for i in range(10)], "k string, n int, line string")
    kept = text.budget_lines(lines, "k", "n", "line", 60).collect()
    assert [r["n"] for r in kept] == [0, 1, 2, 3] and all(r["cut"] for r in kept)
    assert [len(r["line"]) for r in text.budget_lines(spark.createDataFrame([("k", 0, "x" * 999)], lines.schema), "k", "n", "line", 50).collect()] == [160]
    assert text.budget_lines(lines, "k", "n", "line", 0).count() == 10


def test_ignore_rules(spark):
    paths = {"src/a.py": True, "node_modules/a.js": False, ".git/a.py": False, "a.min.js": False, "A.PY": True, "x/dist/a.ts": False, "readme.md": False, "noext": False, "x.d.ts": True, "yarn.lock": False}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    from pyspark.sql import functions as F

    assert {r["p"]: r["k"] for r in df.select("p", repo.wanted(F.col("p")).alias("k")).collect()} == paths


def test_debounce_batch_and_stream(spark, tmp_path):
    at = lambda ms: T0 + dt.timedelta(milliseconds=ms)
    rows = [("p", False, at(0)), ("p", True, at(200)), ("p", False, at(600)), ("q", True, at(100))]
    df = spark.createDataFrame(rows, "path string, deleted boolean, ts timestamp")
    got = sorted((r["path"], r["events"], r["deleted"]) for r in changes.debounce(df).collect())
    assert got == [("p", 1, False), ("p", 2, True), ("q", 1, True)]
    moved = spark.createDataFrame([("moved", "a.py", "b.py", at(0)), ("deleted", "c.py", None, at(1)), ("modified", "d.txt", None, at(2))], changes.EVENT)
    assert {(r["path"], r["deleted"]) for r in changes.relevant(changes.split_moves(moved)).collect()} == {("a.py", True), ("b.py", False), ("c.py", True)}

    source, seen = str(tmp_path / "in"), []
    # a far later event moves the watermark past the bursts
    df.unionByName(spark.createDataFrame([("z", False, at(60_000))], df.schema)).coalesce(1).write.parquet(source)
    spark.createDataFrame([("z", False, at(120_000))], df.schema).coalesce(1).write.mode("append").parquet(source)
    stream = changes.debounce_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source), late="1 second")
    watch = changes.Watch()
    assert watch.start(lambda: changes.index_stream(stream, lambda batch, _: seen.extend(tuple(r) for r in batch.select("path", "events", "deleted").collect()), str(tmp_path / "ck")))
    watch.query.awaitTermination(90)
    assert {("p", 1, False), ("p", 2, True), ("q", 1, True)} <= set(seen) and not watch.stop()
    assert watch.progress()["active"] is False


def test_semantic_filter_after_oversampling(spark):
    rows = [(i, [1.0, i / 100.0], i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>, label int")
    assert [r["vec_id"] for r in semantic.semantic_topk(df, [0.0, 1.0], 2, kind=1, oversample=2).collect()] == [19, 17]
    assert semantic.semantic_topk(df, [0.0, 1.0], 3).count() == 3
    assert abs(float((semantic.hash_vector("some words") ** 2).sum()) - 1) < 1e-9 and not semantic.hash_vector("").any()


NEEDED = {
    "get_function": "StringEndsWith(name", "get_definition": "StringEndsWith(name", "list_nodes_page": "EqualTo(type,METHOD)", "node_by_id": "EqualTo(id,", "list_edges": "EqualTo(type,INHERITS)", "file_symbols": "EqualTo(file_path,",
    "get_callers": "EqualTo(name,", "get_callees": "EqualTo(name,", "file_map_counts": "EqualTo(file_path,", "context_symbols": "EqualTo(file_path,", "context_incoming": "EqualTo(file_path,", "hierarchy_methods": "EqualTo(name,",
}


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001/nodes.parquet"), reason="no tables here")
@pytest.mark.parametrize("name", NEEDED)
def test_filters_reach_the_scan_before_current_rows_are_picked(spark, name):
    df = registry.queries()[name](spark, "/root/testdata/sf0.001")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    pushed = [line for line in df._jdf.queryExecution().explainString(mode).splitlines() if line.startswith("PushedFilters")]
    assert any(NEEDED[name] in line for line in pushed)


def test_a_search_keeps_the_newest_row_of_what_it_matches(spark):
    rows = [("a", "FUNCTION", "load", "x.old.load", 1), ("a", "FUNCTION", "load", "x.load", 2), ("b", "FUNCTION", "save", None, 1), (None, "CLASS", "old", "old", 1)]
    nodes = spark.createDataFrame(rows, "id string, type string, name string, qualified_name string, updated_at int")
    found = live.live_nodes(nodes, columns=["name", "qualified_name"], match=lookup.search_condition("old"))
    assert [tuple(r) for r in found.collect()] == [("a", "load", "x.load")]
    assert found.where(lookup.search_condition("old")).count() == 0
