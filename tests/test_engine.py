import os

import pytest

from graphweave import engine as E
from graphweave.engine import Engine
from graphweave.render import apply_budget, count_tokens


def write(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())


A = "from .b import helper\n\n\ndef first(x):\n    return helper(x)\n"
B = "from .a import first\n\n\ndef helper(x):\n    '''Helps.'''\n    return first(x)\n"


def graph(e):
    nodes = {(r["id"], r["type"], r["start_line"]) for r in e.table("nodes").collect()}
    return nodes, {(r["id"], r["type"]) for r in e.table("edges").collect()}, {tuple(r) for r in e.table("file_deps").collect()}


def test_index_twice_incremental_equals_full_and_deletion(spark, tmp_path):
    root = tmp_path / "repo"
    write(root, {"p/a.py": A, "p/b.py": B, "p/x.min.js": "x", "node_modules/m.js": "function f() {}", ".hid/h.py": "x = 1", "p/big.py": b"#" * (513 * 1024), "p/C.PY": "z = 1\n", "p/bad.py": b"\xff\xfe"})
    e = Engine(spark, str(tmp_path / "store"), buckets=8)
    run = e.index(str(root))
    assert run["files_scanned"] == 4 and run["status"] == "COMPLETED" and run["run_type"] == "FULL"
    names = {os.path.basename(r["file_path"]) for r in e.table("nodes").collect()}
    assert names == {"a.py", "b.py", "C.PY"}
    calls = {(r["source_id"], r["target_id"]) for r in e.table("edges").where("type = 'CALLS'").collect()}
    assert len(calls) == 2  # each way, whatever the order of the files
    before = graph(e)
    again = e.index(str(root))
    assert again["files_indexed"] == 0 and graph(e) == before
    write(root, {"p/b.py": B + "\n\ndef more():\n    return helper(1)\n"})
    assert e.index(str(root))["files_indexed"] == 2  # the file and its importer
    fresh = Engine(spark, str(tmp_path / "other"), buckets=8)
    fresh.index(str(root))
    assert graph(e) == graph(fresh)
    ids = {n[0] for n in graph(e)[0]}
    os.remove(root / "p/b.py")
    e.index(str(root))
    nodes, _, deps = graph(e)
    assert not any(r["file_path"].endswith("b.py") for r in e.table("nodes").collect()) and not deps and nodes
    left = {n[0] for n in nodes}
    assert all(r["source_id"] in left and r["target_id"] in left for r in e.table("edges").collect())
    assert ids > left
    runs = e.table("index_runs")
    assert runs.count() == 4 and runs.where("status = 'COMPLETED'").count() == 4

    out = e.call("get_stats")
    assert out["tokens_est"] <= 400 and "symbols" in out["text"]
    assert e.call("get_function", name="first")["raw"]["found"]
    assert e.call("get_callers", name="nobody")["text"] == "Not found: nobody"
    assert "FUNCTION first(x)" in e.call("get_file_map", path="p\\a.py")["text"]
    assert e.call("get_diff_context", text="")["text"] == "No changes"
    with pytest.raises(ValueError):
        e.call("get_function")
    with pytest.raises(KeyError):
        e.call("nosuch")


def test_a_saved_file_reads_itself_and_its_importers_only(spark, tmp_path, monkeypatch):
    root = tmp_path / "repo"
    write(root, {"p/a.py": A, "p/b.py": B, "p/other.py": "def lone():\n    pass\n", "p/c%20d.py": "def odd():\n    pass\n"})
    e = Engine(spark, str(tmp_path / "store"), buckets=8)
    e.index(str(root))
    assert e.tables.table("nodes").where("file_path like '%c\\%20d.py'").count() == 2
    write(root, {"p/b.py": B + "\n\ndef more():\n    return helper(1)\n", "p/other.py": "def changed():\n    pass\n"})
    read = []
    whole = E.repo.read_files
    monkeypatch.setattr(E.repo, "read_files", lambda s, r, paths: read.extend(paths) or whole(s, r, paths))
    monkeypatch.setattr(E.repo, "scan", lambda *_: pytest.fail("the whole root was scanned"))
    before = e.tables.listed()["nodes"]
    run = e.index_paths(str(root), [str(root / "p/b.py")])
    assert sorted(os.path.basename(p) for p in read) == ["a.py", "b.py"] and run["files_indexed"] == 2
    names = {r["name"] for r in e.table("nodes").collect()}
    assert "more" in names and "lone" in names and "changed" not in names
    after = e.tables.listed()["nodes"]
    assert sum(before[b] == after.get(b) for b in before) >= len(before) - 2  # other buckets stay as they are
    os.remove(root / "p/b.py")
    e.index_paths(str(root), [], [str(root / "p/b.py")])
    monkeypatch.undo()
    write(root, {"p/other.py": "def lone():\n    pass\n"})
    fresh = Engine(spark, str(tmp_path / "other"), buckets=8)
    fresh.index(str(root))
    assert graph(e) == graph(fresh)


def test_readers_see_one_version_whole_and_runs_exclude_each_other(spark, tmp_path):
    root = tmp_path / "repo"
    write(root, {"a.py": A, "b.py": B})
    e = Engine(spark, str(tmp_path / "store"), buckets=8)
    e.index(str(root))
    old = e.tables.version()
    kept = e.tables.table("nodes", version=old)
    n = kept.count()
    write(root, {"a.py": "x = 1\n"})
    commit, seen = e.tables.commit, []
    def watched(changed, base):
        seen.append((e.tables.table("nodes").count(), e.status()["status"]))
        with pytest.raises(E.Busy):
            e.index(str(root))
        return commit(changed, base)
    e.tables.commit = watched
    e.index(str(root))
    assert seen == [(n, "RUNNING")] and e.tables.version() == old + 1 and kept.count() == n
    with pytest.raises(E.Conflict):
        commit({}, old)
    # a run that died is reset, then another one may start
    run = e.status()
    e._append(run | {"id": run["id"] + 1, "status": "RUNNING", "completed_at": None, "started_at": E._now() - E.dt.timedelta(seconds=400)})
    e.index(str(root))
    states = {r["id"]: r["status"] for r in e.runs().collect()}
    assert states[run["id"] + 1] == "FAILED" and states[run["id"] + 2] == "COMPLETED"
    # another repository empties the store
    write(tmp_path / "second", {"z.py": "def z():\n    pass\n"})
    assert e.index(str(tmp_path / "second"))["run_type"] == "FULL"
    assert {r["name"] for r in e.table("nodes").collect()} == {"z.py", "z"}


def test_listings_and_roots(spark, tmp_path, monkeypatch):
    root = tmp_path / "repo"
    write(root, {"a.py": A, "b.py": B, "x.go": "package x", ".env/y.go": "package y", "bin/z.go": "package z"})
    e = Engine(spark, str(tmp_path / "store"), buckets=8)
    assert e.status() is None and e.list_nodes() == [] and e.subgraph("a.py")["found"] is False
    e.index(str(root))
    nodes = e.list_nodes("function")
    assert {r["name"] for r in nodes} == {"first", "helper"} and e.node(nodes[0]["id"])["name"] == nodes[0]["name"] and e.node("no") is None
    assert e.search("HELP")[0]["name"] == "helper" and len(e.list_edges(type="CALLS")) == 2 and e.subgraph("a.py")["edges"]
    assert {os.path.basename(r["file_path"]) for r in E.repo.walk(spark, str(root)).collect()} == {"a.py", "b.py", "x.go"}
    assert "is no ref" in e.get_diff_context(ref="--output=x")["error"]
    assert e._root() == str(root)
    (tmp_path / "second/.git").mkdir(parents=True)
    monkeypatch.setenv("GRAPHWEAVE_REPO_PATH", str(tmp_path / "second"))
    assert e._root() == str(tmp_path / "second") and Engine(spark, str(tmp_path / "s2"), "/given")._root() == "/given"
    many = "".join(f"diff --git a/{root}/f{i:02d}.py b/{root}/f{i:02d}.py\n" + "".join(f"@@ -1 +{k} @@\n" for k in range(1, 9)) for i in range(12))
    found = e.get_diff_context(text=many)["files"]
    assert len(found) == 10 and all(len(f["ranges"]) == 5 for f in found)
    kinds = {f["function"]["name"]: f["function"]["parameters"]["properties"] for f in E.as_functions()}
    assert kinds["search_symbol"]["type"]["enum"] == list(E.SYMBOL_TYPES) and "repo_path" in kinds["get_diff_context"]


def test_polling_a_folder_gives_events(spark, tmp_path):
    from graphweave.streaming import changes

    write(tmp_path, {"a.py": "x = 1\n", ".git/h": "x", "b.py": "y = 1\n"})
    events, seen = changes.poll(spark, str(tmp_path), {})
    assert sorted((r["kind"], os.path.basename(r["path"])) for r in events.collect()) == [("created", "a.py"), ("created", "b.py")]
    write(tmp_path, {"a.py": "x = 1234\n"})
    os.remove(tmp_path / "b.py")
    events, seen = changes.poll(spark, str(tmp_path), seen)
    assert sorted((r["kind"], os.path.basename(r["path"])) for r in events.collect()) == [("deleted", "b.py"), ("modified", "a.py")]
    assert changes.poll(spark, str(tmp_path), seen)[0].count() == 0


def test_catalogue_forms_agree():
    names = list(E.CATALOGUE)
    assert len(names) == 13
    assert [f["function"]["name"] for f in E.as_functions()] == names
    assert [f["name"] for f in E.as_declarations()["function_declarations"]] == names
    assert [f["name"] for f in E.as_tool_list()["tools"]] == names
    assert E.as_commands()[0] == "get_function <name>"


@pytest.mark.parametrize("budget", [5, 20, 60, 400])
def test_budget_is_kept(budget):
    for text in ("x" * 5000, "\n".join(f"line {i} of many" for i in range(200)), "short", ""):
        out = apply_budget(text, budget)
        assert count_tokens(out) <= max(budget, 11) and (out == text) == (count_tokens(text) <= budget)
    assert apply_budget("x" * 99, 0) == "x" * 99


def test_stream_of_changes_keeps_the_graph_current(spark, tmp_path):
    import datetime as dt

    from graphweave.streaming import changes

    root, feed = tmp_path / "repo", str(tmp_path / "feed")
    write(root, {"a.py": "def one():\n    pass\n"})
    at = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    rows = lambda *r: spark.createDataFrame(list(r), changes.EVENT).coalesce(1)
    rows(("modified", str(root / "a.py"), None, at(0)), ("modified", str(root / "a.txt"), None, at(0))).write.parquet(feed)
    for later in (60, 120):  # only relevant events move the watermark on, one batch later
        rows(("modified", str(root / "z.py"), None, at(later))).write.mode("append").parquet(feed)
    events = spark.readStream.schema(changes.EVENT).option("maxFilesPerTrigger", 1).parquet(feed)
    bursts = changes.debounce_stream(changes.split_moves(events), late="1 second")
    e = Engine(spark, str(tmp_path / "store"), buckets=8)
    query = changes.index_stream(changes.relevant(bursts, str(tmp_path)), changes.index_on_change(e, str(root)), str(tmp_path / "ck"))
    query.awaitTermination(120)
    assert [r["name"] for r in e.table("nodes").where("type = 'FUNCTION'").collect()] == ["one"]
