import pytest

from graphweave.llm import doc_pairs, docs

SAYS = [
    "Idempotent; safe to repeat.", "Not thread-safe.", "Blocks up to 30 s.", "Raises KeyError on unknown ids.", "Returns -1 for detached heads.", "Counts open rows. TODO: more.", "@param vec the vector, never empty", ":param vec: unit length\n:returns: a copy",
    "Args:\n    vec: must be sorted.\nReturns:\n    None", "Liest die Datei erneut.", "返回空列表。", "Parameters\n----------\nvec : int\n    number of retries", "Merges the vector, keeping the older half.",
]
SILENT = [
    None, "", "  \n", "TODO", "fixme: write docs", "n/a", "...", "-----", "* * *", "merge_vector", "mergeVector", "Merges the vector.", "This function merges vectors", "Method mergeVector.", "Will merge the vector", "See above.", "{@inheritDoc}", "Same as parent.", "Inherited.", "noqa: E501", "type: ignore",
    "eslint-disable-next-line", "@ts-ignore", "pragma: no cover", "@param {any} vec\n@returns {void}", ":param vec: the vec\n:return:", "Args:\n    vec: vec\nReturns:\n    None", "Noch zu dokumentieren.", "Pendiente de documentar.", "Auto-generated method stub.", "Add description here.", "docstring", "Parameters\n----------\nvec : int",
]


@pytest.mark.parametrize("doc", SAYS)
def test_says_something(doc):
    assert docs.informative(doc, "merge_vector", "merge_vector(vec)")


@pytest.mark.parametrize("doc", SILENT)
def test_says_nothing(doc):
    assert not docs.informative(doc, "merge_vector", "merge_vector(vec)")


def test_assignment_is_best_and_one_to_one():
    scores = {(0, 0): 3.0, (0, 1): 2.9, (1, 0): 2.8, (2, 5): 1.0, (3, 5): 2.0}
    assert doc_pairs.assign(scores) == {0: 1, 1: 0, 3: 5}
    assert doc_pairs.assign({}) == {}


PY = '''# Shared by all.

# Keeps order.
@deco
def a(x):
    return x

class C:
    # Too deep for it.
      # odd
    def b(self):
        r"""Quadratic
        in the worst case."""
    x = 1
        # inner remark
    def c(self): pass

def d(y: str = ")") -> dict[str, int]:
    "Caller owns the lock."
'''
TS = '''/** Blocks for long. */
export const a = async (x: any) => {
  return x;
};

/** Times are UTC. */

class K {
  // Order is lost.
  // Twice.
  b(q) { return q; }
}
'''


def fn(i, name, line, doc=None):
    return {"id": str(i), "name": name, "signature": f"{name}(x)", "docstring": doc, "source_snippet": None, "start_line": line, "end_line": line + 1}


def test_file_documentation_is_found():
    got = doc_pairs.match_file(PY, "m.py", [fn(0, "a", 5), fn(1, "b", 11), fn(2, "c", 16), fn(3, "d", 18), fn(4, "gone", 3), fn(5, "a", 99)])
    assert [g[0] and " ".join(g[0].split()) for g in got] == ["Keeps order.", "Quadratic in the worst case.", None, "Caller owns the lock.", None, None]
    assert got[0][2].startswith("@deco\ndef a(x):") and [g[1] for g in got[:4]] == ["comment", "head", None, "head"]
    got = doc_pairs.match_file(TS, "m.TS", [fn(0, "a", 2), fn(1, "b", 11)])
    assert [g[0] for g in got] == ["Blocks for long.", "Order is lost.\nTwice."]


def linked(text, path, functions):
    return [(g[0] and g[0].split("\n")[0], g[1]) for g in doc_pairs.match_file(text, path, functions)]


def test_tags_outweigh_place_where_two_functions_compete():
    # the comment stands right above f, but speaks of the parameters of g
    text = "// @param left never empty\n// @param right may be null\nconst f = x => 1;\nconst g = (left, right) => left;\n"
    g = dict(fn(1, "g", 4), signature="g(left, right)")
    assert linked(text, "a.js", [fn(0, "f", 3), g]) == [(None, None), ("@param left never empty", "near")]
    # with nobody else to claim it, place keeps it
    assert linked(text, "a.js", [fn(0, "f", 3)]) == [("@param left never empty", "comment")]


def test_the_assignment_beats_the_best_link_first():
    # loadPage fits the second comment best, but the best total leaves that to savePage, which fits no other
    text = "// loadPage keeps the order.\n/* loadPage and savePage share a lock. */\nfunction loadPage(x) {}\nfunction savePage(x) {}\n"
    got = linked(text, "a.js", [fn(0, "loadPage", 3), fn(1, "savePage", 4)])
    assert got == [("loadPage keeps the order.", "near"), ("loadPage and savePage share a lock.", "near")]
    assert linked(text, "a.js", [fn(0, "loadPage", 3)]) == [("loadPage and savePage share a lock.", "comment")]


def test_a_name_reaches_over_a_blank_line_and_a_stranger_does_not():
    assert linked("# read_all blocks for long.\n\ndef read_all(x): pass\n", "a.py", [fn(0, "read_all", 3)]) == [("read_all blocks for long.", "near")]
    assert linked("# Part two of the module.\n\ndef read_all(x): pass\n", "a.py", [fn(0, "read_all", 3)]) == [(None, None)]
    text = "# read_all blocks for long.\n\n\n\n\n\n\n\ndef read_all(x): pass\n"
    assert linked(text, "a.py", [fn(0, "read_all", 9)]) == [(None, None)]


def test_within_the_body_only_with_evidence():
    text = "def read_all(x):\n    # read_all blocks for long.\n    return x\n\ndef b(x):\n    # a step\n    return x\n"
    assert linked(text, "a.py", [fn(0, "read_all", 1), fn(1, "b", 5)]) == [("read_all blocks for long.", "near"), (None, None)]


def test_tables(spark):
    node = "id string, type string, name string, qualified_name string, file_path string, start_line int, end_line int, signature string, docstring string, source_snippet string, updated_at int, found string"
    rows = [
        ("1", "FUNCTION", "a", "q", "m.py", 5, 6, "a(x)", None, None, 1, "x"), ("2", "METHOD", "b", None, "m.py", 11, 13, None, " ", "s", 1, "x"), ("3", "METHOD", "z", None, "lost.py", 1, 1, None, "Not thread-safe.", "snip", 1, "x"), ("3", "METHOD", "z", None, "lost.py", 1, 1, None, "TODO", "snip", 0, "x"),
        ("4", "CLASS", "C", None, "m.py", 8, 8, None, "Says much.", None, 1, "x"), ("5", "FUNCTION", None, None, None, None, None, None, None, None, None, None), ("6", "FUNCTION", "d", None, "m.py", 18, 19, None, "d", None, 1, "x"), (None, "FUNCTION", "d", None, "m.py", 18, 19, None, "Says.", None, 1, "x"),
    ]
    nodes = spark.createDataFrame(rows, node)
    files = spark.createDataFrame([("m.py", PY, 1), ("m.py", None, 2), ("lost.py", None, 1)], "file_path string, content string, scanned_at int")
    assert sorted(r[0] for r in doc_pairs.documented(nodes, files).collect()) == ["1", "2", "3"]
    pairs = {r["id"]: r for r in doc_pairs.pairs(nodes, files).collect()}
    assert set(pairs) == {"1", "2", "3"} and pairs["3"]["code_from"] == "snippet" and pairs["1"]["documentation_from"] == "comment" and pairs["2"]["code"].lstrip().startswith("def b")
    assert doc_pairs.documented(nodes.limit(0), files).count() == 0 and doc_pairs.documented(nodes, files.limit(0)).count() == 1


def test_functions_of_a_file_are_placed_together(spark):
    node = "id string, type string, name string, qualified_name string, file_path string, start_line int, end_line int, signature string, docstring string, source_snippet string, updated_at int, x string"
    places = [("has", "a.py", 2, "Idempotent; safe to repeat."), ("stale", "a.py", 40, None), ("right", "b.py", 2, None), ("far", "b.py", 6000, None)]
    nodes = spark.createDataFrame([(i, "FUNCTION", "f", None, path, line, line + 1, "f(x)", doc, None, 1, "x") for i, path, line, doc in places], node)
    files = spark.createDataFrame([(p, "# Not thread-safe.\ndef f(x):\n    return x\n", 1) for p in ("a.py", "b.py")], "file_path string, content string, scanned_at int")
    assert sorted(r[0] for r in doc_pairs.documented(nodes, files).collect()) == ["has", "right"]
    assert sorted(r["id"] for r in doc_pairs.pairs(nodes, files).collect()) == ["has", "right"]
