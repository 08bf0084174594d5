from graphweave.extract.records import snippet
from graphweave.extract.registry import parse_files, parse_text

PY = '''import a.b as c
from .m import x
from . import y
from p.q import (r, s as t)
LIMIT: int = 3
one, two = 1, 2

@deco
async def top(a, *, b="(") -> dict[str, int]:
    """Says
    something."""
    def inner():
        deep.call()
    return inner(a.run())

class Outer(Base, mod.Mixin, Generic[int], metaclass=M):
    size = 4
    def scan(self):
        self._helper()
    class Inner:
        pass

if True:
    def hidden(): pass
'''

TS = '''import React, { useState as use } from 'react';
import type { T } from "./types";
/** Renders { the app. */
export class App extends Component<Props> {
  private x = 1;
  async render(a: string, b?: number): Promise<any> {
    const s = `}{ ${a}`;
    if (a) { this.go(helper(b)); }
    return new Thing(a);
  }
}
export const arrow = async (a: number): Promise<number> => { return other(a); };
export function plain<T>(x: T): T { return x; }
function* gen() { yield 1; }
interface Shape { side: number; call(): void }
type Alias = { a: string } | null;
const LIMIT = 3;
'''


def names(parsed, kind):
    return [n["name"] for n in parsed.nodes if n["type"] == kind]


def edges(parsed, kind):
    return {(e["source_qualified"], e["target_qualified"]) for e in parsed.edges if e["type"] == kind}


def test_python_symbols():
    p = parse_text("d/m.py", PY)
    assert p.error is None and p.imports == ["a.b", ".m", ".", "p.q"]
    assert names(p, "CLASS") == ["Outer", "Inner"] and names(p, "METHOD") == ["scan"] and names(p, "FUNCTION") == ["top"]
    assert names(p, "VARIABLE") == ["LIMIT", "size"]
    top = next(n for n in p.nodes if n["name"] == "top")
    assert top["signature"] == 'top(a, *, b="(") -> dict[str, int]' and top["docstring"].startswith("Says") and top["start_line"] == 9
    assert edges(p, "INHERITS") == {("d/m.py.Outer", "Base"), ("d/m.py.Outer", "mod.Mixin")}
    assert ("d/m.py.top", "deep.call") in edges(p, "CALLS") and ("d/m.py.top", "a.run") in edges(p, "CALLS")
    assert ("d/m.py", "d/m.py.Inner") in edges(p, "DEFINES") and ("d/m.py.Outer", "d/m.py.Outer.scan") in edges(p, "CONTAINS")
    assert ("d/m.py", ".m.x") in edges(p, "IMPORTS") and ("d/m.py", ".y") in edges(p, "IMPORTS")


def test_script_symbols():
    p = parse_text("App.tsx", TS)
    assert p.error is None and p.imports == ["react", "./types"]
    assert names(p, "CLASS") == ["App"] and names(p, "METHOD") == ["render"]
    assert names(p, "FUNCTION") == ["arrow", "plain", "gen"] and names(p, "TYPE") == ["Shape", "Alias"] and names(p, "VARIABLE") == ["LIMIT"]
    app = next(n for n in p.nodes if n["name"] == "App")
    assert app["docstring"] == "Renders { the app." and edges(p, "INHERITS") == {("App.tsx.App", "Component")}
    assert ("App.tsx.App.render", "this.go") in edges(p, "CALLS") and ("App.tsx.App.render", "Thing") not in edges(p, "CALLS")
    assert ("App.tsx", "react.useState") in edges(p, "IMPORTS") and ("App.tsx", "react.default") in edges(p, "IMPORTS")
    assert ("App.tsx", "App.tsx.arrow") in edges(p, "EXPORTS") and ("App.tsx", "App.tsx.gen") not in edges(p, "EXPORTS")


def test_two_small_files_of_the_inventory():
    scanner = parse_text("test.py", "class Scanner:\n    def scan(self):\n        self._helper()\n")
    assert names(scanner, "CLASS") == ["Scanner"] and names(scanner, "METHOD") == ["scan"]
    app = parse_text("App.tsx", "import { Component } from 'react';\nclass App extends Component {\n  render() {\n    return null;\n  }\n}\n")
    assert "react" in app.imports and names(app, "CLASS") == ["App"]


def test_snippet_of_ten_and_eleven_lines():
    ten = "\n".join(map(str, range(10)))
    assert snippet(ten) == ten
    assert snippet(ten + "\n10").split("\n")[5] == "… (3 more lines)"
    assert len(snippet("x" * 2001)) == 2000


def test_failures_become_rows(spark):
    rows = [("a.py", "def ("), ("b.rb", "x"), ("c.ts", None), ("d.py", ""), ("e.JS", "function f() {")]
    got = {r["file_path"]: r for r in parse_files(spark.createDataFrame(rows, "file_path string, content string")).collect()}
    assert got["a.py"]["error"].startswith("SyntaxError") and got["b.rb"]["error"] and got["c.ts"]["error"] == "unreadable"
    assert got["d.py"]["error"] is None and len(got["d.py"]["nodes"]) == 1 and got["e.JS"]["error"]


def symbols(text, path="m.ts"):
    return [(n["type"], n["name"], n["signature"], n["start_line"], n["end_line"]) for n in parse_text(path, text).nodes[1:]]


def test_script_declarations_that_lines_do_not_show():
    assert symbols("const f = x => x + 1") == [("FUNCTION", "f", "f(x)", 1, 1)]
    p = parse_text("m.ts", "export default class extends Q.R<T> {\n  run() { go(); }\n}")
    assert [(n["type"], n["name"]) for n in p.nodes[1:]] == [("CLASS", "default"), ("METHOD", "run")]
    assert edges(p, "INHERITS") == {("m.ts.default", "Q.R")} and edges(p, "EXPORTS") == {("m.ts", "m.ts.default")} and edges(p, "CALLS") == {("m.ts.default.run", "go")}
    assert [s[:2] for s in symbols("function a() { b(); } function b() {} class C { m() {} n() {} } const d = 1, e = () => 2; type T = { a: { b: string } } | null")] == [
        ("FUNCTION", "a"), ("FUNCTION", "b"), ("CLASS", "C"), ("METHOD", "m"), ("METHOD", "n"), ("VARIABLE", "d"), ("FUNCTION", "e"), ("TYPE", "T"),
    ]
    assert symbols("export default function () { return 1 }") == [("FUNCTION", "default", "default()", 1, 1)]


def test_script_nesting_strings_and_types():
    text = """
function outer(a: { x: number } = {x: 1}, re = /[}/]{2}/g): Promise<{ y: string }> {
  function inner() { return `}${ {a: "`}"} }`; }
  const o = { method() { deep(); }, get g() { return 1 } };
  return a ? inner() : o?.method?.();
}
abstract class K<T extends { a: 1 }> extends mixin(Base) implements I<T> {
  @deco({ a: 1 }) private readonly field: Map<string, number[]> = new Map();
  handler = (e) => { this.on(e) }
  static async *gen<T>(x: T): AsyncGenerator<T> { yield x }
  abstract go(x: number): void;
  get size() { return 1 }
  'quoted name'() {}
}
const g = async <T,>(v: T): Promise<void> => { await outer(v) }
const { a, b } = g, [c] = g;
let late: (x: number) => void;
interface I<T> extends J { (a: string): void; b(): void }
"""
    p = parse_text("m.ts", text)
    got = [(n["type"], n["name"]) for n in p.nodes[1:]]
    assert got == [
        ("FUNCTION", "outer"), ("CLASS", "K"), ("METHOD", "gen"), ("METHOD", "go"), ("METHOD", "size"), ("METHOD", "quoted name"), ("FUNCTION", "g"), ("VARIABLE", "late"), ("TYPE", "I"),
    ]
    outer = next(n for n in p.nodes if n["name"] == "outer")
    assert (outer["start_line"], outer["end_line"]) == (2, 6) and outer["signature"] == "outer(a: { x: number } = {x: 1}, re = /[}/]{2}/g): Promise<{ y: string }>"
    assert edges(p, "CALLS") >= {("m.ts.outer", "inner"), ("m.ts.outer", "o.method"), ("m.ts.outer", "deep"), ("m.ts.g", "outer")} and ("m.ts.outer", "method") not in edges(p, "CALLS")
    assert not edges(p, "INHERITS") and p.error is None
    assert parse_text("m.js", "function f() {").error and parse_text("m.js", "").error is None


def test_script_imports():
    p = parse_text("m.ts", "import 'side';\nimport D, { a as b, type C } from \"x\"; import * as ns from './y'\nimport type { E } from 'z';\nconst lazy = import('w');\nconsole.log(import.meta.url)\n")
    assert p.imports == ["side", "x", "./y", "z"]
    assert edges(p, "IMPORTS") == {("m.ts", "x.default"), ("m.ts", "x.a"), ("m.ts", "x.C"), ("m.ts", "z.E")}
