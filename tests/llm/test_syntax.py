import random
from pathlib import Path

import pytest

from graphweave.llm import syntax_js, syntax_py, validity

GOOD_JS = [
    "", "#!/usr/bin/env node\nlet a = 1", "/a[/]b/g.test(x); a = b / c / d; x = y\n/z/g;", "if (a) /re/.test(b); else {}", "a\n++b", "`a${`b${c}`}d`", "({a = 1} = {})", "({a = 1}) => a",
    "async x => await x", "var x = function* () { yield; yield* a; }", "label: for (;;) { break label }", "import('x').then(); import.meta.url; export * as ns from 'a';", "for (const [k, v] of Object.entries(x)) {}",
    "do x(); while (0) y()", "try{}catch{}finally{}", "1..toString(); 0x1F; 1_000n; .5e-3", "x = class { #a = 1; static b; static { this.c = 1 } has(o) { return #a in o } }", "a?.b?.[c]?.(d) ?? e; y ||= 1", "const x = await f();", "var await = 1;", "[a, b] = [b, a]",
]
BAD_JS = ["let x: number = 1", "<div/>", "interface A {}", "a b", "x = {a = 1}", "1 = 2", "return 1", "break", "if (", "`abc${", "'abc", "/abc", "({a}", "let [a];", "const x;", "var 1a", "/* x", "@", "a ? b", "def f(x): pass", "<<<<<<< HEAD\na = 1\n=======\na = 2\n>>>>>>> x"]
GOOD_TS = [
    "type A<T> = T extends (infer U)[] ? U : never;", "interface X extends Y<Z> { (a: number): string; new (x: any): X; readonly [k: string]: any; m?<T>(a: T): void }", "enum E { A = 1, B, 'c' = 3 }",
    "abstract class A<T> extends B<T> implements C { private readonly x: number = 1; constructor(public a: string) { super() } abstract foo(): void; [k: string]: any }", "const g = <T,>(x: T): T => x;", "let w = <any>z; foo<string>(1); a < b; let y = x as unknown as string; z!;",
    "import type { A } from 'a'; import { type B } from 'b'; import fs = require('fs');", "type M = { readonly [K in keyof T]?: T[K] }; type TL = `a${string}b`;", "const h = b ? (c: number): d => e : f;", "function o(a: string): void; function o(a: any) {}", "let x: Array<Map<string, number[]>> = y;",
]
GOOD_JSX = ["x = <div className=\"a\" b={c} {...d} e><p>Don't {x} &amp; <A.B/></p><></></div>;"]
BAD_JSX = ["x = <div>", "x = <div></p>", "x = <div>}</div>", "x = <a b=c/>"]
PY = [
    "", "x = 1", "def f(a, /, b, *, c=1, **k) -> int:\n    return a", "match x:\n    case {'a': [1, *_], **r} if y: pass\n    case A(b=1) | None: pass", "match = 1; match(x)", "type X[T: int] = list[T]", "f'{a !r:>{w}} {b = } {{}} {f\"{c}\"}'",
    "with (open(a) as b, c): pass", "async def f():\n    async with a: await b\n    return [x async for x in y]", "x: int = (yield_ := 3)", "try: pass\nexcept* A as e: pass", "lambda *a, k=1: a", "print(*a, **b, )", "a = b = c, *d = e", "@x.y\nclass A(B, m=C): pass", "if 1:\n\tx\n\ty", "x = '''a\nb'''", "0xFF + 1_0j + .5e3",
    "def f(:", "x = (1", "x = )", "return 1", "if x:\npass", "  x", "f(a=1, 2)", "'abc", "'''abc", "1 = x", "f(x) = 1", "def f(a, a): pass", "a b", "x = 012", "for x in y", "class A\n  pass", "<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b", "f'{a'", "f'{}'", "break", "x +=", "import", "from a import", "else: pass", "if x:\n    y\n  z", "b'é'", "def f():\n    yield = 1", "del f()", "lambda a=1, b: a", "{**a, b}", "from __future__ import teleportation", "async def f():\n    yield 1\n    return 2", "async def f():\n    yield from a", "if a:\n        x\n\ty", "f'{a +'\nx", "async for x in y: pass",
]


@pytest.mark.parametrize("text", GOOD_JS)
def test_javascript_is_accepted(text):
    assert not syntax_js.faults(text, False, False)


@pytest.mark.parametrize("text", BAD_JS)
def test_javascript_is_refused(text):
    assert syntax_js.faults(text, False, False)


@pytest.mark.parametrize("text", GOOD_TS)
def test_typescript_is_accepted(text):
    assert not syntax_js.faults(text, True, False)


def test_jsx():
    for types in (False, True):
        assert not any(syntax_js.faults(t, types, True) for t in GOOD_JSX)
        assert all(syntax_js.faults(t, types, True) for t in BAD_JSX)


@pytest.mark.parametrize("text", PY)
def test_python_agrees_with_the_interpreter(text):
    try:
        compile(text, "x", "exec", dont_inherit=True)
        valid = True
    except SyntaxError:
        valid = False
    assert (not syntax_py.faults(text)) == valid


def test_recovery_finds_later_errors_and_the_first_cause():
    found = syntax_js.faults("let a = ;\nfunction ok() { return 1; }\nlet b = = 2;\n", False, False)
    assert [f.line for f in found] == [1, 3]
    found = syntax_py.faults("x = = 1\ny = 2\nz = )\n")
    assert {1, 3} <= {f.line for f in found}


def test_files_rows(spark):
    rows = [
        ("/r/a.py", "/r", "x = 1", 1), ("/r/a.py", "/r", "x = 1", 2), ("/r/b.PY", None, "def (", 1), ("/r/c.ts", "/r", None, 1), ("/r/d.md", "/r", "# x", 1), ("/r/e.js", "/r", "", 1), (None, None, "x", 1),
        ("/r/f.js", None, "let a: number", 1), ("/r/g.ts", "/r", "let a: number", 1), ("/r/h.py", "/r", "x = (\n" * 3000, 1), ("/r/i.py", "/r", "x =", 1), ("/r/i.py", "/r", "x = 1", 2),
    ]
    df = spark.createDataFrame(rows, "file_path string, repo_path string, content string, scanned_at int").withColumn("errors", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    got = {r["file_path"]: r for r in validity.check_files(df).collect()}
    assert len(got) == 10
    assert {p for p, r in got.items() if r["valid"] is False} == {"/r/b.PY", "/r/f.js", "/r/h.py"}
    assert got["/r/c.ts"]["valid"] is None and not got["/r/c.ts"]["readable"] and got["/r/d.md"]["language"] is None and got["/r/e.js"]["valid"]
    assert got["/r/b.PY"]["repo_path"] == "/r" and got["/r/b.PY"]["first_cause"] and got["/r/a.py"]["n_errors"] == 0
    assert {r[0] for r in validity.invalid_files(df).collect()} == {"/r/b.PY", "/r/f.js", "/r/h.py"}
    said = spark.createDataFrame([("/r/b.PY", "bad"), ("/r/a.py", "worker lost"), ("/r/e.js", " ")], "file_path string, error string")
    whole = {r["language"]: r for r in validity.rates(validity.check_files(df), said).where("whole").collect()}
    assert whole["python"]["invalid"] == 2 and whole["python"]["told"] == 1 and whole["python"]["false_alarms"] == 1
    assert validity.rates(validity.check_files(df.limit(0))).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_python_agrees_with_the_interpreter_on_damaged_texts(seed):
    """Lines lost, cut, doubled and indented anew: the interpreter is the oracle, the parser alone the verdict."""
    rng = random.Random(seed)
    source = Path(syntax_py.__file__).with_name("packing.py").read_text() + Path(syntax_py.__file__).with_name("syntax.py").read_text().replace("from __future__ import annotations", "")
    for _ in range(60):
        lines = source.split("\n")[: rng.randrange(20, 160)]
        at = rng.randrange(len(lines))
        how = rng.randrange(5)
        if how == 0:
            del lines[at : at + rng.randrange(1, 4)]
        elif how == 1:
            lines[at] = lines[at][: rng.randrange(len(lines[at]) + 1)]
        elif how == 2:
            lines[at:at] = lines[:2]
        elif how == 3:
            lines[at] = rng.choice(["", " ", "\t"]) + lines[at].lstrip()
        else:
            lines[at] += rng.choice(["(", ")", " yield", "'", " await x", "\\", " if", "=", ":"])
        text = "\n".join(lines)
        try:
            compile(text, "x", "exec", dont_inherit=True)
            valid = True
        except SyntaxError:
            valid = False
        assert (not syntax_py.faults(text)) == valid, text
