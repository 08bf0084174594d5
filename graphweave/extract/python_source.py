"""Python files by the standard syntax tree. A file that doesn't parse keeps its FILE node and an error."""

from __future__ import annotations

import ast
import re
import warnings

from graphweave.extract.records import Parsed

_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def parse(path: str, text: str) -> Parsed:
    out = Parsed(path, "python")
    top = out.file(text)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as bad:
        out.error = f"{type(bad).__name__}: {bad}"[:500]
        return out
    lines = text.splitlines()
    for node in tree.body:
        _statement(out, node, top, None, lines)
    return out


def _statement(out: Parsed, node: ast.stmt, parent: str, owner: str | None, lines: list[str]) -> None:
    """A statement of a module (owner None) or of a class body. Blocks of if, try and with aren't entered."""
    if isinstance(node, ast.ClassDef):
        _class(out, node, lines)
    elif isinstance(node, _DEFS):
        _function(out, node, parent, owner, lines)
    elif isinstance(node, ast.Assign):
        for target in node.targets:
            if isinstance(target, ast.Name):
                _variable(out, target.id, node, parent, lines)
    elif isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name):
        _variable(out, node.target.id, node, parent, lines)
    elif isinstance(node, ast.Import) and owner is None:
        for alias in node.names:
            out.imports.append(alias.name)
            out.edge(parent, alias.name, "IMPORTS")
    elif isinstance(node, ast.ImportFrom) and owner is None:
        module = "." * node.level + (node.module or "")
        out.imports.append(module)
        for alias in node.names:
            out.edge(parent, f"{module}{'' if module.endswith('.') else '.'}{alias.name}", "IMPORTS")


def _doc(node: ast.AST) -> str | None:
    doc = ast.get_docstring(node, clean=False)
    return doc.strip() if doc is not None else None


def _code(node: ast.stmt, lines: list[str]) -> str:
    return "\n".join(lines[node.lineno - 1 : node.end_lineno])


def _class(out: Parsed, node: ast.ClassDef, lines: list[str]) -> None:
    name = f"{out.path}.{node.name}"
    out.node("CLASS", node.name, name, node.lineno, node.end_lineno, None, _doc(node), _code(node, lines))
    out.edge(out.path, name, "DEFINES")
    for base in node.bases:
        if isinstance(base, (ast.Name, ast.Attribute)):
            out.edge(name, ast.unparse(base), "INHERITS")
    for inner in node.body:
        _statement(out, inner, name, name, lines)


def _function(out: Parsed, node: ast.FunctionDef | ast.AsyncFunctionDef, parent: str, owner: str | None, lines: list[str]) -> None:
    name = f"{parent}.{node.name}"
    returns = f" -> {ast.unparse(node.returns)}" if node.returns is not None else ""
    out.node("METHOD" if owner else "FUNCTION", node.name, name, node.lineno, node.end_lineno, f"{node.name}{_parameters(node, lines)}{returns}", _doc(node), _code(node, lines))
    out.edge(parent, name, "CONTAINS" if owner else "DEFINES")
    for statement in node.body:
        for inner in ast.walk(statement):
            if isinstance(inner, ast.Call):
                out.edge(name, ast.unparse(inner.func), "CALLS")


_PIECE = re.compile(r"""'{3}[\s\S]*?'{3}|"{3}[\s\S]*?"{3}|'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*"|\#[^\n]*|[()\[\]{}]""")


def _parameters(node: ast.FunctionDef | ast.AsyncFunctionDef, lines: list[str]) -> str:
    """The parameter list as written, white space folded."""
    text = "\n".join(lines[node.lineno - 1 : node.body[0].lineno])
    start = text.find("(", text.find(node.name))
    depth = 0
    for m in _PIECE.finditer(text, start):
        if m.group() in "([{":
            depth += 1
        elif m.group() in ")]}":
            depth -= 1
            if not depth:
                return re.sub(r"\s+", " ", text[start : m.end()])
    return f"({ast.unparse(node.args)})"


def _variable(out: Parsed, name: str, node: ast.stmt, parent: str, lines: list[str]) -> None:
    qualified = out.node("VARIABLE", name, f"{parent}.{name}", node.lineno, node.end_lineno, None, None, _code(node, lines))
    out.edge(parent, qualified, "DEFINES")
