"""Answers as short text under a token budget. Input is what the engine returns: small, collected rows."""

from __future__ import annotations

from collections.abc import Callable

from graphweave.config import TOKENS_PER_ANSWER
from graphweave.operators.text import MARKER

Count = Callable[[str], int]


def count_tokens(text: str) -> int:
    """A quarter of the characters, at least 1; 0 for an empty text. Any tokenizer's count can take its place."""
    return 0 if not text else max(1, len(text) // 4)


def apply_budget(text: str, most: int = TOKENS_PER_ANSWER, count: Count = count_tokens) -> str:
    """The longest run of first lines that fits with the marker; a first line that is too long is cut itself. 0 or less: no limit."""
    if most <= 0 or count(text) <= most:
        return text
    room = most - count(MARKER) - 2
    kept: list[str] = []
    used = 0
    for line in text.split("\n"):
        cost = count(line) + 1
        if used + cost > room:
            break
        kept.append(line)
        used += cost
    if not kept:
        kept = [text.split("\n", 1)[0][: max(0, most * 4 - len(MARKER))]]
    return "\n".join([*kept, MARKER])


def _cut(text: str | None, n: int) -> str:
    return (text or "")[:n]


def _doc(text: str | None, n: int = 80) -> str:
    lines = (text or "").strip().splitlines()
    return lines[0][:n] if lines else ""


def _tail(path: str | None, parts: int = 3) -> str:
    return "/".join((path or "").split("/")[-parts:])


def _more(rows: list, shown: int) -> list[str]:
    return [f"... {len(rows) - shown} more"] if len(rows) > shown else []


def _head(r: dict, sig: int = 120) -> str:
    line = f"{r.get('type', '')} {_cut(r.get('signature') or r['name'], sig)}"
    where = _tail(r.get("file_path"), 1)
    return line + (f"  {where}:{r['start_line']}" if where and r.get("start_line") is not None else f"  {where}" if where else "")


def _missing(d: dict, key: str) -> list[str] | None:
    if d.get("error"):
        return [f"Error: {d['error']}"]
    return [f"Not found: {d.get(key, '')}"] if not d.get("found", True) else None


def get_function(d: dict) -> list[str]:
    out = []
    for r in d["rows"][:8]:
        out.append(_head(r))
        if _doc(r.get("docstring")):
            out.append("  " + _doc(r["docstring"]))
    return out + _more(d["rows"], 8)


def _calls(word: str) -> Callable[[dict], list[str]]:
    def lines(d: dict) -> list[str]:
        return [f"{len(d['rows'])} {word} of {d['name']}", *(f"- {r['name']} ({_tail(r['file_path'])})" for r in d["rows"][:10]), *_more(d["rows"], 10)]

    return lines


def get_file_map(d: dict) -> list[str]:
    out = [f"{_tail(d['path'])}: {len(d['rows'])} symbols"]
    for r in d["rows"][:15]:
        flow = (f" <-{r['callers']}" if r.get("callers") else "") + (f" ->{r['callees']}" if r.get("callees") else "")
        out.append(f"{r['start_line']}: {r['type']} {_cut(r.get('signature') or r['name'], 80)}{flow}")
    return out + _more(d["rows"], 15)


def search_symbol(d: dict) -> list[str]:
    return [f"{len(d['rows'])} symbols for {d['query']}", *(_head(r, 60) for r in d["rows"][:12]), *_more(d["rows"], 12)]


def get_related(d: dict) -> list[str]:
    out = []
    for title, key, n in (("Imports", "imports", 8), ("Imported by", "importers", 8), ("Two steps away", "two_hop", 5)):
        if d.get(key):
            out += [f"{title}:", *(f"- {_tail(p)}" for p in d[key][:n])]
    return out or ["No import relationships"]


def get_context(d: dict) -> list[str]:
    out = [_tail(d["path"])]
    for r in d["symbols"]:
        out.append(f"{r['lines']}: {r['type']} {_cut(r.get('signature') or r['name'], 80)}")
        if _doc(r.get("docstring"), 120):
            out.append("  " + _doc(r["docstring"], 120))
    for title, key in (("Imports", "imports"), ("Incoming", "incoming"), ("Outgoing", "outgoing")):
        if d.get(key):
            out.append(f"{title}:")
            out += [f"- {_tail(x)}" if isinstance(x, str) else f"- {x['symbol']} {x['type']} {x['other']} ({_tail(x['other_file'])})" for x in d[key][:10]]
    return out


def get_hierarchy(d: dict) -> list[str]:
    out = [_head(d["class"])] if d.get("class") else []
    if d.get("class") and _doc(d["class"].get("docstring"), 100):
        out.append("  " + _doc(d["class"]["docstring"], 100))
    for relation, word in (("parent", "extends"), ("child", "extended by")):
        out += [f"{word} {r['name']} ({_tail(r['file_path'])})" for r in d["relations"] if r["relation"] == relation]
    return out + [f"- {_cut(r.get('signature') or r['name'], 80)}" for r in d["methods"]]


def get_stats(d: dict) -> list[str]:
    by = lambda rows: ", ".join(f"{r['type']} {r['n']}" for r in sorted(rows, key=lambda r: (-r["n"], r["type"])))
    out = [f"{d['symbols']} symbols: {by(d['node_types'])}", f"{d['edges']} edges: {by(d['edge_types'])}", f"{d['files']} files; languages: {', '.join(sorted(d['languages']))}"]
    return out + [f"- {_tail(r['file_path'])}: {r['symbols']}" for r in d["hotspots"][:7]]


def get_definition(d: dict) -> list[str]:
    out = []
    for r in d["rows"]:
        out.append(_head(r, 140))
        if _doc(r.get("docstring"), 120):
            out.append("  " + _doc(r["docstring"], 120))
        for relation, mark in (("callee", "->"), ("caller", "<-")):
            names = [c["name"] for c in d["calls"] if c["hit"] == r["id"] and c["relation"] == relation][:8]
            if names:
                out.append(f"  {mark} {', '.join(names)}")
    return out


def search_semantic(d: dict) -> list[str]:
    return [f"{r['score']:.3f} {_head(r, 60)}" for r in d["rows"][:12]] or ["No matches"]


def reindex_embeddings(d: dict) -> list[str]:
    return [f"{d['encoded']} vectors encoded"]


def get_diff_context(d: dict) -> list[str]:
    if not d["files"]:
        return ["No changes"]
    out = []
    for f in d["files"][:10]:
        out.append(f"{_tail(f['file'])} {', '.join(f'{a}-{b}' for a, b in f['ranges'][:5])}")
        out += [f"  {r['type']} {_cut(r.get('signature') or r['name'], 80)}" for r in f["symbols"][:10]]
    for relation in ("caller", "callee"):
        names = [r["name"] for r in d["radius"] if r["relation"] == relation][:8]
        if names:
            out.append(f"{relation}s: {', '.join(names)}")
    return out


FORMATS: dict[str, tuple[Callable[[dict], list[str]], str]] = {
    "get_function": (get_function, "name"),
    "get_callers": (_calls("callers"), "name"),
    "get_callees": (_calls("callees"), "name"),
    "get_file_map": (get_file_map, "path"),
    "search_symbol": (search_symbol, "query"),
    "get_related": (get_related, "path"),
    "get_context": (get_context, "path"),
    "get_hierarchy": (get_hierarchy, "name"),
    "get_stats": (get_stats, ""),
    "get_definition": (get_definition, "name"),
    "search_semantic": (search_semantic, "query"),
    "reindex_embeddings": (reindex_embeddings, ""),
    "get_diff_context": (get_diff_context, ""),
}


def render(tool: str, answer: dict, budget: int = TOKENS_PER_ANSWER, count: Count = count_tokens) -> str:
    """The text of a tool's answer within the budget."""
    lines, key = FORMATS[tool]
    return apply_budget("\n".join(_missing(answer, key) or lines(answer)), budget, count)
