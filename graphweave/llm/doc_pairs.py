"""Functions and methods with their code and the documentation that belongs to them.

Where a symbol carries no documentation, its file may. Candidates of a function are the string at
the head of its body and all comment blocks near it: above it, with or without a gap or other code
between, behind its head and at the top of its body. Comments and undocumented functions of a file
form a bipartite graph, with links scored by distance, indentation, the code between, parameter tags
and names; tags that name other parameters count against a link. The assignment of highest total
score gives each comment to at most one function and each function at most one comment; links whose
score is implausible are rejected, and so are descriptions that say nothing.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.llm.docs import informative
from graphweave.llm.validity import extension

#: Links below this score are implausible.
LEAST_SCORE = 2.0
#: Lines above a function, and within its body, in which a comment can still reach that score.
ABOVE, WITHIN = 6, 3
#: What a link starts from by the comment's place, and what each line of distance, other indentation and code between cost.
PLACE = {"head": 3.5, "above": 3.5, "within": 1.4}
GAP, INDENT, CODE = 1.6, 1.6, 0.6
#: What parameter tags are worth if all are the function's, and cost if none is; the function's name, or another one's, in the text.
TAGS, OTHER_TAGS, NAMED, OTHER_NAMED = 1.8, 1.0, 1.0, 0.8
#: What says something goes before what doesn't.
SAYS = 1.0

_PY_SIGNATURE = re.compile(r"""[rRbBuUfF]{0,2}(?:'''(?:[^\\]|\\.)*?'''|\"\"\"(?:[^\\]|\\.)*?\"\"\"|'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*")|\#[^\n]*|[()\[\]{}:]""", re.S)
_PY_GAP = re.compile(r"(?:[ \t\f]|\\\n|\#[^\n]*|\n)*")
_PY_BLANK = re.compile(r"[ \t]*")
_PY_STRING = re.compile(r"""([rRuU]?)('''(?:[^\\]|\\.)*?'''|\"\"\"(?:[^\\]|\\.)*?\"\"\"|'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*")""", re.S)
_TAG_LINE = re.compile(r"@param\s+(?:\{[^}]*\}+\s*)?\[?([A-Za-z_$][\w$]*)|:param\s+(?:\w+\s+)?([A-Za-z_]\w*)\s*:")


#: Names that aren't plain words, so that a text means the function by them.
_CODE_NAME = re.compile(r"_|[a-z][A-Z]|\d")
_IDENTIFIER = re.compile(r"[A-Za-z_$][\w$]*")


@dataclass
class Site:
    """Where a function is defined: its line, the first line of it and its decorators, and its indent."""

    line: int
    top: int
    indent: int
    at: int


@dataclass
class Comment:
    """A candidate: text, first and last line, indent, and the line of the function whose body it heads."""

    text: str
    first: int
    last: int
    indent: int
    head_of: int = -1


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" \t"))


def _definition(name: str, python: bool) -> re.Pattern:
    n = re.escape(name)
    if python:
        return re.compile(rf"^[ \t]*(?:async[ \t]+)?def[ \t]+{n}\b", re.M)
    return re.compile(
        rf"^[ \t]*(?:(?:export|default|declare|public|private|protected|static|abstract|readonly|override|async|get|set)[ \t]+)*"
        rf"(?:function[ \t]*\*?[ \t]*{n}\b|(?:const|let|var)[ \t]+{n}\b|\*?[ \t]*(?:{n}|'{n}'|\"{n}\"|\[[^\]\n]*\b{n}\])[ \t]*\??[ \t]*(?:[(<]|=(?!=)|:[^=\n]*=))",
        re.M,
    )


def _sites(text: str, lines: list[str], starts: list[int], name: str, python: bool, known: dict) -> list[Site]:
    if name not in known:
        found = []
        for m in _definition(name, python).finditer(text):
            at = m.start()
            line = _line_of(starts, at)
            top = line
            while top > 0 and lines[top - 1].lstrip().startswith("@") and not re.match(r"\s*@param\b", lines[top - 1]):
                top -= 1
            found.append(Site(line, top, _indent(lines[line]), m.end()))
        known[name] = found
    return known[name]


def _line_of(starts: list[int], at: int) -> int:
    lo, hi = 0, len(starts)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if starts[mid] <= at:
            lo = mid
        else:
            hi = mid
    return lo


def _place(functions: list[dict], text: str, lines: list[str], starts: list[int], python: bool) -> dict[int, Site]:
    """The site of each function (by its place in the list): the one at its line, else the nearest of its name left over."""
    known: dict[str, list[Site]] = {}
    placed: dict[int, Site] = {}
    taken: set[tuple[str, int]] = set()
    open_: list[tuple[int, int, Site]] = []
    for i, f in enumerate(functions):
        if not f["name"]:
            continue
        for s in _sites(text, lines, starts, f["name"], python, known):
            gap = abs(s.line + 1 - (f["start_line"] or 0))
            if gap == 0:
                placed[i] = s
                taken.add((f["name"], s.line))
                break
            open_.append((gap, i, s))
    for _, i, s in sorted(open_, key=lambda o: (o[0], o[1], o[2].line)):
        key = (functions[i]["name"], s.line)
        if i not in placed and key not in taken:
            placed[i] = s
            taken.add(key)
    return placed


def _head_string(text: str, at: int) -> str | None:
    """The string at the head of a Python body, from within the definition's signature on."""
    depth = 0
    for m in _PY_SIGNATURE.finditer(text, at):
        c = m.group()
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                return None
        elif c == ":" and depth == 0:
            break
    else:
        return None
    m2 = _PY_STRING.match(text, _PY_GAP.match(text, m.end()).end())
    if m2 is None:
        return None
    after = _PY_BLANK.match(text, m2.end()).end()
    if after < len(text) and text[after] not in "\n;#\"'":
        return None
    if "r" in m2.group(1).lower() or "\\" not in m2.group(2):
        body = m2.group(2)
        return body[3:-3] if body[:3] in ("'''", '"""') else body[1:-1]
    try:
        return ast.literal_eval(m2.group(2))
    except (ValueError, SyntaxError):
        return m2.group(2).strip("\"'")


def comments_of(lines: list[str], python: bool) -> list[Comment]:
    """All comment blocks of a file that stand on lines of their own, in order: runs of line comments of one indent, and block comments."""
    mark = "#" if python else "//"
    out: list[Comment] = []
    at, size = 0, len(lines)
    while at < size:
        bare = lines[at].lstrip()
        if bare.startswith(mark):
            first, indent = at, _indent(lines[at])
            while at + 1 < size and lines[at + 1].lstrip().startswith(mark) and _indent(lines[at + 1]) == indent:
                at += 1
            body = [x.strip().lstrip("#" if python else "/!") for x in lines[first : at + 1]]
            if python and first == 0 and lines[0].startswith("#!"):
                body = body[1:]
            out.append(Comment("\n".join(b[1:] if b.startswith(" ") else b for b in body), first, at, indent))
        elif not python and bare.startswith("/*"):
            first = at
            while at < size and "*/" not in lines[at]:
                at += 1
            if at < size and lines[at].rstrip().endswith("*/"):
                raw = re.sub(r"^/\*+!?|\*+/$", "", "\n".join(lines[first : at + 1]).strip())
                text = "\n".join(re.sub(r"^\s*\*+ ?", "", x) if x.lstrip().startswith("*") else x for x in raw.split("\n")).strip()
                out.append(Comment(text, first, at, _indent(lines[first])))
        at += 1
    return out


def _score(comment: Comment, site: Site, function: dict, lines: list[str], names: set[str]) -> float:
    """How well a comment fits a function: place and distance, then parameter tags and names. names: of the file's other functions."""
    if comment.head_of >= 0:
        if comment.head_of != site.line:
            return -1.0
        score = PLACE["head"]
    elif comment.last < site.top:
        gap = site.top - 1 - comment.last
        code = sum(1 for x in lines[comment.last + 1 : site.top] if x.strip() and not x.lstrip().startswith(("#", "//", "*", "/*")))
        score = PLACE["above"] - GAP * gap - CODE * code - (INDENT if comment.indent != site.indent else 0.0)
    else:
        score = PLACE["within"] - 0.3 * (comment.first - site.line - 1)
    tags = {a or b for a, b in _TAG_LINE.findall(comment.text)}
    if tags and function["signature"]:
        known = set(_IDENTIFIER.findall(function["signature"].partition("(")[2]))
        share = len(tags & known) / len(tags)
        score += TAGS * share if share else -OTHER_TAGS
    words = set(_IDENTIFIER.findall(comment.text))
    if function["name"] in words:
        score += NAMED
    elif words & names:
        score -= OTHER_NAMED
    return score if comment.text.strip() else -1.0


def assign(scores: dict[tuple[int, int], float]) -> dict[int, int]:
    """The assignment function -> comment of highest total score; each side used at most once.

    Links fall into small groups, as a comment is near few functions; each group is solved exactly
    by augmenting along the path that gains most.
    """
    links: dict[int, dict[int, float]] = {}
    for (f, c), s in scores.items():
        links.setdefault(f, {})[c] = s
    owner: dict[int, int] = {}
    mine: dict[int, int] = {}
    for f in sorted(links):
        # Bellman-Ford over alternating paths from f
        best: dict[int, tuple[float, tuple[int, ...]]] = {c: (s, (f, c)) for c, s in links[f].items()}
        changed = True
        while changed:
            changed = False
            for c, (gain, path) in list(best.items()):
                g = owner.get(c)
                if g is None or g in path[::2]:
                    continue
                for d, s in links[g].items():
                    if d != c and d not in path[1::2]:
                        new = gain - links[g][c] + s
                        if d not in best or new > best[d][0] + 1e-9:
                            best[d] = (new, (*path, g, d))
                            changed = True
        ends = [(gain, path) for c, (gain, path) in best.items() if c not in owner]
        # or the last one on the path goes without
        ends += [(gain - links[owner[c]][c], (*path, owner[c])) for c, (gain, path) in best.items() if c in owner]
        if not ends:
            continue
        gain, path = max(ends, key=lambda e: (e[0], -len(e[1]), e[1]))
        if gain <= 0:
            continue
        if len(path) % 2:  # somebody goes without
            mine.pop(path[-1], None)
            path = path[:-1]
        for k in range(0, len(path), 2):
            mine[path[k]] = path[k + 1]
            owner[path[k + 1]] = path[k]
    return mine


def match_file(text: str, path: str, functions: list[dict]) -> list[tuple[str | None, str | None, str | None]]:
    """(documentation found in the file, its kind, code) of each function; None where the file has none."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    lines = text.split("\n")
    starts = [0]
    for x in lines[:-1]:
        starts.append(starts[-1] + len(x) + 1)
    python = extension(path) in ("py", "pyi")
    placed = _place(functions, text, lines, starts, python)
    bare = {i: site for i, site in placed.items() if not (functions[i]["docstring"] or "").strip()}
    comments = comments_of(lines, python) if bare else []
    ends = [c.last for c in comments]
    names = {f["name"] for f in functions if f["name"] and _CODE_NAME.search(f["name"])}
    scores: dict[tuple[int, int], float] = {}
    for i, site in bare.items():
        near = list(range(bisect_left(ends, site.top - ABOVE), bisect_left(ends, site.line + WITHIN + 1)))
        if python:
            head = _head_string(text, site.at)
            if head is not None and head.strip():
                near.append(len(comments))
                comments.append(Comment(head, site.line, site.line, site.indent, head_of=site.line))
        f = functions[i]
        for c in near:
            score = _score(comments[c], site, f, lines, names - {f["name"]})
            if score >= LEAST_SCORE:
                scores[i, c] = score + (SAYS if informative(comments[c].text, f["name"], f["signature"]) else 0.0)
    chosen = assign(scores)
    out = []
    for i, f in enumerate(functions):
        site = placed.get(i)
        code = None
        if site:
            n = max(1, (f["end_line"] or 0) - (f["start_line"] or 0) + 1)
            code = "\n".join(lines[site.top : site.line + n])
        c = comments[chosen[i]] if i in chosen else None
        out.append((c.text if c else None, _origin(c, site) if c else None, code))
    return out


def _origin(comment: Comment, site: Site) -> str:
    """head: the string at the head of the body, comment: directly above the function and its decorators, near: elsewhere near it."""
    if comment.head_of >= 0:
        return "head"
    return "comment" if comment.last == site.top - 1 and comment.indent == site.indent else "near"


_NODE = ["id", "name", "signature", "docstring", "source_snippet", "file_path", "start_line", "end_line"]


def _latest(nodes: DataFrame) -> DataFrame:
    """Functions and methods, each id once with its newest row."""
    rows = nodes.where(F.col("type").isin("FUNCTION", "METHOD") & F.col("id").isNotNull())
    body = [c for c in _NODE if c != "id"]
    return rows.groupBy("id").agg(F.max_by(F.struct(*body), F.struct("updated_at", *[F.col(c) for c in body])).alias("s")).select("id", "s.*")


def _judge(rows: DataFrame) -> DataFrame:
    """Rows (id, name, signature, docstring) whose docstring is informative."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            name, signature, doc = (b.column(i).to_pylist() for i in (1, 2, 3))
            yield b.filter(pa.array([informative(d, n, s) for d, n, s in zip(doc, name, signature, strict=True)], pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def _with_files(rows: DataFrame, files: DataFrame, bare_only: bool = False) -> DataFrame:
    """rows with found, kind and code from their files; rows without a readable file are left out.

    All functions of a file are placed together, as one can only take what no other is nearer to.
    bare_only: only functions without a docstring (null) and their namesakes in the file are wanted.
    """
    text = files.where("content is not null and file_path is not null").groupBy("file_path").agg(F.max_by("content", "scanned_at").alias("content"))
    grouped = rows.where("file_path is not null").groupBy("file_path").agg(F.collect_list(F.struct(*[c for c in _NODE if c != "file_path"])).alias("functions"))
    if bare_only:  # functions compete for places with namesakes only
        bare = F.transform(F.filter("functions", lambda f: f["docstring"].isNull()), lambda f: f["name"])
        grouped = grouped.withColumn("bare", bare).where(F.size("bare") > 0)
        grouped = grouped.withColumn("functions", F.filter("functions", lambda f: f["docstring"].isNull() | F.array_contains("bare", f["name"])))
    both = grouped.join(text, "file_path").select("file_path", "content", "functions")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = []
            for path, content, functions in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for f, (found, kind, code) in zip(functions, match_file(content, path, functions), strict=True):
                    out.append([f["id"], f["name"], f["signature"], f["docstring"], f["source_snippet"], path, found, kind, code])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=["id", "name", "signature", "docstring", "source_snippet", "file_path", "found", "kind", "code"])

    return both.mapInArrow(run, "id string, name string, signature string, docstring string, source_snippet string, file_path string, found string, kind string, code string")


_BLANK = "docstring is null or trim(regexp_replace(docstring, '\\\\s+', ' ')) = ''"


def documented(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(id) of the functions and methods whose documentation says something; files are read only for those without a docstring.

    Of the links that the assignment makes, those count whose comment is the head of the body or stands directly above.
    """
    rows = _latest(nodes)
    own = _judge(rows.where(f"not ({_BLANK})").select("id", "name", "signature", "docstring")).select("id")
    # a function with a docstring only takes its place in the file
    bare = F.expr(_BLANK)
    placed = rows.withColumns({"signature": F.when(bare, F.col("signature")), "docstring": F.when(~bare, F.lit("-")), "source_snippet": F.lit(None).cast("string")})
    found = _with_files(placed, files, bare_only=True).where("kind in ('head', 'comment')").select("id", "name", "signature", F.col("found").alias("docstring"))
    return own.unionByName(_judge(found).select("id"))


def pairs(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """id, name, file_path, signature, code, code_from, documentation, documentation_from; informative ones only.

    Documentation is the docstring, else what the file holds: documentation_from is docstring, head,
    comment (directly above) or near (linked by tags or names from further away). Code is the function's text in its
    file where it is found there, else its snippet, else null. Of rows with one id the newest
    counts; rows of other types or without id are left out; extra columns are not read.
    """
    rows = _latest(nodes)
    near = _with_files(rows, files).select("id", "found", "kind", "code")
    doc = F.when(F.expr(_BLANK), F.col("found")).otherwise(F.col("docstring"))
    origin = F.when(F.expr(_BLANK), F.col("kind")).otherwise(F.lit("docstring"))
    joined = rows.join(near, "id", "left").select(
        "id", "name", "signature", doc.alias("docstring"), "file_path", F.coalesce("code", "source_snippet").alias("code"),
        F.when(F.col("code").isNotNull(), "file").when(F.col("source_snippet").isNotNull(), "snippet").alias("code_from"), origin.alias("documentation_from"),
    )
    return _judge(joined.where("docstring is not null")).withColumnRenamed("docstring", "documentation")
