"""What a parser returns for one file, and the snippet rule."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Parsed:
    path: str
    language: str
    nodes: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)
    error: str | None = None

    def node(self, kind: str, name: str, qualified: str, start: int, end: int, signature: str | None = None, doc: str | None = None, code: str | None = None) -> str:
        self.nodes.append(
            {"type": kind, "name": name, "qualified_name": qualified, "file_path": self.path, "start_line": start, "end_line": end, "language": self.language, "signature": signature, "docstring": doc, "source_snippet": snippet(code) if code is not None else None}
        )
        return qualified

    def edge(self, source: str, target: str, kind: str) -> None:
        self.edges.append({"source_qualified": source, "target_qualified": target, "type": kind, "file_path": self.path, "metadata": None})

    def file(self, text: str) -> str:
        return self.node("FILE", self.path.rpartition("/")[2], self.path, 1, text.count("\n") + 1)


def snippet(code: str, whole: int = 10, chars: int = 2000) -> str:
    """Code of up to ten lines whole; else the first five, a mark with the number left out, the last three; cut at 2,000 characters."""
    lines = code.split("\n")
    if len(lines) > whole:
        lines = [*lines[:5], f"… ({len(lines) - 8} more lines)", *lines[-3:]]
    return "\n".join(lines).rstrip()[:chars]
