"""What the language parsers share: errors, precedence tables and panic-mode recovery.

Statements are parsed by recursive descent and expressions by climbing a precedence table. At an
error the parser notes it, skips to a place where a statement can start again and goes on, so that
one run over a file yields all its independent errors; the first one is the cause.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass


class Bad(Exception):
    """A syntax error at a position of the text."""

    def __init__(self, at: int, why: str):
        super().__init__(why)
        self.at, self.why = at, why


@dataclass(frozen=True)
class Fault:
    line: int
    column: int
    why: str


class Faults:
    """The errors of one text, in order of discovery, each place once."""

    def __init__(self, text: str):
        self.found: list[tuple[int, str]] = []
        self.places: set[int] = set()
        self.starts = [0]
        at = text.find("\n")
        while at >= 0:
            self.starts.append(at + 1)
            at = text.find("\n", at + 1)

    def note(self, bad: Bad) -> None:
        if bad.at not in self.places:
            self.places.add(bad.at)
            self.found.append((bad.at, bad.why))

    def all(self) -> list[Fault]:
        out = []
        for at, why in self.found:
            line = bisect_right(self.starts, at)
            out.append(Fault(line, at - self.starts[line - 1], why))
        return out
