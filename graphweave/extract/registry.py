"""Dispatch by extension, and the table function over scanned files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.config import EXTENSIONS
from graphweave.extract import python_source, script_source
from graphweave.extract.records import Parsed
from graphweave.schema import PARSE_RESULT

Parser = Callable[[str, str], Parsed]

PARSERS: dict[str, Parser] = {
    "python": python_source.parse,
    "javascript": lambda path, text: script_source.parse(path, text, "javascript"),
    "typescript": lambda path, text: script_source.parse(path, text, "typescript"),
}


def parser_for(path: str) -> tuple[str, Parser] | None:
    """The language and parser of a path's extension; None for others."""
    language = EXTENSIONS.get(path.rpartition(".")[2].lower())
    return (language, PARSERS[language]) if language in PARSERS else None


def parse_text(path: str, text: str | None) -> Parsed:
    """What the parser makes of one file; every failure ends up in error."""
    found = parser_for(path)
    if found is None:
        return Parsed(path, "unknown", error="no parser for this extension")
    if text is None:
        return Parsed(path, found[0], error="unreadable")
    try:
        return found[1](path, text)
    except Exception as bad:  # one file must not end the job
        return Parsed(path, found[0], error=f"{type(bad).__name__}: {bad}"[:500])


def parse_files(files: DataFrame) -> DataFrame:
    """Parse results of (file_path, content), one row a file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [parse_text(p, None if t is None or t != t else t) for p, t in zip(b["file_path"], b["content"], strict=True)]
            yield pd.DataFrame({"file_path": [r.path for r in rows], "language": [r.language for r in rows], "nodes": [r.nodes for r in rows], "edges": [r.edges for r in rows], "import_paths": [r.imports for r in rows], "error": pd.Series([r.error for r in rows], dtype=object)})

    return files.where(F.col("file_path").isNotNull()).select("file_path", "content").mapInPandas(run, PARSE_RESULT)
