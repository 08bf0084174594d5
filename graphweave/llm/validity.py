"""Source files that are no valid program of the language their extension stands for."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.llm import syntax_js, syntax_py
from graphweave.llm.syntax import Fault

#: Extension -> (language, TypeScript syntax, JSX syntax).
LANGUAGES = {
    "py": ("python", False, False),
    "js": ("javascript", False, False),
    "jsx": ("javascript", False, True),
    "ts": ("typescript", True, False),
    "tsx": ("typescript", True, True),
}
#: Texts whose verdict a worker remembers, so that a file stored many times is parsed once.
REMEMBERED = 2_000


def extension(path: str | None) -> str:
    name = (path or "").replace("\\", "/").rpartition("/")[2]
    return name.rpartition(".")[2].lower() if "." in name else ""


def faults(text: str, ext: str) -> list[Fault] | None:
    """All errors of a text in the language of an extension, the first one its cause; None for other extensions."""
    if ext not in LANGUAGES:
        return None
    language, types, jsx = LANGUAGES[ext]
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 12_000))
    try:
        return syntax_py.faults(text) if language == "python" else syntax_js.faults(text, types, jsx)
    finally:
        sys.setrecursionlimit(limit)


_FAULT = pa.struct([("line", pa.int32()), ("col", pa.int32()), ("why", pa.string())])


def check_files(files: DataFrame, path: str = "file_path", content: str = "content", repo: str = "repo_path", scanned: str | None = "scanned_at") -> DataFrame:
    """One row per file: file_path, repo_path, language, readable, valid, first_cause, n_errors, errors.

    language is that of the extension in any letter case, null for others. A file with several rows
    counts once, with its last readable content; with none it isn't readable and valid is null, as
    it is for other extensions. An empty text is valid. A null path is a file of its own. A missing
    repo_path is taken from the file's other rows, else the longest repo_path of the table that is
    a folder of the file. Extra columns are not read.
    """
    rows = files.select(F.col(path).alias("f"), F.col(content).alias("c"), F.col(repo).alias("r"), (F.col(scanned) if scanned else F.lit(0)).alias("t"))
    stamp = rows.schema["t"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, bytes], list[Fault] | None] = {}
        for b in batches:
            out = []
            for f, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ext = extension(f)
                if c is None:
                    out.append(None)
                    continue
                key = (ext, hashlib.blake2b(c.encode(), digest_size=16).digest())
                if key not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[key] = faults(c, ext)
                out.append(known[key])
            readable = [c.as_py() for c in b.column(1).is_valid()]
            valid = [None if e is None else not e for e in out]
            errors = pa.array([None if e is None else [{"line": x.line, "col": x.column, "why": x.why} for x in e] for e in out], pa.list_(_FAULT))
            language = [LANGUAGES[x][0] if (x := extension(f)) in LANGUAGES else None for f in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(language, pa.string()), pa.array(readable), pa.array(valid, pa.bool_()), errors], names=["f", "r", "t", "language", "readable", "valid", "errors"])

    checked = rows.mapInArrow(run, f"f string, r string, t {stamp}, language string, readable boolean, valid boolean, errors array<struct<line: int, col: int, why: string>>")
    last = checked.groupBy("f").agg(F.max("r").alias("r"), F.max("language").alias("language"), F.max("readable").alias("readable"), F.max_by(F.struct("valid", "errors"), F.struct("readable", "t")).alias("v"))
    folders = rows.where("r is not null").select("r").distinct()
    lost = last.where("r is null and f is not null").select("f", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("f", "/"))), lambda i: F.array_join(F.slice(F.split("f", "/"), 1, i), "/"))).alias("r"))
    found = lost.join(folders, "r").groupBy("f").agg(F.max_by("r", F.length("r")).alias("folder"))
    named = last.join(found, "f", "left")
    return named.select(
        F.col("f").alias(path),
        F.coalesce("r", "folder").alias(repo),
        "language",
        "readable",
        F.col("v.valid").alias("valid"),
        F.get("v.errors", F.lit(0))["why"].alias("first_cause"),
        F.coalesce(F.size("v.errors"), F.lit(0)).alias("n_errors"),
        F.col("v.errors").alias("errors"),
    )


def invalid_files(files: DataFrame, path: str = "file_path", content: str = "content") -> DataFrame:
    """(file_path): the files whose content is there and isn't valid; without the columns that rates need."""
    return check_files(files.where(F.col(content).isNotNull()).select(path, content, F.lit("").alias("repo_path"), F.col("scanned_at") if "scanned_at" in files.columns else F.lit(0).alias("scanned_at")), path, content).where("not valid").select(path)


def rates(checked: DataFrame, reported: DataFrame | None = None) -> DataFrame:
    """Files, invalid files and acceptance per (repo_path, language) and per language (whole = true, repo_path null).

    reported: (file_path, error) of a parser; then also how many invalid files it gave an error for
    (told) and how many valid ones (false_alarms). Files of other extensions aren't counted; a
    group without a readable file has no acceptance.
    """
    rows = checked.where("language is not null")
    if reported is not None:
        said = reported.groupBy("file_path").agg(F.max(F.coalesce(F.trim("error") != "", F.lit(False))).alias("said"))
        rows = rows.join(said, "file_path", "left")
    else:
        rows = rows.withColumn("said", F.lit(None).cast("boolean"))
    bad, good = F.coalesce(~F.col("valid"), F.lit(False)), F.coalesce(F.col("valid"), F.lit(False))
    said = F.coalesce("said", F.lit(False))
    count = lambda c: F.sum(c.cast("long"))
    measures = [
        F.count(F.lit(1)).alias("files"),
        count(F.col("readable")).alias("readable"),
        count(bad).alias("invalid"),
        count(bad & said).alias("told"),
        count(good & said).alias("false_alarms"),
        F.sum("n_errors").alias("errors"),
    ]
    both = rows.groupBy("repo_path", "language").agg(*measures)
    total = both.groupBy("language").agg(*[F.sum(c).alias(c) for c in ("files", "readable", "invalid", "told", "false_alarms", "errors")])
    out = both.withColumn("whole", F.lit(False)).unionByName(total.withColumn("whole", F.lit(True)).withColumn("repo_path", F.lit(None).cast("string")))
    return out.withColumn("acceptance", F.when(F.col("readable") > 0, F.round(1 - F.col("invalid") / F.col("readable"), 6)))
