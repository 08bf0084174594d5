"""Source files from folders: which files count, their language and content hash; and diffs from a checkout."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave import config


def language(path: Column, extensions: dict[str, str] = config.EXTENSIONS) -> Column:
    """The language of a path's extension in any letter case, 'unknown' for others."""
    table = F.create_map(*[F.lit(x) for pair in extensions.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit("unknown"))


def ignored_folder(path: Column, folders: tuple[str, ...] = config.IGNORED_FOLDERS) -> Column:
    """Whether a folder of the path is in the list or starts with a dot."""
    parts = F.split(path, "/")
    above = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.exists(above, lambda d: d.isin(*folders) | (d.startswith(".") & ~d.isin(".", "..")))


def glob_pattern(pattern: str) -> str:
    """A file-name pattern with * and ? as an anchored regular expression."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def ignored_name(path: Column, patterns: tuple[str, ...] = config.IGNORED_FILES) -> Column:
    name = F.regexp_extract(path, r"[^/]*$", 0)
    return name.rlike("|".join(glob_pattern(p) for p in patterns))


def wanted(path: Column, size: Column | None = None) -> Column:
    """Whether a path (relative to the repository) takes part in an index."""
    rule = ~ignored_folder(path) & ~ignored_name(path) & (language(path) != "unknown")
    return rule & (size <= config.MAX_FILE_BYTES) if size is not None else rule


def _rows_of(files: DataFrame, base: str) -> DataFrame:
    full = F.regexp_replace("path", r"^file:(//)?", "")
    rows = files.withColumn("file_path", full).withColumn("below", F.expr(f"substring(file_path, {len(base) + 2})"))
    kept = rows.where(wanted(F.col("below"), F.col("length")))
    return kept.select(
        "file_path",
        F.lit(base).alias("repo_path"),
        language(F.col("file_path")).alias("language"),
        F.expr("try_validate_utf8(cast(content as string))").alias("content"),
        F.sha2("content", 256).alias("sha256"),
        F.col("length").alias("file_size"),
        F.current_timestamp().cast("timestamp_ntz").alias("scanned_at"),
    )


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, repo_path, language, content, sha256, file_size, scanned_at) of the files below a folder.

    Bytes that are no UTF-8 give null content, their hash stays. Unreadable files are left to the
    file source. Rules apply to the path below root.
    """
    base = root.rstrip("/")
    return _rows_of(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base), base)


def read_files(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """As scan, of these files only; those that the rules leave out are left out."""
    base = root.rstrip("/")
    if not paths:
        return scan_schema(spark)
    escaped = [re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in paths]  # paths aren't patterns
    return _rows_of(spark.read.format("binaryFile").load(escaped), base)


def scan_schema(spark: SparkSession) -> DataFrame:
    """No files."""
    return spark.createDataFrame([], "file_path string, repo_path string, language string, content string, sha256 string, file_size long, scanned_at timestamp_ntz")


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, language, file_size) of the wider walk, which only lists files: more languages, fewer folders left out, nothing read."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).select("path", "length")
    rows = files.select(F.regexp_replace("path", r"^file:(//)?", "").alias("file_path"), F.col("length").alias("file_size"))
    folders = F.split(F.expr(f"substring(file_path, {len(base) + 2})"), "/")
    above = F.slice(folders, F.lit(1), F.size(folders) - 1)
    kept = rows.where(~F.exists(above, lambda d: d.isin(*config.WIDE_IGNORED_FOLDERS)))
    return kept.select("file_path", language(F.col("file_path"), config.WIDE_EXTENSIONS).alias("language"), "file_size").where("language <> 'unknown'")


def language_histogram(files: DataFrame, extensions: dict[str, str] = config.EXTENSIONS) -> DataFrame:
    return files.select(language(F.col("file_path"), extensions).alias("language"), "file_path").distinct().groupBy("language").agg(F.count(F.lit(1)).alias("files"))


def git_diff(repo: str, ref: str = "HEAD", timeout: int = 30) -> str:
    """The unified diff, without context lines, of a checkout against a ref. Raises on any failure of git, and on a ref that would be an option."""
    if ref.startswith("-"):
        raise ValueError(f"{ref!r} is no ref")
    done = subprocess.run(["git", "-C", repo, "diff", "--unified=0", ref, "--"], capture_output=True, text=True, timeout=timeout, check=False)
    if done.returncode:
        raise RuntimeError(done.stderr.strip() or f"git ended with {done.returncode}")
    return done.stdout


def diff_frame(spark: SparkSession, text: str, diff_id: str = "diff") -> DataFrame:
    return spark.createDataFrame([(diff_id, text)], "diff_id string, text string")
