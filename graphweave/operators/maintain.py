"""Keeping tables current: hash differences, affected files, upserts, deletes with cascade and the audit log.

Plain Parquet has no MERGE, so an upsert is the union of old and new with the newest row of each
key kept; graphweave/store.py says how tables change on disk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.operators.live import newest


def file_hashes(files: DataFrame) -> DataFrame:
    """(path, sha256, file_size, language, analyzed_at) from scanned files, the newest scan of each."""
    rows = files.select(F.col("file_path").alias("path"), F.coalesce("sha256", F.lit("")).alias("sha256"), "file_size", "language", F.col("scanned_at").alias("analyzed_at"))
    return newest(rows, "path", "analyzed_at")


def dirty_files(scanned: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """(path, reason) new or changed: a hash that isn't empty and isn't the stored one. force: every file with a hash."""
    now = scanned.select("path", "sha256").where("sha256 <> ''")
    old = stored.select("path", F.col("sha256").alias("old"))
    both = now.join(old, "path", "left")
    reason = F.when(F.col("old").isNull(), "new").when(F.col("old") != F.col("sha256"), "changed").when(F.lit(force), "forced")
    return both.select("path", reason.alias("reason")).where("reason is not null")


def deleted_files(scanned: DataFrame, stored: DataFrame) -> DataFrame:
    return stored.select("path").join(scanned.select("path"), "path", "left_anti")


def expand_dirty(dirty: DataFrame, deps: DataFrame) -> DataFrame:
    """(path): the dirty files and the files that import them directly; one step only."""
    paths = dirty.select("path").distinct()
    near = deps.join(paths.withColumnRenamed("path", "importee"), "importee", "left_semi").select(F.col("importer").alias("path"))
    return paths.unionByName(near).distinct()


def upsert(old: DataFrame, new: DataFrame, key: str = "id", keep: list[str] | None = None, stamp: str | None = None) -> DataFrame:
    """old with the rows of new put in: a new row replaces the old one of its key, but for the kept columns.

    keep: columns (created_at, say) that an existing row keeps. Of several new rows of a key the one
    with the greatest stamp counts. Columns of new that old lacks are dropped.
    """
    keep = [c for c in (keep or []) if c in old.columns]
    fresh = newest(new.select(*old.columns), key, *([stamp] if stamp else []))
    if keep:
        kept = old.join(fresh.select(key), key, "left_semi").select(key, *[F.col(c).alias(f"_old_{c}") for c in keep])
        fresh = fresh.join(kept, key, "left")
        fresh = fresh.select(*[F.coalesce(F.col(f"_old_{c}"), F.col(c)).alias(c) if c in keep else F.col(c) for c in old.columns])
    return old.join(fresh.select(key), key, "left_anti").select(*old.columns).unionByName(fresh.select(*old.columns))


def delete_files(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the files' own, and without edges that lost an end."""
    gone = paths.select(F.col("path").alias("file_path")).distinct()
    left = nodes.join(gone, "file_path", "left_anti").select(*nodes.columns)
    own = edges.join(gone, "file_path", "left_anti").select(*edges.columns)
    return left, cascade(left, own)


def cascade(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose both ends are there."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(*edges.columns)


def replace_deps(deps: DataFrame, importers: DataFrame, new: DataFrame) -> DataFrame:
    """deps with all rows of the importers replaced by the distinct new ones."""
    kept = deps.join(importers.select(F.col("path").alias("importer")), "importer", "left_anti").select("importer", "importee")
    return kept.unionByName(new.select("importer", "importee")).distinct()


def drop_file_deps(deps: DataFrame, paths: DataFrame, rebuilt: bool) -> DataFrame:
    """deps without the files as importers, and, where they were deleted and not rebuilt, as importees."""
    out = deps.join(paths.select(F.col("path").alias("importer")), "importer", "left_anti")
    if not rebuilt:
        out = out.join(paths.select(F.col("path").alias("importee")), "importee", "left_anti")
    return out.select("importer", "importee")


def run_states(events: DataFrame) -> DataFrame:
    """The audit log's current rows: of each run id the last event, messages cut at 2,000 characters."""
    return newest(events.withColumn("error_message", F.substring("error_message", 1, 2000)), "id", "at")


def build_totals(per_file: DataFrame) -> DataFrame:
    """Counters over the files of a build: files, errors, symbols and edges."""
    bad = F.coalesce(F.trim("error") != "", F.lit(False)).cast("long")
    return per_file.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(bad), F.lit(0)).alias("errors"), F.coalesce(F.sum(F.coalesce(F.size("nodes"), F.lit(0))), F.lit(0)).alias("symbols"), F.coalesce(F.sum(F.coalesce(F.size("edges"), F.lit(0))), F.lit(0)).alias("edges"))
