"""Counts over the whole graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def type_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def hotspot_files(nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    """The files with most symbols, and how many calls come into them."""
    calls = edges.where("type = 'CALLS'").groupBy("target_id").agg(F.count(F.lit(1)).alias("c"))
    rows = nodes.select("id", "file_path").join(calls.withColumnRenamed("target_id", "id"), "id", "left")
    per = rows.groupBy("file_path").agg(F.count(F.lit(1)).alias("symbols"), F.coalesce(F.sum("c"), F.lit(0)).alias("calls_in"))
    return per.orderBy(F.desc("symbols"), "file_path").limit(n)


def languages(nodes: DataFrame) -> DataFrame:
    return nodes.where("language is not null").select("language").distinct()


def totals(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """One row: symbols, edges, files with symbols, files with a hash (the two file counts differ by design)."""
    a = nodes.agg(F.count(F.lit(1)).alias("symbols"), F.countDistinct("file_path").alias("files_with_symbols"))
    b = edges.agg(F.count(F.lit(1)).alias("edges"))
    c = files.agg(F.count(F.lit(1)).alias("files_hashed"))
    one = lambda d: d.withColumn("k", F.lit(1))
    return one(a).join(one(b), "k").join(one(c), "k").drop("k")


def last_run(runs: DataFrame, status: str | None = None) -> DataFrame:
    """The run with the highest id, optionally of a status; final slashes of the repository are dropped."""
    rows = runs.where(F.col("status") == status) if status else runs
    body = [c for c in runs.columns if c != "id"]
    best = rows.agg(F.max("id").alias("id"), F.max_by(F.struct(*body), "id").alias("s")).where("id is not null").select("id", "s.*")
    return best.withColumn("repo_path", F.regexp_replace("repo_path", "/+$", ""))


def run_summary(runs: DataFrame) -> DataFrame:
    """Runs, files and mean duration by repository, type and status."""
    repo = F.regexp_replace("repo_path", "/+$", "").alias("repo_path")
    return runs.select(repo, "run_type", "status", "files_indexed", "duration_ms").groupBy("repo_path", "run_type", "status").agg(F.count(F.lit(1)).alias("runs"), F.sum("files_indexed").alias("files_indexed"), F.round(F.avg("duration_ms"), 3).alias("mean_ms"))
