"""The folder tree over file paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def folders(files: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """(folder, depth, files, symbols): every folder above a file with the files and symbols below it."""
    per = files.select("path").distinct().withColumn("s", F.lit(0))
    if symbols is not None:
        counted = symbols.where("type <> 'FILE'").groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("c"))
        per = files.select("path").distinct().join(counted, "path", "left").select("path", F.coalesce("c", F.lit(0)).alias("s"))
    parts = F.split("path", "/")
    above = per.select("s", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("depth", "folder"))
    return above.where("folder <> ''").groupBy("folder", "depth").agg(F.count(F.lit(1)).alias("files"), F.sum("s").alias("symbols"))


def children(files: DataFrame) -> DataFrame:
    """(folder, child, is_folder): the tree's links, folders first when ordered by (folder, not is_folder, child)."""
    parts = F.split("path", "/")
    links = files.select("path").distinct().select(F.posexplode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i - 1), "/").alias("folder"), F.element_at(parts, i).alias("child"), (i < F.size(parts)).alias("is_folder")))).alias("at", "s"))
    return links.select("s.folder", "s.child", "s.is_folder").distinct()


def collapsed(files: DataFrame) -> DataFrame:
    """(folder, label): folders that stay when a folder with one child folder only is merged into that child.

    A folder's merged label reaches up over all single-child folders above it. That run is read off
    the path itself: each folder's ends are matched against the set of folders that do not merge, so
    one join replaces walking up step by step.
    """
    links = children(files).where("folder <> ''")
    single = links.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.max("is_folder").alias("f")).where("n = 1 and f").select("folder")
    every = links.select("folder").distinct()
    stay = every.join(single, "folder", "left_anti")
    parts = F.split("folder", "/")
    ups = stay.select("folder", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - i), "/"))).alias("up", "above"))
    # the nearest folder above that is no single-child folder, or the top
    stops = ups.join(single.withColumnRenamed("folder", "above"), "above", "left_anti").groupBy("folder").agg(F.min("up").alias("up"))
    label = F.array_join(F.slice(parts, F.size(parts) - F.col("up"), F.col("up") + 1), "/")
    return stops.select("folder", label.alias("label"))
