"""Changed line ranges of a diff, and the symbols they touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hunks(diffs: DataFrame, key: str = "diff_id", text: str = "text") -> DataFrame:
    """(key, file, start_line, end_line) of every hunk of unified diffs without context.

    The file is that of the last 'diff --git' line above, on its new side; '+n' is one line, '+n,k'
    k lines, '+n,0' the line itself. Files without hunks give no rows. The running file is kept per
    diff, so one diff's lines meet in one task and all others spread.
    """
    lines = diffs.select(F.col(key), F.posexplode(F.split(text, "\r?\n")).alias("at", "line"))
    file = F.when(F.col("line").startswith("diff --git "), F.regexp_extract("line", r"^diff --git a/.* b/(.*)$", 1))
    marked = lines.where(F.col("line").startswith("diff --git ") | F.col("line").startswith("@@ "))
    known = marked.withColumn("file", F.last(file, ignorenulls=True).over(Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ranges = known.where(F.col("line").startswith("@@ ")).select(
        key,
        "file",
        F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1).alias("start"),
        F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+\d+,(\d+)", 1).alias("many"),
    )
    start = F.col("start").cast("int")
    many = F.when(F.col("many") == "", F.lit(1)).otherwise(F.expr("try_cast(many as int)"))
    return ranges.where("start <> '' and file <> ''").select(key, "file", start.alias("start_line"), (start + F.greatest(many, F.lit(1)) - 1).alias("end_line"))


def overlapping(nodes: DataFrame, ranges: DataFrame, path: str = "file") -> DataFrame:
    """Distinct symbols, files apart, that share a line with a range of their file: an equi-join on the file with the range as a further condition."""
    r = ranges.select(F.col(path).alias("file_path"), F.col("start_line").alias("lo"), F.col("end_line").alias("hi")).distinct()
    symbols = nodes.where("type <> 'FILE'").select("id", "name", "type", "file_path", "start_line", "end_line", "signature")
    return symbols.join(r, "file_path").where("start_line <= hi and end_line >= lo").drop("lo", "hi").distinct()


def diff_context(nodes: DataFrame, ranges: DataFrame) -> DataFrame:
    """(file, symbols): every changed file with the number of its touched symbols; files without symbols stay with 0."""
    touched = overlapping(nodes, ranges).groupBy(F.col("file_path").alias("file")).agg(F.count(F.lit(1)).alias("symbols"))
    return ranges.select("file").distinct().join(touched, "file", "left").select("file", F.coalesce("symbols", F.lit(0)).alias("symbols"))
