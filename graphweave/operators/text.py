"""Text of answers: snippets, embedding text, token estimates and the token budget, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: what a cut answer ends with.
MARKER = "… [truncated to stay under token budget]"


def snippet(text: Column, chars: int = 2000) -> Column:
    """A text of up to ten lines whole; else the first five, how many are left out, and the last three; then cut at so many characters."""
    lines = F.split(text, "\n")
    n = F.size(lines)
    short = F.concat(F.slice(lines, 1, 5), F.array(F.concat(F.lit("… ("), (n - 8).cast("string"), F.lit(" more lines)"))), F.slice(lines, -3, 3))
    return F.substring(F.rtrim(F.array_join(F.when(n <= 10, lines).otherwise(short), "\n")), 1, chars)


def short_path(path: Column, parts: int = 3) -> Column:
    """The last parts of a path."""
    split = F.split(path, "/")
    return F.array_join(F.slice(split, F.greatest(F.lit(1), F.size(split) - parts + 1), F.lit(parts)), "/")


def embedding_text(qualified_name: Column, name: Column, signature: Column, docstring: Column) -> Column:
    """Name, signature and the first 240 characters of the documentation, blanks skipped, joined by ' | '."""
    some = lambda c: F.when(F.trim(c) != "", c)
    return F.concat_ws(" | ", F.coalesce(some(qualified_name), name), some(signature), some(F.substring(docstring, 1, 240)))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least 1; 0 for empty and null texts."""
    n = F.coalesce(F.length(text), F.lit(0))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int")))


def budget_lines(lines: DataFrame, key: str, number: str, line: str, budget: int) -> DataFrame:
    """The longest run of first lines of each key whose tokens, one more a line, and the marker fit the budget.

    A key whose whole text fits keeps all lines; cut says whether lines were left out. Costs are
    positive, so the run is a filter on a running sum. Where not even the first line fits, it is cut
    to the budget's characters. A budget of 0 or less keeps everything.
    """
    if budget <= 0:
        return lines.select(key, number, line, F.lit(False).alias("cut"))
    cost = token_estimate(F.col(line)) + 1
    per = Window.partitionBy(key)
    chars = F.sum(F.length(line) + 1).over(per) - 1
    rows = lines.withColumn("run", F.sum(cost).over(per.orderBy(number).rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("chars", chars).withColumn("first", F.min(number).over(per))
    room = budget - (len(MARKER) // 4) - 2
    fits = F.when(F.col("chars") == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.col("chars") / 4))) <= budget
    within = fits | (F.col("run") <= room)
    short = F.substring(line, 1, max(0, budget * 4 - len(MARKER)))
    return rows.where(within | (F.col(number) == F.col("first"))).select(key, number, F.when(within, F.col(line)).otherwise(short).alias(line), (~fits).alias("cut"))
