"""The change feed: events of files, moves split in two, bursts folded to their last event, and micro-batch indexing."""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphweave.config import DEBOUNCE_MS, IGNORED_FOLDERS
from graphweave.sources.repo import wanted

#: Files of a micro-batch that are named one by one; more are found by a scan.
MANY_PATHS = 1_000
EVENT = "kind string, path string, dest string, ts timestamp"


def split_moves(events: DataFrame) -> DataFrame:
    """(path, deleted, ts): a move is a deletion of the old path and a change of the new one."""
    gone, come = (lambda p: F.struct(F.col(p).alias("path"), F.lit(True).alias("deleted"))), (lambda p: F.struct(F.col(p).alias("path"), F.lit(False).alias("deleted")))
    parts = F.when(F.col("kind") == "moved", F.array(gone("path"), come("dest"))).when(F.col("kind") == "deleted", F.array(gone("path"))).otherwise(F.array(come("path")))
    return events.select("ts", F.explode(parts).alias("s")).select("s.path", "s.deleted", "ts").where("path is not null")


def relevant(changes: DataFrame, root: str = "") -> DataFrame:
    """Changes of files that an index takes in; rules apply to the path below root."""
    below = F.expr(f"substring(path, {len(root.rstrip('/')) + 2})") if root else F.col("path")
    return changes.where(wanted(below))


def debounce(changes: DataFrame, gap_ms: int = DEBOUNCE_MS, key: str = "path", ts: str = "ts", flag: str = "deleted", tie: str | None = None) -> DataFrame:
    """(key, first, last, events, flag): bursts of a key whose events follow within the gap, with the last event's flag.

    The batch form. An event exactly a gap after the one before starts a new burst. A gap must be positive.
    """
    order = [ts, *([tie] if tie else [flag])]
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = gap_ms * 1000
    # events of a key within one stretch of a gap's length belong together, so they are folded on the map side first:
    # what is sorted per key is bounded by its time span, however many events it has
    folded = changes.groupBy(key, F.floor(us / gap).alias("stretch")).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("events"), F.max_by(flag, F.struct(*order)).alias(flag))
    w = Window.partitionBy(key).orderBy("stretch")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    opens = F.coalesce(micros("first") - F.lag(micros("last")).over(w) >= gap, F.lit(True)).cast("int")
    numbered = folded.withColumn("opens", opens).withColumn("burst", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(key, "burst").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("events").alias("events"), F.max_by(flag, "stretch").alias(flag)).drop("burst")


def debounce_stream(changes: DataFrame, gap_ms: int = DEBOUNCE_MS, late: str = "10 seconds") -> DataFrame:
    """The same on a stream: session windows over a watermark; a burst comes out once the watermark has passed its gap."""
    marked = changes.withWatermark("ts", late)
    return marked.groupBy("path", F.session_window("ts", f"{gap_ms} milliseconds")).agg(F.count(F.lit(1)).alias("events"), F.max_by("deleted", "ts").alias("deleted")).select("path", F.col("session_window.start").alias("first"), "events", "deleted")


def index_stream(bursts: DataFrame, index: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Feeds each micro-batch of bursts to an incremental index. A batch may come again after a failure, so index must be idempotent."""
    writer = bursts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(index)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def index_on_change(engine, root: str) -> Callable[[DataFrame, int], None]:
    """For index_stream: brings the files of each micro-batch up to date, and no others but those that import them. Running it again changes nothing."""

    def index(batch: DataFrame, _: int) -> None:
        last = batch.groupBy("path").agg(F.max_by("deleted", "first").alias("deleted"))
        few = last.limit(MANY_PATHS + 1).collect()
        if len(few) > MANY_PATHS:
            engine.index(root)
        elif few:
            engine.index_paths(root, [r["path"] for r in few if not r["deleted"]], [r["path"] for r in few if r["deleted"]])

    return index


def folder_events(spark: SparkSession, feed: str) -> DataFrame:
    """The events that writers of a feed folder leave there as JSON lines (kind, path, dest, ts), as a stream."""
    return spark.readStream.schema(EVENT).json(feed)


def poll(spark: SparkSession, root: str, seen: dict[str, tuple[int, int]]) -> tuple[DataFrame, dict[str, tuple[int, int]]]:
    """(events, what is there now) of a folder against what was there: created, modified and deleted files by time and length.

    For one folder on the driver's machine; its listing must fit there.
    """
    now: dict[str, tuple[int, int]] = {}
    for folder, below, names in os.walk(root):
        below[:] = [d for d in below if d not in IGNORED_FOLDERS and not d.startswith(".")]
        for name in names:
            path = os.path.join(folder, name)
            try:
                s = os.stat(path)
            except OSError:
                continue  # gone again
            now[path] = s.st_mtime_ns, s.st_size
    at = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    rows = [("created" if p not in seen else "modified", p, None, at) for p, s in now.items() if seen.get(p) != s]
    rows += [("deleted", p, None, at) for p in seen if p not in now]
    return spark.createDataFrame(sorted(rows), EVENT), now


class Watch:
    """Start, stop and state of one change feed."""

    def __init__(self) -> None:
        self.query: StreamingQuery | None = None

    def start(self, make: Callable[[], StreamingQuery]) -> bool:
        if self.active():
            return False
        self.query = make()
        return True

    def stop(self) -> bool:
        if not self.active():
            return False
        self.query.stop()
        return True

    def active(self) -> bool:
        return self.query is not None and self.query.isActive

    def progress(self) -> dict:
        last = self.query.lastProgress if self.query is not None else None
        return {"active": self.active(), "batch": last["batchId"] if last else None, "rows": last["numInputRows"] if last else 0}
