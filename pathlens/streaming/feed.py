"""A change feed as a stream: every micro-batch replaces the parts of the stored tree that it names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pathlens.functions import text
from pathlens.operators import changes, graft
from pathlens.operators.staging import settled
from pathlens.sources.store import SnapshotError, Store

#: A path's part is a hash of its top folder: what a batch does not name by its top folder it does not rewrite.
PARTS = 64
LIVE = "path string, is_dir boolean, part string"


def part_of(path) -> Column:
    return F.pmod(F.xxhash64(F.element_at(F.split(path, "/"), 2)), F.lit(PARTS)).cast("string")


def state(store: Store, parts: list[str] | None = None) -> DataFrame:
    """Live (path, is_dir, part) of the current version, or of some parts; empty before the first."""
    try:
        return store.load(check=False, parts=parts)
    except SnapshotError:
        if store.version() is not None:
            raise
        return store.spark.createDataFrame([], LIVE)


def involved(base: DataFrame, events: DataFrame) -> DataFrame:
    """The paths of base that events can concern: those they name, the folders above, and what is below deleted ones."""
    named = events.select("path").distinct()
    up = named.select(F.explode(F.array_append(text.ancestors("path"), F.col("path"))).alias("path")).distinct()
    deleted = events.filter("op = 'delete'").select(F.col("path").alias("anc")).distinct()
    below = base.select("path", F.explode(text.ancestors("path")).alias("anc")).join(deleted, "anc", "left_semi").select("path")
    return base.select("path").join(up, "path", "left_semi").union(below).distinct()


def apply_batch(store: Store, events: DataFrame, batch_id: int, source: str = "feed") -> bool:
    """Applies one batch, once: a batch that the current version holds already is left alone.

    Only the parts that its events fall in are read and rewritten, and in them only the paths involved go through
    the levels; the rest is copied. An ``overflow`` event means that the producer lost some; it raises, since only a
    rebuild can mend that.
    """
    done = store.batch(source)
    if done is not None and batch_id <= done:
        return False
    if not events.filter("op = 'overflow'").isEmpty():
        raise RuntimeError("the event queue overflowed: rebuild the tree and replay from there")
    events = settled(events.select("seq", "op", "path", "is_dir"))
    parts = [r.p for r in events.filter("path <> '/'").select(part_of("path").alias("p")).distinct().collect()]  # at most PARTS
    base = state(store, parts)
    paths = settled(involved(base, events))
    result = changes.apply(events, base.join(paths, "path", "left_semi").select("path", "is_dir"))
    rest = base.join(paths, "path", "left_anti").select("path", "is_dir")
    alive = result.alive.select("path", "is_dir").union(rest).withColumn("part", part_of("path"))
    store.save(alive, {source: batch_id}, parts)
    return True


def start(events: DataFrame, store: Store, checkpoint: str, source: str = "feed", **trigger) -> StreamingQuery:
    """events: a streaming DataFrame (seq, op, path, is_dir), whose batches hold later seqs than earlier ones."""

    def each(batch: DataFrame, batch_id: int) -> None:
        apply_batch(store, batch, batch_id, source)

    writer = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def counters(events: DataFrame) -> DataFrame:
    """Creates, deletes and overflow marks of a stream, as observed metrics named ``feed``."""
    return events.observe("feed", F.count_if(F.col("op") == "create").alias("creates"), F.count_if(F.col("op") == "delete").alias("deletes"), F.count_if(F.col("op") == "overflow").alias("overflows"))


def rescan(store: Store, listing: DataFrame, mount: str, mount_incomplete: bool = False, batches: dict[str, int] | None = None) -> DataFrame:
    """Merges a fresh listing (path, is_dir, incomplete) of mount into the stored tree; gives the counts of graft.stats.

    Only the parts that hold something of mount are rewritten; what lies elsewhere in them stays.
    """
    under = lambda df: df.filter(text.is_within("path", mount) & (F.col("path") != mount))
    listing = settled(under(listing.select("path", "is_dir", "incomplete")))
    parts = None if mount == "/" else [listing.sparkSession.range(1).select(part_of(F.lit(mount)).alias("p")).first().p]
    base = state(store, parts)
    merged = settled(graft.merge(under(base), listing, mount, mount_incomplete))
    elsewhere = base.filter(~text.is_within("path", mount) | (F.col("path") == mount)).select("path", "is_dir")
    alive = merged.filter("status <> 'removed'").select("path", "is_dir").union(elsewhere).withColumn("part", part_of("path"))
    store.save(alive, batches, [str(i) for i in range(PARTS)] if parts is None else parts)
    return graft.stats(merged)


def every(spark: SparkSession, seconds: float, action: Callable[[int], None], checkpoint: str) -> StreamingQuery:
    """Runs action(n) at once and then every so many seconds: rescans and snapshots as a streaming job of their own.

    One run at a time; a run that takes longer puts the next one off. An error ends the job, as with any stream.
    """
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(lambda _, n: action(n)).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def retry_interval(interval: int) -> int:
    """Seconds until the next try where a folder was unavailable."""
    return min(60, interval)
