"""Merging a fresh listing of a subtree that was partly unreadable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlens.functions import text


def merge(before: DataFrame, listing: DataFrame, mount: str, mount_incomplete: bool = False) -> DataFrame:
    """(path, is_dir, status) with status added, unchanged, kept or removed.

    Both sides hold paths below mount; listing has ``incomplete`` for folders that could not be read. A path that
    the listing misses is kept if its deepest listed ancestor is incomplete, else removed.
    """
    old = before.select("path", F.col("is_dir").alias("was_dir"))
    new = listing.groupBy("path").agg(F.max("is_dir").alias("is_dir"), F.max("incomplete").alias("incomplete"))
    both = old.join(new, "path", "full_outer")
    known = F.when(F.col("is_dir").isNull(), "missing").when(F.col("was_dir").isNull(), "added").otherwise("unchanged")
    seen = both.withColumn("status", known).filter("status <> 'missing'").select("path", "is_dir", "status")
    missing = old.join(new, "path", "left_anti")
    folders = new.filter("is_dir").select(F.col("path").alias("anc"), "incomplete")
    folders = folders.union(missing.sparkSession.createDataFrame([(mount, mount_incomplete)], "anc string, incomplete boolean"))
    above = missing.select("path", "was_dir", F.explode(text.ancestors("path")).alias("anc")).join(folders, "anc")
    deepest = above.groupBy("path", "was_dir").agg(F.max_by("incomplete", F.length("anc")).alias("keep"))
    gone = deepest.select("path", F.col("was_dir").alias("is_dir"), F.when(F.col("keep"), "kept").otherwise("removed").alias("status"))
    return seen.union(gone)


def stats(result: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return result.agg(F.count_if(F.col("status") != "removed").alias("total"), n("added").alias("added"), n("removed").alias("removed"), n("kept").alias("kept"))


def listing(entries: DataFrame, mount: str) -> DataFrame:
    """Live entries below mount in pre-order (folders before what they hold), with relative paths."""
    inside = entries.filter(F.col("alive") & text.is_within("path", mount) & (F.col("path") != mount))
    rel = F.substr("path", F.lit(2 if mount == "/" else len(mount) + 2))
    return inside.select(rel.alias("relative"), "is_dir").orderBy(F.split("relative", "/"))
