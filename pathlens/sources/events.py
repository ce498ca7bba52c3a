"""Change events as a stream, from files of JSON lines that a watcher appends to a folder.

A line is one event as the kernel gives it: seq (a total order), mask, parent_ino, parent_path (if known) and name.
A line that can't be read, or lacks its number, mask or name, becomes an ``overflow`` event, as an event is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlens.operators import changes

FIELDS = "seq long, mask long, parent_ino long, parent_path string, name string"


def read(spark: SparkSession, folder: str, folders: DataFrame, files_in_batch: int | None = None) -> DataFrame:
    """A stream of (seq, op, path, is_dir, moved_in), as feed.start takes it; folders (ino, path) names parents by inode.

    Files are taken once and whole, in the order they came; files_in_batch bounds a micro-batch.
    """
    reader = spark.readStream.schema("value string").format("text")
    if files_in_batch:
        reader = reader.option("maxFilesPerTrigger", files_in_batch)
    return parsed(reader.load(folder), folders)


def parsed(lines: DataFrame, folders: DataFrame) -> DataFrame:
    """Events of lines (value)."""
    rows = lines.filter(F.trim("value") != "").select(F.from_json("value", FIELDS).alias("e")).select("e.*")
    whole = F.col("seq").isNotNull() & F.col("mask").isNotNull() & F.col("name").isNotNull()
    columns = ["seq", "op", "path", "is_dir", "moved_in"]
    known = changes.with_paths(changes.classified(rows.filter(whole)), folders).select(*columns)
    lost = rows.filter(~F.coalesce(whole, F.lit(False))).select(F.coalesce("seq", F.lit(-1)).cast("long"), F.lit("overflow"), F.lit("/"), F.lit(True), F.lit(False))
    return known.union(lost)
