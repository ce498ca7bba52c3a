"""An optional n-gram index: worthwhile for selective words over large stored tables; a scan is the default."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlens.functions import text


def build(entries: DataFrame, n: int = 3, column: str = "name_fold") -> DataFrame:
    """(key, id): each distinct window of n bytes of each name."""
    return entries.select("id", F.explode(text.ngrams(column, n)).alias("key")).select("key", "id")


def store(index: DataFrame, path: str, partitions: int) -> None:
    """Sorted by key, so that a lookup reads few row groups."""
    index.repartitionByRange(partitions, "key").sortWithinPartitions("key", "id").write.mode("overwrite").parquet(path)


def append(entries: DataFrame, path: str, partitions: int, n: int = 3) -> None:
    """Adds new entries to a stored index: files beside the old ones, which are not read.

    Dead entries need no removal, as a search tests its candidates; an id must not come back with another name.
    """
    build(entries, n).repartitionByRange(partitions, "key").sortWithinPartitions("key", "id").write.mode("append").parquet(path)


def frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("key").agg(F.count("*").alias("df"))


def stats(index: DataFrame) -> DataFrame:
    per_key = frequency(index)
    return per_key.agg(F.count("*").alias("distinct_keys"), F.coalesce(F.sum("df"), F.lit(0)).cast("long").alias("postings"))


def candidates(index: DataFrame, needle: str, n: int = 3) -> DataFrame | None:
    """Ids of names that hold all of the folded needle's windows; None if it is too short for the index."""
    keys = text.literal_ngrams(needle, n)
    if not keys:
        return None
    wanted = reduce(lambda a, b: a | b, [F.col("key") == F.lit(bytearray(k)) for k in keys])
    return index.filter(wanted).groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(keys)).select("id")


def search(entries: DataFrame, index: DataFrame, needle: str, n: int = 3) -> DataFrame:
    """Entries whose name holds the needle: candidates, then the test itself."""
    folded = text.fold_text(needle)
    found = candidates(index, folded, n)
    match = F.col("alive") & F.contains("name_fold", F.lit(folded))
    return entries.filter(match) if found is None else entries.join(found, "id", "left_semi").filter(match)
