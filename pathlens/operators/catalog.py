"""Several parts as one catalogue: merged results, statistics, roots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlens.functions import text
from pathlens.operators import search as _search
from pathlens.operators.model import SearchOptions, clamp_limit


def merged(parts: list[DataFrame]) -> DataFrame:
    """Hits of several parts without repeated paths: the first part's row stays. Cut to a limit only after that."""
    every = reduce(DataFrame.unionByName, parts)
    cols = [c for c in every.columns if c != "path"]
    first = every.groupBy("path").agg(F.min(F.struct("part_ord", "id", *[c for c in cols if c not in ("part_ord", "id")])).alias("r"))
    return first.select("path", "r.*").select(*every.columns)


def search(parts: list[DataFrame], query: str, options: SearchOptions = SearchOptions(), limit: int | None = None) -> DataFrame:
    columns = ["part_ord", "id", "path", "name", "is_dir"]
    return _search.page(merged([_search.hits(p, query, options).select(*columns) for p in parts]), clamp_limit(limit))


def stats(entries: DataFrame, *by: str) -> DataFrame:
    """Live entries, slots with dead ones, files and folders."""
    return entries.groupBy(*by).agg(F.count_if("alive").alias("live"), F.count("*").alias("slots"), F.count_if(F.col("alive") & ~F.col("is_dir")).alias("files"), F.count_if(F.col("alive") & F.col("is_dir")).alias("folders"))


def resident(entries: DataFrame, partitions: int) -> DataFrame:
    """What searches read, kept in the executors' memory in the order of ids, spilled to disk where it doesn't fit."""
    columns = ["part_ord", "id", "name", "path", "name_fold", "path_fold", "parent_path", "is_dir", "hidden", "alive"]
    return entries.select(*columns).repartitionByRange(partitions, "part_ord", "id").sortWithinPartitions("part_ord", "id").persist()


def medians(measured: DataFrame, value: str, *by: str) -> DataFrame:
    """The median, least and largest of value and the number of runs, by the columns given."""
    return measured.groupBy(*by).agg(F.median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"), F.count(value).alias("runs"))


def scan_report(walked: DataFrame) -> DataFrame:
    """What a walk (path, is_dir, error) found: files, folders, and folders that could not be read."""
    ok = walked.groupBy("path").agg(F.max("is_dir").alias("is_dir"), F.max(F.col("error").isNotNull()).alias("failed"))
    return ok.agg(F.count_if(~F.col("is_dir")).alias("files"), F.count_if("is_dir").alias("folders"), F.count_if("failed").alias("errors"))


def part_of(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """paths with the innermost root of roots.root that holds them (null if none)."""
    up = paths.select("path").distinct().withColumn("root", F.explode(F.array_append(text.ancestors("path"), F.col("path"))))
    inner = up.join(roots.select("root"), "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.join(inner, "path", "left")


def checked_roots(spark: SparkSession, roots: list[tuple[str, int]]) -> DataFrame:
    """(root, device) pairs with what is kept, and why the others are not: repeated, or inside another on its device."""
    rows = [(i, text.normalise_path(r), d) for i, (r, d) in enumerate(roots)]
    df = spark.createDataFrame(rows, "ord int, root string, device long")
    other = df.select(F.col("ord").alias("o"), F.col("root").alias("outer"), F.col("device").alias("dev"))
    repeated = df.join(other, (F.col("root") == F.col("outer")) & (F.col("o") < F.col("ord")), "left_semi").select("ord", F.lit("repeated").alias("note"))
    nested = df.withColumn("anc", F.explode(text.ancestors("root"))).join(other, (F.col("anc") == F.col("outer")) & (F.col("device") == F.col("dev")), "left_semi").select("ord", F.lit("nested").alias("note"))
    notes = repeated.union(nested).groupBy("ord").agg(F.max("note").alias("note"))
    return df.join(notes, "ord", "left").select("ord", "root", F.col("note").isNull().alias("kept"), F.coalesce("note", F.lit("")).alias("note"))
