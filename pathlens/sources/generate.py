"""A synthetic tree of files for measuring: any size, the same for the same seed, made where it is read.

Folders lie on LEVELS levels, deeper ones more often; a folder holds some twenty files. Names are words in Zipf's
proportions (the r-th word about 1 / r as often as the first), a number and an extension, and one file has a name
of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS, FILES_IN_FOLDER, NEEDLE = 8, 20.5, "zqxv-unique-needle.pdf"
WORDS = """report image draft letter budget photo notes scan final music plan invoice contract travel recipe garden backup
review summary holiday project meeting family school lecture chapter poster design survey ticket statement policy passport diploma
license warranty manual catalog diary novel thesis essay drawing portrait landscape concert wedding birthday reunion picnic
marathon orchard harbour village bridge castle forest desert island glacier""".split()
EXTENSIONS = "jpg pdf xlsx txt docx png mp3 md html csv mp4 zip json log svg pptx odt epub flac webp".split()


def _uniform(seed: int, salt: int) -> Column:
    """From 0 to 1, by id."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(1 << 40)) / float(1 << 40)


def _zipf(values: list[str], u: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.floor(F.pow(F.lit(float(len(values) + 1)), u)).cast("int") - 1)


def links(spark: SparkSession, files: int = 1_000_000, seed: int = 1, partitions: int | None = None) -> DataFrame:
    """(id, parent_id, name, is_dir): a root, folders and files; parents have smaller ids than what they hold."""
    folders = max(LEVELS, round(files / FILES_IN_FOLDER))
    share = [k + 1 for k in range(LEVELS)]
    sizes = [max(1, folders * s // sum(share)) for s in share]
    starts = [1 + sum(sizes[:k]) for k in range(LEVELS)]
    end = 1 + sum(sizes)
    up = F.lit(0).cast("long")
    for k in range(1, LEVELS):
        up = F.when(F.col("id") >= starts[k], starts[k - 1] + F.floor(_uniform(seed, 1) * sizes[k - 1])).otherwise(up)
    number = F.floor(_uniform(seed, 2) * 10_000).cast("string")
    dirs = spark.range(1, end, 1, partitions).select("id", up.alias("parent_id"), F.concat(_zipf(WORDS, _uniform(seed, 3)), F.lit("-"), number).alias("name"), F.lit(True).alias("is_dir"))
    stem = F.concat(_zipf(WORDS, _uniform(seed, 3)), F.lit("_"), _zipf(WORDS, _uniform(seed, 4)), F.lit("-"), number, F.lit("."), _zipf(EXTENSIONS, _uniform(seed, 5)))
    name = F.when(F.col("id") == end + files // 2, F.lit(NEEDLE)).otherwise(stem)
    leaves = spark.range(end, end + files, 1, partitions).select("id", (1 + F.floor(_uniform(seed, 6) * (end - 1))).alias("parent_id"), name.alias("name"), F.lit(False).alias("is_dir"))
    root = spark.range(1).select("id", F.lit(None).cast("long").alias("parent_id"), F.lit("/").alias("name"), F.lit(True).alias("is_dir"))
    return root.union(dirs).union(leaves)
