"""What the operators share: staging in the shared folder, shipping code to workers, bounded batches."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pathlens.operators.staging import checkpoint_folder

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that Spark puts into one Arrow batch at most: texts may be long, and a worker holds a batch whole.
ROWS_IN_BATCH = 2000


def ship(spark: SparkSession) -> None:
    """Puts this checkout on the workers' path; where executors don't see it, install the package there.

    Workers give freed memory back (glibc's trimming, no pool of Arrow's own), and the session's Arrow batches are
    held to ROWS_IN_BATCH rows where it allows more.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGE_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *paths])
        env.setdefault("MALLOC_TRIM_THRESHOLD_", str(2 << 20))
        env.setdefault("MALLOC_MMAP_THRESHOLD_", str(2 << 20))
        env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(batch)) <= ROWS_IN_BATCH:
        spark.conf.set(batch, ROWS_IN_BATCH)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is set, a temporary one on a single machine, else an error."""
    return checkpoint_folder(spark)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back.

    This cuts the lineage, lets a lost executor's work be redone from files, makes whatever was order
    dependent final, and gives the planner real sizes. Spark deletes nothing there; the files belong to the
    application and go with its checkpoint folder.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/pathlens/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into pieces of few rows and bytes, so that Python holds little text at a time."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, min(rows, int(n * max_bytes / max(1, batch.nbytes))))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def count_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
