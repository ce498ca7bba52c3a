"""Result sinks: one path a line, or NUL after each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def line_safe(found: DataFrame) -> DataFrame:
    """Without the paths that a line could not hold."""
    p = F.col("path")
    return found.filter(~(F.contains(p, F.lit("\n")) | F.contains(p, F.lit("\r"))))


def write_lines(found: DataFrame, path: str) -> None:
    line_safe(found).select("path").write.text(path)


def write_nul(found: DataFrame, path: str) -> None:
    found.select("path").write.option("lineSep", "\0").text(path)
