"""Commands over hits, planned as data; nothing is run here."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlens.functions import text

BATCH_BYTES = 128 * 1024


@dataclass(frozen=True)
class Command:
    args: tuple[str, ...]
    batched: bool


def split_clause(argv: list[str]) -> tuple[list[str], Command | None]:
    """The other arguments, and the command of ``-exec CMD ;`` (one run a hit) or ``-exec CMD {} +`` (batches)."""
    if "-exec" not in argv:
        return list(argv), None
    at = argv.index("-exec")
    end = next((i for i in range(at + 1, len(argv)) if argv[i] in (";", "+")), None)
    if end is None:
        raise ValueError("-exec needs ';' or '+' at the end of its command")
    args, batched = argv[at + 1 : end], argv[end] == "+"
    if not args:
        raise ValueError("-exec needs a command")
    if batched and args[-1] != "{}":
        raise ValueError("-exec ... + needs {} as its last argument")
    return argv[:at] + argv[end + 1 :], Command(tuple(args), batched)


def each(hits: DataFrame, command: Command) -> DataFrame:
    """hits with argv: every ``{}`` in an argument stands for the path."""
    return hits.withColumn("argv", F.array(*(text.substitute(a, "path") for a in command.args)))


def batched(paths: Iterator[str], base: int, budget: int) -> Iterator[list[str]]:
    """Greedy runs of paths whose bytes, one more for each and base fit the budget; a longer path goes alone."""
    held: list[str] = []
    used = base
    for p in paths:
        cost = len(p.encode()) + 1
        if held and used + cost > budget:
            yield held
            held, used = [], base
        held.append(p)
        used += cost
    if held:
        yield held


def batches(hits: DataFrame, command: Command, budget: int = BATCH_BYTES) -> DataFrame:
    """(part, batch, argv): paths in order, packed greedily to the budget within each of Spark's partitions.

    part is the partition's number, so (part, batch) names a batch; one partition gives a single sequence.
    """
    head = list(command.args[:-1])  # the last one stands for the paths
    base = sum(len(a.encode()) + 1 for a in head)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        for n, paths in enumerate(batched((p for f in frames for p in f.path), base, budget)):
            yield pd.DataFrame({"part": [part], "batch": [n], "argv": [head + paths]})

    return hits.select("path").mapInPandas(run, "part int, batch long, argv array<string>")
