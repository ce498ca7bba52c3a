"""A Python data source that walks folders: spark.read.format("pathlens_walk").option("root", ...).load().

One Spark partition per top-level folder, one device, symbolic links not followed, excluded folders pruned with
all below them. Unreadable folders come out as rows with ``error``; a listing that must be of a mount point
raises Unavailable when it isn't one, so that callers keep what they knew.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAX_SUBTREE_DEPTH = 64
SCHEMA = "path string, path_raw binary, is_dir boolean, size_bytes long, mtime double, ino long, error string"


class Unavailable(RuntimeError):
    """The folder is no mount point now."""


def row(raw: bytes, is_dir: bool, stat: os.stat_result | None, error: str | None = None) -> tuple:
    """path_raw is set only where the name isn't UTF-8; path is then for display."""
    try:
        path, kept = raw.decode(), None
    except UnicodeDecodeError:
        path, kept = raw.decode("utf-8", "replace"), raw
    return path, kept, is_dir, None if stat is None or is_dir else stat.st_size, None if stat is None else stat.st_mtime, None if stat is None else stat.st_ino, error


def walk(top: bytes, device: int, exclude: frozenset[bytes], depth: int = 10**6, include_top: bool = True) -> Iterator[tuple]:
    todo = [(top, 0)]
    if include_top:
        yield row(top, True, os.lstat(top))
    while todo:
        folder, level = todo.pop()
        try:
            with os.scandir(folder) as found:
                inside = sorted(found, key=lambda e: e.name)
        except OSError as e:
            yield row(folder, True, None, e.strerror)
            continue
        for e in inside:
            try:
                stat = e.stat(follow_symlinks=False)
            except OSError:
                continue  # gone meanwhile
            is_dir = e.is_dir(follow_symlinks=False)
            if is_dir and e.path in exclude:
                continue
            yield row(e.path, is_dir, stat)
            if is_dir and stat.st_dev == device and level + 1 < depth:
                todo.append((e.path, level + 1))


class Top(InputPartition):
    def __init__(self, path: bytes, device: int, whole: bool):
        super().__init__((path, device, whole))
        self.path, self.device, self.whole = path, device, whole


class WalkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.fsencode(options["root"])
        self.exclude = frozenset(os.fsencode(p) for p in options.get("exclude", "").split("\n") if p)
        self.depth = int(options.get("depth", 10**6))
        if options.get("mount", "false") == "true" and not os.path.ismount(self.root):
            raise Unavailable(f"{options['root']} is not a mount point")

    def partitions(self) -> list[Top]:
        device = os.lstat(self.root).st_dev
        tops = [Top(self.root, device, False)]
        try:
            with os.scandir(self.root) as found:
                for e in sorted(found, key=lambda e: e.name):
                    if e.is_dir(follow_symlinks=False) and e.path not in self.exclude and e.stat(follow_symlinks=False).st_dev == device:
                        tops.append(Top(e.path, device, True))
        except OSError:
            pass  # the first partition reports it
        return tops

    def read(self, top: Top) -> Iterator[tuple]:
        if top.whole:
            if self.depth > 1:
                yield from walk(top.path, top.device, self.exclude, self.depth - 1, include_top=False)
        else:
            yield from walk(top.path, top.device, self.exclude, depth=1)


class WalkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pathlens_walk"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WalkReader:
        return WalkReader(self.options)


def read(spark: SparkSession, root: str, exclude: list[str] = (), mount: bool = False, subtree: bool = False):
    """The rows of a walk; subtree caps it at 64 levels, as for a folder that has just appeared."""
    spark.dataSource.register(WalkSource)
    options = {"root": root, "exclude": "\n".join(exclude), "mount": str(mount).lower()}
    if subtree:
        options["depth"] = str(MAX_SUBTREE_DEPTH)
    return spark.read.format("pathlens_walk").options(**options).load()


def as_listing(walked, root: str):
    """(listing, whether root itself could not be read) of a walk's rows, as graft.merge takes them.

    listing has (path, is_dir, incomplete): one row a path below root, incomplete where its folder could not be read.
    """
    from pyspark.sql import functions as F

    one = walked.groupBy("path").agg(F.max("is_dir").alias("is_dir"), F.max(F.col("error").isNotNull()).alias("incomplete"))
    top = one.filter(F.col("path") == root).select("incomplete").first()
    return one.filter(F.col("path") != root), top is None or top.incomplete
