"""Versioned snapshots: Parquet directories and a pointer that is flipped when one is whole.

A save may replace some parts only; the pointer then names for each part the version that holds it, and the other
parts' files stay where they are.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMAT, MAX_PARTS = 1, 4096


class SnapshotError(ValueError):
    """A snapshot that is not there, not ours, or breaks an invariant."""


class Store:
    """<root>/v=<n>/ holds the entries by part; <root>/CURRENT names the version that readers take."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _current(self) -> dict | None:
        at = self._path(f"{self.root}/CURRENT")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            raw = bytes(stream.readAllBytes())
        finally:
            stream.close()
        try:
            found = json.loads(raw)
        except ValueError:
            raise SnapshotError("CURRENT is no pointer of ours") from None
        if found.get("format") != FORMAT:
            raise SnapshotError(f"unknown snapshot format {found.get('format')}")
        return found

    def version(self) -> int | None:
        now = self._current()
        return now and now["version"]

    def batch(self, source: str) -> int | None:
        """The last batch of a stream that the current version holds."""
        return ((self._current() or {}).get("batches") or {}).get(source)

    def save(self, entries: DataFrame, batches: dict[str, int] | None = None, parts: list[str] | None = None) -> int:
        """Writes a new version beside the others, then flips the pointer by a rename; readers never see half of one.

        With parts, entries hold all rows of these parts, which are replaced; the others stay.
        """
        now = self._current() or {}
        version = now.get("version", 0) + 1
        writer = entries.write.mode("overwrite")
        if "part" in entries.columns:
            writer = writer.partitionBy("part")
        at = f"{self.root}/v={version}"
        held = now.get("parts")
        if parts is not None:
            if bad := [p for p in parts if not re.fullmatch(r"[A-Za-z0-9_-]+", p)]:
                raise SnapshotError(f"parts to replace need plain names: {bad[0]}")
            if now and held is None:
                raise SnapshotError("the current version is not held by parts; save it whole with parts first")
        writer.parquet(at)
        if parts is not None:
            written = {n[5:] for n in self._names(at) if n.startswith("part=")}
            if not written <= set(parts):
                raise SnapshotError("entries of other parts than those to replace")
            held = {p: v for p, v in (held or {}).items() if p not in parts} | {p: version for p in written}
        else:
            held = None
        used = sorted({version, *(held or {}).values()})
        # A version that the pointer no longer names stays for the last readers: until keep more have come.
        freed = {v: n for v, n in {**{str(v): version for v in now.get("used", [])}, **now.get("freed", {})}.items() if int(v) not in used}
        gone = [v for v, n in freed.items() if version - n >= self.keep - 1]
        pointer = {"format": FORMAT, "version": version, "schema": json.loads(entries.schema.json()), "batches": {**now.get("batches", {}), **(batches or {})}, "parts": held, "used": used, "freed": {v: n for v, n in freed.items() if v not in gone}}
        self._flip(pointer)
        for v in gone:
            self._fs.delete(self._path(f"{self.root}/v={v}"), True)
        return version

    def _names(self, folder: str) -> list[str]:
        return [f.getPath().getName() for f in self._fs.listStatus(self._path(folder))]

    def _flip(self, pointer: dict) -> None:
        tmp, at = self._path(f"{self.root}/CURRENT.tmp"), self._path(f"{self.root}/CURRENT")
        out = self._fs.create(tmp, True)
        out.write(json.dumps(pointer).encode())
        out.close()
        jvm = self.spark.sparkContext._jvm
        self._fs.setPermission(tmp, jvm.org.apache.hadoop.fs.permission.FsPermission("600"))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._fs.makeQualified(tmp), self._fs.makeQualified(at), options)

    def load(self, check: bool = True, parts: list[str] | None = None) -> DataFrame:
        """The current version's rows; of parts only, if given and if it is held by parts."""
        now = self._current()
        if now is None:
            raise SnapshotError("there is no snapshot")
        schema = T.StructType.fromJson(now["schema"])
        held = now.get("parts")
        if held is None:
            df = self.spark.read.schema(schema).parquet(f"{self.root}/v={now['version']}")
            if parts is not None:
                df = df.filter(F.col("part").isin(parts))
        else:
            df = self.spark.createDataFrame([], schema)
            by_version: dict[int, list[str]] = {}
            for p, v in held.items():
                if parts is None or p in parts:
                    by_version.setdefault(v, []).append(p)
            for v, own in sorted(by_version.items()):
                base = f"{self.root}/v={v}"
                df = df.union(self.spark.read.schema(schema).option("basePath", base).parquet(*(f"{base}/part={p}" for p in sorted(own))).select(*schema.names))
        if check:
            validate(df)
        return df


def validate(entries: DataFrame) -> None:
    """Raises unless parts are few, roots exist, ids are unique, and every parent is there and stands before its child."""
    have = set(entries.columns)
    if not {"id", "parent_id"} <= have:
        return
    rows = entries.select((F.col("part") if "part" in have else F.lit("")).alias("p"), "id", "parent_id")
    found = rows.groupBy("p").agg(F.count_if(F.col("parent_id").isNull()).alias("roots"), F.count_if(F.col("parent_id") >= F.col("id")).alias("backward"))
    parts, rootless, backward = found.agg(F.count("*"), F.count_if(F.col("roots") == 0), F.coalesce(F.sum("backward"), F.lit(0))).first()
    if parts > MAX_PARTS:
        raise SnapshotError(f"{parts} parts; at most {MAX_PARTS}")
    if rootless or backward:
        raise SnapshotError(f"{rootless} parts without a root, {backward} entries before their parents")
    ids = rows.groupBy("p", "id").agg(F.count("*").alias("n"))
    up = rows.filter("parent_id is not null").groupBy("p", F.col("parent_id").alias("id")).agg(F.lit(1).alias("wanted"))
    missing, repeated = up.join(ids, ["p", "id"], "full").agg(F.count_if(F.col("n").isNull()), F.count_if(F.col("n") > 1)).first()
    if missing or repeated:
        raise SnapshotError(f"{missing} parents are missing, {repeated} ids are repeated")
