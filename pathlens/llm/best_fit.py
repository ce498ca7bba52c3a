"""Best-fit packing of token sequences with a bounded number of open bins.

Each task cuts its documents into pieces of at most ``capacity`` ids and packs the pieces online, batch by batch
with long ones first: a bitset whose bit f says that some open bin has f places free gives the fullest bin that
still takes a piece in a few integer operations. A bin closes when it is full; beyond ``open_bins`` the fullest
closes first. What is still open when a task ends is packed again, bins whole, in groups of ``fan_in`` tasks, and
so on up to a single group, so that few places stay free however the rows are spread.

Null text is empty: a document of the end id alone; very long texts are cut into pieces whole. Rows that repeat an
id are packed each. Pieces of equal length are packed in the order they come. Extra columns are ignored. An empty
table gives no sequence.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlens.llm import runtime, tokens

CAPACITY, OPEN_BINS, FAN_IN = 2048, 1024, 32


class Packer:
    """place() gives (bin, offset); bins are numbered from first on."""

    def __init__(self, capacity: int, open_bins: int, first: int = 0):
        self.capacity, self.most, self.next = capacity, open_bins, first
        self.free: dict[int, list[int]] = defaultdict(list)  # free places -> open bins
        self.bits = self.count = 0

    def place(self, size: int) -> tuple[int, int]:
        fit = self.bits >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            bin_, offset = self._take(room), self.capacity - room
        else:
            room, bin_, offset = self.capacity, self.next, 0
            self.next += 1
        if room > size:
            if self.count == self.most:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
            self._put(room - size, bin_)
        return bin_, offset

    def _take(self, room: int) -> int:
        bins = self.free[room]
        bin_ = bins.pop()
        if not bins:
            self.bits ^= 1 << room
        self.count -= 1
        return bin_

    def _put(self, room: int, bin_: int) -> None:
        self.free[room].append(bin_)
        self.bits |= 1 << room
        self.count += 1

    def open(self) -> set[int]:
        return {b for bins in self.free.values() for b in bins}


def pack(docs: DataFrame, tokenizer: str, end_id: int, text_col: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, fan_in: int = FAN_IN, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; and its ids if asked for."""
    runtime.ship(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    end, top = struct.pack("<I", end_id), 4 * capacity
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64())]
    if with_ids:
        fields.append(("ids", pa.list_(pa.int64())))
    types = pa.schema([*fields, ("open", pa.bool_())])
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, " + "ids array<long>, " * with_ids + "open boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer).encode
        packer = Packer(capacity, open_bins, TaskContext.get().partitionId() << 32)
        held: list[tuple] = []  # pieces in bins that are still open

        def out(rows: list[tuple], is_open: bool) -> Iterator[pa.RecordBatch]:
            if rows:
                cols = [pa.array(c, f.type) for c, f in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([is_open] * len(rows))], schema=types)

        for b in runtime.slices(batches, rows=2048, max_bytes=16 << 20):
            pieces = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = encode(t) + end
                for n, at in enumerate(range(0, len(raw), top)):
                    x = raw[at : at + top]
                    pieces.append((i, n, at // 4, len(x) // 4, zlib.crc32(x), x if with_ids else None))
            pieces.sort(key=lambda p: -p[3])
            for p in pieces:
                bin_, offset = packer.place(p[3])
                held.append((*p[:5], bin_, offset, *([tokens.as_ids(p[5]).astype(np.int64)] if with_ids else [])))
            still = packer.open()
            yield from out([p for p in held if p[5] not in still], False)
            held = [p for p in held if p[5] in still]
        yield from out(held, True)

    # Staged: a task that is run again after others have read its bins would otherwise pack anew.
    placed = runtime.stage(src.mapInArrow(run, ddl), "packed-pieces")
    names = [f.name for f in types if f.name != "open"]
    final = merge_open(placed.filter("open").groupBy("bin").agg(F.sum("length").alias("used")), capacity, open_bins, fan_in)
    closed = placed.filter("not open").select(*names)
    moved = placed.filter("open").join(final, "bin").select(*(F.col("target").alias("bin") if n == "bin" else (F.col("offset") + F.col("shift")).alias("offset") if n == "offset" else F.col(n) for n in names))
    return closed.union(moved).withColumnRenamed("bin", "sequence_id")


def merge_open(bins: DataFrame, capacity: int, open_bins: int, fan_in: int) -> DataFrame:
    """(bin, target, shift) for open bins (bin, used), packed whole into each other level by level."""
    now = runtime.stage(bins.select("bin", F.col("bin").alias("target"), F.lit(0).cast("long").alias("shift"), "used", F.shiftright("bin", 32).alias("part")), "open-bins")
    parts = (now.agg(F.max("part")).first()[0] or 0) + 1

    def pack_group(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["used", "target"], ascending=[False, True])
        packer, target, shift = Packer(capacity, len(g) + 1), [], []
        for used in g.used:
            b, offset = packer.place(int(used))
            target.append(b)
            shift.append(offset)
        heads = dict(zip(target[::-1], g.target[::-1]))  # a merged bin is named after its first member
        sums = g.used.groupby(np.array(target)).sum()
        room = set(sorted(packer.open(), key=lambda b: sums[b])[:open_bins])  # the least full go on
        return pd.DataFrame({"target": g.target, "to": [heads[b] for b in target], "by": shift, "total": [sums[b] for b in target], "goes_on": [b in room for b in target]})

    done = None
    while True:
        level = now.select("target", "used", "part").distinct()
        packed = level.withColumn("g", (F.col("part") / fan_in).cast("long")).groupBy("g").applyInPandas(pack_group, "target long, to long, by long, total long, goes_on boolean")
        joined = now.join(runtime.stage(packed, "bin-moves"), "target").select("bin", F.col("to").alias("target"), (F.col("shift") + F.col("by")).alias("shift"), F.col("total").alias("used"), (F.col("part") / fan_in).cast("long").alias("part"), "goes_on")
        joined = runtime.stage(joined, "open-bins")
        settled = joined.filter("not goes_on") if parts > fan_in else joined
        done = settled.select("bin", "target", "shift") if done is None else done.union(settled.select("bin", "target", "shift"))
        if parts <= fan_in:
            return done
        now, parts = joined.filter("goes_on").drop("goes_on"), -(-parts // fan_in)


def pack_documents(docs: DataFrame, name: str = "word_bpe_49k.json", end_id: int = 0, **kw) -> DataFrame:
    return pack(docs, tokens.tokenizer_path(name), end_id, **kw)
