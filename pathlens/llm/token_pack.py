"""Token ids in patched frame-of-reference blocks.

Documents go in ascending id order into segments. A segment's payload is a file of its own:

    magic "PFB1" | block size u32 | ids u64 | blocks u32 | starts of blocks u32 * (blocks + 1) | blocks
    block: minimum u32 | width u8 | 0 u8 | exceptions n u16 | packed (id - minimum) low bits | positions u16 * n | values u32 * n

The width is the one that ``percentile`` of a block's differences fit; the others are exceptions, stored whole.
Payloads are rows of Parquet part files, which any store that Spark writes to takes, with Spark's commit
protocol, and carry their documents' ids and lengths. A document is never cut between segments.

Null text is empty: a document of the end id alone; very long texts are encoded whole. Rows with a null id come
first; rows that repeat an id follow each other in the order of their texts, and are dealt over tasks by their
texts' beginnings, so one id may hold many rows. Extra columns are ignored. An empty table gives no segment.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlens.llm import runtime, tokens

MAGIC = b"PFB1"
BLOCK, PERCENTILE, SEGMENT = 512, 90, 1 << 17
SEGMENTS = "part int, segment int, first long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


def pack(ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> bytes:
    n = len(ids)
    count = -(-n // block)
    if not n:
        return MAGIC + struct.pack("<IQI", block, 0, 0) + struct.pack("<I", 0)
    v = np.empty(count * block, np.uint32)
    v[:n], v[n:] = ids, ids[-1]
    v = v.reshape(count, block)
    low = v.min(1)
    d = v - low[:, None]
    bits = np.frexp(d.astype(np.float64))[1]
    k = min(block - 1, block * percentile // 100)
    width = np.partition(bits, k, axis=1)[:, k]
    packed: list[bytes] = [b""] * count
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            flags = (d[rows][:, :, None] >> np.arange(w, dtype=np.uint32)).astype(np.uint8) & 1
            for r, raw in zip(rows, np.packbits(flags.reshape(len(rows), -1), axis=1, bitorder="little")):
                packed[r] = raw.tobytes()
    out = []
    over = bits > width[:, None]
    some = over.any(1)
    for r in range(count):
        at = np.flatnonzero(over[r]) if some[r] else ()
        tail = at.astype("<u2").tobytes() + d[r, at].astype("<u4").tobytes() if len(at) else b""
        out.append(struct.pack("<IBBH", low[r], width[r], 0, len(at)) + packed[r] + tail)
    starts = np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype("<u4")
    return MAGIC + struct.pack("<IQI", block, n, count) + starts.tobytes() + b"".join(out)


def unpack(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """ids [first, last) of a payload; only the blocks that hold them are read."""
    if payload[:4] != MAGIC:
        raise ValueError("not a block file")
    block, n, count = struct.unpack_from("<IQI", payload, 4)
    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, np.uint32)
    starts = np.frombuffer(payload, "<u4", count + 1, 20)
    data = 20 + 4 * (count + 1)
    b0, b1 = first // block, -(-last // block)
    out = np.empty((b1 - b0, block), np.uint32)
    by_width: dict[int, list] = {}
    patches = []
    for b in range(b0, b1):
        at = data + int(starts[b])
        low, width, _, n_over = struct.unpack_from("<IBBH", payload, at)
        size = block * width // 8
        by_width.setdefault(width, []).append((b - b0, low, at + 8))
        if n_over:
            patches.append((b - b0, low, at + 8 + size, n_over))
    for w, rows in by_width.items():
        where = [r for r, _, _ in rows]
        lows = np.array([x for _, x, _ in rows], np.uint32)[:, None]
        if not w:
            out[where] = lows
            continue
        raw = np.stack([np.frombuffer(payload, np.uint8, block * w // 8, at) for _, _, at in rows])
        flags = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(rows), block, w)
        values = np.zeros((len(rows), block), np.uint32)
        for i in range(w):
            values |= flags[:, :, i].astype(np.uint32) << np.uint32(i)
        out[where] = values + lows
    for r, low, at, k in patches:
        pos = np.frombuffer(payload, "<u2", k, at)
        out[r, pos] = np.frombuffer(payload, "<u4", k, at + 2 * k) + np.uint32(low)
    return out.reshape(-1)[first - b0 * block : last - b0 * block]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, text_col: str = "text", id_col: str = "doc_id", segment_ids: int = SEGMENT) -> None:
    """Encodes docs and writes their segments under path, in ascending id order over the part numbers."""
    spark = docs.sparkSession
    runtime.ship(spark)
    n = runtime.count_partitions(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    end = struct.pack("<I", end_id)
    types = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), tokens.encoder(tokenizer).encode
        raws, ids, state = [], [], [0, 0, 0]

        def segment() -> pa.RecordBatch:
            all_ids = tokens.as_ids(b"".join(raws))
            row = [part, state[0], state[1], len(all_ids), list(ids), [len(r) // 4 for r in raws], pack(all_ids)]
            state[:] = [state[0] + 1, state[1] + len(all_ids), 0]
            raws.clear(), ids.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, types)], schema=types)

        for b in runtime.slices(batches):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = encode(t) + end
                raws.append(raw)
                ids.append(i)
                state[2] += len(raw) // 4
                if state[2] >= segment_ids:
                    yield segment()
        if raws:
            yield segment()

    # Ordered by (id, text); 64 characters of the text suffice to cut within an id.
    src.repartitionByRange(n, F.col("doc_id"), F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text").mapInArrow(run, SEGMENTS).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of the files under path: doc_id, start, n_tokens, ids_crc32, and its ids if asked for."""
    runtime.ship(spark)
    files = spark.read.schema(SEGMENTS).parquet(path)
    offset, offsets = 0, {}
    for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").toLocalIterator():  # one row a part file
        offsets[r.part], offset = offset, offset + r.n
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.uint32()))] * with_ids
    types = pa.schema([(n, pa.list_(pa.int64()) if n == "ids" else t) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(i, 1) for i in range(batch.num_rows)):
                part, first, doc_ids, lengths, payload = (b.column(i)[0].as_py() for i in range(5))
                ids = unpack(payload).astype("<u4")
                stops = np.cumsum(lengths)
                starts = stops - lengths
                crc = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(starts, stops)]
                cols = [pa.array(doc_ids, pa.int64()), pa.array(starts + (offsets[part] + first)), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.array([ids[s:e].astype(np.int64) for s, e in zip(starts, stops)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, schema=types)

    return files.select("part", "first", "doc_ids", "lengths", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def round_trip(docs: DataFrame, name: str = "byte_bpe_50k.json", end_id: int = 2, path: str | None = None) -> DataFrame:
    """Writes docs under path (in the shared folder, if None) and reads the files back."""
    spark = docs.sparkSession
    path = path or f"{runtime.shared_folder(spark)}/pathlens/token-files-{uuid.uuid4().hex}"
    write(docs, path, tokens.tokenizer_path(name), end_id)
    return read(spark, path)
