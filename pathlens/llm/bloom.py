"""Bloom filters over 64-bit hashes: built by Spark, of a bounded size, tested in numpy.

A filter has ``bits`` bits a key, from 2 ** LEAST to 2 ** ``most`` bits (64 MB) whatever the number of keys: beyond
that it lets more through, never less. Keys must be uniform hashes, as their own bits are the places. An empty table
gives a filter that holds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlens.llm import runtime

LEAST, MOST = 20, 29
#: Each place takes its bits from another end of the key.
SHIFTS = (0, 17, 34)
#: Bits that one task sets, as a power of two.
CHUNK = 19
#: Keys that a task gathers before it hands on their places, a row a chunk.
KEYS_HELD = 250_000


def build(keys: DataFrame, column: str, bits: int = 16, most: int = MOST) -> np.ndarray:
    """The filter's words as uint64. Places are set in chunks by tasks; the driver gets the chunks, 2 ** most / 8 bytes in all."""
    runtime.ship(keys.sparkSession)
    power = min(most, max(LEAST, (bits * keys.count()).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def dealt() -> pa.RecordBatch:
            p = np.unique(np.concatenate(held))
            chunks, starts = np.unique(p >> np.uint64(CHUNK), return_index=True)
            blobs = [x.tobytes() for x in np.split((p & np.uint64((1 << CHUNK) - 1)).astype(np.uint32), starts[1:])] if len(chunks) else []
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(chunks.astype(np.int64)), pa.array(blobs, pa.binary())], names=["chunk", "blob"])

        for b in batches:
            u = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            held += [(u >> np.uint64(s)) & np.uint64((1 << power) - 1) for s in SHIFTS]
            n += len(u)
            if n >= KEYS_HELD:
                yield dealt()
                n = 0
        if held:
            yield dealt()

    def set_bits(g: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(1 << CHUNK, bool)
        for blob in g.blob:
            flags[np.frombuffer(blob, np.uint32)] = True
        return pd.DataFrame({"chunk": [g.chunk.iloc[0]], "blob": [np.packbits(flags, bitorder="little").tobytes()]})

    dealt = keys.select(F.col(column).cast("long").alias("key")).mapInArrow(places, "chunk long, blob binary")
    out = np.zeros(1 << (power - 6), np.uint64)
    size = 1 << (CHUNK - 6)
    for r in dealt.groupBy("chunk").applyInPandas(set_bits, "chunk long, blob binary").collect():
        out[r.chunk * size : (r.chunk + 1) * size] = np.frombuffer(r.blob, "<u8")
    return out


def contains(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether keys (int64) may have been put in; never False for one that has."""
    u, mask = keys.astype(np.int64).view(np.uint64), np.uint64(len(words) * 64 - 1)
    ok = np.ones(len(keys), bool)
    for s in SHIFTS:
        p = (u >> np.uint64(s)) & mask
        ok &= (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return ok
