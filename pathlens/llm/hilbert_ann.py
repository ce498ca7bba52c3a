"""Approximate nearest neighbours by shifted Hilbert curves.

Distinct vectors are projected at random onto a few dimensions, once per curve, shifted and put in Hilbert order.
Each curve's keys are sorted by a range partitioning, which gives every vector a position. Positions and codes (the
vector in one byte a component) go into blocks; a query asks the blocks that its window of positions reaches for
its nearest codes there. The curves' candidates are merged by code, the best ones' vectors fetched once, and their
exact distances ranked again. What is shuffled for a vector is its code once a curve and not the vector.

``window`` is a share of the positions to either side, at least ``least_window`` positions. Unless given, it is the
share that finds ``recall`` of the true neighbours within a bounded sample: in a larger table neighbours lie closer,
so it errs to the wide side. Embeddings without structure (random directions in 64 dimensions) need wide windows, as
no ordering brings their neighbours close, and the work then grows as the square of the table; structured ones need
far less. Blocks are as long as half a window, within bounds, so a query asks few of them; a block's queries beyond
ASKS are dealt over copies of the block, which so never outweigh them. Identical vectors are indexed once, with the
k + 1 smallest ids that any result can need.

Vectors that are null, zero, of another length than most sampled ones, or hold null or non-finite components take
no part, nor do rows without an id; a table without queries or vectors gives an empty result. A row that repeats an
id with the same vector counts once; with different vectors, the nearest counts. Ties go to the smaller id. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathlens.llm import runtime

CURVES, DIMENSIONS, ORDER = 4, 8, 7
RECALL, LEAST_WINDOW = 0.97, 32
#: Positions in a block, and the asks that go to one copy of it.
BLOCKS, ASKS = (1024, 1 << 18), 200_000
SAMPLE, TRIALS = 4000, 500
#: Candidates by code, as multiples of k + 1: from each block, and in all.
FROM_BLOCK, IN_ALL = 2, 4


def hilbert_keys(cells: np.ndarray, order: int) -> np.ndarray:
    """Positions along the Hilbert curve of integer cells (n, d) below 2**order: Skilling's transform, vectorised."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    for level in range(order - 1, 0, -1):
        q = 1 << level
        low = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(order - 1, 0, -1):
        turn = np.where((x[-1] & (1 << level)) != 0, turn ^ ((1 << level) - 1), turn)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(order - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


class Curves:
    """Projections, ranges and shifts; fitted on a bounded sample, which shapes the grid and names the window."""

    def __init__(self, sample: np.ndarray, curves: int, dimensions: int, order: int, seed: int):
        rng = np.random.default_rng(seed)
        width = sample.shape[1]
        d = min(dimensions, width)
        self.order = min(order, 62 // d)
        self.maps = []
        for _ in range(curves):
            basis = np.linalg.qr(rng.standard_normal((width, d)))[0]
            y = sample @ basis
            low, high = np.quantile(y, 0.005, axis=0), np.quantile(y, 0.995, axis=0)
            self.maps.append((basis, low, np.maximum(high - low, 1e-12), rng.random(d)))

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(curves, n)"""
        side = 1 << self.order
        out = []
        for basis, low, span, shift in self.maps:
            # Half the grid holds the data; the shift moves it over the other half.
            unit = np.clip((x @ basis - low) / span, 0, 1) * 0.5 + shift * 0.5
            out.append(hilbert_keys(np.minimum((unit * side).astype(np.int64), side - 1), self.order))
        return np.stack(out)


def fitted_window(shape: Curves, sample: np.ndarray, k: int, recall: float, trials: int = TRIALS) -> float:
    """The share of positions to either side that holds, on one curve or another, that part of the sample's neighbours."""
    x = np.unique(sample, axis=0)
    n, asked = len(x), np.random.default_rng(0).permutation(len(x))[:trials]
    if n <= k + 1:
        return 1.0
    d2 = (x[asked] ** 2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x[asked] @ x.T
    d2[np.arange(len(asked)), asked] = np.inf
    near = np.argpartition(d2, k - 1, axis=1)[:, :k]
    apart = np.full(near.shape, n)
    for key in shape.keys(x):
        pos = np.empty(n, int)
        pos[np.argsort(key, kind="stable")] = np.arange(n)
        apart = np.minimum(apart, np.abs(pos[asked][:, None] - pos[near]))
    return float(np.quantile(apart, recall, method="higher") / n)


def packed(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, n (components), raw (their bytes) of the rows that take part."""
    kind = rows.schema[vec_col].dataType
    dtype = "<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runtime.slices(batches, rows=8192):
            ids, n, raw = [], [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                x = v.values.to_numpy(zero_copy_only=False) if v.is_valid else ()
                if i is not None and len(x) and np.isfinite(x := np.asarray(x, float)).all() and x.any():
                    ids.append(i)
                    n.append(len(x))
                    raw.append((x + 0.0).astype(dtype).tobytes())  # no negative zeros
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int32()), pa.array(raw, pa.binary())], names=["vec_id", "n", "raw"])

    src = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>" if dtype == "<f4" else "array<double>").alias("vec"))
    return src.mapInArrow(run, "vec_id long, n int, raw binary")


def search(rows: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", curves: int = CURVES, dimensions: int = DIMENSIONS, order: int = ORDER, recall: float = RECALL, window: float | None = None, least_window: int = LEAST_WINDOW, blocks: tuple[int, int] = BLOCKS, asks_per_task: int = ASKS, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which is_query(its id column) holds."""
    spark = rows.sparkSession
    runtime.ship(spark)
    clean = runtime.stage(packed(rows, id_col, vec_col), "ann-packed")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = rows.schema[vec_col].dataType
    dtype = "<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8"
    # A bounded sample, in the order of a hash of the id: it shapes the grid and names the usual length and the window.
    sample = [np.frombuffer(r.raw, dtype).astype(float) for r in clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("raw").toLocalIterator()]
    if not sample:
        return empty
    width = max((n := [len(v) for v in sample]), key=n.count)
    sample = np.array([v for v in sample if len(v) == width])
    shape = Curves(sample, curves, dimensions, order, seed)
    share = fitted_window(shape, sample, k, recall) if window is None else window
    scale = 127 / np.abs(sample).max()
    clean = clean.filter(F.col("n") == width).select("vec_id", "raw")

    # The k + 1 smallest ids of each distinct vector; Spark cuts groups to that before it shuffles them.
    by_vector = Window.partitionBy("raw").orderBy("vec_id")
    firsts = clean.distinct().withColumn("n", F.row_number().over(by_vector)).filter(F.col("n") <= k + 1)
    groups = firsts.groupBy("raw").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asked = clean.filter(is_query(F.col("vec_id"))).distinct()
    wanted = asked.select("raw").distinct().withColumn("wanted", F.lit(True))
    # A rep may stand for two vectors if an id repeats: (rep, vh) is the key throughout.
    vectors = runtime.stage(groups.join(wanted, "raw", "left").select(F.get("ids", F.lit(0)).alias("rep"), F.xxhash64("raw").alias("vh"), "raw", "ids", F.coalesce("wanted", F.lit(False)).alias("wanted")), "ann-vectors")
    n, n_asked = vectors.agg(F.count("*"), F.count_if("wanted")).first()
    if not n_asked:
        return empty
    matrix = lambda column: np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width).astype(float)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runtime.slices(batches, rows=4096):
            x = matrix(b.column(2))
            codes = [c.tobytes() for c in np.clip(np.rint(x * scale), -127, 127).astype(np.int8)]
            rep, vh, ask = (b.column(i) for i in (0, 1, 3))
            for curve, key in enumerate(shape.keys(x)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), curve, "i4")), pa.array(key), rep, vh, ask, pa.array(codes, pa.binary())], names=["curve", "key", "rep", "vh", "wanted", "code"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *(b.column(i) for i in range(2, 6)), pa.array(np.full(b.num_rows, part, "i4")), pa.array(np.arange(at, at + b.num_rows))], names=["curve", "rep", "vh", "wanted", "code", "part", "at"])
            at += b.num_rows

    keys = vectors.select("rep", "vh", "raw", "wanted").mapInArrow(keyed, "curve int, key long, rep long, vh long, wanted boolean, code binary")
    ranged = keys.repartitionByRange(runtime.count_partitions(spark), "curve", "key", "vh").sortWithinPartitions("curve", "key", "vh", "rep")
    ordered = runtime.stage(ranged.mapInArrow(numbered, "curve int, rep long, vh long, wanted boolean, code binary, part int, at long"), "ann-order")
    counts = ordered.groupBy("part", "curve").agg(F.count("*").alias("n"), F.min("at").alias("low")).orderBy("curve", "part").collect()  # a row or two per part
    base, total = [], {}
    for r in counts:
        base.append((r.part, r.curve, total.get(r.curve, 0) - r.low))
        total[r.curve] = total.get(r.curve, 0) + r.n
    reach = int(max(least_window, np.ceil(share * n)))
    block = min(max(blocks[0], reach // 2), blocks[1])
    offsets = F.broadcast(spark.createDataFrame(base, "part int, curve int, base long"))  # as few rows as parts
    placed = ordered.join(offsets, ["part", "curve"]).select("curve", "rep", "vh", "wanted", "code", (F.col("at") + F.col("base")).alias("pos"))
    copies = int(max(1, np.ceil(n_asked * min(1.0, (block + 2 * reach) / n) / asks_per_task)))
    last = (n - 1) // block
    cut = lambda c: F.least(F.greatest(F.floor(c / block), F.lit(0)), F.lit(last))
    own = F.floor(F.col("pos") / block).alias("block")
    data = placed.select("curve", own, F.explode(F.array(*map(F.lit, range(copies)))).alias("copy"), F.lit(False).alias("q"), "rep", "vh", "pos", "code")
    asks = placed.filter("wanted").select("curve", F.explode(F.sequence(cut(F.col("pos") - reach), cut(F.col("pos") + reach))).alias("block"), F.pmod("vh", F.lit(copies)).cast("int").alias("copy"), F.lit(True).alias("q"), "rep", "vh", "pos", "code")

    def within(g: pd.DataFrame) -> pd.DataFrame:
        q, x = g[g.q], g[~g.q].sort_values("pos")
        rep, vh = x.rep.to_numpy(), x.vh.to_numpy()
        out = [(q.rep.iloc[i], q.vh.iloc[i], rep[near], vh[near], d) for i, near, d in nearest_codes(q, x, width, reach, FROM_BLOCK * (k + 1))]
        if not out:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("rep", "vh", "x_rep", "x_vh", "d2")})
        sizes = [len(o[2]) for o in out]
        cols = [np.repeat([o[i] for o in out], sizes) for i in (0, 1)] + [np.concatenate([o[i] for o in out]) for i in (2, 3, 4)]
        return pd.DataFrame(dict(zip(("rep", "vh", "x_rep", "x_vh", "d2"), cols)))

    local = data.union(asks).groupBy("curve", "block", "copy").applyInPandas(within, "rep long, vh long, x_rep long, x_vh long, d2 long")
    best = Window.partitionBy("rep", "vh").orderBy("d2", "x_rep", "x_vh")
    short = runtime.stage(local.distinct().withColumn("n", F.row_number().over(best)).filter(F.col("n") <= IN_ALL * (k + 1)).drop("n", "d2"), "ann-short")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runtime.slices(batches, rows=8192):
            d = np.sqrt(((matrix(b.column(3)) - matrix(b.column(4))) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(d)], names=["rep", "vh", "ids", "score"])

    theirs = vectors.select(F.col("rep").alias("x_rep"), F.col("vh").alias("x_vh"), F.col("raw").alias("x_raw"), "ids")
    pairs = short.join(theirs, ["x_rep", "x_vh"]).join(vectors.filter("wanted").select("rep", "vh", "raw"), ["rep", "vh"])
    rated = pairs.select("rep", "vh", "ids", "raw", "x_raw").mapInArrow(exact, "rep long, vh long, ids array<long>, score double")
    nearest = Window.partitionBy("rep", "vh").orderBy("score", "vec_id")
    single = rated.select("rep", "vh", "score", F.explode("ids").alias("vec_id")).groupBy("rep", "vh", "vec_id").agg(F.min("score").alias("score"))
    found = runtime.stage(single.withColumn("n", F.row_number().over(nearest)).filter(F.col("n") <= k + 1).drop("n"), "ann-found")
    queries = asked.withColumnRenamed("vec_id", "query_id").join(vectors.filter("wanted").select("raw", "rep", "vh"), "raw").select("query_id", "rep", "vh")
    per_query = Window.partitionBy("query_id").orderBy("score", "vec_id")
    answers = queries.join(found, ["rep", "vh"]).filter("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return answers.withColumn("rank", F.row_number().over(per_query)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_codes(q: pd.DataFrame, x: pd.DataFrame, width: int, reach: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query its place, the places in x (sorted by position) of the nearest codes within reach, their squared distances."""
    codes = lambda g: np.frombuffer(b"".join(g.code), np.int8).reshape(-1, width).astype(np.float32)
    if not len(q) or not len(x):
        return
    xs, at, q_at = codes(x), x.pos.to_numpy(), q.pos.to_numpy()
    xx = (xs**2).sum(1)
    lo, hi = np.searchsorted(at, q_at - reach), np.searchsorted(at, q_at + reach, "right")
    qs = codes(q)
    for k in range(0, len(q), 128):
        part = qs[k : k + 128]
        d2 = (part**2).sum(1)[:, None] + xx[None] - 2 * part @ xs.T
        for i, row in enumerate(d2):
            a, b = lo[k + i], hi[k + i]
            if a < b:
                own = row[a:b]
                near = np.argpartition(own, most - 1)[:most] if b - a > most else np.arange(b - a)
                yield k + i, a + near, np.rint(own[near]).astype(np.int64)
