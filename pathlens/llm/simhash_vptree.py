"""SimHash near-duplicates with vantage-point trees.

Every text gets a 64-bit fingerprint of its word shingles. Distinct fingerprints are routed through the top of
one vantage-point tree, grown on a bounded sample: at each node the Hamming distance to a vantage point sends a
fingerprint inside (at most the median), outside, or, within ``radius`` below the boundary, to both. By the
triangle bound two fingerprints at most ``radius`` apart then share a shard, so each shard finds its pairs alone,
by the same splits down to small leaves that are compared in full; a shard returns a spanning forest of its
links. Shards are counted before, and those over twice SHARD get a subtree grown on a sample of their own, again and
again, so no task's share grows with the corpus. Only fingerprints that no vantage point tells apart stay together
(all within a few bits of each other, which bounds their number); their links are looked up by flipping bits.
Large-star/small-star rounds join the forests into components.

Exact copies share a fingerprint and are never expanded into pairs. Null and empty texts have fingerprint zero,
linked like any other. A row with a null id gets its group's component (the smallest id there; null if none).
Repeated rows get the same result each; an empty table gives an empty one; very long texts are read whole; extra
columns are ignored, or kept by ``drop_duplicates``.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathlens.llm import runtime

SEED = 42
BITS = 64
#: Fingerprints a shard should hold, and the most that only the tree's shape is learned from.
SHARD, SAMPLE = 30_000, 20_000
LEAF, PAIRWISE = 128, 4096


def fingerprint(text: str | None, width: int = 3) -> int:
    """Bits set in over half of the XXH64 values of the width-word shingles, as an unsigned integer."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return 0
    n, step = max(1, len(words) - width + 1), 1 << 16

    def parts() -> Iterator[np.ndarray]:
        for at in range(0, n, step):
            part = words[at : at + step + width - 1]
            shingles = map(b" ".join, zip(*(part[k:] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
            yield np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), np.uint64)

    return majority(parts(), n)


def majority(parts: Iterable[np.ndarray], n: int) -> int:
    """The bits set in over half of n hashes."""
    total = np.zeros(BITS, np.int64)
    for h in parts:
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row."""
    runtime.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runtime.slices(batches):
            fp = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def distance(a: np.ndarray, v: np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ v).astype(np.int16)


def vantage(x: np.ndarray, radius: int, tries: int = 8) -> tuple[np.uint64, int] | None:
    """The vantage point and boundary that balance the sides with few on both; None if no split makes both smaller."""
    best, n = None, len(x)
    for v in x[np.linspace(0, n - 1, min(n, tries)).astype(int)]:
        d = distance(x, v)
        mu = int(np.median(d))
        for m in (mu, mu - 1):
            inside, outside = int((d <= m).sum()), int((d > m - radius).sum())
            cost = inside + outside + max(inside, outside)
            if max(inside, outside) < n and (best is None or cost < best[0]):
                best = (cost, v, m)
    return best and (best[1], best[2])


def top_tree(sample: np.ndarray, depth: int, radius: int) -> list:
    """Nested [vantage, boundary, inside, outside]; a leaf is []."""
    if depth == 0 or len(sample) < 64:
        return []
    found = vantage(sample, radius)
    if found is None:
        return []
    v, mu = found
    d = distance(sample, v)
    return [int(v), mu, top_tree(sample[d <= mu], depth - 1, radius), top_tree(sample[d > mu - radius], depth - 1, radius)]


def route(x: np.ndarray, tree: list, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """Shard numbers and the positions in x that belong there."""
    todo = [(tree, np.arange(len(x)), 1)]
    while todo:
        node, at, name = todo.pop()
        if not node:
            if len(at):
                yield name, at
            continue
        v, mu, inside, outside = node
        d = distance(x[at], np.uint64(v))
        todo += [(inside, at[d <= mu], 2 * name), (outside, at[d > mu - radius], 2 * name + 1)]


def links(x: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of all pairs at most radius apart, each at least once."""
    todo = [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) > LEAF and (found := vantage(x[at], radius)):
            d = distance(x[at], found[0])
            inside, outside = at[d <= found[1]], at[d > found[1] - radius]
            if len(inside) + len(outside) < 1.7 * len(at):
                todo += [inside, outside]
                continue
        if len(at) > PAIRWISE:
            yield from flipped(x, at, radius)
            continue
        own = x[at]
        for k in range(0, len(at), 256):  # a leaf, or fingerprints that no vantage point tells apart
            near = np.bitwise_count(own[k : k + 256, None] ^ own[None, k:]) <= radius
            i, j = np.nonzero(near)
            keep = i < j
            if keep.any():
                yield at[k + i[keep]], at[k + j[keep]]


def flipped(x: np.ndarray, at: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs by flipping up to radius bits and looking the result up: no square of their number."""
    order = at[np.argsort(x[at])]
    own = x[order]
    for k in range(1, radius + 1):
        for bits in combinations(range(BITS), k):
            want = own ^ np.uint64(sum(1 << b for b in bits))
            place = np.minimum(np.searchsorted(own, want), len(own) - 1)
            hit = (own[place] == want) & (own < want)
            if hit.any():
                yield order[hit], order[place[hit]]


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Per position the smallest position linked to it."""
    up = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = up[i], up[j]
            low, high = np.minimum(a, b), np.maximum(a, b)
            if (low == high).all():
                break
            np.minimum.at(up, high, low)
            while True:
                jump = up[up]
                if (jump == up).all():
                    break
                up = jump
    return up


def routed(rows: DataFrame, trees: dict[int, list], radius: int, names: dict[int, int]) -> DataFrame:
    """rows (shard, fp) dealt to the leaves of their shard's tree; leaf numbers count on from the tree's name."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard, fp = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for s in np.unique(shard):
                x = fp[shard == s]
                for leaf, at in route(x, trees[int(s)], radius):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), names[int(s)] + leaf, np.int64)), pa.array(x[at].view(np.int64))], names=["shard", "fp"])

    return rows.mapInArrow(assign, "shard long, fp long")


def sharded(nodes: DataFrame, radius: int, n: int, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """(shard, fp): every two fingerprints at most radius apart share a shard; shards hold at most 2 * shard unless
    no vantage point splits them. Samples shape the trees alone; any shape finds all pairs."""
    rows = nodes.select(F.lit(0).cast("long").alias("shard"), "fp")
    over, done, first = {0: n}, None, 1
    while over := {s: c for s, c in over.items() if c > 2 * shard or (c > shard and done is None)}:
        # A sample a shard, in the order of a hash, of sample rows in all or 256 a shard; at most n / shard shards are over.
        each = max(256, sample // len(over))
        order = Window.partitionBy("shard").orderBy(F.xxhash64("fp"), "fp")
        picked = rows.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= each).toPandas() if len(over) > 1 else rows.orderBy(F.xxhash64("fp"), "fp").limit(each).toPandas()
        trees, names = {}, {}
        for s, g in picked.groupby("shard"):
            depth = max(1, math.ceil(math.log(over[s] / shard) / math.log(1 / 0.6)))
            trees[s] = top_tree(np.sort(g.fp.to_numpy(np.int64).view(np.uint64)), min(depth, 12), radius)
            names[s], first = first, first + (2 << 12)
        dealt = runtime.stage(routed(rows, trees, radius, names), "fp-shards")
        sizes = {r.shard: r["count"] for r in dealt.groupBy("shard").count().toLocalIterator()}  # a row a shard
        # What a tree could not make smaller stays as it is.
        stuck = {names[s] + 1 for s, t in trees.items() if not t}
        over = {s: c for s, c in sizes.items() if s not in stuck and c > 2 * shard}
        small = dealt.filter(~F.col("shard").isin([int(s) for s in over])) if over else dealt
        done = small if done is None else done.union(small)
        rows = dealt.filter(F.col("shard").isin([int(s) for s in over])) if over else rows
    return rows if done is None else done


def shard_links(nodes: DataFrame, radius: int, n: int, shard: int = SHARD) -> DataFrame:
    """Links (a, b), a > b as longs, that connect whatever fingerprints of nodes.fp are linked."""

    def within(g: pd.DataFrame) -> pd.DataFrame:
        x = np.unique(g.fp.to_numpy(np.int64))
        up = forest(len(x), links(x.view(np.uint64), radius))
        at = np.flatnonzero(up != np.arange(len(x)))
        return pd.DataFrame({"a": x[at], "b": x[up[at]]})

    return sharded(nodes, radius, n, shard).groupBy("shard").applyInPandas(within, "a long, b long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(fp, root) for every end of edges (a > b): root is the component's smallest end.

    Alternating large-star and small-star rounds; every round is staged, and neighbours' minima are staged
    before they are joined, so that Spark may split a hub's rows.
    """

    def star(e: DataFrame, name: str) -> DataFrame:
        low = runtime.stage(e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), name)
        return e.join(low, "a")

    e, before = edges, None
    for _ in range(max_rounds):
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = star(both, "cc-large").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        down = runtime.stage(large, "cc-edges")
        joined = star(down, "cc-small")
        small = joined.filter("b != m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).union(joined.select("a", F.col("m").alias("b"))).distinct()
        e = runtime.stage(small, "cc-edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("fp"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", radius: int = 2, width: int = 3) -> DataFrame:
    """doc_id, fp (long), component_id (smallest doc_id reachable by links) of every row."""
    spark = docs.sparkSession
    prints = runtime.stage(fingerprints(docs, text_col, id_col, width), "fingerprints")
    nodes = runtime.stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp-nodes")
    edges = runtime.stage(shard_links(nodes, radius, nodes.count()), "fp-links")
    if edges.isEmpty():
        named = nodes.select("fp", F.col("least").alias("component_id"))
    else:
        rooted = nodes.join(runtime.stage(components(edges), "fp-roots"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        least = runtime.stage(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "fp-least")
        named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(runtime.stage(named, "fp-components"), "fp")


def drop_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", radius: int = 2, width: int = 3) -> DataFrame:
    """docs with one row of each near-duplicate group: the one with the smallest id.

    Rows with a null id can't be told apart: where their group has no id at all, the first of each fingerprint
    stays, else none. Rows that repeat an id count as copies: the first stays. First is by text, then by the whole row.
    """
    found = runtime.stage(near_duplicates(docs, text_col, id_col, radius, width), "near-duplicates")
    gone = runtime.stage(found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(id_col)).distinct(), "duplicate-ids")
    kept = docs.join(gone, id_col, "left_anti").select(*docs.columns)
    odd = runtime.stage(found.groupBy("doc_id").count().filter("count > 1 or doc_id is null").select(F.col("doc_id").alias(id_col)), "repeated-ids")
    if odd.isEmpty():
        return kept
    single = kept.join(odd, id_col, "left_anti").filter(F.col(id_col).isNotNull())
    again = first_rows(kept.join(odd, id_col, "left_semi"), id_col, text_col)
    fp = free_name(docs, "__fp")
    lone = found.filter("component_id is null").select(F.col("fp").alias(fp)).distinct()
    nameless = with_fingerprint(docs.filter(F.col(id_col).isNull()), fp, text_col, width).join(lone, fp, "left_semi")
    return single.select(*docs.columns).union(again.select(*docs.columns)).union(first_rows(nameless, fp, text_col).select(*docs.columns))


def free_name(rows: DataFrame, name: str) -> str:
    """name, longer by underscores where rows has such a column."""
    while name.lower() in (c.lower() for c in rows.columns):
        name += "_"
    return name


def first_rows(rows: DataFrame, key: str, text_col: str) -> DataFrame:
    """One row of each key; Spark cuts a key's rows to one before it shuffles them."""
    order, n = Window.partitionBy(key).orderBy(text_col, F.to_json(F.struct(*rows.columns))), free_name(rows, "__n")
    return rows.withColumn(n, F.row_number().over(order)).filter(F.col(n) == 1).drop(n)


def with_fingerprint(docs: DataFrame, out_col: str, text_col: str, width: int) -> DataFrame:
    """docs with their fingerprints as out_col, a new column."""
    runtime.ship(docs.sparkSession)
    at, names = docs.columns.index(text_col), [*docs.columns, out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runtime.slices(batches):
            fp = np.array([fingerprint(t, width) for t in b.column(at).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp)], names=names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out_col, T.LongType())]))
