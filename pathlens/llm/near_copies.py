"""Near copies: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more, all of them.

A row's node is the XXH64 value of its words (lower-cased as in simhash_vptree), so exact copies are one node.
Candidates come from two sides. The vantage-point trees of simhash_vptree give the nodes whose 5-word
fingerprints differ in 2 bits or fewer; most near copies differ in more, at which the trees' boundaries overlap
too far to divide anything. So a prefix filter gives the rest: shingles are put in one order, those of many texts
last (all are counted, by 32 bits of their hash and a Bloom filter over the result), then by hash; two sets of that
similarity share a shingle among the first |x| - ceil(0.8 |x|) + 1 of each, whatever the order is. So a passage that
many texts share makes no candidates, and miscounts change how many there are, not which pairs are found. Sizes, places in the order and parity bitmaps (each differing bit is a shingle that one side
lacks) rule out most; exact Jaccard over the whole sets decides the rest. Each shingle's nodes are first compared
with its smallest one, and only nodes not yet linked with each other, so that a cluster costs its size and not
its square.

Fewer than five words are one shingle. Null and empty texts are one node. Of each component of linked nodes one
row stays, chosen by id (null last), node, text and the whole row; a row goes for its own text only, whatever
other rows have its id. Very long texts count whole; an empty table gives an empty one; ties go by that order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathlens.llm import bloom, runtime
from pathlens.llm.simhash_vptree import SEED, components, free_name, majority, shard_links

WIDTH = 5
#: A shingle of more texts than this goes last; more, where over MOST_CROWDED shingles would.
CROWD, MOST_CROWDED = 4, 30_000_000
#: Texts whose postings a bucket holds on average.
BUCKET = 6_000
#: Nodes of one shingle that are compared in one task.
BLOCK = 4_000
#: Differing bits at which the trees link fingerprints.
RADIUS = 2
POSTING = np.dtype([("shingle", "<i8"), ("node", "<i8"), ("n", "<i4"), ("s", "<i4"), ("at", "<i4")])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def node_of(words: list[bytes]) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(b" ".join(words), SEED)


def hashes(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """The shingles' hashes, repeats included; none of no words."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.empty(0, np.uint64)
    runs = map(b" ".join, zip(*(words[k:] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.fromiter((xxh64_intdigest(s, SEED) for s in runs), np.uint64)


def shingles(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """The distinct shingles' hashes in order."""
    return np.unique(hashes(words, width).view(np.int64))


def parity(h: np.ndarray) -> bytes:
    """A bitmap of some two bits a shingle: bit i is set if an odd number of shingles falls on it."""
    size = 1 << max(6, (2 * len(h)).bit_length())
    return np.packbits(np.bincount((h.view(np.uint64) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Differing bits of two bitmaps, the longer one folded: at most as many as the shingles that only one set has."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def as_long(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def prefix(n: int, s: int) -> int:
    """How many first shingles, of s that others may have, meet one of every set at 0.8 or more; below 1: no such set."""
    return s - (4 * n + 4) // 5 + 1


def crowd_keys(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of shingles' hashes: bucket, 32 bits, and both mixed into a uniform 64-bit key."""
    u = h.view(np.uint64)
    bucket, high = (u & np.uint64(0xFFFFFFFF)) % np.uint64(buckets), u >> np.uint64(32)
    return bucket, high.astype(np.uint32), mixed(bucket << np.uint64(32) | high)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))).view(np.int64)


def by_bucket(bucket: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The buckets that occur and the bytes of their rows."""
    order = np.argsort(bucket, kind="stable")
    names, starts = np.unique(bucket[order], return_index=True)
    return names.astype(np.int64), [x.tobytes() for x in np.split(rows[order], starts[1:])] if len(names) else []


def counted(docs: DataFrame, text_col: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bloom filters over the keys of the shingles of two texts or more, and of many; copies within a batch count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runtime.slices(batches):
            h = np.concatenate([shingles(words_of(t)) for t in set(b.column(0).to_pylist())])
            bucket, high, _ = crowd_keys(h, buckets)
            names, blobs = by_bucket(bucket, high)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def count(g: pd.DataFrame) -> pd.DataFrame:
        high, n = np.unique(np.frombuffer(b"".join(g.blob), np.uint32), return_counts=True)
        high, n = high[n > 1], n[n > 1]
        return pd.DataFrame({"key": mixed(np.uint64(g.bucket.iloc[0]) << np.uint64(32) | high.astype(np.uint64)), "n": n})

    packed = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, blob binary")
    found = runtime.stage(packed.groupBy("bucket").applyInPandas(count, "key long, n int"), "copy-counts")
    least, total = CROWD, 0
    for r in found.groupBy(F.floor(F.log2("n")).alias("power")).count().orderBy(F.desc("power")).collect():  # at most 31 rows
        total += r["count"]
        if total > MOST_CROWDED:
            least = max(CROWD, 2 ** (r.power + 1) - 1)
            break
    return bloom.build(found, "key", 8), bloom.build(found.filter(F.col("n") > least), "key", 8)


def postings(docs: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """First shingles that nodes share, and the nodes.

    The first: node, n (size of its set), s (of these, what others may have), shingle, at (its place in the order),
    and the same of the hub there. The second: node, n, fp (fingerprint), bitmap. Both are packed and shuffled once, by
    bucket; nodes that can have no near copy are in neither.
    """
    buckets = max(runtime.count_partitions(docs.sparkSession), docs.count() // BUCKET)
    shipped = docs.sparkSession.sparkContext.broadcast(counted(docs, text_col, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runtime.slices(batches):
            made, nodes, passed = [np.empty(0, POSTING)], {}, set()
            for t in b.column(0).to_pylist():
                words = words_of(t)
                node = int(np.uint64(node_of(words)).astype(np.int64))
                if node in passed:
                    continue
                passed.add(node)
                raw = hashes(words)
                h = np.unique(raw.view(np.int64))
                key = crowd_keys(h, buckets)[2]
                elsewhere = bloom.contains(shipped.value[0], key)
                first = prefix(len(h), int(elsewhere.sum()))
                if first < 1 or not len(h):
                    continue
                nodes[node] = (len(h), int(np.uint64(majority([raw], len(raw))).astype(np.int64)), parity(h))
                ours = h[elsewhere]
                ours = ours[np.argsort(bloom.contains(shipped.value[1], key[elsewhere]), kind="stable")]
                rows = np.empty(first, POSTING)
                rows["shingle"], rows["at"] = ours[:first], np.arange(first)
                rows["node"], rows["n"], rows["s"] = node, len(h), len(ours)
                made.append(rows)
            rows = np.concatenate(made)
            names, blobs = by_bucket(np.ascontiguousarray(rows["shingle"]).view(np.uint64) % np.uint64(buckets), rows)
            n, fp, bitmap = zip(*nodes.values()) if nodes else ((), (), ())
            none = [None] * len(nodes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*names, *(-1 - x % buckets for x in nodes)], pa.int64()), pa.array([*blobs, *none], pa.binary())]
                + [pa.array([*[None] * len(blobs), *x], t) for x, t in zip((nodes, n, fp, bitmap), (pa.int64(), pa.int32(), pa.int64(), pa.binary()))],
                names=["bucket", "blob", "node", "n", "fp", "bitmap"],
            )

    def shared(g: pd.DataFrame) -> pd.DataFrame:
        if g.blob.iloc[0] is None:
            return g.drop_duplicates("node")[["node", "n", "fp", "bitmap"]].assign(**dict.fromkeys(("s", "shingle", "at", "hub", "hub_n", "hub_s", "hub_at")))
        x = np.frombuffer(b"".join(g.blob), POSTING)
        own = (x["n"] - x["s"]) / x["n"]
        x = x[np.lexsort((x["node"], own, x["shingle"]))]
        new = np.ones(len(x), bool)
        new[1:] = (x["shingle"][1:] != x["shingle"][:-1]) | (x["node"][1:] != x["node"][:-1])  # exact copies are one node
        x = x[new]
        _, starts, n = np.unique(x["shingle"], return_index=True, return_counts=True)
        keep, hub = np.repeat(n > 1, n), x[np.repeat(starts, n)]
        x, hub = x[keep], hub[keep]
        return pd.DataFrame({**{c: x[c] for c in ("node", "n", "s", "shingle", "at")}, "hub": hub["node"], **{f"hub_{c}": hub[c] for c in ("n", "s", "at")}}).assign(fp=None, bitmap=None)

    packed = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, blob binary, node long, n int, fp long, bitmap binary")
    found = runtime.stage(packed.groupBy("bucket").applyInPandas(shared, "node long, n int, fp long, bitmap binary, s int, shingle long, at int, hub long, hub_n int, hub_s int, hub_at int"), "copy-candidates")
    return found.filter("bitmap is null").drop("fp", "bitmap"), found.filter("bitmap is not null").select("node", "n", "fp", "bitmap")


def possible(x: str, y: str) -> Column:
    """Whether sets that share a shingle at these places may share enough; x, y: prefixes of the columns n, s and at.

    They share at most the lesser s, and what only one may have, n - s, is in the union besides the other set.
    """
    c = lambda p, name: F.col(f"{p}{name}")
    most = F.least(c(x, "at"), c(y, "at")) + F.least(c(x, "s") - c(x, "at"), c(y, "s") - c(y, "at"))
    union = c(x, "n") + c(y, "n") - F.least(c(x, "s"), c(y, "s"))
    return (9 * most >= 4 * (c(x, "n") + c(y, "n"))) & (5 * F.least(c(x, "s"), c(y, "s")) >= 4 * union)


def tree_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): nodes with one fingerprint, and nodes whose fingerprints the trees link, each by its smallest node."""
    least = runtime.stage(nodes.groupBy("fp").agg(F.min("node").alias("b"), F.count("*").alias("n")), "copy-fingerprints")
    same = nodes.join(least.filter("n > 1").select("fp", "b"), "fp").filter("node <> b").select(F.col("node").alias("a"), "b")
    links = runtime.stage(shard_links(least, RADIUS, least.count()), "copy-fp-links")
    one, two = least.select(F.col("fp").alias("a"), F.col("b").alias("x")), least.select(F.col("fp").alias("b"), F.col("b").alias("y"))
    return same.union(links.join(one, "a").join(two, "b").select(F.greatest("x", "y"), F.least("x", "y")))


def similar(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, text_col: str) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runtime.slices(batches, rows=8192):
            n = b.column(2).to_numpy() + b.column(3).to_numpy()
            keep = [9 * differing(x, y) <= s for s, x, y in zip(n, b.column(4).to_pylist(), b.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = runtime.stage(pairs.distinct(), "copy-pairs")
    one, two = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bitmap").alias(f"bitmap_{c}")) for c in "ab")
    rated = pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "bitmap_a", "bitmap_b")
    pairs = runtime.stage(rated.mapInArrow(likely, "a long, b long"), "copy-likely")
    wanted = runtime.stage(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "copy-wanted")
    # Texts stay where they are: those that the filter passes give their sets, and false ones go in the join.
    shipped = docs.sparkSession.sparkContext.broadcast(bloom.build(wanted, "node"))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies within a task give one set, as far as a bounded memory tells
        for b in runtime.slices(batches):
            words = [words_of(t) for t in b.column(0).to_pylist()]
            node = np.array([node_of(w) for w in words], np.uint64).view(np.int64)
            has = {}
            for i in np.flatnonzero(bloom.contains(shipped.value, node)):
                if (k := int(node[i])) not in seen:
                    has[k] = shingles(words[i]).tobytes()
                    if len(seen) < 200_000:
                        seen.add(k)
            yield pa.RecordBatch.from_arrays([pa.array(has.keys(), pa.int64()), pa.array(has.values(), pa.binary())], names=["node", "has"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runtime.slices(batches):
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(9 * both >= 4 * (len(x) + len(y)))  # 5 * both >= 4 * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(sets_of, "node long, has binary")
    sets = runtime.stage(sets.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("has").alias("has")), "copy-sets")
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("has").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("has").alias("y")), "b")
    return runtime.stage(joined.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "copy-links")


def rooted(links: DataFrame) -> DataFrame:
    """(node, root) of every end of links, the roots included."""
    found = runtime.stage(components(links).withColumnRenamed("fp", "node"), "copy-roots")
    return found.union(found.select("root", "root")).distinct()


def across(found: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): nodes under one shingle and different roots that places, sizes and bitmaps allow to be similar.

    Pairs are compared in numpy, and only those that pass become rows. A shingle of over BLOCK nodes is dealt in pairs
    of blocks.
    """
    rows = runtime.stage(found.join(roots, "node", "left").select("shingle", "node", "n", "s", "at", F.coalesce("root", "node").alias("root")), "copy-rooted")
    mixed_ = rows.groupBy("shingle").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("shingle", "size")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    pairs_of = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least(i, own).alias("i"), F.greatest(i, own).alias("j")))
    dealt = rows.join(mixed_, "shingle").withColumn("blocks", blocks).withColumn("p", F.explode(pairs_of)).join(nodes.select("node", "bitmap"), "node")
    place = F.when(F.col("blocks") > 1, F.col("shingle")).otherwise(F.pmod("shingle", F.lit(runtime.count_partitions(found.sparkSession) * 8)))

    def within(g: pd.DataFrame) -> pd.DataFrame:
        out = [np.empty((0, 2), np.int64)]
        for _, own in g.groupby("shingle"):
            if own.root.nunique() > 1:
                out += alike(own, bool(own.i.iloc[0] != own.j.iloc[0]))
        pairs = np.unique(np.concatenate(out), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    columns = ["shingle", "node", "n", "s", "at", "root", "bitmap", own.alias("block"), "p.i", "p.j"]
    return dealt.select(place.alias("place"), *columns).groupBy("place", "i", "j").applyInPandas(within, "a long, b long")


def alike(g: pd.DataFrame, other_block: bool) -> Iterator[np.ndarray]:
    """Rows (a, b), a > b, of one shingle's nodes that may be similar; with other_block only from different blocks."""
    order = np.argsort(g.n.to_numpy(), kind="stable")
    node, n, s, at, root, block = (g[c].to_numpy()[order].astype(np.int64) for c in ("node", "n", "s", "at", "root", "block"))
    maps = g.bitmap.to_numpy()[order]
    size = np.array([len(m) for m in maps])
    reach = np.searchsorted(n, n * 5 // 4, "right")  # a set over 5/4 of the size shares too little
    folded: dict[int, dict[int, np.ndarray]] = {}

    def words(k: int, to: int) -> np.ndarray:
        known = folded.setdefault(to, {})
        if k not in known:
            known[k] = np.bitwise_xor.reduce(np.frombuffer(maps[k], np.uint8).reshape(-1, to), axis=0).view(np.uint64)
        return known[k]

    for i in range(len(n)):
        j = np.arange(i + 1, reach[i])
        least, both = np.minimum(s[i], s[j]), n[i] + n[j]
        most = np.minimum(at[i], at[j]) + np.minimum(s[i] - at[i], s[j] - at[j])
        j = j[(root[i] != root[j]) & (9 * most >= 4 * both) & (5 * least >= 4 * (both - least)) & ((block[i] != block[j]) | (not other_block))]
        if not len(j):
            continue
        if not i % 1024:
            folded.clear()  # what is left behind isn't needed again
        to = int(size[i])
        for k in range(0, len(j), max(1, (1 << 22) // to)):
            some = j[k : k + max(1, (1 << 22) // to)]
            apart = np.bitwise_count(np.stack([words(x, to) for x in some]) ^ words(i, to)).sum(1, dtype=np.int64)
            near = some[9 * apart <= n[i] + n[some]]
            if len(near):
                yield np.stack([np.maximum(node[i], node[near]), np.minimum(node[i], node[near])], 1)


def linked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(node, root) of all nodes with a near copy; root is the smallest node linked to them."""
    found, nodes = postings(docs, text_col)
    roots = docs.sparkSession.createDataFrame([], "node long, root long")
    if found.isEmpty():
        return roots
    by_prefix = found.filter("node != hub").filter(possible("", "hub_")).select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b"))
    first = similar(docs, nodes, tree_pairs(nodes).union(by_prefix), text_col)
    if not first.isEmpty():
        roots = rooted(first)
    more = similar(docs, nodes, across(found, roots, nodes), text_col)
    if more.isEmpty():
        return roots
    return rooted(first.union(more))


def drop_near_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with one row of each component of near copies.

    Rows that no copy can have, by a Bloom filter over the nodes with copies, pass by without a shuffle.
    """
    runtime.ship(docs.sparkSession)
    node, root, n, may = (free_name(docs, c) for c in ("__node", "__root", "__n", "__may"))
    near = linked(docs, text_col)
    at, names = docs.columns.index(text_col), docs.columns

    def nodes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runtime.slices(batches):
            yield pa.RecordBatch.from_arrays([as_long([node_of(words_of(t)) for t in b.column(0).to_pylist()])], names=["node"])

    own = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(nodes_of, "node long")
    copied = runtime.stage(own.groupBy("node").count().filter("count > 1").select("node"), "copied-nodes")
    groups = runtime.stage(copied.join(near, "node", "full").select("node", F.coalesce("root", "node").alias("root")), "copy-groups")
    shipped = docs.sparkSession.sparkContext.broadcast(bloom.build(groups, "node"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runtime.slices(batches):
            own = np.array([node_of(words_of(t)) for t in b.column(at).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own), pa.array(bloom.contains(shipped.value, own))], names=[*names, node, may])

    known = docs.mapInArrow(mark, T.StructType([*docs.schema.fields, T.StructField(node, T.LongType()), T.StructField(may, T.BooleanType())]))
    named = groups.select(F.col("node").alias(node), F.col("root").alias(root))
    held = known.filter(F.col(may)).join(named, node, "left")
    order = Window.partitionBy(root).orderBy(F.col(id_col).asc_nulls_last(), node, text_col, F.to_json(F.struct(*names)))
    one = held.filter(F.col(root).isNotNull()).withColumn(n, F.row_number().over(order)).filter(F.col(n) == 1)
    return known.filter(~F.col(may)).select(*names).union(held.filter(F.col(root).isNull()).select(*names)).union(one.select(*names))
