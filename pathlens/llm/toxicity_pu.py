"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents (P) and unlabelled ones (U, any document) train a logistic model on the presence of
words and word beginnings. The risk is the class-prior-corrected one, prior * R_P(+) + max(0, R_U(-) - prior *
R_P(-)); where the second part turns negative its gradient is reversed. P and U are bounded samples (``max_p``,
``max_u``) in the order of a hash of the id; candidate features come from P, their choice from P against U.

Null text counts as empty and gets the score of a document without features; very long texts count whole. Without
positives every score is the prior. Rows that repeat score alike. In training an id counts once in P and once in U,
with the smallest of its texts, so ``max_p`` and ``max_u`` bound what comes to the driver; ties between features go
to the smaller key. An empty table gives an empty one; extra columns pass by.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathlens.llm import runtime
from pathlens.llm.quality_gbdt import held_out, sample_labels

MAX_P, MAX_U, CANDIDATES, FEATURES = 3000, 9000, 1 << 15, 4096
WORD = re.compile(r"[^\W_]+")
PREFIXES = (3, 4, 5, 6)
KNOWN_WORDS = 400_000


def keys_of(word: str) -> list[int]:
    """64-bit keys of a lower-cased word and of its beginnings."""
    from xxhash import xxh64_intdigest

    names = [f"w:{word[:64]}"] + [f"p:{word[:k]}" for k in PREFIXES if len(word) >= k]
    return [int(np.uint64(xxh64_intdigest(x)).astype(np.int64)) for x in names]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def sketches(text: str | None) -> tuple[int, int]:
    """Two min-hashes of the shingles of five words: copies and near copies nearly always share one."""
    from xxhash import xxh64_intdigest

    words = (text or "").lower().split()
    shingles = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    return tuple(int(np.uint64(min(xxh64_intdigest(s, seed) for s in shingles)).astype(np.int64)) for seed in (1, 2))


def without_copies(rows) -> list[int]:
    """Positions of rows (a, b sketches) that share no sketch with an earlier one: a passage copied thousands of
    times is one piece of evidence."""
    seen_a, seen_b, kept = set(), set(), []
    for i, (a, b) in enumerate(rows):
        if a not in seen_a and b not in seen_b:
            kept.append(i)
        seen_a.add(a)
        seen_b.add(b)
    return kept


class Lookup:
    """Words to the positions of their known keys; a worker remembers what it has looked up, within a bound."""

    def __init__(self, keys: np.ndarray):
        self.at = {int(k): i for i, k in enumerate(keys)}
        self.seen: dict[str, tuple] = {}

    def features(self, text: str | None) -> list[int]:
        out: set[int] = set()
        seen = self.seen
        for w in words_of(text):
            f = seen.get(w)
            if f is None:
                f = tuple(self.at[k] for k in keys_of(w) if k in self.at)
                if len(seen) < KNOWN_WORDS:
                    seen[w] = f
            if f:
                out.update(f)
        return sorted(out)


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, feature_lists: list[list[int]]) -> np.ndarray:
        raw = np.array([self.bias + self.weights[f].sum() if f else self.bias for f in feature_lists])
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def _sum(values: np.ndarray, indptr: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values)))
    return total[indptr[1:]] - total[indptr[:-1]]


def packed(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    indptr = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    return (np.concatenate(rows).astype(int) if indptr[-1] else np.zeros(0, int)), indptr


def risks(w: np.ndarray, p: tuple, u: tuple, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The two parts of the risk, prior * R_P(+) and R_U(-) - prior * R_P(-), and their gradients; w ends with the bias."""

    def push(idx: np.ndarray, indptr: np.ndarray, per_row: np.ndarray) -> np.ndarray:
        g = np.bincount(idx, np.repeat(per_row, np.diff(indptr)), len(w))
        g[-1] += per_row.sum()
        return g / len(per_row)

    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    fp, fu = _sum(w[p[0]], p[1]) + w[-1], _sum(w[u[0]], u[1]) + w[-1]
    rest = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    return prior * np.logaddexp(0, -fp).mean(), rest, prior * push(*p, -sigmoid(-fp)), push(*u, sigmoid(fu)) - prior * push(*p, sigmoid(fp))


def fit(p: list[np.ndarray], u: list[np.ndarray], n_features: int, prior: float, steps: int = 500, rate: float = 0.05, l2: float = 2e-5, slack: float = 0.02) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk with the logistic loss (Adam on all rows).

    Below -slack * prior the corrected negative risk counts as overfitted, and its gradient is reversed.
    """
    w, m, v = (np.zeros(n_features + 1) for _ in range(3))
    w[-1] = np.log(prior / (1 - prior))
    p, u = packed(p), packed(u)
    for t in range(1, steps + 1):
        _, rest, g_p, g_rest = risks(w, p, u, prior)
        g = g_p + g_rest if rest >= -slack * prior else -g_rest
        g[:-1] += l2 * w[:-1]
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def choose(p: list[np.ndarray], u: list[np.ndarray], n: int, prior: float, purity: float = 0.6, least_z: float = 5.0, most: int = FEATURES) -> np.ndarray:
    """Features whose documents are mostly positive, as P, U and the prior have it; the most frequent in P first.

    prior * P(feature | P) / P(feature) estimates the share of positives among a feature's documents.
    """
    n_p, n_u = len(p), len(u)
    c_p, c_u = (np.bincount(np.concatenate(x).astype(int), minlength=n) if x else np.zeros(n) for x in (p, u))
    a, b = c_p / n_p, (c_u + 0.5) / (n_u + 1)
    z = (a - b) / np.sqrt(b * (1 - b) / n_p + b * (1 - b) / n_u + 1e-12)
    good = np.flatnonzero((z >= least_z) & (c_p >= max(4, 0.004 * n_p)) & (prior * a >= purity * b))
    return good[np.argsort(-c_p[good], kind="stable")][:most]


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", max_p: int = MAX_P, max_u: int = MAX_U) -> Model:
    spark = docs.sparkSession
    runtime.ship(spark)
    known = labels.select("doc_id", column).filter(F.col(column).isNotNull())
    share = known.filter(F.col(column).isin(0, 1) & ~held_out("doc_id")).agg(F.avg(F.col(column).cast("double"))).first()[0]
    prior = float(np.clip(0.1 if share is None else share, 1e-3, 0.9))
    p_ids = sample_labels(known.filter(F.col(column) == 1), column, max_p).select("doc_id", F.lit(True).alias("p"))
    u_ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter(F.col("doc_id").isNotNull() & ~held_out("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_u).select("doc_id", F.lit(False).alias("p"))
    picked = runtime.stage(p_ids.union(u_ids), "pu-sample")  # max_p + max_u rows: a bounded side
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "p").agg(F.min("text").alias("text"))
    texts = runtime.stage(texts.select("p", "text"), "pu-texts")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runtime.slices(batches, rows=128):
            keys = [k for t in b.column(0).to_pylist() for k in {k for w in words_of(t) for k in keys_of(w)}]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())], names=["key"])

    counted = texts.filter("p").select("text").mapInArrow(emit, "key long").groupBy("key").count().filter("count >= 3").orderBy(F.desc("count"), "key").limit(CANDIDATES)
    candidates = counted.select("key").toPandas().key.to_numpy(np.int64)
    if not len(candidates):
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
    shipped = spark.sparkContext.broadcast(candidates)

    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(shipped.value)
        for b in runtime.slices(batches):
            known = b.column(1).to_pylist()
            x = [np.array(look.features(t), np.uint16).tobytes() for t in known]
            one, two = zip(*map(sketches, known))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary()), pa.array(one, pa.int64()), pa.array(two, pa.int64())], names=["p", "x", "a", "b"])

    rows = texts.mapInArrow(vectorise, "p boolean, x binary, a long, b long").toPandas()
    rows = rows.sort_values(["p", "a", "b", "x"], kind="stable")  # the same model whatever order the rows come in

    def lone(own) -> list[np.ndarray]:
        return [np.frombuffer(own.x.iloc[i], np.uint16) for i in without_copies(zip(own.a, own.b))]

    p, u = lone(rows[rows.p]), lone(rows[~rows.p])
    if not p or not u:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
    kept = choose(p, u, len(candidates), prior)
    place = np.full(len(candidates), -1)
    place[kept] = np.arange(len(kept))
    p, u = ([(y := place[x])[y >= 0] for x in rows_] for rows_ in (p, u))
    weights, bias = fit(p, u, len(kept), prior)
    return Model(candidates[kept], weights, bias)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with out_col added (replaced, if there): how likely a text is toxic, from 0 to 1."""
    runtime.ship(docs.sparkSession)
    kept = [c for c in docs.columns if c != out_col]
    src, at = docs.select(*kept), kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(model.keys)
        for b in runtime.slices(batches):
            s = model.score([look.features(t) for t in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*kept, out_col])

    return src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField(out_col, T.DoubleType())]))
