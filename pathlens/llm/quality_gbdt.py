"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from whole texts (words, character classes, repeats, lines and the worst window of 50 words).
Trees are grown in numpy on histograms of binned statistics from a bounded sample of labelled rows
(``max_rows``), then flattened into arrays of feature, threshold and child that a batch of rows walks together.

Null text counts as empty and gets a score as any other; very long texts count whole. Without labelled rows of both
classes the score is the share of ones (0.5 if there are none). Repeated rows score alike. In training an id counts
once, with the smallest of its texts, so ``max_rows`` bounds what comes to the driver; of equally good splits the
first statistic's lowest cut is taken. An empty table gives an empty one; extra columns pass by.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathlens.llm import runtime

NAMES = (
    "log_chars log_words word_len word_len_sd max_word_len alpha digit upper space ascii_punct symbol bang pipe non_ascii char_entropy "
    "symbol_words bang_words upper_words pipe_words odd_words distinct_words adjacent_equal top_word log_lines line_len dup_lines ended_lines "
    "w_symbol w_bang w_upper w_pipe w_adjacent w_distinct run_share short_words"
).split()
WINDOW = 50
UPPER, ALPHA, DIGIT = slice(65, 91), [*range(65, 91), *range(97, 123)], slice(48, 58)
SYMBOLS = np.frombuffer(b"#$%&*+/<=>@\\^_`{|}~", np.uint8)
PUNCT = np.array([c for c in range(33, 127) if not chr(c).isalnum()])
_KIND = np.zeros(256, np.uint8)
_KIND[SYMBOLS] = 1
_KIND[33] = 2
_KIND[65:91] = 4
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _worst(flags: np.ndarray) -> float:
    """The largest share of set flags in any window of WINDOW words."""
    n = len(flags)
    if n <= WINDOW:
        return float(flags.mean()) if n else 0.0
    total = np.concatenate(([0], np.cumsum(flags)))
    return float((total[WINDOW:] - total[:-WINDOW]).max() / WINDOW)


def statistics(text: str | None) -> list[float]:
    """One number for each of NAMES."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return [float(np.log1p(len(raw)))] + [0.0] * (len(NAMES) - 1)
    buf = np.frombuffer(raw, np.uint8)
    count = np.bincount(buf, minlength=256)
    size = len(buf)
    share = count / size
    letters = count[ALPHA].sum() + count[128:].sum()
    p = share[share > 0]
    gap = _SPACE[buf]
    starts = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    ends = np.flatnonzero(~gap & np.concatenate((gap[1:], [True]))) + 1
    lens = ends - starts
    kind = _KIND[buf]
    per = lambda bit: np.diff(np.concatenate(([0], np.cumsum(kind == bit)))[np.stack([starts, ends], 1)], axis=1)[:, 0]
    n_symbol, n_bang, n_upper = per(1), per(2), per(4)
    symbol_w, bang_w = n_symbol >= 2, n_bang >= 2
    upper_w = (n_upper >= 2) & (n_upper * 2 > lens)
    pipe_w = (lens == 1) & (buf[starts] == 124)
    same = np.fromiter(map(eq, words, words[1:]), bool, n - 1) if n > 1 else np.zeros(0, bool)
    w_same = _worst(same)
    if n > 2 * WINDOW:
        w_distinct = min(len(set(words[i : i + WINDOW])) for i in range(0, n - WINDOW + 1, WINDOW // 2)) / WINDOW
    else:
        w_distinct = len(set(words)) / n
    edges = np.flatnonzero(np.concatenate(([True], ~same, [True])))
    run = np.diff(edges).max() if n > 1 else 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ended = sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"') for x in lines)
    freq = Counter(words)
    return [
        float(np.log1p(size)), float(np.log1p(n)), float(lens.mean()), float(lens.std()), float(np.log1p(lens.max())), letters / size, share[DIGIT].sum(),
        count[UPPER].sum() / max(1, letters), gap.mean(), share[PUNCT].sum(), share[SYMBOLS].sum(), share[33], share[124], count[128:].sum() / size, float(-(p * np.log2(p)).sum()),
        symbol_w.mean(), bang_w.mean(), upper_w.mean(), pipe_w.mean(), float(np.mean(lens > 24)), len(freq) / n, same.mean() if n > 1 else 0.0, max(freq.values()) / n,
        float(np.log1p(len(lines))), size / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), ended / max(1, len(lines)),
        _worst(symbol_w), _worst(bang_w), _worst(upper_w), _worst(pipe_w), w_same, w_distinct, run / n, float(np.mean(lens <= 2)),
    ]


@dataclass
class Forest:
    """Trees as flat arrays: node -> feature (-1: leaf), threshold, left child; the right one follows it."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go = x[rows, np.maximum(f, 0)] > self.threshold[at]
                at = np.where(inner, self.left[at] + go, at)
            total += self.value[at]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 5, rate: float = 0.1, bins: int = 48, l2: float = 2.0, least: int = 8) -> Forest:
    """Newton boosting on the logistic loss with histograms of bins."""
    mean = float(y.mean()) if len(y) else 0.5
    base = float(np.log((mean + 1e-3) / (1 - mean + 1e-3)))
    empty = Forest(base, np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, int), np.zeros(0), 0)
    if len(y) < 2 or mean in (0.0, 1.0):
        return empty
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(d)], 1)
    flat = binned + np.arange(d) * bins
    raw = np.full(n, base)
    feature, threshold, left, value, roots = [], [], [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        roots.append(len(feature))
        todo = [(len(feature), np.arange(n), 0)]
        for a in (feature, threshold, left, value):
            a.append(0)
        while todo:
            node, rows, level = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            feature[node], threshold[node], left[node], value[node] = -1, 0.0, 0, -rate * gs / (hs + l2)
            if level < depth and len(rows) >= 2 * least:
                key = flat[rows].ravel()
                rep = lambda v: np.bincount(key, np.repeat(v[rows], d), d * bins).reshape(d, bins).cumsum(1)[:, :-1]  # noqa: B023, E731
                gl, hl = rep(g), rep(h)
                nl = np.bincount(key, minlength=d * bins).reshape(d, bins).cumsum(1)[:, :-1]
                gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                gain[(nl < least) | (len(rows) - nl < least)] = -1
                j, b = divmod(int(gain.argmax()), bins - 1)
                if gain[j, b] > 1e-6 and b < len(cuts[j]):
                    right = binned[rows, j] > b
                    feature[node], threshold[node], left[node] = j, float(cuts[j][b]), len(feature)
                    for a in (feature, threshold, left, value):
                        a += [0, 0]
                    todo += [(left[node], rows[~right], level + 1), (left[node] + 1, rows[right], level + 1)]
                    continue
            raw[rows] += value[node]
    return Forest(base, np.array(roots), np.array(feature), np.array(threshold), np.array(left), np.array(value), depth + 1)


def held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def sample_labels(labels: DataFrame, column: str, max_rows: int) -> DataFrame:
    """At most max_rows rows (doc_id, y) whose documents aren't held out, in the order of a hash of doc_id.

    A document with several labels counts with the largest; null ids and labels other than 0 and 1 don't count.
    """
    clean = labels.select("doc_id", F.col(column).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("doc_id"))
    return clean.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", max_rows: int = 20_000) -> Forest:
    """Fits on at most max_rows labelled documents: a bounded sample, whose statistics go to the driver."""
    spark = docs.sparkSession
    runtime.ship(spark)
    picked = runtime.stage(sample_labels(labels, column, max_rows), "label-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runtime.slices(batches):
            x = [np.array(statistics(t), np.float32).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary())], names=["y", "x"])

    # max_rows rows of 12 bytes: a bounded side.
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = texts.select("y", "text").mapInArrow(run, "y int, x binary").toPandas()
    if rows.empty:
        return fit(np.zeros((0, len(NAMES))), np.zeros(0))
    x = np.frombuffer(b"".join(rows.x), np.float32).reshape(len(rows), -1).astype(float)
    order = np.lexsort((*x.T, rows.y.to_numpy()))  # the same forest whatever order the rows come in
    return fit(x[order], rows.y.to_numpy(float)[order])


def score(docs: DataFrame, forest: Forest, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with out_col added (replaced, if there): how likely label 1 is, from 0 to 1."""
    runtime.ship(docs.sparkSession)
    kept = [c for c in docs.columns if c != out_col]
    src, at = docs.select(*kept), kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runtime.slices(batches):
            x = np.array([statistics(t) for t in b.column(at).to_pylist()], np.float32).astype(float)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(forest.score(x), pa.float64())], names=[*kept, out_col])

    return src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField(out_col, T.DoubleType())]))
