"""Benchmark decontamination with one Aho-Corasick automaton over the words of benchmark items.

Texts are normalised to words, and words to numbers by the benchmark's vocabulary. An item gives its windows of
10 consecutive words; a shorter item is one window. Every window holds whole one of the item's consecutive blocks
of 5 words, so the automaton's patterns are these blocks (a shorter item whole, if it has under 10 words): it has
a node a word and not ten. It reads each document once; where a block occurs, the words on either side are
compared with the item's, and a run of a window's length or more is hit whole, as its windows cover it. Ranges of
word numbers map back to code points of the original text on demand.

The benchmark's word numbers are broadcast and each worker builds the automaton once, some 100 bytes a word.
Items go into one automaton up to ``MOST_WORDS`` words (400 MB); only beyond that the next items go into another
one, which reads the same folded words, so no item is dropped.

Null texts have no words and hit nothing; an item without words has no window. Items with the same text all
count; an item without an id counts for hits, and has no id to be listed or counted. Repeated document rows get
the same result each, very long texts are read whole, an empty table gives an empty one, an empty benchmark hits
nothing. Extra columns are ignored, or kept by ``drop_contaminated``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlens.llm import runtime

#: A-Z become lower case; ASCII other than digits and letters parts words; the rest belongs to words.
FOLD = bytes(ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MOST_WORDS = 4_000_000
_SCANNERS: dict = {}


def folded(text: str | None) -> list[bytes]:
    """The words, in UTF-8: split() on bytes leaves Unicode spaces inside words."""
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


class Items:
    """A benchmark's items as word numbers, in groups of one automaton each; what is broadcast."""

    def __init__(self, rows: Iterator[tuple], width: int, most_words: int = MOST_WORDS):
        self.key, self.width = uuid.uuid4().hex, width
        self.vocabulary: dict[bytes, int] = {}
        self.groups: list[list[tuple]] = []  # (item id, word numbers)
        size = most_words
        for item, text in rows:
            words = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in folded(text)], np.int32)
            if len(words):
                if size + len(words) > most_words:
                    self.groups.append([])
                    size = 0
                size += len(words)
                self.groups[-1].append((item, words))


class Scanner:
    """The automata of Items."""

    def __init__(self, items: Items):
        import ahocorasick

        self.number, self.width = items.vocabulary.get, items.width
        self.items = [x for g in items.groups for x in g]
        self.automata, k = [], 0
        half = max(1, items.width // 2)
        for group in items.groups:
            blocks: dict[tuple, list[tuple[int, int]]] = {}
            for _, words in group:
                own = words.tolist()
                starts = range(0, len(own) - half + 1, half) if len(own) >= items.width else (0,)
                for at in starts:
                    blocks.setdefault(tuple(own[at : at + half] if len(own) >= items.width else own), []).append((k, at))
                k += 1
            a = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for block, owners in blocks.items():
                a.add_word(block, (len(block), owners))
            a.make_automaton()
            self.automata.append(a)

    def runs(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(item's place, from, to) of the runs of word numbers that hold windows of items."""
        number = self.number
        text = tuple([number(w, 0) for w in words])
        for a in self.automata:
            done: dict[tuple[int, int], int] = {}  # (item, shift between text and item) -> end of the run compared
            for end, (size, owners) in a.iter(text):
                first = end - size + 1
                for k, at in owners:
                    if done.get((k, first - at), 0) > end:
                        continue
                    own = self.items[k][1]
                    lo, hi, n = first, end + 1, len(own)
                    shift = first - at
                    while lo > 0 and lo > shift and text[lo - 1] == own[lo - 1 - shift]:
                        lo -= 1
                    while hi < len(text) and hi - shift < n and text[hi] == own[hi - shift]:
                        hi += 1
                    done[k, shift] = hi
                    if hi - lo >= min(n, self.width):
                        yield k, lo, hi


def scanner(shipped) -> Scanner:
    """One per worker and benchmark; the last one is kept."""
    items = shipped.value
    if items.key not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[items.key] = Scanner(items)
    return _SCANNERS[items.key]


def ship_items(benchmark: DataFrame, width: int, most_words: int = MOST_WORDS):
    """Items as a broadcast: the benchmark's size, which the automata are bounded by; its rows pass through the driver one by one."""
    spark = benchmark.sparkSession
    runtime.ship(spark)
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null").orderBy("item_id", "text")
    return spark.sparkContext.broadcast(Items(((r[0], r[1]) for r in rows.toLocalIterator()), width, most_words))


def scan(text: str | None, s: Scanner) -> tuple[int, list[tuple[int, int]], list]:
    """Number of words, merged hit ranges of word numbers [from, to), sorted ids of items with occurring windows."""
    words = folded(text)
    found = list(s.runs(words))
    ids = {s.items[k][0] for k, _, _ in found} - {None}
    return len(words), merged([(lo, hi) for _, lo, hi in found]), sorted(ids)


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of word numbers as code points of text, end exclusive."""
    at = [m.span() for m in WORD.finditer(text.translate({c: chr(c).lower() for c in range(65, 91)}))]
    return [(at[lo][0], at[hi - 1][1]) for lo, hi in ranges]


def hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 10, most_words: int = MOST_WORDS, with_spans: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_words, ranges (word numbers, [from, to) in a row), items; spans (code points) if asked for."""
    shipped = ship_items(benchmark, width, most_words)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("ranges", pa.list_(pa.int64())), ("items", pa.list_(pa.int64())), ("spans", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(shipped)
        for b in runtime.slices(batches):
            texts = b.column(1).to_pylist()
            n_words, ranges, items = zip(*(scan(t, s) for t in texts))
            spans = [[x for y in original_spans(t, r) for x in y] if with_spans and r else [] for t, r in zip(texts, ranges)]
            cols = [b.column(0).to_pylist(), n_words, [[x for p in r for x in p] for r in ranges], items, spans]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return src.mapInArrow(run, "doc_id long, n_words long, ranges array<long>, items array<long>, spans array<long>")


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(r) for r in out]


def summary(found: DataFrame) -> DataFrame:
    """hits() as one digest row per document."""
    n_hit = F.aggregate(F.transform("ranges", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names).cast("binary"), 256).alias("items_sha256"), (F.size("ranges") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", width: int = 10, most_words: int = MOST_WORDS) -> DataFrame:
    """docs without the rows that hold any window, in one pass and without a shuffle."""
    shipped = ship_items(benchmark, width, most_words)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(shipped)
        for b in runtime.slices(batches):
            yield b.filter(pa.array([next(s.runs(folded(t)), None) is None for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
