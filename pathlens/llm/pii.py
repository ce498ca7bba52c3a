"""Personal data by patterns, and terms that disclose it by corpus co-occurrence.

Four kinds of personal data are found by pattern: these base spans always stay. The information-theoretic part
treats each distinct value as a protected entity c and the words of the documents that print it as terms t. With
N rows, df(c), df(t) and co(c, t) rows that hold them (whole texts, wherever the words stand):

    IC(c) = log2(N / df(c))        PMI(c; t) = log2(N * co / (df(c) * df(t)))

A term discloses an entity when it gives ``share`` of the entity's information content and ``bits`` bits at
least, the evidence that a chance meeting wouldn't give. An entity printed once is so judged by its own rarity: a
term in few enough other documents gives it away. An entity in so many rows that its content is under ``bits``
bits is public. Copies add no evidence, as they raise both sides alike and lower the content. Every mention of a
disclosing term outside base spans, in any document of its entity, becomes a span of kind ``term``. Sanitising
replaces base spans by their kind, and terms by ``[NAME]`` when capitalised (generalised), else removes them.

Null text counts as empty; empty and null texts, empty tables and tables of under 2 ** ``bits`` rows have no terms.
Spans depend on a row's text alone (joined by its XXH64; offsets come from the row's own text), so repeated ids,
null ids and repeated rows need no rule. Very long texts are read whole. Ties can't occur: each term passes or
fails by itself. Extra columns of any name pass by.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathlens.llm import bloom, runtime
from pathlens.llm.simhash_vptree import free_name

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match starts where its run of digits does, and every part takes the whole of its run.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")
BITS, SHARE = 10.0, 0.9
#: A term in over this share of the rows with entities is common: there are few of those, and they stay out of joins.
COMMON = 0.001


def emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, (end := m.end())
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) by start, then kind; code points, end exclusive."""
    found = [(s, e, 0) for s, e in emails(text)]
    found += [(*m.span(), 1) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            found.append((*m.span(), 2))
    found += [(*m.span(), 3) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=lambda x: (x[0], x[2]))


def _hash(value: str) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(value.encode("utf-8", "replace"))).astype(np.int64))


def entity_of(text: str, span: tuple[int, int, int]) -> int:
    s, e, kind = span
    return _hash(f"{KINDS[kind]}:{text[s:e].lower() if kind == 0 else re.sub(r'[^0-9.]', '', text[s:e])}")


def words_outside(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(folded word, start, end) of the words that touch no base span."""
    starts = [s for s, _, _ in spans]
    reach = list(accumulate((e for _, e, _ in spans), max))  # spans may overlap: the furthest end so far
    for m in TERM.finditer(text):
        k = bisect_left(starts, m.end())
        if not k or reach[k - 1] <= m.start():
            yield m[0].lower(), m.start(), m.end()


def text_key(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string"))


def find(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: doc_id, text_key, base (start, end, kind number, three in a row); where there are base spans also
    entities and terms (distinct hashes) and places (the terms' mentions, three 32-bit integers each: term, start, end)."""
    runtime.ship(docs.sparkSession)
    longs = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("base", longs), ("entities", longs), ("terms", longs), ("places", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runtime.slices(batches):
            base, entities, terms, places = [], [], [], []
            for t in b.column(1).to_pylist():
                spans = base_spans(t or "")
                base.append([x for y in spans for x in y])
                entities.append(list({entity_of(t, s) for s in spans}))
                at: dict[str, int] = {}
                own = [(at.setdefault(w, len(at)), s, e) for w, s, e in words_outside(t, spans)] if spans else []
                terms.append([_hash(w) for w in at])
                places.append(np.array(own, "<i4").tobytes())
            cols = [b.column(0), b.column(2), *(pa.array(c, longs) for c in (base, entities, terms)), pa.array(places, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), text_key(text_col).alias("text_key"))
    return rows.mapInArrow(run, "doc_id long, text_key long, base array<long>, entities array<long>, terms array<long>, places binary")


def document_frequency(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df) over all of docs for the terms given.

    A Bloom filter of bounded size goes to every task and drops words that are no candidates before the shuffle;
    the join with terms removes its false positives.
    """
    spark = docs.sparkSession
    runtime.ship(spark)
    shipped = spark.sparkContext.broadcast(bloom.build(terms, "term"))  # of a bounded size, whatever the corpus

    seen: dict[str, int | None] = {}

    def keys_of(words: set[str]) -> list[int]:
        new = [w for w in words if w not in seen]
        if new:
            if len(seen) > 250_000:
                seen.clear()
                new = list(words)
            h = np.array([_hash(w) for w in new], np.int64)
            ok = bloom.contains(shipped.value, h)
            seen.update((w, int(x) if k else None) for w, x, k in zip(new, h, ok))
        return [h for w in words if (h := seen[w]) is not None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of a whole task, so that a frequent term costs a row per task and not one per document."""
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], names=["term", "n"])
            counts.clear()
            return made

        for b in runtime.slices(batches, rows=1024):
            for t in b.column(0).to_pylist():
                if t:
                    counts.update(keys_of(set(map(str.lower, TERM.findall(t)))))
            if len(counts) > 250_000:
                yield out()
        yield out()

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))
    return counted.join(terms, "term", "left_semi")


def disclosing(docs: DataFrame, found: DataFrame, text_col: str = "text", share: float = SHARE, bits: float = BITS) -> DataFrame:
    """text_key, terms: the hashes of each text's words that disclose one of its entities.

    co >= 1 in a text that holds both, so its rarest entity settles most terms by df(t) alone; only what several
    documents of an entity share is counted in pairs. A term's df is at least that among rows with entities, and co
    at most df(c), which keeps frequent words out before anything is joined.
    """
    spark = docs.sparkSession
    none = spark.createDataFrame([], "text_key long, terms array<long>")
    total = float(docs.count())
    held = found.filter(F.size("entities") > 0)
    entities = held.select("text_key", F.explode("entities").alias("entity"))
    df_entity = runtime.stage(entities.groupBy("entity").agg(F.count("*").alias("df_entity")), "pii-entities")
    most = total / 2.0**bits
    protected = F.col("df_entity") <= most
    rows, each, widest = held.count(), df_entity.count(), df_entity.filter(protected).agg(F.max("df_entity")).first()[0]
    if not rows or not each or widest is None:
        return none
    # Each of these is in over N / 2 ** bits rows, so there are at most 2 ** bits times the mean entities of a row.
    public = F.broadcast(df_entity.filter(~protected).select("entity"))
    own = entities.join(public, "entity", "left_anti").distinct().join(df_entity, "entity")
    own = runtime.stage(own, "pii-owned")
    alone = F.least(F.pow(F.lit(total) / F.col("df_entity"), F.lit(1 - share)), F.lit(most) / F.col("df_entity"))
    shared = F.least(F.pow(F.col("df_entity"), F.lit(share)) * total ** (1 - share), F.lit(most))
    limits = runtime.stage(own.groupBy("text_key").agg(F.max(alone).alias("alone"), F.max(shared).alias("shared")), "pii-limits")
    top = min(widest**share * total ** (1 - share), most)

    words = held.select("text_key", F.explode("terms").alias("term"))
    near = runtime.stage(words.groupBy("term").agg(F.count("*").alias("near")), "pii-near")
    # At most 1 / COMMON times the mean words of a row.
    common = F.broadcast(near.filter(F.col("near") > max(top, COMMON * rows)).select("term"))
    rare = near.filter(F.col("near") <= top).select("term", "near")
    met = words.join(common, "term", "left_anti").join(rare, "term").distinct()
    met = runtime.stage(met.join(limits, "text_key").filter("near <= shared").select("text_key", "term", "alone", "shared"), "pii-met")
    if met.isEmpty():
        return none
    df = runtime.stage(document_frequency(docs, met.select("term").distinct(), text_col).filter(F.col("df") <= top), "pii-df")
    rated = runtime.stage(met.join(df, "term").filter("df <= shared"), "pii-rated")
    direct = rated.filter("df <= alone").select("text_key", "term")
    open_ = rated.filter("df > alone").select("term").distinct()
    several = own.filter("df_entity > 1").select("text_key", "entity", "df_entity")
    copies = held.groupBy("text_key").agg(F.count("*").alias("rows"))
    pairs = rated.join(open_, "term", "left_semi").select("text_key", "term", "df").join(several, "text_key")
    counted = pairs.join(copies, "text_key").groupBy("entity", "term", "df", "df_entity").agg(F.sum("rows").alias("co"))
    p = F.col("co") / F.col("df")
    tells = (p >= F.pow(F.col("df_entity") / F.lit(total), F.lit(1 - share))) & (F.col("co") * total >= F.col("df") * F.col("df_entity") * 2.0**bits)
    rules = runtime.stage(counted.filter(tells).select("entity", "term"), "pii-rules")
    indirect = pairs.select("text_key", "entity", "term").join(rules, ["entity", "term"], "left_semi").select("text_key", "term")
    return direct.union(indirect).groupBy("text_key").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def analyse(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", share: float = SHARE, bits: float = BITS) -> DataFrame:
    """Per row: doc_id, base (start, end, kind number in a row), terms (start, end in a row) that disclose."""
    found = runtime.stage(find(docs, text_col, id_col), "pii-found")
    telling = runtime.stage(disclosing(docs, found, text_col, share, bits), "pii-telling").select(F.col("text_key").alias("key"), F.col("terms").alias("tell"))
    empty = F.array().cast("array<long>")
    schema = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(pa.int64())), ("terms", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runtime.slices(batches):
            out = []
            for terms, raw, tell in zip(b.column(2), b.column(3), b.column(4)):
                hit = np.isin(terms.values.to_numpy(), tell.values.to_numpy())
                own = np.frombuffer(raw.as_py(), "<i4").reshape(-1, 3)
                out.append(own[hit[own[:, 0]], 1:].astype(np.int64).ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, schema.types[2])], schema=schema)

    held = found.filter(F.size("entities") > 0).join(telling, F.col("text_key") == F.col("key"), "left")
    marked = held.filter("tell is not null").select("doc_id", "base", "terms", "places", "tell").mapInArrow(run, "doc_id long, base array<long>, terms array<long>")
    plain = held.filter("tell is null").select("doc_id", "base", empty.alias("terms")).union(found.filter(F.size("entities") == 0).select("doc_id", "base", empty.alias("terms")))
    return marked.union(plain)


def digest(found: DataFrame) -> DataFrame:
    """analyse() as counts, a hash of the base spans and all spans as text."""
    at = lambda col, n: F.transform(F.sequence(F.lit(0), (F.size(col) / n).cast("int") - 1), lambda k: k * n)
    names = F.array(*map(F.lit, KINDS))
    line = lambda kind, s, e: F.concat_ws(":", kind, s.cast("string"), e.cast("string"))
    base = F.when(F.size("base") > 0, F.transform(at("base", 3), lambda k: F.struct(F.get("base", k).alias("s"), F.get("base", k + 2).alias("k"), line(F.get(names, F.get("base", k + 2).cast("int")), F.get("base", k), F.get("base", k + 1)).alias("t")))).otherwise(F.array())
    term = F.when(F.size("terms") > 0, F.transform(at("terms", 2), lambda k: F.struct(F.get("terms", k).alias("s"), F.lit(9).cast("long").alias("k"), line(F.lit("term"), F.get("terms", k), F.get("terms", k + 1)).alias("t")))).otherwise(F.array())
    kinds = F.transform(at("base", 3), lambda k: F.get("base", k + 2))
    n = lambda i: F.when(F.size("base") > 0, F.size(F.filter(kinds, lambda x: x == i))).otherwise(0).cast("long")
    rows = found.withColumns({"b": base, "t": term})
    return rows.select(
        "doc_id",
        *(n(i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(F.concat_ws(",", F.transform("b", lambda x: x["t"])).cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform(F.array_sort(F.concat("b", "t")), lambda x: x["t"])).alias("spans"),
    )


def cleaned(text: str, base: list[tuple[int, int, int]], terms: list[tuple[int, int]]) -> str:
    """Spans that overlap are replaced together under the first one's name."""
    out, end = [], 0
    for s, e, name in sorted([(s, e, f"[{KINDS[k].upper()}]") for s, e, k in base] + [(s, e, "[NAME]" if text[s : s + 1].isupper() else "") for s, e in terms]):
        if s >= end:
            out += [text[end:s], name]
        end = max(end, e)
    return "".join([*out, text[end:]])


def sanitise(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length_col: str | None = "n_chars", share: float = SHARE, bits: float = BITS) -> DataFrame:
    """docs with spans replaced in text_col, and length_col (if there) set to the new length in code points.

    Only rows with base spans are joined with their terms; the others pass by as they are.
    """
    found = runtime.stage(find(docs, text_col, id_col), "pii-found")
    key, tell, has = (free_name(docs, c) for c in ("__key", "__tell", "__has"))
    telling = runtime.stage(disclosing(docs, found, text_col, share, bits), "pii-telling").select(F.col("text_key").alias(key), F.col("terms").alias(tell))
    names = docs.columns
    at = names.index(text_col)
    n_at = names.index(length_col) if length_col in names else None

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runtime.slices(batches):
            flags = pa.array([bool(t) and bool(base_spans(t)) for t in b.column(at).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns, flags], names=[*names, has])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runtime.slices(batches):
            out = []
            for t, own in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist()):
                spans, own = base_spans(t), set(own or ())
                out.append(cleaned(t, spans, [(s, e) for w, s, e in words_outside(t, spans) if _hash(w) in own] if own else []))
            cols = b.columns[: len(names)]
            cols[at] = pa.array(out, pa.string())
            if n_at is not None:
                cols[n_at] = pa.array([len(t) for t in out], cols[n_at].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    flagged = docs.mapInArrow(mark, T.StructType([*docs.schema.fields, T.StructField(has, T.BooleanType())]))
    rows = flagged.filter(F.col(has)).drop(has)
    held = rows.join(telling, F.xxhash64(rows[text_col].cast("string")) == F.col(key), "left").select(*(rows[c] for c in names), tell)
    return held.mapInArrow(run, docs.schema).union(flagged.filter(~F.col(has)).drop(has))
