"""Searches as one predicate over stored columns, and the presentation of hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlens.functions import text
from pathlens.operators.model import LAUNCHER_BYTES, LAUNCHER_LIMIT, SearchOptions, clamp_limit


def predicate(spark, query: str, options: SearchOptions = SearchOptions()) -> Column | None:
    """What a query asks of an entry; None if it can't match anything.

    A regular expression takes the query whole. Otherwise one word is sought in the name, or in the path if it
    holds a slash or the options say so; several words must all occur in the path.
    """
    if not query:
        return None
    if options.regex:
        made = text.checked_regex(spark, query, options.match_case)
        match = F.rlike(F.col("path" if options.in_path or "/" in query else "name"), F.lit(made))
    else:
        terms = text.bounded_terms(text.split_terms(query))
        if not terms:
            return None
        in_path = options.in_path or len(terms) > 1 or "/" in terms[0]
        column = ("path" if in_path else "name") + ("" if options.match_case else "_fold")
        needles = terms if options.match_case else [text.fold_text(t) for t in terms]
        match = reduce(lambda a, b: a & b, [F.contains(F.col(column), F.lit(n)) for n in dict.fromkeys(needles)])
    match = match & F.col("alive")
    if options.kind != "all":
        match = match & (F.col("is_dir") == (options.kind == "folders"))
    return match & ~F.col("hidden") if options.hide_hidden else match


def hits(entries: DataFrame, query: str, options: SearchOptions = SearchOptions()) -> DataFrame:
    """All entries that match, in no order."""
    p = predicate(entries.sparkSession, query, options)
    return entries.limit(0) if p is None else entries.filter(p)


def hits_raw(entries: DataFrame, needle: bytes, in_path: bool = False, match_case: bool = False) -> DataFrame:
    """Live entries whose name or path holds these bytes, for names that are not UTF-8 (path_raw holds those).

    Bytes are compared as they are; without match_case ASCII letters are folded.
    """
    whole = F.coalesce("path_raw", F.encode("path", "utf-8")) if "path_raw" in entries.columns else F.encode("path", "utf-8")
    shown = F.decode(whole, "ISO-8859-1")  # a character a byte
    shown = shown if in_path or b"/" in needle else text.base_name(shown)
    wanted = needle.decode("latin-1")
    if not match_case:
        upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
        shown, wanted = F.translate(shown, upper, lower), wanted.translate(str.maketrans(upper, lower))
    return entries.filter(F.contains(shown, F.lit(wanted)) & F.col("alive")) if needle else entries.limit(0)


def search(entries: DataFrame, query: str, options: SearchOptions = SearchOptions(), limit: int | None = None) -> DataFrame:
    """One page: hits in the order of parts and ids. The limit is the caller's, up to the hard cap."""
    return page(hits(entries, query, options), clamp_limit(limit))


def page(found: DataFrame, limit: int) -> DataFrame:
    return found.orderBy("part_ord", "id").limit(limit)


def page_with_notice(found: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """A page and whether there is more: one row beyond the limit is asked for."""
    return page(found, limit), page(found, limit + 1).count() > limit


def ranked(entries: DataFrame, query: str, limit: int = LAUNCHER_LIMIT, unicode: bool = False) -> DataFrame:
    """Launcher results: the first hits, by relevance, then path. Queries under three bytes give none."""
    found = search(entries, query, limit=limit) if len(query.encode()) >= LAUNCHER_BYTES else entries.limit(0)
    scored = found.withColumn("relevance", text.relevance("name", query, unicode))
    return scored.withColumn("type", text.result_type("relevance")).orderBy(F.desc("relevance"), "path")


def with_stat(found: DataFrame, stat: DataFrame) -> DataFrame:
    """Hits with size and mtime of stat (path, size_bytes, mtime): -1 and unknown where there is none or for folders."""
    joined = found.drop("size_bytes", "mtime").join(stat.select("path", "size_bytes", "mtime"), "path", "left")
    plain = F.when(F.col("is_dir"), None)
    return joined.withColumns({"sort_size": F.coalesce(plain.otherwise(F.col("size_bytes")), F.lit(-1).cast("long")), "sort_mtime": F.coalesce(plain.otherwise(F.unix_timestamp("mtime")), F.lit(-1).cast("long"))})


ORDERS = {"name": ("name_fold", "path"), "path": ("path_fold", "path"), "size": ("sort_size", "path"), "mtime": ("sort_mtime", "path")}


def sorted_by(found: DataFrame, column: str, descending: bool = False, limit: int | None = None) -> DataFrame:
    key, tie = ORDERS[column]
    out = found.orderBy(F.desc(key) if descending else F.asc(key), tie)
    return out if limit is None else out.limit(limit)


def presented(found: DataFrame) -> DataFrame:
    """Columns for people: name, parent, size, modified, icon class, the path on one line and as URI."""
    return found.select(
        "id",
        text.one_line(text.base_name("path")).alias("shown_name"),
        text.one_line(text.parent_dir("path")).alias("parent"),
        F.when(F.col("is_dir"), F.lit("")).otherwise(text.format_size("size_bytes")).alias("size"),
        text.format_time("mtime").alias("modified"),
        text.icon("path").alias("icon"),
        text.file_uri("path").alias("uri"),
    )
