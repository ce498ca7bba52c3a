"""URL filters as a temporal list join, in DataFrame operations only.

Lists are dated entries (list_id, kind, pattern, action, dated): ``add`` puts a pattern on a list, ``remove`` takes
it off; at the same instant ``remove`` wins. Each (list, kind, pattern) becomes validity intervals, from an add to
the next entry. A capture (url, fetched_at) matches an entry of kind ``host`` if the pattern is its host or a
parent domain, and one of kind ``prefix`` if the pattern is its host and path cut at a slash. Hosts are compared in
lower case, paths as they are.

Both sides meet in an equi-join on (kind, key, time slot). Slots hold equal shares of the captures (quantiles of
their times), so a key with a long history or many captures is dealt over SLOTS tasks, an interval has at most
SLOTS rows however long it lasts, and one odd date makes no slot of its own. Only distinct (url, fetched_at) pairs
are matched, so repeated captures cost one. Spark's own size check decides on broadcasting.

A null url or fetch time matches nothing, nor does a url without scheme and host; empty lists flag nothing, an
empty table gives an empty one; entries with a null field are void; repeated entries count once. Of a very long
url only as many labels and steps as the longest pattern has are compared. Other columns pass by, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathlens.llm.simhash_vptree import free_name

SLOTS = 64


def host_of(url) -> Column:
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(host), r"\.+$", "")


def path_of(url) -> Column:
    return F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")


def normal_pattern(kind, pattern) -> Column:
    """The host part of a pattern in lower case, without dots and slashes at the end."""
    host = F.lower(F.regexp_extract(pattern, "^[^/]*", 0))
    whole = F.when(F.col(kind) == "prefix", F.concat(host, F.regexp_replace(pattern, "^[^/]*", ""))).otherwise(F.lower(pattern))
    return F.regexp_replace(whole, r"[./]+$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """list_id, kind, pattern, valid_from, valid_to (null: still valid)."""
    clean = entries.select("list_id", "kind", normal_pattern("kind", "pattern").alias("pattern"), "action", F.col("dated").cast("timestamp").alias("dated")).dropna()
    one = clean.groupBy("list_id", "kind", "pattern", "dated").agg(F.max("action").alias("action"))  # remove > add
    w = Window.partitionBy("list_id", "kind", "pattern").orderBy("dated")
    return one.withColumn("valid_to", F.lead("dated").over(w)).filter("action = 'add'").select("list_id", "kind", "pattern", F.col("dated").alias("valid_from"), "valid_to")


def slots_of(times: DataFrame, column: str, n: int = SLOTS) -> list:
    """At most n - 1 instants that cut the times into equal shares."""
    cuts = times.agg(F.percentile_approx(column, [k / n for k in range(1, n)], 10 * n)).first()[0]
    return sorted(set(cuts or ()))


def slot(ts, cuts: list) -> Column:
    """How many cuts are at or before ts."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= ts)) if cuts else F.lit(0)


def match(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """Distinct (url, ts) that match, with the sorted array ``matches`` of list:pattern."""
    valid = intervals(entries)
    n_labels, n_steps = valid.agg(F.max(F.when(F.col("kind") == "host", F.size(F.split("pattern", r"\.")))), F.max(F.when(F.col("kind") == "prefix", F.size(F.split("pattern", "/"))))).first()
    rows = captures.select(F.col(url_col).alias("url"), F.col(time_col).cast("timestamp").alias("ts")).dropna()
    cuts = slots_of(rows, "ts")
    parsed = rows.distinct().select("url", "ts", host_of("url").alias("host"), path_of("url").alias("path")).filter("host <> ''")
    labels, steps = F.split("host", r"\."), F.split("path", "/")
    # As long as the longest pattern: longer keys can't match.
    hosts = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(n_labels or 1))), lambda i: F.struct(F.lit("host").alias("kind"), F.array_join(F.slice(labels, -i, i), ".").alias("key")))
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.size(steps), F.lit(n_steps or 1))), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat("host", F.array_join(F.slice(steps, F.lit(1), i), "/")).alias("key")))
    keys = parsed.select("url", "ts", slot(F.col("ts"), cuts).alias("slot"), F.explode(F.array_distinct(F.concat(hosts, prefixes))).alias("k")).select("url", "ts", "slot", "k.kind", "k.key")
    last = F.when(F.col("valid_to").isNull(), F.lit(len(cuts))).otherwise(slot(F.col("valid_to"), cuts))
    span = F.sequence(slot(F.col("valid_from"), cuts), last)
    dated = valid.select("list_id", F.col("kind").alias("its_kind"), "pattern", "valid_from", "valid_to", F.explode(span).alias("its_slot"))
    active = (F.col("ts") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("ts") < F.col("valid_to")))
    hit = keys.join(dated, (F.col("kind") == F.col("its_kind")) & (F.col("key") == F.col("pattern")) & (F.col("slot") == F.col("its_slot")) & active)
    # At most one item per list and pattern that match one url.
    return hit.groupBy("url", "ts").agg(F.array_sort(F.collect_set(F.concat_ws(":", "list_id", "pattern"))).alias("matches"))


def flag(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at", out_col: str = "matches") -> DataFrame:
    """captures with out_col added (replaced, if there): the list entries active when each was fetched."""
    kept = captures.drop(out_col)
    url, ts, matches = (free_name(captures, c) for c in ("__url", "__ts", "__matches"))
    found = match(captures, entries, url_col, time_col).select(F.col("url").alias(url), F.col("ts").alias(ts), F.col("matches").alias(matches))
    joined = kept.join(found, (kept[url_col] == found[url]) & (kept[time_col].cast("timestamp") == found[ts]), "left")
    return joined.select(*[kept[c] for c in kept.columns], F.coalesce(found[matches], F.array().cast("array<string>")).alias(out_col))


def drop_flagged(captures: DataFrame, entries: DataFrame, **kw) -> DataFrame:
    flags = free_name(captures, "__flags")
    return flag(captures, entries, out_col=flags, **kw).filter(F.size(flags) == 0).drop(flags)
