"""A change feed applied to a tree: creates, deletes with all below, unknown parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathlens.functions import text
from pathlens.operators.staging import settled

#: Bits of kernel event masks.
CREATE, MOVED_TO, DELETE, MOVED_FROM, IS_DIR = 0x100, 0x80, 0x200, 0x40, 0x40000000


def classified(events: DataFrame, mask: str = "mask") -> DataFrame:
    """op and is_dir from kernel event masks; a rename is a delete of the old and a create of the new name."""
    m = F.col(mask)
    op = F.when((m.bitwiseAND(CREATE | MOVED_TO)) != 0, "create").when((m.bitwiseAND(DELETE | MOVED_FROM)) != 0, "delete")
    moved_in = m.bitwiseAND(MOVED_TO | IS_DIR) == (MOVED_TO | IS_DIR)
    return events.withColumns({"op": op, "is_dir": m.bitwiseAND(IS_DIR) != 0, "moved_in": moved_in}).filter("op is not null")


#: The events that one folder's listing may add, as a shift of seq.
LISTING_BITS = 24


def with_listings(events: DataFrame, listings: DataFrame) -> DataFrame:
    """events (seq, op, path, is_dir, moved_in) with creates for what folders held when they moved in.

    listings (seq, path, is_dir) has what a walk found below the folder that came with event seq. Kernels tell of
    the folder alone, so its contents follow it here, parents first, before the next event: seq is shifted by
    LISTING_BITS, which keeps the order of events. A folder moved in that has no listing counts as empty.
    """
    base = F.shiftleft(F.col("seq").cast("long"), LISTING_BITS)
    own = events.select(base.alias("seq"), "op", "path", "is_dir")
    moved = events.filter("moved_in and op = 'create'").select(F.col("seq").alias("its"), F.col("path").alias("top"))
    inside = listings.join(moved, (F.col("seq") == F.col("its")) & F.startswith("path", F.concat("top", F.lit("/"))))
    rank = F.row_number().over(Window.partitionBy("seq").orderBy(F.size(F.split("path", "/")), "path"))
    fits = F.when(rank < (1 << LISTING_BITS), rank).otherwise(F.raise_error(F.lit("a listing of more entries than one event can hold")))
    return own.union(inside.select((base + fits).alias("seq"), F.lit("create"), "path", "is_dir"))


class Applied:
    """What a feed left: ``alive`` (path, is_dir, since) and ``dropped`` creates (seq, path)."""

    def __init__(self, alive: DataFrame, dropped: DataFrame):
        self.alive, self.dropped = alive, dropped


def apply(events: DataFrame, base: DataFrame | None = None, root: str = "/") -> Applied:
    """events (seq, op, path, is_dir), seq a total order, over a base (path, is_dir) of live entries.

    Levels go from the root down. At each one a create counts only while its folder is alive, a folder's death
    ends all it holds, and what lives is a set of intervals per path; recreating a folder revives nothing below.
    Creates of living paths change nothing, so events that come twice do no harm.
    """
    events = events.select(F.col("seq").cast("long").alias("seq"), "op", "path", "is_dir")
    if base is not None:
        events = events.union(base.filter(F.col("path") != root).select(F.lit(-1).cast("long"), F.lit("create"), "path", "is_dir"))
    depth = F.size(F.filter(F.split("path", "/"), lambda x: x != ""))
    events = settled(events.withColumn("depth", depth).filter(F.col("path") != root))
    spark = events.sparkSession
    start = len([p for p in root.split("/") if p])
    deepest = events.agg(F.max("depth")).first()[0] or start
    above = spark.createDataFrame([(root, True, -2, None)], "path string, is_dir boolean, since long, until long")
    lives, drops = above.limit(0), events.select("seq", "path").limit(0)
    by_path = Window.partitionBy("path").orderBy("seq", "rank")
    later = by_path.rowsBetween(1, Window.unboundedFollowing)
    for level in range(start + 1, deepest + 1):
        own = events.filter(F.col("depth") == level).withColumn("folder", text.parent_dir("path"))
        folders = above.filter("is_dir").select(F.col("path").alias("folder"), F.col("since").alias("f_since"), F.col("until").alias("f_until"))
        # seq -1 is the base: it stands before any event, its folders too
        creates = own.filter("op = 'create'")
        alive_then = (F.col("f_since") < F.col("seq")) | ((F.col("f_since") <= F.col("seq")) & (F.col("seq") == -1))
        placed = creates.join(folders, "folder").filter(alive_then & (F.col("f_until").isNull() | (F.col("f_until") > F.col("seq"))))
        drops = drops.union(creates.join(placed.select("seq", "path"), ["seq", "path"], "left_anti").select("seq", "path"))
        known = placed.select("path", "folder").distinct()
        deaths = known.join(folders.filter("f_until is not null"), "folder").select("path", F.col("f_until").alias("seq"), F.lit("delete").alias("op"), F.lit(False).alias("is_dir"))
        ops = placed.select("path", "seq", "op", "is_dir").union(own.filter("op = 'delete'").select("path", "seq", "op", "is_dir")).union(deaths).distinct()
        ops = ops.withColumn("rank", F.when(F.col("op") == "delete", 0).otherwise(1))
        marked = ops.withColumns({"before": F.lag("op").over(by_path), "until": F.min(F.when(F.col("op") == "delete", F.col("seq"))).over(later)})
        above = settled(marked.filter("op = 'create' and (before is null or before = 'delete')").select("path", "is_dir", F.col("seq").alias("since"), "until"))
        lives = lives.union(above)
    return Applied(lives.filter("until is null").select("path", "is_dir", "since"), drops)


def without_excluded(events: DataFrame, excluded: DataFrame) -> DataFrame:
    keys = excluded.select(F.col("path").alias("anc")).distinct()
    inside = events.select("seq", F.explode(F.array_append(text.ancestors("path"), F.col("path"))).alias("anc")).join(keys, "anc", "left_semi").select("seq").distinct()
    return events.join(inside, "seq", "left_anti")


def with_paths(events: DataFrame, folders: DataFrame) -> DataFrame:
    """events (parent_ino, parent_path, name) with their path: the folder by inode, else by the path given."""
    by_ino = folders.filter("ino <> 0").select(F.col("ino").alias("parent_ino"), F.col("path").alias("by_ino"))
    up = F.coalesce("by_ino", "parent_path")
    path = F.when(up == "/", F.concat(up, F.col("name"))).otherwise(F.concat(up, F.lit("/"), F.col("name")))
    return events.join(by_ino, "parent_ino", "left").withColumn("path", path).drop("by_ino")


def compacted(entries: DataFrame) -> DataFrame:
    """Live entries only, ids dense in the old order; parents before children as before."""
    # The dense id of a row is its rank: counts per range of ids, then ranks within ranges, so no single task has all.
    live = entries.filter("alive")
    width = 1 << 16
    ranged = live.select("id", F.floor(F.col("id") / width).alias("r"))
    sums = ranged.groupBy("r").agg(F.count("*").alias("n"))
    starts = sums.withColumn("start", F.sum("n").over(Window.orderBy("r")) - F.col("n")).select("r", "start")
    dense = settled(ranged.join(starts, "r").select("id", (F.col("start") + F.row_number().over(Window.partitionBy("r").orderBy("id")) - 1).alias("new_id")))
    parents = dense.select(F.col("id").alias("parent_id"), F.col("new_id").alias("new_parent"))
    out = live.join(dense, "id").join(parents, "parent_id", "left")
    return out.select(F.col("new_id").alias("id"), F.col("new_parent").alias("parent_id"), *[c for c in live.columns if c not in ("id", "parent_id")])


def reconciled(rebuilt: DataFrame, captured: DataFrame, started: int) -> Applied:
    """A rebuilt tree with the events captured since it was begun replayed over it."""
    return apply(captured.filter(F.col("seq") > started), rebuilt)
