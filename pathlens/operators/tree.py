"""Paths, depths and inherited attributes from parent links; subtrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlens.functions import text
from pathlens.operators.staging import settled

MAX_DOUBLINGS = 16  # 2**16 levels


def _joined(up, name):
    return F.when(F.endswith(up, F.lit("/")), F.concat(up, name)).otherwise(F.concat(up, F.lit("/"), name))


def with_paths(entries: DataFrame) -> DataFrame:
    """entries (id, parent_id, name, is_dir, ...) with path, depth, hidden.

    Only folders can be parents, so they are resolved first, by pointer doubling: after k joins every folder knows
    its ancestor 2**k levels up and the names between. All entries then take one join with their folder.
    A link to a missing parent, or to one that is no folder, or a loop is an error, for files as for folders. A
    root's name is a path and never counts as hidden.
    """
    key = [c for c in ("part",) if c in entries.columns]
    root = F.col("parent_id").isNull()
    now = entries.filter("is_dir").select(*key, "id", F.col("parent_id").alias("up"), F.col("name").alias("tail"), root.alias("whole"), F.when(root, 0).otherwise(1).alias("depth"), (~root & F.startswith("name", F.lit("."))).alias("hidden"))
    for _ in range(MAX_DOUBLINGS):
        now = settled(now)
        if now.filter("up is not null").isEmpty():
            break
        above = now.select(*key, F.col("id").alias("up"), F.col("up").alias("_up"), F.col("tail").alias("_tail"), F.col("depth").alias("_depth"), F.col("hidden").alias("_hidden"))
        now = now.join(above, [*key, "up"], "left").select(
            *key,
            "id",
            F.when(F.col("up").isNotNull() & F.col("_tail").isNull(), F.raise_error(F.concat(F.lit("no folder with id "), F.col("up").cast("string")))).otherwise(F.col("_up")).alias("up"),
            F.when(F.col("up").isNull(), F.col("tail")).otherwise(_joined(F.col("_tail"), F.col("tail"))).alias("tail"),
            (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
            (F.col("hidden") | F.coalesce("_hidden", F.lit(False))).alias("hidden"),
        )
    else:
        raise ValueError("parent links form a loop")
    folders = now.select(*key, F.col("id").alias("parent_id"), F.col("tail").alias("_path"), F.col("depth").alias("_depth"), F.col("hidden").alias("_hidden"))
    kept = entries.drop("path", "depth", "hidden")
    up = F.when(F.col("_path").isNull(), F.raise_error(F.concat(F.lit("no folder with id "), F.col("parent_id").cast("string")))).otherwise(F.col("_path"))
    return kept.join(folders, [*key, "parent_id"], "left").select(
        *kept.columns,
        F.when(root, F.when(F.col("name") == "", "/").otherwise(F.col("name"))).otherwise(_joined(up, F.col("name"))).alias("path"),
        F.when(root, 0).otherwise(F.col("_depth") + 1).alias("depth"),
        F.when(root, F.lit(False)).otherwise(F.col("_hidden") | F.startswith("name", F.lit("."))).alias("hidden"),
    )


def with_paths_sql(spark: SparkSession, view: str, levels: int = 150) -> DataFrame:
    """The same by a recursive query, for inputs below spark.sql.cteRecursionRowLimit."""
    return spark.sql(f"""
        WITH RECURSIVE t MAX RECURSION LEVEL {levels} AS (
          SELECT id, name AS path, 0 AS depth, false AS hidden FROM {view} WHERE parent_id IS NULL
          UNION ALL
          SELECT e.id, CASE WHEN endswith(t.path, '/') THEN concat(t.path, e.name) ELSE concat(t.path, '/', e.name) END, t.depth + 1, t.hidden OR startswith(e.name, '.')
          FROM {view} e JOIN t ON e.parent_id = t.id)
        SELECT * FROM t""")


def hidden_below(path, root: str = "/") -> Column:
    """Whether a dot name stands in path below root; a root's own dots hide nothing."""
    p = F.col(path) if isinstance(path, str) else path
    return F.contains(F.substr(p, F.lit(1 if root == "/" else len(root) + 1)), F.lit("/."))


def derived(entries: DataFrame, part_ord: int = 0, root: str = "/") -> DataFrame:
    """Adds what searches need and scans should not compute: folded names and paths, the parent's path, hidden.

    Folded columns are stored, so that a search's contains() reaches the Parquet scan. root is the tree's root, for
    entries that don't say what is hidden.
    """
    have = set(entries.columns)
    out = entries.withColumns({"name_fold": text.fold("name"), "path_fold": text.fold("path"), "parent_path": text.parent_dir("path")})
    if "alive" not in have:
        out = out.withColumn("alive", F.lit(True))
    if "hidden" not in have:
        out = out.withColumn("hidden", hidden_below("path", root))
    if "part_ord" not in have:
        out = out.withColumn("part_ord", F.lit(part_ord))
    return out


def restored(entries: DataFrame, part_ord: int = 0, root: str = "/") -> DataFrame:
    """Stored entries with whatever a snapshot left out: paths from parent links, and the columns of searches."""
    have = set(entries.columns)
    whole = entries if "path" in have else with_paths(entries)
    folded = {"name_fold", "path_fold", "parent_path", "alive", "hidden", "part_ord"}
    return whole if folded <= set(whole.columns) else derived(whole, part_ord, root)


def below(entries: DataFrame, folders: DataFrame, strict: bool = True) -> DataFrame:
    """Entries below any of folders.path: ancestor prefixes meet in a hash join instead of comparing all pairs."""
    up = text.ancestors("path")
    if not strict:
        up = F.array_append(up, F.col("path"))
    keys = folders.select(F.col("path").alias("anc")).distinct()
    return entries.withColumn("anc", F.explode(up)).join(keys, "anc", "left_semi").drop("anc").dropDuplicates(["path"])


def without_excluded(entries: DataFrame, excluded: DataFrame) -> DataFrame:
    """Folders equal to an excluded path go, with what is below them, whether or not the folders have rows themselves.

    Only distinct folders are taken apart into their ancestors, not every entry.
    """
    keys = excluded.select(F.col("path").alias("anc")).distinct()
    folders = entries.select(text.parent_dir("path").alias("gone")).union(entries.filter("is_dir").select("path")).distinct()
    gone = folders.withColumn("anc", F.explode(F.array_append(text.ancestors("gone"), F.col("gone")))).join(keys, "anc", "left_semi").select("gone").distinct()
    kept = entries.join(gone, F.col("is_dir") & (F.col("path") == F.col("gone")), "left_anti")
    return kept.join(gone, text.parent_dir("path") == F.col("gone"), "left_anti")


def resolve(entries: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, id) of the live entry at each path."""
    return paths.select("path").join(entries.filter("alive").select("path", "id"), "path", "left")


def children(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (parent_id, name) with the id of the live child, null if there is none."""
    return wanted.join(entries.filter("alive").select("parent_id", "name", "id"), ["parent_id", "name"], "left")
