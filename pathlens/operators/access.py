"""Who may see what: an entry is visible if its folder can be listed and all folders above can be passed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlens.functions import text


def rules(folders: DataFrame, uid: int, groups: list[int] = ()) -> DataFrame:
    """(dir, can_list, can_pass) for a principal, from folders (path, uid, gid, mode).

    As usual for mode bits: the owner's count for the owner, else the group's for its members, else the others';
    uid 0 may do all. Listing takes reading and passing, passing the execute bit. Folders with a null field are shut.
    """
    member = F.col("gid").isin(*groups) if groups else F.lit(False)
    shift = F.when(F.col("uid") == uid, 6).when(member, 3).otherwise(0)
    bit = lambda n: F.expr(f"(shiftright(mode, _shift) & {n}) <> 0")
    known = F.col("uid").isNotNull() & F.col("gid").isNotNull() & F.col("mode").isNotNull()
    root = F.lit(uid == 0)
    rows = folders.withColumn("_shift", shift)
    can = lambda c: root | (known & F.coalesce(c, F.lit(False)))
    return rows.select(F.col("path").alias("dir"), can(bit(4) & bit(1)).alias("can_list"), can(bit(1)).alias("can_pass"))


def listable_folders(folders: DataFrame, acl: DataFrame, unlisted: str = "deny") -> DataFrame:
    """folders.path that a principal can list, given acl (dir, can_list, can_pass).

    A folder that acl doesn't name, or names with a null, is shut, with all below it; with unlisted="allow" it is
    open. Of several rules for a folder the strictest counts.
    """
    if unlisted not in ("deny", "allow"):
        raise ValueError("unlisted must be deny or allow")
    strict = lambda c: F.min(F.coalesce(F.col(c), F.lit(False))).alias(c)
    known = acl.groupBy(F.col("dir").alias("anc")).agg(strict("can_list"), strict("can_pass"))
    every = folders.select("path").distinct()
    walk = every.withColumn("anc", F.explode(F.array_append(text.ancestors("path"), F.col("path")))).join(known, "anc", "left")
    missing = F.lit(unlisted == "allow")
    passes, lists = F.coalesce("can_pass", missing), F.coalesce("can_list", missing)
    shut = walk.filter(~passes | (~lists & (F.col("anc") == F.col("path")))).select("path").distinct()
    return every.join(shut, "path", "left_anti")


def visible(found: DataFrame, acl: DataFrame, unlisted: str = "deny") -> DataFrame:
    """Hits in folders that can be listed. It filters before any limit, so no page comes up short."""
    parents = found.select(F.col("parent_path").alias("path")).distinct()
    allowed = listable_folders(parents, acl, unlisted).withColumnRenamed("path", "parent_path")
    return found.join(allowed, "parent_path", "left_semi")
