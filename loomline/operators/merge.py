"""File and log merges of two copies with a common base, and the guards that stop a harmful one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def three_way(host: DataFrame, stick: DataFrame, base: DataFrame, key: str = "path") -> DataFrame:
    """(path, action) from equality of the three hashes; each input has path and hash."""
    parts = [df.select(key, F.col("hash").alias(name)) for df, name in ((host, "h"), (stick, "s"), (base, "b"))]
    j = reduce(lambda x, y: x.join(y, key, "full_outer"), parts)
    h, s, b = F.col("h"), F.col("s"), F.col("b")
    action = (
        F.when(h.eqNullSafe(s), F.lit("same"))
        .when(h.eqNullSafe(b), F.when(s.isNull(), F.lit("delete_host")).otherwise(F.lit("to_host")))
        .when(s.eqNullSafe(b), F.when(h.isNull(), F.lit("delete_stick")).otherwise(F.lit("to_stick")))
        .otherwise(F.lit("conflict"))
    )
    return j.select(key, "h", "s", "b", action.alias("action"))


def resolve(path: Column, h: Column, s: Column, host: Column, stick: Column) -> Column:
    """Conflict rule: an edit beats a deletion, logs are united, else version, then time, then hash decide."""
    order = lambda x: F.struct(x["version"], x["mtime"], x["hash"])
    return F.when(h.isNull(), F.lit("stick")).when(s.isNull(), F.lit("host")).when(path.endswith(".jsonl"), F.lit("union")).when(order(host) >= order(stick), F.lit("host")).otherwise(F.lit("stick"))


def union_logs(stick: DataFrame, host: DataFrame, id_col: str = "id", line_col: str = "line", pos_col: str = "pos") -> DataFrame:
    """The stick's lines, then those only the host has; lines without id are known by their hash."""
    key = F.coalesce(F.col(id_col).cast("string"), F.sha2(F.col(line_col), 256))
    both = stick.withColumn("side", F.lit(0)).unionByName(host.withColumn("side", F.lit(1))).withColumn("key", key)
    first = Window.partitionBy("key").orderBy("side", pos_col)
    return both.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r", "key")


def index_diff(disk: DataFrame, index: DataFrame, key: str = "path") -> DataFrame:
    """Added, changed (size or time), deleted or unchanged entries of a file index."""
    d = disk.select(key, F.struct("size", "mtime").alias("d"))
    i = index.select(key, F.struct("size", "mtime").alias("i"))
    status = F.when(F.col("i").isNull(), "added").when(F.col("d").isNull(), "deleted").when(F.col("d") != F.col("i"), "changed").otherwise("unchanged")
    return d.join(i, key, "full_outer").select(key, status.alias("status"))


def vanished_groups(index: DataFrame, disk: DataFrame, group: str, least: int = 1000) -> DataFrame:
    """Top-level groups of at least ``least`` entries of which nothing is left: a sign that a disk is not mounted."""
    return index.groupBy(group).agg(F.count("*").alias("entries")).where(F.col("entries") >= least).join(disk.select(group).distinct(), group, "left_anti")


def mass_delete(plan: DataFrame, share: float = 0.25, least: int = 8) -> DataFrame:
    """(total, deletions, blocked): whether a plan deletes too much."""
    deleted = F.sum(F.col("action").startswith("delete").cast("int"))
    counts = plan.agg(F.count("*").alias("total"), F.coalesce(deleted, F.lit(0)).alias("deletions"))
    return counts.withColumn("blocked", (F.col("total") >= least) & (F.col("deletions") / F.col("total") > share))


def verify_manifest(manifest: DataFrame, disk: DataFrame, key: str = "path") -> DataFrame:
    """missing, malformed, hash or ok for each manifest entry."""
    d = disk.select(key, F.col("hash").alias("disk_hash"))
    state = F.when(~F.coalesce(F.col("hash"), F.lit("")).rlike("^[0-9a-f]{64}$"), "malformed").when(F.col("disk_hash").isNull(), "missing").when(F.col("hash") != F.col("disk_hash"), "hash").otherwise("ok")
    return manifest.join(d, key, "left").select(key, state.alias("state"), (F.col("version") + (state == "hash").cast("int")).alias("version"))


def repaired(manifest: DataFrame, disk: DataFrame, key: str = "path") -> DataFrame:
    """The manifest as the disk is: entries without a file go, hashes are those of the files, a version goes up only where
    the hash changed; files without an entry start at version 1."""
    d = disk.select(key, F.col("hash").alias("disk_hash"))
    j = manifest.select(key, F.col("hash").alias("old_hash"), "version").join(d, key, "full_outer").where("disk_hash is not null")
    version = F.when(F.col("version").isNull(), F.lit(1)).otherwise(F.col("version") + (~F.col("old_hash").eqNullSafe(F.col("disk_hash"))).cast("int"))
    return j.select(key, F.col("disk_hash").alias("hash"), version.alias("version"))


def tenants(*sides: DataFrame) -> DataFrame:
    """Every tenant that any side names."""
    return reduce(DataFrame.union, [s.select("agent_id") for s in sides]).where("agent_id is not null").distinct()
