"""Version states from operation logs: as of a version, at the head, between two versions, and as file histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spans(ops: DataFrame) -> DataFrame:
    """Versions from `vnum` to before `until` (null: still) in which a path holds a digest. One shuffle by object and path."""
    order = Window.partitionBy("object_id", "path").orderBy("vnum")
    return ops.withColumn("until", F.lead("vnum").over(order)).where(~F.col("removed")).select("object_id", "path", "digest", "vnum", "until")


def heads(ops: DataFrame) -> DataFrame:
    return ops.groupBy("object_id").agg(F.max("vnum").alias("head"))


def version_state(ops: DataFrame) -> DataFrame:
    """(object_id, vnum, path, digest) of every version; grows with versions times files, use spans() where that is too much."""
    s = spans(ops).join(heads(ops), "object_id")
    last = F.coalesce(F.col("until") - 1, F.col("head"))
    return s.select("object_id", F.explode(F.sequence("vnum", last)).alias("vnum"), "path", "digest")


def state_as_of(ops: DataFrame, version: Column | None = None) -> DataFrame:
    """State at a version (a column over object_id and head); none: the head."""
    s = spans(ops)
    if version is None:
        return s.where(F.col("until").isNull()).select("object_id", "path", "digest")
    s = s.join(heads(ops), "object_id").withColumn("__at", version)
    return s.where((F.col("vnum") <= F.col("__at")) & (F.col("until").isNull() | (F.col("until") > F.col("__at")))).select("object_id", "path", "digest")


def file_changes(ops: DataFrame) -> DataFrame:
    """UPDATE where a path's digest differs from the last seen or it is back, REMOVE where it goes; one shuffle."""
    order = Window.partitionBy("object_id", "path").orderBy("vnum")
    before = F.lag(F.when(~F.col("removed"), F.col("digest"))).over(order)
    change = F.when(~F.col("removed") & (before.isNull() | (before != F.col("digest"))), "UPDATE").when(F.col("removed") & before.isNotNull(), "REMOVE")
    gone_before = F.coalesce(F.max(F.col("removed").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    out = ops.withColumns({"change": change, "back": gone_before & before.isNull() & ~F.col("removed")})
    return out.where("change is not null").select("object_id", "path", "vnum", "change", F.when(F.col("change") == "UPDATE", F.col("digest")).alias("digest"), "back")


def state_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """ADDED, REMOVED or MODIFIED paths between two states (object_id, path, digest)."""
    a, b = left.withColumnRenamed("digest", "old_digest"), right.withColumnRenamed("digest", "new_digest")
    status = F.when(F.col("old_digest").isNull(), "ADDED").when(F.col("new_digest").isNull(), "REMOVED").when(F.col("old_digest") != F.col("new_digest"), "MODIFIED")
    return a.join(b, ["object_id", "path"], "full_outer").withColumn("status", status).where("status is not null")


def manifest(ops: DataFrame) -> DataFrame:
    """Where each digest of an object was first stored: (object_id, digest, content_vnum, content_path)."""
    first = F.min(F.struct("vnum", "path"))
    puts = ops.where(~F.col("removed")).groupBy("object_id", "digest").agg(first.alias("f"))
    return puts.select("object_id", "digest", F.col("f.vnum").alias("content_vnum"), F.concat_ws("/", F.concat(F.lit("v"), F.col("f.vnum").cast("string")), F.lit("content"), F.col("f.path")).alias("content_path"))


def file_details(state: DataFrame, manifest: DataFrame, root: Column) -> DataFrame:
    """(object_id, path, digest, storage_path, missing): where each file of a state lies; digests are matched in any case, one that the manifest lacks has no path."""
    m = manifest.groupBy("object_id", F.lower("digest").alias("__digest")).agg(F.min("content_path").alias("content_path"))
    joined = state.withColumn("__digest", F.lower("digest")).join(m, ["object_id", "__digest"], "left")
    path = F.when(F.col("content_path").isNotNull(), F.concat_ws("/", root, "content_path"))
    return joined.select("object_id", "path", "digest", path.alias("storage_path"), F.col("content_path").isNull().alias("missing"))
