"""Integrity rules: each returns rows of issues or of what breaks a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import paths


def version_gaps(versions: DataFrame) -> DataFrame:
    """(object_id, first, last): ranges of versions missing between 1 and the head; told by neighbours, so that a head of any size makes no rows."""
    own = versions.select("object_id", F.col("vnum").cast("long").alias("vnum")).where("vnum > 0").distinct()
    before = F.coalesce(F.lag("vnum").over(Window.partitionBy("object_id").orderBy("vnum")), F.lit(0))
    ranges = own.select("object_id", (before + 1).alias("first"), (F.col("vnum") - 1).alias("last"))
    return ranges.where(F.col("first") <= F.col("last"))


def mixed_padding(versions: DataFrame) -> DataFrame:
    """Objects whose versions (object_id, vpad) are padded in more than one way."""
    return versions.groupBy("object_id").agg(F.countDistinct("vpad").alias("paddings")).where("paddings > 1")


def path_conflicts(files: DataFrame) -> DataFrame:
    """Paths that are a directory of another path of the same object; by an equi-join on exploded prefixes."""
    above = files.select("object_id", F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    return files.select("object_id", "path").distinct().join(above, ["object_id", "path"], "left_semi")


def referential(manifest: DataFrame, state: DataFrame) -> DataFrame:
    """Digests in only one of manifest and state, compared exactly: E050 (state only) and E107 (manifest only)."""
    m, s = (x.select("object_id", "digest").distinct().withColumn(n, F.lit(True)) for x, n in ((manifest, "m"), (state, "s")))
    both = m.join(s, ["object_id", "digest"], "full_outer")
    return both.withColumn("code", F.when(F.col("m").isNull(), "E050").when(F.col("s").isNull(), "E107")).where("code is not null").select("object_id", "digest", "code")


def duplicate_digests(manifest: DataFrame) -> DataFrame:
    """Digests that differ in case alone (E096)."""
    return manifest.groupBy("object_id", F.lower("digest").alias("digest")).agg(F.countDistinct("digest").alias("forms")).where("forms > 1")


def files_against_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """E023 (file not in the manifest), E092 (path without file), E093 (another digest)."""
    a = files.select("object_id", "path", F.lower("digest").alias("actual"))
    b = manifest.select("object_id", "path", F.lower("digest").alias("expected"))
    code = F.when(F.col("expected").isNull(), "E023").when(F.col("actual").isNull(), "E092").when(F.col("actual") != F.col("expected"), "E093")
    return a.join(b, ["object_id", "path"], "full_outer").withColumn("code", code).where("code is not null").select("object_id", "path", "code")


def state_mismatch(a: DataFrame, b: DataFrame) -> DataFrame:
    """E066: paths of a version whose digest differs between two inventories, or that only one has."""
    x, y = a.withColumnRenamed("digest", "x"), b.withColumnRenamed("digest", "y")
    return x.join(y, ["object_id", "vnum", "path"], "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select("object_id", "vnum", "path", F.lit("E066").alias("code"))


def metadata_drift(versions: DataFrame, others: DataFrame) -> DataFrame:
    """W011: message, user name or user address that differs between two inventories' versions, as raw strings."""
    fields = ("message", "user_name", "user_address")
    joined = versions.alias("a").join(others.alias("b"), ["object_id", "vnum"])
    issue = F.explode(F.array_compact(F.array(*(F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), f) for f in fields)))).alias("field")
    return joined.select("object_id", "vnum", issue, F.lit("W011").alias("code"))


def visible_content(manifest: DataFrame, versions: DataFrame) -> DataFrame:
    """(object_id, vnum, n_paths): content paths that each version can see, by a running sum instead of a range join."""
    added = manifest.groupBy("object_id", F.col("content_vnum").alias("vnum")).agg(F.count("*").alias("added"))
    order = Window.partitionBy("object_id").orderBy("vnum")
    joined = versions.select("object_id", "vnum").join(added, ["object_id", "vnum"], "left")
    return joined.select("object_id", "vnum", F.coalesce(F.sum("added").over(order), F.lit(0)).cast("long").alias("n_paths"))


def content_groups(files: DataFrame) -> DataFrame:
    """One row for each digest of an object: its first path, its copies, and the bytes that keeping one saves."""
    return files.groupBy("object_id", "digest").agg(F.min("path").alias("content_path"), F.count("*").alias("copies"), (F.sum("size") - F.max("size")).alias("saved_bytes"))
