"""New versions as transforms of states; nothing is written here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["object_id", "path"]


def put(state: DataFrame, files: DataFrame) -> DataFrame:
    """The new version holds the given files alone, for the objects that have some; other objects keep their state."""
    return state.join(files.select("object_id").distinct(), "object_id", "left_anti").unionByName(files)


def write(state: DataFrame, files: DataFrame) -> DataFrame:
    """State with the files added or replaced."""
    return state.join(files.select(*KEY), KEY, "left_anti").unionByName(files)


def overwrites(state: DataFrame, files: DataFrame) -> DataFrame:
    """Paths that a write without leave to overwrite must refuse."""
    return files.select(*KEY).join(state.select(*KEY), KEY, "left_semi")


def remove(state: DataFrame, paths: DataFrame) -> DataFrame:
    return state.join(paths.select(*KEY), KEY, "left_anti")


def rename(state: DataFrame, moves: DataFrame) -> DataFrame:
    """moves: (object_id, path, to). A target that exists is replaced; a source that doesn't exist has no effect here, see missing()."""
    moved = state.join(moves, KEY).select("object_id", F.col("to").alias("path"), "digest")
    gone = moved.select(*KEY).union(moves.select(*KEY))
    return state.join(gone, KEY, "left_anti").unionByName(moved)


def missing(state: DataFrame, moves: DataFrame) -> DataFrame:
    return moves.select(*KEY).join(state.select(*KEY), KEY, "left_anti")


def reinstate(state: DataFrame, older: DataFrame, moves: DataFrame) -> DataFrame:
    """Files of an older state put back under a path: moves (object_id, path, to)."""
    return write(state, older.join(moves, KEY).select("object_id", F.col("to").alias("path"), "digest"))


def replicate(version_state: DataFrame, at: DataFrame) -> DataFrame:
    """A new head whose state is that of version `at` (object_id, at, head)."""
    rows = version_state.join(at, "object_id").where(F.col("vnum") == F.col("at"))
    return rows.select("object_id", (F.col("head") + 1).alias("vnum"), "path", "digest")


def rollback(version_state: DataFrame, at: DataFrame) -> DataFrame:
    return version_state.join(at.select("object_id", "at"), "object_id").where(F.col("vnum") <= F.col("at")).drop("at")


def commit_mutable_head(manifest: DataFrame) -> DataFrame:
    """Content paths of the mutable head become those of the version that is committed; the flag falls."""
    prefix = "extensions/0005-mutable-head/head/content/"
    path = F.when(F.col("mutable"), F.concat(F.lit("v"), F.col("head").cast("string"), F.lit("/content/"), F.substr("content_path", F.lit(len(prefix) + 1)))).otherwise(F.col("content_path"))
    return manifest.select("object_id", "digest", path.alias("content_path"))
