"""Operation logs and snapshots in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def event_ops(events: DataFrame) -> DataFrame:
    """One operation a version: (object_id, vnum, path, removed, digest, created); an object is a user's events in order of time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        F.col("user_id").alias("object_id"), F.row_number().over(order).cast("long").alias("vnum"),
        F.concat(F.lit("f"), (F.col("event_id") % 7).cast("string")).alias("path"),
        (F.col("event_type") == "error").alias("removed"), F.sha2(F.col("props").cast("binary"), 256).alias("digest"), F.col("ts").alias("created"),
    )


def turn_states(conversations: DataFrame) -> DataFrame:
    """Snapshots: (object_id, vnum, path, digest), one file a turn."""
    return conversations.select(F.col("conv_id").alias("object_id"), (F.col("turn") + 1).alias("vnum"), F.col("role").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


def document_files(documents: DataFrame) -> DataFrame:
    """A content store: (object_id, path, digest, size, content) with an object a language."""
    content = F.col("text").cast("binary")
    return documents.select(F.col("lang").alias("object_id"), F.col("doc_id").cast("string").alias("path"), F.sha2(content, 256).alias("digest"), F.octet_length(content).cast("long").alias("size"), content.alias("content"))
