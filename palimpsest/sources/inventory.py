"""Inventory documents (one JSON document for each object version) and their normalized tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import versions

SCHEMA = (
    "id string, type string, digestAlgorithm string, head string, contentDirectory string, "
    "fixity map<string,map<string,array<string>>>, manifest map<string,array<string>>, "
    "versions map<string,struct<created:string,message:string,user:struct<name:string,address:string>,state:map<string,array<string>>>>"
)


def parse(raw: DataFrame, column: str = "raw") -> DataFrame:
    """raw with `inv`; documents that are no JSON have null fields."""
    return raw.withColumn("inv", F.from_json(F.col(column), SCHEMA))


def objects(parsed: DataFrame) -> DataFrame:
    i = F.col("inv")
    return parsed.select(i["id"].alias("object_id"), i["type"].alias("type"), i["digestAlgorithm"].alias("digest_algorithm"), i["head"].alias("head"), versions.number(i["head"]).alias("head_vnum"), F.coalesce(i["contentDirectory"], F.lit("content")).alias("content_dir"))


def version_rows(parsed: DataFrame) -> DataFrame:
    rows = parsed.select(F.col("inv.id").alias("object_id"), F.explode("inv.versions").alias("version", "v"))
    return rows.select("object_id", versions.number(F.col("version")).alias("vnum"), versions.padding(F.col("version")).alias("vpad"), "version", F.col("v.created").alias("created_raw"), F.try_to_timestamp("v.created").alias("created"), F.col("v.message").alias("message"), F.col("v.user.name").alias("user_name"), F.col("v.user.address").alias("user_address"))


def state_rows(parsed: DataFrame) -> DataFrame:
    rows = parsed.select(F.col("inv.id").alias("object_id"), F.explode("inv.versions").alias("version", "v"))
    rows = rows.select("object_id", versions.number(F.col("version")).alias("vnum"), F.explode("v.state").alias("digest", "paths"))
    return rows.select("object_id", "vnum", "digest", F.explode("paths").alias("path"))


def manifest_rows(parsed: DataFrame) -> DataFrame:
    rows = parsed.select(F.col("inv.id").alias("object_id"), F.explode("inv.manifest").alias("digest", "paths"))
    rows = rows.select("object_id", "digest", F.explode("paths").alias("content_path"))
    return rows.withColumn("content_vnum", versions.number(F.substring_index("content_path", "/", 1)))


def fixity_rows(parsed: DataFrame) -> DataFrame:
    rows = parsed.select(F.col("inv.id").alias("object_id"), F.explode("inv.fixity").alias("algorithm", "block"))
    rows = rows.select("object_id", "algorithm", F.explode("block").alias("digest", "paths"))
    return rows.select("object_id", "algorithm", "digest", F.explode("paths").alias("content_path"))


def build(states: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """Inventory documents (object_id, raw) from snapshots (object_id, vnum, path, digest); the same snapshots give the same bytes, however their rows are dealt."""
    one = states.groupBy("object_id", "vnum", "digest").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    state = one.groupBy("object_id", "vnum").agg(F.sort_array(F.collect_list(F.struct("digest", "paths"))).alias("state"))
    # Sorted before the states become maps, which have no order.
    v = F.transform(
        F.sort_array(F.collect_list(F.struct("vnum", "state"))),
        lambda x: F.struct(
            F.concat(F.lit("v"), x["vnum"].cast("string")).alias("k"),
            F.struct(F.lit("2020-01-01T00:00:00Z").alias("created"), F.lit("m").alias("message"), F.struct(F.lit("u").alias("name")).alias("user"), F.map_from_entries(x["state"]).alias("state")).alias("v"),
        ),
    )
    whole = state.groupBy("object_id").agg(F.map_from_entries(v).alias("versions"), F.max("vnum").alias("head"))
    first = states.groupBy("object_id", "digest").agg(F.min(F.struct("vnum", "path")).alias("f"))
    path = F.concat_ws("/", F.concat(F.lit("v"), F.col("f.vnum").cast("string")), F.lit("content"), F.col("f.path"))
    manifest = first.groupBy("object_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("digest", F.array(path))))).alias("manifest"))
    doc = F.struct(F.col("object_id").cast("string").alias("id"), F.lit("https://ocfl.io/1.1/spec/#inventory").alias("type"), F.lit(algorithm).alias("digestAlgorithm"), F.concat(F.lit("v"), F.col("head").cast("string")).alias("head"), "manifest", "versions")
    return whole.join(manifest, "object_id").select(F.col("object_id").cast("string").alias("object_id"), F.to_json(doc).alias("raw"))
