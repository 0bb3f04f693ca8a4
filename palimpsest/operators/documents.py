"""Issues of inventory documents (object_id, raw), one row (object_id, code) for each breach.

Two gates: a document that is no JSON object is E033 and nothing else, and the value rules look only at documents whose
shape is right. Documents are taken apart as VARIANT, so each check is a projection or an explode of its own document;
the one shuffle is that of the gate and of the rules that compare digests or versions within a document. Documents in
which a key occurs twice count as no JSON. A null object_id stays null, and its documents are gated together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import versions
from palimpsest.operators import integrity
from palimpsest.sources import inventory

# The two inventory types, the content digest algorithms and the codes of wrong types by field.
TYPES = ("https://ocfl.io/1.0/spec/#inventory", "https://ocfl.io/1.1/spec/#inventory")
CONTENT_ALGORITHMS = ("sha512", "sha256")
TOP_STRINGS = {"id": "E037", "type": "E038", "digestAlgorithm": "E033", "head": "E040", "contentDirectory": "E033"}
TOP_OBJECTS = {"fixity": "E111", "manifest": "E106", "versions": "E044"}
VERSION_STRINGS, VERSION_OBJECTS = {"created": "E049", "message": "E094"}, {"user": "E054", "state": "E050"}
USER_STRINGS = {"name": "E054", "address": "E033"}
UNKNOWN = "E102"


def _kind(value: str) -> Column:
    return F.regexp_extract(F.coalesce(F.expr(f"schema_of_variant({value})"), F.lit("VOID")), "^[A-Z]+", 0)


def _fields(df: DataFrame, value: str, name: str) -> DataFrame:
    """A row for each field of the object `value`: object_id, what `name` calls the field, value, kind."""
    rows = df.select("object_id", F.explode(F.expr(f"try_variant_get({value}, '$', 'map<string,variant>')")).alias(name, "value"))
    return rows.withColumn("kind", _kind("value"))


def _shape(fields: DataFrame, name: str, strings: dict[str, str], objects: dict[str, str]) -> DataFrame:
    """Strings may be null, objects may not; other fields are unknown."""
    code = F.when(~F.col(name).isin(*strings, *objects), UNKNOWN)
    for f, c in strings.items():
        code = code.when((F.col(name) == f) & ~F.col("kind").isin("STRING", "VOID"), c)
    for f, c in objects.items():
        code = code.when((F.col(name) == f) & (F.col("kind") != "OBJECT"), c)
    return fields.select("object_id", code.alias("code"))


def _path_lists(maps: DataFrame, not_list: str, not_string: str) -> DataFrame:
    lists = _fields(maps, "value", "digest")
    items = lists.where("kind = 'ARRAY'").select("object_id", F.explode(F.expr("try_variant_get(value, '$', 'array<variant>')")).alias("value"))
    return lists.select("object_id", F.when(F.col("kind") != "ARRAY", not_list).alias("code")).union(items.select("object_id", F.when(_kind("value") != "STRING", not_string).alias("code")))


def shape_issues(docs: DataFrame) -> DataFrame:
    """Breaches of types: wrong JSON types and unknown fields."""
    parsed = docs.select("object_id", F.expr("try_parse_json(raw)").alias("doc"))
    parsed = parsed.withColumn("kind", F.when(F.col("doc").isNotNull(), _kind("doc")))
    top = _fields(parsed.where("kind = 'OBJECT'"), "doc", "field")
    each = _fields(top.where("field = 'versions' and kind = 'OBJECT'"), "value", "version")
    inside = _fields(each.where("kind = 'OBJECT'"), "value", "field")
    user = _fields(inside.where("field = 'user' and kind = 'OBJECT'"), "value", "field")
    found = [
        parsed.select("object_id", F.when(F.coalesce(F.col("kind"), F.lit("")) != "OBJECT", "E033").alias("code")),
        _shape(top, "field", TOP_STRINGS, TOP_OBJECTS),
        each.select("object_id", F.when(F.col("kind") != "OBJECT", "E047").alias("code")),
        _shape(inside, "field", VERSION_STRINGS, VERSION_OBJECTS),
        _shape(user, "field", USER_STRINGS, {}),
        _path_lists(top.where("field = 'manifest' and kind = 'OBJECT'"), "E092", "E092"),
        _path_lists(inside.where("field = 'state' and kind = 'OBJECT'"), "E050", "E051"),
    ]
    return reduce(DataFrame.union, found).where("code is not null")


def _coded(df: DataFrame, *codes: Column) -> DataFrame:
    return df.select("object_id", F.explode(F.array_compact(F.array(*codes))).alias("code"))


def _blank(c: Column) -> Column:
    return c.isNull() | c.rlike(r"^\s*$")


def _number_codes(version: Column) -> tuple[Column, Column]:
    """E104 for what is no version number, E009 for zero."""
    fine = version.rlike(r"^v\d+$")
    return F.when(version.isNotNull() & ~fine, "E104"), F.when(fine & version.rlike("^v0+$"), "E009")


def value_issues(docs: DataFrame) -> DataFrame:
    """(object_id, code, n) of breaches of values: required fields, version numbers, timestamps, users, digests."""
    parsed = inventory.parse(docs).select(F.col("object_id").alias("owner"), "inv")
    one = parsed.select(F.col("owner").alias("object_id"), "inv.*")
    algorithm, directory = F.col("digestAlgorithm"), F.col("contentDirectory")
    top = _coded(
        one,
        F.when(_blank(F.col("id")), "E036"), *(F.when(F.col(c).isNull(), "E036") for c in ("type", "digestAlgorithm", "head")),
        F.when(~versions.is_uri(F.col("id")), "W005"), F.when(~F.col("type").isin(*TYPES), "E038"),
        F.when(~algorithm.isin(*CONTENT_ALGORITHMS), "E025").when(algorithm != "sha512", "W004"), *_number_codes(F.col("head")),
        F.when(directory.contains("/"), "E017"), F.when(directory.isin(".", ".."), "E018"),
        F.when(F.col("manifest").isNull(), "E041"), F.when(F.col("versions").isNull(), "E043").when(F.size("versions") == 0, "E008"),
        F.when(~F.coalesce(F.map_contains_key("versions", F.col("head")), F.lit(True)), "E010"),
    )
    named = one.select("object_id", "head", F.explode("versions").alias("version", "v"))
    user, created = F.col("v.user"), F.col("v.created")
    each = _coded(
        named, *_number_codes(F.col("version")),
        F.when(created.isNull(), "E048").when(~versions.is_rfc3339(created), "E049"), F.when(F.col("v.state").isNull(), "E048"),
        F.when(user.isNull(), "W007").when(_blank(user["name"]), "E054"), F.when(F.col("v.message").isNull(), "W007"),
        F.when(user.isNotNull() & user["address"].isNull(), "W008"), F.when(~versions.is_uri(user["address"]), "W009"),
    )
    numbered = named.select("object_id", "head", "version", versions.number(F.col("version")).alias("vnum"), versions.padding(F.col("version")).alias("vpad")).where("vnum > 0")
    last = numbered.groupBy("object_id", "head").agg(F.max_by("version", "vnum").alias("highest"))
    wrong_head = last.select("object_id", F.when(F.col("head") != F.col("highest"), "E040").alias("code")).where("code is not null")
    absent = F.max("vnum") - F.countDistinct("vnum")  # counted, not listed: a version number may be of any size
    gaps = numbered.groupBy("object_id").agg(absent.alias("n")).where("n > 0").select("object_id", F.lit("E010").alias("code"), "n")
    # Paddings are compared from version to version as long as none is missing.
    order = Window.partitionBy("object_id").orderBy("vnum")
    run = numbered.withColumns({"nth": F.row_number().over(order), "first": F.first("vpad").over(order)}).where((F.col("nth") == F.col("vnum")) & (F.col("vpad") != F.col("first")))
    pads = run.select("object_id", F.lit("E013").alias("code")).distinct()
    manifest = one.select("object_id", F.explode(F.map_keys("manifest")).alias("digest"))
    state = named.select("object_id", "version", F.explode(F.map_keys("v.state")).alias("digest"))
    unknown = state.join(manifest, ["object_id", "digest"], "left_anti").select("object_id", F.lit("E050").alias("code"))
    unused = manifest.join(one.where("versions is not null").select("object_id"), "object_id", "left_semi").join(state, ["object_id", "digest"], "left_anti").select("object_id", F.lit("E107").alias("code"))
    same = integrity.duplicate_digests(manifest).select("object_id", F.lit("E096").alias("code"))
    return reduce(DataFrame.union, [top, each, wrong_head, pads, unknown, unused, same]).withColumn("n", F.lit(1).cast("long")).union(gaps)


def issues(docs: DataFrame) -> DataFrame:
    """(object_id, code, n): how often each document breaks each rule."""
    shape = shape_issues(docs)
    bad = shape.select(F.col("object_id").alias("gated")).distinct()
    right = docs.join(bad, F.col("object_id").eqNullSafe(F.col("gated")), "left_anti")
    return shape.withColumn("n", F.lit(1).cast("long")).union(value_issues(right)).groupBy("object_id", "code").agg(F.sum("n").alias("n"))
