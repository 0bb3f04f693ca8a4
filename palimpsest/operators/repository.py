"""A repository as a table of its files: (path, kind, length, content), with paths below the storage root.

kind is file, directory or other; content is filled for metadata files only. An object root is a directory that holds an
object declaration; nothing below one is an object of its own, and the storage root's extensions directory holds none.
Issues are rows (root, code, subject). An object whose declaration names no known version has no other issues.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import paths
from palimpsest.sources import inventory

# Names and versions of the storage format, and the extensions that its registry lists.
DECLARATION = "0=ocfl_object_"
SUPPORTED = ("0=ocfl_object_1.0", "0=ocfl_object_1.1")
INVENTORY = "inventory.json"
MUTABLE_HEAD = "extensions/0005-mutable-head/head"
EXTENSIONS = [
    "0001-digest-algorithms", "0002-flat-direct-storage-layout", "0003-hash-and-id-n-tuple-storage-layout", "0004-hashed-n-tuple-storage-layout",
    "0005-mutable-head", "0006-flat-omit-prefix-storage-layout", "0007-n-tuple-omit-prefix-storage-layout", "0008-schema-registry", "0009-digest-algorithms",
]


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_of(path: Column) -> Column:
    """Directory of a path; empty for the storage root."""
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


def declarations(files: DataFrame) -> DataFrame:
    """(root, name, code): object declarations; code is E003 for unknown versions, E007 for wrong content, else null."""
    name = name_of(F.col("path"))
    rows = files.where((F.col("kind") == "file") & name.startswith(DECLARATION)).withColumn("name", name)
    right = F.col("content").cast("string").eqNullSafe(F.concat(F.substr("name", F.lit(3)), F.lit("\n")))
    return rows.select(parent_of(F.col("path")).alias("root"), "name", F.when(~F.col("name").isin(*SUPPORTED), "E003").when(~right, "E007").alias("code"))


def object_roots(files: DataFrame) -> DataFrame:
    """(root): directories with a declaration that lie in no other object and not in the storage root's extensions."""
    every = declarations(files).select("root").distinct().where(~F.col("root").startswith("extensions/") & (F.col("root") != "extensions"))
    above = every.select("root", F.explode(paths.ancestors(F.col("root"))).alias("up"))
    nested = above.join(every.select(F.col("root").alias("up")), "up", "left_semi").select("root")
    return every.join(nested, "root", "left_anti")


def below(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, rel, kind, length, content): everything below each of roots, by an equi-join on exploded prefixes."""
    rows = files.withColumn("root", F.explode(paths.ancestors(F.col("path")))).join(roots.select("root").distinct(), "root")
    return rows.select("root", F.substr("path", F.length("root") + 2).alias("rel"), "kind", "length", "content")


def children(entries: DataFrame, prefix: str = "") -> DataFrame:
    """Of entries below roots: those directly in the directory that the pattern `prefix` names, with their `name`."""
    return entries.where(F.col("rel").rlike(f"^{prefix}[^/]+$")).withColumn("name", name_of(F.col("rel")))


def inventories(entries: DataFrame) -> DataFrame:
    """(root, rel, mutable, raw): each object's inventory; that of a mutable head goes before the root's."""
    rows = entries.where(F.col("rel").isin(INVENTORY, f"{MUTABLE_HEAD}/{INVENTORY}")).withColumn("mutable", F.col("rel") != INVENTORY)
    best = rows.groupBy("root").agg(F.max_by(F.struct("rel", "mutable", F.col("content").cast("string").alias("raw")), "mutable").alias("i"))
    return best.select("root", "i.*")


def version_inventories(entries: DataFrame) -> DataFrame:
    """(root, version, raw): the inventories in version directories."""
    rows = entries.where(F.col("rel").rlike(r"^v\d+/inventory\.json$"))
    return rows.select("root", F.substring_index("rel", "/", 1).alias("version"), F.col("content").cast("string").alias("raw"))


def inventory_of_version(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """(root, version, raw) for wanted (root, version): the version's own copy, else the current inventory if that is its head, else null."""
    now = inventories(entries).select("root", F.get_json_object("raw", "$.head").alias("version"), F.col("raw").alias("current"))
    return wanted.join(version_inventories(entries), ["root", "version"], "left").join(now, ["root", "version"], "left").select("root", "version", F.coalesce("raw", "current").alias("raw"))


def list_objects(files: DataFrame) -> DataFrame:
    """(object_id, root): the ids that the objects' inventories state."""
    roots = object_roots(files)
    return inventories(below(files, roots)).select(F.get_json_object("raw", "$.id").alias("object_id"), "root")


def contains(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (root, ...) with `present`: whether an object root is there."""
    return wanted.join(object_roots(files).withColumn("present", F.lit(True)), "root", "left").withColumn("present", F.coalesce("present", F.lit(False)))


def sidecars(entries: DataFrame) -> DataFrame:
    """(root, rel, algorithm, digest, fine): sidecars with the inventory they belong to; `fine` where they hold a digest and the inventory's name."""
    rows = entries.where(F.col("rel").rlike(r"(^|/)inventory\.json\.[^/]+$"))
    parts = F.split(F.regexp_replace(F.col("content").cast("string"), r"\s+$", ""), r"\s+")
    fine = (F.size(parts) == 2) & (parts[1] == INVENTORY)
    return rows.select("root", F.regexp_replace("rel", r"\.json\.[^/]+$", ".json").alias("rel"), F.regexp_extract("rel", r"\.json\.([^/]+)$", 1).alias("algorithm"), parts[0].alias("digest"), F.coalesce(fine, F.lit(False)).alias("fine"))


def _issues(rows: DataFrame, code: Column, subject: str = "rel") -> DataFrame:
    return rows.select("root", code.alias("code"), F.col(subject).alias("subject")).where("code is not null")


def sidecar_issues(entries: DataFrame) -> DataFrame:
    """E058 (no sidecar), E061 (wrong form), E060 (another digest than the inventory's) for root and version inventories."""
    rows = entries.where(F.col("rel").rlike(r"^(v\d+/)?inventory\.json$"))
    named = rows.select("root", "rel", "content", F.get_json_object(F.col("content").cast("string"), "$.digestAlgorithm").alias("algorithm"))
    own = F.when(F.col("algorithm") == "sha512", F.sha2("content", 512)).when(F.col("algorithm") == "sha256", F.sha2("content", 256))
    both = named.withColumn("own", own).where("own is not null").join(sidecars(entries), ["root", "rel", "algorithm"], "left")
    return _issues(both, F.when(F.col("fine").isNull(), "E058").when(~F.col("fine"), "E061").when(F.lower("own") != F.lower("digest"), "E060"))


def _parsed(entries: DataFrame) -> DataFrame:
    """(root, algorithm, content_dir, versions, inv) from the root inventories."""
    rows = inventory.parse(entries.where(F.col("rel") == INVENTORY).select("root", F.col("content").cast("string").alias("raw")))
    i = F.col("inv")
    return rows.select("root", i["digestAlgorithm"].alias("algorithm"), F.coalesce(i["contentDirectory"], F.lit("content")).alias("content_dir"), F.map_keys(i["versions"]).alias("versions"), "inv")


def root_issues(entries: DataFrame, parsed: DataFrame) -> DataFrame:
    """E001, E003, E046, E063, E010, E067, W001, W013: what an object root and its extensions directory hold."""
    top = children(entries).join(parsed.select("root", "algorithm", "versions"), "root")
    known = (F.col("name") == INVENTORY) | (F.col("name") == F.concat(F.lit(f"{INVENTORY}."), F.col("algorithm")))
    name, folder, version = F.col("name"), F.col("kind") == "directory", F.col("name").rlike("^v0*[1-9][0-9]*$")
    code = F.when(name.isin("logs", "extensions"), F.when(~folder, "E001")).when(version & ~folder, "E001").when(version & ~F.array_contains("versions", name), "E046")
    code = code.when(version, F.when(name.rlike("^v0"), "W001")).when(~name.startswith(DECLARATION), "E001")
    declared = top.where(name.startswith(DECLARATION)).groupBy("root").agg(F.min("name").alias("first"), F.collect_set("name").alias("names"))
    more = declared.select("root", F.explode("names").alias("rel"), "first").where("rel != first")
    extra = children(entries, "extensions/")
    absent = parsed.select("root", F.explode("versions").alias("rel")).join(children(entries).where(F.col("kind") == "directory").select("root", "rel"), ["root", "rel"], "left_anti")
    without = entries.select("root").distinct().join(entries.where(F.col("rel") == INVENTORY).select("root"), "root", "left_anti").withColumn("rel", F.lit(INVENTORY))
    return reduce(
        DataFrame.union,
        [
            _issues(top.where(~known), code), _issues(more, F.lit("E003")), _issues(absent, F.lit("E010")), _issues(without, F.lit("E063")),
            _issues(extra, F.when(F.col("kind") != "directory", "E067").when(~F.col("name").isin(*EXTENSIONS), "W013")),
        ],
    )


def version_issues(entries: DataFrame, parsed: DataFrame) -> DataFrame:
    """E015, E090, W002, W003, W010: what version directories hold."""
    inner = children(entries, r"v\d+/").withColumn("version", F.substring_index("rel", "/", 1)).join(parsed, "root").where(F.array_contains("versions", F.col("version")))
    named = (F.col("name") == INVENTORY) | (F.col("name") == F.concat(F.lit(f"{INVENTORY}."), F.col("algorithm"))) | ((F.col("name") == F.col("content_dir")) & (F.col("kind") == "directory"))
    code = F.when(F.col("kind") == "file", "E015").when(F.col("kind") == "directory", "W002").otherwise("E090")
    held = entries.where(F.col("rel").rlike("^v[0-9]+/[^/]+/")).select("root", F.array_join(F.slice(F.split("rel", "/"), 1, 2), "/").alias("rel")).distinct()
    empty = inner.where((F.col("name") == F.col("content_dir")) & (F.col("kind") == "directory")).join(held, ["root", "rel"], "left_anti")
    wanted = parsed.select("root", F.explode("versions").alias("rel"))
    copies = entries.where(F.col("rel").rlike(r"^v\d+/inventory\.json$")).select("root", F.substring_index("rel", "/", 1).alias("rel"))
    return _issues(inner.where(~named), code).union(_issues(empty, F.lit("W003"))).union(_issues(wanted.join(copies, ["root", "rel"], "left_anti"), F.lit("W010")))


def content_files(entries: DataFrame, parsed: DataFrame) -> DataFrame:
    """(root, rel, kind, length): what lies in the content directories of the inventory's versions."""
    rows = entries.where(F.col("rel").rlike("^v[0-9]+/[^/]+/.")).join(parsed.select("root", "versions", "content_dir"), "root")
    inside = F.array_contains("versions", F.substring_index("rel", "/", 1)) & (F.split("rel", "/")[1] == F.col("content_dir"))
    return rows.where(inside).select("root", "rel", "kind", "length")


def content_issues(entries: DataFrame, parsed: DataFrame) -> DataFrame:
    """E023 (file not in the manifest), E024 (empty directory), E092 and E093 (path of manifest or fixity block without file)."""
    held = content_files(entries, parsed)
    files = held.where(F.col("kind") != "directory").select("root", "rel")
    listed = parsed.select("root", F.explode("inv.manifest").alias("digest", "names")).select("root", F.explode("names").alias("rel")).distinct()
    fixity = parsed.select("root", F.explode("inv.fixity").alias("algorithm", "block")).select("root", F.explode("block").alias("digest", "names")).select("root", F.explode("names").alias("rel")).distinct()
    filled = held.select("root", F.explode(paths.ancestors(F.col("rel"))).alias("rel")).distinct()
    empty = held.where(F.col("kind") == "directory").join(filled, ["root", "rel"], "left_anti")
    gone = lambda x, y: x.join(y, ["root", "rel"], "left_anti")
    return reduce(DataFrame.union, [_issues(gone(files, listed), F.lit("E023")), _issues(empty, F.lit("E024")), _issues(gone(listed, files), F.lit("E092")), _issues(gone(fixity, files), F.lit("E093"))])


def object_issues(files: DataFrame) -> DataFrame:
    """(root, code, subject) of every object of the repository; later rules look only at objects of a known version, most of them only at those with an inventory."""
    declared = declarations(files)
    roots = object_roots(files)
    wrong = declared.join(roots, "root", "left_semi").where("code is not null").select("root", "code", F.col("name").alias("subject"))
    entries = below(files, roots.join(wrong.where("code = 'E003'").select("root"), "root", "left_anti"))
    parsed = _parsed(entries).where("inv.versions is not null")
    return reduce(DataFrame.union, [wrong, root_issues(entries, parsed), sidecar_issues(entries), version_issues(entries, parsed), content_issues(entries, parsed)])


def unsupported_extensions(files: DataFrame) -> DataFrame:
    """(name): extensions of the storage root that are not in the registry."""
    top = files.where(F.col("path").rlike("^extensions/[^/]+$") & (F.col("kind") == "directory"))
    return top.select(name_of(F.col("path")).alias("name")).where(~F.col("name").isin(*EXTENSIONS))
