"""Whole objects as table rows: purge, export, import, staged content, fixity blocks, older inventories and the details table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import digests, versions

# Fixed value: where a mutable head lies in its object.
MUTABLE = "extensions/0005-mutable-head/head/content/"


# --- purge, export, import


def purge(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows without the objects of ids; an id that is not there has no effect."""
    return rows.join(ids.select("object_id").distinct(), "object_id", "left_anti")


def export_version(state: DataFrame, manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """(object_id, vnum, path, digest, content_path) of the wanted (object_id, vnum), what a copy of them has to hold."""
    m = manifest.groupBy("object_id", F.lower("digest").alias("digest_lc")).agg(F.min("content_path").alias("content_path"))
    s = state.join(wanted.select("object_id", "vnum").distinct(), ["object_id", "vnum"], "left_semi").withColumn("digest_lc", F.lower("digest"))
    return s.join(m, ["object_id", "digest_lc"], "left").select("object_id", "vnum", "path", "digest", "content_path")


def import_conflicts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(object_id): objects to import that exist already."""
    return incoming.select("object_id").distinct().join(existing.select("object_id"), "object_id", "left_semi")


def incompatible(objects: DataFrame, previous: DataFrame, states: DataFrame, previous_states: DataFrame, manifest: DataFrame, previous_manifest: DataFrame) -> DataFrame:
    """(object_id, rule): why a new inventory can't follow the existing one.

    objects: (object_id, type, digest_algorithm, content_dir, head_vnum). Rules: type, algorithm, content_dir, head (not
    the next version), state (versions of the existing one differ), manifest (its entries differ, or a new entry lies
    outside the new version).
    """
    p = previous.select("object_id", *(F.col(c).alias(f"p_{c}") for c in ("type", "digest_algorithm", "content_dir", "head_vnum")))
    both = objects.join(p, "object_id")
    fields = F.array_compact(
        F.array(
            F.when(~F.col("type").eqNullSafe(F.col("p_type")), "type"), F.when(~F.col("digest_algorithm").eqNullSafe(F.col("p_digest_algorithm")), "algorithm"),
            F.when(~F.col("content_dir").eqNullSafe(F.col("p_content_dir")), "content_dir"), F.when(~F.col("head_vnum").eqNullSafe(F.col("p_head_vnum") + 1), "head"),
        )
    )
    found = both.select("object_id", F.explode(fields).alias("rule"))
    heads = both.select("object_id", "p_head_vnum", "head_vnum")
    key = ["object_id", "vnum", "path"]
    old = previous_states.join(heads, "object_id").select(*key, F.lower("digest").alias("x"))
    new = states.join(heads, "object_id").where(F.col("vnum") <= F.col("p_head_vnum")).select(*key, F.lower("digest").alias("y"))
    state = old.join(new, key, "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select("object_id", F.lit("state").alias("rule"))
    entry = ["object_id", "content_path"]
    a = previous_manifest.join(heads, "object_id").select(*entry, F.lower("digest").alias("x"))
    b = manifest.join(heads, "object_id").select(*entry, F.lower("digest").alias("y"), "head_vnum")
    outside = ~F.col("content_path").startswith(F.concat(F.lit("v"), F.col("head_vnum").cast("string"), F.lit("/")))
    differs = F.col("y").isNull() | (F.col("x").isNull() & outside) | (F.col("x") != F.col("y"))
    listed = a.join(b, entry, "full_outer").where(differs).select("object_id", F.lit("manifest").alias("rule"))
    return found.union(state).union(listed).distinct()


def staged_issues(staged: DataFrame, manifest: DataFrame, heads: DataFrame) -> DataFrame:
    """(object_id, content_path, problem): staged files (object_id, content_path) against the manifest entries of the new version (object_id, head)."""
    new = manifest.join(heads, "object_id").where(F.col("content_vnum") == F.col("head")).select("object_id", "content_path", F.lit(1).alias("listed"))
    both = staged.select("object_id", "content_path", F.lit(1).alias("there")).distinct().join(new, ["object_id", "content_path"], "full_outer")
    problem = F.when(F.col("there").isNull(), "missing").when(F.col("listed").isNull(), "unexpected")
    return both.withColumn("problem", problem).where("problem is not null").select("object_id", "content_path", "problem")


def pruned(manifest: DataFrame, state: DataFrame, head: Column) -> DataFrame:
    """manifest without entries that the version `head` added and its state no longer names."""
    named = state.select("object_id", F.lower("digest").alias("digest_lc")).distinct().withColumn("named", F.lit(True))
    rows = manifest.withColumn("digest_lc", F.lower("digest")).join(named, ["object_id", "digest_lc"], "left")
    return rows.where((F.col("content_vnum") != head) | F.col("named")).drop("digest_lc", "named")


# --- mutable head


def stage(new_content: DataFrame, revision: Column) -> DataFrame:
    """Manifest entries of a mutable head: content paths of the revision's folder instead of the version's."""
    path = F.concat(F.lit(MUTABLE), F.lit("r"), revision.cast("string"), F.lit("/"), F.regexp_replace("content_path", "^v[0-9]+/[^/]+/", ""))
    return new_content.withColumns({"content_path": path, "mutable": F.lit(True)})


def purge_staged(manifest: DataFrame) -> DataFrame:
    return manifest.where(~F.col("content_path").startswith(MUTABLE))


def has_staged(manifest: DataFrame) -> DataFrame:
    """(object_id, staged): whether an object has a mutable head."""
    return manifest.groupBy("object_id").agg(F.max(F.col("content_path").startswith(MUTABLE)).alias("staged"))


def orphans(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(object_id, content_path): files of a mutable head that the manifest doesn't name."""
    return files.where(F.col("content_path").startswith(MUTABLE)).select("object_id", "content_path").join(manifest, ["object_id", "content_path"], "left_anti")


def stale_markers(markers: DataFrame) -> DataFrame:
    """(object_id, name): revision markers below the object's latest one."""
    rows = markers.withColumn("revision", versions.revision(F.col("name"))).where("revision is not null")
    latest = rows.groupBy("object_id").agg(F.max("revision").alias("latest"))
    return rows.join(latest, "object_id").where(F.col("revision") < F.col("latest")).select("object_id", "name")


# --- fixity


def add_fixity(state: DataFrame, manifest: DataFrame, asked: DataFrame, default: str = "sha512") -> tuple[DataFrame, DataFrame]:
    """New fixity rows (object_id, algorithm, digest, content_path) for asked (object_id, path, algorithm, value, actual), and what is refused.

    The default algorithm is not stored, but its value must be the file's digest; another value must be that of the
    content, `actual`, where that is known. Refused rows: (object_id, path, algorithm, problem) missing or mismatch.
    """
    m = manifest.groupBy("object_id", F.lower("digest").alias("digest_lc")).agg(F.min("content_path").alias("content_path"))
    rows = asked.join(state.select("object_id", "path", "digest"), ["object_id", "path"], "left").withColumn("digest_lc", F.lower("digest")).join(m, ["object_id", "digest_lc"], "left")
    truth = F.when(F.col("algorithm") == default, F.col("digest")).otherwise(F.col("actual"))
    problem = F.when(F.col("content_path").isNull(), "missing").when(~F.coalesce(digests.matches(truth, F.col("value")), F.lit(True)), "mismatch")
    rows = rows.withColumn("problem", problem)
    fine = rows.where(F.col("problem").isNull() & (F.col("algorithm") != default))
    return fine.select("object_id", "algorithm", F.lower("value").alias("digest"), "content_path").distinct(), rows.where("problem is not null").select("object_id", "path", "algorithm", "problem")


def clear_fixity(fixity: DataFrame, ids: DataFrame) -> DataFrame:
    return purge(fixity, ids)


def fixity_of_paths(fixity: DataFrame) -> DataFrame:
    """(object_id, content_path, fixity): a map from algorithm to digest. Of two values of an algorithm the smaller one."""
    one = fixity.groupBy("object_id", "content_path", "algorithm").agg(F.min("digest").alias("digest"))
    return one.groupBy("object_id", "content_path").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("algorithm", "digest")))).alias("fixity"))


def fixity_issues(fixity: DataFrame, actual: DataFrame) -> DataFrame:
    """(object_id, content_path, algorithm, code): E093 where the content's digest (object_id, content_path, algorithm, actual) is another, E092 for content algorithms."""
    both = fixity.join(actual, ["object_id", "content_path", "algorithm"]).where(~digests.matches(F.col("actual"), F.col("digest")))
    return both.select("object_id", "content_path", "algorithm", F.when(F.col("algorithm").isin("sha512", "sha256"), "E092").otherwise("E093").alias("code"))


def digests_under(manifest: DataFrame, prefix: str) -> DataFrame:
    """(object_id, digest): the distinct digests of content paths below a directory."""
    return manifest.where(F.col("content_path").startswith(prefix.rstrip("/") + "/")).select("object_id", "digest").distinct()


# --- older inventories


def manifests_by_algorithm(manifests: DataFrame) -> DataFrame:
    """(object_id, algorithm, content_path, digest): what the newest inventory (inv_vnum) of an algorithm says of a content path."""
    return manifests.groupBy("object_id", "algorithm", "content_path").agg(F.max_by("digest", "inv_vnum").alias("digest"))


def manifest_issues(manifests: DataFrame) -> DataFrame:
    """(object_id, inv_vnum, content_path, code): E092 where an older inventory gives a content path another digest than the newest of its algorithm."""
    newest = manifests_by_algorithm(manifests).withColumnRenamed("digest", "newest")
    differs = manifests.join(newest, ["object_id", "algorithm", "content_path"]).where(F.lower("digest") != F.lower("newest"))
    return differs.select("object_id", "inv_vnum", "content_path", F.lit("E092").alias("code"))


def chain_issues(states: DataFrame) -> DataFrame:
    """(object_id, inv_vnum, vnum, path, code): E066 where an older inventory's state of a version differs from that of the newest inventory of its algorithm.

    states: (object_id, inv_vnum, algorithm, vnum, path, digest). Where an inventory is the newest of its algorithm but
    not of all, only the paths are compared with those of the newest one, as digests of two algorithms can't be.
    """
    inv = states.groupBy("object_id", "inv_vnum").agg(F.first("algorithm").alias("algorithm"))
    of_object, of_algorithm = Window.partitionBy("object_id"), Window.partitionBy("object_id", "algorithm")
    inv = inv.withColumns({"newest": F.max("inv_vnum").over(of_object), "same": F.max("inv_vnum").over(of_algorithm)}).where(F.col("inv_vnum") < F.col("newest"))
    inv = inv.withColumns({"by_digest": F.col("same") > F.col("inv_vnum"), "anchor": F.when(F.col("same") > F.col("inv_vnum"), F.col("same")).otherwise(F.col("newest"))})
    pairs = inv.select("object_id", "inv_vnum", "anchor", "by_digest")
    key = ["object_id", "inv_vnum", "vnum", "path"]
    mine = states.join(pairs, ["object_id", "inv_vnum"]).where(F.col("vnum") <= F.col("inv_vnum")).select(*key, F.lower("digest").alias("x"), F.lit(True).alias("m"))
    theirs = states.select("object_id", F.col("inv_vnum").alias("anchor"), "vnum", "path", "digest").join(pairs, ["object_id", "anchor"]).where(F.col("vnum") <= F.col("inv_vnum"))
    theirs = theirs.select(*key, F.lower("digest").alias("y"), F.lit(True).alias("t"))
    both = mine.join(theirs, key, "full_outer").join(pairs.select("object_id", "inv_vnum", "by_digest"), ["object_id", "inv_vnum"])
    differs = F.col("m").isNull() | F.col("t").isNull() | (F.col("by_digest") & (F.col("x") != F.col("y")))
    return both.where(differs).select(*key, F.lit("E066").alias("code"))


# --- the details table: (object_id, version_id, object_root_path, revision_id, inventory_digest, digest_algorithm, inventory, update_timestamp)


def select_details(details: DataFrame, ids: DataFrame) -> DataFrame:
    return details.join(ids.select("object_id").distinct(), "object_id", "left_semi")


def out_of_sync(details: DataFrame, new: DataFrame) -> DataFrame:
    """(object_id): rows of new that may not follow what is stored: not the next version, or not the next revision of a mutable head."""
    old = details.select("object_id", F.col("version_id").alias("v"), F.col("revision_id").alias("r"))
    both = new.join(old, "object_id")
    revision, before = versions.revision(F.col("revision_id")), versions.revision(F.col("r"))
    staged = (F.col("v") != F.col("version_id")) | F.coalesce(revision != before + 1, F.lit(False))
    plain = ~F.col("version_id").eqNullSafe(versions.following(F.col("v"))) | F.coalesce(revision != 1, F.lit(False))
    return both.where(F.when(F.col("r").isNotNull(), staged).otherwise(plain)).select("object_id")


def upsert_details(details: DataFrame, new: DataFrame) -> DataFrame:
    """details with the rows of new that are in sync put in or in place of the old ones."""
    fine = new.join(out_of_sync(details, new), "object_id", "left_anti")
    return purge(details, fine).unionByName(fine)


def delete_details(details: DataFrame, ids: DataFrame) -> DataFrame:
    return purge(details, ids)


def path_issues(rows: DataFrame, key: list[str], edge: str, parts: str, conflict: str) -> DataFrame:
    """(*key, path, code): paths that begin or end with a slash (edge), have blank or dot parts (parts), occur twice or are a directory of another (conflict)."""
    from palimpsest.functions import paths

    p = F.col("path")
    each = F.split(p, "/", -1)
    inner = F.regexp_replace(p, "^/|/$", "")
    wrong = F.when(p.startswith("/") | p.endswith("/"), edge), F.when(F.exists(F.split(inner, "/", -1), lambda x: x == ""), parts), F.when(F.exists(each, lambda x: x.isin(".", "..")), parts)
    single = rows.select(*key, "path", F.explode(F.array_compact(F.array(*wrong))).alias("code"))
    twice = rows.groupBy(*key, "path").agg(F.count("*").alias("n")).where("n > 1").select(*key, "path", F.lit(conflict).alias("code"))
    above = rows.select(*key, F.explode(paths.ancestors(p)).alias("path")).distinct()
    under = rows.select(*key, "path").distinct().join(above, [*key, "path"], "left_semi").select(*key, "path", F.lit(conflict).alias("code"))
    return reduce(DataFrame.union, [single, twice, under])


def fixity_block_issues(fixity: DataFrame, key: list[str]) -> DataFrame:
    """(*key, digest, code): E057 for values that are no digest of their algorithm, E097 for values that differ in case alone."""
    shape = F.lit(True)
    for name in digests.LENGTHS:
        shape = F.when(F.col("algorithm") == name, digests.well_formed(F.col("digest"), name)).otherwise(shape)
    rows = fixity.select(*key, "algorithm", "digest").distinct()
    wrong = rows.where(~shape).select(*key, "digest", F.lit("E057").alias("code"))
    twice = rows.groupBy(*key, "algorithm", F.lower("digest").alias("digest_lc")).agg(F.count("*").alias("n")).where("n > 1")
    return wrong.union(twice.select(*key, F.col("digest_lc").alias("digest"), F.lit("E097").alias("code")))
