"""Update logs: the operations of one new version for each object, applied in order to its head state.

A log has rows (object_id, seq, op, path, to, digest, overwrite, expected_head). op is add (path, digest), remove (path),
rename (path, to), reinstate (path, to, digest of the older version, see with_reinstated) or clear. Operations of an
object are folded in order of seq over a map from path to digest, on the JVM; a log holds one version's operations of
an object, so the fold's row is as large as that version. An error of any operation keeps the object as it is:
exists (no leave to overwrite), missing (no such source), out_of_sync (the expected head is not the head).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("object_id", "seq", "op", "path", "to", "digest", "overwrite", "expected_head")


def with_reinstated(log: DataFrame, version_state: DataFrame) -> DataFrame:
    """log whose reinstate rows have the digest of (from_version, path); null where there is none."""
    old = version_state.select("object_id", F.col("vnum").alias("from_version"), "path", F.col("digest").alias("__old"))
    found = log.join(old, ["object_id", "from_version", "path"], "left")
    return found.withColumn("digest", F.when(F.col("op") == "reinstate", F.col("__old")).otherwise(F.col("digest"))).select(*COLUMNS)


def folded(state: DataFrame, heads: DataFrame, log: DataFrame) -> DataFrame:
    """(object_id, head, before, now, errors): maps from path to digest before and after the log, and the errors (seq, code)."""
    before = state.groupBy("object_id").agg(F.map_from_entries(F.collect_list(F.struct("path", "digest"))).alias("before"))
    row = F.struct("seq", "op", "path", "to", "digest", F.coalesce("overwrite", F.lit(False)).alias("overwrite"), "expected_head")
    steps = log.groupBy("object_id").agg(F.sort_array(F.collect_list(row)).alias("steps"))
    empty = "cast(map() as map<string,string>)"
    rows = steps.join(heads, "object_id", "left").join(before, "object_id", "left").withColumn("before", F.coalesce("before", F.expr(empty))).withColumn("head", F.coalesce(F.col("head").cast("long"), F.lit(0).cast("long")))
    target = "case when o.op = 'add' then o.path else o.to end"
    value = "case when o.op = 'rename' then element_at(s.now, o.path) else o.digest end"
    moves, lost = "o.op in ('add', 'rename', 'reinstate')", "(o.op = 'rename' and not map_contains_key(s.now, o.path) or o.op = 'reinstate' and o.digest is null)"
    code = f"case when o.expected_head <> head then 'out_of_sync' when {lost} then 'missing' when {moves} and not o.overwrite and map_contains_key(s.now, {target}) then 'exists' end"
    kept = f"map_filter(s.now, (k, v) -> not (k = coalesce(case when {moves} then {target} end, '') and {moves}) and not (o.op in ('remove', 'rename') and k = o.path) and o.op <> 'clear')"
    now = f"case when {code} is not null then s.now when {moves} then map_concat({kept}, map({target}, {value})) else {kept} end"
    errors = f"case when {code} is null then s.errors else array_append(s.errors, named_struct('seq', o.seq, 'code', {code})) end"
    first = "named_struct('now', before, 'errors', cast(array() as array<struct<seq:bigint,code:string>>))"
    done = F.expr(f"aggregate(steps, {first}, (s, o) -> named_struct('now', {now}, 'errors', {errors}))")
    return rows.withColumn("done", done).select("object_id", "head", "before", F.col("done.now").alias("now"), F.col("done.errors").alias("errors"))


def apply(state: DataFrame, heads: DataFrame, log: DataFrame) -> DataFrame:
    """(object_id, vnum, path, digest): the state of the new version of each object whose log has no error. A version without files has a row with a null path."""
    fine = folded(state, heads, log).where(F.size("errors") == 0)
    return fine.select("object_id", (F.col("head") + 1).alias("vnum"), F.explode_outer("now").alias("path", "digest"))


def errors(state: DataFrame, heads: DataFrame, log: DataFrame) -> DataFrame:
    """(object_id, seq, code) of the operations that fail."""
    return folded(state, heads, log).select("object_id", F.explode("errors").alias("e")).select("object_id", "e.seq", "e.code")


def new_content(manifest: DataFrame, new_state: DataFrame) -> DataFrame:
    """(object_id, digest, content_vnum, content_path): what the new version adds to the manifest, the first path of each digest not yet there."""
    known = manifest.select("object_id", F.lower("digest").alias("digest_lc"))
    rows = new_state.where("path is not null").withColumn("digest_lc", F.lower("digest")).join(known, ["object_id", "digest_lc"], "left_anti")
    first = rows.groupBy("object_id", "digest", F.col("vnum").alias("content_vnum")).agg(F.min("path").alias("path"))
    return first.select("object_id", "digest", "content_vnum", F.concat(F.lit("v"), F.col("content_vnum").cast("string"), F.lit("/content/"), F.col("path")).alias("content_path"))
