"""Queries over repositories, updates, details and older inventories, with their DuckDB SQL.

Repositories are laid out as a table of files from the conversations: an object a conversation, a version a turn, a file
a role. Faults are planted by an object's number modulo 16, so that the SQL can tell what each rule has to find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import digests, paths
from palimpsest.operators import mutate, repository, state, tables, updates
from palimpsest.plans.registry import FILES, MANIFEST, OPS, STATES, TURNS, files, ops, query, turns
from palimpsest.runtime import saved, table
from palimpsest.sources import inventory

SQL_O = "o as (select conv_id n, 'root/o' || conv_id root, conv_id % 16 k, count(distinct turn) versions from conversations where conv_id is not null group by all)"
#: What a content path holds: each digest of an object lies where its first version, and in that its first role, put it.
SQL_M = f"{TURNS}, m as (select object_id n, digest, min(vnum) v, 'v' || min(vnum) || '/content/' || arg_min(path, (vnum, path)) rel from turns where object_id is not null group by all)"


def tree(spark, d: str) -> DataFrame:
    """(path, kind, length, content) of a repository with planted faults."""
    t = turns(spark, d).where("object_id is not null")
    docs = inventory.build(t).select(F.col("object_id").cast("long").alias("n"), "raw")
    k = F.col("n") % 16
    root = F.concat(F.lit("root/o"), F.col("n").cast("string"))

    def entry(rows: DataFrame, rel, kind: str = "file", content=None) -> DataFrame:
        data = F.lit(None).cast("binary") if content is None else content.cast("binary")
        return rows.select(F.concat_ws("/", root, rel).alias("path"), F.lit(kind).alias("kind"), F.octet_length(data).cast("long").alias("length"), data.alias("content"))

    lit = F.lit
    first = t.groupBy(F.col("object_id").alias("n"), "digest").agg(F.min(F.struct("vnum", "path")).alias("f"))
    content = first.select("n", F.concat(lit("v"), F.col("f.vnum").cast("string"), lit("/content")).alias("dir"), F.col("f.vnum").alias("v"), F.col("f.path").alias("name"))
    versions = t.select(F.col("object_id").alias("n"), F.concat(lit("v"), F.col("vnum").cast("string")).alias("v")).distinct()
    sidecar = F.when(k == 3, F.concat(F.sha2(lit("x").cast("binary"), 256), lit(" inventory.json\n"))).when(k == 5, lit("abc\n")).otherwise(F.concat(F.sha2(F.col("raw").cast("binary"), 256), lit(" inventory.json\n")))
    parts = [
        entry(docs.where(k != 2), lit("0=ocfl_object_1.1"), content=F.when(k == 1, "ocfl_object_1.0\n").otherwise("ocfl_object_1.1\n")),
        entry(docs.where(k != 15), lit("inventory.json"), content=F.col("raw")),
        entry(docs.where((k != 4) & (k != 15)), lit("inventory.json.sha256"), content=sidecar),
        entry(versions, F.col("v"), "directory"),
        entry(content.select("n", "dir").distinct(), F.col("dir"), "directory"),
        entry(content.where((k != 11) | (F.col("v") != 1)), F.concat_ws("/", "dir", "name")),
        entry(docs.where(k == 6), lit("notes.txt")), entry(docs.where(k == 7), lit("v99"), "directory"),
        entry(docs.where(k == 8), lit("extensions/unknown-extension"), "directory"), entry(docs.where(k == 9), lit("extensions/file")),
        entry(docs.where(k == 10), lit("v1/content/stray")), entry(docs.where(k == 12), lit("v1/readme")),
        entry(docs.where(k == 13), lit("v1/other"), "directory"), entry(docs.where(k == 14), lit("v1/content/empty"), "directory"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return saved(spark, out, "tree")


# --- repositories


@query(f"with {SQL_O} select root from o where k <> 2")
def object_roots(spark, d):
    return repository.object_roots(tree(spark, d))


@query(f"with {SQL_O} select n::varchar object_id, root from o where k not in (2, 15)")
def list_repository(spark, d):
    return repository.list_objects(tree(spark, d))


@query("select distinct conv_id n, 'root/o' || conv_id root, conv_id % 16 <> 2 present from conversations where conv_id is not null union all select -1, 'root/none', false")
def contains_object(spark, d):
    wanted = table(spark, d, "conversations").where("conv_id is not null").select(F.col("conv_id").alias("n")).distinct().union(spark.range(-1, 0).toDF("n"))
    root = F.when(F.col("n") < 0, "root/none").otherwise(F.concat(F.lit("root/o"), F.col("n").cast("string")))
    return repository.contains(tree(spark, d), wanted.withColumn("root", root)).select("n", "root", "present")


@query(f"with {SQL_O} select root, '0=ocfl_object_1.1' name, case when k = 1 then 'E007' end code from o where k <> 2")
def declarations(spark, d):
    return repository.declarations(tree(spark, d))


@query(f"with {SQL_O} select root, case k when 3 then 'E060' when 4 then 'E058' else 'E061' end code, 'inventory.json' subject from o where k in (3, 4, 5)")
def sidecar_check(spark, d):
    f = tree(spark, d)
    return repository.sidecar_issues(repository.below(f, repository.object_roots(f)))


@query(f"with {SQL_O}, {SQL_M} select root, 'v1' as version, n::varchar object_id from o where k not in (2, 15) and versions = 1 union all select root, 'v1', null from o where k not in (2, 15) and versions > 1")
def inventory_bytes(spark, d):
    f = tree(spark, d)
    entries = repository.below(f, repository.object_roots(f))
    wanted = repository.inventories(entries).select("root", F.lit("v1").alias("version"))
    return repository.inventory_of_version(entries, wanted).select("root", "version", F.get_json_object("raw", "$.id").alias("object_id"))


@query(f"with {SQL_O}, {SQL_M} select root, count(*) directories from (select root, n from o where k <> 2) join (select n, 'v' || v d from (select distinct object_id n, vnum v from turns)  union all select n, 'v99' from o where k = 7 union all select n, 'extensions' from o where false) using (n) group by root")
def directory_listing(spark, d):
    f = tree(spark, d)
    top = repository.children(repository.below(f, repository.object_roots(f))).where("kind = 'directory'")
    return top.groupBy("root").agg(F.count("*").alias("directories"))


_FOUND = {6: ("E001", "'notes.txt'"), 7: ("E046", "'v99'"), 8: ("W013", "'extensions/unknown-extension'"), 9: ("E067", "'extensions/file'"), 10: ("E023", "'v1/content/stray'"), 12: ("E015", "'v1/readme'"), 13: ("W002", "'v1/other'"), 14: ("E024", "'v1/content/empty'")}
_ONES = " union all ".join(f"select root, '{c}' code, {s} subject from o where k = {k}" for k, (c, s) in _FOUND.items())


@query(f"""with {SQL_O}, {SQL_M} {_ONES} union all select root, 'E007', '0=ocfl_object_1.1' from o where k = 1
union all select root, case k when 3 then 'E060' when 4 then 'E058' else 'E061' end, 'inventory.json' from o where k in (3, 4, 5)
union all select root, 'E063', 'inventory.json' from o where k = 15
union all select root, 'E092', rel from o join m using (n) where k = 11 and v = 1
union all select distinct root, 'W003', 'v1/content' from o join m using (n) where k = 11 and v = 1
union all select distinct root, 'W010', 'v' || vnum from o join turns on turns.object_id = o.n where k not in (2, 15)""")
def object_issues(spark, d):
    return repository.object_issues(tree(spark, d))


# --- update logs: on each user's head state, by three operations of one log


def _log(spark, d):
    o = ops(spark, d)
    s, h = state.state_as_of(o), state.heads(o)
    every = h.select("object_id", F.col("head").alias("expected_head"))
    n = F.col("object_id") % 4
    lit, null = F.lit, F.lit(None).cast("string")
    rows = lambda w, seq, op, path, to, digest, over: every.where(w).select("object_id", lit(seq).cast("long").alias("seq"), lit(op).alias("op"), path.alias("path"), to.alias("to"), digest.alias("digest"), lit(over).alias("overwrite"), (F.col("expected_head") - F.when(F.col("object_id") % 8 == 3, 1).otherwise(0)).alias("expected_head"))
    log = rows(n == 0, 1, "clear", null, null, null, False).union(rows(n == 0, 2, "add", lit("g"), null, lit("d"), False)).union(rows(n == 0, 3, "rename", lit("g"), lit("h"), null, False))
    log = log.union(rows(n == 1, 1, "remove", lit("f1"), null, null, False)).union(rows(n == 1, 2, "add", lit("f2"), null, lit("e"), True))
    log = log.union(rows(n == 2, 1, "add", lit("f3"), null, lit("c"), False)).union(rows(n == 3, 1, "remove", lit("zz"), null, null, False))
    return s, h, log


@query(f"""with {STATES}
select object_id, head + 1 vnum, 'h' path, 'd' digest from heads where object_id % 4 = 0
union all select s.object_id, h.head + 1, s.path, s.digest from head_state s join heads h using (object_id) where object_id % 4 = 1 and path not in ('f1', 'f2')
union all select object_id, head + 1, 'f2', 'e' from heads where object_id % 4 = 1
union all select s.object_id, h.head + 1, s.path, s.digest from head_state s join heads h using (object_id) where object_id % 4 = 2 and object_id not in (select object_id from head_state where path = 'f3')
union all select object_id, head + 1, 'f3', 'c' from heads where object_id % 4 = 2 and object_id not in (select object_id from head_state where path = 'f3')
union all select h.object_id, h.head + 1, s.path, s.digest from heads h left join head_state s using (object_id) where h.object_id % 8 = 7""")
def update_log_state(spark, d):
    return updates.apply(*_log(spark, d))


@query(f"""with {STATES} select object_id, 1::bigint seq, 'exists' code from head_state where object_id % 4 = 2 and path = 'f3'
union all select object_id, 1, 'out_of_sync' from heads where object_id % 8 = 3""")
def update_log_errors(spark, d):
    return updates.errors(*_log(spark, d))


@query(f"""with {STATES}, {MANIFEST} select object_id, 'd' digest, head + 1 content_vnum, 'v' || (head + 1) || '/content/h' content_path from heads where object_id % 4 = 0
union all select object_id, 'e', head + 1, 'v' || (head + 1) || '/content/f2' from heads where object_id % 4 = 1
union all select object_id, 'c', head + 1, 'v' || (head + 1) || '/content/f3' from heads where object_id % 4 = 2 and object_id not in (select object_id from head_state where path = 'f3')""")
def update_new_content(spark, d):
    return updates.new_content(state.manifest(ops(spark, d)), updates.apply(*_log(spark, d)))


@query(f"with {STATES} select * from head_state where object_id % 3 <> 0")
def purge_object(spark, d):
    s = state.state_as_of(ops(spark, d))
    return tables.purge(s, s.where("object_id % 3 = 0"))


@query(f"with {STATES}, {MANIFEST} select s.object_id, s.vnum, s.path, s.digest, m.content_path from states s join heads h using (object_id) left join manifest m on m.object_id = s.object_id and m.digest = s.digest where s.vnum = (h.head + 1) // 2")
def export_version(spark, d):
    o = ops(spark, d)
    wanted = state.heads(o).select("object_id", F.floor((F.col("head") + 1) / 2).alias("vnum"))
    return tables.export_version(state.version_state(o), state.manifest(o), wanted)


@query(f"with {OPS} select distinct object_id from ops where object_id % 5 = 0")
def import_conflicts(spark, d):
    h = state.heads(ops(spark, d))
    return tables.import_conflicts(h, h.select("object_id").where("object_id % 5 = 0").union(spark.range(-3, 0).toDF("object_id")))


@query(f"""with {TURNS}, h as (select object_id, max(vnum) head from turns where object_id is not null group by 1 having head > 1)
select object_id, 'algorithm' as rule from h where object_id % 6 = 1 union all select object_id, 'head' from h where object_id % 6 = 2
union all select object_id, 'state' from h where object_id % 6 = 3 union all select distinct t.object_id, 'manifest' from h join turns t using (object_id) where t.object_id % 6 = 4""")
def import_compatible(spark, d):
    t = turns(spark, d).where("object_id is not null").withColumn("vnum", F.col("vnum").cast("long"))
    head = t.groupBy("object_id").agg(F.max("vnum").alias("head_vnum")).where("head_vnum > 1")
    k, lit = F.col("object_id") % 6, F.lit
    told = lambda h, algorithm: head.select("object_id", lit("t").alias("type"), algorithm.alias("digest_algorithm"), lit("content").alias("content_dir"), h.alias("head_vnum"))
    new = told(F.col("head_vnum") + F.when(k == 2, 1).otherwise(0), F.when(k == 1, "sha512").otherwise("sha256"))
    before = t.join(head, "object_id").where("vnum < head_vnum").drop("head_vnum")
    now = t.join(head, "object_id").drop("head_vnum").withColumn("digest", F.when((k == 3) & (F.col("vnum") == 1), F.md5("digest")).otherwise(F.col("digest")))
    m = t.join(head, "object_id").groupBy("object_id", "digest").agg(F.min(F.struct("vnum", "path")).alias("f"))
    m = m.select("object_id", "digest", F.col("f.vnum").alias("v"), F.concat(lit("v"), F.col("f.vnum").cast("string"), lit("/content/"), F.col("f.path")).alias("content_path"))
    old = m.join(head, "object_id").where("v < head_vnum").select("object_id", "digest", "content_path")
    moved = m.join(head, "object_id").withColumn("content_path", F.when((k == 2) & (F.col("v") == F.col("head_vnum")), F.concat(lit("v"), (F.col("head_vnum") + 1).cast("string"), lit("/x"), F.substring_index("content_path", "/", -1))).when(k == 4, F.concat(lit("w"), "content_path")).otherwise(F.col("content_path")))
    return tables.incompatible(new, told(F.col("head_vnum") - 1, lit("sha256")), now, before, moved.select("object_id", "digest", "content_path"), old)


@query(f"""with {OPS}, {MANIFEST}, h as (select object_id, max(vnum) head from ops group by 1), n as (select m.* from manifest m join h using (object_id) where content_vnum = head)
select object_id, content_path, 'missing' problem from n where object_id % 3 = 0 union all select object_id, 'v' || head || '/content/stray', 'unexpected' from h where object_id % 4 = 0""")
def staged_content_check(spark, d):
    o = ops(spark, d)
    m, h = state.manifest(o), state.heads(o)
    staged = m.where("object_id % 3 != 0").join(h, "object_id").where("content_vnum = head").select("object_id", "content_path")
    stray = h.where("object_id % 4 = 0").select("object_id", F.concat(F.lit("v"), F.col("head").cast("string"), F.lit("/content/stray")).alias("content_path"))
    return tables.staged_issues(staged.union(stray), m, h)


@query(f"with {STATES}, {MANIFEST} select object_id, digest, content_vnum, content_path from manifest m join heads h using (object_id) where content_vnum <> head or exists (select 1 from head_state s where s.object_id = m.object_id and s.digest = m.digest and s.path <> 'f1')")
def manifest_pruned(spark, d):
    o = ops(spark, d)
    s = mutate.remove(state.state_as_of(o), state.state_as_of(o).where("path = 'f1'"))
    return tables.pruned(state.manifest(o).join(state.heads(o), "object_id"), s, F.col("head")).drop("head")


# --- mutable head


def _staged(spark, d) -> DataFrame:
    o = ops(spark, d)
    m = state.manifest(o).join(state.heads(o), "object_id").withColumn("mutable", F.lit(False))
    new = F.col("content_vnum") == F.col("head")
    return m.where(~new).unionByName(tables.stage(m.where(new), F.col("head") % 3 + 1))


_STAGED = f"{OPS}, {MANIFEST}, h as (select object_id, max(vnum) head from ops group by 1), st as (select m.object_id, m.digest, content_vnum = head mutable, case when content_vnum = head then 'extensions/0005-mutable-head/head/content/r' || (head % 3 + 1) || '/' || split_part(content_path, '/', -1) else content_path end content_path from manifest m join h using (object_id))"


@query(f"with {_STAGED} select object_id, digest, mutable, content_path from st")
def stage_changes(spark, d):
    return _staged(spark, d).select("object_id", "digest", "mutable", "content_path")


@query(f"with {_STAGED} select object_id, digest, content_path from st where not mutable")
def purge_staged(spark, d):
    return tables.purge_staged(_staged(spark, d)).select("object_id", "digest", "content_path")


@query(f"with {_STAGED} select object_id, bool_or(mutable) staged from st group by 1")
def has_staged(spark, d):
    return tables.has_staged(_staged(spark, d))


@query(f"with {_STAGED} select object_id, content_path || '.old' content_path from st where mutable")
def mutable_orphans(spark, d):
    m = _staged(spark, d)
    both = m.select("object_id", "content_path").union(m.select("object_id", F.concat("content_path", F.lit(".old"))))
    return tables.orphans(both, m)


@query("with c as (select distinct conv_id object_id, turn + 1 r from conversations where conv_id is not null) select object_id, 'r' || r as name from c where r < (select max(r) from c x where x.object_id = c.object_id)")
def stale_markers(spark, d):
    c = table(spark, d, "conversations").where("conv_id is not null").select(F.col("conv_id").alias("object_id"), F.concat(F.lit("r"), (F.col("turn") + 1).cast("string")).alias("name")).distinct()
    return tables.stale_markers(c)


# --- fixity


def _fixity(spark, d):
    f = files(spark, d)
    s = f.select("object_id", "path", "digest")
    m = f.groupBy("object_id", "digest").agg(F.min("path").alias("content_path"))
    bad = F.col("path").cast("long") % 10 == 3
    md5 = digests.digest(F.col("content"), "md5")
    asked = f.select("object_id", "path", F.lit("md5").alias("algorithm"), F.when(bad, F.lit("00")).otherwise(F.upper(md5)).alias("value"), md5.alias("actual"))
    return s, m, asked.union(f.select("object_id", "path", F.lit("sha256"), F.when(bad, F.lit("00")).otherwise(F.col("digest")), F.lit(None).cast("string")))


@query(f"with {FILES}, m as (select object_id, digest, min(path) content_path from files group by all) select distinct object_id, 'md5' algorithm, md5(text) digest, content_path from files join m using (object_id, digest) where path::bigint % 10 <> 3")
def fixity_added(spark, d):
    return tables.add_fixity(*_fixity(spark, d), default="sha256")[0]


@query(f"with {FILES} select object_id, path, unnest(['md5', 'sha256']) algorithm, 'mismatch' problem from files where path::bigint % 10 = 3 and digest is not null and object_id is not null union all select object_id, path, unnest(['md5', 'sha256']), 'missing' from files where digest is null or object_id is null")
def fixity_refused(spark, d):
    return tables.add_fixity(*_fixity(spark, d), default="sha256")[1]


@query(f"with {FILES}, m as (select object_id, digest, min(path) content_path, any_value(text) text from files where digest is not null and object_id is not null group by all) select object_id, content_path, 'md5=' || md5(text) || ',size=' || octet_length(encode(text)) fixity from m")
def fixity_of_paths(spark, d):
    f = files(spark, d).where("digest is not null and object_id is not null")
    one = f.groupBy("object_id", "digest").agg(F.min_by(F.struct("path", "content"), "path").alias("c"))
    rows = one.select("object_id", F.col("c.path").alias("content_path"), F.explode(F.create_map(F.lit("md5"), F.md5("c.content"), F.lit("size"), F.octet_length("c.content").cast("string"))).alias("algorithm", "digest"))
    found = tables.fixity_of_paths(rows.select("object_id", "algorithm", "digest", "content_path"))
    return found.select("object_id", "content_path", F.concat_ws(",", F.transform(F.array_sort(F.map_entries("fixity")), lambda e: F.concat_ws("=", e["key"], e["value"]))).alias("fixity"))


@query(f"with {FILES} select object_id, path content_path, 'md5' algorithm, 'E093' code from files where path::bigint % 20 = 4 union all select object_id, path, 'sha256', 'E092' from files where path::bigint % 20 = 5")
def fixity_issues(spark, d):
    f, k = files(spark, d).where("digest is not null and object_id is not null"), F.col("path").cast("long") % 20
    actual = f.select("object_id", F.col("path").alias("content_path"), F.explode(F.create_map(F.lit("md5"), F.md5("content"), F.lit("sha256"), F.col("digest"))).alias("algorithm", "actual"))
    n = F.col("content_path").cast("long") % 20
    wrong = ((n == 4) & (F.col("algorithm") == "md5")) | ((n == 5) & (F.col("algorithm") == "sha256"))
    return tables.fixity_issues(actual.select("object_id", "content_path", "algorithm", F.when(wrong, F.lit("00")).otherwise(F.upper("actual")).alias("digest")), actual)


@query(f"with {OPS}, {MANIFEST} select distinct object_id, digest from manifest where content_vnum = 1")
def digests_under_prefix(spark, d):
    return tables.digests_under(state.manifest(ops(spark, d)), "v1")


# --- older inventories


def _chain(spark, d) -> DataFrame:
    t = turns(spark, d).where("object_id is not null").withColumn("vnum", F.col("vnum").cast("long"))
    inv = t.select("object_id", F.col("vnum").alias("inv_vnum")).distinct()
    rows = t.join(inv, "object_id").where("vnum <= inv_vnum")
    k, damaged = F.col("object_id") % 5, (F.col("object_id") % 5 == 1) & (F.col("inv_vnum") == 2) & (F.col("vnum") == 1)
    other = (k == 2) & (F.col("inv_vnum") == 1)
    return rows.withColumns({"algorithm": F.when(other, "sha512").otherwise("sha256"), "digest": F.when(damaged, F.md5("digest")).when(other, F.lit("x")).otherwise(F.upper("digest"))})


@query(f"with {TURNS}, h as (select object_id, max(vnum) head from turns group by 1) select object_id, case when head > 2 then 2 else 1 end::bigint inv_vnum, 1::bigint vnum, path, 'E066' code from turns join h using (object_id) where vnum = 1 and object_id % 5 = 1 and exists (select 1 from turns x where x.object_id = turns.object_id and x.vnum = 2)")
def inventory_chain(spark, d):
    return tables.chain_issues(_chain(spark, d).select("object_id", "inv_vnum", "algorithm", "vnum", "path", "digest"))


@query(f"with {SQL_M}, i as (select distinct object_id n, vnum iv from turns where object_id is not null) select n object_id, 'sha256' algorithm, rel content_path, case when n % 3 = 0 and max(iv) = v then md5(any_value(digest)) else any_value(digest) end digest from m join i using (n) where iv >= v group by n, rel, v")
def manifests_by_algorithm(spark, d):
    return tables.manifests_by_algorithm(_manifests(spark, d))


def _manifests(spark, d) -> DataFrame:
    t = turns(spark, d).where("object_id is not null").withColumn("vnum", F.col("vnum").cast("long"))
    m = t.groupBy("object_id", "digest").agg(F.min(F.struct("vnum", "path")).alias("f"))
    m = m.select("object_id", "digest", F.col("f.vnum").alias("v"), F.concat(F.lit("v"), F.col("f.vnum").cast("string"), F.lit("/content/"), F.col("f.path")).alias("content_path"))
    rows = m.join(t.select("object_id", F.col("vnum").alias("inv_vnum")).distinct(), "object_id").where("inv_vnum >= v")
    changed = (F.col("object_id") % 3 == 0) & (F.col("inv_vnum") == F.col("v"))
    return rows.select("object_id", "inv_vnum", F.lit("sha256").alias("algorithm"), "content_path", F.when(changed, F.md5("digest")).otherwise(F.col("digest")).alias("digest"))


@query(f"with {SQL_M}, h as (select object_id n, max(vnum) head from turns group by 1) select n object_id, v::bigint inv_vnum, rel content_path, 'E092' code from m join h using (n) where n % 3 = 0 and head > v")
def older_manifests(spark, d):
    return tables.manifest_issues(_manifests(spark, d))


# --- details table


def _details(spark, d) -> DataFrame:
    h = state.heads(ops(spark, d))
    text, r = F.lit(None).cast("string"), F.col("object_id") % 4
    return h.select("object_id", F.concat(F.lit("v"), F.col("head").cast("string")).alias("version_id"), F.concat(F.lit("o/"), F.col("object_id").cast("string")).alias("object_root_path"), F.when(r == 1, "r2").alias("revision_id"), F.sha2(F.col("head").cast("string").cast("binary"), 256).alias("inventory_digest"), F.lit("sha256").alias("digest_algorithm"), text.cast("binary").alias("inventory"), F.lit(None).cast("timestamp").alias("update_timestamp"), "head")


def _next_details(details: DataFrame) -> DataFrame:
    """Next versions; for users of rest 1 a next revision, for rest 3 a version too far, for rest 5 of 8 a revision too far."""
    k = F.col("object_id")
    version = F.when(k % 4 == 1, F.col("version_id")).otherwise(F.concat(F.lit("v"), (F.col("head") + F.when(k % 4 == 3, 2).otherwise(1)).cast("string")))
    revision = F.when(k % 8 == 5, "r5").when(k % 4 == 1, "r3")
    return details.withColumns({"version_id": version, "revision_id": revision, "inventory_digest": F.lit("new")})


@query(f"with {OPS}, h as (select object_id, max(vnum) head from ops group by 1) select object_id, case when object_id % 4 in (0, 2) then 'v' || (head + 1) else 'v' || head end version_id, case when object_id % 8 = 1 then 'r3' when object_id % 4 = 1 then 'r2' end revision_id, case when object_id % 4 in (0, 2) or object_id % 8 = 1 then 'new' else sha256(head::varchar) end inventory_digest from h")
def details_upsert(spark, d):
    now = _details(spark, d)
    return tables.upsert_details(now, _next_details(now)).select("object_id", "version_id", "revision_id", "inventory_digest")


@query(f"with {OPS} select distinct object_id from ops where object_id % 4 = 3 or object_id % 8 = 5")
def details_out_of_sync(spark, d):
    now = _details(spark, d)
    return tables.out_of_sync(now, _next_details(now))


@query(f"with {OPS}, h as (select object_id, max(vnum) head from ops group by 1) select object_id, 'v' || head version_id, sha256(head::varchar) inventory_digest from h where object_id % 7 = 0")
def details_select(spark, d):
    return tables.select_details(_details(spark, d), state.heads(ops(spark, d)).where("object_id % 7 = 0")).select("object_id", "version_id", "inventory_digest")


@query(f"with {OPS} select distinct object_id from ops where object_id % 7 <> 0")
def details_delete(spark, d):
    return tables.delete_details(_details(spark, d), state.heads(ops(spark, d)).where("object_id % 7 = 0")).select("object_id")


# --- paths of inventories


@query("""with p as (select page_id, case page_id % 7 when 1 then '/a/b' when 2 then 'a//b' when 3 then 'a/../b' when 4 then 'a/' when 5 then 'x/y' else 'p/' || page_id end path from pages)
select page_id // 7 g, path, code from (select page_id, path, case page_id % 7 when 1 then 'E100' when 4 then 'E100' when 2 then 'E099' when 3 then 'E099' end code from p) where code is not null
union all select page_id // 7, 'x', 'E101' from p where page_id % 7 = 5
union all select page_id // 7, 'a/', 'E101' from p where page_id % 7 = 4 and page_id - 2 in (select page_id from pages)""")
def inventory_path_issues(spark, d):
    k = F.col("page_id") % 7
    path = F.when(k == 1, "/a/b").when(k == 2, "a//b").when(k == 3, "a/../b").when(k == 4, "a/").when(k == 5, "x/y").otherwise(F.concat(F.lit("p/"), F.col("page_id").cast("string")))
    p = table(spark, d, "pages").select("page_id", F.floor(F.col("page_id") / 7).alias("g"), path.alias("path"))
    rows = p.select("g", "path").union(p.where("page_id % 7 = 5").select("g", F.lit("x")))
    return tables.path_issues(rows, ["g"], "E100", "E099", "E101").where(~F.col("path").isin("a", "/a", "p", "", "a/.."))


def _mapped(preset: str):
    def f(spark, d):
        return table(spark, d, "pages").select(F.col("url").alias("path"), paths.mapped(F.col("url"), preset).alias("mapped"))

    f.__name__ = f"logical_path_mapping_{preset}"
    return f


def _register_mappers() -> None:
    from palimpsest.plans.registry import _sql_encode

    for preset, chars in (("windows", paths.ENCODE_WINDOWS), ("linux", paths.ENCODE_LINUX), ("cloud", paths.ENCODE_CLOUD)):
        given = " || ".join(f"chr({ord(c)})" for c in "%" + chars)
        query(f"select url path, {_sql_encode('url', f'not contains({given}, c)')} mapped from pages")(_mapped(preset))


_register_mappers()
