"""Every query of the engine with its DuckDB SQL. A query and its SQL share a name and column names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import digests, layouts, paths, versions
from palimpsest.operators import documents, integrity, mutate, state
from palimpsest.runtime import ship, table
from palimpsest.sources import inventory, oplog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

OPS = "ops as (select user_id object_id, row_number() over (partition by user_id order by ts, event_id)::bigint vnum, 'f' || (event_id % 7) path, event_type = 'error' removed, sha256(props) digest, ts created from events)"
#: State of every version: for each version and path, the last operation up to it.
STATES = f"""{OPS}, last as (select v.object_id, v.vnum, o.path, arg_max(o.digest, o.vnum) digest, arg_max(o.removed, o.vnum) removed
  from ops v join ops o on o.object_id = v.object_id and o.vnum <= v.vnum group by all),
states as (select object_id, vnum, path, digest from last where not removed),
heads as (select object_id, max(vnum) head from ops group by object_id),
head_state as (select s.object_id, s.path, s.digest from states s join heads h on s.object_id = h.object_id and s.vnum = h.head)"""
MANIFEST = """manifest as (select object_id, digest, min(vnum) content_vnum,
  'v' || min(vnum) || '/content/' || arg_min(path, (vnum, path)) content_path from ops where not removed group by object_id, digest)"""
FILES = "files as (select lang object_id, doc_id::varchar path, sha256(text) digest, octet_length(encode(text)) size, text from documents)"
TURNS = "turns as (select conv_id object_id, turn + 1 vnum, role path, sha256(text) digest from conversations)"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def ops(spark, d) -> DataFrame:
    return oplog.event_ops(table(spark, d, "events"))


def files(spark, d) -> DataFrame:
    return oplog.document_files(table(spark, d, "documents"))


def turns(spark, d) -> DataFrame:
    return oplog.turn_states(table(spark, d, "conversations"))


# --- states and histories


@query(f"with {STATES} select object_id, vnum, path, digest from states")
def version_state(spark, d):
    return state.version_state(ops(spark, d))


@query(f"with {STATES} select * from head_state")
def head_state(spark, d):
    return state.state_as_of(ops(spark, d))


@query(f"with {STATES} select s.object_id, s.path, s.digest from states s join heads h using (object_id) where s.vnum = h.head // 2")
def state_as_of_middle(spark, d):
    return state.state_as_of(ops(spark, d), F.floor(F.col("head") / 2))


@query(f"""with {STATES}, grid as (select v.object_id, v.vnum, p.path, s.digest from ops v join (select distinct object_id, path from ops) p using (object_id)
  left join states s on s.object_id = v.object_id and s.vnum = v.vnum and s.path = p.path),
c as (select *, lag(digest) over (partition by object_id, path order by vnum) before from grid)
select object_id, path, vnum, case when digest is null then 'REMOVE' else 'UPDATE' end change, digest from c where digest is distinct from before""")
def file_change_history(spark, d):
    return state.file_changes(ops(spark, d)).drop("back")


@query(f"with {STATES} select distinct object_id, path from ops where not removed except select object_id, path from head_state")
def removed_files(spark, d):
    o = ops(spark, d)
    return o.where(~F.col("removed")).select("object_id", "path").distinct().join(state.state_as_of(o), ["object_id", "path"], "left_anti")


@query(f"""with {OPS}, c as (select *, lag(removed) over (partition by object_id, path order by vnum) before from ops)
select object_id, path, vnum, digest from c where not removed and before""")
def reinstated_files(spark, d):
    return state.file_changes(ops(spark, d)).where("back").select("object_id", "path", "vnum", "digest")


@query(f"""with {STATES}, a as (select s.object_id, path, digest from states s join heads h using (object_id) where s.vnum = h.head // 2)
select object_id, path, a.digest old_digest, b.digest new_digest, case when a.digest is null then 'ADDED' when b.digest is null then 'REMOVED' else 'MODIFIED' end status
from a full join head_state b using (object_id, path) where a.digest is distinct from b.digest""")
def state_diff_between_versions(spark, d):
    o = ops(spark, d)
    return state.state_diff(state.state_as_of(o, F.floor(F.col("head") / 2)), state.state_as_of(o)).select("object_id", "path", "old_digest", "new_digest", "status")


@query(f"""with {STATES}, n as (select object_id, count(*) files, count(distinct digest) digests from head_state group by object_id)
select o.object_id, max(vnum) head, min(created) first_created, max(created) last_created, coalesce(any_value(files), 0) files, coalesce(any_value(digests), 0) digests
from ops o left join n using (object_id) group by o.object_id""")
def describe_object(spark, d):
    o = ops(spark, d)
    n = state.state_as_of(o).groupBy("object_id").agg(F.count("*").alias("files"), F.countDistinct("digest").alias("digests"))
    v = o.groupBy("object_id").agg(F.max("vnum").alias("head"), F.min("created").alias("first_created"), F.max("created").alias("last_created"))
    return v.join(n, "object_id", "left").fillna(0, ["files", "digests"])


@query(f"with {STATES} select o.object_id, o.vnum, o.created, count(s.path) files from ops o left join states s using (object_id, vnum) group by all")
def describe_version(spark, d):
    o = ops(spark, d)
    n = state.version_state(o).groupBy("object_id", "vnum").agg(F.count("*").alias("files"))
    return o.select("object_id", "vnum", "created").join(n, ["object_id", "vnum"], "left").fillna(0, ["files"])


@query(f"with {STATES}, {MANIFEST} select h.object_id, h.path, case when h.object_id % 3 = 0 then upper(h.digest) else h.digest end digest, case when m.digest is not null then 'objects/' || h.object_id || '/' || m.content_path end storage_path, m.digest is null missing from head_state h left join manifest m on m.object_id = h.object_id and m.digest = h.digest and not (h.object_id % 5 = 0 and m.content_vnum = 1)")
def file_details(spark, d):
    o = ops(spark, d)
    s = state.state_as_of(o).withColumn("digest", F.when(F.col("object_id") % 3 == 0, F.upper("digest")).otherwise(F.col("digest")))
    return state.file_details(s, state.manifest(o).where("not (object_id % 5 = 0 and content_vnum = 1)"), F.concat(F.lit("objects/"), F.col("object_id").cast("string")))


@query(f"with {OPS}, {MANIFEST} select object_id, digest, content_vnum, content_path from manifest")
def content_path_lookup(spark, d):
    return state.manifest(ops(spark, d))


@query(f"with {OPS} select object_id, max(vnum) head, count(*) > 0 present from ops group by object_id")
def list_objects(spark, d):
    return state.heads(ops(spark, d)).withColumn("present", F.lit(True))


@query(f"with {OPS}, {MANIFEST} select v.object_id, v.vnum, count(m.digest) n_paths from ops v left join manifest m on m.object_id = v.object_id and m.content_vnum <= v.vnum group by all")
def content_visible_to_version(spark, d):
    o = ops(spark, d)
    return integrity.visible_content(state.manifest(o), o)


# --- content


@query(f"with {FILES} select object_id, digest, min(path) content_path, count(*) copies from files group by object_id, digest")
def manifest_dedup(spark, d):
    return integrity.content_groups(files(spark, d)).drop("saved_bytes")


@query(f"with {FILES} select object_id, sum(s)::bigint saved_bytes, count(*) distinct_contents from (select object_id, digest, sum(size) - max(size) s from files group by all) group by object_id")
def dedup_savings_bytes(spark, d):
    return integrity.content_groups(files(spark, d)).groupBy("object_id").agg(F.sum("saved_bytes").alias("saved_bytes"), F.count("*").alias("distinct_contents"))


@query(f"with {FILES} select object_id, path, md5(text) md5, sha1(text) sha1, sha256(text) sha256, size::varchar size from files")
def fixity_builtin(spark, d):
    return files(spark, d).select("object_id", "path", *(digests.digest(F.col("content"), a).alias(a) for a in ("md5", "sha1", "sha256", "size")))


@query()
def fixity_blake2b(spark, d):
    ship(spark)
    names = ("blake2b-512", "blake2b-384", "blake2b-256", "blake2b-160", "sha512/256")
    return files(spark, d).select("object_id", "path", *(digests.digest(F.col("content"), a).alias(a.replace("-", "_").replace("/", "_")) for a in names))


@query(f"with {FILES} select object_id, path, sha256(text) actual, upper(case when path::bigint % 100 = 7 then sha256(text || '!') else digest end) expected from files where path::bigint % 100 = 7")
def fixity_check(spark, d):
    damaged = F.col("path").cast("long") % 100 == 7
    f = files(spark, d).select("object_id", "path", digests.digest(F.col("content"), "sha256").alias("actual"), F.upper(F.when(damaged, F.sha2(F.concat("content", F.lit("!").cast("binary")), 256)).otherwise(F.col("digest"))).alias("expected"))
    return f.where(~digests.matches(F.col("actual"), F.col("expected")))


@query(f"with {FILES} select object_id, path, lower(substr(hex(encode(text)), 21, 40)) part from files where octet_length(encode(text)) >= 30")
def range_read(spark, d):
    return files(spark, d).where(F.octet_length("content") >= 30).select("object_id", "path", F.lower(F.hex(F.substring("content", 11, 20))).alias("part"))


# --- mutations


@query(f"with {STATES} select s.object_id, h.head + 1 vnum, s.path, s.digest from states s join heads h using (object_id) where s.vnum = (h.head + 1) // 2")
def replicate_as_head(spark, d):
    o = ops(spark, d)
    return mutate.replicate(state.version_state(o), state.heads(o).withColumn("at", F.floor((F.col("head") + 1) / 2)))


@query(f"with {STATES} select s.object_id, s.vnum, s.path, s.digest from states s join heads h using (object_id) where s.vnum <= h.head // 2")
def rollback(spark, d):
    o = ops(spark, d)
    return mutate.rollback(state.version_state(o), state.heads(o).withColumn("at", F.floor(F.col("head") / 2)))


@query(f"with {STATES}, n as (select object_id, 'g' || vnum path, digest from ops where vnum <= 2 and object_id % 2 = 0) select * from head_state where object_id not in (select object_id from n) union all select * from n")
def put_replace_state(spark, d):
    o = ops(spark, d)
    new = o.where("vnum <= 2 and object_id % 2 = 0").select("object_id", F.concat(F.lit("g"), F.col("vnum").cast("string")).alias("path"), "digest")
    return mutate.put(state.state_as_of(o), new)


@query(f"with {STATES}, moved as (select object_id, digest from head_state where path = 'f1') select object_id, path, digest from head_state where path <> 'f1' and not (path = 'f2' and object_id in (select object_id from moved)) union all select object_id, 'f2', digest from moved")
def rename(spark, d):
    s = state.state_as_of(ops(spark, d))
    return mutate.rename(s, s.where("path = 'f1'").select("object_id", "path", F.lit("f2").alias("to")))


@query(f"with {STATES} select object_id, path from head_state where path = 'f2' and object_id in (select object_id from head_state where path = 'f1')")
def overwrite_violations(spark, d):
    s = state.state_as_of(ops(spark, d))
    return mutate.overwrites(s, s.where("path = 'f1'").select("object_id", F.lit("f2").alias("path")))


@query(f"with {STATES} select object_id, path, digest from head_state where path <> 'f3'")
def remove_file(spark, d):
    s = state.state_as_of(ops(spark, d))
    return mutate.remove(s, s.where("path = 'f3'"))


@query(f"""with {STATES}, old as (select s.object_id, s.path, s.digest from states s where s.vnum = 1)
select object_id, path, digest from head_state h where not exists (select 1 from old where old.object_id = h.object_id and old.path = h.path) union all select * from old""")
def reinstate_first_version(spark, d):
    o = ops(spark, d)
    old = state.state_as_of(o, F.lit(1))
    return mutate.reinstate(state.state_as_of(o), old, old.select("object_id", "path", F.col("path").alias("to")))


@query(f"""with {OPS}, {MANIFEST}, h as (select object_id, max(vnum) head from ops group by 1) select object_id, digest, content_path from manifest""")
def mutable_commit_rewrite(spark, d):
    o = ops(spark, d)
    m = state.manifest(o).join(state.heads(o), "object_id").withColumn("mutable", F.col("content_vnum") == F.col("head"))
    staged = F.concat(F.lit("extensions/0005-mutable-head/head/content/"), F.substring_index("content_path", "/", -1))
    return mutate.commit_mutable_head(m.withColumn("content_path", F.when(F.col("mutable"), staged).otherwise(F.col("content_path"))))


@query("select conv_id object_id, max(turn + 1)::bigint revision from conversations group by conv_id")
def latest_revision(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("object_id"), F.concat(F.lit("r"), (F.col("turn") + 1).cast("string")).alias("name"))
    return c.groupBy("object_id").agg(F.max(versions.revision(F.col("name"))).alias("revision"))


# --- layouts and paths

NAMES = "(select c_name id from customer)"


def names(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_name").alias("id"))


@query("select id, case when contains(id, '/') or id = 'extensions' then null else id end root from (select case c_custkey % 5 when 1 then 'extensions' when 2 then 'EXTENSIONS' when 3 then 'a/' || c_name when 4 then '' else c_name end id from customer)")
def layout_flat(spark, d):
    k = F.col("c_custkey") % 5
    given = F.when(k == 1, "extensions").when(k == 2, "EXTENSIONS").when(k == 3, F.concat(F.lit("a/"), "c_name")).when(k == 4, "").otherwise(F.col("c_name"))
    return table(spark, d, "customer").select(given.alias("id"), layouts.mapped(given, "0002-flat-direct-storage-layout").alias("root"))


@query(f"select id, h[1:3] || '/' || h[4:6] || '/' || h[7:9] || '/' || h root from (select id, sha256(id) h from {NAMES})")
def layout_hashed_ntuple(spark, d):
    return names(spark, d).select("id", layouts.hashed_ntuple(F.col("id")).alias("root"))


@query(f"select id, h[1:3] || '/' || h[4:6] || '/' || h[7:9] || '/' || h[10:] root from (select id, sha256(id) h from {NAMES})")
def layout_hashed_ntuple_short(spark, d):
    return names(spark, d).select("id", layouts.hashed_ntuple(F.col("id"), short_root=True).alias("root"))


def _sql_encode(column: str, kept: str) -> str:
    code = "regexp_replace(lower(hex(encode(c))), '(..)', '%\\1', 'g')"
    return f"array_to_string(list_transform(string_split({column}, ''), lambda c: case when {kept} then c when octet_length(encode(c)) >= 3 then upper({code}[1:2]) || {code}[3:] else {code} end), '')"


@query(f"select id, h[1:3] || '/' || h[4:6] || '/' || h[7:9] || '/' || case when length(e) > 100 then e[1:100] || '-' || h else e end root from (select url id, sha256(url) h, {_sql_encode('url', chr(39).join(['regexp_full_match(c, ', '[A-Za-z0-9_-]', ')']))} e from pages)")
def layout_hash_id(spark, d):
    return table(spark, d, "pages").select(F.col("url").alias("id"), layouts.hashed_id(F.col("url")).alias("root"))


@query("select url id, case when split_part(url, '/', -1) in ('', 'extensions') then null else split_part(url, '/', -1) end root from (select case page_id % 5 when 1 then url || '/extensions' when 2 then url || '/Extensions' when 3 then 'extensions' when 4 then url || '/' else url end url from pages)")
def layout_flat_omit_prefix(spark, d):
    k = F.col("page_id") % 5
    url = F.when(k == 1, F.concat("url", F.lit("/extensions"))).when(k == 2, F.concat("url", F.lit("/Extensions"))).when(k == 3, "extensions").when(k == 4, F.concat("url", F.lit("/"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select(url.alias("id"), layouts.flat_omit_prefix(url, "/").alias("root"))


@query(f"select id, p[1:4] || '/' || p[5:8] || '/' || b root from (select id, split_part(id, '#', -1) b, lpad(split_part(id, '#', -1), greatest(8, length(split_part(id, '#', -1)))::int, '0') p from {NAMES})")
def layout_ntuple_omit_prefix(spark, d):
    return names(spark, d).select("id", layouts.ntuple_omit_prefix(F.col("id"), "#", 4, 2).alias("root"))


@query(f"select url path, {_sql_encode('url', chr(39).join(['regexp_full_match(c, ', '[A-Za-z0-9_-]', ')']))} encoded from pages")
def percent_encode(spark, d):
    return table(spark, d, "pages").select(F.col("url").alias("path"), paths.percent_encode(F.col("url"), keep="A-Za-z0-9_-").alias("encoded"))


@query(f"select url path, {_sql_encode('url', 'not contains(' + chr(39) + '%<>:' + chr(34) + chr(92) + '|?* #[]' + chr(39) + ', c)')} mapped from pages")
def logical_path_mapping_all(spark, d):
    return table(spark, d, "pages").select(F.col("url").alias("path"), paths.percent_encode(F.col("url"), encode=paths.ENCODE_ALL).alias("mapped"))


_BASE = "case when starts_with(path, '/') then 'leading_slash' end, case when ends_with(path, '/') then 'trailing_slash' end, case when list_contains(n, '') then 'empty_part' end, case when list_has_any(n, ['.', '..']) then 'dot_part' end"
_ANY = "case when len(list_filter(n, lambda x: {})) > 0 then '{}' end"
_BYTES, _END = _ANY.format("octet_length(encode(x)) > 255", "name_bytes"), _ANY.format("regexp_matches(x, '[ .]$')", "space_or_period_at_end")
_CTRL, _EXT = "case when regexp_matches(path, '[\\x00-\\x1F]') then 'control_char' end", "case when regexp_matches(path, '[\\x{7F}-\\x{A0}]') then 'extended_control_char' end"
_WORDS = _ANY.format("regexp_matches(x, '(?i)^(?:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(?:\\.[^.]+)?$')", "reserved_name")
_LONG = "case when octet_length(encode(path)) > 1024 then 'path_bytes' end"
_CHARS = "case when len(list_filter(n, lambda x: length(x) > {})) > 0 then 'name_chars' end"
_BLOCK = "case when regexp_matches(path, '{}') then 'blocked_char' end"
_RULES = {
    "unix": [_BYTES, "case when contains(path, chr(0)) then 'blocked_char' end"],
    "windows": [_CHARS.format(255), _END, _CTRL, _BLOCK.format('[<>:"\\\\|?*]'), _WORDS],
    "cloud": [_CHARS.format(254), _END, _CTRL, _BLOCK.format("[\\\\#\\[\\]*?]"), _LONG, _EXT],
    "all": [_BYTES, _CHARS.format(254), _END, _CTRL, _BLOCK.format('[<>:"\\\\|?*#\\[\\]]'), _WORDS, _LONG, _EXT],
}


def _constraint_query(preset: str):
    def f(spark, d):
        rows = table(spark, d, "pages").select(F.col("url").alias("path"))
        return rows.select("path", F.array_join(paths.violations(F.col("path"), preset), ",").alias("violations"))

    f.__name__ = f"path_constraints_{preset}"
    rules = ", ".join([_BASE, *_RULES[preset]])
    query(f"select path, array_to_string(list_filter([{rules}], lambda x: x is not null), ',') violations from (select url path, string_split(url, '/') n from pages)")(f)


for _preset in _RULES:
    _constraint_query(_preset)

LINES = "(select o_custkey object_id, 'd' || (o_orderkey % 5) || case when o_orderkey % 3 = 0 then '/e' || (o_orderkey % 7) else '' end path from orders)"


@query(f"with f as (select distinct object_id, path from {LINES}) select distinct a.object_id, a.path from f a join f b on a.object_id = b.object_id and starts_with(b.path, a.path || '/')")
def path_conflict(spark, d):
    k = F.col("o_orderkey")
    path = F.concat(F.lit("d"), (k % 5).cast("string"), F.when(k % 3 == 0, F.concat(F.lit("/e"), (k % 7).cast("string"))).otherwise(""))
    return integrity.path_conflicts(table(spark, d, "orders").select(F.col("o_custkey").alias("object_id"), path.alias("path")))


# --- integrity


@query("with v as (select distinct o_custkey object_id, (o_orderkey % 9) * 1000000000 + 1 vnum from orders), r as (select object_id, vnum, coalesce(lag(vnum) over (partition by object_id order by vnum), 0) p from v) select object_id, p + 1 as first, vnum - 1 as last from r where p + 1 < vnum")
def version_gaps(spark, d):
    return integrity.version_gaps(table(spark, d, "orders").select(F.col("o_custkey").alias("object_id"), (F.col("o_orderkey") % 9 * 1_000_000_000 + 1).alias("vnum")))


@query("select o_custkey object_id, count(distinct case when o_orderkey % 4 = 0 then 3 else 0 end) paddings from orders group by 1 having paddings > 1")
def padding_consistency(spark, d):
    n = F.col("o_orderkey").cast("string")
    v = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("v"), F.lpad((F.col("o_orderkey") % 100).cast("string"), 3, "0"))).otherwise(F.concat(F.lit("v"), n))
    return integrity.mixed_padding(table(spark, d, "orders").select(F.col("o_custkey").alias("object_id"), versions.padding(v).alias("vpad")))


@query(f"with {OPS}, m as (select distinct object_id, digest from ops where vnum % 5 <> 0 and not removed), s as (select distinct object_id, digest from ops where vnum % 7 <> 0 and not removed) select object_id, digest, case when m.digest is null then 'E050' else 'E107' end code from (select *, 1 x from m) m full join (select *, 1 x from s) s using (object_id, digest) where m.x is null or s.x is null".replace("case when m.digest is null", "case when m.x is null"))
def manifest_referential(spark, d):
    o = ops(spark, d).where(~F.col("removed"))
    return integrity.referential(o.where("vnum % 5 != 0"), o.where("vnum % 7 != 0"))


@query(f"with {OPS}, m as (select object_id, case when vnum % 2 = 0 then upper(digest) else digest end digest from ops) select object_id, lower(digest) digest, count(distinct digest) forms from m group by 1, 2 having forms > 1")
def duplicate_digests(spark, d):
    o = ops(spark, d)
    return integrity.duplicate_digests(o.select("object_id", F.when(F.col("vnum") % 2 == 0, F.upper("digest")).otherwise(F.col("digest")).alias("digest")))


@query(f"with {OPS} select object_id, vnum, regexp_full_match(lower(x), '[0-9a-f]{{64}}') fine from (select object_id, vnum, case when vnum % 11 = 0 then digest[1:60] when vnum % 13 = 0 then digest[1:63] || 'g' else upper(digest) end x from ops)")
def digest_shape(spark, d):
    o, x = ops(spark, d), F.col("digest")
    given = F.when(F.col("vnum") % 11 == 0, F.substring(x, 1, 60)).when(F.col("vnum") % 13 == 0, F.concat(F.substring(x, 1, 63), F.lit("g"))).otherwise(F.upper(x))
    return o.select("object_id", "vnum", digests.well_formed(given, "sha256").alias("fine"))


@query("select event_id, regexp_full_match(s, '(?i)\\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\\d|3[01])T([01]\\d|2[0-3]):[0-5]\\d:[0-5]\\d(\\.\\d{1,9})?(Z|[+-]([01]\\d|2[0-3]):[0-5]\\d)') fine from (select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || case event_id % 4 when 0 then 'Z' when 1 then '.123+01:00' when 2 then '' else '+25:00' end s from events)")
def rfc3339_check(spark, d):
    k = F.col("event_id") % 4
    s = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(k == 0, "Z").when(k == 1, ".123+01:00").when(k == 2, "").otherwise("+25:00"))
    return table(spark, d, "events").select("event_id", versions.is_rfc3339(s).alias("fine"))


@query("select u uri, regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*:') fine from (select case when page_id % 3 = 0 then substr(url, 9) else url end u from pages)")
def uri_check(spark, d):
    u = F.when(F.col("page_id") % 3 == 0, F.substr("url", F.lit(9))).otherwise(F.col("url"))
    return table(spark, d, "pages").select(u.alias("uri"), versions.is_uri(u).alias("fine"))


@query("select v version, case when n % 5 = 0 then case when n % 1000 < 999 then 'v' || lpad((n % 1000 + 1)::varchar, 4, '0') else 'v' || lpad((n % 1000 + 1)::varchar, 4, '0') end else 'v' || (n + 1) end following, case when n % 5 = 0 then case when n % 1000 > 1 then 'v' || lpad((n % 1000 - 1)::varchar, 4, '0') end when n > 1 then 'v' || (n - 1) end preceding from (select o_orderkey n, case when o_orderkey % 5 = 0 then 'v' || lpad((o_orderkey % 1000)::varchar, 4, '0') else 'v' || o_orderkey end v from orders)")
def version_arithmetic(spark, d):
    n = F.col("o_orderkey")
    v = F.when(n % 5 == 0, F.concat(F.lit("v"), F.lpad((n % 1000).cast("string"), 4, "0"))).otherwise(F.concat(F.lit("v"), n.cast("string")))
    return table(spark, d, "orders").select(v.alias("version"), versions.following(v).alias("following"), versions.preceding(v).alias("preceding"))


@query(f"with {FILES} select object_id, path, case when path::bigint % 50 = 1 then 'E092' when path::bigint % 50 = 2 then 'E023' else 'E093' end code from files where path::bigint % 50 in (1, 2, 3)")
def files_against_manifest(spark, d):
    f, k = files(spark, d), F.col("path").cast("long") % 50
    return integrity.files_against_manifest(f.where(k != 1), f.where(k != 2).withColumn("digest", F.when(k == 3, F.sha2(F.lit("x").cast("binary"), 256)).otherwise(F.upper("digest"))))


@query(f"with {TURNS} select object_id, vnum, path, 'E066' code from turns where object_id % 6 = 0 or object_id % 6 = 1 and vnum % 2 = 0")
def cross_inventory_state(spark, d):
    t = turns(spark, d)
    other = t.where("object_id % 6 != 0").withColumn("digest", F.when((F.col("object_id") % 6 == 1) & (F.col("vnum") % 2 == 0), F.md5("digest")).otherwise(F.col("digest")))
    return integrity.state_mismatch(t, other)


@query("with v as (select distinct conv_id object_id, (turn + 1)::bigint vnum from conversations) select object_id, vnum, 'message' field, 'W011' code from v where vnum % 3 = 0 union all select object_id, vnum, 'user_name', 'W011' from v where vnum % 4 = 0")
def metadata_drift(spark, d):
    v = turns(spark, d).select("object_id", "vnum").distinct()
    a = v.select("*", F.lit("m").alias("message"), F.lit("u").alias("user_name"), F.lit(None).cast("string").alias("user_address"))
    b = a.withColumns({"message": F.when(F.col("vnum") % 3 == 0, "other").otherwise(F.col("message")), "user_name": F.when(F.col("vnum") % 4 == 0, None).otherwise(F.col("user_name"))})
    return integrity.metadata_drift(a, b)


@query(f"with {TURNS} select object_id::varchar object_id, vnum::bigint vnum, digest, path from turns where object_id is not null")
def inventory_parse(spark, d):
    return inventory.state_rows(inventory.parse(inventory.build(turns(spark, d))))


@query(f"with {TURNS} select object_id::varchar object_id, digest, 'v' || min(vnum) || '/content/' || arg_min(path, (vnum, path)) content_path, min(vnum)::bigint content_vnum from turns group by object_id, digest")
def inventory_manifest(spark, d):
    return inventory.manifest_rows(inventory.parse(inventory.build(turns(spark, d))))


#: Faults planted by an object's id modulo 16: what stands in the document, what takes its place, the codes that follow.
FAULTS = [
    (1, '"head":"v', '"head_":"v', {"E102": 1}), (2, '"id":"', '"id":5,"message":"', {"E037": 1, "E102": 1}),
    (3, '{"id"', '{"id', {"E033": 1}), (4, '"digestAlgorithm":"sha256"', '"digestAlgorithm":"md5"', {"E025": 1}),
    (5, "/spec/#inventory", "/spec/#other", {"E038": 1}), (6, '"digestAlgorithm":"sha256"', '"digestAlgorithm":"sha512","contentDirectory":"a/b"', {"E017": 1}),
    (7, '"digestAlgorithm":"sha256",', "", {"E036": 1}), (8, '"manifest":{', '"manifest":{"ff":["v1/content/x"],', {"E107": 1}),
    (9, '"manifest":{', '"manifest":{"ff":"v1/content/x",', {"E092": 1}), (10, '"head":"v', '"head":"w', {"E104": 1, "E010": 1, "E040": 1}),
]
#: W004 where sha256 stays, W005 as ids are numbers, W008 for each version; none where the shape is wrong.
_FAULT_SQL = " union all ".join(f"select object_id, '{c}' code, {n}::bigint n from o where k = {k}" for k, _, _, codes in FAULTS for c, n in codes.items())


@query(f"""with o as (select conv_id::varchar object_id, conv_id % 16 k, count(distinct turn) versions from conversations group by 1, 2)
{_FAULT_SQL} union all select object_id, 'W005', 1 from o where k not in (1, 2, 3, 9)
union all select object_id, 'W004', 1 from o where k not in (1, 2, 3, 4, 6, 7, 9) union all select object_id, 'W008', versions from o where k not in (1, 2, 3, 9)""")
def document_issues(spark, d):
    docs, k, raw = inventory.build(turns(spark, d)), F.col("object_id").cast("long") % 16, F.col("raw")
    for n, old, new, _ in FAULTS:
        raw = F.when(k == n, F.replace(F.col("raw"), F.lit(old), F.lit(new))).otherwise(raw)
    return documents.issues(docs.select("object_id", raw.alias("raw")))
