"""Secret scans by a trigram inverted index, with DataFrame and SQL functions alone.

From each rule's pattern a Boolean query over trigrams is derived; its disjunctive clauses are intersected over the
postings of the trigrams that any rule asks for, and only documents that satisfy a clause are verified by the
pattern. A rule without mandatory trigrams (the hex rule) scans every document. The index folds case, so it can only
let through too many candidates, never too few.

Results for odd input: null text counts as empty and has no spans; null, repeated and clashing doc_id values only
widen the candidates of a document, its spans come from its own text; repeated rows give equal rows; an empty table
gives an empty one. Positions are code points, ends exclusive. A column that has the name of a new one is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.runtime import table



@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches; those whose group is shorter than `least` fall away."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The kinds in order; the first three are the base.
RULES = (
    Rule("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abpr]-[A-Za-z0-9-]{20,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")

ANY = frozenset({frozenset()})  # one clause that asks for nothing
MOST = 64


def _grams(s: str) -> frozenset:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _of(strings: set[str]) -> frozenset:
    """Clauses (a set of sets of trigrams) that one of these strings must satisfy."""
    return ANY if any(len(s) < 3 for s in strings) else _least({_grams(s) for s in strings})


def _least(clauses) -> frozenset:
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _and(a: frozenset, b: frozenset) -> frozenset:
    both = _least({x | y for x in a for y in b})
    return both if len(both) <= MOST else min(a, b, key=len)  # dropping a condition widens the candidates only


@dataclass
class _Part:
    """All strings of a pattern part, if few; else how they begin and end and what they must hold."""

    exact: set[str] | None
    first: set[str]
    last: set[str]
    must: frozenset

    def open(self) -> _Part:
        if self.exact is None:
            return self
        return _Part(None, {s[:2] for s in self.exact}, {s[-2:] for s in self.exact}, _of(self.exact))


_UNKNOWN = _Part(None, {""}, {""}, ANY)


def _then(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST:
        return _Part({x + y for x, y in product(a.exact, b.exact)}, set(), set(), ANY)
    ends, begins = a.exact or a.last, b.exact or b.first
    ends = ends if a.exact is None else {s[-2:] for s in ends}
    begins = begins if b.exact is None else {s[:2] for s in begins}
    across = _of({x + y for x, y in product(ends, begins)}) if len(ends) * len(begins) <= MOST else ANY
    left, right = a.open(), b.open()
    first = {(x + y)[:2] for x, y in product(a.exact, right.first)} if a.exact is not None else left.first
    last = {(x + y)[-2:] for x, y in product(left.last, b.exact)} if b.exact is not None else right.last
    return _Part(None, first, last, _and(_and(left.must, right.must), across))


def _or(parts: list[_Part]) -> _Part:
    if all(p.exact is not None for p in parts) and sum(len(p.exact) for p in parts) <= MOST:
        return _Part(set().union(*(p.exact for p in parts)), set(), set(), ANY)
    parts = [p.open() for p in parts]
    must = _least(set().union(*(p.must for p in parts)))
    return _Part(None, set().union(*(p.first for p in parts)), set().union(*(p.last for p in parts)), ANY if frozenset() in must else must)


def _part(tree) -> _Part:
    out = _Part({""}, set(), set(), ANY)
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            p = _Part({chr(arg).lower()}, set(), set(), ANY)
        elif name == "IN":
            chars = set()
            for k, v in arg:
                chars |= {chr(v).lower()} if str(k) == "LITERAL" else {chr(c).lower() for c in range(v[0], v[1] + 1)} if str(k) == "RANGE" and v[1] - v[0] < 256 else {""}
            p = _Part(chars, set(), set(), ANY) if len(chars) <= 8 and "" not in chars else _UNKNOWN
        elif name == "SUBPATTERN":
            p = _part(arg[-1])
        elif name == "BRANCH":
            p = _or([_part(x) for x in arg[1]])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, inner = arg
            one = _part(inner)
            if (least, most) == (0, 1):
                p = _or([one, _Part({""}, set(), set(), ANY)])
            elif least == 0:
                p = _UNKNOWN
            else:
                p = one
                for _ in range(min(least, 4) - 1):
                    p = _then(p, one)
                p = p if least == most <= 4 else _then(p.open(), _UNKNOWN)
        elif name == "AT":
            continue
        else:
            p = _UNKNOWN
        out = _then(out, p)
    return out


def trigram_query(pattern: str) -> frozenset:
    """The pattern's Boolean query: a set of clauses, of which a matching text has all trigrams of one at least."""
    return _part(parser.parse(pattern)).open().must


def candidates(docs: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, rules): for each document with some, the rules with trigrams whose query its text satisfies."""
    spark = docs.sparkSession
    clauses = [(r.kind, c) for r in rules for c in sorted(map(sorted, trigram_query(r.pattern))) if c]
    if not clauses:
        return docs.sparkSession.range(0).select(F.lit(None).cast("long").alias("doc_id"), F.array().cast("array<string>").alias("rules"))
    if any(len(c) > 60 for _, c in clauses):
        clauses = [(k, c[:60]) for k, c in clauses]  # fewer conditions only widen the candidates
    grams = sorted({t for _, c in clauses for t in c})
    text = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    terms = ", ".join(f"({text(t)}, {n}, {text(k)}, {1 << c.index(t)}L, {(1 << len(c)) - 1}L)" for n, (k, c) in enumerate(clauses) for t in c)
    asked = spark.sql(f"select * from values {terms} as asked(gram, clause, rule, bit, full)")  # bounded by the rules
    postings = docs.select("doc_id", F.lower("text").alias("low")).select(
        "doc_id", F.explode(F.filter(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in grams)), lambda x: x.isNotNull())).alias("gram")
    )
    return (
        postings.join(F.broadcast(asked), "gram")
        .groupBy("doc_id", "clause", "rule", "full").agg(F.bit_or("bit").alias("seen")).where("seen = full")
        .groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))
    )


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start,ord,kind,end>> of one rule's matches in a text."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    zipped = F.zip_with(F.zip_with(whole, group, lambda m, g: F.struct(F.length(m).alias("n"), F.length(g).alias("g"))), F.slice(F.transform(F.split(text, rule.pattern, -1), F.length), 1, F.greatest(F.size(whole), F.lit(0))), lambda x, gap: F.struct(x["n"].alias("n"), x["g"].alias("g"), gap.alias("gap")))
    found = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>").alias("found"))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), (start + x["n"]).alias("end"))
        kept = F.when(x["g"] >= rule.least, F.concat(acc["found"], F.array(span))).otherwise(acc["found"])
        return F.struct((start + x["n"]).alias("at"), kept.alias("found"))

    return F.aggregate(zipped, found, step, lambda acc: acc["found"])


def secret_spans(df: DataFrame, rules=RULES) -> DataFrame:
    """df with `spans`: array<struct<start,ord,kind,end>> in order of start, then kind. df has doc_id and text."""
    df = df.select(*(c for c in df.columns if c.lower() not in ("spans", "__rules")))
    whole = df.withColumn("__text", F.coalesce("text", F.lit("")))
    asked = candidates(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), rules).select(F.col("doc_id").alias("__doc"), F.col("rules").alias("__rules"))
    joined = whole.join(asked, whole["doc_id"].eqNullSafe(asked["__doc"]), "left")
    none = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>")
    parts = []
    for n, r in enumerate(rules):
        full_scan = frozenset() in trigram_query(r.pattern)
        gate = F.col("__text").rlike(r.pattern) if full_scan else F.array_contains("__rules", r.kind) & F.col("__text").rlike(r.pattern)
        parts.append(F.when(gate, _spans(F.col("__text"), r, n)).otherwise(none))
    return joined.select(*(df[c] for c in df.columns), F.array_sort(F.concat(*parts)).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    found = secret_spans(docs.select("doc_id", "text")).select("doc_id", "spans")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["ord"] < len(BASE))
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(df: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """df with each stretch of text that spans cover replaced by the mark; overlapping spans count as one stretch. Null text stays null."""
    found = secret_spans(df)

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
        )

    done = F.aggregate(F.col("spans"), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return found.select(*(F.when(F.col("text").isNull() | (F.size("spans") == 0), F.col("text")).otherwise(done).alias("text") if c == "text" else F.col(f"`{c}`") for c in df.columns if c != "spans"))


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def oracle() -> str:
    parts = " union all ".join(
        f"select doc_id, row, '{r.kind}' kind, {n} ord, {r.least} least, string_split_regex(t, {_literal(r.pattern)}) g, regexp_extract_all(t, {_literal(r.pattern)}) a, regexp_extract_all(t, {_literal(r.pattern)}, {r.group}) v from d"
        for n, r in enumerate(RULES)
    )
    return f"""
with d as (select row_number() over () as row, doc_id, coalesce(text, '') t from documents),
m as ({parts}),
e as (select row, kind, ord, least, g, a, v, unnest(range(1, len(a) + 1)) i from m where len(a) > 0),
s as (select row, kind, ord, length(a[i]) n, coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(a[1:i-1], lambda x: length(x))), 0) b
      from e where length(v[i]) >= least),
f as (select row, count(*) filter (kind = 'assign') n_assign, count(*) filter (kind = 'access') n_access, count(*) filter (kind = 'hex') n_hex,
             string_agg(kind || ':' || b::bigint || ':' || (b + n)::bigint, ',' order by b, ord) filter (ord < {len(BASE)}) base,
             string_agg(kind || ':' || b::bigint || ':' || (b + n)::bigint, ',' order by b, ord) spans from s group by row)
select d.doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex,
       sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
from d left join f using (row)"""
