"""Mixing sources to target weights by iterative proportional fitting.

Token masses are summed by cell (source, language, topic) over all documents. Raking scales the cells by turns until
their sums meet the target shares of every source, language and topic. `sample`, the pipeline's stage, takes each
document as often as its cell's raked mass over its true mass, times `rate`, says: the whole part, and once more where
a hash of its id falls under the fraction. The column `copies` says how often; the document stands in one row. So with
copies counted, expected shares are those raking meets, and expected tokens `rate` of all. Draws hang on the id alone,
so a rerun takes the same ones.

`plan`, the query, takes no document twice, as its SQL has it: probabilities are cut at 1, and one factor makes up for
the cut, so that the expected tokens are `rate` of all. Where cells are cut its expected shares MISS the targets, the
more the larger `rate` is; README has the figures.

Without given targets a marginal's target shares are its true ones to the power TEMPER, made to sum to 1. A topic is
the column `topic`, if there is one, else the form of the text (figures, markup, lines, talk, prose).

Cells are aggregated before any shuffle. Up to CELLS of them (about 10 MB) are raked on the driver, more of them by
the same steps as DataFrames.

Results for odd input: null source, language or topic is a value of its own (the empty string); null text has no
tokens; documents without tokens, and cells without mass, are taken with probability `rate`; repeated rows share one
fate; without doc_id the text decides; an empty table gives an empty one; columns named like the new ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.runtime import saved, table

RATE, TEMPER, ROUNDS, CELLS, SEED = 0.8, 0.5, 30, 200_000, "mix"
KEYS = ("source", "lang", "topic")
WORD = r"[^ \t-\r]+"


def topic_of():
    text = F.coalesce("text", F.lit(""))
    n = F.length(text)
    count = lambda chars: n - F.length(F.translate(text, chars, ""))
    return (
        F.when(count("0123456789") * 20 > n, "figures").when(count("#*$%&|<>{}=") * 40 > n, "markup")
        .when(count("\n") * 60 > n, "lines").when(count("?!") * 100 > n, "talk").otherwise("prose")
    )


def annotated(docs: DataFrame) -> DataFrame:
    """docs with cell keys __source, __lang, __topic and __tokens."""
    topic = F.coalesce(F.col("topic").cast("string"), F.lit("")) if "topic" in docs.columns else topic_of()
    return docs.withColumns({"__source": F.coalesce(F.col("source").cast("string"), F.lit("")), "__lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "__topic": topic, "__tokens": F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")})


def rake(cells: np.ndarray, keys: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Cell masses whose marginals have the target shares; keys number each cell's value in each marginal."""
    w = cells / cells.sum()
    for _ in range(rounds):
        for key, target in zip(keys, targets, strict=True):
            w = w * (target / np.maximum(np.bincount(key, w, len(target)), 1e-300))[key]
    return w / w.sum()


def probabilities(mass: np.ndarray, w: np.ndarray, rate: float) -> np.ndarray:
    """min(1, factor x raked / true mass), with the factor for which rate of the mass is expected."""
    ratio = w / mass
    order = np.argsort(-ratio, kind="stable")
    m, v = mass[order], w[order]
    full = np.cumsum(m) - m  # mass of the cells before, if these are taken whole
    rest = v[::-1].cumsum()[::-1]
    factor = (rate * mass.sum() - full) / rest
    fits = np.flatnonzero(factor * ratio[order] <= 1 + 1e-12)
    return np.minimum(1.0, (factor[fits[0]] if len(fits) else np.inf) * ratio)


def tempered(mass: np.ndarray, temper: float) -> np.ndarray:
    t = mass**temper
    return t / t.sum()


def cell_weights(rows: DataFrame, rate: float = RATE, temper: float = TEMPER, targets: dict[str, dict[str, float]] | None = None, most: int = CELLS) -> DataFrame:
    """(source, lang, topic, mass, weight, copies, prob) of each cell with tokens."""
    spark = rows.sparkSession
    cells = rows.groupBy(*(F.col(f"__{k}").alias(k) for k in KEYS)).agg(F.sum("__tokens").cast("double").alias("mass"))
    cells = saved(spark, cells.where("mass > 0"), "cells")
    if cells.limit(most + 1).count() > most:
        return _distributed(cells, rate, temper, targets or {})
    found = cells.orderBy(*KEYS).toPandas()
    if found.empty:
        return cells.select(*KEYS, "mass", *(F.lit(0.0).alias(c) for c in ("weight", "copies", "prob")))
    mass, numbers, shares = found["mass"].to_numpy(), [], []
    for k in KEYS:
        values, number = np.unique(found[k].to_numpy(dtype=str), return_inverse=True)
        own = np.bincount(number, mass)
        given = (targets or {}).get(k)
        share = tempered(own, temper) if given is None else np.array([given.get(v, 0.0) for v in values])
        numbers.append(number)
        shares.append(share / max(share.sum(), 1e-300))
    w = rake(mass, numbers, shares)
    found["weight"], found["copies"], found["prob"] = w, rate * mass.sum() * w / mass, probabilities(mass, w, rate)
    # As an Arrow table: rows from pandas would start Python workers of another kind in the executors, which stay beside the next stage's.
    return saved(spark, spark.createDataFrame(pa.Table.from_pandas(found, preserve_index=False)), "cell-weights")


def _distributed(cells: DataFrame, rate: float, temper: float, targets: dict[str, dict[str, float]]) -> DataFrame:
    """The same for more cells than one machine should hold."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("mass")).first()[0]
    now = cells.withColumn("weight", F.col("mass") / total)
    for k in KEYS:
        if k in targets:
            share = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in targets[k].items() for x in kv)), F.col(k)), F.lit(0.0))
            goal = cells.groupBy(k).agg(F.sum("mass").alias("own")).select(k, share.alias("goal"))
        else:
            goal = cells.groupBy(k).agg(F.pow(F.sum("mass"), temper).alias("goal"))
        whole = goal.agg(F.sum("goal")).first()[0]
        now = now.join(goal.select(k, (F.col("goal") / whole).alias(f"goal_{k}")), k)
    now = saved(spark, now, "rake")
    for _ in range(ROUNDS):
        for k in KEYS:
            sums = now.groupBy(k).agg(F.sum("weight").alias("__sum"))
            now = now.join(sums, k).withColumn("weight", F.col("weight") * F.col(f"goal_{k}") / F.greatest("__sum", F.lit(1e-300))).drop("__sum")
        now = saved(spark, now, "rake")
    low, high = 0.0, now.agg(F.max(F.col("mass") / F.col("weight"))).first()[0] or 0.0
    while high - low > 1e-9 * high:  # 64 factors at a time
        tries = [low + (high - low) * i / 64 for i in range(65)]
        got = now.agg(*(F.sum(F.least(F.lit(1.0), F.col("weight") / F.col("mass") * x) * F.col("mass")).alias(f"x{i}") for i, x in enumerate(tries))).first()
        at = max((i for i, x in enumerate(got) if x <= rate * total), default=0)
        low, high = tries[at], tries[min(at + 1, 64)]
    return saved(spark, now.select(*KEYS, "mass", "weight", (F.col("weight") / F.col("mass") * (rate * total)).alias("copies"), F.least(F.lit(1.0), F.col("weight") / F.col("mass") * low).alias("prob")), "cell-weights")


def chosen(rows: DataFrame, weights: DataFrame, rate: float, seed: str) -> DataFrame:
    """rows with __weight, __prob, __taken and __copies."""
    w = weights.select(*(F.col(k).alias(f"__{k}") for k in KEYS), F.col("weight").alias("__weight"), F.col("prob").alias("__prob"), F.col("copies").alias("__copies"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))) if "__name" not in rows.columns else F.col("__name")
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed), name).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    joined = rows.join(w, [f"__{k}" for k in KEYS], "left")
    prob, copies = (F.when(F.col("__tokens") > 0, F.coalesce(c, F.lit(rate))).otherwise(F.lit(rate)) for c in ("__prob", "__copies"))
    drawn = F.floor(copies) + (u < copies - F.floor(copies)).cast("long")
    return joined.withColumns({"__prob": prob, "__weight": F.coalesce("__weight", F.lit(0.0)), "__taken": u < prob, "__copies": drawn})


def plan(docs: DataFrame, rate: float = RATE, temper: float = TEMPER, targets=None, seed: str = SEED, most: int = CELLS) -> DataFrame:
    """Every document with its cell, its tokens, its cell's raked share, its probability and whether it is taken."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    rows = annotated(docs).select("doc_id", name.alias("__name"), *(f"__{k}" for k in KEYS), "__tokens")
    rows = saved(docs.sparkSession, rows, "mix-rows")
    out = chosen(rows, cell_weights(rows, rate, temper, targets, most), rate, seed)
    return out.select("doc_id", F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"), F.col("__tokens").alias("n_tokens"), F.col("__weight").alias("weight"), F.col("__prob").alias("prob"), F.col("__taken").alias("sampled"))


def sample(docs: DataFrame, rate: float = RATE, temper: float = TEMPER, targets=None, seed: str = SEED) -> DataFrame:
    """The documents that are taken, with the columns of docs and copies (long), how often each is taken."""
    rows = annotated(docs)
    return chosen(rows, cell_weights(rows, rate, temper, targets), rate, seed).where("__copies > 0").select(*(c for c in docs.columns if c.lower() != "copies"), F.col("__copies").alias("copies"))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    out = plan(table(spark, sf_dir, "documents"))
    return out.withColumns({"weight": F.round("weight", 8), "prob": F.round("prob", 6)})


ORACLE = f"""
with recursive d as (select doc_id, coalesce(source, '') s, coalesce(lang, '') l, coalesce(text, '') x from documents),
c as (select *, length(x) n, length(x) - length(translate(x, '0123456789', '')) figures, length(x) - length(translate(x, '#*$%&|<>{{}}=', '')) markup,
      length(x) - length(replace(x, chr(10), '')) newlines, length(x) - length(translate(x, '?!', '')) talk, len(regexp_extract_all(x, '[^ \\t-\\r]+')) tokens from d),
r as (select doc_id, s, l, tokens, case when figures * 20 > n then 'figures' when markup * 40 > n then 'markup' when newlines * 60 > n then 'lines' when talk * 100 > n then 'talk' else 'prose' end t from c),
m as (select s, l, t, sum(tokens)::double mass from r group by s, l, t having sum(tokens) > 0),
g as (select *, sqrt(sum(mass) over (partition by s)) gs, sqrt(sum(mass) over (partition by l)) gl, sqrt(sum(mass) over (partition by t)) gt from m),
ws as (select sum(x) x from (select distinct s, gs x from g)), wl as (select sum(x) x from (select distinct l, gl x from g)), wt as (select sum(x) x from (select distinct t, gt x from g)),
h as (select g.s, g.l, g.t, mass, gs / ws.x gs, gl / wl.x gl, gt / wt.x gt from g, ws, wl, wt),
ipf(it, s, l, t, mass, gs, gl, gt, w) as (
  select 0, s, l, t, mass, gs, gl, gt, mass / (select sum(mass) from h) from h
  union all
  select it + 1, s, l, t, mass, gs, gl, gt, w * gt / sum(w) over (partition by t)
  from (select it, s, l, t, mass, gs, gl, gt, w * gl / sum(w) over (partition by l) w
  from (select it, s, l, t, mass, gs, gl, gt, w * gs / sum(w) over (partition by s) w from ipf where it < {ROUNDS}))),
k as (select s, l, t, mass, w / (select sum(w) from ipf where it = {ROUNDS}) w from ipf where it = {ROUNDS}),
o as (select *, w / mass ratio, sum(mass) over (order by w / mass desc, s, l, t rows unbounded preceding) - mass whole,
      sum(w) over (order by w / mass desc, s, l, t rows between current row and unbounded following) rest from k),
f as (select *, ({RATE} * (select sum(mass) from k) - whole) / rest factor from o),
b as (select max_by(factor, ratio) factor from f where factor * ratio <= 1 + 1e-12),
p as (select s, l, t, w, least(1.0, b.factor * ratio) prob from f, b),
a as (select r.doc_id, r.s source, r.l lang, r.t topic, r.tokens::bigint n_tokens, coalesce(p.w, 0) weight, case when r.tokens > 0 then p.prob else {RATE} end prob,
      ('0x' || substr(md5('{SEED}' || r.doc_id), 1, 8))::bigint / 4294967296.0 u from r left join p using (s, l, t))
select doc_id, source, lang, topic, n_tokens, round(weight, 8) weight, round(prob, 6) prob, u < prob sampled from a"""
