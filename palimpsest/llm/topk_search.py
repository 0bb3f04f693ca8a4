"""Exact top-k search by multi-resolution segment statistics.

With a vector cut into segments of length l, means m and deviations s, the squared distance of two vectors is at
least the sum over segments of l((m - m')^2 + (s - s')^2). Their inner product is (|x|^2 + |y|^2 - distance) / 2, so
that lower bound on the distance is an upper bound on the score. Levels go from few segments to many, the last with one
or two values a segment. Each query has a floor, the k-th best score it has met so far: at first among SEED vectors of
its partition, then carried from block to block of a task. A candidate whose bound at a level is below the floor is
left out; a level that leaves out less than LEAST_CUT of a block's candidates is passed over in the task's next blocks,
as it costs more than it saves. What is left at the finest level is scored exactly in the order of its bounds, in
steps of STEP: after each the floor rises, and the query is done once its next bound is below it.

The vectors are read in blocks of the partitions that hold them. The queries lie in a written table of the shared
folder, in parts of QUERY_BLOCK rows at most, and each task reads them part by part: nothing is broadcast, and a task
holds one block of either. Each partition returns its own k best for a query; a window ranks them.

Results for odd input: null vectors and vectors with null or non-finite components take no part, nor do rows without
vec_id; vectors are compared with those of equal length; an empty vector scores 0; repeated rows are candidates each,
a query's own id never is; repeated query rows count once; ties go to the smaller vec_id; an empty table gives an
empty one. Scores beyond 64 bits wrap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.runtime import arrow_rows, scratch_path, ship, table

LEVELS, QUERY_BLOCK, VECTOR_BLOCK = (4, 8, 16, 32, 48), 512, 8192
#: Vectors of a block that give first floors; candidates scored at once; share of a block that a level must leave out to be kept.
SEED, STEP, LEAST_CUT = 256, 64, 0.1


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations by segment, each times the root of the segment's length, so that a bound is one product."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    lens = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / lens
    square = np.add.reduceat(x * x, edges[:-1], axis=1) / lens
    return np.hstack([mean, np.sqrt(np.maximum(square - mean * mean, 0))]) * np.sqrt(np.tile(lens, 2))


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer scores; by floating point where all sums stay below 2^53."""
    if q.size and x.size and np.abs(q).max() * np.abs(x).max() * x.shape[1] >= 2.0**53:
        return q.astype(np.int64) @ x.astype(np.int64).T
    return (q @ x.T).astype(np.int64)


class Floors:
    """A task's floors by query, the levels still in use by vector length, and how many pairs were bounded and scored."""

    def __init__(self, levels: tuple[int, ...], k: int) -> None:
        self.levels, self.k, self.floor, self.used = levels, k, {}, {}
        self.pairs = self.scored = 0

    def steps(self, n: int) -> list[int]:
        return self.used.setdefault(n, [s for s in self.levels if s < n] or [n])


def best_of(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, floors: Floors) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the rows of this block that may be among its k best of all, at most k, as (vec_id, score)."""
    n, k = x.shape[1], floors.k
    if not n:
        scores = np.zeros((len(q), len(x)), np.int64)
        return [_top(x_ids[(m := x_ids != i)], s[m], k) for i, s in zip(q_ids, scores, strict=True)]
    floor = np.array([floors.floor.get((n, int(i)), -np.inf) for i in q_ids])
    seeds = x[:SEED]
    if len(seeds) > k and np.isneginf(floor).any():
        s = exact(q, seeds).astype(np.float64)
        s[q_ids[:, None] == x_ids[None, :SEED]] = -np.inf
        floor = np.maximum(floor, np.partition(s, -k, axis=1)[:, -k])
    steps = floors.steps(n)
    alive, bounds, at = np.ones((len(q), len(x)), bool), None, 0
    alive[q_ids[:, None] == x_ids[None, :]] = False
    slack = 1e-6 * (1 + float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * n)
    for s in list(steps):
        before = alive.sum()
        bounds = (q @ x.T) if s >= n else statistics(q, s) @ statistics(x, s).T
        bounds += slack
        alive &= bounds >= floor[:, None]
        if s != steps[-1] and alive.sum() > (1 - LEAST_CUT) * before:
            floors.used[n] = [t for t in floors.used[n] if t != s]
    out = []
    for i in range(len(q)):
        left = np.flatnonzero(alive[i])
        left = left[np.argsort(-bounds[i, left], kind="stable")]
        ids, scores, at = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while at < len(left) and bounds[i, left[at]] >= floor[i]:
            now = left[at : at + STEP]
            ids, scores = _top(np.concatenate([ids, x_ids[now]]), np.concatenate([scores, exact(q[i : i + 1], x[now])[0]]), k)
            at += len(now)
            if len(scores) == k:
                floor[i] = max(floor[i], scores[-1])
        floors.pairs, floors.scored = floors.pairs + len(x), floors.scored + at
        floors.floor[n, int(q_ids[i])] = floor[i]
        out.append((ids, scores))
    return out


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def quantised(column) -> np.ndarray | None:
    """floor(64 x) of a list of rows of one length."""
    return np.floor(64.0 * np.asarray(column, dtype=np.float64))


def search(vectors: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each row that the condition is_query picks."""
    spark = vectors.sparkSession
    ship(spark)
    arrow_rows(spark, 4096)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    path = scratch_path(spark, "queries")
    asked = vectors.where(is_query).select(F.col(vec_id).cast("long").alias("id")).distinct()
    queries = rows.join(asked, "id", "left_semi").distinct()
    queries.write.option("maxRecordsPerFile", QUERY_BLOCK).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        parts = ds.dataset(place, filesystem=store, format="parquet", exclude_invalid_files=False).files
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count, floors = 0, Floors(levels, k)  # eight bytes a query and a key

        def through() -> Iterator[pa.RecordBatch]:
            for part in parts:
                t = ds.dataset(part, filesystem=store, format="parquet").to_table()
                q_ids = t["id"].to_numpy()
                q_lens = t["v"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
                flat = t["v"].to_pylist()
                got: list[tuple[int, np.ndarray, np.ndarray]] = []
                for n in np.unique(q_lens):
                    of = np.flatnonzero(q_lens == n)
                    x_parts = [(i, x) for i, x in held if x.shape[1] == n]
                    if not x_parts:
                        continue
                    x_ids, x = np.concatenate([i for i, _ in x_parts]), np.concatenate([x for _, x in x_parts])
                    q = quantised([flat[i] for i in of]).reshape(len(of), int(n))
                    got += [(q_ids[i], *b) for i, b in zip(of, best_of(q, q_ids[of], x, x_ids, floors), strict=True)]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([g[0] for g in got], [len(g[1]) for g in got])), pa.array(np.concatenate([g[1] for g in got])), pa.array(np.concatenate([g[2] for g in got]))], names=["query_id", "vec_id", "score"])

        for b in batches:
            ids, v = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            lens = v.value_lengths().to_numpy(zero_copy_only=False)
            flat, ends = v.flatten().to_numpy(zero_copy_only=False), np.cumsum(lens)
            for n in np.unique(lens):
                of = np.flatnonzero(lens == n)
                at = (ends[of] - n)[:, None] + np.arange(n)[None, :]
                held.append((ids[of], quantised(flat[at]) if n else np.zeros((len(of), 0))))
            count += len(ids)
            if count >= VECTOR_BLOCK:
                yield from through()
                held, count = [], 0
        if count:
            yield from through()

    found = rows.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_topk_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) e from embeddings
           where vec_id is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::bigint score
      from v q, v c where q.vec_id % 20 = 0 and c.vec_id <> q.vec_id and len(q.e) = len(c.e)),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select * from r where rank <= 20"""
