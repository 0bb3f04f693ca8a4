"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from palimpsest.runtime import arrow_rows, ship

#: White space as the contracts have it: x20 and x09 to x0D. bytes.split() splits at exactly these.
SPACE = " \t\n\x0b\x0c\r"


def vocabulary(path: str | None, name: str) -> bytes:
    """A public tokenizer's file, read on the driver; all of them are under 2 MB, so they may be broadcast."""
    import public_tokenizers

    with open(path or public_tokenizers.path(name), "rb") as f:
        return f.read()


def appended(
    df: DataFrame, needs: list[str], fields: list[T.StructField], make: Callable[[], Callable[[dict[str, list]], list[Iterable]]], drop: Iterable[str] = ()
) -> DataFrame:
    """df with columns made from `needs`, batch by batch in Arrow; make() runs once a task and returns the batch function.

    A column of df that has the name of a new one is replaced. Rows are kept as they are, one out for each in.
    """
    spark = df.sparkSession
    ship(spark)
    arrow_rows(spark)
    new = {f.name.lower() for f in fields}
    gone = {d.lower() for d in drop}
    kept = [c for c in df.columns if c.lower() not in new and c.lower() not in gone]
    extra = [c for c in needs if c not in kept]
    source = df.select(*[df[f"`{c}`"] for c in kept], *[df[f"`{c}`"].alias(f"__in_{c}") for c in extra])
    schema = T.StructType([*source.schema.fields[: len(kept)], *fields])
    kinds = [pa_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None  # made by the first rows, gone with the task
        for b in batches:
            if not b.num_rows:
                continue
            work = work or make()
            columns = [b.column(i) for i in range(len(kept))]
            values = {c: b.column(kept.index(c) if c in kept else len(kept) + extra.index(c)) for c in needs}
            made = [a if isinstance(a, pa.Array) else pa.array(a, k) for a, k in zip(work(values), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns + made, names=[f.name for f in schema.fields])

    return source.mapInArrow(settled(run), schema)


def settled(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, with the worker's free memory given back at the task's end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        settle()

    return whole


_malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None


def settle() -> None:
    """Give back what is free but kept by the allocators: a worker lives on, and shares its executor's memory with the JVM and other workers."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim:
        _malloc_trim(0)


_held: dict[object, object] = {}


def held(key: object, make: Callable[[], object]) -> object:
    """What this worker keeps from task to task: one object, made anew where another operator or query had its own."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Let go of what this worker keeps: it may run tasks of other stages."""
    _held.clear()
    settle()


def pa_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)

