"""Digests of binary columns: built-in functions where Spark has them, Arrow batches for the rest. A registry takes new ones."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _arrow(make: Callable[[], "hashlib._Hash"]) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def digest(data: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            h = make()
            h.update(x)
            return h.hexdigest()

        return pd.Series([one(x) for x in data], dtype=object)

    return lambda c: digest(c)


REGISTRY: dict[str, Callable[[Column], Column]] = {
    "md5": F.md5,
    "sha1": F.sha1,
    "sha256": lambda c: F.sha2(c, 256),
    "sha512": lambda c: F.sha2(c, 512),
    "size": lambda c: F.octet_length(c).cast("string"),
}


def register(name: str, function: Callable[[Column], Column]) -> None:
    REGISTRY[name.lower()] = function


for _bits in (512, 384, 256, 160):
    register(f"blake2b-{_bits}", lambda c, n=_bits // 8: _arrow(lambda: hashlib.blake2b(digest_size=n))(c))
register("sha512/256", lambda c: _arrow(lambda: hashlib.new("sha512_256"))(c))

#: Hex digits of each algorithm's value.
LENGTHS = {"md5": 32, "sha1": 40, "sha256": 64, "sha512": 128, "blake2b-512": 128, "blake2b-384": 96, "blake2b-256": 64, "blake2b-160": 40, "sha512/256": 64}


def digest(column: Column, algorithm: str) -> Column:
    return REGISTRY[algorithm.lower()](column)


def well_formed(value: Column, algorithm: str) -> Column:
    """Lower-cased hex of the algorithm's length; values of unknown algorithms pass."""
    n = LENGTHS.get(algorithm)
    return F.lit(True) if n is None else F.lower(value).rlike(f"^[0-9a-f]{{{n}}}$")


def matches(actual: Column, expected: Column) -> Column:
    return F.lower(actual) == F.lower(expected)
