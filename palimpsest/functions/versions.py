"""Version numbers (v1, v02), revision numbers (r1), timestamps and URIs as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RFC3339 = r"(?i)^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{1,9})?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)$"


def number(version: Column) -> Column:
    return F.when(version.rlike(r"^v\d+$"), F.substr(version, F.lit(2)).try_cast("bigint"))


def padding(version: Column) -> Column:
    """Digits of a zero-padded number, else 0."""
    return F.when(version.rlike(r"^v0\d*$"), F.length(version) - 1).otherwise(0)


def named(vnum: Column, vpad: Column) -> Column:
    return F.concat(F.lit("v"), F.when(vpad > 0, F.lpad(vnum.cast("string"), 20, "0").substr(F.lit(21) - vpad, vpad)).otherwise(vnum.cast("string")))


def following(version: Column) -> Column:
    """The next version, null past the padded maximum."""
    n, pad = number(version) + 1, padding(version)
    return F.when((pad == 0) | (F.length(n.cast("string")) < pad), named(n, pad))


def preceding(version: Column) -> Column:
    n = number(version) - 1
    return F.when(n > 0, named(n, padding(version)))


def revision(name: Column) -> Column:
    n = F.when(name.rlike(r"^r\d+$"), F.substr(name, F.lit(2)).try_cast("bigint"))
    return F.when(n > 0, n)


def is_rfc3339(value: Column) -> Column:
    return value.rlike(RFC3339)


def is_uri(value: Column) -> Column:
    return value.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
