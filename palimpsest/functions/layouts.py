"""Storage layouts: object id to object root path, as columns. Ids that a layout can't map give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.paths import percent_encode


def _digest(value: Column, algorithm: str) -> Column:
    data = value.cast("binary")
    return {"md5": F.md5(data), "sha1": F.sha1(data), "sha256": F.sha2(data, 256), "sha512": F.sha2(data, 512)}[algorithm]


def _tuples(digest: Column, size: int, count: int) -> list[Column]:
    return [F.substring(digest, i * size + 1, size) for i in range(count)]


def validate(size: int, count: int, digest_length: int) -> None:
    """Both zero or neither, both at most 32, and no more characters than the digest has."""
    if not (0 <= size <= 32 and 0 <= count <= 32) or (size == 0) != (count == 0) or size * count > digest_length:
        raise ValueError(f"tuple size {size} and number {count} do not fit a digest of {digest_length}")


def flat(object_id: Column) -> Column:
    return F.when(~F.contains(object_id, F.lit("/")) & (object_id != "extensions"), object_id)


def hashed_ntuple(object_id: Column, size: int = 3, count: int = 3, short_root: bool = False, algorithm: str = "sha256") -> Column:
    validate(size, count, {"md5": 32, "sha1": 40, "sha256": 64, "sha512": 128}[algorithm])
    d = _digest(object_id, algorithm)
    last = F.substr(d, F.lit(size * count + 1)) if short_root else d
    return F.concat_ws("/", *_tuples(d, size, count), last)


def hashed_id(object_id: Column, size: int = 3, count: int = 3, algorithm: str = "sha256") -> Column:
    """Digest tuples, then the escaped id; over 100 characters the first 100 and the digest."""
    d, name = _digest(object_id, algorithm), percent_encode(object_id, keep="A-Za-z0-9_-")
    return F.concat_ws("/", *_tuples(d, size, count), F.when(F.length(name) > 100, F.concat_ws("-", F.substring(name, 1, 100), d)).otherwise(name))


def flat_omit_prefix(object_id: Column, delimiter: str) -> Column:
    """What follows the last delimiter, in whatever case that is written."""
    at = F.locate(delimiter.lower()[::-1], F.lower(F.reverse(object_id)))
    tail = F.when(at > 0, F.substr(object_id, F.length(object_id) - at + 2)).otherwise(object_id)
    return F.when((tail != "") & (tail != "extensions"), tail)


def ntuple_omit_prefix(object_id: Column, delimiter: str, size: int = 3, count: int = 3, pad_left: bool = True, reverse: bool = False) -> Column:
    """The id without its prefix, zero-padded and cut into tuples; ASCII ids with the delimiter only."""
    at = F.locate(delimiter.lower()[::-1], F.lower(F.reverse(object_id)))
    base = F.when((at > 0) & object_id.rlike("^[\\x00-\\x7F]*$"), F.substr(object_id, F.length(object_id) - at + 2))
    turned = F.reverse(base) if reverse else base
    zeros = F.repeat(F.lit("0"), F.greatest(F.lit(size * count) - F.length(turned), F.lit(0)))
    padded = F.concat(zeros, turned) if pad_left else F.concat(turned, zeros)
    return F.when(base != "", F.concat_ws("/", *_tuples(padded, size, count), base))


#: Layouts by the name of their extension; register() adds more.
LAYOUTS = {
    "0002-flat-direct-storage-layout": flat,
    "0003-hash-and-id-n-tuple-storage-layout": hashed_id,
    "0004-hashed-n-tuple-storage-layout": hashed_ntuple,
    "0006-flat-omit-prefix-storage-layout": flat_omit_prefix,
    "0007-n-tuple-omit-prefix-storage-layout": ntuple_omit_prefix,
}


def register(name: str, layout) -> None:
    LAYOUTS[name] = layout


def mapped(object_id: Column, name: str, **config) -> Column:
    """Object root of an id by a named layout; unknown names raise KeyError."""
    return LAYOUTS[name](object_id, **config)
