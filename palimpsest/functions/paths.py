"""Path functions and constraints as columns. A constraint gives an array of violation names; empty means fine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that each target's logical path mapping escapes.
ENCODE_WINDOWS = '<>:"\\|?* '
ENCODE_LINUX = " "
ENCODE_CLOUD = "\\#[]*? "
ENCODE_ALL = '<>:"\\|?* #[]'
# Names that Windows reserves.
RESERVED = r"(?i)^(?:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(?:\.[^.]+)?$"
# Characters that each target forbids in file names.
BLOCKED_WINDOWS = '<>:"\\|?*'
BLOCKED_CLOUD = "\\#[]*?"
BLOCKED_ALL = '<>:"\\|?*#[]'


def escaped(char: Column) -> Column:
    """%xx for each UTF-8 byte in lower case; the first nibble of a three- or four-byte lead is upper case."""
    code = F.regexp_replace(F.lower(F.hex(F.encode(char, "UTF-8"))), "(..)", "%$1")
    return F.when(F.octet_length(char) >= 3, F.concat(F.upper(F.substring(code, 1, 2)), F.substr(code, F.lit(3)))).otherwise(code)


def percent_encode(path: Column, keep: str | None = None, encode: str | None = None) -> Column:
    """Escapes what is not in the class `keep`, or what is in the characters `encode`; the per cent sign always."""
    def one(c):
        if keep is not None:
            return F.when(c.rlike(f"^[{keep}]$"), c).otherwise(escaped(c))
        return F.when(F.contains(F.lit("%" + encode), c) & (c != ""), escaped(c)).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(path, ""), lambda c: c != ""), one), "")


def escaped_class(path: Column, chars: str, control: str = "") -> Column:
    """Escapes the per cent sign, the given characters and those of the ranges in `control` (as in a character class)."""
    cls = "[" + control + "".join("\\" + c if c in "\\[]^-" else c for c in "%" + chars) + "]"
    return F.array_join(F.transform(F.filter(F.split(path, ""), lambda c: c != ""), lambda c: F.when(c.rlike(f"^{cls}$"), escaped(c)).otherwise(c)), "")


# Fixed value: the control characters that every mapping but the direct one escapes.
CONTROLS = "\\x00-\\x1f\\x7f-\\xa0"

#: Mappings from logical to content paths, by name; register() adds more.
MAPPERS = {
    "direct": lambda c: c,
    "linux": lambda c: escaped_class(c, ENCODE_LINUX, CONTROLS),
    "windows": lambda c: escaped_class(c, ENCODE_WINDOWS, CONTROLS),
    "cloud": lambda c: escaped_class(c, ENCODE_CLOUD, CONTROLS),
    "all": lambda c: escaped_class(c, ENCODE_ALL, CONTROLS),
    "conservative": lambda c: percent_encode(c, keep="A-Za-z0-9_-"),
}


def register_mapper(name: str, mapper) -> None:
    MAPPERS[name] = mapper


def mapped(path: Column, mapper: str) -> Column:
    """Content path of a logical path by a named mapping."""
    return MAPPERS[mapper](path)


# --- constraints of one kind: each gives a label where the value breaks it, else null


def begin_end(value: Column, label: str, begins: str | None = None, ends: str | None = None, must: bool = False) -> Column:
    """The value must (or must not) begin with `begins` and end with `ends`, where given."""
    tests = ([value.startswith(begins)] if begins is not None else []) + ([value.endswith(ends)] if ends is not None else [])
    broken = F.lit(False)
    for t in tests:
        broken = broken | (~t if must else t)
    return F.when(broken, label)


def length(value: Column, label: str, chars: int | None = None, octets: int | None = None) -> Column:
    over = F.lit(False) if chars is None else utf16_length(value) > chars
    return F.when(over if octets is None else over | (F.octet_length(value) > octets), label)


def pattern(value: Column, label: str, regex: str, must: bool = False) -> Column:
    """The whole value must (or must not) match."""
    fits = value.rlike(f"^(?:{regex})$")
    return F.when(~fits if must else fits, label)


def characters(value: Column, label: str, chars: str, allow: bool = False) -> Column:
    """The value holds none of the characters, or with `allow` no others."""
    return F.when(value.rlike("[^" + _class(chars)[1:]) if allow else value.rlike(_class(chars)), label)


def logical_violations(path: Column, backslash: bool = False) -> Column:
    """Rules of logical paths, on request with the one against backslashes as separators."""
    return F.array_compact(F.array(*base_violations(path), *([F.when(F.contains(path, F.lit("\\")), "backslash")] if backslash else [])))


def utf16_length(path: Column) -> Column:
    """Characters as UTF-16 units."""
    return (F.octet_length(F.encode(path, "UTF-16BE")) / 2).cast("int")


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "\\[]^-" else c for c in chars) + "]"


def base_violations(path: Column) -> list[Column]:
    """Rules that hold for every content path."""
    parts = F.split(path, "/", -1)
    return [
        F.when(path.startswith("/"), "leading_slash"),
        F.when(path.endswith("/"), "trailing_slash"),
        F.when(F.exists(parts, lambda x: x == ""), "empty_part"),
        F.when(F.exists(parts, lambda x: x.isin(".", "..")), "dot_part"),
    ]


def violations(path: Column, preset: str) -> Column:
    """Violations of a preset: minimal, unix, windows, cloud or all."""
    names = F.split(path, "/", -1)
    any_name = lambda test, label: F.when(F.exists(names, test), label)
    rules = base_violations(path)
    if preset in ("unix", "all"):
        rules.append(any_name(lambda x: F.octet_length(x) > 255, "name_bytes"))
    if preset == "unix":
        rules.append(F.when(F.contains(path, F.lit("\0")), "blocked_char"))
    if preset in ("windows", "cloud", "all"):
        most = 255 if preset == "windows" else 254
        rules.append(any_name(lambda x: utf16_length(x) > most, "name_chars"))
        rules.append(any_name(lambda x: x.rlike("[ .]$"), "space_or_period_at_end"))
        rules.append(F.when(path.rlike("[\\x00-\\x1F]"), "control_char"))
        blocked = {"windows": BLOCKED_WINDOWS, "cloud": BLOCKED_CLOUD, "all": BLOCKED_ALL}[preset]
        rules.append(F.when(path.rlike(_class(blocked)), "blocked_char"))
    if preset in ("windows", "all"):
        rules.append(any_name(lambda x: x.rlike(RESERVED), "reserved_name"))
    if preset in ("cloud", "all"):
        rules.append(F.when(F.octet_length(path) > 1024, "path_bytes"))
        rules.append(F.when(path.rlike("[\\x7F-\\xA0]"), "extended_control_char"))
    return F.array_compact(F.array(*rules))


def ancestors(path: Column) -> Column:
    """Every proper directory prefix of a path."""
    parts = F.split(path, "/")
    return F.transform(F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: i < F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def content_path(version: Column, mapped: Column, content_dir: str = "content", revision: Column | None = None) -> Column:
    """Content path of a mapped logical path; with a revision, in the mutable head."""
    if revision is not None:
        return F.concat_ws("/", F.lit(MUTABLE_HEAD), F.lit("head"), F.lit(content_dir), revision, mapped)
    return F.concat_ws("/", version, F.lit(content_dir), mapped)


# Fixed value: the folder of the mutable head.
MUTABLE_HEAD = "extensions/0005-mutable-head"


def object_paths(root: Column, algorithm: Column, version: Column) -> dict[str, Column]:
    """The paths of an object's parts below the storage root."""
    at = lambda *parts: F.concat_ws("/", root, *(F.lit(p) if isinstance(p, str) else p for p in parts))
    sidecar = F.concat(F.lit("inventory.json."), algorithm)
    return {
        "inventory": at("inventory.json"), "sidecar": at(sidecar), "version": at(version), "version_inventory": at(version, "inventory.json"),
        "version_sidecar": at(version, sidecar), "mutable_head": at(MUTABLE_HEAD, "head"), "mutable_inventory": at(MUTABLE_HEAD, "head", "inventory.json"),
        "revisions": at(MUTABLE_HEAD, "revisions"), "logs": at("logs"), "extensions": at("extensions"),
    }
