"""Partitioning, backoff, comparison and parsing functions, all as Column expressions (no UDF)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def string_hash32(s: Column | str) -> Column:
    """The signed 32-bit hash h = 31 * h + c over the UTF-16 units of a string (characters of the basic plane)."""
    h = F.aggregate(F.split(_col(s), ""), F.lit(0).cast("bigint"), lambda acc, c: F.pmod(acc * 31 + F.when(c == "", F.lit(0)).otherwise(F.ascii(c)), F.lit(4294967296)))
    return F.when(h >= 2147483648, h - 4294967296).otherwise(h).cast("int")


def hash_partition(key: Column | str, n: int) -> Column:
    """Partition of a key in 0..n-1; partition 0 if there are none; null keys stay null (the producer picks any)."""
    if n <= 0:
        return F.lit(0)
    return F.pmod(string_hash32(key), F.lit(n))


def routed_partition(forced: Column | str, key: Column | str, n: int) -> Column:
    """A header that names a partition wins over the key's hash."""
    return F.coalesce(F.pmod(_col(forced).try_cast("int"), F.lit(n)), hash_partition(key, n))


def record_id(id_: Column | str) -> Column:
    """``ms-seq`` as a struct that compares by number; a missing sequence is 0."""
    parts = F.split(_col(id_), "-")
    return F.struct(parts[0].try_cast("bigint").alias("ms"), F.coalesce(F.get(parts, 1).try_cast("bigint"), F.lit(0).cast("bigint")).alias("seq"))


def backoff_ms(attempt: Column | str, initial_ms: int, multiplier: float = 2.0, max_ms: int = 10_000) -> Column:
    """Delay before retry ``attempt`` (from 1): initial * multiplier^(attempt - 1), at most ``max_ms``."""
    return F.least(F.lit(max_ms).cast("bigint"), F.floor(F.lit(initial_ms) * F.pow(F.lit(float(multiplier)), _col(attempt) - 1)).cast("bigint"))


def wildcard(pattern: str) -> str:
    """A regular expression for a pattern in which ``*`` stands for anything."""
    return "^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$"


def table_allowed(database: Column | str, table: Column | str, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Whether a table is wanted; patterns are matched with ``table`` and ``database.table``; excluding wins; no includes: all."""
    name, full = _col(table), F.concat_ws(".", _col(database), _col(table))

    def any_of(patterns: list[str]) -> Column:
        out = F.lit(False)
        for p in patterns:
            out = out | name.rlike(wildcard(p)) | full.rlike(wildcard(p))
        return out

    wanted = any_of(list(include)) if include else F.lit(True)
    return wanted & ~any_of(list(exclude))


def change_key(after: Column | str) -> Column:
    """Key of a changed row: ``id``, else ``pk``, else its non-null values joined by ``_``."""
    a = _col(after)
    return F.coalesce(F.try_element_at(a, F.lit("id")), F.try_element_at(a, F.lit("pk")), F.concat_ws("_", F.map_values(a)))


def decoded_columns(text: Column | str) -> Column:
    """``name[type]:value`` pairs of a logical-decoding line as a map; quoted values may hold blanks and doubled quotes."""
    item = r"([^\s\[]+)\[[^\]]*\]:('(?:[^']|'')*'|\S+)"
    names = F.regexp_extract_all(_col(text), F.lit(item), F.lit(1))
    values = F.transform(
        F.regexp_extract_all(_col(text), F.lit(item), F.lit(2)),
        lambda v: F.when(v == "null", F.lit(None)).when(v.startswith("'"), F.replace(F.substring(v, F.lit(2), F.length(v) - 2), F.lit("''"), F.lit("'"))).otherwise(v),
    )
    return F.map_from_arrays(names, values)


def ring_position(name: Column | str) -> Column:
    """Place on a hash ring: the first 8 bytes of MD5 as a number, without the sign bit."""
    digits = F.md5(_col(name).cast("binary"))
    first, rest = (F.conv(F.substring(digits, at, n), 16, 10).cast("bigint") for at, n in ((1, 1), (2, 15)))
    return F.shiftleft(first.bitwiseAND(7), 60) + rest


def instance_id(service: Column | str, host: Column | str, port: Column | str) -> Column:
    return F.concat(_col(service), F.lit("-"), _col(host), F.lit(":"), _col(port).cast("string"))


def is_offloaded(payload: Column | str, limit: int = 65536) -> Column:
    """Whether a payload is too large to stay inside its record."""
    return F.octet_length(_col(payload)) > limit


def significant_change(old: Column | str, new: Column | str, kind: str, threshold: float = 0.0) -> Column:
    """PERCENTAGE, ABSOLUTE or ANY change beyond a threshold; a missing side is always significant; from 0 any change is."""
    o, n = _col(old), _col(new)
    if kind == "PERCENTAGE":
        rule = F.when(o == 0, n != 0).otherwise(F.abs(n - o) / F.abs(o) * 100 > threshold)
    elif kind == "ABSOLUTE":
        rule = F.abs(n - o) > threshold
    elif kind == "ANY":
        rule = o != n
    else:
        raise ValueError(f"unknown kind of change: {kind}")
    return F.when(o.isNull() | n.isNull(), F.lit(True)).otherwise(rule)


def compares(actual: Column | str, op: str, wanted: str) -> Column:
    """``actual op wanted``: by number if both are numbers, else by text; a missing value never matches."""
    a, w = _col(actual).cast("string"), F.lit(str(wanted))
    x, y = a.try_cast("double"), w.try_cast("double")
    ops = {
        "==": (x == y, a == w), "!=": (x != y, a != w), ">": (x > y, a > w), ">=": (x >= y, a >= w), "<": (x < y, a < w), "<=": (x <= y, a <= w),
    }
    if op not in ops:
        raise ValueError(f"unknown comparison: {op}")
    by_number, by_text = ops[op]
    return F.coalesce(by_number, by_text, F.lit(False))


def matches(fields: Column | str, conditions: dict[str, str], as_json: bool = False) -> Column:
    """All of ``{"field": value}`` or ``{"field:op": value}`` hold for a map column (or a JSON object's text)."""
    out = F.lit(True)
    for key, wanted in conditions.items():
        name, _, op = key.partition(":")
        actual = F.get_json_object(_col(fields), f"$.{name}") if as_json else F.try_element_at(_col(fields), F.lit(name))
        out = out & compares(actual, op or "==", wanted)
    return out
