"""Scalar column helpers (all JVM-side built-ins, no Python UDF)."""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

def ts_lit(value) -> Column:
    """A TIMESTAMP_NTZ literal (test data and oracle output are NTZ)."""
    if isinstance(value, Column):
        return value
    if isinstance(value, (_dt.datetime, _dt.date)):
        value = value.isoformat(sep=" ") if isinstance(value, _dt.datetime) else value.isoformat()
    return F.lit(str(value)).cast("timestamp_ntz")


def seconds_between(later: Column | str, earlier: Column | str) -> Column:
    """``later - earlier`` in seconds (R7 freshness, N6 durations)."""
    a = F.col(later) if isinstance(later, str) else later
    b = F.col(earlier) if isinstance(earlier, str) else earlier
    return interval_micros(a - b) / F.lit(1_000_000.0)


def interval_micros(i: Column) -> Column:
    """Microseconds of a day-time interval.  The difference of two zone-less
    times is one; no cast to a zoned time, so the session zone has no part."""
    whole = ((F.extract(F.lit("DAY"), i).cast("bigint") * 24 + F.extract(F.lit("HOUR"), i)) * 60
             + F.extract(F.lit("MINUTE"), i)) * 60
    return whole * 1_000_000 + (F.extract(F.lit("SECOND"), i) * 1_000_000).cast("bigint")


def micros(ts: Column) -> Column:
    """Microseconds of a zone-less time since 1970."""
    return interval_micros(ts - ts_lit("1970-01-01 00:00:00"))


def hour_of(ts: Column) -> Column:
    """The start of the hour of a zone-less time (E5); the session zone has no part."""
    return F.timestamp_add("HOUR", F.floor(micros(ts) / 3_600_000_000).cast("int"), ts_lit("1970-01-01 00:00:00"))


def add_hours(ts: Column | str, hours: Column | int) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    h = hours if isinstance(hours, Column) else F.lit(hours)
    return F.timestamp_add("HOUR", h, c)


def add_seconds(ts: Column | str, seconds: Column | int) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    s = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return F.timestamp_add("SECOND", s, c)


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, NULL when den is 0 or NULL (ANSI-safe)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def percent_or_zero(part: Column, total: Column) -> Column:
    """part / total * 100, 0 when total is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), total.cast("double")) * 100.0, F.lit(0.0))


def online_key(entity: Column | str, feature: Column | str) -> Column:
    """``entity:feature`` cache key."""
    e = F.col(entity) if isinstance(entity, str) else entity
    f = F.col(feature) if isinstance(feature, str) else feature
    return F.concat_ws(":", e, f)


def split_online_key(key: Column | str) -> tuple[Column, Column]:
    """Split on the *last* colon: entity ids may contain colons."""
    k = F.col(key) if isinstance(key, str) else key
    feature = F.substring_index(k, ":", -1)
    entity = k.substr(F.lit(1), F.length(k) - F.length(feature) - F.lit(1))
    return entity, feature


def _set_regex(pattern: str, i: int) -> tuple[str, int] | None:
    """The regex of the character set whose body begins at ``i``, and the place after its bracket; None
    if it has none.  The ends of a range may come in either order."""
    negated = pattern[i:i + 1] in ("!", "^") and pattern[i:i + 1] != ""
    j, chars = i + negated, []
    while j < len(pattern) and pattern[j] != "]":
        j += pattern[j] == "\\" and j + 1 < len(pattern)
        last = j
        if pattern[j + 1:j + 2] == "-" and j + 2 < len(pattern) and pattern[j + 2] != "]":
            last = j + 2 + (pattern[j + 2] == "\\" and j + 3 < len(pattern))
        lo, hi = sorted((pattern[j], pattern[last]))
        chars.append("-".join(re.sub(r"([\[\]\\^&-])", r"\\\1", c) for c in ((lo, hi) if last > j else (lo,))))
        j = last + 1
    if j >= len(pattern):
        return None
    if not chars:
        return ("." if negated else "(?!)"), j + 1
    return f"[{'^' if negated else ''}{''.join(chars)}]", j + 1


def glob_to_regex(pattern: str) -> str:
    """Translate a cache glob (``*``, ``?``, ``[...]``) into an anchored
    Java regex; a backslash takes the next character literally, an empty set
    matches nothing, every other character is matched literally, and any
    character may be a line break (E12)."""
    out, i = ["(?s)^"], 0
    while i < len(pattern):
        ch = pattern[i]
        found = _set_regex(pattern, i + 1) if ch == "[" else None
        if found:
            out.append(found[0])
            i = found[1]
            continue
        if ch == "\\" and i + 1 < len(pattern):
            i += 1
            ch = pattern[i]
            out.append(re.escape(ch))
        else:
            out.append({"*": ".*", "?": "."}.get(ch) or re.escape(ch))
        i += 1
    out.append("\\z")
    return "".join(out)


def glob_match(col: Column | str, pattern: str) -> Column:
    """Glob predicate: a literal prefix ``abc*`` becomes ``startswith``;
    anything else an anchored ``rlike``."""
    c = F.col(col) if isinstance(col, str) else col
    meta = set("*?[\\")
    if pattern.endswith("*") and not (set(pattern[:-1]) & meta):
        return c.startswith(pattern[:-1])
    if not (set(pattern) & meta):
        return c == F.lit(pattern)
    return c.rlike(glob_to_regex(pattern))


def decode_json_value(value_json: Column | str, dtype: Column | str) -> Column:
    """Decode a JSON scalar by the declared dtype.

    Returns the value rendered as STRING of the decoded type, or NULL when
    the JSON does not hold that type.  ``try_variant_get`` is strict per
    type, so ``"x"`` is not an int64 and ``25`` is not a bool.
    """
    v = F.try_parse_json(F.col(value_json) if isinstance(value_json, str) else value_json)
    d = F.col(dtype) if isinstance(dtype, str) else dtype
    kind = F.schema_of_variant(v)
    as_double = F.try_variant_get(v, "$", "double")
    as_long = F.try_variant_get(v, "$", "bigint")
    as_bool = F.try_variant_get(v, "$", "boolean")
    as_str = F.try_variant_get(v, "$", "string")
    numeric = kind.isin("BIGINT", "DOUBLE", "DECIMAL", "INT", "SMALLINT", "TINYINT", "FLOAT") | \
        kind.startswith("DECIMAL")
    integral = kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT")
    return (F.when((d == "float64") & numeric, as_double.cast("string"))
             .when((d == "int64") & integral, as_long.cast("string"))
             .when((d == "bool") & (kind == "BOOLEAN"), as_bool.cast("string"))
             .when((d == "string") & (kind == "STRING"), as_str))
