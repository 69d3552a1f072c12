"""Column helpers; all are built-in expressions that stay in the JVM."""

from __future__ import annotations

import json
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwork.model import STATES

__all__ = ["append", "append_capped", "in_mask", "json_contains", "json_has_key", "json_merge", "micros_of", "period_start", "retry_seconds", "split_list", "tags_all", "tags_any", "unique_key_hex", "unique_key_text", "plus_seconds"]

#: Longest duration that fits in 63 bits of nanoseconds, in seconds.
MOST_SECONDS = (2**63 - 1) / 1e9
#: Seconds from the first day of year 1 to the epoch.
YEAR_ONE = 62_135_596_800


def in_mask(mask: Column, state: Column) -> Column:
    """Whether the state's bit is set in the mask; null mask or unknown state: null."""
    bit = F.array_position(F.array(*(F.lit(s) for s in STATES)), state).cast("int") - 1
    return F.when(bit >= 0, F.call_function("getbit", mask, bit) == 1)


def append(items: Column, item: Column) -> Column:
    """``item`` at the end of an array; a null array is an empty one."""
    return F.when(items.isNull(), F.array(item)).otherwise(F.array_append(items, item))


def append_capped(items: Column, item: Column, most: int) -> Column:
    """Like :func:`append`, but the oldest go once there are ``most``."""
    kept = F.when(F.size(items) >= most, F.slice(items, F.size(items) - (most - 2), most - 1) if most > 1 else F.slice(items, 1, 0)).otherwise(items)
    return append(kept, item)


def split_list(text: Column, sep: str = ",") -> Column:
    """A separated list as an array; the empty text is the empty array."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, f"\\Q{sep}\\E"))


def tags_all(tags: Column, wanted: list[str]) -> Column:
    """Whether all of ``wanted`` are among the tags."""
    return F.size(F.array_except(F.array(*(F.lit(t) for t in wanted)), tags)) == 0


def tags_any(tags: Column, wanted: list[str]) -> Column:
    """Whether one of ``wanted`` is among the tags."""
    return F.arrays_overlap(tags, F.array(*(F.lit(t) for t in wanted)))


def micros_of(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def plus_seconds(ts: Column, seconds: Column) -> Column:
    """A zoneless timestamp some (fractions of) seconds later."""
    return F.timestamp_micros(micros_of(ts) + F.round(seconds * 1_000_000).cast("long")).cast("timestamp_ntz")


# --- JSON as text ------------------------------------------------------------


def _entries(text: Column) -> Column:
    """The fields of an object; null for what is none."""
    return F.try_parse_json(text).try_cast("map<string,variant>")


def json_merge(left: Column, right: Column) -> Column:
    """Shallow merge of two JSON objects: keys of ``right`` win. The result has
    the kept keys of ``left`` first; spacing is normalised. A null or blank
    ``left`` counts as empty; one that is no object, or can't be read, stays as
    it is, and so does any if ``right`` is null. Of a repeated key the last
    value counts, if the session allows such keys (see
    :func:`tarnwork.runtime.prepared`), else the text can't be read."""
    none = F.coalesce(F.trim(left) == "", F.lit(True))
    a, b = F.when(none, F.expr("cast(parse_json('{}') as map<string,variant>)")).otherwise(_entries(left)), _entries(right)
    kept = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    return F.when(a.isNull() | b.isNull(), left).otherwise(F.to_json(F.map_concat(kept, b)))


def json_has_key(text: Column, key: str) -> Column:
    """Whether the object has the key at its top, be its value null or not."""
    return F.coalesce(F.array_contains(F.json_object_keys(text), key), F.lit(False))


def _holder(want):
    return lambda x: F.coalesce(_holds(x, want), F.lit(False))


def _holds(value: Column, want) -> Column:
    kind = F.schema_of_variant(value)
    if isinstance(want, dict):
        out = kind.startswith("OBJECT")
        for k, v in want.items():
            inner = F.try_variant_get(value, f'$["{k}"]' if '"' not in k else f"$['{k}']", "variant")
            out = out & F.coalesce(_holds(inner, v), F.lit(False))
        return out
    if isinstance(want, list):
        items = value.try_cast("array<variant>")
        out = kind.startswith("ARRAY")
        for w in want:
            out = out & F.coalesce(F.exists(items, _holder(w)), F.lit(False))
        return out
    if want is None:
        return kind == "VOID"
    if isinstance(want, bool):
        return (kind == "BOOLEAN") & (value.try_cast("boolean") == want)
    if isinstance(want, str):
        return (kind == "STRING") & (value.try_cast("string") == want)
    number = kind.startswith("DECIMAL") | kind.isin("BIGINT", "DOUBLE", "FLOAT", "INT")
    same = value.try_cast("double") == float(want)
    if isinstance(want, int) and abs(want) < 10**38:  # whole numbers digit by digit
        same = same & (~kind.rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$") | (value.try_cast("decimal(38,0)") == F.lit(Decimal(want)).cast("decimal(38,0)")))
    return number & same


def json_contains(text: Column, fragment: str) -> Column:
    """Whether the JSON value contains the fragment: objects if every key is
    there with a contained value, arrays if every element is contained in some
    element, scalars if they are equal; an array also contains a scalar of its
    elements at the top. Null or unreadable text: false."""
    want = json.loads(fragment)
    value = F.try_parse_json(text)
    out = F.coalesce(_holds(value, want), F.lit(False))
    if not isinstance(want, dict | list):
        out = out | F.coalesce(_holds(value, [want]), F.lit(False))
    return out


# --- uniqueness and retries --------------------------------------------------


def period_start(ts: Column, seconds: int) -> Column:
    """``ts`` rounded down to whole periods counted from the first day of year 1."""
    at = F.floor(micros_of(ts) / 1_000_000).cast("long") + YEAR_ONE
    start = at - F.pmod(at, F.lit(seconds).cast("long")) - YEAR_ONE
    return F.timestamp_seconds(start).cast("timestamp_ntz")


def unique_key_text(kind: Column | None = None, args: Column | None = None, fields: list[str] | None = None, ts: Column | None = None, period: int | None = None, queue: Column | None = None) -> Column:
    """The text a unique key is the hash of: the given parts in fixed order.

    ``args``: all top-level fields in the order of their names, or only
    ``fields``; absent fields are left out, values keep their JSON form.
    """
    parts = []
    if kind is not None:
        parts.append(F.concat(F.lit("&kind="), kind))
    if args is not None:
        m = _entries(args)
        keys = F.array_sort(F.map_keys(m))
        if fields:
            keys = F.filter(keys, lambda k: k.isin(fields))
        pairs = F.transform(keys, lambda k: F.concat(F.to_json(F.array(k)).substr(F.lit(2), F.length(F.to_json(F.array(k))) - 2), F.lit(":"), F.to_json(F.element_at(m, k))))
        parts.append(F.concat(F.lit("&args={"), F.array_join(pairs, ","), F.lit("}")))
    if period is not None and ts is not None:
        parts.append(F.concat(F.lit("&period="), F.date_format(period_start(ts, period), "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    if queue is not None:
        parts.append(F.concat(F.lit("&queue="), queue))
    return F.concat(*parts) if parts else F.lit("")


def unique_key_hex(text: Column) -> Column:
    """The key itself, as hexadecimal text (``unhex`` gives the bytes)."""
    return F.sha2(text, 256)


def retry_seconds(errors: Column, jitter: Column | float = 0.0) -> Column:
    """Seconds till the next attempt after ``errors`` (an array) and one more:
    the fourth power of their number, plus the share ``jitter`` of it, capped."""
    n = F.coalesce(F.size(errors), F.lit(0))
    base = F.least(F.pow(F.greatest(n, F.lit(0)) + 1, F.lit(4)), F.lit(MOST_SECONDS))
    j = jitter if isinstance(jitter, Column) else F.lit(float(jitter))
    return F.when(base == MOST_SECONDS, base).otherwise(F.least(base + base * j, F.lit(MOST_SECONDS)))
