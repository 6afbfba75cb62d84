"""Resolutions ('10kb') and bin sizes (10000), natural order of names."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of resolutions: fixed values.
UNITS = {"b": 1, "kb": 1_000, "mb": 1_000_000, "gb": 1_000_000_000}
PATTERN = r"^\s*([0-9]+\.?[0-9]*|\.[0-9]+)\s*([kmg]?b)\s*$"


def to_binsize(resolution: str) -> int:
    """Base pairs of a resolution; ValueError where it has no known unit."""
    found = re.match(PATTERN, resolution.lower())
    if not found:
        raise ValueError(f"not a resolution: {resolution!r}")
    return int(Decimal(found[1]) * UNITS[found[2]])


def to_resolution(binsize: int) -> str:
    """The largest unit of which a bin has one or more, without trailing zeros."""
    unit = max((u for u in UNITS if UNITS[u] <= binsize), key=UNITS.get, default="b")
    text = format(Decimal(binsize) / UNITS[unit], "f")
    return (text.rstrip("0").rstrip(".") if "." in text else text) + unit


def binsize_of(resolution: Column) -> Column:
    """to_binsize of a column; null where the text is no resolution."""
    low = F.lower(resolution)
    scale = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    number = F.regexp_extract(low, PATTERN, 1).try_cast("decimal(28,9)")
    return (number * F.try_element_at(scale, F.regexp_extract(low, PATTERN, 2))).cast("bigint")


def resolution_of(binsize: Column) -> Column:
    """to_resolution of a column."""
    out = F.lit(None).cast("string")
    for unit, size in UNITS.items():
        text = F.regexp_replace((binsize.cast("decimal(28,9)") / F.lit(size)).cast("decimal(28,9)").cast("string"), r"\.?0+$", "")
        out = F.when(binsize >= size, F.concat(text, F.lit(unit))).otherwise(out)
    return out


def natural_key(name: Column) -> Column:
    """Sorts names as people do: runs of digits by their value (up to 18 digits)."""
    runs = F.regexp_extract_all(name, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    padded = F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(F.regexp_replace(x, "^0+(?=.)", ""), 18, "0")).otherwise(x))
    return F.array_join(padded, "\u0001")
