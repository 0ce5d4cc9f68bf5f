"""Column functions for what the recordings' pipelines do to single values and short arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded(c: Column, width: int) -> Column:
    return F.lpad(c.cast("string"), width, "0")


def part(c: Column, place: int, sep: str = "_") -> Column:
    """A part of a name, counted from 0, or from the end with a negative place."""
    return F.element_at(F.split(c, sep), place + 1 if place >= 0 else place)


def without_suffix(c: Column, suffix: str) -> Column:
    return F.regexp_replace(c, f"{suffix}$", "")


def parse_day(c: Column, pattern: str = "yyyy-MM-dd") -> Column:
    return F.to_date(c, pattern)


def from_epoch(seconds: Column) -> Column:
    """The timestamp to the nearest microsecond. Whole seconds are multiplied as integers: a double holds microseconds exactly only up to the year 2255."""
    whole = F.floor(seconds)
    return F.timestamp_micros(whole * 1_000_000 + F.round((seconds - whole) * 1e6).cast("long"))


def log_spaced(low: float, high: float, n: int) -> Column:
    """10 ** low to 10 ** high in n equal steps of the exponent, as an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.pow(F.lit(10.0), low + k * ((high - low) / max(n - 1, 1))))


def roll(a: Column, k: int) -> Column:
    """Elements moved k places to the right, around the end."""
    n = F.size(a)
    return F.transform(a, lambda x, i: F.element_at(a, F.pmod(i - k, n) + 1))


def take(a: Column, places: Column) -> Column:
    return F.transform(places, lambda i: F.element_at(a, i + 1))


def argmin(a: Column) -> Column:
    """Place of the smallest element that is neither null nor NaN; null without one."""
    pairs = F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.array_min(F.filter(pairs, lambda p: p["x"].isNotNull() & ~F.isnan(p["x"])))["i"]


def differences(a: Column) -> Column:
    return F.zip_with(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(1))), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1))), lambda x, y: x - y)


def options(c: Column, schema: str = "map<string,string>") -> Column:
    """A JSON object's entries."""
    return F.from_json(c, schema)
