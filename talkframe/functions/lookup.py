"""Small fixed mappings as expressions, so a lookup stays inside the generated stage instead of becoming a join."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_map(table: Mapping[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def mapped(key: Column, table: Mapping[str, object], default: object = None) -> Column:
    """``table[key]``, or ``default`` when the key is absent or null."""
    found = F.try_element_at(literal_map(table), F.coalesce(key, F.lit("")))
    return found if default is None else F.coalesce(found, F.lit(default))


def any_contains(text: Column, needles: Iterable[str]) -> Column:
    out = F.lit(False)
    for needle in needles:
        out = out | text.contains(needle)
    return out


def count_contains(text: Column, needles: Iterable[str]) -> Column:
    out = F.lit(0)
    for needle in needles:
        out = out + text.contains(needle).cast("int")
    return out


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def noisy_or(p: Column, evidence: Column) -> Column:
    return F.lit(1.0) - (F.lit(1.0) - p) * (F.lit(1.0) - evidence)
