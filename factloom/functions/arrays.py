"""Array helpers as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def distinct_ci(xs: Column, most: int | None = None) -> Column:
    """Strings in order, each once whatever its case; the first ``most``."""
    def first_of_each(ys: Column) -> Column:
        return let(F.transform(ys, lambda y: F.lower(y)), lambda low: F.filter(ys, lambda y, i: F.array_position(low, F.lower(y)) == i + 1))

    out = let(xs, first_of_each)
    return F.slice(out, 1, most) if most else out


def found(t: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern."""
    return F.regexp_extract_all(t, F.lit(pattern), F.lit(group))


def trimmed(t: Column) -> Column:
    """Without blanks at the ends, whatever their width; tabs and line ends stay."""
    return F.regexp_replace(t, r"^\p{Zs}+|\p{Zs}+\z", "")


def strings() -> Column:
    return F.array().cast("array<string>")


def lowered(xs: Column) -> Column:
    return F.transform(xs, lambda x: F.lower(x))


def without(xs: Column, low_known: Column) -> Column:
    """Strings whose lower case isn't among ``low_known``."""
    return F.filter(xs, lambda x: ~F.array_contains(low_known, F.lower(x)))


def hits(xs: Column, low_text: Column) -> Column:
    """Strings that a lower-case text holds, whatever their case."""
    return F.filter(xs, lambda x: low_text.contains(F.lower(x)))
