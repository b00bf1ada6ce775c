"""Small building blocks shared by the column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\f\u000b\u00a0"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def truthy(c: Column) -> Column:
    """Neither null nor empty; never null itself."""
    return F.coalesce(c != "", F.lit(False))


def filled(c: Column) -> Column:
    """Holds something besides white space; never null itself."""
    return F.coalesce(strip(c) != "", F.lit(False))


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null. The group must not match an empty text; the text is scanned once, match or not."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def first_found(text: Column, patterns) -> Column:
    """The first pattern that matches wins; later ones are not evaluated."""
    return F.coalesce(*[found(text, p) for p in patterns])


def contains_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def title_case(c: Column) -> Column:
    """Capitalise every run of letters, also after digits and hyphens."""
    runs = F.split(F.lower(c), r"(?<=\P{L})(?=\p{L})")
    return F.array_join(F.transform(runs, F.initcap), "")


def try_double(c: Column) -> Column:
    return c.try_cast("double")


def rest(array: Column) -> Column:
    """All elements but the first."""
    return F.slice(array, F.lit(2), F.greatest(F.size(array) - 1, F.lit(0)))


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)
