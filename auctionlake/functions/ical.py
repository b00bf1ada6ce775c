"""Fields of calendar events."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from auctionlake.functions import patterns as P
from auctionlake.functions.base import bind, col, found, strip, truthy


def ical_unescape(value: str | Column) -> Column:
    c = col(value)
    for escaped, plain in (("\\n", "\n"), ("\\N", "\n"), ("\\,", ","), ("\\;", ";"), ("\\\\", "\\")):
        c = F.replace(c, F.lit(escaped), F.lit(plain))
    return c


def ical_ts(value: str | Column) -> Column:
    """``YYYY-MM-DD HH:MM`` with a trailing Z for UTC stamps; the zone name of local stamps is dropped."""
    c = col(value)
    return F.when(c.rlike(P.ICAL_STAMP), F.regexp_replace(F.regexp_extract(c, P.ICAL_STAMP, 0), P.ICAL_STAMP, "$1-$2-$3 $4:$5$7"))


def ical_entries(block: str | Column, names: tuple[str, ...]) -> Column:
    """The named properties and all custom-field lines of a block, in order, as an array of (name, id, value), read in one scan.

    A custom field's name is marked with ``=``; the FIELDVALUE line of an id goes by ``#``.
    """
    plain = P.ICAL_FIELD % "|".join(map(re.escape, names))
    lines = F.regexp_extract_all(col(block), F.lit(f"{plain}|{P.ICAL_CUSTOM_LINE.removeprefix('(?m)')}"), F.lit(0))
    any_custom = P.ICAL_CUSTOM % "(.*?)"

    def entry(name: Column, ident: Column, value: Column) -> Column:
        return F.struct(name.alias("name"), ident.alias("id"), value.alias("value"))

    def parsed(line: Column) -> Column:
        custom = entry(F.concat(F.lit("="), F.regexp_extract(line, any_custom, 1)), F.regexp_extract(line, any_custom, 2), F.regexp_extract(line, any_custom, 3))
        continued = entry(F.lit("#"), F.regexp_extract(line, P.ICAL_CONTINUED, 1), F.regexp_extract(line, P.ICAL_CONTINUED, 2))
        own = entry(F.regexp_extract(line, r"^([^;:]*)", 1), F.lit(""), F.substring(line, F.instr(line, ":") + 1, F.length(line)))
        return F.when(line.startswith("X-TRUMBA-CUSTOMFIELD;NAME"), custom).when(line.startswith("X-TRUMBA-CUSTOMFIELD;FIELDVALUE"), continued).otherwise(own)

    return F.filter(F.transform(lines, parsed), lambda e: ((e["name"] != "=") & (e["name"] != "#")) | (e["id"] != ""))


def _first(entries: Column, test) -> Column:
    return F.get(F.filter(entries, test), F.lit(0))


def entry_field(entries: Column, name: str) -> Column:
    """Raw value of a plain property; null when the property is missing, '' when it is empty."""
    return strip(_first(entries, lambda e: e["name"] == name)["value"])


def entry_custom(entries: Column, name: str) -> Column:
    """Value of a named custom field, taken from its FIELDVALUE line when the field itself has none."""

    def given(head: Column) -> Column:
        value = strip(head["value"])
        unset = (value == "") | F.lower(value).isin("value", "n/a")
        continued = strip(_first(entries, lambda e: (e["name"] == "#") & (e["id"] == head["id"]))["value"])
        return ical_unescape(F.when(unset, continued).otherwise(value))

    return bind(_first(entries, lambda e: e["name"] == f"={name}"), given)


def ical_field(block: str | Column, name: str) -> Column:
    """``entry_field`` of one property of a block."""
    return entry_field(ical_entries(block, (name,)), name)


def ical_custom(block: str | Column, name: str) -> Column:
    """``entry_custom`` of one field of a block."""
    return bind(ical_entries(block, ()), lambda entries: entry_custom(entries, name))


def pin_from_link(link: str | Column) -> Column:
    c = col(link)
    return F.coalesce(*[found(c, p) for p in P.PIN_LINKS])


def uid_to_id(uid: str | Column) -> Column:
    c = col(uid)
    number = found(c, P.EVENT_NUMBER)
    return F.when(truthy(c), F.coalesce(F.concat(F.lit("trumba_"), number), strip(c)))
