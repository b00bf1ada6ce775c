"""Facts read out of notice text: parcel ids, deeds, cases, counties, acreage, dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from auctionlake import dims
from auctionlake.functions import patterns as P
from auctionlake.functions.base import (
    bind, blank_to_null, col, contains_any, empty_to_null, first_found, found, strip, title_case, truthy,
)


def folded(text: Column) -> Column:
    """Text in lower case as the patterns that ignore case see it: the three other letters they take for i and s count as those."""
    for other, plain in (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s")):
        text = F.replace(text, F.lit(other), F.lit(plain))
    return F.lower(text)


def holding(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds all the words: what a pattern cannot match without, at a fraction of its cost."""
    return reduce(lambda a, b: a & b, [text.contains(w) for w in words])


def first_held(text: Column, patterns: tuple[str, ...], needed: tuple[tuple[str, ...], ...], low: Column | None = None) -> Column:
    """``first_found``, each pattern tried only on texts that hold the words it needs, in lower case."""
    low = folded(text) if low is None else low
    return F.coalesce(*[F.when(holding(low, words), found(text, p)) for p, words in zip(patterns, needed, strict=True)])


def _plausible_acres(text: Column, pattern: str) -> Column:
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    numbers = F.transform(hits, lambda h: F.replace(h, F.lit(","), F.lit("")).try_cast("double"))
    return F.try_element_at(F.filter(numbers, lambda v: (v > 0.1) & (v < 10000)), F.lit(1))


def acreage(text: str | Column, low: Column | None = None) -> Column:
    """First plausible acreage; wordings are tried in order of trust, each only on texts that hold its plain words."""
    text = col(text)

    low = folded(text) if low is None else low
    ways = [F.when(low.contains(word), _plausible_acres(text, p)) for p, word in zip(P.ACREAGE, P.ACREAGE_WORDS, strict=True)]
    return F.when(low.contains("acre"), F.coalesce(*ways))


def normalise_pin(raw: str | Column) -> Column:
    """Runs of blanks, en-dashes and question marks stand for one hyphen."""
    c = F.btrim(strip(col(raw)), F.lit(","))
    return F.btrim(F.regexp_replace(c, P.PIN_SEPARATORS, "-"), F.lit("-"))


def pin(text: str | Column, low: Column | None = None) -> Column:
    """Tax parcel id. A text is scanned only for wordings whose plain words it holds."""
    return normalise_pin(first_held(col(text), P.PIN, P.PIN_NEEDS, low))


def deed_plat(text: str | Column) -> Column:
    """Recording reference as one tagged string, such as ``Deed:Bk12Pg34`` or ``Plat:File5Pg6``. The text is scanned once for each
    wording whose letters it holds until one is found; its numbers are read from what matched."""
    text = col(text)

    def tagged(p: str, tag: str, sep: str) -> Column:
        return bind(found(text, p, 0), lambda m: F.concat(F.lit(tag), F.regexp_extract(m, p, 1), F.lit(sep), F.regexp_extract(m, p, 2)))

    return F.coalesce(*[F.when(holding(text, needs), tagged(*wording)) for wording, needs in zip(P.DEED_PLAT, P.DEED_PLAT_NEEDS, strict=True)])


def deed_only(reference: str | Column) -> Column:
    reference = col(reference)
    return F.when(reference.startswith("Deed:"), reference)


def court_case(text: str | Column) -> Column:
    return F.upper(first_found(col(text), P.COURT_CASE))


def sp_case(text: str | Column, state: str = "NC") -> Column:
    return found(col(text), P.SP_CASE[state])


def notice_county(text: str | Column, slug: str | Column | None = None) -> Column:
    """County a notice speaks of. Only the first upper-case ``X COUNTY`` counts, unless it is NORTH."""
    text = col(text)
    ways = [
        found(text, P.COUNTY_OF),
        F.nullif(found(text, P.COUNTY_UPPER), F.lit("NORTH")),
        found(text, P.COUNTY_LATE_OF),
        found(text, P.COUNTY_COURT),
    ]
    if slug is not None:
        ways.append(found(col(slug), P.COUNTY_SLUG))
    return F.initcap(F.lower(F.coalesce(*ways)))


def grid_county(text: str | Column, state: str = "NC") -> Column:
    text = col(text)
    return F.coalesce(*[blank_to_null(F.regexp_extract(text, p, 1)) for p in P.GRID_COUNTY[state]])


def office_county(label: str | Column) -> Column:
    return F.initcap(F.lower(first_found(col(label), P.OFFICE_COUNTY)))


def notice_address(text: str | Column, low: Column | None = None) -> Column:
    text = col(text)
    return F.btrim(strip(F.when((folded(text) if low is None else low).contains("property"), found(text, P.NOTICE_ADDRESS))), F.lit(".,"))


def _iso_date(text: Column, pattern: str) -> Column:
    """Year, month and day of the first match, found by one scan of the text and read from what matched."""
    months = F.array(*[F.lit(m.lower()) for m in P.MONTHS])

    def iso(m: Column) -> Column:
        month = F.array_position(months, F.lower(F.substring(F.regexp_extract(m, pattern, 1), 1, 3)))
        day = F.lpad(F.regexp_extract(m, pattern, 2), 2, "0")
        return F.when(m.isNotNull(), F.concat_ws("-", F.regexp_extract(m, pattern, 3), F.lpad(month.cast("string"), 2, "0"), day))

    return bind(found(text, pattern, 0), iso)


def auction_date(text: str | Column, low: Column | None = None) -> Column:
    """ISO text of the announced sale day. The day is not validated; see ``auction_day``."""
    text = col(text)

    low = folded(text) if low is None else low
    dated = F.coalesce(F.when(low.contains("date"), _iso_date(text, P.DATE_OF_SALE)), _iso_date(text, P.ON_DATE))
    return F.when(contains_any(low, [m.lower() for m in P.MONTHS]), dated)


def auction_day(iso: str | Column) -> Column:
    """The same as a date, null for days that do not exist."""
    return F.try_to_date(col(iso), "yyyy-MM-dd")


def slug_title(slug: str | Column) -> Column:
    slug = col(slug)
    words = F.regexp_replace(strip(F.replace(slug, F.lit("-"), F.lit(" "))), r"(?U)\s+", " ")
    return F.when(truthy(slug), title_case(words)).otherwise(F.lit("Unknown"))


def strip_html(text: str | Column, collapse: bool = False) -> Column:
    c = F.regexp_replace(col(text), r"<[^>]+>", " ")
    return strip(F.regexp_replace(c, r"(?U)\s+", " ") if collapse else c)


def posted_date(lines: str | Column) -> Column:
    """Date text of the last Posted or Updated line of a card; '' when there is none."""
    dated = F.filter(col(lines), lambda x: x.contains("Posted") | x.contains("Updated"))
    last = F.try_element_at(dated, F.lit(-1))
    bare = F.replace(F.replace(last, F.lit("Posted "), F.lit("")), F.lit("Updated "), F.lit(""))
    return F.coalesce(strip(bare), F.lit(""))


def notice_class(text: str | Column) -> Column:
    """Label by the two signal lists; foreclosure words win."""
    low = F.lower(col(text))
    return (
        F.when(contains_any(low, dims.FORECLOSURE_SIGNALS), "foreclosure")
        .when(contains_any(low, dims.PROBATE_SIGNALS), "probate")
        .otherwise("other")
    )


def extract_notice_fields(df, text: str = "text", slug: str | None = None):
    """All facts of a notice as columns, in one pass over the table; its text is folded once for all of them."""
    low = F.col("_low")
    return df.withColumn("_low", folded(col(text))).withColumns(
        {
            "county": notice_county(text, slug),
            "court_case": court_case(text),
            "extracted_pin": pin(text, low),
            "extracted_deed_plat": deed_plat(text),
            "notice_address": empty_to_null(notice_address(text, low)),
            "notice_auction_date": auction_date(text, low),
            "notice_acres": acreage(text, low),
        }
    ).withColumn("deed_book", deed_only("extracted_deed_plat")).drop("_low")
