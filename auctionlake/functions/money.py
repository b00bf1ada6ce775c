"""Money, sale dates and the city line of a listing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auctionlake.functions import patterns as P
from auctionlake.functions.base import col, strip, truthy


def dollars(text: str | Column) -> Column:
    """Every character but digits and points is dropped; what is no number then gives null."""
    return F.regexp_replace(col(text), r"[^\d.]", "").try_cast("double")


def cents(text: str | Column, on_fail: int | None = 0) -> Column:
    """Truncated to whole cents, as a long. With ``on_fail=None`` the words n/a and not yet set are null too."""
    value = (dollars(text) * 100).try_cast("long")
    if on_fail is None:
        unset = F.lower(strip(col(text))).isin("n/a", "not yet set")
        return F.when(~unset, value)
    return F.coalesce(value, F.lit(on_fail).cast("long"))


def last_bid(text: str | Column) -> Column:
    """The last amount with cents named in a bid text, in dollars."""
    text = strip(col(text))
    low = F.lower(text)
    amounts = F.regexp_extract_all(text, F.lit(P.DOLLARS_WITH_CENTS), F.lit(1))
    amount = F.replace(F.try_element_at(amounts, F.lit(-1)), F.lit(","), F.lit("")).try_cast("double")
    return F.when(~(low.contains("bid") & low.contains("not available")), amount)


def city_state_zip(text: str | Column) -> Column:
    """struct(city, state, zip); text of another shape is all city."""
    text = strip(col(text))
    shaped = text.rlike(P.CITY_STATE_ZIP)
    return F.struct(
        F.when(shaped, strip(F.regexp_extract(text, P.CITY_STATE_ZIP, 1))).otherwise(text).alias("city"),
        F.when(shaped, F.regexp_extract(text, P.CITY_STATE_ZIP, 2)).alias("state"),
        F.when(shaped, F.regexp_extract(text, P.CITY_STATE_ZIP, 3)).alias("zip"),
    )


def sale_date(text: str | Column) -> Column:
    """M/D/YYYY as ISO text; text with the word not has no date."""
    text = strip(col(text))
    iso = F.concat_ws(
        "-",
        F.regexp_extract(text, P.SLASH_DATE, 3),
        F.lpad(F.regexp_extract(text, P.SLASH_DATE, 1), 2, "0"),
        F.lpad(F.regexp_extract(text, P.SLASH_DATE, 2), 2, "0"),
    )
    return F.when(text.rlike(P.SLASH_DATE) & ~F.lower(text).contains("not"), iso)


def describe(*labelled: tuple[str, Column]) -> Column:
    """``Label: value`` parts joined by `` | ``; empty and null values are left out, null when none is left."""
    parts = [F.when(truthy(v), F.concat(F.lit(f"{label}: "), v)) for label, v in labelled]
    return F.nullif(F.concat_ws(" | ", *parts), F.lit(""))


def money_text(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount, 2))


def normalise_bids_and_dates(df, bid: str, sale: str, city_line: str):
    """Bid, sale date and city line of a listing table as typed columns, in one pass."""
    place = city_state_zip(city_line)
    return df.withColumns(
        {
            "bid_cents": cents(bid),
            "bid_dollars": dollars(bid),
            "last_bid": last_bid(bid),
            "sale_date": sale_date(sale),
            "city": place["city"],
            "state": place["state"],
            "zip_code": place["zip"],
        }
    )


