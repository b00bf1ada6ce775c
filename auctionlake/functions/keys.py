"""Identity of a listing and its place in reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auctionlake import dims
from auctionlake.functions.base import col, contains_any, strip


def dedup_hash(
    address="address", city="city", county="county", state="state", zip_code="zip_code",
    latitude="latitude", longitude="longitude",
) -> Column:
    """SHA-256 over the folded address, with six-digit coordinates when both are known."""
    parts = [F.lower(strip(F.coalesce(col(c), F.lit("")))) for c in (address, city, county, state)]
    parts.append(strip(F.coalesce(col(zip_code), F.lit(""))))
    lat, lng = col(latitude), col(longitude)
    place = F.when(lat.isNotNull() & lng.isNotNull(), F.format_string("%.6f,%.6f", lat, lng))
    return F.sha2(F.concat_ws("|", *parts, place), 256)


def property_category(source: str | Column = "source", ptype: str | Column = "property_type") -> Column:
    """``notice`` or ``listing``."""
    source = F.lower(strip(F.coalesce(col(source), F.lit(""))))
    ptype = F.lower(strip(F.coalesce(col(ptype), F.lit(""))))
    is_notice = source.isin(*dims.NOTICE_SOURCES) | contains_any(ptype, dims.NOTICE_TYPE_WORDS)
    return F.when(is_notice, "notice").otherwise("listing")


def dashboard_day() -> Column:
    """The date listings are ranked by."""
    return F.coalesce(F.col("initial_auction_date").cast("string"), F.col("last_seen").cast("string"))


def dashboard_order() -> list[Column]:
    return [
        dashboard_day().desc_nulls_last(),
        F.col("first_seen").desc_nulls_last(),
        F.col("id").desc(),
    ]
