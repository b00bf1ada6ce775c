"""Which rows count."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionlake import dims
from auctionlake.functions.base import truthy


def in_counties(county: Column, variant: str) -> Column:
    """Membership in a fixed list of at most 38 names: a literal IN, which reaches the file scan's codegen."""
    key = F.lower(F.trim(county))
    if variant == "tn":
        key = F.regexp_replace(key, "[ _]", "")
    return F.coalesce(key.isin(*dims.COUNTY_VARIANTS[variant]), F.lit(False))


def qualifying(df: DataFrame, variant: str = "mountain", county: str = "county") -> DataFrame:
    return df.where(in_counties(F.col(county), variant))


def county_acre_gate(
    df: DataFrame, variant: str = "nc", min_acres: float = dims.DEFAULT_MIN_ACRES
) -> DataFrame:
    """Qualifying county and a known acreage of at least ``min_acres``; the county is put in title case."""
    kept = qualifying(df, variant).where((F.col("acres") != 0) & (F.col("acres") >= min_acres))
    return kept.withColumn("county", F.initcap(F.lower(F.trim("county"))))


def exclude_commercial(df: DataFrame, ptype: str = "property_type") -> DataFrame:
    return df.where(~F.lower(F.coalesce(F.col(ptype), F.lit(""))).contains("commercial"))


def exclude_redeemed(df: DataFrame, redeemed: str = "redeemed", event_type: str = "event_type") -> DataFrame:
    """Unknown stays; a set value must contain ``no`` and ``foreclosure`` respectively."""
    paid = truthy(F.col(redeemed)) & ~F.lower(redeemed).contains("no")
    other = truthy(F.col(event_type)) & ~F.lower(event_type).contains("foreclosure")
    return df.where(~F.coalesce(paid, F.lit(False)) & ~F.coalesce(other, F.lit(False)))


def min_acreage(df: DataFrame, n: float) -> DataFrame:
    return df.where(F.coalesce("acres", F.lit(0.0)) >= n)


def like_escape(text: str) -> str:
    """A user's words as a LIKE literal."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def search_predicate(
    q: str = "", county: str = "", min_acres: float | None = None, status: str = "active",
    fields: tuple[str, ...] = ("address", "city", "county", "description", "notes"),
) -> Column:
    """Case-insensitive search over the listing's texts; each argument narrows the result only when given."""
    keep = F.col("status") == (status or "active")
    if q.strip():
        pattern = f"%{like_escape(q.strip())}%"
        hit = F.lit(False)
        for f in fields:
            hit = hit | F.coalesce(F.col(f).ilike(pattern), F.lit(False))
        keep = keep & hit
    if county.strip():
        keep = keep & F.col("county").ilike(f"%{like_escape(county.strip())}%")
    if min_acres:
        keep = keep & (F.col("acres") >= min_acres)
    return keep


def in_need(source: str | None = None) -> Column:
    """Whether a listing lacks GIS acreage or a viewer link, or has a link from before the present formats; never null."""
    maps, gis = F.col("google_maps_url"), F.col("gis_url")
    unsized = F.col("acres").isNull() | F.col("acres_source").isNull() | (F.col("acres_source") == "placeholder")
    outdated = (
        gis.contains("services6.arcgis.com")
        | gis.rlike("(?is)/query.*f=json")
        | (maps.contains("/maps/search/") & ~maps.contains("?api=1"))
    )
    linked = truthy(F.col("parcel_number")) & (~truthy(gis) | F.coalesce(outdated, F.lit(False)))
    keep = unsized | linked
    if source:
        keep = keep & (F.col("source") == source)
    return F.coalesce(keep, F.lit(False))


def needs_enrichment(df: DataFrame, source: str | None = None, limit: int | None = None) -> DataFrame:
    """The listings that ``in_need`` names."""
    out = df.where(in_need(source))
    return out if limit is None else out.orderBy("id").limit(limit)


def needs_address_enrichment(df: DataFrame, source: str = "hutchens_law") -> DataFrame:
    return df.where((F.col("source") == source) & F.col("acres").isNull() & truthy(F.col("address")))


def recent_errors(runs: DataFrame, now: datetime, hours: int = 6, n: int | None = 5) -> DataFrame:
    """Newest failures of the last hours; all of them without ``n``."""
    since = now - timedelta(hours=hours)
    failed = runs.where((F.col("started_at") >= F.lit(since)) & F.col("status").isin("failed", "error"))
    return failed if n is None else failed.orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(n)


