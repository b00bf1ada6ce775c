"""Table schemas and the projection that brings any table up to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auctionlake.functions.base import truthy

_S, _D, _L, _I, _DATE = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.DateType()

TNMAP_COLUMNS = {
    "tnmap_owner": _S, "tnmap_owner2": _S, "tnmap_address": _S, "tnmap_city": _S,
    "tnmap_deeded_acres": _D, "tnmap_calculated_acres": _D, "tnmap_gislink": _S, "tnmap_cmap": _S,
    "tnmap_gp": _S, "tnmap_parcel": _S, "tnmap_subdivision": _S,
}

# What one sighting of a property carries.
SIGHTING_COLUMNS = {
    "source": _S, "source_listing_id": _S, "url": _S, "address": _S, "city": _S, "county": _S, "state": _S,
    "zip_code": _S, "latitude": _D, "longitude": _D, "price_cents": _L, "acres": _D, "description": _S,
    "property_type": _S, "listing_date": _S, "auction_date": _S, "close_date": _S, "upset_bid": _S,
    "foreclosure_key": _S, "parcel_number": _S, "deed_book": _S, "court_case": _S, "first_seen": _DATE,
    "last_seen": _DATE, "google_maps_url": _S, "google_maps_topo_url": _S, "gis_url": _S, "elevation_ft": _D,
    "parcel_screenshot": _S, "initial_auction_date": _S, "upset_bid_end": _S, "raw_source_text": _S,
    "raw_parcel_text": _S, "raw_deed_text": _S, "raw_paragraph": _S, "extracted_deed_plat": _S,
    "extracted_pin": _S, "acres_source": _S,
}

PROPERTY_COLUMNS = {
    "id": _L,
    **SIGHTING_COLUMNS,
    "last_updated": _DATE, "seen_count": _I, "dedup_hash": _S, "status": _S, "tags": _S, "notes": _S,
    "scraped_at": _S, "manual_acres_set": _S, "manual_acres_override": _D, "gis_county": _S, "owner_name": _S,
    "land_use": _S,
    **TNMAP_COLUMNS,
}

RUN_COLUMNS = {
    "id": _L, "source": _S, "started_at": T.TimestampType(), "finished_at": T.TimestampType(),
    "properties_found": _I, "properties_new": _I, "properties_duplicate": _I, "properties_updated": _I,
    "status": _S, "error_message": _S,
}


def struct(columns: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


def with_columns_of(df: DataFrame, columns: dict[str, T.DataType]) -> DataFrame:
    """Exactly the given columns, missing ones as typed nulls."""
    have = set(df.columns)
    return df.select(
        *[(F.col(n).cast(t) if n in have else F.lit(None).cast(t)).alias(n) for n, t in columns.items()]
    )


def conform(df: DataFrame, columns: dict[str, T.DataType] | None = None) -> DataFrame:
    """Bring an older property table up to the present schema.

    The two date columns are filled from their forerunners only when the table did
    not have them yet.
    """
    have = set(df.columns)
    if "initial_auction_date" not in have and "auction_date" in have:
        old = F.col("auction_date")
        known = truthy(old) & (F.lower(old) != "not yet set")
        df = df.withColumn("initial_auction_date", F.when(known, old))
    if "upset_bid_end" not in have and "close_date" in have:
        df = df.withColumn("upset_bid_end", F.when(truthy(F.col("close_date")), F.col("close_date")))
    return with_columns_of(df, columns or PROPERTY_COLUMNS)


def retype(df: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """Numbers as numbers; what is none becomes null."""
    fields = fields or {
        "acres": "double", "price_cents": "bigint", "elevation_ft": "double", "manual_acres_override": "double",
    }
    return df.withColumns({n: F.col(n).try_cast(t) for n, t in fields.items() if n in df.columns})


__all__ = [
    "PROPERTY_COLUMNS", "RUN_COLUMNS", "SIGHTING_COLUMNS", "TNMAP_COLUMNS", "conform", "retype",
    "struct", "with_columns_of",
]
