"""Links to viewers and maps, their repair, and the keys read out of links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auctionlake import dims
from auctionlake.functions import patterns as P
from auctionlake.functions.base import col, filled, found, strip, truthy


def _located(lng: Column, lat: Column) -> Column:
    return F.coalesce((lng != 0) & (lat != 0), F.lit(False))


def quote(text: Column) -> Column:
    """Percent-encoding that keeps slashes and writes blanks as %20."""
    c = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for safe, code in (("/", "%2F"), ("~", "%7E")):
        c = F.replace(c, F.lit(code), F.lit(safe))
    return F.replace(c, F.lit("*"), F.lit("%2A"))


def viewer_url(lng: str | Column, lat: str | Column, parcel: str | Column) -> Column:
    """Parcel viewer centred on the coordinates, else a map search for the parcel."""
    lng, lat, parcel = col(lng), col(lat), col(parcel)
    centred = F.concat(F.lit(P.PARCEL_VIEWER), F.format_string("&center=%.6f,%.6f&level=16", lng, lat))
    search = F.concat(F.lit(P.MAPS_SEARCH + "parcel+"), parcel, F.lit("+in+NC"))
    return F.when(_located(lng, lat), centred).when(truthy(parcel), search)


def maps_url(
    lng: str | Column, lat: str | Column, address: str | Column, city: str | Column, county: str | Column
) -> Column:
    """Pin on the coordinates, else a text search for the address."""
    lng, lat = col(lng), col(lat)
    pin = F.format_string("%.6f,%.6f", lat, lng)
    parts = [F.when(filled(col(c)), F.replace(strip(col(c)), F.lit(" "), F.lit("+"))) for c in (address, city, county)]
    query = F.concat_ws("+", *parts, F.lit("NC"))
    return F.concat(F.lit(P.MAPS_SEARCH + "?api=1&query="), F.when(_located(lng, lat), pin).otherwise(query))


def topo_url(
    lng: str | Column, lat: str | Column, address: str | Column, city: str | Column, county: str | Column
) -> Column:
    return F.concat(maps_url(lng, lat, address, city, county), F.lit("&" + P.TOPO_ARGS))


def place_search(address: str | Column, county: str | Column) -> Column:
    """Map search as the feeds themselves write it: blanks inside the address stay."""
    parts = [F.when(truthy(col(c)), col(c)) for c in (address, county)]
    return F.concat(F.lit(P.MAPS_SEARCH), F.concat_ws("+", *parts, F.lit("NC")))


def place_topo(search: str | Column) -> Column:
    return F.concat(col(search), F.lit("/@?api=1&" + P.TOPO_ARGS))


def county_viewer_url(county: str | Column, parcel: str | Column) -> Column:
    """Page of the county's own viewer, else a map search; null without county or parcel."""
    county, parcel = col(county), col(parcel)
    heads = {c: f"{base}?{param}=" for c, (base, param) in dims.COUNTY_VIEWERS.items()}
    head = dims.lookup(heads, F.lower(strip(county)))
    search = F.concat(F.lit(P.MAPS_SEARCH + "parcel+"), quote(parcel), F.lit("+in+"), quote(county), F.lit("+NC"))
    return F.when(truthy(county) & truthy(parcel), F.coalesce(F.concat(head, quote(parcel)), search))


def assessor_url(county: str | Column, state: str | Column, parcel: str | Column) -> Column:
    """Generic assessor page; '' without a parcel."""
    county, state, parcel = (strip(F.coalesce(col(c), F.lit(""))) for c in (county, state, parcel))
    host = F.concat(F.lit("https://www."), F.lower(county), F.lower(state), F.lit(".countyassessor.org/parcel/"))
    return F.when(truthy(parcel), F.concat(host, parcel)).otherwise("")


def stale_gis_url(url: str | Column) -> Column:
    """Links to dead services and to raw query output."""
    c = col(url)
    raw = c.contains("/query") & (c.contains("f=json") | c.contains("outFields"))
    return F.coalesce(c.contains("services6.arcgis.com") | raw, F.lit(False))


def stale_maps_url(url: str | Column) -> Column:
    """Anything stored as a map link that is none."""
    c = col(url)
    return F.coalesce((c != "") & ~c.contains("google.com/maps"), F.lit(False))


def session_id(url: str | Column) -> Column:
    return found(col(url), r"/\(S\((\w+)\)\)/")


def with_links(df):
    """Viewer, map and terrain links of a listing table."""
    place = ("longitude", "latitude", "address", "city", "county")
    return df.withColumns(
        {
            "gis_url": viewer_url("longitude", "latitude", "parcel_number"),
            "google_maps_url": maps_url(*place),
            "google_maps_topo_url": topo_url(*place),
        }
    )
