"""Parcel numbers, parcel attributes and street addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auctionlake import dims
from auctionlake.functions import patterns as P
from auctionlake.functions.base import bind, blank_to_null, col, empty_to_null, strip, truthy


def parcel_variants(parcel: str | Column) -> Column:
    """Spellings to look a parcel up by: as written, without dashes, letters and digits only."""
    raw = strip(col(parcel))
    spellings = F.array(raw, F.replace(raw, F.lit("-"), F.lit("")), F.regexp_replace(raw, "[^A-Za-z0-9]", ""))
    return F.filter(F.array_distinct(spellings), truthy)


def county_matches(gis_county: str | Column, target: str | Column) -> Column:
    """Case-insensitive; an empty target matches every county."""
    gis, want = col(gis_county), col(target)
    return ~truthy(want) | F.coalesce(F.lower(gis) == F.lower(want), F.lit(False))


def normalise_street(address: str | Column) -> Column:
    """Street words to search by: no house number, upper case, short suffix, at most the last three words."""
    bare = F.upper(F.regexp_replace(strip(col(address)), r"(?U)^\s*\d+\s+", ""))
    words = F.filter(F.split(bare, r"(?U)\s+"), truthy)

    def shorten(ws: Column) -> Column:
        last = F.try_element_at(ws, F.lit(-1))
        short = F.coalesce(dims.lookup(dims.STREET_ABBREVIATIONS, last), last)
        return F.when(F.size(ws) > 0, F.concat(F.slice(ws, F.lit(1), F.size(ws) - 1), F.array(short)))

    def searched(ws: Column) -> Column:
        tail = F.array_join(F.slice(ws, F.greatest(F.size(ws) - 2, F.lit(1)), F.lit(3)), " ")
        return F.when(F.size(ws) == 2, F.concat_ws(" ", F.substring(ws[0], 1, 3), ws[1])).otherwise(tail)

    return bind(bind(words, shorten), searched)


def address_words(address: str | Column) -> Column:
    """Upper-case address without street suffix words."""
    return strip(F.regexp_replace(F.upper(strip(col(address))), P.STREET_SUFFIX_WORDS, ""))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, r"(?U)\s+"), truthy))


def number_list(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0))


def words_overlap(a: Column, b: Column) -> Column:
    """More than half of all words, and at least two, are shared. Both are sets, so words in all are their sizes less those shared."""
    common = F.size(F.array_intersect(a, b))
    return (common >= 2) & (common * 3 > F.size(a) + F.size(b))


def addresses_match(a: str | Column, b: str | Column) -> Column:
    """Same numbers in the same order (none on both sides counts), or the words overlap."""
    a, b = address_words(a), address_words(b)
    return (number_list(a) == number_list(b)) | words_overlap(word_set(a), word_set(b))


def centroid(rings: str | Column) -> Column:
    """struct(lng, lat): mean of all vertices of all rings, closing ones too; null without vertices."""
    points = F.flatten(col(rings))
    n = F.size(points)

    def mean(i: int) -> Column:
        total = F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p[i])
        return F.round(total / n, 6)

    return F.when(n > 0, F.struct(mean(0).alias("lng"), mean(1).alias("lat")))


def clean_acres(gis: str | Column, recorded: str | Column) -> Column:
    """GIS acreage if positive, else the recorded one; two decimals, null when neither is a number."""
    g = col(gis).try_cast("double")
    return F.round(F.when(g > 0, g).otherwise(col(recorded).try_cast("double")), 2)


def land_use(code: str | Column, label: str | Column) -> Column:
    return F.nullif(F.concat_ws(" — ", empty_to_null(col(code)), empty_to_null(col(label))), F.lit(""))


def normalise_parcels(features):
    """Parcel table from features ``struct(attributes, geometry)``.

    Features without a usable acreage stay, marked by ``is_clean``: a lookup that
    hits one stops there without a result. Filter on it for a table of parcels.
    """
    a = F.col("attributes")
    c = centroid(F.col("geometry.rings"))
    acres = clean_acres(a["gisacres"], a["recareano"])
    return features.select(
        "feature_id",
        a["parno"].alias("parno"),
        a["altparno"].alias("altparno"),
        a["nparno"].alias("nparno"),
        a["cntyfips"].alias("cntyfips"),
        a["cntyname"].alias("cntyname"),
        blank_to_null(a["siteadd"]).alias("site_address"),
        blank_to_null(a["ownname"]).alias("owner_name"),
        land_use(a["parusecd2"], a["parusedsc2"]).alias("land_use"),
        acres.alias("acres"),
        c["lng"].alias("longitude"),
        c["lat"].alias("latitude"),
        acres.isNotNull().alias("is_clean"),
    )
