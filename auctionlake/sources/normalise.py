"""Source records to the common sighting columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionlake import dims
from auctionlake.functions import patterns as P
from auctionlake.functions.base import empty_to_null, filled, strip, truthy
from auctionlake.functions.ical import entry_custom, entry_field, ical_entries, ical_ts, ical_unescape, pin_from_link, uid_to_id
from auctionlake.functions.links import county_viewer_url, place_search, place_topo
from auctionlake.functions.money import cents, city_state_zip, describe, dollars, last_bid, money_text, sale_date
from auctionlake.functions.text import (
    acreage, auction_date, court_case, deed_only, deed_plat, notice_address, notice_county, office_county, pin,
    slug_title, strip_html,
)
from auctionlake.operators.filters import exclude_commercial, exclude_redeemed
from auctionlake.schema import SIGHTING_COLUMNS, with_columns_of

KANIA_URL = "https://kanialawfirm.com/tax-foreclosures/foreclosure-listings/"
HUTCHENS_URL = "https://sales.hutchenslawfirm.com/NCfcSalesList.aspx"
ZLS_URL = "https://zls-nc.com/listings"
BUNCOMBE_URL = "https://taxforeclosures.buncombenc.gov/"
CITIZEN_TIMES_URL = "https://www.citizen-times.com/public-notices/"


def sighting(df: DataFrame, columns: dict[str, Column], keep: tuple[str, ...] = ()) -> DataFrame:
    """Project to the sighting columns; ``keep`` names further columns to carry along."""
    made = df.select(*keep, *[c.alias(n) for n, c in columns.items()])
    missing = [F.lit(None).cast(t).alias(n) for n, t in SIGHTING_COLUMNS.items() if n not in columns]
    order = [*keep, *SIGHTING_COLUMNS]
    return made.select("*", *missing).select(*order)


def _text(name: str) -> Column:
    return strip(F.coalesce(F.col(name), F.lit("")))


def _key(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])


def normalise_listing_json(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Listing-API rows. The part after the last comma of the address is the city."""
    df = exclude_commercial(df.where(filled(F.col("county"))), "propertytype")
    df = df.withColumns(
        {
            "_address": strip_html("address"), "_sale": strip_html(_text("saledatetime")),
            "_closes": strip_html(_text("closedate")), "_parcel": strip_html(_text("parcel")), "_bid": _text("currentbid"),
        }
    ).withColumn("_parts", F.filter(F.transform(F.split("_address", r",\s*"), strip), truthy))
    parts, whole = F.col("_parts"), empty_to_null(F.col("_address"))
    split = F.size(parts) >= 2
    sale, closes, bid, parcel = (F.col(c) for c in ("_sale", "_closes", "_bid", "_parcel"))
    case = _text("courtfile")
    opening = F.coalesce(F.col("openingbid"), F.lit(""))
    price = cents(F.coalesce(empty_to_null(F.col("openingbid")), empty_to_null(F.col("currentbid"))))
    columns = {
        "source": F.lit("kania_law"),
        "source_listing_id": F.coalesce(empty_to_null(F.col("courtfile")), F.col("___id___"), F.lit("")),
        "court_case": empty_to_null(F.col("courtfile")),
        "url": F.lit(KANIA_URL),
        "address": F.when(split, F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), ", "))
        .otherwise(whole),
        "city": F.when(split, F.try_element_at(parts, F.lit(-1))),
        "county": _text("county"),
        "state": F.lit("NC"),
        "price_cents": F.nullif(price, F.lit(0).cast("long")),
        "acres_source": F.lit("placeholder"),
        "description": describe(
            ("Sale", F.when(~F.lower(sale).contains("not yet set"), sale)),
            ("Upset bid", bid),
            ("Close date", closes),
            ("Parcel", parcel),
            ("Court file", case),
            ("Type", F.when(filled(F.col("propertytype")), F.col("propertytype"))),
        ),
        "property_type": empty_to_null(F.lower(_text("propertytype"))),
        "parcel_number": empty_to_null(parcel),
        "auction_date": empty_to_null(_text("saledatetime")),
        "close_date": empty_to_null(_text("closedate")),
        "upset_bid": empty_to_null(bid),
        "foreclosure_key": _key(_text("saledatetime"), _text("closedate"), bid, opening),
    }
    return sighting(df, columns, keep)


def _unavailable(c: Column) -> Column:
    return F.lower(c).rlike("not|unavailable")


def normalise_sales_grid(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Sales-grid rows whose county cell reads ``X, NC``."""

    raw = ("case_no", "sp_no", "county_raw", "sale_date_raw", "address_raw", "csz_raw", "deed_raw", "bid_raw")
    df = df.withColumns({f"_{c}": strip_html(c, collapse=True) for c in raw})
    df = df.withColumns({"_place": city_state_zip("_csz_raw"), "_bid": last_bid("_bid_raw")})

    def clean(name: str) -> Column:
        return F.col(f"_{name}")

    case, sp, deed, sale = clean("case_no"), clean("sp_no"), clean("deed_raw"), clean("sale_date_raw")
    county = F.lower(strip(F.regexp_extract(clean("county_raw"), r"^(.+?),\s*NC$", 1)))
    place, bid = F.col("_place"), F.col("_bid")
    deed_known = F.when(truthy(deed) & ~_unavailable(deed), deed)
    columns = {
        "source": F.lit("hutchens_law"),
        "source_listing_id": F.coalesce(empty_to_null(case), empty_to_null(sp)),
        "court_case": empty_to_null(sp),
        "url": F.lit(HUTCHENS_URL),
        "address": empty_to_null(clean("address_raw")),
        "city": empty_to_null(place["city"]),
        "county": county,
        "state": F.coalesce(place["state"], F.lit("NC")),
        "zip_code": place["zip"],
        "price_cents": (bid * 100).cast("long"),
        "acres_source": F.lit("placeholder"),
        "description": describe(
            ("Sale", sale),
            ("Bid", money_text(bid)),
            ("SP#", F.when(~_unavailable(sp), sp)),
            ("Case", case),
            ("Deed", deed_known),
        ),
        "property_type": F.lit("Foreclosure Sale"),
        "deed_book": deed_known,
        "auction_date": sale_date(sale),
        "foreclosure_key": _key(case, sale, F.col("bid_raw"), deed),
    }
    return sighting(df, columns, keep).where(truthy(F.col("county")))


def normalise_tax_grid(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Tax-office rows. ``upset_bid`` holds the deadline, as this source shows no upset amount.

    Rows without a parcel get no listing id, so they are told apart by address.
    """
    df = df.withColumn("_county", office_county("tax_office"))
    county = F.col("_county")
    parcel, status, opening = F.col("parcel"), F.col("status"), F.col("opening_bid")
    address = empty_to_null(F.col("address_raw"))
    has_parcel = truthy(parcel)
    search = F.when(address.isNotNull() | (has_parcel & county.isNotNull()), place_search(address, county))

    def amount(label: str, c: Column) -> tuple[str, Column]:
        return label, F.when(F.lower(c) != "n/a", c)

    columns = {
        "source": F.lit("zls_nc"),
        "source_listing_id": F.when(has_parcel, F.concat(F.lit("zls_nc_"), parcel)),
        "url": F.lit(ZLS_URL),
        "address": address,
        "county": county,
        "state": F.lit("NC"),
        "price_cents": F.nullif(cents(opening, on_fail=None), F.lit(0).cast("long")),
        "description": describe(
            ("Status", F.when(~status.contains("Not yet") & ~status.contains("Pending"), status)),
            amount("Opening", opening),
            amount("Current", F.col("current_bid")),
            ("Upset", F.when(F.col("upset_deadline") != "n/a", F.col("upset_deadline"))),
            ("Parcel", parcel),
        ),
        "property_type": F.lit("tax_foreclosure"),
        "parcel_number": empty_to_null(parcel),
        "gis_url": county_viewer_url(county, parcel),
        "auction_date": F.when(
            truthy(F.col("sale_date_raw")) & ~F.lower("sale_date_raw").contains("not yet"), F.col("sale_date_raw")
        ),
        "upset_bid": empty_to_null(F.col("upset_deadline")),
        "foreclosure_key": _key(parcel, status, opening),
        "google_maps_url": search,
        "google_maps_topo_url": place_topo(search),
    }
    return sighting(df, columns, keep)


def normalise_ical(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Calendar events. Events without summary, location or description are dropped."""
    plain = {"summary": "SUMMARY", "location": "LOCATION", "body": "DESCRIPTION", "begins": "DTSTART", "ends": "DTEND", "uid": "UID", "link": "X-TRUMBA-LINK"}
    custom = {
        "event_type": "Event Type", "redeemed": "Redeemed", "case_number": "Case Number", "pin": "PIN lookup", "kind": "Property Type",
        "fire_district": "Fire District", "bid_text": "Opening/Current Bid",
    }
    shaped = {"summary": ical_unescape, "location": ical_unescape, "body": ical_unescape, "begins": ical_ts, "ends": ical_ts, "pin": pin_from_link}

    def fields(entries):
        raw = {k: entry_field(entries, v) for k, v in plain.items()} | {k: entry_custom(entries, v) for k, v in custom.items()}
        return F.struct(*[shaped.get(k, lambda x: x)(v).alias(k) for k, v in raw.items()])

    # A generator: filters on the fields stay above it, so that no block is parsed once per condition.
    parsed = F.inline(F.transform(F.array(ical_entries("block", tuple(plain.values()))), fields))
    others = [c for c in df.columns if c not in (*plain, *custom)]
    staged = exclude_redeemed(df.select(*others, parsed).where("summary is not null and location is not null and body is not null"))
    c = {n: F.col(n) for n in staged.columns}
    address = empty_to_null(c["location"])
    search = place_search(address, F.lit("Buncombe"))
    columns = {
        "source": F.lit("buncombe_tax"),
        "source_listing_id": uid_to_id(c["uid"]),
        "url": F.coalesce(empty_to_null(c["link"]), F.lit(BUNCOMBE_URL)),
        "address": address,
        "county": F.lit("Buncombe"),
        "state": F.lit("NC"),
        "price_cents": (dollars(c["bid_text"]) * 100).cast("long"),
        "acres_source": F.lit("placeholder"),
        "description": F.coalesce(
            empty_to_null(c["body"]),
            describe(
                ("Opening/Current Bid", c["bid_text"]),
                ("Redeemed", c["redeemed"]),
                ("Case Number", c["case_number"]),
                ("PIN", c["pin"]),
                ("Property Type", c["kind"]),
                ("Fire District", c["fire_district"]),
                ("Bidding Begins", c["begins"]),
                ("Bidding Ends", c["ends"]),
            ),
        ),
        "property_type": F.lit("tax_foreclosure"),
        "parcel_number": c["pin"],
        "gis_url": F.concat(F.lit(P.BUNCOMBE_VIEWER), c["pin"]),
        "auction_date": c["begins"],
        "upset_bid": empty_to_null(c["bid_text"]),
        "foreclosure_key": _key(c["case_number"], c["pin"], c["bid_text"]),
        "court_case": empty_to_null(c["case_number"]),
        "initial_auction_date": c["begins"],
        "upset_bid_end": c["ends"],
        "google_maps_url": search,
        "google_maps_topo_url": place_topo(search),
        "raw_source_text": empty_to_null(c["body"]),
    }
    return sighting(staged, columns, keep)


def normalise_hits(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Notice-search hits; the county is not filtered here, see ``filters.qualifying``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    staged = df.withColumns(
        {
            "county_found": notice_county(text, F.coalesce("slug", F.lit(""))),
            "case": court_case(text),
            "pin_found": pin(text),
            "ref": deed_plat(text),
            "auction": F.coalesce(auction_date(text), F.col("date_start")),
        }
    )

    def labelled(label: str, c: str) -> Column:
        return F.when(truthy(F.col(c)), F.concat(F.lit(f"{label}: "), F.col(c)))

    summary = F.concat_ws(
        " -- ", slug_title("slug"), labelled("Case", "case"), labelled("Auction", "auction"),
        labelled("PIN", "pin_found"), labelled("Deed/Plat", "ref"),
    )
    columns = {
        "source": F.lit("newspaper_notices"),
        "source_listing_id": F.col("id"),
        "court_case": F.col("case"),
        "extracted_deed_plat": F.col("ref"),
        "extracted_pin": F.col("pin_found"),
        "deed_book": deed_only("ref"),
        "raw_source_text": text,
        "raw_paragraph": text,
        "url": F.lit(CITIZEN_TIMES_URL),
        "address": notice_address(text),
        "county": F.col("county_found"),
        "state": F.lit("NC"),
        "description": F.concat(F.lit("[Citizen Times] "), summary),
        "property_type": F.lit("public_notice"),
        "parcel_number": F.col("pin_found"),
        "auction_date": F.col("auction"),
    }
    return sighting(staged, columns, keep).where(truthy(F.col("county")))


def normalise_newspaper(details: DataFrame, publication: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Candidates joined with their detail pages: slug, uid, date, pin, deed_plat, court_case, title, raw_text.

    Detail pages with neither parcel nor title failed to load and are dropped, but for
    the one newspaper that has no detail pages at all.
    """
    pub = dims.PUBLICATIONS[publication]
    title = F.col("title")
    if publication == "mitchell":
        heading, url, df = F.lit("Legal Notice"), F.lit(pub["base"]), details
    else:
        df = details.where(F.col("pin").isNotNull() | truthy(title))
        if publication == "sylva":
            heading = F.when(F.length(title) >= 4, title).otherwise("Legal Notice")
            url = F.concat(F.lit(pub["base"]), F.col("uid"))
        elif publication == "watauga":
            heading = F.when(F.length(title) > 5, title).otherwise(slug_title("slug"))
            url = F.concat(F.lit(pub["base"]), F.col("slug"), F.lit("/ad_"), F.col("uid"), F.lit(".html"))
        else:
            heading = F.when(F.length(title) > 5, title).otherwise(F.col("card_title"))
            url = F.col("url")
    dated = F.concat(F.lit(" -- "), empty_to_null(F.col("date")))
    columns = {
        "source": F.lit("newspaper_notices"),
        "court_case": F.col("court_case"),
        "extracted_deed_plat": F.col("deed_plat"),
        "extracted_pin": F.col("pin"),
        "deed_book": deed_only("deed_plat"),
        "raw_source_text": F.col("raw_text"),
        "raw_paragraph": F.col("raw_text"),
        "source_listing_id": F.concat(F.lit(pub["prefix"]), F.col("uid")),
        "url": url,
        "city": F.lit(pub["city"]),
        "county": F.lit(pub["county"]),
        "state": F.lit("NC"),
        "description": F.concat(F.lit(f"[{pub['label']}] "), heading, F.coalesce(dated, F.lit(""))),
        "property_type": F.lit("public_notice"),
        "parcel_number": F.col("pin"),
        "auction_date": empty_to_null(F.col("date")),
    }
    return sighting(df, columns, keep)


def normalise_court_notices(
    df: DataFrame, state: str, min_acres: float = dims.DEFAULT_MIN_ACRES, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Notices of the two state grids. A notice without a known acreage stays; a known small one goes."""
    acres = acreage("text")
    columns = {
        "source": F.lit({"NC": "ncforeclosures", "TN": "tnforeclosures"}[state]),
        "source_listing_id": F.coalesce(empty_to_null(F.col("sp_case")), F.col("pk_id")),
        "url": F.col("detail_url"),
        "county": F.lower(_text("county")),
        "state": F.lit(state),
        "price_cents": F.lit(100).cast("long"),
        "acres": acres,
        "description": F.col("text"),
        "raw_source_text": F.col("text"),
        "property_type": F.lit("foreclosure"),
    }
    return sighting(df, columns, keep).where(F.col("acres").isNull() | (F.col("acres") >= min_acres))


def union_sources(*feeds: DataFrame) -> DataFrame:
    """Bag union by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


def unify(*feeds: DataFrame, source: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One batch from any feeds: known columns only, price never null, all rows under the run's source name."""
    df = union_sources(*feeds)
    if source is not None:
        df = df.withColumn("source", F.lit(source))
    if "price" in df.columns and "price_cents" not in df.columns:
        df = df.withColumn("price_cents", (F.col("price").cast("double") * 100).cast("long"))
    batch = with_columns_of(df, {**{k: df.schema[k].dataType for k in keep}, **SIGHTING_COLUMNS})
    return batch.withColumn("price_cents", F.coalesce("price_cents", F.lit(0).cast("long")))


