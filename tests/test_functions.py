"""Column expressions on literal values."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from auctionlake import dims
from auctionlake.functions import ical, keys, links, money, parcel, text
from auctionlake.schema import conform, retype


def value(spark, expr, **columns):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in columns.items())
    return spark.createDataFrame([tuple(columns.values())], schema).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("t,want", [
    ("containing 12.5 acres more or less", 12.5),
    ("being approximately 1,234.5 acres", 1234.5),
    ("Tract 2 of the land, having 40 acres", None),
    ("Tract No. 2 of the land having 40 acres", 40.0),
    ("40.00 acres m.o.l.", 40.0),
    ("containing 0.05 acres; 3 acres more or less", 3.0),
    ("containing 7 acres", 7.0),
    ("no size", None),
])
def test_acreage(spark, t, want):
    assert value(spark, text.acreage("t"), t=t) == want


@pytest.mark.parametrize("t,want", [
    ("Parcel ID #9508-82-4582-000", "9508-82-4582-000"),
    ("parcel ID 7567-93-8054 in", "7567-93-8054"),
    ("parcel identification number 9775-39-2342-00000 and 9775-39-0376-00000", "9775-39-2342-00000"),
    ("tax parcel #1984-32-8523-000", "1984-32-8523-000"),
    ("PIN: 061878609600000", "061878609600000"),
    ("PIN 9775-39-2342?00000", "9775-39-2342-00000"),
    ("PIN 9775–39–2342", None),
    ("PID: 1984-42–0606-000", "1984-42-0606-000"),
    ("REID 12345", "12345"),
    ("nothing here", None),
])
def test_pin(spark, t, want):
    assert value(spark, text.pin("t"), t=t) == want


@pytest.mark.parametrize("t,want", [
    ("Deed Book 1341, Page 599", "Deed:Bk1341Pg599"),
    ("Deed Vol. 794 at Page 609", "Deed:Bk794Pg609"),
    ("Plat Book 211, Page 72", "Plat:Bk211Pg72"),
    ("Plat File 15, Page 282", "Plat:File15Pg282"),
    ("Plat Cabinet 25 at Slide 378", "Plat:Cabinet25Slide378"),
    ("recorded in Book 332 at Page 316", "Deed:Bk332Pg316"),
    ("Book : 6481 Page: 631", "Deed:Bk6481Pg631"),
    ("a book", None),
])
def test_deed_plat(spark, t, want):
    assert value(spark, text.deed_plat("t"), t=t) == want


@pytest.mark.parametrize("t,want", [
    ("file 26cv000298-870 of", "26CV000298-870"),
    ("25-CV015317-250", "25-CV015317-250"),
    ("Case No: 26M1234", "26M1234"),
    ("In the General Court of Justice, 22R003", "22R003"),
    ("none", None),
])
def test_court_case(spark, t, want):
    assert value(spark, text.court_case("t"), t=t) == want


@pytest.mark.parametrize("t,slug,want", [
    ("COUNTY OF BUNCOMBE", "", "Buncombe"),
    ("in HAYWOOD COUNTY court", "", "Haywood"),
    ("NORTH COUNTY road, late of Clay County", "", "Clay"),
    ("", "notice-in-polk-county-nc", "Polk"),
    ("x", "y", None),
])
def test_notice_county(spark, t, slug, want):
    assert value(spark, text.notice_county("t", "slug"), t=t, slug=slug) == want


@pytest.mark.parametrize("t,want", [
    ("Date of Sale: August 8, 2026", "2026-08-08"),
    ("will be sold on Sept 31 2026 at 10:00 AM", "2026-09-31"),
    ("on May 3, 2026", None),
    ("never", None),
])
def test_auction_date(spark, t, want):
    assert value(spark, text.auction_date("t"), t=t) == want
    day = value(spark, text.auction_day(text.auction_date("t")), t=t)
    assert (day is None) == (want in (None, "2026-09-31"))


def test_small_texts(spark):
    assert value(spark, text.slug_title("t"), t="notice-of-1st  sale") == "Notice Of 1St Sale"
    assert value(spark, text.slug_title("t"), t="") == "Unknown"
    assert value(spark, text.notice_address("t"), t="Address of the Property: 328 Wooten Cove Rd.,\nx") == "328 Wooten Cove Rd"
    assert value(spark, text.office_county("t"), t="HAYWOOD  County Tax Office") == "Haywood"
    assert value(spark, text.office_county("t"), t="clay tax office") == "Clay"
    assert value(spark, text.strip_html("t"), t="<p>a<br/>b</p>") == "a b"
    assert value(spark, text.sp_case("t", "NC"), t="no 26SP001-2 x") == "26SP001-2"
    assert value(spark, text.sp_case("t", "NC"), t="no 23SP001") is None
    assert value(spark, text.notice_class("t"), t="Notice to Creditors") == "probate"


@pytest.mark.parametrize("t,want", [
    ("$169,894.26", 169894.26), ("Bid not available yet", None), ("$1.00 then $127,248.07", 127248.07), ("$5", None), ("", None),
    ("$169894.26", None),
])
def test_last_bid(spark, t, want):
    assert value(spark, money.last_bid("t"), t=t) == want


def test_money(spark):
    assert value(spark, money.cents("t"), t="$1,234.50") == 123450
    assert value(spark, money.cents("t"), t="19.99") == 1998
    assert value(spark, money.cents("t"), t="abc") == 0
    assert value(spark, money.cents("t", None), t="n/a") is None
    assert value(spark, money.cents("t"), t="1.2.3") == 0
    assert value(spark, money.dollars("t"), t="13,851.33") == 13851.33
    p = value(spark, money.city_state_zip("t"), t="Clemmons, NC 27012-7296")
    assert (p["city"], p["state"], p["zip"]) == ("Clemmons", "NC", "27012-7296")
    p = value(spark, money.city_state_zip("t"), t=" Nowhere ")
    assert (p["city"], p["state"], p["zip"]) == ("Nowhere", None, None)
    assert value(spark, money.sale_date("t"), t="8/1/2026 10 AM") == "2026-08-01"
    assert value(spark, money.sale_date("t"), t="not 8/1/2026") is None


BLOCK = (
    'SUMMARY;LANGUAGE=en:A\\, B\r\nDTSTART;TZID=America/New_York:20260807T120000\r\nDTEND:20260817T170000Z\r\nEMPTY:\r\n'
    'X-TRUMBA-CUSTOMFIELD;NAME="Bid";ID=7;TYPE=Currency:n/a\r\nX-TRUMBA-CUSTOMFIELD;FIELDVALUE;ID=8 -> no\r\n'
    'X-TRUMBA-CUSTOMFIELD;FIELDVALUE;ID=7 -> 13\\,851.33\r\nX-TRUMBA-CUSTOMFIELD;NAME="Red";ID=9;TYPE=x:No\r\n'
)


def test_ical(spark):
    f = lambda e: value(spark, e, b=BLOCK)
    assert f(ical.ical_unescape(ical.ical_field("b", "SUMMARY"))) == "A, B"
    assert f(ical.ical_field("b", "EMPTY")) == ""
    assert f(ical.ical_field("b", "LOCATION")) is None
    assert f(ical.ical_ts(ical.ical_field("b", "DTSTART"))) == "2026-08-07 12:00"
    assert f(ical.ical_ts(ical.ical_field("b", "DTEND"))) == "2026-08-17 17:00Z"
    assert f(ical.ical_custom("b", "Bid")) == "13,851.33"
    assert f(ical.ical_custom("b", "Red")) == "No"
    assert f(ical.ical_custom("b", "Other")) is None
    assert value(spark, ical.pin_from_link("t"), t="x?pid=12-3&PINN=9") == "9"
    assert value(spark, ical.uid_to_id("t"), t="http://x/event/12") == "trumba_12"


@pytest.mark.parametrize("t,want", [
    ("16 Overlook Drive", "OVE DR"), ("202 Mountain View Street", "MOUNTAIN VIEW ST"),
    ("155 Old County Home Road", "COUNTY HOME RD"), ("12 Main", "MAIN"), ("  ", None), ("12", "12"),
])
def test_normalise_street(spark, t, want):
    assert value(spark, parcel.normalise_street("t"), t=t) == want


@pytest.mark.parametrize("a,b,want", [
    ("12 Oak St", "12 Elm Rd", True), ("Oak St", "Elm Rd", True), ("12 Oak Hill Farm", "13 Oak Hill Farm", True),
    ("12 Oak Hill", "13 Oak Hill", False), ("12 Oak", "14 Pine", False),
])
def test_addresses_match(spark, a, b, want):
    assert value(spark, parcel.addresses_match("a", "b"), a=a, b=b) is want


def test_parcel_bits(spark):
    assert value(spark, parcel.parcel_variants("t"), t=" 97-7.5 ") == ["97-7.5", "977.5", "9775"]
    assert value(spark, parcel.clean_acres("a", "b"), a="0.0", b="3.456") == 3.46
    assert value(spark, parcel.clean_acres("a", "b"), a="x", b="") is None
    assert value(spark, parcel.land_use("a", "b"), a="R1", b="Home") == "R1 — Home"
    assert value(spark, parcel.land_use("a", "b"), a="", b=None) is None
    assert value(spark, parcel.county_matches("a", "b"), a="CLAY", b="clay") is True
    assert value(spark, parcel.county_matches("a", "b"), a=None, b="clay") is False
    assert value(spark, parcel.county_matches("a", "b"), a=None, b="") is True
    ring = "array(array(array(0D, 0D), array(2D, 0D), array(2D, 4D)), array(array(0D, 4D)))"
    assert tuple(value(spark, parcel.centroid(F.expr(ring)), t="")) == (1.0, 2.0)
    assert value(spark, parcel.centroid(F.expr("cast(null as array<array<array<double>>>)")), t="") is None


def test_links(spark):
    assert value(spark, links.viewer_url("x", "y", "p"), x=-82.5, y=35.25, p="1").endswith("&center=-82.500000,35.250000&level=16")
    assert value(spark, links.viewer_url("x", "y", "p"), x=0.0, y=35.25, p="1") == "https://www.google.com/maps/search/parcel+1+in+NC"
    assert value(spark, links.viewer_url("x", "y", "p"), x=0.0, y=0.0, p="") is None
    maps = links.maps_url("x", "y", "a", "c", "k")
    assert value(spark, maps, x=-82.5, y=35.25, a="", c="", k="").endswith("query=35.250000,-82.500000")
    assert value(spark, maps, x=0.0, y=0.0, a="1 Oak St", c=" ", k="Clay").endswith("query=1+Oak+St+Clay+NC")
    assert value(spark, links.county_viewer_url("k", "p"), k=" Clay", p="1 a/b") == "https://claycounty-portal.com/property-search/?ParcelID=1%20a/b"
    assert "parcel+9+in+Wake+NC" in value(spark, links.county_viewer_url("k", "p"), k="Wake", p="9")
    assert value(spark, links.stale_gis_url("u"), u="https://h/query?where=1&f=json") is True
    assert value(spark, links.stale_gis_url("u"), u=None) is False
    assert value(spark, links.stale_maps_url("u"), u="https://maps.example") is True
    assert value(spark, links.session_id("u"), u="https://h/(S(ab1))/x") == "ab1"


def test_keys(spark):
    h = keys.dedup_hash("a", "b", "c", "d", "e", "x", "y")
    import hashlib

    want = hashlib.sha256("1 oak|b|c|nc|28|35.250000,-82.500000".encode()).hexdigest()
    assert value(spark, h, a=" 1 OAK ", b="B", c="c", d="NC", e=" 28 ", x=35.25, y=-82.5) == want
    assert value(spark, keys.property_category("s", "t"), s=None, t="Estate sale") == "notice"
    assert value(spark, keys.property_category("s", "t"), s="kania_law", t="land") == "listing"
    assert value(spark, dims.nc_fips(F.col("c")), c=" Clay ") == "043"
    assert value(spark, dims.address_fips(F.col("c")), c="columbus") is None
    assert value(spark, dims.tn_county_id(F.col("c")), c="Van Buren") == 88


def test_schema(spark):
    old = spark.createDataFrame([Row(id=1, auction_date="2026-01-01", close_date=""), Row(id=2, auction_date="Not yet set", close_date="x")])
    rows = {r["id"]: r for r in conform(old).collect()}
    assert rows[1]["initial_auction_date"] == "2026-01-01" and rows[2]["initial_auction_date"] is None
    assert rows[1]["upset_bid_end"] is None and rows[2]["upset_bid_end"] == "x"
    assert rows[1]["tnmap_owner"] is None
    bad = spark.createDataFrame([("x", "12")], "acres string, price_cents string")
    assert tuple(retype(bad).first()) == (None, 12)
