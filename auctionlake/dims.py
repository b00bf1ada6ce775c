"""Reference dimensions. Everything here is small and of fixed size, so it may be inlined or broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# County lists, codes, viewers, word lists. They must equal the
# published lists for results to agree, so they are stated as they are.
# ---------------------------------------------------------------------------

MOUNTAIN_COUNTIES = (
    "alleghany ashe avery buncombe burke caldwell cherokee clay graham haywood henderson jackson "
    "macon madison mcdowell mitchell polk swain transylvania watauga yancey"
).split()

STATE_COUNTIES = {
    "GA": "dawson fannin gilmer habersham lumpkin murray pickens rabun towns union white".split(),
    "AL": "blount cherokee cleburne dekalb talladega".split(),
    "KY": "bell harlan knox perry whitley".split(),
    "NC": (
        "alleghany ashe avery buncombe burke caldwell catawba cherokee clay cleveland franklin graham "
        "haywood henderson jackson macon madison mcdowell mitchell polk rutherford swain transylvania "
        "watauga wilkes yancey"
    ).split(),
    "SC": "anderson greenville oconee pickens".split(),
    "TN": (
        "anderson bledsoe blount campbell carter claiborne cocke coffee cumberland fentress grainger "
        "greene grundy hamblen hamilton hancock hawkins jefferson johnson knox marion mcminn monroe "
        "morgan overton pickett polk roane scott sequatchie sevier sullivan unicoi union vanburen warren "
        "washington white"
    ).split(),
}

NC_FIPS = {
    "alleghany": "005", "ashe": "009", "avery": "011", "buncombe": "021", "burke": "023",
    "caldwell": "027", "catawba": "035", "cherokee": "039", "clay": "043", "cleveland": "045",
    "columbus": "047", "cumberland": "049", "franklin": "069", "graham": "075", "haywood": "087",
    "henderson": "089", "jackson": "099", "macon": "113", "madison": "115", "mcdowell": "111",
    "mitchell": "121", "montgomery": "123", "polk": "149", "rutherford": "161", "swain": "173",
    "transylvania": "175", "watauga": "189", "wilkes": "193", "yancey": "199",
}

# Address search knows three counties fewer than parcel search.
ADDRESS_SEARCH_UNKNOWN = ("columbus", "cumberland", "montgomery")

# Tennessee counties in alphabetical order; the county id is the 1-based position.
TN_COUNTIES = (
    "anderson bedford benton bledsoe blount bradley campbell cannon carroll carter cheatham chester "
    "claiborne clay cocke coffee crockett cumberland davidson decatur dekalb dickson dyer fayette "
    "fentress franklin gibson giles grainger greene grundy hamblen hamilton hancock hardeman hardin "
    "hawkins haywood henderson henry hickman houston humphreys jackson jefferson johnson knox lake "
    "lauderdale lawrence lewis lincoln loudon macon madison marion marshall maury mcminn mcnairy meigs "
    "monroe montgomery moore morgan obion overton perry pickett polk putnam rhea roane robertson "
    "rutherford scott sequatchie sevier shelby smith stewart sullivan sumner tipton trousdale unicoi "
    "union vanburen warren washington wayne weakley white williamson wilson"
).split()

STREET_ABBREVIATIONS = {
    "DRIVE": "DR", "ROAD": "RD", "STREET": "ST", "BLVD": "BLVD", "AVENUE": "AVE", "LANE": "LN",
    "CIRCLE": "CIR", "COURT": "CT", "PLACE": "PL", "WAY": "WAY", "DR": "DR", "RD": "RD", "ST": "ST",
    "AVE": "AVE", "LN": "LN", "CIR": "CIR", "CT": "CT", "PL": "PL", "BOULEVARD": "BLVD",
}

COUNTY_VIEWERS = {
    "alleghany": ("https://www.alleghanycountync.org/property-search", "ParcelID"),
    "ashe": ("https://gov.ashecountync.gov/departments/gis/", "ParcelNumber"),
    "avery": ("https://averycountync.gov/property-records/", "ParcelID"),
    "buncombe": ("https://buncompecounty.org/property-search/", "ParcellID"),
    "burke": ("https://gov.burkecountync.gov/pages/propertysearch", "ParcelID"),
    "caldwell": ("https://caldwellcitizentimes.com/county/propertysearch.aspx", "ParcelID"),
    "catawba": ("https://www.catawbacountync.org/property-search/", "ParcelID"),
    "cherokee": ("https://www.cherokeecounty-nc.gov:8080/TaxNet/BasicSearch.aspx", "Parcel"),
    "clay": ("https://claycounty-portal.com/property-search/", "ParcelID"),
    "graham": ("https://grahamcountync.org/property-records", "ParcelID"),
    "haywood": ("https://www.haywoodcountync.gov/property-search/", "ParcelID"),
    "henderson": ("https://gov.hendersoncountync.gov/property-search", "ParcelID"),
    "jackson": ("https://jacksoncountync.org/property-search/", "ParcelID"),
    "madison": ("https://madisoncountync.org/property-search/", "ParcelID"),
    "mcdowell": ("https://mcdowellcountync.gov/property-records", "ParcelID"),
    "mitchell": ("https://mitchellcounty-portal.com/property-search", "ParcelID"),
    "swain": ("https://swaincountync.gov/property-records/", "ParcelID"),
    "transylvania": ("https://transylvaniacountync.gov/property-search", "ParcelID"),
    "watauga": ("https://gov.wataugacounty.org/property-search", "ParcelID"),
    "wilkes": ("https://wilkescountync.org/property-search", "ParcelID"),
    "yancey": ("https://yanceycountync.org/property-search", "ParcelID"),
}

# Newspapers: id prefix, label, city, county, page address, link pattern and shortest page accepted.
PUBLICATIONS = {
    "watauga": dict(
        prefix="wd_", label="Watauga Democrat", city="Boone", county="Watauga",
        base="https://www.wataugademocrat.com/classifieds/community/public_notices/",
        link=r"/classifieds/community/public_notices/([^\"'<>]+)/ad_([0-9a-f-]+)\.html",
        min_chars=0,
    ),
    "sylva": dict(
        prefix="sh_", label="Sylva Herald", city="Sylva", county="Jackson",
        base="https://www.thesylvaherald.com/classifieds/community/announcements/legal/",
        link=r"/classifieds/community/announcements/legal/()((?:ad_)?[0-9a-f-]+\.html)",
        min_chars=0,
    ),
    "mitchell": dict(
        prefix="mn_", label="Mitchell News", city="Spruce Pine", county="Mitchell",
        base="https://www.mitchellnews.com/classified/legals",
        link=r"/classified/legals/()(?:ad_)?([0-9a-f-]+)",
        min_chars=1500,
    ),
    "transylvania": dict(
        prefix="tt_", label="Transylvania Times", city="Brevard", county="Transylvania",
        base="https://marketplace.transylvaniatimes.com/brevard-nc/public-notices/search",
        link=None, min_chars=0,
    ),
}

NOTICE_SOURCES = ("newspaper_notices",)
NOTICE_TYPE_WORDS = ("notice", "estate", "proceeding")
TITLE_WORDS = ("NOTICE", "FORECLOS", "SALE", "CREDITOR", "BIDDER")
RELEVANT_STEMS = (
    "foreclosure", "sale", "exchange", "trust", "lien", "mortgage", "distress", "sheriff",
    "execution", "attachment", "judicial", "creditor", "filing", "publication", "bidding",
)
FORECLOSURE_SIGNALS = (
    "foreclos", "tax sale", "tax lien", "substitute trustee", "trustee's sale", "sheriff",
    "sale of real", "deed of trust",
)
PROBATE_SIGNALS = (
    "notice to creditors", "probate", "having qualified as", "estate file", "executor of the estate",
)
BACKFILL_DAYS = 180
OVERLAP_DAYS = 7
DEFAULT_MIN_ACRES = 10.0
RUN_ALL_MIN_ACRES = 2.0

# The county sets the feeds are filtered by.
COUNTY_VARIANTS = {
    "mountain": MOUNTAIN_COUNTIES,
    "nc": STATE_COUNTIES["NC"],
    "tn": STATE_COUNTIES["TN"],
}


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Constant map lookup as an expression: no join, no shuffle, null when absent."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def county_key(county: Column) -> Column:
    return F.lower(F.trim(county))


def nc_fips(county: Column) -> Column:
    return lookup(NC_FIPS, county_key(county))


def address_fips(county: Column) -> Column:
    known = {c: f for c, f in NC_FIPS.items() if c not in ADDRESS_SEARCH_UNKNOWN}
    return lookup(known, county_key(county))


def tn_county_id(county: Column) -> Column:
    """1-based alphabetical position; spaces and underscores in the name do not matter."""
    ids = {c: str(i) for i, c in enumerate(TN_COUNTIES, 1)}
    return lookup(ids, F.regexp_replace(county_key(county), "[ _]", "")).cast("int")


def dim_county(spark: SparkSession) -> DataFrame:
    """(state, county) of every qualifying county list, 88 rows; names repeat across states."""
    rows = [(s, c) for s, cs in STATE_COUNTIES.items() for c in cs]
    return spark.createDataFrame(rows, "state string, county string")


def dim_mountain(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in MOUNTAIN_COUNTIES], "county string")
