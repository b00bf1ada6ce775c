"""Parcel matching against trying every pair on small random tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from auctionlake import dims
from auctionlake.operators import enrich as en

COUNTIES = ["clay", "polk", "macon"]
STREETS = ["OLD MILL RD", "MILL RD", "NEW OLD MILL RD", "A ST", "OAK HILL FARM LN", "OVERLOOK DR", "OVE DR", "B", "MAIN ST UNIT 2"]
PARCEL = ("feature_id long, parno string, altparno string, nparno string, cntyfips string, cntyname string, site_address string, "
          "owner_name string, land_use string, acres double, longitude double, latitude double, is_clean boolean")


def make_parcels(rng, n):
    rows = []
    for i in range(n):
        county = rng.choice(COUNTIES)
        fips = dims.NC_FIPS[county]
        no = rng.choice([f"{rng.randrange(12)}", f"1-{rng.randrange(6)}", None])
        acres = rng.choice([None, 0.0, 2.5, 4.0])
        rows.append((i, no, rng.choice([None, f"A{rng.randrange(8)}"]), f"37{fips}_{rng.randrange(12)}", fips,
                     rng.choice([county, county.upper(), "other"]), f"{rng.randrange(5)} {rng.choice(STREETS)}", "o", None, acres,
                     rng.choice([None, -82.5]), rng.choice([None, 35.25]), acres is not None))
    return rows


NAMES = [c.split()[0] for c in PARCEL.split(", ")]


def lookup(parcel, county, parcels, strict=False):
    p = (parcel or "").strip()
    if not p:
        return None
    fips = dims.NC_FIPS.get((county or "").lower().strip())
    spellings = [p] if strict else [p, p.replace("-", ""), re.sub("[^A-Za-z0-9]", "", p)]
    same = lambda r: not county or (r["cntyname"] or "").lower() == county.lower()
    for v in spellings:
        if not v:
            continue
        steps = [
            fips and (lambda r: r["cntyfips"] == fips and r["nparno"] == f"37{fips}_{v}"),
            fips and (lambda r: r["cntyfips"] == fips and r["altparno"] == v),
            fips and (lambda r: r["cntyfips"] == fips and r["parno"] == v),
            lambda r: r["parno"] == v, lambda r: r["altparno"] == v,
        ]
        for i, test in enumerate(steps):
            hit = next((r for r in parcels if test and test(r)), None)
            if hit is None:
                continue
            if strict and i >= 2:
                return hit if hit["is_clean"] and same(hit) else None
            if i < 2 and not (hit["is_clean"] and same(hit)):
                continue
            if i == 2 and not hit["is_clean"]:
                continue
            return hit if hit["is_clean"] else None
    return None


def listing_frame(spark, rng, n):
    numbers = [None, "", " ", "3", "1-2", " 1-3", "A4", "zz", "A-5", "3 1-2", "zz A3", "1 - 2"]
    rows = [(i, rng.choice([*COUNTIES, "Clay", "nowhere", None, ""]), rng.choice(numbers),
             f"{rng.randrange(9)} {rng.choice(['Old Mill Road', 'Mill Rd', 'Overlook Drive', 'A Street', 'B', 'Hill Farm Lane', 'Main St'])}")
            for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, county string, parcel_number string, address string")


def test_parcel_lookup(spark):
    for seed in range(2):
        rng = random.Random(seed)
        raw = make_parcels(rng, 60)
        parcels = [dict(zip(NAMES, r)) for r in raw]
        rows, df = listing_frame(spark, rng, 150)
        pdf = spark.createDataFrame(raw, PARCEL)
        for policy in ("default", "strict"):
            got = {r["id"]: r["match"] for r in en.match_parcels(df, pdf, policy).select("id", "match").collect()}
            for i, county, number, _ in rows:
                want = lookup(number, county, parcels, policy == "strict")
                assert (got[i] and got[i]["feature_id"]) == (want and want["feature_id"]), (policy, county, number)
        got = {r["id"]: r["match"] for r in en.match_parcels(df, pdf, split_candidates=True).select("id", "match").collect()}
        for i, county, number, _ in rows:
            want = None
            for word in (number or "").split():
                tries = [word] + ([re.sub(r"[-\s]", "", word)] if re.sub(r"[-\s]", "", word) not in (word, "") else [])
                for t in tries:
                    want = lookup(t, county, parcels)
                    if want and want["acres"] > 0:
                        break
                if want and want["acres"] > 0:
                    break
            assert (got[i] and got[i]["feature_id"]) == (want and want["feature_id"]), (county, number)


def test_blank_parcel_numbers_do_not_gather(spark):
    """Nine listings in ten have none: each comes through once."""
    rows = [(i, "clay", "3" if i % 10 == 0 else ["", " ", None][i % 3]) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, county string, parcel_number string")
    fips = dims.NC_FIPS["clay"]
    pdf = spark.createDataFrame([(1, "3", None, None, fips, "clay", "1 A ST", "o", None, 2.0, None, None, True)], PARCEL)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = en.match_parcels(df, pdf)
        got = joined.select("id", "match.feature_id").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(r["id"] for r in got) == list(range(2000)) and all((r["feature_id"] == 1) == (r["id"] % 10 == 0) for r in got)
    assert joined.columns == [*df.columns, "match"]


def test_enrichment_in_place_is_enrichment_of_those_in_need(spark):
    rng = random.Random(2)
    _, df = listing_frame(spark, rng, 200)
    links = {"source": "s", "city": "c", "gis_url": None, "google_maps_url": None, "google_maps_topo_url": None}
    df = df.withColumns({k: F.lit(v).cast("string") for k, v in links.items()} | {"latitude": F.lit(None).cast("double"), "longitude": F.lit(None).cast("double")})
    df = df.withColumns({"acres": F.when(F.col("id") % 3 == 0, 7.5), "acres_source": F.when(F.col("id") % 3 == 0, "gis"), "gis_url": F.when(F.col("id") % 6 == 0, "x")})
    pdf = spark.createDataFrame(make_parcels(rng, 60), PARCEL)
    got = en.enrich_in_place(df, pdf)
    done = en.enrich(df, pdf).drop("outcome")
    want = df.join(done.select("id"), "id", "left_anti").unionByName(done, allowMissingColumns=True)
    rows = lambda d: sorted(map(repr, d.select(sorted(got.columns)).collect()))
    assert rows(got) == rows(want) and got.where("owner_name is not null").count() > 20
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "Union" not in plan.split("Join LeftOuter")[0]


def normalised(address):
    words = re.sub(r"^\s*\d+\s+", "", address.strip()).upper().split()
    if words:
        words[-1] = dims.STREET_ABBREVIATIONS.get(words[-1], words[-1])
    return " ".join(words[-3:]) if len(words) >= 3 else f"{words[0][:3]} {words[1]}" if len(words) == 2 else " ".join(words)


@pytest.mark.parametrize("block", [50_000, 2])
def test_address_search(spark, block):
    """The same whether frequent grams are split or not."""
    rng = random.Random(5)
    raw = make_parcels(rng, 80)
    parcels = [dict(zip(NAMES, r)) for r in raw]
    rows, df = listing_frame(spark, rng, 120)
    got = {r["id"]: r["match"] for r in en.match_addresses(df, spark.createDataFrame(raw, PARCEL), block).select("id", "match").collect()}
    hits = 0
    for i, county, _, address in rows:
        want = None
        fips = dims.NC_FIPS.get((county or "").lower().strip())
        street = normalised(address)
        for like in (re.escape(street), ".*".join(re.escape(w) for w in street.split()[:2])):
            hit = next((p for p in parcels if fips and p["cntyfips"] == fips and re.search(like, p["site_address"])), None)
            if hit and hit["is_clean"] and hit["acres"] > 0:
                want = hit
                break
        hits += want is not None
        assert (got[i] and got[i]["feature_id"]) == (want and want["feature_id"]), (county, address)
    assert hits > 10


SUFFIX = re.compile(r"\b(ST|STREET|AVE|AVENUE|BLVD|BOULEVARD|DR|DRIVE|ROAD|RD|LANE|LN|CIR|CIRCLE|WAY|COURT|CT)\b\.?", re.I)


def alike(a, b):
    a, b = (SUFFIX.sub("", x.strip().upper()).strip() for x in (a, b))
    if re.findall(r"\d+", a) == re.findall(r"\d+", b):
        return True
    x, y = set(a.split()), set(b.split())
    return len(x & y) >= 2 and len(x & y) > len(x | y) / 2


@pytest.mark.parametrize("block", [50_000, 2])
def test_fuzzy(spark, block):
    rng = random.Random(9)
    words = ["OAK", "HILL", "FARM", "MILL", "OLD", "BEND"]
    address = lambda: " ".join([str(rng.randrange(30)), *rng.sample(words, rng.randrange(1, 5)), rng.choice(["ST", "Rd", ""])])
    sites = [(i, rng.choice([1, 2, 4]), rng.choice([address(), None, " "]), f"own{i}") for i in range(60)]
    rest = "OWNER2 string, CITY string, DEEDAC double, CALCAC double, GISLINK string, CMAP string, GP string, PARCEL string, SUBDIV string"
    pdf = spark.createDataFrame([(*s, *[None] * 9) for s in sites], f"ord long, COUNTY_ID int, ADDRESS string, OWNER string, {rest}")
    rows = [(i, rng.choice(["Anderson", "bedford", "bledsoe", "nowhere"]), rng.choice([address(), address(), "", None])) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, county string, address string")
    ids = {"anderson": 1, "bedford": 2, "bledsoe": 4}
    for score in (15, 5):
        got = {r["id"]: r["tnmap_owner"] for r in en.match_fuzzy(df, pdf, score, block).select("id", "tnmap_owner").collect()}
        for i, county, addr in rows:
            inside = [s for s in sites if s[1] == ids.get(county.lower()) and (s[2] or "").strip()]
            want = next((s[3] for s in inside if (addr or "").strip() and alike(addr, s[2])), None)
            if want is None and score <= 5 and inside:
                want = inside[0][3]
            assert got[i] == want, (county, addr)
