"""Column expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from auctionlake import dims
from auctionlake.functions import ical, keys, links, money, parcel, text
from auctionlake.plans.catalog_reports import FV, LV, NV, PV, _on
from auctionlake.plans.views import oracle, view

TV = "texts_v"
SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
TITLE = "upper(substr(county, 1, 1)) || substr(county, 2)"
PIN = (
    "case when l_linenumber % 3 = 0 then lpad(cast(l_partkey % 10000 as varchar), 4, '0') || '-' || "
    "lpad(cast(l_suppkey % 100 as varchar), 2, '0') || '-' || lpad(cast(l_orderkey % 10000 as varchar), 4, '0') || '-000' end"
)
REF = (
    "case when l_linenumber % 2 = 0 then 'Deed:Bk' || l_partkey || 'Pg' || l_suppkey "
    "else 'Plat:File' || l_partkey || 'Pg' || l_suppkey end"
)
CASE = "'26CV' || lpad(cast(l_orderkey % 1000000 as varchar), 6, '0') || '-100'"
DAY = "case when l_linenumber % 4 = 0 then '2026-03-' || lpad(cast(l_suppkey % 28 + 1 as varchar), 2, '0') end"
ADDR = "case when l_linenumber % 5 = 0 then l_suppkey || ' Oak Lane' end"


def _notice(name, expr, sql):
    return (
        _on(NV, lambda df: df.select("nid", expr().alias(name))),
        oracle(NV, f"select nid, {sql} as {name} from notices_v"),
    )


def _texts(name, expr, sql):
    return (
        _on(TV, lambda df: df.select("tid", expr().alias(name))),
        oracle(TV, f"select tid, {sql} as {name} from texts_v"),
    )


def raw_features(parcels):
    """Parcel table as nested features, four corners and the closing one as the ring."""
    x, y = F.col("x0"), F.col("y0")
    corner = lambda dx, dy: F.array(x + dx, y + dy)
    ring = F.array(corner(0.0, 0.0), corner(0.004, 0.0), corner(0.004, 0.004), corner(0.0, 0.004))
    fields = "parno altparno nparno cntyfips cntyname siteadd ownname parusecd2 parusedsc2 gisacres recareano".split()
    geometry = F.when(~F.col("no_geometry"), F.struct(F.array(ring).alias("rings")))
    return parcels.select("feature_id", F.struct(*fields).alias("attributes"), geometry.alias("geometry"))


def parcels(spark, sf):
    return parcel.normalise_parcels(raw_features(view(spark, sf, PV)))


ACRES_SQL = """case when try_cast(gisacres as double) > 0 then round(try_cast(gisacres as double), 2)
  else round(try_cast(recareano as double), 2) end"""
USE_SQL = """nullif(concat_ws(' — ', nullif(parusecd2, ''), nullif(parusedsc2, '')), '')"""
CLEAN_SQL = f"""select feature_id, parno, altparno, nparno, cntyfips, cntyname, nullif(trim(siteadd), '') as site_address,
  nullif(trim(ownname), '') as owner_name, {USE_SQL} as land_use, {ACRES_SQL} as acres,
  case when not no_geometry then round(x0 + 0.002, 6) end as longitude,
  case when not no_geometry then round(y0 + 0.002, 6) end as latitude,
  {ACRES_SQL} is not null as is_clean from parcels_v"""

SUFFIX_MAP = "case split_part(address, ' ', 4) when 'Road' then 'RD' when 'Drive' then 'DR' when 'Lane' then 'LN' when 'Street' then 'ST' else 'CT' end"
VIEWER = links.P.PARCEL_VIEWER

QUERIES = {
    "c1_dedup_hash": (
        _on(LV, lambda df: df.select("id", keys.dedup_hash().alias("dedup_hash"))),
        oracle(LV, """select id, sha256(lower(address) || '|' || lower(coalesce(city, '')) || '|' || county || '|nc|' || zip_code
            || case when latitude is not null then '|' || printf('%.6f,%.6f', latitude, longitude) else '' end) as dedup_hash
            from listings_v"""),
    ),
    "c2_acreage": _notice("acres", lambda: text.acreage("text"), "cast(cast(l_quantity as int) + 0.5 as double)"),
    "c3_pin": _notice("pin", lambda: text.pin("text"), PIN),
    "c4_normalise_pin": (
        _on(NV, lambda df: df.select("nid", text.normalise_pin(
            F.concat(F.lit(" "), F.col("l_partkey"), F.lit(" –? "), F.col("l_suppkey"), F.lit("-,"))).alias("pin"))),
        oracle(NV, "select nid, l_partkey || '-' || l_suppkey as pin from notices_v"),
    ),
    "c5_deed_plat": _notice("deed_plat", lambda: text.deed_plat("text"), REF),
    "c6_deed_only": _notice(
        "deed_book", lambda: text.deed_only(text.deed_plat("text")), f"case when l_linenumber % 2 = 0 then {REF} end"),
    "c7_court_case": _notice("court_case", lambda: text.court_case("text"), CASE),
    "c8_sp_case_nc": _texts("sp_case", lambda: text.sp_case("sp_text", "NC"), "case when tid % 3 = 0 then sp_text end"),
    "c8_sp_case_tn": _texts("sp_case", lambda: text.sp_case("sp_text", "TN"), "case when tid % 3 < 2 then sp_text end"),
    "c9_notice_county": _notice("county", lambda: text.notice_county("text", "slug"), TITLE),
    "c9_slug_county": _notice(
        "county", lambda: text.notice_county(F.lit(""), F.col("slug")), f"case when slug is not null then {TITLE} end"),
    "c10_grid_county_nc": _texts(
        "county", lambda: F.lower(text.grid_county("nc_text", "NC")), "case when tid % 3 < 2 then county end"),
    "c10_grid_county_tn": _texts(
        "county", lambda: F.lower(text.grid_county("tn_text", "TN")), "case when tid % 4 < 3 then county end"),
    "c11_office_county": _texts("county", lambda: text.office_county("office"), f"case when tid % 3 < 2 then {TITLE} end"),
    "c12_clean_parcels": (parcels, oracle(PV, CLEAN_SQL)),
    "c13_notice_address": _notice("address", lambda: text.notice_address("text"), ADDR),
    "c14_auction_date": (
        _on(NV, lambda df: df.select("nid", text.auction_date("text").alias("auction_date")).withColumn(
            "auction_day", text.auction_day("auction_date"))),
        oracle(NV, f"select nid, {DAY} as auction_date, cast({DAY} as date) as auction_day from notices_v"),
    ),
    "c15_slug_title": _notice(
        "title", lambda: text.slug_title("slug"),
        f"case when slug is null then 'Unknown' else 'Notice Of Sale ' || {TITLE} || ' County ' || l_orderkey end"),
    "c16_cents": (
        _on(FV, lambda df: df.select("rid", money.cents("openingbid").alias("cents"),
                                     money.cents("openingbid", None).alias("cents_or_null"))),
        oracle(FV, """select rid, coalesce(v, 0) as cents, v as cents_or_null from (select rid, cast(trunc(try_cast(
            regexp_replace(openingbid, '[^0-9.]', '', 'g') as double) * 100) as bigint) as v from feed_v)"""),
    ),
    "c17_dollars": (
        _on(FV, lambda df: df.select("rid", money.dollars("currentbid").alias("dollars"))),
        oracle(FV, "select rid, case when rid % 4 <> 0 then cast(rid % 5000 + 0.25 as double) end as dollars from feed_v"),
    ),
    "c18_last_bid": _texts("last_bid", lambda: money.last_bid("bid_text"), """case tid % 4
        when 1 then (o_custkey % 900 + 1) * 1000 + tid % 1000 + 0.07::double when 2 then o_custkey % 900 + 1.5::double end"""),
    "c19_city_state_zip": (
        _on(TV, lambda df: df.select("tid", money.city_state_zip("city_line").alias("p")).select("tid", "p.*")),
        oracle(TV, """select tid, case tid % 5 when 0 then 'Somewhere' when 1 then 'Old Town' else 'Town' || o_custkey % 40 end as city,
            case when tid % 5 > 0 then 'NC' end as state, case when tid % 5 = 1 then (28000 + o_custkey % 900) || '-1234'
            when tid % 5 > 1 then cast(28000 + o_custkey % 900 as varchar) end as zip from texts_v"""),
    ),
    "c20_sale_date": _texts("sale_date", lambda: money.sale_date("sale_text"), """case when tid % 3 = 1 then '2026-' ||
        lpad(cast(tid % 12 + 1 as varchar), 2, '0') || '-' || lpad(cast(o_custkey % 28 + 1 as varchar), 2, '0') end"""),
    "c21_strip_html": (
        lambda spark, sf: spark.read.parquet(f"{sf}/pages.parquet").select(
            "page_id", F.sha2(text.strip_html("html"), 256).alias("stripped")),
        f"select page_id, sha256(trim(regexp_replace(html, '<[^>]+>', ' ', 'g'), {SPACE} || chr(160))) as stripped from pages",
    ),
    "c21_strip_html_collapse": _texts("plain", lambda: text.strip_html("html", True), "'a ' || tid || ' c'"),
    "c22_ical_unescape": _texts(
        "plain", lambda: ical.ical_unescape("escaped"), "'x' || tid || ', y; z' || chr(10) || 'w' || chr(92)"),
    "c23_ical_ts": _texts("ts", lambda: ical.ical_ts("stamp"), """case when tid % 6 > 0 then '2026-' ||
        lpad(cast(tid % 12 + 1 as varchar), 2, '0') || '-' || lpad(cast(o_custkey % 28 + 1 as varchar), 2, '0') || ' ' ||
        lpad(cast(o_custkey % 24 as varchar), 2, '0') || ':' || lpad(cast(tid % 60 as varchar), 2, '0') ||
        case when tid % 6 = 1 then 'Z' else '' end end"""),
    "c25_pin_from_link": _texts(
        "pin", lambda: ical.pin_from_link("link"), "case tid % 4 when 0 then tid || '-0' when 1 then cast(tid as varchar) end"),
    "c25_uid_to_id": _texts(
        "listing_id", lambda: ical.uid_to_id("uid"), "case tid % 3 when 0 then 'trumba_' || tid when 1 then 'u' || tid end"),
    "c26_parcel_variants": (
        _on(LV, lambda df: df.select("id", F.array_join(parcel.parcel_variants("parcel_number"), "|").alias("variants"))),
        oracle(LV, """select id, case id % 4 when 1 then parcel_number || '|' || replace(parcel_number, '-', '')
            when 3 then case when parcel_number = '' then '' else parcel_number || '|' || replace(parcel_number, '-', '') end
            else parcel_number end as variants from listings_v"""),
    ),
    "c27_county_matches": (
        _on(TV, lambda df: df.select("tid", parcel.county_matches(
            text.office_county("office"), F.when(F.col("tid") % 5 > 0, F.upper("county"))).alias("same"))),
        oracle(TV, "select tid, tid % 5 = 0 or tid % 3 < 2 as same from texts_v"),
    ),
    "c28_normalise_street": (
        _on(LV, lambda df: df.select("id", parcel.normalise_street("address").alias("street"))),
        oracle(LV, f"""select id, split_part(address, ' ', 2) || ' ' || split_part(address, ' ', 3) || ' ' || {SUFFIX_MAP} as street
            from listings_v"""),
    ),
    "c29_addresses_match": (
        lambda spark, sf: _pairs(spark, sf).select("id", parcel.addresses_match("address", "siteadd").alias("same")),
        oracle((LV, PV), """select id, split_part(address, ' ', 1) = trim(split_part(siteadd, ' ', 1)) as same
            from listings_v join parcels_v on feature_id = id"""),
    ),
    "c30_links": (
        _on(LV, lambda df: links.with_links(df).select(
            "id", "gis_url", "google_maps_url", "google_maps_topo_url")),
        oracle(LV, f"""select id, case when latitude is not null then
              '{VIEWER}' || printf('&center=%.6f,%.6f&level=16', longitude, latitude)
              when parcel_number <> '' then 'https://www.google.com/maps/search/parcel+' || parcel_number || '+in+NC' end as gis_url,
            m as google_maps_url, m || '&map_action=map&base=maps.terrain' as google_maps_topo_url
            from (select *, 'https://www.google.com/maps/search/?api=1&query=' || case when latitude is not null
              then printf('%.6f,%.6f', latitude, longitude)
              else concat_ws('+', replace(address, ' ', '+'), city, county, 'NC') end as m from listings_v)"""),
    ),
    "c30_county_viewer": (
        _on(LV, lambda df: df.select("id", links.county_viewer_url("county", "parcel_number").alias("viewer"))),
        oracle(LV, f"""select id, case when parcel_number <> '' then coalesce(head || parcel_number,
            'https://www.google.com/maps/search/parcel+' || parcel_number || '+in+' || county || '+NC') end as viewer
            from listings_v left join (values {", ".join(f"('{c}', '{b}?{p}=')" for c, (b, p) in dims.COUNTY_VIEWERS.items())})
            as t(c, head) on c = county"""),
    ),
    "c30_assessor": (
        _on(LV, lambda df: df.select("id", links.assessor_url("county", "state", "parcel_number").alias("assessor"))),
        oracle(LV, """select id, case when parcel_number <> '' then 'https://www.' || county || 'nc.countyassessor.org/parcel/'
            || parcel_number else '' end as assessor from listings_v"""),
    ),
    "c31_session_id": _texts(
        "session", lambda: links.session_id("portal"), "case when tid % 2 = 0 then 'a' || tid || 'z' end"),
    "c32_posted_date": _texts("posted", lambda: text.posted_date(F.split("card", "\n")), """case tid % 3
        when 0 then 'Jan ' || (o_custkey % 28 + 1) when 1 then 'Feb ' || (o_custkey % 28 + 1) else '' end"""),
    "a15_centroid": (
        _on(PV, lambda df: raw_features(df).select("feature_id", parcel.centroid("geometry.rings").alias("c")).select(
            "feature_id", "c.lng", "c.lat")),
        oracle(PV, """select feature_id, case when not no_geometry then round(x0 + 0.002, 6) end as lng,
            case when not no_geometry then round(y0 + 0.002, 6) end as lat from parcels_v"""),
    ),
    "extract_notice_fields": (
        _on(NV, lambda df: text.extract_notice_fields(df.drop("county"), "text", "slug").select(
            "nid", "county", "court_case", "extracted_pin", "extracted_deed_plat", "deed_book", "notice_address",
            "notice_auction_date", "notice_acres")),
        oracle(NV, f"""select nid, {TITLE} as county, {CASE} as court_case, {PIN} as extracted_pin, {REF} as extracted_deed_plat,
            case when l_linenumber % 2 = 0 then {REF} end as deed_book, {ADDR} as notice_address, {DAY} as notice_auction_date,
            cast(cast(l_quantity as int) + 0.5 as double) as notice_acres from notices_v"""),
    ),
    "normalise_bids_and_dates": (
        _on(TV, lambda df: money.normalise_bids_and_dates(df, "bid_text", "sale_text", "city_line").select(
            "tid", "last_bid", "sale_date", "city", "zip_code")),
        oracle(TV, """select tid, case tid % 4 when 1 then (o_custkey % 900 + 1) * 1000 + tid % 1000 + 0.07::double
              when 2 then o_custkey % 900 + 1.5::double end as last_bid,
            case when tid % 3 = 1 then '2026-' || lpad(cast(tid % 12 + 1 as varchar), 2, '0') || '-' ||
              lpad(cast(o_custkey % 28 + 1 as varchar), 2, '0') end as sale_date,
            case tid % 5 when 0 then 'Somewhere' when 1 then 'Old Town' else 'Town' || o_custkey % 40 end as city,
            case when tid % 5 = 1 then (28000 + o_custkey % 900) || '-1234'
              when tid % 5 > 1 then cast(28000 + o_custkey % 900 as varchar) end as zip_code from texts_v"""),
    ),
}


def _pairs(spark, sf):
    a, b = view(spark, sf, LV), view(spark, sf, PV)
    return a.join(b, a["id"] == b["feature_id"]).select("id", "address", "siteadd")
