"""Reports over listings, feeds and runs: scans, filters, joins, aggregations, windows, order, sets."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from auctionlake import dims
from auctionlake.functions.links import stale_gis_url, stale_maps_url
from auctionlake.functions.text import notice_class
from auctionlake.operators import filters as fl
from auctionlake.operators import report as rp
from auctionlake.operators.sequence import change_events, keep_first
from auctionlake.plans.views import oracle, view
from auctionlake.sources.notices import min_length, relevant_notices
from auctionlake.sources.normalise import union_sources
from auctionlake.sources.sinks import export_rows

NOW = datetime(1998, 1, 30, 18, 0, 0)
TODAY = date(1998, 1, 1)
LV, PV, FV, RV, SV, NV = "listings_v", "parcels_v", "feed_v", "runs_v", "sightings_v", "notices_v"
DASH = "coalesce(initial_auction_date, last_seen) desc, first_seen desc, id desc"

#: What sightings are one property's: the listing, or the address of those without one.
ENTITY = "case when source_listing_id is null then address else concat(source, '|', source_listing_id) end"


def _in(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


MOUNTAIN = _in(dims.MOUNTAIN_COUNTIES)
NC = _in(dims.STATE_COUNTIES["NC"])


def _on(name, fn):
    return lambda spark, sf: fn(view(spark, sf, name))


def _listings(fn):
    return _on(LV, fn)


def _runs(fn):
    return _on(RV, fn)


CATEGORY = (
    "case when lower(trim(source)) = 'newspaper_notices' or lower(property_type) like '%notice%' or "
    "lower(property_type) like '%estate%' or lower(property_type) like '%proceeding%' then 'notice' else 'listing' end"
)

CENTS = (
    "coalesce(cast(trunc(try_cast(regexp_replace(openingbid, '[^0-9.]', '', 'g') as double) * 100) as bigint), 0)"
)


def _stem_sql(text: str, words) -> str:
    return "(" + " or ".join(f"contains({text}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


QUERIES = {
    # -- filters
    "f1_qualifying_mountain": (
        _listings(lambda df: fl.qualifying(df, "mountain").select("id", "county")),
        oracle(LV, f"select id, county from listings_v where county in ({MOUNTAIN})"),
    ),
    "f1_qualifying_nc": (
        _listings(lambda df: fl.qualifying(df, "nc").select("id", "county")),
        oracle(LV, f"select id, county from listings_v where county in ({NC})"),
    ),
    "f1_qualifying_tn": (
        _listings(lambda df: fl.qualifying(df, "tn").select("id", "county")),
        oracle(LV, f"select id, county from listings_v where county in ({_in(dims.STATE_COUNTIES['TN'])})"),
    ),
    "f2_county_acre_gate": (
        _listings(lambda df: fl.county_acre_gate(df, "nc", 10.0).select("id", "county", "acres")),
        oracle(LV, f"""select id, upper(substr(county, 1, 1)) || substr(county, 2) as county, acres from listings_v
            where county in ({NC}) and acres >= 10"""),
    ),
    "f3_exclude_commercial": (
        _listings(lambda df: fl.exclude_commercial(df).select("id", "property_type")),
        oracle(LV, "select id, property_type from listings_v where property_type not like '%commercial%'"),
    ),
    "f4_exclude_redeemed": (
        _on(FV, lambda df: fl.exclude_redeemed(
            df, redeemed="courtfile", event_type="propertytype").select("rid", "courtfile", "propertytype")),
        oracle(FV, """select rid, courtfile, propertytype from feed_v
            where (coalesce(courtfile, '') = '' or lower(courtfile) like '%no%')
              and (coalesce(propertytype, '') = '' or lower(propertytype) like '%foreclosure%')"""),
    ),
    "f5_relevant_notices": (
        _on(NV, lambda df: relevant_notices(df, "slug", "text").select("nid", "slug")),
        oracle(NV, f"""select nid, slug from notices_v
            where {_stem_sql("upper(slug)", dims.TITLE_WORDS)}
              and {_stem_sql("lower(concat_ws(' ', slug, text))", dims.RELEVANT_STEMS)}"""),
    ),
    "f6_min_length": (
        lambda spark, sf: min_length(spark.read.parquet(f"{sf}/documents.parquet"), 500).select("doc_id", "n_chars"),
        "select doc_id, n_chars from documents where length(text) >= 500",
    ),
    "f7_search": (
        _listings(lambda df: df.where(fl.search_predicate("mill", "an", 5.0)).select("id", "address", "county", "acres")),
        oracle(LV, """select id, address, county, acres from listings_v where status = 'active' and acres >= 5
            and county ilike '%an%' and (address ilike '%mill%' or coalesce(city, '') ilike '%mill%'
              or county ilike '%mill%' or description ilike '%mill%' or coalesce(notes, '') ilike '%mill%')"""),
    ),
    "f7_search_api": (
        _listings(lambda df: df.where(
            fl.search_predicate("furniture", fields=("address", "city", "county", "description"))
        ).select("id", "description")),
        oracle(LV, """select id, description from listings_v where status = 'active'
            and (address ilike '%furniture%' or coalesce(city, '') ilike '%furniture%' or county ilike '%furniture%'
              or description ilike '%furniture%')"""),
    ),
    "f8_needs_enrichment": (
        _listings(lambda df: fl.needs_enrichment(df).select("id", "acres", "gis_url")),
        oracle(LV, """select id, acres, gis_url from listings_v where acres is null or acres_source is null
            or acres_source = 'placeholder'
            or (coalesce(parcel_number, '') <> '' and coalesce(gis_url, '') = '')
            or (coalesce(parcel_number, '') <> '' and (gis_url ilike '%services6.arcgis.com%'
                or gis_url ilike '%/query%f=json%'
                or (google_maps_url ilike '%/maps/search/%' and google_maps_url not ilike '%?api=1%')))"""),
    ),
    "f9_address_candidates": (
        _listings(lambda df: fl.needs_address_enrichment(df, "src_3").select("id", "address")),
        oracle(LV, """select id, address from listings_v where source = 'src_3' and acres is null and address <> ''"""),
    ),
    "f10_stale_links": (
        _listings(lambda df: df.select(
            "id", stale_gis_url("gis_url").alias("stale_gis"), stale_maps_url("google_maps_url").alias("stale_maps"),
            stale_maps_url("url").alias("stale_page"))),
        oracle(LV, """select id, coalesce(contains(gis_url, 'services6.arcgis.com') or (contains(gis_url, '/query')
              and (contains(gis_url, 'f=json') or contains(gis_url, 'outFields'))), false) as stale_gis,
            coalesce(not contains(google_maps_url, 'google.com/maps'), false) as stale_maps, true as stale_page
            from listings_v"""),
    ),
    "f11_min_acreage": (
        _listings(lambda df: fl.min_acreage(df, 5.0).select("id", "acres")),
        oracle(LV, "select id, acres from listings_v where coalesce(acres, 0) >= 5"),
    ),
    "f12_notice_class": (
        _on(NV, lambda df: df.groupBy(notice_class("text").alias("label")).agg(F.count(F.lit(1)).alias("notices"))),
        oracle(NV, f"""select case when {_stem_sql('lower(text)', dims.FORECLOSURE_SIGNALS)} then 'foreclosure'
            when {_stem_sql('lower(text)', dims.PROBATE_SIGNALS)} then 'probate' else 'other' end as label,
            count(*) as notices from notices_v group by 1"""),
    ),
    "f13_recent_errors": (
        _runs(lambda df: fl.recent_errors(df, NOW).select("id", "source", "started_at", "error_message")),
        oracle(RV, """select id, source, started_at, error_message from runs_v
            where started_at >= timestamp '1998-01-30 12:00:00' and status in ('failed', 'error')
            order by started_at desc, id desc limit 5"""),
    ),
    # -- joins over listings and runs
    "j7_case_peers": (
        _listings(rp.case_peers),
        oracle(LV, """select a.court_case, a.id, n - 1 as peers from listings_v a join
            (select court_case, count(*) as n from listings_v where status = 'active' group by 1) b
            on a.court_case = b.court_case where status = 'active' and n > 1"""),
    ),
    "j7_same_case_of_listing": (
        _listings(lambda df: rp.same_case(df, 100).select("id", "court_case", "address")),
        oracle(LV, """select b.id, b.court_case, b.address from listings_v a join listings_v b
            on a.court_case = b.court_case and a.id <> b.id where a.id = 100 and b.status = 'active'"""),
    ),
    "j8_county_codes": (
        _listings(lambda df: df.select(
            "id", dims.nc_fips(F.col("county")).alias("fips"), dims.tn_county_id(F.col("county")).alias("tn_id"))),
        oracle(LV, f"""select id, fips, t.tn_id from listings_v l join dim_county_v d on d.county = l.county
            left join (values {", ".join(f"('{c}', {i})" for i, c in enumerate(dims.TN_COUNTIES, 1))}) as t(c, tn_id)
            on t.c = l.county"""),
    ),
    "j9_new_since_last_run": (
        lambda spark, sf: rp.new_since_last_run(view(spark, sf, LV), view(spark, sf, RV)).select(
            "id", "source", "first_seen", "last_run"),
        oracle((LV, RV), """select id, l.source, first_seen, last_run from listings_v l join
            (select source, cast(max(finished_at) as date) as last_run from runs_v where status = 'completed' group by 1) r
            on l.source = r.source and first_seen >= last_run where status = 'active'"""),
    ),
    "j10_latest_runs": (
        _runs(rp.latest_runs),
        oracle(RV, """select source, started_at, status, properties_found from runs_v
            where (source, started_at) in (select (source, max(started_at)) from runs_v group by source)"""),
    ),
    "j11_absent_counties": (
        _on(FV, rp.absent_counties),
        oracle(FV, f"""select county from (values {", ".join(f"('{c}')" for c in dims.MOUNTAIN_COUNTIES)}) as q(county)
            where not exists (select 1 from feed_v f where lower(trim(f.county)) = q.county)"""),
    ),
    # -- aggregations
    "a1_stats": (
        lambda spark, sf: rp.stats(view(spark, sf, LV), view(spark, sf, RV), TODAY),
        oracle((LV, RV), """select count(*) filter (status = 'active') as total_active, count(*) as total_seen,
            count(*) filter (first_seen = date '1998-01-01') as today_new,
            cast(coalesce(sum(seen_count - 1), 0) as bigint) as total_duplicates_seen,
            count(*) filter (status = 'archived') as total_archived,
            (select count(*) from runs_v) as scrape_runs from listings_v"""),
    ),
    "a2_run_count": (_runs(rp.run_count), oracle(RV, "select count(*) as runs from runs_v")),
    "a3_by_source": (
        _listings(rp.by_source),
        oracle(LV, "select source, count(*) as cnt from listings_v where status = 'active' group by 1"),
    ),
    "a4_top_counties": (
        _listings(rp.top_counties),
        oracle(LV, """select upper(substr(county, 1, 1)) || substr(county, 2) || ', ' || state as label, count(*) as cnt
            from listings_v where status = 'active' group by county, state order by cnt desc, county, state limit 10"""),
    ),
    "a5_county_frequency": (
        _on(FV, rp.county_frequency),
        oracle(FV, f"""select lower(trim(county)) as county, count(*) as records,
            count(*) filter (lower(trim(county)) in ({MOUNTAIN})) as qualifying
            from feed_v where trim(county) <> '' group by 1"""),
    ),
    "a6_filter_funnel": (
        _on(FV, rp.filter_funnel),
        oracle(FV, f"""select case when lower(coalesce(propertytype, '')) like '%commercial%' then 'commercial'
            when {CENTS} = 0 then 'zero_price' when openingbid <> '' and trim(openingbid) = '' then 'no_bid'
            else 'pass' end as reason, count(*) as records from feed_v
            where lower(trim(county)) in ({MOUNTAIN}) group by 1"""),
    ),
    "a7_bids_by_county": (
        _on(FV, rp.bids_by_county),
        oracle(FV, f"""select lower(trim(county)) as county, openingbid, {CENTS} as cents, count(*) as records
            from feed_v where lower(trim(county)) in ({MOUNTAIN}) group by 1, 2, 3"""),
    ),
    "a8_coverage": (
        _on(FV, rp.coverage),
        oracle(FV, f"""select count(distinct lower(trim(county))) as covered, cast(21 as bigint) as qualifying,
            round(count(distinct lower(trim(county))) / 21.0, 4) as ratio from feed_v
            where lower(trim(county)) in ({MOUNTAIN})"""),
    ),
    "a9_enrichment_rate": (
        _listings(rp.enrichment_rate),
        oracle(LV, """select source, count(*) as listings, count(*) filter (acres_source = 'gis') as enriched,
            round(count(*) filter (acres_source = 'gis') * 100.0 / count(*), 1) as rate_pct
            from listings_v group by rollup (source)"""),
    ),
    "a12_search_total": (
        _listings(lambda df: rp.search_total(df, "creek", "", 2.0, "archived")),
        oracle(LV, """select count(*) as total from listings_v where status = 'archived' and acres >= 2
            and (address ilike '%creek%' or coalesce(city, '') ilike '%creek%' or county ilike '%creek%'
              or description ilike '%creek%' or coalesce(notes, '') ilike '%creek%')"""),
    ),
    "a13_run_totals": (
        _runs(rp.run_totals),
        oracle(RV, "select cast(sum(properties_found) as bigint) as found, cast(sum(properties_new) as bigint) as new from runs_v"),
    ),
    "a16_health": (
        _runs(lambda df: rp.health(df, NOW)),
        oracle(RV, """with latest as (select source, status from runs_v
              where (source, started_at) in (select (source, max(started_at)) from runs_v group by source)),
            errors as (select count(*) as n from runs_v
              where started_at >= timestamp '1998-01-30 12:00:00' and status in ('failed', 'error')),
            ok as (select count(*) filter (status = 'completed') as healthy_sources from latest)
            select healthy_sources, n as recent_errors, case when n > 0 then 'unhealthy'
              when healthy_sources > 0 then 'healthy' else 'degraded' end as verdict from ok, errors"""),
    ),
    # -- windows
    "w1_last_completed": (
        _runs(rp.last_completed),
        oracle(RV, """select source, finished_at, id from runs_v where status = 'completed'
            qualify row_number() over (partition by source order by finished_at desc, id desc) = 1"""),
    ),
    "w2_keep_first": (
        _on(SV, lambda df: keep_first(df.where("source_listing_id is not null"), ["source", "source_listing_id"], ["ord"])
            .select("source", "source_listing_id", "ord", "price_cents")),
        oracle(SV, """select source, source_listing_id, ord, price_cents from sightings_v where source_listing_id is not null
            qualify row_number() over (partition by source, source_listing_id order by ord) = 1"""),
    ),
    "w4_failure_breaker": (
        _runs(rp.failure_counts),
        oracle(RV, """with seq as (select source, status, sum(case when status = 'completed' then 1 else 0 end)
              over (partition by source order by started_at, id) as grp from runs_v where status <> 'running')
            select source, count(*) filter (status = 'failed' and grp = top) as failures
            from (select *, max(grp) over (partition by source) as top from seq) group by source"""),
    ),
    "w4_failing_sources": (
        _runs(lambda df: rp.failing_sources(df, 1)),
        oracle(RV, """with seq as (select source, status, sum(case when status = 'completed' then 1 else 0 end)
              over (partition by source order by started_at, id) as grp from runs_v where status <> 'running'),
            f as (select source, count(*) filter (status = 'failed' and grp = top) as failures
              from (select *, max(grp) over (partition by source) as top from seq) group by source)
            select * from f where failures >= 1"""),
    ),
    "w5_navigation": (
        _listings(rp.navigation),
        oracle(LV, f"""select id, lag(id) over w as previous_id, lag(address) over w as previous_address,
            lead(id) over w as next_id, lead(address) over w as next_address
            from listings_v where status = 'active' window w as (order by {DASH})"""),
    ),
    "w5_navigation_notices": (
        _listings(lambda df: rp.navigation(df, "notice")),
        oracle(LV, f"""select id, lag(id) over w as previous_id, lag(address) over w as previous_address,
            lead(id) over w as next_id, lead(address) over w as next_address
            from listings_v where status = 'active' and {CATEGORY} = 'notice' window w as (order by {DASH})"""),
    ),
    "w5_neighbours_of_listing": (
        _listings(lambda df: rp.neighbours_of(df, 100).select(
            F.col("previous.id").alias("previous_id"), F.col("next.id").alias("next_id"))),
        oracle(LV, f"""with nav as (select id, lag(id) over w as previous_id, lead(id) over w as next_id
            from listings_v where status = 'active' window w as (order by {DASH}))
            select max(previous_id) filter (id = 100) as previous_id, max(next_id) filter (id = 100) as next_id from nav"""),
    ),
    "w6_change_events": (
        _on(SV, lambda df: change_events(df.withColumn("entity", F.expr(ENTITY)), ["entity"])
            .select("entity", "ord", "price_cents", F.col("before.price_cents").alias("old_cents"))),
        oracle(SV, """select entity, ord, price_cents, old_cents from (
              select *, lag(price_cents) over w as old_cents, lag(auction_date) over w as old_date,
                lag(upset_bid) over w as old_upset, row_number() over w as rn
              from (select *, case when source_listing_id is null then address else source || '|' || source_listing_id end as entity from sightings_v)
              window w as (partition by entity order by ord))
            where rn > 1 and (price_cents <> old_cents or auction_date <> old_date or upset_bid <> old_upset)"""),
    ),
    # -- order and limits
    "o1_dashboard": (
        _listings(lambda df: rp.active(df, 100).select("id", "initial_auction_date", "last_seen", "first_seen")),
        oracle(LV, f"""select id, initial_auction_date, last_seen, first_seen from listings_v where status = 'active'
            order by {DASH} limit 100"""),
    ),
    "o1_landing": (
        _listings(lambda df: rp.with_category(rp.active(df, 1000)).select("id", "category")),
        oracle(LV, f"select id, {CATEGORY} as category from listings_v where status = 'active' order by {DASH} limit 1000"),
    ),
    "o2_new_since": (
        _listings(lambda df: rp.new_since(df, TODAY, "src_2").select("id", "first_seen")),
        oracle(LV, f"""select id, first_seen from listings_v where status = 'active' and source = 'src_2'
            and first_seen >= date '1998-01-01' order by {DASH} limit 100"""),
    ),
    "o2_new_in_days": (
        _listings(lambda df: rp.new_in_days(df, date(2001, 7, 20)).select("id", "first_seen")),
        oracle(LV, f"""select id, first_seen from listings_v where status = 'active'
            and first_seen >= date '2001-07-13'"""),
    ),
    "o3_search_page": (
        _listings(lambda df: rp.search(df, "river", page=3, per_page=20).select("id", "address")),
        oracle(LV, f"""select id, address from listings_v where status = 'active' and (address ilike '%river%'
            or coalesce(city, '') ilike '%river%' or county ilike '%river%' or description ilike '%river%'
            or coalesce(notes, '') ilike '%river%') order by {DASH} limit 20 offset 40"""),
    ),
    "o4_processing_order": (
        _listings(lambda df: rp.processing_order(df).select("id", "status")),
        oracle(LV, "select id, status from listings_v order by case when status = 'active' then 0 else 1 end, id"),
    ),
    "o5_recent_runs": (
        _runs(lambda df: rp.recent_runs(df).select("id", "source", "started_at", "status")),
        oracle(RV, "select id, source, started_at, status from runs_v order by started_at desc, id desc limit 50"),
    ),
    "o6_enrichment_cap": (
        _listings(lambda df: fl.needs_enrichment(df, "src_1").select("id")),
        oracle(LV, """select id from listings_v where source = 'src_1' and (acres is null or acres_source is null
            or acres_source = 'placeholder' or (coalesce(parcel_number, '') <> '' and coalesce(gis_url, '') = '')
            or (coalesce(parcel_number, '') <> '' and (gis_url ilike '%services6.arcgis.com%'
                or (google_maps_url ilike '%/maps/search/%' and google_maps_url not ilike '%?api=1%'))))"""),
    ),
    "o7_by_id": (
        _listings(lambda df: rp.by_id(df, 100).select("id", "address", "price_cents")),
        oracle(LV, "select id, address, price_cents from listings_v where id = 100"),
    ),
    # -- sets
    "u1_union_sources": (
        lambda spark, sf: union_sources(
            view(spark, sf, LV).select("source", "address", "acres"), view(spark, sf, SV).select("source", "address", "upset_bid")
        ).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("acres").alias("sized"), F.count("upset_bid").alias("bids")),
        oracle((LV, SV), """select source, count(*) as n, count(acres) as sized, count(upset_bid) as bids from (
            select source, address, acres, null as upset_bid from listings_v union all
            select source, address, null, upset_bid from sightings_v) group by 1"""),
    ),
    "u2_covered": (
        _on(FV, rp.covered),
        oracle(FV, f"select distinct lower(trim(county)) as county from feed_v where lower(trim(county)) in ({MOUNTAIN})"),
    ),
    "u3_county_options": (
        _listings(rp.county_options),
        oracle(LV, "select distinct county from listings_v where status = 'active' and county is not null"),
    ),
    "u4_missed": (
        _on(FV, rp.missed),
        oracle(FV, f"""select county from (values {", ".join(f"('{c}')" for c in dims.MOUNTAIN_COUNTIES)}) as q(county)
            except select lower(trim(county)) from feed_v"""),
    ),
    "u5_target_county_listings": (
        _listings(lambda df: rp.target_counties(df.sparkSession).join(
            df.groupBy("county").agg(F.count(F.lit(1)).alias("listings")), "county", "left")),
        oracle(LV, f"""select county, n as listings from (values {", ".join(
            f"('{c}')" for cs in dims.STATE_COUNTIES.values() for c in cs)}) as q(county)
            left join (select county as c, count(*) as n from listings_v group by 1) on c = county"""),
    ),
    # -- projections over listings, export
    "p10_category": (
        _listings(lambda df: rp.with_category(df).groupBy("category").agg(F.count(F.lit(1)).alias("n"))),
        oracle(LV, f"select {CATEGORY} as category, count(*) as n from listings_v group by 1"),
    ),
    "p11_tile_flags": (
        _listings(lambda df: rp.tile_flags(df).select("id", "is_new", "is_enriched", "display_date")),
        oracle(LV, """select id, seen_count <= 3 as is_new,
            coalesce(owner_name, '') <> '' or coalesce(gis_url, '') <> '' as is_enriched,
            coalesce(last_updated, first_seen) as display_date from listings_v"""),
    ),
    "k1_export": (
        _listings(lambda df: export_rows(df).select("id", "price_cents", "price")),
        oracle(LV, f"""select id, price_cents, round(price_cents / 100.0, 2) as price from listings_v
            where status = 'active'"""),
    ),
}
