"""Upsert, parcel matching, table changes, sinks and streams."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from auctionlake import dims
from auctionlake.functions.keys import dedup_hash
from auctionlake.operators import enrich as en
from auctionlake.operators import mutate
from auctionlake.operators import upsert as up
from auctionlake.plans import jobs
from auctionlake.plans.catalog_reports import LV, PV, RV, SV, _on
from auctionlake.plans.catalog_text import CLEAN_SQL, VIEWER, parcels
from auctionlake.plans.views import oracle, table, view, with_views
from auctionlake.schema import PROPERTY_COLUMNS, conform, struct, with_columns_of
from auctionlake.shared import new_folder, stage
from auctionlake.sources.sinks import append_runs, read_runs, read_snapshot, write_snapshot
from auctionlake.streaming import pull, stream
from auctionlake.streaming.store import read_table, write_table

CV = "current_v"
TODAY = date(1998, 2, 1)
NOW = datetime(1998, 2, 1, 12, 0, 0)

# ---------------------------------------------------------------------------
# Upsert
# ---------------------------------------------------------------------------

SHOWN = (
    "id", "source", "source_listing_id", "address", "price_cents", "acres", "auction_date", "upset_bid", "parcel_number",
    "google_maps_url", "initial_auction_date", "first_seen", "last_seen", "last_updated", "seen_count", "status",
)


def stored(spark, sf):
    """Current table, with its hashes: written once, as a stored table is, since an upsert reads it several times."""
    return stage(with_columns_of(view(spark, sf, CV), PROPERTY_COLUMNS).withColumn("dedup_hash", dedup_hash()), "current")


def odd(spark, sf):
    return view(spark, sf, SV).where("ord % 2 = 1")


def empty_table(spark):
    return spark.createDataFrame([], struct(PROPERTY_COLUMNS))


def upsert_sql(batch: str, current: str, result: str, ord_: str = "ord") -> str:
    """Row-wise reading of the same rules: every sighting is routed, then properties fold their rows in order."""
    return oracle(("sightings_v", "current_v"), f"""
with cur as (select * from current_v where {current}), b as (select * replace ({ord_} as ord) from sightings_v where {batch}),
k as (select source, source_listing_id, min(id) as id from cur where source_listing_id is not null group by 1, 2),
h as (select address, min(id) as id from cur group by 1),
r as (select b.*, case when b.source_listing_id is not null then k.id else h.id end as match_id from b
  left join k on k.source = b.source and k.source_listing_id = b.source_listing_id left join h on h.address = b.address),
kc as (select source, source_listing_id, min(ord) as c, arg_min(address, ord) as address from r
  where match_id is null and source_listing_id is not null group by 1, 2),
hk as (select address, min(c) as c from kc group by 1),
hc as (select address, min(ord) as c from r where match_id is null and source_listing_id is null group by 1),
e as (select r.*, case when match_id is not null then null when r.source_listing_id is not null then kc.c
    else least(hc.c, coalesce(hk.c, hc.c)) end as created from r
  left join kc on kc.source = r.source and kc.source_listing_id = r.source_listing_id
  left join hc on hc.address = r.address left join hk on hk.address = r.address),
x as (select match_id, created, ord, price_cents, auction_date, upset_bid, initial_auction_date from e union all
  select id, null, -1, price_cents, auction_date, upset_bid, initial_auction_date from cur
  where id in (select match_id from e)),
y as (select match_id, created, max(cast(coalesce(old <> now, false) as int)) as changed from (
    select match_id, created, [price_cents::varchar, auction_date, upset_bid] as now, lag([price_cents::varchar, auction_date, upset_bid])
      over (partition by match_id, created order by ord) as old from x) group by 1, 2),
z as (select match_id, created, arg_max(initial_auction_date, ord) filter (old is null or old = '' or old <> now) as spelled from (
    select *, trim(initial_auction_date) as now, lag(trim(initial_auction_date)) over (partition by match_id, created order by ord) as old
    from x where initial_auction_date is not null) group by 1, 2),
f as (select match_id, created, count(*) as n,
    arg_max(struct_pack(price := price_cents, acres := acres, auction := auction_date, upset := upset_bid), ord) as l,
    arg_min(struct_pack(source := source, lid := source_listing_id, address := address), ord) as b,
    arg_min(parcel_number, ord) filter (parcel_number <> '') as parcel_number,
    arg_max(google_maps_url, ord) filter (google_maps_url <> '') as google_maps_url from e group by 1, 2),
g as (select f.*, y.changed, z.spelled from f join y on f.match_id is not distinct from y.match_id and f.created is not distinct from y.created
  left join z on f.match_id is not distinct from z.match_id and f.created is not distinct from z.created),
snapshot as (
  select cur.id, source, source_listing_id, address, case when n is null then cur.price_cents else l.price end as price_cents,
    case when n is null or manual_acres_set is not null then cur.acres else l.acres end as acres,
    case when n is null then cur.auction_date else l.auction end as auction_date,
    case when n is null then cur.upset_bid else l.upset end as upset_bid,
    coalesce(cur.parcel_number, g.parcel_number) as parcel_number, coalesce(g.google_maps_url, cur.google_maps_url) as google_maps_url,
    coalesce(g.spelled, cur.initial_auction_date) as initial_auction_date, first_seen,
    case when n is null then last_seen else date '1998-02-01' end as last_seen,
    case when changed = 1 then date '1998-02-01' else last_updated end as last_updated,
    cast(seen_count + coalesce(n, 0) as int) as seen_count, status
  from cur left join g on g.match_id = cur.id
  union all
  select coalesce((select max(id) from cur), 0) + row_number() over (order by created), b.source, b.lid, b.address, l.price, l.acres,
    l.auction, l.upset, parcel_number, google_maps_url, spelled, date '1998-02-01', date '1998-02-01',
    case when changed = 1 then date '1998-02-01' end, cast(n as int), 'active' from g where match_id is null)
{result}""")


SHOWN_SQL = "select " + ", ".join(SHOWN) + " from snapshot"

# ---------------------------------------------------------------------------
# Parcels
# ---------------------------------------------------------------------------


def _probe_sql(text: str, policy: str) -> str:
    """CTEs ending in ``best``: (id, parcel fields) of the first acceptable parcel of each listing."""
    variants = [f"trim({text})", f"replace(trim({text}), '-', '')", f"regexp_replace({text}, '[^A-Za-z0-9]', '', 'g')"]
    if policy == "strict":
        variants = variants[:1]
    tries = " union all ".join(f"select id, county, {i} as v, {expr} as s from src" for i, expr in enumerate(variants))
    cond = [
        "p.cntyfips = t.fips and p.nparno = '37' || t.fips || '_' || t.s", "p.cntyfips = t.fips and p.altparno = t.s",
        "p.cntyfips = t.fips and p.parno = t.s", "p.parno = t.s", "p.altparno = t.s",
    ]
    hits = " union all ".join(
        f"select t.id, t.v * 5 + {i} as rank, {i} as step, t.county, p.* from t join p on {c}" for i, c in enumerate(cond))
    if policy == "strict":
        ends, good = "step >= 2 or (is_clean and cntyname = county)", "is_clean and cntyname = county"
    else:
        ends, good = "step >= 3 or (is_clean and (step = 2 or cntyname = county))", "is_clean"
    return f"""p as ({CLEAN_SQL}), t as (select q.*, fips from ({tries}) q join dim_county_v using (county) where s <> ''),
hits as ({hits}), ended as (select * from hits where {ends}
  qualify row_number() over (partition by id order by rank, feature_id) = 1), best as (select * from ended where {good})"""


def j3_sql(select: str, policy: str = "default", text: str = "parcel_number", where: str = "true") -> str:
    return oracle((LV, PV), f"with src as (select *, {text} as txt from listings_v where {where}), {_probe_sql('txt', policy)} {select}")


FOUND = "select l.id, b.parno as found, b.acres as found_acres from listings_v l left join best b on b.id = l.id"

SHORT = "case split_part(address, ' ', 4) when 'Road' then 'RD' when 'Drive' then 'DR' when 'Lane' then 'LN' when 'Street' then 'ST' else 'CT' end"
W12 = "split_part(address, ' ', 2) || '{}' || split_part(address, ' ', 3)"
ADDRESS_CTE = f"""pa as ({CLEAN_SQL}), q as (select id, fips, 1 as prio, '%' || {W12.format(' ')} || ' ' || {SHORT} || '%' as pattern
    from listings_v join dim_county_v using (county) where county not in ('columbus', 'cumberland', 'montgomery') union all
  select id, fips, 2, '%' || {W12.format('%')} || '%' from listings_v join dim_county_v using (county)
    where county not in ('columbus', 'cumberland', 'montgomery')),
first_hits as (select q.id, prio, pa.* from q join pa on pa.cntyfips = q.fips and pa.site_address like q.pattern
  qualify row_number() over (partition by q.id, prio order by feature_id) = 1),
by_address as (select * from first_hits where is_clean and acres > 0 qualify row_number() over (partition by id order by prio) = 1)"""


def tn_sites(spark, sf):
    """Assessment parcels: county id, and addresses with a common tail so that words overlap."""
    df = view(spark, sf, PV)
    return df.select(
        F.col("feature_id").alias("ord"), dims.tn_county_id(F.col("cntyname")).alias("COUNTY_ID"),
        F.when(F.trim("siteadd") != "", F.concat("siteadd", F.when(F.col("feature_id") % 2 == 0, " PARK HILL").otherwise(""))).alias("ADDRESS"),
        F.col("ownname").alias("OWNER"), F.lit(None).cast("string").alias("OWNER2"), F.lit("City").alias("CITY"),
        F.col("parno").alias("CMAP"), F.lit("G").alias("GP"), F.col("altparno").alias("PARCEL"), F.lit("L").alias("GISLINK"),
        F.lit("S").alias("SUBDIV"), F.lit("1").alias("LOT"), F.lit(1.5).alias("DEEDAC"), F.lit(2.5).alias("CALCAC"))


def tn_listings(spark, sf):
    df = view(spark, sf, LV)
    return df.withColumn("address", F.when(F.col("id") % 3 == 0, F.concat("address", F.lit(" Park Hill"))).otherwise(F.col("address")))


def fuzzy(min_score):
    return lambda spark, sf: en.match_fuzzy(tn_listings(spark, sf), tn_sites(spark, sf), min_score).select(
        "id", "tnmap_cmap", "tnmap_deeded_acres")


TN_IDS = ", ".join(f"('{c}', {i})" for i, c in enumerate(dims.TN_COUNTIES, 1))
SUFFIXES = "ST|STREET|AVE|AVENUE|BLVD|BOULEVARD|DR|DRIVE|ROAD|RD|LANE|LN|CIR|CIRCLE|WAY|COURT|CT"
WORDS = "list_distinct(list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> ''))"


TN_SHOWN = """p.ownname as tnmap_owner, cast(null as varchar) as tnmap_owner2, p.siteadd || case when p.feature_id % 2 = 0 then ' PARK HILL' else '' end as tnmap_address,
  case when p.feature_id is not null then 'City' end as tnmap_city, case when p.feature_id is not null then 1.5::double end as tnmap_deeded_acres,
  case when p.feature_id is not null then 2.5::double end as tnmap_calculated_acres, case when p.feature_id is not null then 'L' end as tnmap_gislink,
  p.parno as tnmap_cmap, case when p.feature_id is not null then 'G' end as tnmap_gp, p.altparno as tnmap_parcel,
  case when p.feature_id is not null then 'S' end as tnmap_subdivision"""


def fuzzy_sql(min_score: int, shown: str = "p.parno as tnmap_cmap, case when p.parno is not null then 1.5::double end as tnmap_deeded_acres") -> str:
    fallback = "coalesce(m.ord, c.ord)" if min_score <= 5 else "m.ord"
    return oracle((LV, PV), f"""with tn as (select * from (values {TN_IDS}) as t(cname, cid)),
s as (select feature_id as ord, cid, parno, trim(regexp_replace(trim(siteadd) || case when feature_id % 2 = 0 then ' PARK HILL' else '' end,
    '\\b({SUFFIXES})\\b\\.?', '', 'g')) as w from parcels_v join tn on cname = cntyname where trim(siteadd) <> ''),
a as (select id, cid, trim(regexp_replace(upper(address || case when id % 3 = 0 then ' Park Hill' else '' end),
    '\\b({SUFFIXES})\\b\\.?', '', 'g')) as w from listings_v join tn on cname = county),
pairs as (select a.id, s.ord, regexp_extract_all(a.w, '\\d+') = regexp_extract_all(s.w, '\\d+') as nums,
    len(list_intersect({WORDS.format('a.w')}, {WORDS.format('s.w')})) as common,
    len(list_distinct(list_concat({WORDS.format('a.w')}, {WORDS.format('s.w')}))) as total from a join s using (cid)),
m as (select id, min(ord) as ord from pairs where nums or (common >= 2 and common * 2 > total) group by 1),
c as (select cid, min(ord) as ord from s group by 1)
select l.id, {shown}
from listings_v l left join a on a.id = l.id left join m on m.id = l.id left join c on c.cid = a.cid
left join parcels_v p on p.feature_id = {fallback}""")


def maps_sql(lat: str, lng: str, county: str) -> str:
    return f"""'https://www.google.com/maps/search/?api=1&query=' || case when {lat} is not null then printf('%.6f,%.6f', {lat}, {lng})
        else concat_ws('+', replace(address, ' ', '+'), city, {county}, 'NC') end"""


def viewer_sql(lat: str, lng: str, parcel: str) -> str:
    return f"""case when {lat} is not null then '{VIEWER}' || printf('&center=%.6f,%.6f&level=16', {lng}, {lat})
        when {parcel} <> '' then 'https://www.google.com/maps/search/parcel+' || {parcel} || '+in+NC' end"""


NEEDS = """(l.acres is null or acres_source is null or acres_source = 'placeholder'
  or (coalesce(parcel_number, '') <> '' and coalesce(gis_url, '') = '')
  or (coalesce(parcel_number, '') <> '' and (gis_url like '%services6.arcgis.com%'
    or (google_maps_url like '%/maps/search/%' and google_maps_url not like '%?api=1%'))))"""

# ---------------------------------------------------------------------------
# Commands
# ---------------------------------------------------------------------------


def commands(df):
    """A stream of manual changes: each listing gets some, some repeat, some are wrong."""
    i = F.col("id")

    def some(every: int, step: int, kind: str, value, ident=None):
        return F.when(i % every == 0, F.struct(
            (i * 8 + step).alias("ord"), (i if ident is None else ident).alias("id"), F.lit(kind).alias("kind"),
            value.cast("string").alias("value"), F.lit("2026-05-06").alias("at")))

    none = F.lit(None)
    all_ = F.array(
        some(4, 0, "archive", none), some(8, 1, "unarchive", none), some(5, 2, "notes", F.concat(F.lit("n"), i)),
        some(10, 3, "notes", none), some(3, 4, "acres", F.when(i % 9 > 0, i % 50 + 0.5)), some(6, 5, "acres", i % 7),
        some(50, 6, "archive", none, i + 4000000000000000000),
    )
    return df.select(F.explode(F.filter(all_, lambda c: c.isNotNull())).alias("c")).select("c.*")


SET_ACRES = "case when manual_acres_set is null and id % 3 = 0 then case when id % 9 > 0 then id % 50 + 0.5::double when id % 6 = 0 then cast(id % 7 as double) end end"

# ---------------------------------------------------------------------------
# Streams
# ---------------------------------------------------------------------------


def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return stream.stream_files(spark, sf, schema, glob="events.parquet")


def st1_incremental(spark, sf):
    """Two runs over the landed files: the second finds nothing new."""
    out, mark = new_folder(spark, "notices"), new_folder(spark, "mark")
    for _ in range(2):
        rows = _event_stream(spark, sf).select("event_id", "ts", "event_type")
        stream.write_stream(rows, out, mark).awaitTermination()
    return spark.read.parquet(out)


def st1_pulls(spark, sf):
    """Three pulls by date: a backfill, one that fails before its mark, and one that reads a week again and finds what came late."""
    root, events = new_folder(spark, "pulls"), table(spark, sf, "events").select("event_id", "ts", "event_type")
    late = F.col("event_id") % 5 == 0
    pull.pull(events.where(~late), root, date(2024, 1, 12), "event_id", "ts", backfill=8)
    events.write.parquet(f"{root}/rows/run=1")
    pull.pull(events, root, date(2024, 1, 15), "event_id", "ts", backfill=8)
    pull.pull(events, root, date(2024, 1, 25), "event_id", "ts", backfill=8)
    return pull.pulled(spark, root).select("event_id", "event_type", F.col("run").cast("bigint").alias("run"))


def st2_periodic(spark, sf):
    """The same on a clock, stopped once all landed files are read."""
    out = new_folder(spark, "notices")
    rows = _event_stream(spark, sf).select("event_id", "event_type")
    q = stream.write_stream(rows, out, new_folder(spark, "mark"), trigger={"processingTime": "1 second"})
    q.processAllAvailable()
    q.stop()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def st3_seen(spark, sf):
    """Ids that come again are passed over."""
    out = new_folder(spark, "notices")
    hits = _event_stream(spark, sf).withColumn("id", F.concat("event_type", F.col("user_id").cast("string")))
    stream.stream_notices(hits.select("id"), out, new_folder(spark, "mark")).awaitTermination()
    return spark.read.parquet(out).select("id")


def st4_upsert(spark, sf):
    """Sightings land in two portions; each is folded into the stored table as it arrives."""
    landing, root, mark = (new_folder(spark, n) for n in ("sightings", "table", "mark"))
    rows = view(spark, sf, SV)
    for parity in (0, 1):
        rows.where(f"ord % 2 = {parity}").write.mode("append").parquet(landing)
        arriving = stream.stream_files(spark, landing, rows.schema, files_per_batch=1000000)
        stream.stream_upsert(arriving, root, mark, today=TODAY).awaitTermination()
    return read_table(spark, root).select(*SHOWN)


def k2_snapshot(spark, sf):
    path = new_folder(spark, "snapshot")
    write_snapshot(conform(view(spark, sf, LV)), path)
    return read_snapshot(spark, path).select("id", "address", "acres", "status", "first_seen")


def k3_run_log(spark, sf):
    """Runs logged at their start and again at their end, read as one row each."""
    path = new_folder(spark, "runs")
    runs = view(spark, sf, RV)
    append_runs(runs.withColumns({"status": F.lit("running"), "finished_at": F.lit(None)}), path)
    append_runs(runs.where("finished_at is not null"), path)
    return read_runs(spark, path).select("id", "source", "status", "properties_found")


def d9_run(spark, sf):
    runs = mutate.start_run(view(spark, sf, RV), "src_new", NOW, -1)
    outcome = up.outcome_counts(up.fold_batch(odd(spark, sf), stored(spark, sf), TODAY))
    return mutate.finish_run(runs, -1, outcome, NOW).select(
        "id", "source", "status", "properties_found", "properties_new", "properties_duplicate", "finished_at")


def d8_evolve(spark, sf):
    old = view(spark, sf, LV).drop("initial_auction_date", "acres_source", "owner_name")
    old = old.withColumn("auction_date", F.when(F.col("id") % 6 == 1, "not yet set").otherwise(F.col("auction_date")))
    return conform(old).select("id", "initial_auction_date", "upset_bid_end", "owner_name", "land_use")


def run_all(spark, sf):
    done, _ = jobs.run_all(stored(spark, sf), odd(spark, sf), parcels(spark, sf), TODAY)
    return done.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("acres_source") == "gis").alias("gis"))


QUERIES = {
    "d1_upsert": (
        lambda spark, sf: up.upsert(stored(spark, sf), odd(spark, sf), TODAY).snapshot.select(*SHOWN),
        upsert_sql("ord % 2 = 1", "true", SHOWN_SQL),
    ),
    "d1_upsert_actions": (
        lambda spark, sf: up.upsert(stored(spark, sf), odd(spark, sf), TODAY).actions,
        upsert_sql("ord % 2 = 1", "true", "select ord, case when ord = created then 'new' else 'duplicate' end as action from e"),
    ),
    "w8_running_fold": (
        lambda spark, sf: up.upsert(empty_table(spark), view(spark, sf, SV), TODAY).snapshot.select(*SHOWN),
        upsert_sql("true", "false", SHOWN_SQL),
    ),
    "j1_natural_key": (
        lambda spark, sf: up.route_matches(odd(spark, sf), stored(spark, sf), TODAY).where("route = 'key'").select(
            "source", "source_listing_id", "sightings", "match_id"),
        upsert_sql("ord % 2 = 1", "true", """select source, source_listing_id, count(*) as sightings, max(match_id) as match_id
            from e where source_listing_id is not null group by 1, 2"""),
    ),
    "j2_address_hash": (
        lambda spark, sf: up.route_matches(odd(spark, sf), stored(spark, sf), TODAY).where("route = 'hash'").select(
            "address", "sightings", "match_id", "created_ord"),
        upsert_sql("ord % 2 = 1", "true", """select address, count(*) as sightings, max(match_id) as match_id, max(created) as created_ord
            from e where source_listing_id is null group by 1"""),
    ),
    "j2_address_hash_in_batch": (
        lambda spark, sf: up.route_matches(view(spark, sf, SV), empty_table(spark), TODAY).where("route = 'hash'").select(
            "address", "sightings", "match_id", "created_ord"),
        upsert_sql("true", "false", """select address, count(*) as sightings, max(match_id) as match_id, max(created) as created_ord
            from e where source_listing_id is null group by 1"""),
    ),
    "a11_batch_outcome": (
        lambda spark, sf: up.upsert(stored(spark, sf), odd(spark, sf), TODAY).counts,
        upsert_sql("ord % 2 = 1", "true", """select count(*) as found, count(*) filter (ord = created) as new,
            count(*) filter (ord is distinct from created) as duplicate from e"""),
    ),
    # -- parcels
    "j3_parcel_lookup": (
        lambda spark, sf: en.match_parcels(view(spark, sf, LV), parcels(spark, sf)).select(
            "id", F.col("match.parno").alias("found"), F.col("match.acres").alias("found_acres")),
        j3_sql(FOUND),
    ),
    "j3_parcel_lookup_strict": (
        lambda spark, sf: en.match_parcels(view(spark, sf, LV), parcels(spark, sf), policy="strict").select(
            "id", F.col("match.parno").alias("found"), F.col("match.acres").alias("found_acres")),
        j3_sql(FOUND, "strict"),
    ),
    "j4_parcel_candidates": (
        lambda spark, sf: en.match_parcels(
            view(spark, sf, LV).withColumn("parcel_number", F.concat(F.lit("junk-1 "), "parcel_number")), parcels(spark, sf),
            split_candidates=True).select("id", F.col("match.parno").alias("found")),
        j3_sql("select l.id, b.parno as found from listings_v l left join best b on b.id = l.id"),
    ),
    "j5_address_search": (
        lambda spark, sf: en.match_addresses(view(spark, sf, LV), parcels(spark, sf)).select(
            "id", F.col("match.parno").alias("found"), F.col("match.acres").alias("found_acres")),
        oracle((LV, PV), f"""with {ADDRESS_CTE} select l.id, b.parno as found, b.acres as found_acres
            from listings_v l left join by_address b on b.id = l.id"""),
    ),
    "j6_fuzzy_match": (fuzzy(15), fuzzy_sql(15)),
    "j6_fuzzy_match_any": (fuzzy(5), fuzzy_sql(5)),
    "d10_tn_columns": (
        lambda spark, sf: en.match_fuzzy(tn_listings(spark, sf), tn_sites(spark, sf)).select("id", *en.TN_FIELDS), fuzzy_sql(15, TN_SHOWN),
    ),
    "a14_county_groups": (
        _on(LV, lambda df: df.groupBy(dims.tn_county_id(F.col("county")).alias("county_id")).agg(F.count(F.lit(1)).alias("listings"))),
        oracle(LV, f"""select cid as county_id, count(*) as listings from listings_v
            left join (values {TN_IDS}) as t(cname, cid) on cname = county group by 1"""),
    ),
    "w7_best_parcel": (
        lambda spark, sf: en.lookup_parcels(view(spark, sf, LV), parcels(spark, sf)).select(
            "county", "parcel_number", F.col("match.feature_id").alias("best")),
        j3_sql("select distinct l.county, parcel_number, feature_id as best from listings_v l join best b on b.id = l.id"),
    ),
    "a10_enrichment_outcome": (
        lambda spark, sf: en.enrichment_outcome(en.enrich(view(spark, sf, LV), parcels(spark, sf))),
        j3_sql(f"""select count(*) filter (parcel_number <> '' and b.acres > 0) as enriched,
            count(*) filter (coalesce(parcel_number, '') = '') as skipped,
            count(*) filter (parcel_number <> '' and not coalesce(b.acres > 0, false)) as failed
            from listings_v l left join best b on b.id = l.id where {NEEDS}"""),
    ),
    "d6_apply_parcels": (
        lambda spark, sf: en.enrich(view(spark, sf, LV), parcels(spark, sf)).where("outcome = 'enriched'").select(
            "id", "acres", "acres_source", "parcel_number", "owner_name", "land_use", "gis_county", "latitude", "longitude",
            "gis_url", "google_maps_url"),
        j3_sql(f"""select l.id, b.acres, 'gis' as acres_source, parno as parcel_number, b.owner_name, b.land_use, cntyname as gis_county,
            coalesce(b.latitude, l.latitude) as latitude, coalesce(b.longitude, l.longitude) as longitude,
            {viewer_sql('b.latitude', 'b.longitude', 'parno')} as gis_url, {maps_sql('b.latitude', 'b.longitude', 'cntyname')} as google_maps_url
            from listings_v l join best b on b.id = l.id where b.acres > 0 and {NEEDS}"""),
    ),
    "d6_apply_addresses": (
        lambda spark, sf: en.enrich_by_address(view(spark, sf, LV), parcels(spark, sf), "src_3").select(
            "id", "outcome", "acres", "parcel_number", "gis_county"),
        oracle((LV, PV), f"""with {ADDRESS_CTE} select l.id, case when b.id is null then 'failed' else 'enriched' end as outcome, b.acres,
            coalesce(b.parno, l.parcel_number) as parcel_number, b.cntyname as gis_county
            from listings_v l left join by_address b on b.id = l.id where source = 'src_3' and l.acres is null"""),
    ),
    "j12_d7_repair_links": (
        lambda spark, sf: en.repair_links(view(spark, sf, LV).withColumn("google_maps_topo_url", F.lit(None).cast("string")), parcels(spark, sf)).select(
            "id", "parcel_number", "latitude", "longitude", "gis_url", "google_maps_url"),
        j3_sql(f"""select id, parcel_number, latitude, longitude, {viewer_sql('latitude', 'longitude', 'parcel_number')} as gis_url,
            {maps_sql('latitude', 'longitude', 'county')} as google_maps_url from (
              select l.id, address, city, l.county,
                case when l.latitude is not null or status <> 'active' then nullif(parcel_number, '')
                  when m1.latitude is not null or m2.id is null then coalesce(m1.parno, nullif(parcel_number, '')) else m2.parno end as parcel_number,
                case when l.latitude is not null or status <> 'active' then l.latitude when m1.latitude is not null or m2.id is null
                  then m1.latitude else m2.latitude end as latitude,
                case when l.latitude is not null or status <> 'active' then l.longitude when m1.latitude is not null or m2.id is null
                  then m1.longitude else m2.longitude end as longitude
              from listings_v l left join best m1 on m1.id = l.id left join by_address m2 on m2.id = l.id)""").replace(
            "best as (", f"{ADDRESS_CTE}, best as ("),
    ),
    # -- table changes
    "d2_archive_below": (
        _on(LV, lambda df: mutate.archive_below(df, 2.0, TODAY, ["src_0", "src_1", "src_2"]).select("id", "status", "last_seen")),
        oracle(LV, """select id, case when hit then 'archived' else status end as status,
            case when hit then date '1998-02-01' else last_seen end as last_seen from (select *, coalesce(status = 'active' and acres > 0
              and acres < 2 and source in ('src_0', 'src_1', 'src_2'), false) as hit from listings_v)"""),
    ),
    "d2_archived_count": (
        _on(LV, lambda df: df.agg(F.count_if(mutate.below_acres(df, 10.0)).alias("archived"))),
        oracle(LV, "select count(*) as archived from listings_v where status = 'active' and acres > 0 and acres < 10"),
    ),
    "d3_d4_d5_commands": (
        _on(LV, lambda df: mutate.apply_commands(df.withColumn("manual_acres_override", F.lit(None).cast("double")), commands(df))[0].select(
            "id", "status", "notes", "acres", "manual_acres_set", "manual_acres_override")),
        oracle(LV, f"""select id, case when id % 8 = 0 then 'active' when id % 4 = 0 then 'archived' else status end as status,
            case when id % 10 = 0 then '' when id % 5 = 0 then 'n' || id else notes end as notes, coalesce(a, acres) as acres,
            coalesce(manual_acres_set, case when a is not null then '2026-05-06' end) as manual_acres_set, a as manual_acres_override
            from (select *, {SET_ACRES} as a from listings_v)"""),
    ),
    "d5_rejected_commands": (
        _on(LV, lambda df: mutate.apply_commands(df.withColumn("manual_acres_override", F.lit(None).cast("double")), commands(df))[1].select(
            "ord", "id", "kind", "reason")),
        oracle(LV, """select id * 8 + 6 as ord, id + 4000000000000000000 as id, 'archive' as kind, 'not found' as reason from listings_v where id % 50 = 0
            union all select id * 8 + 4, id, 'acres', case when manual_acres_set is not null then 'already set' else 'missing value' end
              from listings_v where id % 3 = 0 and (manual_acres_set is not null or id % 9 = 0)
            union all select id * 8 + 5, id, 'acres', 'already set' from listings_v
              where id % 6 = 0 and (manual_acres_set is not null or id % 9 > 0)"""),
    ),
    "d8_schema_evolution": (
        d8_evolve,
        oracle(LV, """select id, case when id % 6 <> 1 then auction_date end as initial_auction_date,
            nullif(close_date, '') as upset_bid_end, cast(null as varchar) as owner_name, cast(null as varchar) as land_use from listings_v"""),
    ),
    "d9_run_rows": (
        d9_run,
        upsert_sql("ord % 2 = 1", "true", """select id, source, status, properties_found, properties_new, cast(null as int) as properties_duplicate,
              finished_at from runs_v union all
            select -1, 'src_new', 'completed', cast(count(*) as int), cast(count(*) filter (ord = created) as int),
              cast(count(*) filter (ord is distinct from created) as int), timestamp '1998-02-01 12:00:00' from e""").replace(
            "sightings_v as (", with_views((RV,), "duckdb")[5:] + ",\nsightings_v as (", 1),
    ),
    "k2_snapshot": (
        k2_snapshot, oracle(LV, "select id, address, acres, status, first_seen from listings_v"),
    ),
    "k3_run_log": (
        k3_run_log, oracle(RV, "select id, source, status, properties_found from runs_v"),
    ),
    # -- streams
    "st1_incremental_pull": (st1_incremental, "select event_id, ts, event_type from events"),
    "st1_pull_by_mark": (st1_pulls, """select event_id, event_type, case when event_id % 5 > 0 and d between date '2024-01-04' and date '2024-01-12' then 0
        when d between date '2024-01-08' and date '2024-01-15' then 1 else 2 end::bigint as run
        from (select *, ts::date as d from events) where event_id % 5 > 0 and d between date '2024-01-04' and date '2024-01-25'
          or d between date '2024-01-08' and date '2024-01-25'"""),
    "st2_periodic_run": (st2_periodic, "select event_type, count(*) as n from events group by 1"),
    "st3_seen_ids": (st3_seen, "select distinct event_type || user_id as id from events"),
    "st4_stream_upsert": (
        st4_upsert,
        upsert_sql("true", "false", SHOWN_SQL, "ord + (ord % 2) * 1125899906842624"),
    ),
    "st5_bid_clock": (
        lambda spark, sf: stream.bid_clock(
            table(spark, sf, "events").select("ts", F.col("user_id").alias("listing_id"), F.col("value").alias("amount")), gap="1 day", least_raise=20),
        """with recursive b as (select user_id as listing_id, ts, value, row_number() over (partition by user_id order by ts, value) as k from events),
          r as (select listing_id, k, ts as first_bid, ts as last_bid, value as high_bid, 1 as bids, 0 as rejected from b where k = 1 union all
            select listing_id, b.k, case when late then ts else first_bid end, case when late or raised then ts else last_bid end,
              case when late or raised then value else high_bid end, case when late then 1 when raised then bids + 1 else bids end,
              case when late then 0 when raised then rejected else rejected + 1 end
            from (select b.*, r.first_bid, r.last_bid, r.high_bid, r.bids, r.rejected, b.ts >= r.last_bid + interval 1 day as late,
                b.value >= r.high_bid + greatest(r.high_bid * 0.05::double, 20) as raised
              from r join b on b.listing_id = r.listing_id and b.k = r.k + 1) as b)
        select listing_id, first_bid, last_bid + interval 1 day as closes, bids::bigint as bids, rejected::bigint as rejected, high_bid
        from r qualify row_number() over (partition by listing_id, first_bid order by k desc) = 1""",
    ),
    "run_all_job": (run_all, None),
}
