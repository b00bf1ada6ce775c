"""Domain tables derived from the benchmark tables, the same text for Spark and for the checking engine.

The benchmark tables hold no foreclosure data, so listings, parcels, sightings, runs and notices
are derived from their keys by integer arithmetic both engines share.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from auctionlake import dims

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

#: Counties of the derived listings with their codes.
COUNTY_CODES = list(dims.NC_FIPS.items())[:25]

WORD_1 = "OLD NEW UPPER LOWER EAST WEST LONG"
WORD_2 = "MILL CREEK CHURCH RIVER VALLEY FOREST STONE MEADOW SPRING ORCHARD QUARRY"
SUFFIX_LONG = "Road Drive Lane Street Court"
SUFFIX_SHORT = "RD DR LN ST CT"


def _word(words: str, key: str) -> str:
    return f"split_part('{words}', ' ', cast(({key}) % {len(words.split())} + 1 as int))"


def _street(key: str, suffix: str) -> str:
    return f"{_word(WORD_1, key)} || ' ' || {_word(WORD_2, key)} || ' ' || {_word(suffix, key)}"


VIEWS = {
    "dim_county_v": "select * from (values "
    + ", ".join(f"({i}, '{county}', '{code}')" for i, (county, code) in enumerate(COUNTY_CODES))
    + ") as t(k, county, fips)",
    "listings_v": f"""
select o_orderkey as id,
  'src_' || cast(o_custkey % 5 as @str) as source,
  case when o_orderkey % 7 = 0 then null else 'L' || cast(o_orderkey as @str) end as source_listing_id,
  'https://listings.example/' || cast(o_orderkey as @str) as url,
  cast(c_custkey % 900 + 1 as @str) || ' ' || {_street('c_custkey', SUFFIX_LONG)} as address,
  case when o_orderkey % 6 = 0 then null else 'Town' || cast(c_custkey % 40 as @str) end as city,
  county, 'NC' as state, cast(28000 + c_custkey % 900 as @str) as zip_code,
  case when o_orderkey % 5 = 0 then cast(35000 + o_orderkey % 1000 as double) / 1000 end as latitude,
  case when o_orderkey % 5 = 0 then cast(-82000 - o_orderkey % 1000 as double) / 1000 end as longitude,
  cast(round(o_totalprice * 100) as bigint) as price_cents,
  case when o_orderkey % 11 = 0 then null else cast(o_orderkey % 400 as double) / 10 end as acres,
  case when o_orderkey % 11 = 0 then 'placeholder' when o_orderkey % 3 = 0 then 'gis' end as acres_source,
  'Sale: ' || cast(cast(o_orderdate as date) as @str) || ' | Type: ' || c_mktsegment as description,
  case o_orderkey % 3 when 0 then 'public_notice' when 1 then 'tax_foreclosure' else 'commercial lot' end as property_type,
  case when o_orderkey % 4 = 0 then null else cast(cast(o_orderdate as date) + 30 as @str) end as auction_date,
  case when o_orderkey % 4 = 0 then null else cast(o_orderdate as date) + 30 end as initial_auction_date,
  case when o_orderkey % 10 = 0 then '' else cast(cast(o_orderdate as date) + 40 as @str) end as close_date,
  case o_orderkey % 4
    when 0 then lpad(cast(o_orderkey % 2500 as @str), 9, '0')
    when 1 then '0000-' || lpad(cast(o_orderkey % 2500 as @str), 5, '0')
    when 2 then 'A' || cast(o_orderkey % 2500 as @str)
    else case when o_orderkey % 8 = 3 then '' else 'missing-' || cast(o_orderkey as @str) end end as parcel_number,
  '26SP' || lpad(cast(o_custkey % 500 as @str), 6, '0') || '-100' as court_case,
  cast(o_orderdate as date) as first_seen,
  cast(o_orderdate as date) + cast(o_orderkey % 90 as int) as last_seen,
  case when o_orderkey % 9 = 0 then cast(o_orderdate as date) + 5 end as last_updated,
  cast(1 + o_orderkey % 5 as int) as seen_count,
  case when o_orderstatus = 'F' then 'archived' else 'active' end as status,
  case when o_orderkey % 13 = 0 then 'call back about lot ' || cast(o_orderkey % 100 as @str) end as notes,
  case when o_orderkey % 17 = 0 then '2026-01-02T03:04:05' end as manual_acres_set,
  case when o_orderkey % 3 = 0 then 'https://www.arcgis.com/view/' || cast(o_orderkey as @str)
       when o_orderkey % 12 = 1 then 'https://services6.arcgis.com/x/query?where=1&f=json' end as gis_url,
  case when o_orderkey % 12 = 3 then 'https://www.google.com/maps/search/lot' end as google_maps_url,
  case when o_orderkey % 8 = 0 then c_name end as owner_name
from orders join customer on c_custkey = o_custkey join dim_county_v on k = c_nationkey""",
    "parcels_v": f"""
select p_partkey as feature_id,
  lpad(cast(p_partkey as @str), 9, '0') as parno, 'A' || cast(p_partkey as @str) as altparno,
  '37' || fips || '_' || lpad(cast(p_partkey as @str), 9, '0') as nparno,
  fips as cntyfips, county as cntyname,
  case when p_partkey % 17 = 0 then 'bad' when p_partkey % 10 = 0 then '0' else cast(p_size as @str) end as gisacres,
  case when p_partkey % 34 = 0 then 'n/a' when p_partkey % 51 = 0 then null
       else cast(cast(p_size as double) / 2 as @str) end as recareano,
  case when p_partkey % 29 = 0 then '  ' else
    cast(p_partkey % 900 + 1 as @str) || ' ' || {_street('p_partkey', SUFFIX_SHORT)} end as siteadd,
  case when p_partkey % 19 = 0 then null else ' ' || p_brand || ' ' end as ownname,
  case when p_partkey % 3 = 0 then null else 'R' || cast(p_size as @str) end as parusecd2,
  case when p_partkey % 4 = 0 then '' else p_type end as parusedsc2,
  p_partkey % 31 = 0 as no_geometry,
  cast(-80000 - p_partkey % 4000 as double) / 1000 as x0,
  cast(35000 + p_partkey % 1500 as double) / 1000 as y0
from part join dim_county_v on k = p_partkey % 25""",
    "sightings_v": """
select (l_orderkey * 8 + l_linenumber) * 1048576 + cast(round(l_extendedprice * 100) as bigint) % 1048576 as ord,
  'src_' || cast(l_orderkey % 5 as @str) as source,
  case when l_orderkey % 7 = 0 then null else 'L' || cast(l_orderkey % 500 as @str) end as source_listing_id,
  cast(l_orderkey % 300 + 1 as @str) || ' Main Road' as address,
  cast(round(l_extendedprice * 100) as bigint) as price_cents,
  cast(cast(l_shipdate as date) as @str) as auction_date,
  l_returnflag as upset_bid,
  case when l_linenumber % 4 = 0 then null else l_quantity end as acres,
  case when l_linenumber % 3 = 0 then 'P' || cast(l_partkey as @str) end as parcel_number,
  case when l_linenumber % 5 = 0 then 'https://maps.example/' || cast(l_partkey as @str) end as google_maps_url,
  case when l_linenumber % 2 = 0 then null
       when l_linenumber % 3 = 0 then ' ' || cast(l_suppkey % 3 as @str) else cast(l_suppkey % 3 as @str) end
    as initial_auction_date
from lineitem""",
    "runs_v": """
select event_id as id, 'src_' || cast(user_id % 5 as @str) as source,
  ts - interval '26' year as started_at,
  case when event_type in ('signup') then null else ts - interval '26' year end as finished_at,
  case when event_type = 'error' then 'failed' when event_type = 'signup' then 'running' else 'completed' end as status,
  cast(floor(value) as int) as properties_found, cast(floor(value / 2) as int) as properties_new,
  case when event_type = 'error' then 'error ' || cast(user_id as @str) end as error_message
from events""",
    "feed_v": """
select o_orderkey as rid, case when o_orderkey % 37 = 0 then '' when o_orderkey % 4 = 0 then upper(county)
    else ' ' || county end as county,
  cast(o_custkey % 900 + 1 as @str) || ' <b>Elm</b> St, Lot ' || cast(o_orderkey % 9 as @str) || ', Marion' as address,
  case when o_orderkey % 9 = 0 then null else '<p>' || lpad(cast(o_orderkey % 2500 as @str), 9, '0') || '</p>' end as parcel,
  case when o_orderkey % 5 = 0 then 'Not yet set' else cast(cast(o_orderdate as date) as @str) end as saledatetime,
  case when o_orderkey % 6 = 0 then '' when o_orderkey % 6 = 1 then '  '
    else '$' || cast(o_custkey % 97 as @str) || ',' || lpad(cast(o_orderkey % 1000 as @str), 3, '0') || '.50' end as openingbid,
  case when o_orderkey % 4 = 0 then null else '$' || cast(o_orderkey % 5000 as @str) || '.25' end as currentbid,
  case when o_orderkey % 8 = 0 then null else cast(cast(o_orderdate as date) + 10 as @str) end as closedate,
  case when o_orderkey % 10 = 0 then 'Commercial Building' when o_orderkey % 10 = 1 then null else 'Vacant Land' end as propertytype,
  case when o_orderkey % 3 = 0 then '' else '26CVD' || lpad(cast(o_orderkey % 1000000 as @str), 6, '0') end as courtfile
from orders join customer on c_custkey = o_custkey join dim_county_v on k = c_nationkey""",
    "notices_v": """
select (l_orderkey * 8 + l_linenumber) * 1048576 + cast(round(l_extendedprice * 100) as bigint) % 1048576 as nid,
  'STATE OF NORTH CAROLINA COUNTY OF ' || upper(county) || '. '
  || case when l_linenumber % 3 = 0 then 'Parcel ID #' || lpad(cast(l_partkey % 10000 as @str), 4, '0') || '-' ||
       lpad(cast(l_suppkey % 100 as @str), 2, '0') || '-' || lpad(cast(l_orderkey % 10000 as @str), 4, '0') || '-000. ' else '' end
  || case when l_linenumber % 2 = 0 then 'Deed Book ' || cast(l_partkey as @str) || ' at Page ' || cast(l_suppkey as @str)
       else 'Plat File ' || cast(l_partkey as @str) || ', Page ' || cast(l_suppkey as @str) end || '. '
  || case when l_linenumber % 4 = 0 then 'Date of Sale: March ' || cast(l_suppkey % 28 + 1 as @str) || ', 2026. ' else '' end
  || 'Case No: 26CV' || lpad(cast(l_orderkey % 1000000 as @str), 6, '0') || '-100. '
  || case when l_linenumber = 5 then 'Notice to creditors of the estate' when l_linenumber = 6 then 'General notice'
       else 'Substitute trustee will sell land' end
  || ' containing ' || cast(cast(l_quantity as int) as @str) || '.5 acres more or less.' || chr(10)
  || case when l_linenumber % 5 = 0 then 'Address of Property: ' || cast(l_suppkey as @str) || ' Oak Lane.' || chr(10) else '' end
    as text,
  case when l_linenumber = 7 then null else 'notice-of-sale-' || county || '-county-' || cast(l_orderkey as @str) end as slug,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, county, cast(l_shipdate as date) as shipped
from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
  join dim_county_v on k = c_nationkey""",
}

VIEWS["texts_v"] = """
select o_orderkey as tid,
  case o_orderkey % 4 when 0 then 'Bid not available yet'
    when 1 then 'Bid upset 07/24/2026 from $1.00, increasing bid to $' || cast(o_custkey % 900 + 1 as @str) || ',' ||
      lpad(cast(o_orderkey % 1000 as @str), 3, '0') || '.07'
    when 2 then '$' || cast(o_custkey % 900 + 1 as @str) || '.50' else '' end as bid_text,
  case o_orderkey % 3 when 0 then 'not set' when 1 then 'on ' || cast(o_orderkey % 12 + 1 as @str) || '/' ||
      cast(o_custkey % 28 + 1 as @str) || '/2026 10:00' else '' end as sale_text,
  case o_orderkey % 5 when 0 then ' Somewhere ' when 1 then 'Old Town, NC ' || cast(28000 + o_custkey % 900 as @str) || '-1234'
    else 'Town' || cast(o_custkey % 40 as @str) || ', NC ' || cast(28000 + o_custkey % 900 as @str) end as city_line,
  case o_orderkey % 6 when 0 then 'whenever' else 'TZID=America/New_York:2026' || lpad(cast(o_orderkey % 12 + 1 as @str), 2, '0') ||
    lpad(cast(o_custkey % 28 + 1 as @str), 2, '0') || 'T' || lpad(cast(o_custkey % 24 as @str), 2, '0') ||
    lpad(cast(o_orderkey % 60 as @str), 2, '0') || '00' || case when o_orderkey % 6 = 1 then 'Z' else '' end end as stamp,
  case o_orderkey % 4 when 0 then 'https://gis.example/?PINN=' || cast(o_orderkey as @str) || '-0&x=1'
    when 1 then 'https://gis.example/?pid=' || cast(o_orderkey as @str) when 2 then '' else 'https://gis.example/' end as link,
  case o_orderkey % 3 when 0 then 'http://cal.example/event/' || cast(o_orderkey as @str) when 1 then ' u' || cast(o_orderkey as @str) || ' '
    else '' end as uid,
  case o_orderkey % 3 when 0 then upper(county) || ' County  Tax Office' when 1 then county || ' tax office' else 'Clerk of Court' end as office,
  '<p>a <b>' || cast(o_orderkey as @str) || '</b>  c</p>' as html,
  'x' || cast(o_orderkey as @str) || chr(92) || ', y' || chr(92) || '; z' || chr(92) || 'n' || 'w' || chr(92) || chr(92) as escaped,
  case when o_orderkey % 2 = 0 then 'https://n.example/(S(a' || cast(o_orderkey as @str) || 'z))/Details.aspx?ID=1'
    else 'https://n.example/Details.aspx' end as portal,
  case o_orderkey % 3 when 0 then '26SP' || lpad(cast(o_orderkey as @str), 6, '0') || '-100' when 1 then '19SP' || lpad(cast(o_orderkey as @str), 6, '0')
    else 'none' end as sp_text,
  case o_orderkey % 3 when 0 then 'NORTH CAROLINA, ' || upper(county) || ' COUNTY'
    when 1 then 'SUPERIOR Court DIVISION ' || upper(substr(county, 1, 1)) || substr(county, 2) || ' COUNTY' else 'no place' end as nc_text,
  case o_orderkey % 4 when 0 then 'TENNESSEE, ' || upper(county) || ' COUNTY' when 1 then upper(county) || ' COUNTY, TENNESSEE'
    when 2 then 'at the north door, ' || upper(substr(county, 1, 1)) || substr(county, 2) || ' County Courthouse' else 'no place' end as tn_text,
  case o_orderkey % 3 when 0 then 'Notice of sale' || chr(10) || 'Posted Jan ' || cast(o_custkey % 28 + 1 as @str) || chr(10) || 'text'
    when 1 then 'Posted Jan 1' || chr(10) || 'Updated Feb ' || cast(o_custkey % 28 + 1 as @str) else 'nothing' end as card,
  o_orderkey, o_custkey, county
from orders join customer on c_custkey = o_custkey join dim_county_v on k = c_nationkey"""

# One stored row per natural key, or per address where there is no key, from the even-numbered sightings.
VIEWS["current_v"] = """
select s.ord as id, s.source, s.source_listing_id, s.address, s.price_cents, s.acres, s.auction_date, s.upset_bid,
  s.parcel_number, s.google_maps_url, case when s.ord % 3 = 0 then ' 1 ' else s.initial_auction_date end as initial_auction_date,
  date '1998-01-01' as first_seen, date '1998-01-02' as last_seen, cast(null as date) as last_updated,
  cast(1 + s.ord % 3 as int) as seen_count, case when s.ord % 5 = 0 then 'archived' else 'active' end as status,
  case when s.ord % 9 = 0 then '2026-01-02' end as manual_acres_set
from sightings_v s join (select min(ord) as ord from sightings_v where ord % 2 = 0
  group by case when source_listing_id is null then address else source || '|' || source_listing_id end) f on f.ord = s.ord"""

_NEEDS = {
    "current_v": ("sightings_v",),
    "texts_v": ("dim_county_v",),
    "listings_v": ("dim_county_v",), "parcels_v": ("dim_county_v",), "feed_v": ("dim_county_v",),
    "notices_v": ("dim_county_v",),
}
# Views whose rows are parsed at some cost: the table whose rows are dealt to tasks, and by what.
TEXT_VIEWS = {"notices_v": ("lineitem", "l_orderkey"), "texts_v": ("orders", "o_custkey"), "feed_v": ("orders", "o_custkey")}
# The same join in another order for Spark, so that only orders meet customers by a shuffle.
LINES_FIRST = """from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
  join dim_county_v on k = c_nationkey"""
ORDERS_FIRST = """from lineitem join (select o_orderkey, county from orders join customer on c_custkey = o_custkey
  join dim_county_v on k = c_nationkey) on o_orderkey = l_orderkey"""
TYPES = {"spark": "string", "duckdb": "varchar"}


def with_views(names: tuple[str, ...], engine: str) -> str:
    """``with a as (...), b as (...)`` for the named views and what they need."""
    ordered: list[str] = []
    for n in names:
        for m in (*_NEEDS.get(n, ()), n):
            if m not in ordered:
                ordered.append(m)
    text = ",\n".join(f"{n} as ({VIEWS[n]})" for n in ordered)
    return "with " + text.replace("@str", TYPES[engine])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A benchmark table."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a DataFrame.

    Rows whose parsing costs more than their transport are dealt to all cores, as one row group is one task whatever its texts cost. They
    are dealt before their texts are made: the few stored columns travel, by the key that the joins use next, and customers meet orders first.
    """
    text = with_views((name,), "spark")
    dealt, key = TEXT_VIEWS.get(name, (None, None))
    for t in sorted(set(re.findall(r"\b(?:from|join)\s+(\w+)", text)) & set(TABLES)):
        rows = table(spark, sf_dir, t)
        if t == dealt:
            used = [c for c in rows.columns if re.search(rf"\b{c}\b", text)]
            rows = rows.select(*used).repartition(max(partitions(rows), 2 * spark.sparkContext.defaultParallelism), key)
        rows.createOrReplaceTempView(t)
    return spark.sql(f"{text.replace(LINES_FIRST, ORDERS_FIRST)} select * from {name}")


def partitions(stored: DataFrame) -> int:
    """Tasks that read a stored table."""
    return stored.rdd.getNumPartitions()


def oracle(names: tuple[str, ...] | str, body: str) -> str:
    """SQL for the checking engine over derived tables."""
    names = (names,) if isinstance(names, str) else names
    head = with_views(names, "duckdb")
    body = body.strip().replace("@str", "varchar")
    return f"{head}, {body[5:]}" if body.lower().startswith("with ") else f"{head} {body}"
