"""Source readers and normalisers, run over raw texts that Spark first writes from the tables.

The reference SQL goes straight to the facts the texts were written from.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from auctionlake import dims
from auctionlake.functions.parcel import normalise_parcels
from auctionlake.operators import filters as fl
from auctionlake.operators.sequence import keep_first
from auctionlake.plans.catalog_reports import FV, LV, NV, PV, _on
from auctionlake.plans.catalog_text import CASE, CLEAN_SQL, DAY, PIN, REF, SPACE, TITLE, TV, raw_features
from auctionlake.plans.views import oracle, table, view
from auctionlake.schema import retype
from auctionlake.sources import feeds, normalise as nz, notices as nt, parcels as pc

FEED_FIELDS = "county address parcel saledatetime openingbid currentbid closedate propertytype courtfile".split()
TOWN = "case tid % 5 when 0 then 'Somewhere' when 1 then 'Old Town' else 'Town' || o_custkey % 40 end"
ZIP = "case when tid % 5 = 1 then (28000 + o_custkey % 900) || '-1234' when tid % 5 > 1 then cast(28000 + o_custkey % 900 as varchar) end"
BID = "case tid % 4 when 1 then (o_custkey % 900 + 1) * 1000 + tid % 1000 + 0.07 when 2 then o_custkey % 900 + 1.5 end"
BID_CENTS = "case tid % 4 when 1 then cast(trunc(((o_custkey % 900 + 1) * 1000 + tid % 1000 + 0.07::double) * 100) as bigint) when 2 then (o_custkey % 900 + 1) * 100 + 50 end"
SALE = """case when tid % 3 = 1 then '2026-' || lpad(cast(tid % 12 + 1 as varchar), 2, '0') || '-' ||
  lpad(cast(o_custkey % 28 + 1 as varchar), 2, '0') end"""


def api_files(feed):
    """Listing-API responses: one object, and elements that are none."""
    value = F.struct(*FEED_FIELDS, F.col("rid").alias("___id___"))
    body = F.to_json(F.struct(value.alias("value")))
    return feed.select(
        "rid", F.concat(F.lit("["), body, F.lit(', {"value": "text"}, 7, {"other": 1}, {"value": null}]')).alias("content")
    )


def sales_pages(texts):
    """Sales-grid pages of one good row per class and one with a cell too few."""
    cells = [
        F.when(F.col("tid") % 3 == 0, "").otherwise(F.concat(F.lit("<b>C"), F.col("tid"), F.lit("</b>"))),
        F.concat(F.lit("26SP"), F.col("tid")),
        F.when(F.col("tid") % 11 == 0, "Greer, SC").otherwise(F.concat(F.initcap("county"), F.lit(", NC"))),
        F.col("sale_text"),
        F.concat(F.lit("<i>"), F.col("tid"), F.lit("  Elm\n St</i>")),
        F.col("city_line"),
        F.when(F.col("tid") % 4 == 0, "Not available").otherwise(F.concat(F.lit("Bk 1 Pg "), F.col("tid"))),
        F.col("bid_text"),
    ]

    def row(cls: str, n: int):
        inner = F.concat(*[F.concat(F.lit('<td class="c">'), c, F.lit("</td>\n")) for c in cells[:n]])
        return F.concat(F.lit(f'<tr class="{cls}">'), inner, F.lit("</tr>"))

    html = F.concat(
        F.lit("<table><tr><th>x</th></tr>"), row("GridRow_WebBlue", 8), row("GridAltRow_WebBlue", 8),
        row("GridRow_WebBlue", 7), F.lit("</table>"),
    )
    return texts.select("tid", "county", html.alias("html"))


def tax_cells(texts):
    t = F.col("tid")
    parcel = F.when(t % 6 == 0, "").otherwise(F.concat(F.lit("P-"), t))
    cells = F.array(
        F.col("office"), parcel, F.when(t % 5 == 0, "Pending sale").otherwise("For sale"),
        F.when(t % 4 == 0, "Not yet set").otherwise("8/1/2026 10:00 AM"),
        F.when(t % 7 == 0, "").otherwise("8/11/2026"),
        F.when(t % 3 == 0, "N/A").otherwise(F.concat(F.lit("$"), t, F.lit(".50"))), F.lit("n/a"), F.lit("shot"),
        F.when(t % 9 == 0, "").otherwise(F.concat(F.lit("⚠️ "), t, F.lit(" Oak Rd"))),
    )
    return texts.select("tid", F.when(t % 13 == 0, F.slice(cells, 1, 8)).otherwise(cells).alias("cells"))


def calendars(texts):
    """Calendar files of one event: folded lines, escapes, values given apart, some redeemed or incomplete."""
    t = F.col("tid")

    def line(*parts):
        return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts], F.lit("\r\n"))

    def custom(name: str, ident: int, value):
        return line(f'X-TRUMBA-CUSTOMFIELD;NAME="{name}";ID={ident};TYPE=SingleLine:', value)

    text = F.concat(
        line("BEGIN:VCALENDAR"), line("BEGIN:VEVENT"),
        F.when(t % 10 == 3, "").otherwise(line("SUMMARY:OWNER\\, ", t)),
        line("LOCATION:", t, " Whit\r\n temore Rd"),
        line("DTSTART;", F.col("stamp")), line("DTEND:20260817T170000Z"),
        line("UID:", F.col("uid")),
        line("X-TRUMBA-LINK:https://cal.example/", t),
        custom("Redeemed", 1, F.when(t % 7 == 0, "Yes").otherwise("No")),
        custom("Case Number", 2, F.when(t % 5 == 0, "").otherwise(F.concat(F.lit("26 CVD "), t))),
        custom("PIN lookup", 3, F.col("link")),
        custom("Opening/Current Bid", 4, F.when(t % 2 == 0, "value").otherwise(F.concat(t, F.lit(".25")))),
        F.when(t % 2 == 0, line("X-TRUMBA-CUSTOMFIELD;FIELDVALUE;ID=4 -> ", t, "\\,000.75")).otherwise(""),
        F.when(t % 3 == 0, line("DESCRIPTION:")).otherwise(line("DESCRIPTION:about\\n", t)),
        line("END:VEVENT"), line("END:VCALENDAR"),
    )
    return texts.select("tid", text.alias("content"))


def hit_files(rows):
    """Search responses of one hit and one without an id; ids repeat over the files."""
    source = F.struct(
        F.col("l_orderkey").cast("string").alias("id"), "text", "slug", F.col("shipped").cast("string").alias("date_start")
    )
    broken = F.struct(F.lit(None).cast("string").alias("id"), "text", "slug", F.lit("x").alias("date_start"))
    hits = F.array(F.struct(source.alias("_source")), F.struct(broken.alias("_source")))
    body = F.struct(F.struct(hits.alias("hits")).alias("hits"))
    return rows.select(F.col("nid").alias("file"), F.to_json(body).alias("content"))


UID = "lpad(to_hex(page_id), 8, '0')"


def linked_pages(pages, base: str, middle: str, end: str):
    """Web pages with three notice links, the first of them twice, and two dates."""
    uid = F.lower(F.lpad(F.hex("page_id"), 8, "0"))

    def link(slug: str, mark: str):
        return F.concat(F.lit(f'<a href="{base}{slug}{middle}'), uid, F.lit(f'{mark}{end}">n</a>'))

    slugs = ("sheriff-sale-1", "bake-off", "tax-lien-2") if middle else ("", "", "")
    links = F.concat(
        link(slugs[0], "-a"), link(slugs[0], "-a"), F.lit("<i>Jan 5, 2026</i>"), link(slugs[1], "-b"),
        F.lit("<i>March 16 2026</i>"), link(slugs[2], "-c"),
    )
    return pages.select("page_id", F.concat("html", links).alias("html"))


def _candidates(publication, base, middle, end):
    return lambda spark, sf: nt.notice_page_candidates(
        linked_pages(table(spark, sf, "pages"), base, middle, end), publication
    ).select("page_id", "uid", "idx", "date")


def _candidate_sql(marks: str, where: str = "true"):
    return f"""select page_id, lower({UID}) || mark as uid, cast(idx as int) as idx, d as date from pages,
        (values {marks}) as m(mark, idx, d) where {where}"""


def grid_pages(texts, column: str):
    """Result grids: a key row and two rows that belong to it, after rows that belong to none; keys repeat."""
    key = F.concat(
        F.lit("<tr><td><input type='hidden' id='ctl_hdnPKValue' value='"), F.col("tid"),
        F.lit("'/><input id='btnView2' onclick=\"location.href='Details.aspx?ID="), F.col("tid"), F.lit("'\"/></td></tr>"),
    )
    follow = F.concat(F.lit("<tr><td>"), F.col("sp_text"), F.lit("</td></tr>\n<tr><td><b>"), F.col(column), F.lit("</b></td></tr>"))
    again = F.when(F.col("tid") % 2 == 0, F.concat(key, follow)).otherwise("")
    html = F.concat(F.lit("<table><tr><th>head</th></tr>"), key, follow, again, F.lit("</table>"))
    return texts.select("tid", html.alias("html"))


def detail_pages(pages):
    note = F.concat(
        F.lit("<p>Parcel ID #1234-56-"), F.lpad(F.col("page_id").cast("string"), 4, "0"),
        F.lit(" Deed Book 7 at Page "), F.col("page_id").cast("string"), F.lit(" 26SP"),
        F.lpad(F.col("page_id").cast("string"), 6, "0"), F.lit("</p></body>"),
    )
    return pages.select("page_id", F.concat("html", note).alias("html"))


BODY_SQL = r"""lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<head\b.*?</head>', ' ', 'g'),
  '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'))"""
OK_SQL = f"not regexp_matches({BODY_SQL}, 'sorry|error|blocked|404')"
SQUASH = "trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<{t}\\b[^>]*>(.*?)</{t}>', 1), '<[^>]+>', ' ', 'g'), '[\\s\\x{{a0}}]+', ' ', 'g'))"
H1 = SQUASH.format(t="h1")
PAGE_TITLE = SQUASH.format(t="title")
DETAIL_SQL = f"""select page_id, case when ok then '1234-56-' || lpad(cast(page_id as varchar), 4, '0') end as pin,
  case when ok then 'Deed:Bk7Pg' || page_id end as deed_plat,
  case when ok then '26SP' || lpad(cast(page_id as varchar), 6, '0') end as court_case, title
  from (select page_id, {OK_SQL} and not contains(lpad(cast(page_id as varchar), 6, '0'), '404') as ok,
    coalesce(nullif({H1}, ''), nullif(trim(split_part({PAGE_TITLE}, '|', 1)), '')) as title from pages)"""


def details(spark, sf):
    return nt.notice_details(detail_pages(table(spark, sf, "pages")))


def news(publication):
    def run(spark, sf):
        extra = {
            "uid": F.concat(F.lit("u"), "page_id"), "slug": F.concat(F.lit("tax-sale-"), "page_id"), "card_title": F.lit("Card"),
            "url": F.concat(F.lit("https://n.example/"), "page_id"),
            "date": F.when(F.col("page_id") % 2 == 0, "Jan 5, 2026").otherwise(""),
        }
        rows = details(spark, sf).withColumns({k: v.cast("string") for k, v in extra.items()})
        return nz.normalise_newspaper(rows, publication).select(
            "source_listing_id", "url", "city", "county", "description", "deed_book", "court_case", "auction_date")
    return run


def _news_sql(publication, heading, url, where="pin is not null or title <> ''"):
    p = dims.PUBLICATIONS[publication]
    return f"""select '{p["prefix"]}u' || page_id as source_listing_id, {url} as url, '{p["city"]}' as city, '{p["county"]}' as county,
        '[{p["label"]}] ' || {heading} || case when page_id % 2 = 0 then ' -- Jan 5, 2026' else '' end as description,
        deed_plat as deed_book, court_case, case when page_id % 2 = 0 then 'Jan 5, 2026' end as auction_date
        from ({DETAIL_SQL}) where {where}"""


CAL_KEPT = "tid % 10 <> 3 and tid % 7 <> 0"
CAL_PIN = "case tid % 4 when 0 then tid || '-0' when 1 then cast(tid as varchar) end"
CAL_BID = "case when tid % 2 = 0 then tid || ',000.75' else tid || '.25' end"
STAMP = """case when tid % 6 > 0 then '2026-' || lpad(cast(tid % 12 + 1 as varchar), 2, '0') || '-' ||
  lpad(cast(o_custkey % 28 + 1 as varchar), 2, '0') || ' ' || lpad(cast(o_custkey % 24 as varchar), 2, '0') || ':' ||
  lpad(cast(tid % 60 as varchar), 2, '0') || case when tid % 6 = 1 then 'Z' else '' end end"""
SEARCH = "'https://www.google.com/maps/search/'"


def listing_json(spark, sf):
    return feeds.listing_records(api_files(view(spark, sf, FV)))


def _batch(spark, sf):
    texts = view(spark, sf, TV)
    return nz.unify(
        fl.qualifying(nz.normalise_listing_json(listing_json(spark, sf))),
        fl.qualifying(nz.normalise_sales_grid(feeds.sales_grid_rows(sales_pages(texts))), "nc"),
        fl.qualifying(nz.normalise_tax_grid(feeds.tax_grid_rows(tax_cells(texts)))),
        nz.normalise_ical(feeds.ical_events(calendars(texts))),
    )


QUERIES = {
    "s1_listing_json": (
        lambda spark, sf: listing_json(spark, sf).drop("rid", "pos"),
        oracle(FV, f"select {', '.join(FEED_FIELDS)}, cast(rid as varchar) as ___id___ from feed_v"),
    ),
    "s2_sales_grid": (
        _on(TV, lambda df: feeds.sales_grid_rows(sales_pages(df)).select("tid", "pos", "case_no", "sp_no", "csz_raw", "bid_raw")),
        oracle(TV, """select tid, cast(n as int) as pos, case when tid % 3 = 0 then '' else '<b>C' || tid || '</b>' end as case_no,
            '26SP' || tid as sp_no, city_line as csz_raw, bid_text as bid_raw from texts_v, (values (0), (1)) as r(n)"""),
    ),
    "s3_tax_grid": (
        _on(TV, lambda df: feeds.tax_grid_rows(tax_cells(df)).select("tid", "tax_office", "parcel", "opening_bid", "address_raw")),
        oracle(TV, """select tid, office as tax_office, case when tid % 6 = 0 then '' else 'P-' || tid end as parcel,
            case when tid % 3 = 0 then 'N/A' else '$' || tid || '.50' end as opening_bid,
            case when tid % 9 = 0 then '' else tid || ' Oak Rd' end as address_raw from texts_v where tid % 13 <> 0"""),
    ),
    "s4_ical_events": (
        _on(TV, lambda df: feeds.ical_events(calendars(df)).select(
            "tid", F.regexp_extract("block", "LOCATION:(.*)", 1).alias("location"))),
        oracle(TV, "select tid, tid || ' Whittemore Rd' as location from texts_v"),
    ),
    "s5_notice_hits": (
        _on(NV, lambda df: nt.notice_hits(hit_files(df)).select(
            F.col("id"), F.col("file").alias("nid"), "date_start")),
        oracle(NV, """select cast(l_orderkey as varchar) as id, min(nid) as nid,
            cast(arg_min(shipped, nid) as varchar) as date_start from notices_v group by 1"""),
    ),
    "s6_page_links_watauga": (
        _candidates("watauga", "/classifieds/community/public_notices/", "/ad_", ".html"),
        _candidate_sql("('-a', 0, 'Jan 5, 2026'), ('-c', 1, 'March 16 2026')"),
    ),
    "s6_page_links_sylva": (
        _candidates("sylva", "/classifieds/community/announcements/legal/", "", ".html"),
        _candidate_sql("('-a.html', 0, 'Jan 5, 2026'), ('-b.html', 1, 'March 16 2026'), ('-c.html', 2, 'Jan 5, 2026')"),
    ),
    "s6_page_links_mitchell": (
        _candidates("mitchell", "/classified/legals/", "", ""),
        _candidate_sql(
            "('-a', 0, 'Jan 5, 2026'), ('-b', 1, 'March 16 2026'), ('-c', 2, 'Jan 5, 2026')",
            f"length(trim(regexp_replace(html, '<[^>]+>', ' ', 'g') || ' n  n  Jan 5, 2026  n  March 16 2026  n', {SPACE} || chr(160))) >= 1500"),
    ),
    "s6_cards": (
        _on(TV, lambda df: nt.card_candidates(
            df.select("tid", F.concat(F.lit("/public-notices/"), "tid").alias("href"), F.col("card").alias("card_text"))
        ).select("tid", "title", "content", "posted")),
        oracle(TV, """select tid, 'Notice of sale' as title, 'Posted Jan ' || (o_custkey % 28 + 1) || ' text' as content,
            'Jan ' || (o_custkey % 28 + 1) as posted from texts_v where tid % 3 = 0"""),
    ),
    "s7_grid_nc": (
        _on(TV, lambda df: nt.unique_grid_records(nt.group_grid_rows(grid_pages(df, "nc_text"), "NC"), ["tid", "pos"]).select(
            "pk_id", "sp_case", F.lower("county").alias("county"), "detail_url")),
        oracle(TV, """select cast(tid as varchar) as pk_id, case when tid % 3 = 0 then sp_text end as sp_case,
            case when tid % 3 < 2 then county end as county, 'Details.aspx?ID=' || tid as detail_url from texts_v"""),
    ),
    "s7_grid_tn": (
        _on(TV, lambda df: nt.unique_grid_records(nt.group_grid_rows(grid_pages(df, "tn_text"), "TN"), ["tid", "pos"]).select(
            "pk_id", "sp_case", F.lower("county").alias("county"), "detail_url")),
        oracle(TV, """select cast(tid as varchar) as pk_id, case when tid % 3 < 2 then sp_text end as sp_case,
            case when tid % 4 < 3 then county end as county, 'Details.aspx?ID=' || tid as detail_url from texts_v"""),
    ),
    "s8_parcel_features": (
        _on(PV, lambda df: normalise_parcels(pc.parcel_features(
            raw_features(df).select(
                F.col("feature_id").alias("file"),
                F.to_json(F.struct(F.array(F.struct("attributes", "geometry")).alias("features"))).alias("content"))
        )).where("is_clean").select("parno", "acres", "land_use", "longitude", "latitude")),
        oracle(PV, f"select parno, acres, land_use, longitude, latitude from ({CLEAN_SQL}) where is_clean"),
    ),
    "s9_notice_details": (
        lambda spark, sf: details(spark, sf).select("page_id", "pin", "deed_plat", "court_case", "title"),
        DETAIL_SQL,
    ),
    "s10_backfill_window": (
        _on(NV, lambda df: nt.incremental_window(df, None, date(1999, 6, 30), ts="shipped").select("nid", "shipped")),
        oracle(NV, "select nid, shipped from notices_v where shipped between date '1999-06-30' - 180 and date '1999-06-30'"),
    ),
    "s10_next_window": (
        _on(NV, lambda df: nt.incremental_window(df, date(1999, 6, 20), date(1999, 6, 30), ts="shipped").select("nid", "shipped")),
        oracle(NV, "select nid, shipped from notices_v where shipped between date '1999-06-20' and date '1999-06-30'"),
    ),
    "s10_overlap_window": (
        _on(NV, lambda df: nt.incremental_window(df, date(1999, 6, 29), date(1999, 6, 30), ts="shipped").select("nid", "shipped")),
        oracle(NV, "select nid, shipped from notices_v where shipped between date '1999-06-30' - 7 and date '1999-06-30'"),
    ),
    "p1_listing_json": (
        lambda spark, sf: nz.normalise_listing_json(listing_json(spark, sf), keep=("rid",)).select(
            "rid", "source_listing_id", "court_case", "address", "city", "county", "price_cents", "property_type",
            "parcel_number", "upset_bid", "foreclosure_key"),
        oracle(FV, """select rid, case when courtfile <> '' then courtfile else cast(rid as varchar) end as source_listing_id,
            nullif(courtfile, '') as court_case,
            (split_part(address, ' ', 1)) || '  Elm  St, ' || trim(split_part(address, ',', 2)) as address, 'Marion' as city,
            trim(county) as county, nullif(coalesce(cast(trunc(try_cast(regexp_replace(coalesce(nullif(openingbid, ''), currentbid),
              '[^0-9.]', '', 'g') as double) * 100) as bigint), 0), 0) as price_cents,
            lower(propertytype) as property_type, regexp_replace(parcel, '</?p>', '', 'g') as parcel_number,
            currentbid as upset_bid,
            saledatetime || '|' || coalesce(closedate, '') || '|' || coalesce(currentbid, '') || '|' || openingbid as foreclosure_key
            from feed_v where trim(county) <> '' and lower(coalesce(propertytype, '')) not like '%commercial%'"""),
    ),
    "p2_sales_grid": (
        _on(TV, lambda df: nz.normalise_sales_grid(feeds.sales_grid_rows(sales_pages(df).drop("county")), keep=("tid", "pos")).select(
            "tid", "pos", "source_listing_id", "court_case", "address", "city", "county", "state", "zip_code", "price_cents",
            "deed_book", "auction_date")),
        oracle(TV, f"""select tid, cast(n as int) as pos, case when tid % 3 = 0 then '26SP' || tid else 'C' || tid end as source_listing_id,
            '26SP' || tid as court_case, tid || ' Elm St' as address, {TOWN} as city, county, 'NC' as state, {ZIP} as zip_code,
            {BID_CENTS} as price_cents, case when tid % 4 <> 0 then 'Bk 1 Pg ' || tid end as deed_book, {SALE} as auction_date
            from texts_v, (values (0), (1)) as r(n) where tid % 11 <> 0"""),
    ),
    "p3_tax_grid": (
        _on(TV, lambda df: nz.normalise_tax_grid(feeds.tax_grid_rows(tax_cells(df)), keep=("tid",)).select(
            "tid", "source_listing_id", "county", "address", "price_cents", "auction_date", "upset_bid", "foreclosure_key",
            "description", "google_maps_url")),
        oracle(TV, f"""select tid, 'zls_nc_' || p as source_listing_id, c as county, a as address, cents as price_cents,
            case when tid % 4 <> 0 then '8/1/2026 10:00 AM' end as auction_date, case when tid % 7 <> 0 then '8/11/2026' end as upset_bid,
            coalesce(p, '') || '|' || st || '|' || ob as foreclosure_key,
            nullif(concat_ws(' | ', case when tid % 5 <> 0 then 'Status: ' || st end, case when tid % 3 <> 0 then 'Opening: ' || ob end,
              case when tid % 7 <> 0 then 'Upset: 8/11/2026' end, 'Parcel: ' || p), '') as description,
            case when a is not null or (p is not null and c is not null) then {SEARCH} || concat_ws('+', a, c, 'NC') end as google_maps_url
            from (select *, case when tid % 6 <> 0 then 'P-' || tid end as p, case when tid % 3 < 2 then {TITLE} end as c,
              case when tid % 9 <> 0 then tid || ' Oak Rd' end as a, case when tid % 5 = 0 then 'Pending sale' else 'For sale' end as st,
              case when tid % 3 = 0 then 'N/A' else '$' || tid || '.50' end as ob,
              case when tid % 3 <> 0 then tid * 100 + 50 end as cents from texts_v) where tid % 13 <> 0"""),
    ),
    "p4_ical": (
        _on(TV, lambda df: nz.normalise_ical(feeds.ical_events(calendars(df)), keep=("tid",)).select(
            "tid", "source_listing_id", "address", "price_cents", "parcel_number", "court_case", "auction_date", "upset_bid_end",
            "foreclosure_key", "upset_bid", "raw_source_text", "google_maps_topo_url")),
        oracle(TV, f"""select tid, case tid % 3 when 0 then 'trumba_' || tid when 1 then 'u' || tid end as source_listing_id,
            tid || ' Whittemore Rd' as address,
            case when tid % 2 = 0 then (tid * 1000) * 100 + 75 + case when tid = 0 then 0 else 0 end else tid * 100 + 25 end as price_cents,
            {CAL_PIN} as parcel_number, case when tid % 5 <> 0 then '26 CVD ' || tid end as court_case, {STAMP} as auction_date,
            '2026-08-17 17:00Z' as upset_bid_end,
            (case when tid % 5 <> 0 then '26 CVD ' || tid else '' end) || '|' || coalesce({CAL_PIN}, '') || '|' || {CAL_BID} as foreclosure_key,
            {CAL_BID} as upset_bid, case when tid % 3 <> 0 then 'about' || chr(10) || tid end as raw_source_text,
            {SEARCH} || tid || ' Whittemore Rd+Buncombe+NC/@?api=1&map_action=map&base=maps.terrain' as google_maps_topo_url
            from texts_v where {CAL_KEPT}"""),
    ),
    "p5_notice_hits": (
        _on(NV, lambda df: fl.qualifying(nz.normalise_hits(nt.notice_hits(hit_files(df)))).select(
            "source_listing_id", "court_case", "parcel_number", "deed_book", "extracted_deed_plat", "address", "county",
            "auction_date", "description")),
        oracle(NV, f"""with firsts as (select * from notices_v qualify row_number() over (partition by l_orderkey order by nid) = 1)
            select source_listing_id, court_case, parcel_number, deed_book, extracted_deed_plat, address, {TITLE} as county, auction_date,
            '[Citizen Times] ' || concat_ws(' -- ', title, 'Case: ' || court_case, 'Auction: ' || auction_date, 'PIN: ' || parcel_number,
              'Deed/Plat: ' || extracted_deed_plat) as description
            from (select *, cast(l_orderkey as varchar) as source_listing_id, {CASE} as court_case, {PIN} as parcel_number,
              {REF} as extracted_deed_plat, case when l_linenumber % 2 = 0 then {REF} end as deed_book,
              case when l_linenumber % 5 = 0 then l_suppkey || ' Oak Lane' end as address,
              coalesce({DAY}, cast(shipped as varchar)) as auction_date,
              case when slug is null then 'Unknown' else 'Notice Of Sale ' || {TITLE} || ' County ' || l_orderkey end as title
              from firsts) where county in ({", ".join(f"'{c}'" for c in dims.MOUNTAIN_COUNTIES)})"""),
    ),
    "p6_newspaper_watauga": (
        news("watauga"),
        _news_sql("watauga", "case when length(title) > 5 then title else 'Tax Sale ' || page_id end",
                  f"'{dims.PUBLICATIONS['watauga']['base']}tax-sale-' || page_id || '/ad_u' || page_id || '.html'"),
    ),
    "p6_newspaper_sylva": (
        news("sylva"),
        _news_sql("sylva", "case when length(title) >= 4 then title else 'Legal Notice' end",
                  f"'{dims.PUBLICATIONS['sylva']['base']}u' || page_id"),
    ),
    "p6_newspaper_mitchell": (
        news("mitchell"),
        _news_sql("mitchell", "'Legal Notice'", f"'{dims.PUBLICATIONS['mitchell']['base']}'", "true"),
    ),
    "p6_newspaper_transylvania": (
        news("transylvania"),
        _news_sql("transylvania", "case when length(title) > 5 then title else 'Card' end", "'https://n.example/' || page_id"),
    ),
    "p7_court_notices_nc": (
        _on(NV, lambda df: nz.normalise_court_notices(
            df.select(F.col("nid").cast("string").alias("pk_id"), F.lit(None).cast("string").alias("sp_case"), "county", "text",
                      F.lit("d").alias("detail_url")), "NC", 20.0).select("source_listing_id", "county", "acres", "description")),
        oracle(NV, """select cast(nid as varchar) as source_listing_id, county, cast(cast(l_quantity as int) + 0.5 as double) as acres,
            text as description from notices_v where cast(l_quantity as int) + 0.5 >= 20"""),
    ),
    "p7_court_notices_tn": (
        lambda spark, sf: nz.normalise_court_notices(
            table(spark, sf, "documents").select(
                F.col("doc_id").cast("string").alias("pk_id"), F.lit(None).cast("string").alias("sp_case"),
                F.lit(" Knox ").alias("county"), "text", F.lit("d").alias("detail_url")), "TN").select(
            "source_listing_id", "county", "state", F.length("description").alias("kept_chars")),
        """select cast(doc_id as varchar) as source_listing_id, 'knox' as county, 'TN' as state,
            cast(length(text) as int) as kept_chars from documents""",
    ),
    "p8_unified_batch": (
        lambda spark, sf: _batch(spark, sf).groupBy("source").agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(F.col("price_cents") == 0).alias("unpriced"), F.count("acres").alias("sized")),
        oracle((FV, TV), f"""select 'kania_law' as source, count(*) as rows, count(*) filter (v = 0) as unpriced, cast(0 as bigint) as sized
              from (select coalesce(cast(trunc(try_cast(regexp_replace(coalesce(nullif(openingbid, ''), currentbid), '[^0-9.]', '', 'g')
                as double) * 100) as bigint), 0) as v from feed_v where lower(trim(county)) in ({", ".join(f"'{c}'" for c in dims.MOUNTAIN_COUNTIES)})
                and lower(coalesce(propertytype, '')) not like '%commercial%')
            union all select 'hutchens_law', count(*) * 2, count(*) filter (tid % 4 in (0, 3)) * 2, 0 from texts_v
              where tid % 11 <> 0 and county in ({", ".join(f"'{c}'" for c in dims.STATE_COUNTIES["NC"])})
            union all select 'zls_nc', count(*), count(*) filter (tid % 3 = 0), 0 from texts_v
              where tid % 13 <> 0 and tid % 3 < 2 and county in ({", ".join(f"'{c}'" for c in dims.MOUNTAIN_COUNTIES)})
            union all select 'buncombe_tax', count(*), 0, 0 from texts_v where {CAL_KEPT}"""),
    ),
    "p9_retype": (
        _on(FV, lambda df: retype(
            df.select("rid", F.col("openingbid").alias("acres"), F.regexp_replace("currentbid", r"\$", "").alias("elevation_ft"),
                      F.col("rid").cast("string").alias("price_cents")))),
        oracle(FV, """select rid, try_cast(openingbid as double) as acres,
            try_cast(replace(currentbid, '$', '') as double) as elevation_ft, rid as price_cents from feed_v"""),
    ),
    "p12_descriptions": (
        lambda spark, sf: nz.normalise_listing_json(listing_json(spark, sf), keep=("rid",)).select("rid", "description"),
        oracle(FV, """select rid, nullif(concat_ws(' | ', case when saledatetime <> 'Not yet set' then 'Sale: ' || saledatetime end,
              'Upset bid: ' || currentbid, 'Close date: ' || closedate, 'Parcel: ' || regexp_replace(parcel, '</?p>', '', 'g'),
              'Court file: ' || nullif(courtfile, ''), 'Type: ' || propertytype), '') as description
            from feed_v where trim(county) <> '' and lower(coalesce(propertytype, '')) not like '%commercial%'"""),
    ),
    "w2_keep_first_by_url": (
        _on(LV, lambda df: keep_first(
            df.select(F.coalesce("source_listing_id", F.lit("")).alias("listing_id"), "court_case", "id"),
            ["listing_id", "court_case"], ["id"])),
        oracle(LV, """select coalesce(source_listing_id, '') as listing_id, court_case, min(id) as id from listings_v group by 1, 2"""),
    ),
    "w3_positional_dates": (
        lambda spark, sf: linked_pages(table(spark, sf, "pages"), "/classified/legals/", "", "").select(
            "page_id", F.inline(nt.assign_dates(
                F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.struct(F.lit("s").alias("slug"), i.cast("string").alias("uid"))),
                F.regexp_extract_all("html", F.lit(nt.P.LONG_DATE), F.lit(0))))).select("page_id", "uid", "date"),
        """select page_id, cast(u as varchar) as uid, case when u % 2 = 1 then 'Jan 5, 2026' else 'March 16 2026' end as date
            from pages, (values (1), (2), (3), (4), (5)) as n(u)""",
    ),
}
