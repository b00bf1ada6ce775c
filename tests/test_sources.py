"""Readers on landed files, and the collecting job over them."""

import json
from datetime import date

from auctionlake.operators import mutate
from auctionlake.operators.sequence import dense_index, neighbours, long_levels
from auctionlake.plans import jobs
from auctionlake.plans.jobs import Landing
from auctionlake.schema import PROPERTY_COLUMNS, RUN_COLUMNS, struct
from auctionlake.sources import feeds, notices as nt, parcels as pc
from auctionlake.sources.sinks import export_json, read_snapshot, write_snapshot
from pyspark.sql import functions as F


def land(tmp_path, name, **files):
    folder = tmp_path / name
    folder.mkdir()
    for f, text in files.items():
        (folder / f).write_text(text, encoding="utf8", newline="")
    return str(folder)


API = json.dumps([
    {"value": {"county": "Clay", "address": "1 <b>Oak</b> St, Hayesville, NC", "parcel": "55-1", "saledatetime": "Not yet set",
               "openingbid": "$1,000.50", "currentbid": "", "closedate": "", "propertytype": "Land", "courtfile": "26CVD1"}},
    {"value": {"county": "Wake", "courtfile": "x"}}, {"value": "text"}, 5,
    {"value": {"county": "polk", "openingbid": None, "currentbid": "$7", "propertytype": "Commercial"}},
    {"value": {"county": "polk", "currentbid": "$7", "___id___": 9}},
])
ROW = '<tr class="{}">' + "<td>{}</td> " * 8 + "</tr>"
GRID = "<table>" + ROW.format("GridRow_WebBlue", "C1", "SP1", "Buncombe, NC", "8/1/2026", "2 Elm", "Leicester, NC 28748", "n/a not", "$1.25") + (
    ROW.format("GridAltRow_WebBlue", "C2", "SP2", "York, SC", "", "", "", "", "")) + "</table>"
CAL = ("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nSUMMARY:A\r\nLOCATION:5 Long\r\n  Rd\r\nDESCRIPTION:\r\nUID:http://x/event/77\r\n"
       "DTSTART;TZID=x:20260807T120000\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nSUMMARY:B\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n")
HITS = json.dumps({"hits": {"total": {"value": 2}, "hits": [
    {"_source": {"id": "n1", "text": "COUNTY OF CLAY PIN: 061878609600000 Deed Book 1 Page 2", "slug": "tax-sale", "date_start": "2026-01-01"}},
    {"_source": {"id": "n1", "text": "again"}}, {"_source": {"id": None, "text": "x"}}]}})
COURT = ("<table><tr><td>top</td></tr><tr><td><input id='a_hdnPKValue' value='7'></td></tr>"
         "<tr><td>NORTH CAROLINA, CLAY COUNTY 26SP000123-100 containing 12 acres</td></tr></table>")


def test_collect(spark, tmp_path):
    landing = Landing(
        listing_json=land(tmp_path, "api", a=API), sales_grid=land(tmp_path, "grid", a=GRID), calendar=land(tmp_path, "cal", a=CAL),
        notice_hits=land(tmp_path, "hits", a=HITS), court_grids={"NC": land(tmp_path, "court", a=COURT, b=COURT)},
    )
    batch = jobs.numbered(jobs.collect(spark, landing))
    rows = {(r["source"], r["source_listing_id"]): r for r in batch.collect()}
    assert set(rows) == {("kania_law", "26CVD1"), ("kania_law", "9"), ("hutchens_law", "C1"), ("buncombe_tax", "trumba_77"),
                         ("newspaper_notices", "n1"), ("ncforeclosures", "26SP000123-100")}
    api = rows["kania_law", "26CVD1"]
    assert (api["address"], api["city"], api["price_cents"], api["description"]) == (
        "1  Oak  St, Hayesville", "NC", 100050, "Parcel: 55-1 | Court file: 26CVD1 | Type: Land")
    grid = rows["hutchens_law", "C1"]
    assert (grid["county"], grid["zip_code"], grid["price_cents"], grid["deed_book"]) == ("buncombe", "28748", 125, None)
    assert rows["buncombe_tax", "trumba_77"]["address"] == "5 Long Rd"
    assert rows["newspaper_notices", "n1"]["deed_book"] == "Deed:Bk1Pg2"
    assert rows["ncforeclosures", "26SP000123-100"]["acres"] == 12.0
    assert len({r["ord"] for r in rows.values()}) == 6

    table = spark.createDataFrame([], struct(PROPERTY_COLUMNS))
    parcels = pc.read_parcels(spark, land(tmp_path, "gis", a=json.dumps({"features": [
        {"attributes": {"parno": "551", "cntyfips": "043", "cntyname": "Clay", "gisacres": 1.5, "siteadd": None},
         "geometry": {"rings": [[[-83, 35], [-83, 36], [-82, 36], [-82, 35]]]}}, {"attributes": None}]})))
    done, result = jobs.run_all(table, batch, parcels, date(2026, 3, 1))
    assert tuple(result.counts.first()) == (6, 6, 0)
    small = done.where("source_listing_id = '26CVD1'").first()
    assert (small["acres"], small["parcel_number"], small["status"], small["latitude"]) == (1.5, "551", "archived", 35.5)

    out = str(tmp_path / "snap")
    write_snapshot(done, out)
    assert read_snapshot(spark, out).count() == 6
    export_json(done, str(tmp_path / "export"))
    exported = spark.read.json(str(tmp_path / "export"))
    assert exported.count() == 5 and "dedup_hash" not in exported.columns


def test_tn_parcels(spark, tmp_path):
    path = land(tmp_path, "tn", a=json.dumps({"features": [{"attributes": {"COUNTY_ID": 3, "OWNER": "X", "DEEDAC": 1.5}}]}))
    row = pc.read_tn_parcels(spark, path).first()
    assert (row["COUNTY_ID"], row["OWNER"], row["DEEDAC"]) == (3, "X", 1.5)


def test_all_links_of_a_page(spark):
    html = "".join(f'<a href="/classified/legals/{i:08x}-0">' for i in range(40)) + "x" * 2000 + "Jan 1, 2026"
    pages = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert nt.notice_page_candidates(pages, "mitchell").count() == 40


def test_tax_grid_needs_nine_cells(spark):
    rows = spark.createDataFrame([(1, [str(i) for i in range(8)]), (2, [str(i) for i in range(9)])], "i int, cells array<string>")
    assert [r["i"] for r in feeds.tax_grid_rows(rows).collect()] == [2]


def test_sequence_over_sparse_keys(spark):
    ids = [0, 1, 5, (1 << 21) - 1, 1 << 21, (1 << 42) - 1, 1 << 42, (1 << 42) + 7, (1 << 62) + 3]
    df = spark.createDataFrame([(i,) for i in ids], "n long")
    assert {r["n"]: r["index"] for r in dense_index(df, "n").collect()} == {v: i + 1 for i, v in enumerate(sorted(ids))}
    for up in (True, False):
        out = neighbours(df, [], long_levels("n", up), F.struct("n")).collect()
        order = sorted(ids, reverse=not up)
        for r in out:
            i = order.index(r["n"])
            assert (r["previous"] and r["previous"]["n"]) == (order[i - 1] if i else None)
            assert (r["next"] and r["next"]["n"]) == (order[i + 1] if i + 1 < len(order) else None)


def test_runs(spark):
    from datetime import datetime

    runs = mutate.start_run(spark.createDataFrame([], struct(RUN_COLUMNS)), "s", datetime(2026, 1, 1), 1)
    counts = spark.createDataFrame([(5, 2, 3)], "found long, new long, duplicate long")
    row = mutate.finish_run(runs, 1, counts, datetime(2026, 1, 2), "failed", "why").first()
    assert (row["properties_found"], row["properties_new"], row["properties_duplicate"], row["status"], row["error_message"]) == (
        5, 2, 3, "failed", "why")


CELLS = json.dumps([["Clay County Tax Office", "P-9", "For sale", "8/1/2026 10:00 AM", "8/11/2026", "$5,000.00", "n/a", "shot", "⚠️ 9 Oak Rd"], ["short"]])
UID = "0a1b2c3d-11"
PAPER = f'<a href="/classifieds/community/public_notices/sheriff-sale-1/ad_{UID}.html">n</a> Jan 5, 2026'
DETAIL = "<html><body><h1>Notice of Sale</h1>Parcel ID: 123-45 Deed Book 4 Page 5</body></html>"


def test_each_source_fails_by_itself(spark, tmp_path):
    """A broken feed is logged and passed over; after three failures it is not tried any more."""
    from auctionlake.sources.sinks import read_runs

    log = str(tmp_path / "runs")
    landing = Landing(
        listing_json=land(tmp_path, "api", a=API), sales_grid=str(tmp_path / "missing"), tax_grid=land(tmp_path, "tax", a=CELLS),
        newspapers={"watauga": (land(tmp_path, "paper", a=PAPER), land(tmp_path, "ads", **{f"{UID}.html": DETAIL}))},
    )
    for attempt in range(4):
        batch = jobs.collect_each(spark, landing, log)
        rows = {(r["source"], r["county"]): r for r in batch.collect()}
        assert {s for s, _ in rows} == {"kania_law", "zls_nc", "newspaper_notices"}
        runs = read_runs(spark, log)
        assert runs.where("source = 'sales_grid'").count() == min(attempt + 1, 3)
    paper = next(r for (s, _), r in rows.items() if s == "newspaper_notices")
    assert (paper["source_listing_id"], paper["extracted_pin"], paper["deed_book"]) == (f"wd_{UID}", "123-45", "Deed:Bk4Pg5")
    told = {(r["source"], r["status"]): r for r in runs.collect()}
    assert set(told) == {("listing_json", "completed"), ("sales_grid", "failed"), ("tax_grid", "completed"), ("newspaper_watauga", "completed")}
    assert told["sales_grid", "failed"]["error_message"] and told["listing_json", "completed"]["properties_found"] == 2
    assert runs.count() == runs.select("id").distinct().count() == 3 * 4 + 3
    assert len({r["ord"] for r in jobs.numbered(batch).collect()}) == 4
    assert jobs.collect_each(spark, Landing(sales_grid=str(tmp_path / "missing")), log).count() == 0
