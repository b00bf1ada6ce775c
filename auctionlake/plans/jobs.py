"""Whole jobs: collect, enrich and archive over landed files and stored tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auctionlake import dims
from auctionlake.operators import enrich as en
from auctionlake.operators import filters as fl
from auctionlake.operators import mutate, report
from auctionlake.operators.sequence import running_before
from auctionlake.operators.upsert import UpsertResult, upsert
from auctionlake.schema import RUN_COLUMNS, SIGHTING_COLUMNS, struct
from auctionlake.shared import stage
from auctionlake.sources import feeds, normalise as nz, notices as nt
from auctionlake.sources.sinks import append_runs, has_runs, read_runs


@dataclass
class Landing:
    """Folders of landed raw files by source; those left out are not read."""

    listing_json: str | None = None
    sales_grid: str | None = None
    calendar: str | None = None
    notice_hits: str | None = None
    court_grids: dict[str, str] = field(default_factory=dict)
    tax_grid: str | None = None
    newspapers: dict[str, tuple[str, str]] = field(default_factory=dict)


AT = ("file", "pos")


def _court(spark: SparkSession, state: str, path: str) -> DataFrame:
    records = nt.unique_grid_records(nt.group_grid_rows(feeds.read_texts(spark, path, "html"), state), list(AT))
    return fl.county_acre_gate(nz.normalise_court_notices(records, state, keep=AT), state.lower())


def _newspaper(spark: SparkSession, publication: str, pages: str, details: str) -> DataFrame:
    """Notices linked from a newspaper's pages with their detail pages, which are landed as ``<uid>.html``."""
    found = nt.notice_page_candidates(feeds.read_texts(spark, pages, "html"), publication).withColumnRenamed("idx", "pos")
    read = nt.notice_details(feeds.read_texts(spark, details, "html")).withColumn("_page", F.regexp_extract("file", r"([^/]+?)(?:\.html)?$", 1))
    met = found.withColumn("_page", F.regexp_replace("uid", r"\.html$", "")).join(read.drop("file"), "_page", "left").drop("_page")
    return nz.normalise_newspaper(met, publication, keep=AT)


def sources(spark: SparkSession, landing: Landing) -> dict[str, Callable[[], DataFrame]]:
    """How to read and normalise each landed source: name -> its sightings of the qualifying counties, with file and position."""
    parts: dict[str, Callable[[], DataFrame]] = {}
    if landing.listing_json:
        parts["listing_json"] = lambda: fl.qualifying(nz.normalise_listing_json(feeds.read_listing_json(spark, landing.listing_json), AT))
    if landing.sales_grid:
        parts["sales_grid"] = lambda: fl.qualifying(nz.normalise_sales_grid(feeds.read_sales_grid(spark, landing.sales_grid), AT), "nc")
    if landing.tax_grid:
        parts["tax_grid"] = lambda: fl.qualifying(nz.normalise_tax_grid(feeds.read_tax_grid(spark, landing.tax_grid), AT))
    if landing.calendar:
        parts["calendar"] = lambda: nz.normalise_ical(feeds.read_ical(spark, landing.calendar), AT)
    if landing.notice_hits:
        parts["notice_hits"] = lambda: fl.qualifying(nz.normalise_hits(nt.read_notice_hits(spark, landing.notice_hits), AT))
    for state, path in landing.court_grids.items():
        parts[f"court_{state.lower()}"] = partial(_court, spark, state, path)
    for publication, (pages, details) in landing.newspapers.items():
        parts[f"newspaper_{publication}"] = partial(_newspaper, spark, publication, pages, details)
    return parts


def collect(spark: SparkSession, landing: Landing) -> DataFrame:
    """One batch of sightings of the qualifying counties, with file and position as their order."""
    return nz.unify(*[make() for make in sources(spark, landing).values()], keep=AT)


def collect_each(spark: SparkSession, landing: Landing, log: str, now: Callable[[], datetime] = datetime.now) -> DataFrame:
    """``collect`` with every source by itself: it is read and stored, or fails, without touching the others.

    Each gets a row in the run log under ``log`` when it starts and again when it ends, with what it found or its error. A source that
    has failed three times since its last success is left out until its log says otherwise.
    """
    known = read_runs(spark, log) if has_runs(spark, log) else spark.createDataFrame([], struct(RUN_COLUMNS))
    out = {r["source"] for r in report.failing_sources(known).collect()}  # as many as there are sources
    number = (known.agg(F.max("id")).first()[0] or 0) + 1
    done = []
    for run, (name, make) in enumerate(((n, m) for n, m in sources(spark, landing).items() if n not in out), number):
        began = now()
        row = {"id": run, "source": name, "started_at": began, "status": "running"}
        append_runs(_run_row(spark, row), log)
        try:
            rows = stage(make(), f"source-{name}")
            row |= {"status": "completed", "properties_found": rows.count()}
            done.append(rows)
        except Exception as error:  # noqa: BLE001 - whatever a source raises is that source's failure
            row |= {"status": "failed", "error_message": str(error)[:2000]}
        append_runs(_run_row(spark, row | {"finished_at": now()}), log)
    return nz.unify(*done, keep=AT) if done else spark.createDataFrame([], struct({**SIGHTING_COLUMNS, "file": T.StringType(), "pos": T.IntegerType()}))


def _run_row(spark: SparkSession, row: dict) -> DataFrame:
    return spark.createDataFrame([tuple(row.get(c) for c in RUN_COLUMNS)], struct(RUN_COLUMNS))


def numbered(batch: DataFrame, order: tuple[str, str] = ("file", "pos")) -> DataFrame:
    """Batch with a unique arrival number ``ord``: files by name, each taking as many numbers as its highest position needs.

    File names are summed up in ranges (``running_before``), so no task holds them all.
    """
    file, pos = order
    sizes = batch.groupBy(file).agg((F.max(pos).cast("long") + 1).alias("_n"))
    ranked = running_before(sizes, file, "_n", "_first").drop("_n")
    return batch.join(ranked, file).withColumn("ord", F.col("_first") + F.col(pos)).drop("_first", file, pos)


def run_all(current: DataFrame, batch: DataFrame, parcels: DataFrame, today: date) -> tuple[DataFrame, UpsertResult]:
    """(table after upsert, enrichment and archiving of small properties, upsert result)."""
    result = upsert(current, batch, today)
    table = enrich_table(result.snapshot, parcels)
    return mutate.archive_below(table, dims.RUN_ALL_MIN_ACRES, today), result


def enrich_table(table: DataFrame, parcels: DataFrame) -> DataFrame:
    """Whole table, listings in need of it enriched."""
    return en.enrich_in_place(table, parcels)
