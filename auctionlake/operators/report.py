"""Search, statistics, coverage, run health and navigation."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionlake import dims
from auctionlake.functions.base import filled, truthy
from auctionlake.functions.keys import dashboard_day, dashboard_order, property_category
from auctionlake.functions.money import cents
from auctionlake.operators.filters import in_counties, recent_errors, search_predicate
from auctionlake.operators.sequence import long_levels, neighbours

ACTIVE = "status = 'active'"


def title_county(c: str = "county") -> Column:
    """Counties come in several spellings by source; reports use one."""
    return F.initcap(F.lower(F.trim(c)))


# -- listings ---------------------------------------------------------------


def active(df: DataFrame, limit: int | None = 100, source: str | None = None) -> DataFrame:
    """Active listings in dashboard order."""
    out = df.where(ACTIVE)
    if source:
        out = out.where(F.col("source") == source)
    out = out.orderBy(*dashboard_order())
    return out if limit is None else out.limit(limit)


def new_since(df: DataFrame, since: date, source: str | None = None, limit: int | None = 100) -> DataFrame:
    return active(df.where(F.col("first_seen") >= F.lit(since)), limit, source)


def new_in_days(df: DataFrame, today: date, days: int = 7, limit: int | None = None) -> DataFrame:
    return new_since(df, today - timedelta(days=days), limit=limit)


def search(
    df: DataFrame, q: str = "", county: str = "", min_acres: float | None = None, status: str = "active",
    page: int = 1, per_page: int = 20,
) -> DataFrame:
    """One page of matches in dashboard order."""
    hits = df.where(search_predicate(q, county, min_acres, status)).orderBy(*dashboard_order())
    return hits.offset((page - 1) * per_page).limit(per_page)


def search_total(
    df: DataFrame, q: str = "", county: str = "", min_acres: float | None = None, status: str = "active"
) -> DataFrame:
    return df.where(search_predicate(q, county, min_acres, status)).agg(F.count(F.lit(1)).alias("total"))


def county_options(df: DataFrame) -> DataFrame:
    """Counties of the active listings, sorted."""
    return df.where(ACTIVE).where("county is not null").select("county").distinct().orderBy("county")


def by_id(df: DataFrame, listing_id: int) -> DataFrame:
    return df.where(F.col("id") == listing_id)


def processing_order(df: DataFrame) -> DataFrame:
    """Active rows first, then by id."""
    return df.orderBy(F.when(F.col("status") == "active", 0).otherwise(1), "id")


def tile_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "is_new": F.col("seen_count") <= 3,
            "is_enriched": truthy(F.col("owner_name")) | truthy(F.col("gis_url")),
            "display_date": F.coalesce("last_updated", "first_seen"),
        }
    )


def with_category(df: DataFrame) -> DataFrame:
    return df.withColumn("category", property_category())


def case_peers(df: DataFrame) -> DataFrame:
    """Active listings that share their court case with others: case, id and number of peers.

    The peers of a listing are the other rows of its case; pairs are not spelled out, as they grow
    with the square of a case.
    """
    cases = df.where(ACTIVE).where(filled(F.col("court_case")))
    sizes = cases.groupBy("court_case").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return cases.join(sizes, "court_case").select("court_case", "id", (F.col("_n") - 1).alias("peers"))


def same_case(df: DataFrame, listing_id: int) -> DataFrame:
    """The other active listings of one listing's court case."""
    case = F.trim(by_id(df, listing_id).select(F.max("court_case")).scalar())
    return df.where(ACTIVE).where((F.trim("court_case") == case) & (F.col("id") != listing_id))


def navigation(df: DataFrame, category: str | None = None) -> DataFrame:
    """(id, previous_id, previous_address, next_id, next_address) of every active listing in dashboard order.

    The order is cut by day, first sighting and id, so no task orders the whole table: days, which are texts of any number, are dealt
    to tasks by ranges, and ids are split in blocks of two million. The ranges are stored when this is called.
    """
    rows = with_category(df.where(ACTIVE))
    if category in ("notice", "listing"):
        rows = rows.where(F.col("category") == category)
    day = F.coalesce(dashboard_day(), F.lit(""))
    levels = [
        ("_day", day, False),
        ("_seen", F.coalesce(F.col("first_seen").cast("string"), F.lit("")), False),
        *long_levels("id", ascending=False, bits=42),
    ]
    slim = rows.select("id", "address", "initial_auction_date", "last_seen", "first_seen")
    out = neighbours(slim, [], levels, F.struct("id", "address"))
    return out.select(
        "id",
        F.col("previous.id").alias("previous_id"), F.col("previous.address").alias("previous_address"),
        F.col("next.id").alias("next_id"), F.col("next.address").alias("next_address"),
    )


def neighbours_of(df: DataFrame, listing_id: int, category: str | None = None) -> DataFrame:
    """The same for one listing, in one pass: the nearest keys on either side. Both null when it is not listed."""
    rows = with_category(df.where(ACTIVE))
    if category in ("notice", "listing"):
        rows = rows.where(F.col("category") == category)
    key = F.struct(
        F.coalesce(dashboard_day(), F.lit("")).alias("day"),
        F.coalesce(F.col("first_seen").cast("string"), F.lit("")).alias("seen"), "id",
    )
    keyed = rows.select(key.alias("k"), F.struct("id", "address").alias("p"))
    own = keyed.where(F.col("k.id") == listing_id).select(F.max("k")).scalar()
    return keyed.withColumn("own", own).agg(
        F.min_by("p", F.when(F.col("k") > F.col("own"), F.col("k"))).alias("previous"),
        F.max_by("p", F.when(F.col("k") < F.col("own"), F.col("k"))).alias("next"),
    )


# -- statistics --------------------------------------------------------------


def stats(df: DataFrame, runs: DataFrame, today: date) -> DataFrame:
    """Totals of the property table in one pass, and the number of runs."""
    totals = df.agg(
        F.count_if(F.col("status") == "active").alias("total_active"),
        F.count(F.lit(1)).alias("total_seen"),
        F.count_if(F.col("first_seen") == F.lit(today)).alias("today_new"),
        F.coalesce(F.sum(F.col("seen_count") - 1), F.lit(0)).cast("long").alias("total_duplicates_seen"),
        F.count_if(F.col("status") == "archived").alias("total_archived"),
    )
    return totals.withColumn("scrape_runs", run_count(runs).scalar())


def run_count(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count(F.lit(1)).alias("runs"))


def by_source(df: DataFrame) -> DataFrame:
    counts = df.where(ACTIVE).groupBy("source").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.orderBy(F.col("cnt").desc(), "source")


def top_counties(df: DataFrame, n: int = 10) -> DataFrame:
    counts = (
        df.where(ACTIVE).where("county is not null")
        .groupBy(title_county().alias("county"), "state").agg(F.count(F.lit(1)).alias("cnt"))
    )
    top = counts.orderBy(F.col("cnt").desc(), "county", "state").limit(n)
    return top.select(F.concat("county", F.lit(", "), "state").alias("label"), "cnt")


def enrichment_rate(df: DataFrame) -> DataFrame:
    """Listings and enriched ones by source, with a total row of source null."""
    done = F.count_if(F.col("acres_source") == "gis")
    counts = df.where("source is not null").rollup("source").agg(F.count(F.lit(1)).alias("listings"), done.alias("enriched"))
    return counts.withColumn("rate_pct", F.round(F.col("enriched") * 100.0 / F.col("listings"), 1))


# -- feed coverage -----------------------------------------------------------


def county_frequency(feed: DataFrame) -> DataFrame:
    """Feed rows by county, and how many of them are in a qualifying one."""
    key = dims.county_key(F.col("county"))
    rows = feed.select(key.alias("county")).where("county <> ''")
    return rows.groupBy("county").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(in_counties(F.col("county"), "mountain")).alias("qualifying")
    )


def seen_counties(feed: DataFrame) -> DataFrame:
    return feed.select(dims.county_key(F.col("county")).alias("county")).where("county <> ''").distinct()


def covered(feed: DataFrame) -> DataFrame:
    return dims.dim_mountain(feed.sparkSession).intersect(seen_counties(feed))


def missed(feed: DataFrame) -> DataFrame:
    return dims.dim_mountain(feed.sparkSession).subtract(seen_counties(feed))


def absent_counties(feed: DataFrame) -> DataFrame:
    """The same as ``missed`` by anti-join."""
    return dims.dim_mountain(feed.sparkSession).join(seen_counties(feed), "county", "left_anti")


def coverage(feed: DataFrame) -> DataFrame:
    """covered, qualifying and their ratio."""
    flags = dims.dim_mountain(feed.sparkSession).join(seen_counties(feed).withColumn("seen", F.lit(True)), "county", "left")
    return flags.agg(F.count("seen").alias("covered"), F.count(F.lit(1)).alias("qualifying")).withColumn(
        "ratio", F.round(F.col("covered") / F.col("qualifying"), 4)
    )


def target_counties(spark) -> DataFrame:
    """All state lists flattened; names repeat across states."""
    return dims.dim_county(spark).select("county")


def filter_funnel(feed: DataFrame) -> DataFrame:
    """Rows of qualifying counties by the first reason to drop them."""
    price = cents("openingbid")
    reason = (
        F.when(F.lower(F.coalesce("propertytype", F.lit(""))).contains("commercial"), "commercial")
        .when(price == 0, "zero_price")
        .when(truthy(F.col("openingbid")) & ~filled(F.col("openingbid")), "no_bid")
        .otherwise("pass")
    )
    rows = feed.where(in_counties(F.col("county"), "mountain"))
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("records"))


def bids_by_county(feed: DataFrame) -> DataFrame:
    """Distinct opening bids of each qualifying county, their value in cents and how often they occur."""
    rows = feed.where(in_counties(F.col("county"), "mountain"))
    counts = rows.groupBy(dims.county_key(F.col("county")).alias("county"), "openingbid").agg(F.count(F.lit(1)).alias("records"))
    return counts.withColumn("cents", cents("openingbid"))


# -- runs --------------------------------------------------------------------


def recent_runs(runs: DataFrame, n: int = 50) -> DataFrame:
    return runs.orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(n)


def latest_runs(runs: DataFrame) -> DataFrame:
    """Runs started last in their source; runs started at the same instant are all kept."""
    last = runs.groupBy("source").agg(F.max("started_at").alias("started_at"))
    return runs.join(last, ["source", "started_at"], "left_semi").select(
        "source", "started_at", "status", "properties_found"
    )


def last_completed(runs: DataFrame) -> DataFrame:
    """The last completed run of each source."""
    done = runs.where("status = 'completed'")
    return done.groupBy("source").agg(F.max("finished_at").alias("finished_at"), F.max_by("id", F.struct("finished_at", "id")).alias("id"))


def new_since_last_run(df: DataFrame, runs: DataFrame) -> DataFrame:
    """Active listings first seen on or after the day their source last completed a run."""
    last = last_completed(runs).select("source", F.to_date("finished_at").alias("last_run"))
    return df.where(ACTIVE).join(last, "source").where(F.col("first_seen") >= F.col("last_run"))


def failure_counts(runs: DataFrame) -> DataFrame:
    """Failures of each source since its last success, running attempts aside.

    Two aggregations instead of a running window, so one busy source does not gather in a task.
    """
    at = F.struct("started_at", "id")
    ended = runs.where("status <> 'running'")
    wins = ended.where("status = 'completed'").groupBy("source").agg(F.max(at).alias("win"))
    tally = ended.select("source", at.alias("at"), (F.col("status") != "completed").alias("failed")).join(wins, "source", "left")
    since = F.col("failed") & (F.col("win").isNull() | (F.col("at") > F.col("win")))
    return tally.groupBy("source").agg(F.count_if(since).alias("failures"))


def failing_sources(runs: DataFrame, max_failures: int = 3) -> DataFrame:
    """Sources to leave out until they are looked at."""
    return failure_counts(runs).where(F.col("failures") >= max_failures)


def run_totals(runs: DataFrame) -> DataFrame:
    return runs.agg(
        F.coalesce(F.sum("properties_found"), F.lit(0)).cast("long").alias("found"),
        F.coalesce(F.sum("properties_new"), F.lit(0)).cast("long").alias("new"),
    )


def health(runs: DataFrame, now: datetime) -> DataFrame:
    """unhealthy after recent errors, else healthy when any source's last run completed, else degraded."""
    ok = latest_runs(runs).agg(F.count_if(F.col("status") == "completed").alias("healthy_sources"))
    errors = recent_errors(runs, now, n=None).agg(F.count(F.lit(1)).alias("n")).scalar()
    return ok.withColumn("recent_errors", errors).withColumn(
        "verdict",
        F.when(F.col("recent_errors") > 0, "unhealthy").when(F.col("healthy_sources") > 0, "healthy").otherwise("degraded"),
    )
