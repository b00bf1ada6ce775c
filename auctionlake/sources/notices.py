"""Public notices: search responses, newspaper pages, notice grids and detail pages."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auctionlake import dims
from auctionlake.functions import patterns as P
from auctionlake.functions.base import bind, contains_any, empty_to_null, found, rest, strip, truthy
from auctionlake.functions.text import (
    court_case, deed_plat, grid_county, pin, posted_date, sp_case, strip_html,
)
from auctionlake.operators.sequence import keep_first
from auctionlake.sources.feeds import read_texts

HITS = "hits struct<hits:array<struct<_source:struct<id:string,text:string,slug:string,date_start:string>>>>"
SOURCE_FIELDS = ("id", "text", "slug", "date_start")


def notice_hits(files: DataFrame, column: str = "content", order: tuple[str, ...] = ("file",)) -> DataFrame:
    """Search hits of all responses; hits without an id are dropped, the first hit of an id wins."""
    body = F.from_json(F.col(column), HITS)
    hits = files.select(*order, F.posexplode(body["hits"]["hits"]).alias("pos", "hit"))
    rows = hits.select(*order, "pos", *[F.col(f"hit._source.{f}").alias(f) for f in SOURCE_FIELDS])
    return keep_first(rows.where(truthy(F.col("id"))), ["id"], [*order, "pos"])


def read_notice_hits(spark: SparkSession, path: str) -> DataFrame:
    return notice_hits(read_texts(spark, path))


def incremental_window(
    df: DataFrame, last_end: date | None, today: date, ts: str = "date_start",
    backfill: int = dims.BACKFILL_DAYS, overlap: int = dims.OVERLAP_DAYS,
) -> DataFrame:
    """Rows of the days to be read now: from the high-water mark or ``overlap`` days back, whichever is earlier, or ``backfill`` days
    back the first time.

    Days are read again because notices are also published late, under an older date; ``streaming.pull`` leaves out what it has.
    """
    start = min(last_end, today - timedelta(days=overlap)) if last_end else today - timedelta(days=backfill)
    return df.where(F.to_date(ts).between(F.lit(start), F.lit(today)))


def relevant_slug(slug: Column) -> Column:
    return contains_any(F.lower(slug), dims.RELEVANT_STEMS)


def assign_dates(candidates: Column, dates: Column) -> Column:
    """Candidate i gets date i modulo the number of dates; null when the page names none. The dates are read once, not once per candidate."""

    def given(found: Column) -> Column:
        n = F.size(found)
        return F.transform(
            candidates,
            lambda c, i: F.struct(
                c["slug"].alias("slug"), c["uid"].alias("uid"), i.alias("idx"),
                F.when(n > 0, F.try_element_at(found, (F.pmod(i, F.greatest(n, F.lit(1))) + 1).cast("int"))).alias("date"),
            ),
        )

    return bind(dates, given)


def notice_page_candidates(
    pages: DataFrame, publication: str, column: str = "html"
) -> DataFrame:
    """Notices linked from the pages of one newspaper, with their assumed dates.

    All work happens inside the page's own arrays: no shuffle.
    """
    pub = dims.PUBLICATIONS[publication]
    html = F.col(column)
    slugs = F.regexp_extract_all(html, F.lit(pub["link"]), F.lit(1))
    uids = F.regexp_extract_all(html, F.lit(pub["link"]), F.lit(2))
    links = F.arrays_zip(slugs.alias("slug"), uids.alias("uid"))
    df = pages.where(F.length(strip_html(html)) >= pub["min_chars"]) if pub["min_chars"] else pages
    df = df.withColumn("_links", links).withColumn("_uids", F.col("_links.uid"))
    first = F.filter("_links", lambda x, i: F.array_position(F.col("_uids"), x["uid"]) == i + 1)
    if publication == "watauga":
        first = F.filter(first, lambda x: relevant_slug(x["slug"]))
    dates = F.regexp_extract_all(html, F.lit(P.LONG_DATE), F.lit(0))
    keep = [c for c in pages.columns if c != column]
    return (
        df.select(*keep, F.inline(assign_dates(first, dates)))
        .withColumn("publication", F.lit(publication))
    )


def card_candidates(cards: DataFrame, href: str = "href", text: str = "card_text") -> DataFrame:
    """Notice cards: title, content and posted date from the card's lines, irrelevant ones dropped."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), strip), truthy)
    df = cards.withColumn("_lines", lines)
    df = df.withColumns(
        {
            "title": F.coalesce(F.try_element_at("_lines", F.lit(1)), F.lit("")),
            "content": F.array_join(rest(F.col("_lines")), " "),
            "posted": posted_date("_lines"),
        }
    ).drop("_lines")
    return relevant_notices(df).where(truthy(F.col(href)) & ~F.lower(href).contains("search"))


def relevant_notices(df: DataFrame, title: str = "title", content: str = "content") -> DataFrame:
    """Title names a notice and title or content name real property."""
    body = F.lower(F.concat_ws(" ", F.col(title), F.col(content)))
    # bound, as a filter would make the text anew for every word
    named = bind(F.upper(F.col(title)), lambda t: contains_any(t, dims.TITLE_WORDS))
    return df.where(named & bind(body, lambda b: contains_any(b, dims.RELEVANT_STEMS)))


def min_length(df: DataFrame, n: int, text: str = "text") -> DataFrame:
    """Pages shorter than that did not load."""
    return df.where(F.length(text) >= n)


def group_grid_rows(pages: DataFrame, state: str, column: str = "html") -> DataFrame:
    """Notices of a result grid: each key row together with the rows that follow it.

    A page is cut in front of its key rows, so the grouping needs neither a window nor
    a shuffle. Records repeat across pages; see ``unique_grid_records``.
    """
    keep = [c for c in pages.columns if c != column]
    rows = F.regexp_extract_all(F.col(column), F.lit(P.TABLE_ROW), F.lit(0))
    marked = F.transform(rows, lambda r: F.when(r.rlike(P.KEY_FIELD), F.concat(F.lit("\u0001"), r)).otherwise(r))
    # what stands before the first key row belongs to no notice
    groups = rest(F.split(F.array_join(marked, " "), "\u0001"))
    df = pages.select(*keep, F.posexplode(groups).alias("pos", "chunk"))
    key = F.regexp_extract("chunk", P.KEY_FIELD, 0)
    text = strip(F.regexp_replace(F.regexp_replace("chunk", "<[^>]+>", ""), r"(?U)\s+", " "))
    df = df.select(
        *keep, "pos",
        F.regexp_extract(key, P.VALUE_ATTRIBUTE, 1).alias("pk_id"),
        text.alias("text"),
        found(F.col("chunk"), P.DETAIL_LINK).alias("detail_url"),
    )
    return df.withColumns({"sp_case": sp_case("text", state), "county": grid_county("text", state)})


def unique_grid_records(records: DataFrame, order: list[str]) -> DataFrame:
    return keep_first(records, ["pk_id"], order)


def notice_details(pages: DataFrame, column: str = "html") -> DataFrame:
    """Parcel, deed, case and title of detail pages.

    A page whose text speaks of an error yields no references but keeps its title.
    """
    html = F.col(column)
    body = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1>", " ")
    df = pages.withColumn("raw_text", strip(F.regexp_replace(F.regexp_replace(body, r"<[^>]+>", " "), r"[ \t]+", " ")))
    ok = truthy(F.col("raw_text")) & ~F.lower("raw_text").rlike(P.FAILED_PAGE_WORDS)

    def heading(pattern: str) -> Column:
        return F.when(html.rlike(pattern), strip_html(F.regexp_extract(html, pattern, 1), collapse=True))

    heads = [
        heading(r"(?is)<h1\b[^>]*>(.*?)</h1>"),
        heading(r"(?is)<h2\b[^>]*>(.*?)</h2>"),
        heading(r"(?is)<[^>]+class=[\"'][^\"']*article-title[^\"']*[\"'][^>]*>(.*?)</"),
    ]
    page_title = F.substring_index(strip_html(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1), True), "|", 1)
    title = F.coalesce(empty_to_null(F.coalesce(*heads)), empty_to_null(strip(page_title)))
    return df.withColumns(
        {
            "pin": F.when(ok, pin("raw_text")),
            "deed_plat": F.when(ok, deed_plat("raw_text")),
            "court_case": F.when(ok, court_case("raw_text")),
            "title": title,
        }
    ).drop(column)


