"""Listing feeds: API arrays, HTML grids and calendars.

Every reader pairs a file scan (one row per landed file) with a parser that works on
any DataFrame holding the text, so the same job reads files, tables or streams.
A landed file is one page, response or calendar; files are the unit of parallelism.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auctionlake.functions import patterns as P
from auctionlake.functions.base import strip

LISTING_VALUE = (
    "struct<county:string,address:string,parcel:string,saledatetime:string,openingbid:string,currentbid:string,"
    "closedate:string,propertytype:string,courtfile:string,___id___:string>"
)

SALES_GRID_COLUMNS = ("case_no", "sp_no", "county_raw", "sale_date_raw", "address_raw", "csz_raw", "deed_raw", "bid_raw")
TAX_GRID_COLUMNS = ("tax_office", "parcel", "status", "sale_date_raw", "upset_deadline", "opening_bid", "current_bid")


def read_texts(spark: SparkSession, path: str, column: str = "content") -> DataFrame:
    """One row per file with its whole text and name."""
    return spark.read.text(path, wholetext=True).select(
        F.col("value").alias(column), F.col("_metadata.file_path").alias("file")
    )


def listing_records(files: DataFrame, column: str = "content") -> DataFrame:
    """Array elements of each response whose ``value`` is an object; other elements are passed over."""
    elements = F.from_json(F.col(column), "array<string>")
    record = F.from_json(F.col("element"), "struct<value:string>")
    keep = [c for c in files.columns if c != column]
    return (
        files.select(*keep, F.posexplode(elements).alias("pos", "element"))
        .withColumn("value", record["value"])
        .where(F.col("value").startswith("{"))
        .select(*keep, "pos", F.from_json("value", LISTING_VALUE).alias("v"))
        .select(*keep, "pos", "v.*")
    )


def read_listing_json(spark: SparkSession, path: str) -> DataFrame:
    return listing_records(read_texts(spark, path))


def sales_grid_rows(pages: DataFrame, column: str = "html") -> DataFrame:
    """Grid rows of exactly eight cells, as eight raw string columns."""
    keep = [c for c in pages.columns if c != column]
    rows = F.regexp_extract_all(F.col(column), F.lit(P.GRID_ROW), F.lit(1))
    cut = F.transform(rows, lambda r, i: F.struct(i.alias("pos"), F.regexp_extract_all(r, F.lit(P.TABLE_CELL), F.lit(1)).alias("cells")))
    # chosen inside the page's array: a filter on rows would be moved below and cut every row again
    cells = pages.select(*keep, F.inline(F.filter(cut, lambda r: F.size(r["cells"]) == len(SALES_GRID_COLUMNS))))
    return cells.select(*keep, "pos", *[F.col("cells")[i].alias(n) for i, n in enumerate(SALES_GRID_COLUMNS)])


def read_sales_grid(spark: SparkSession, path: str) -> DataFrame:
    return sales_grid_rows(read_texts(spark, path, "html"), "html")


def tax_grid_rows(rows: DataFrame, cells: str = "cells") -> DataFrame:
    """Seven named values and the address from cell arrays.

    The two last cells are no values; the very last one holds the address, behind a
    warning sign. Rows of fewer than nine cells are not listings.
    """
    c = F.col(cells)
    keep = [x for x in rows.columns if x != cells]
    values = F.slice(c, F.lit(1), F.greatest(F.size(c) - 2, F.lit(0)))
    address = F.regexp_replace(strip(F.try_element_at(c, F.lit(-1))), "^⚠️\\s*", "")
    return rows.where((F.size(c) >= 5) & (F.size(values) >= 7)).select(
        *keep,
        *[strip(values[i]).alias(n) for i, n in enumerate(TAX_GRID_COLUMNS)],
        strip(address).alias("address_raw"),
    )


def read_tax_grid(spark: SparkSession, path: str) -> DataFrame:
    """Landed grids: each file an array of rows, a row an array of cell texts."""
    rows = F.from_json("content", "array<array<string>>")
    return tax_grid_rows(read_texts(spark, path).select("file", F.posexplode(rows).alias("pos", "cells")))


def ical_events(files: DataFrame, column: str = "content") -> DataFrame:
    """One row per VEVENT block, continuation lines unfolded."""
    keep = [c for c in files.columns if c != column]
    text = F.regexp_replace(F.col(column), r"\r?\n[ \t]", "")
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)BEGIN:VEVENT(.*?)END:VEVENT"), F.lit(1))
    return files.select(*keep, F.posexplode(blocks).alias("pos", "block"))


def read_ical(spark: SparkSession, path: str) -> DataFrame:
    return ical_events(read_texts(spark, path))
