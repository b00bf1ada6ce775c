"""Repeated pulls of notices by date, with a stored high-water mark and an overlap.

Under ``root``, ``rows/run=N`` holds what run N added and ``marks/run=N`` the last day it read. The mark is written after the rows and
makes the run count: a run that failed before has no mark, its rows are not read, and the next run replaces them.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auctionlake import dims
from auctionlake.functions.base import truthy
from auctionlake.sources.notices import incremental_window


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def marks(spark: SparkSession, root: str) -> DataFrame:
    """(run, last_end) of the runs that were finished."""
    shape = "last_end date, run bigint"
    return spark.read.schema(shape).parquet(f"{root}/marks") if _exists(spark, f"{root}/marks") else spark.createDataFrame([], shape)


def last_mark(spark: SparkSession, root: str) -> tuple[int, date | None]:
    """The number and the last day of the newest finished run; (-1, None) before the first."""
    top = marks(spark, root).select(F.max(F.struct("run", "last_end")).alias("m")).first()["m"]
    return (top["run"], top["last_end"]) if top else (-1, None)


def pulled(spark: SparkSession, root: str) -> DataFrame | None:
    """All rows of the finished runs, with the run that brought them; None before the first."""
    run, _ = last_mark(spark, root)
    return spark.read.parquet(f"{root}/rows").where(F.col("run") <= run) if run >= 0 else None


def pull(
    hits: DataFrame, root: str, today: date, ident: str = "id", ts: str = "date_start",
    backfill: int = dims.BACKFILL_DAYS, overlap: int = dims.OVERLAP_DAYS,
) -> int:
    """Store the notices of the present window that no finished run has, then the mark; returns the number of the run.

    The window starts at the mark or ``overlap`` days back, whichever is earlier, and ``backfill`` days back the first time, so that
    notices published late under an older date are met. Rows without an id are left out; of rows that share an id one is kept.
    """
    spark = hits.sparkSession
    run, end = last_mark(spark, root)
    window = incremental_window(hits, end, today, ts, backfill, overlap)
    fresh = window.where(truthy(F.col(ident).cast("string"))).dropDuplicates([ident])
    known = pulled(spark, root)
    if known is not None:
        fresh = fresh.join(known.select(ident), ident, "left_anti").select(*hits.columns)
    fresh.write.mode("overwrite").parquet(f"{root}/rows/run={run + 1}")
    last = max(today, end) if end else today
    spark.range(1).select(F.lit(last).alias("last_end")).coalesce(1).write.mode("overwrite").parquet(f"{root}/marks/run={run + 1}")
    return run + 1
