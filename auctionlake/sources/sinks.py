"""Where tables are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auctionlake.operators.report import active
from auctionlake.schema import PROPERTY_COLUMNS, RUN_COLUMNS, with_columns_of


def export_rows(df: DataFrame, limit: int | None = None) -> DataFrame:
    """All active listings (or the first ``limit``) as handed out: price in dollars, no internal hash."""
    price = F.when(F.col("price_cents") != 0, F.round(F.col("price_cents") / 100, 2))
    return active(df, limit).drop("dedup_hash").withColumn("price", F.coalesce(price, F.lit(0.0)))


def export_json(df: DataFrame, path: str, limit: int | None = None) -> None:
    """JSON lines of all rows, sorted and split over many files."""
    export_rows(df, limit).write.mode("overwrite").json(path)


def write_snapshot(df: DataFrame, path: str) -> None:
    """Whole property table, split by status so that reports on active rows skip the archive."""
    with_columns_of(df, PROPERTY_COLUMNS).write.mode("overwrite").partitionBy("status").parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return with_columns_of(spark.read.parquet(path), PROPERTY_COLUMNS)


def append_runs(runs: DataFrame, path: str) -> None:
    """Run log. A run is appended when it starts and again when it ends; see ``read_runs``."""
    with_columns_of(runs, RUN_COLUMNS).write.mode("append").parquet(path)


def has_runs(spark: SparkSession, path: str) -> bool:
    """Whether any run was logged."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row per run, the finished entry before the started one."""
    log = with_columns_of(spark.read.parquet(path), RUN_COLUMNS)
    row = F.struct(*RUN_COLUMNS)
    return log.groupBy("id").agg(F.max_by(row, F.struct(F.col("finished_at").isNotNull(), F.coalesce("finished_at", "started_at"))).alias("r")).select("r.*")
