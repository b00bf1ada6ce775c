"""Changes to the property and run tables, each a function from table to table."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auctionlake.functions.base import truthy
from auctionlake.schema import RUN_COLUMNS, with_columns_of


def below_acres(df: DataFrame, min_acres: float, sources: list[str] | None = None):
    """Predicate: active, acreage known and positive but below ``min_acres``, in the sources if given."""
    hit = (F.col("status") == "active") & (F.col("acres") > 0) & (F.col("acres") < min_acres)
    if sources:
        hit = hit & F.col("source").isin(*sources)
    return F.coalesce(hit, F.lit(False))


def archive_below(
    df: DataFrame, min_acres: float, today: date, sources: list[str] | None = None
) -> DataFrame:
    """Small properties archived as of today. Count them beforehand with ``below_acres``."""
    hit = below_acres(df, min_acres, sources)
    return df.withColumns(
        {
            "status": F.when(hit, "archived").otherwise(F.col("status")),
            "last_seen": F.when(hit, F.lit(today)).otherwise(F.col("last_seen")),
        }
    )


def apply_commands(df: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new table, rejected commands).

    A command is (ord, id, kind, value, at): ``archive``, ``unarchive``, ``notes`` with a text, or
    ``acres`` with a number. Commands apply in order. Acreage can be set by hand once only:
    later settings are rejected, as are commands on unknown ids and settings without a number.
    """
    acres = F.col("value").try_cast("double")
    c = commands.withColumn("_acres", acres)
    sets = (F.col("kind") == "acres") & F.col("_acres").isNotNull()
    status = F.when(F.col("kind").isin("archive", "unarchive"), F.col("ord"))
    folded = c.groupBy("id").agg(
        F.max_by("kind", status).alias("_status"),
        F.max_by(F.struct(F.coalesce("value", F.lit("")).alias("v")), F.when(F.col("kind") == "notes", F.col("ord"))).alias("_notes"),
        F.min_by(F.struct("_acres", "at", "ord"), F.when(sets, F.col("ord"))).alias("_set"),
    )
    open_ = ~truthy(F.col("manual_acres_set"))
    one = F.col("_set").isNotNull() & open_
    table = df.join(folded, "id", "left")
    out = table.withColumns(
        {
            "status": F.when(F.col("_status") == "archive", "archived").when(F.col("_status") == "unarchive", "active")
            .otherwise(F.col("status")),
            "notes": F.when(F.col("_notes").isNotNull(), F.col("_notes.v")).otherwise(F.col("notes")),
            "acres": F.when(one, F.col("_set._acres")).otherwise(F.col("acres")),
            "manual_acres_override": F.when(one, F.col("_set._acres")).otherwise(F.col("manual_acres_override")),
            "manual_acres_set": F.when(one, F.col("_set.at").cast("string")).otherwise(F.col("manual_acres_set")),
        }
    ).select(*df.columns)
    known = df.select("id", open_.alias("_open"))
    checked = c.join(folded.select("id", F.col("_set.ord").alias("_first")), "id").join(known, "id", "left")
    is_acres = F.col("kind") == "acres"
    late = is_acres & (~F.col("_open") | (F.coalesce(F.col("ord") > F.col("_first"), F.lit(False))))
    reason = (
        F.when(F.col("_open").isNull(), "not found")
        .when(late, "already set")
        .when(is_acres & F.col("_acres").isNull(), "missing value")
    )
    rejected = checked.withColumn("reason", reason).where("reason is not null").select(*commands.columns, "reason")
    return out, rejected


def start_run(runs: DataFrame, source: str, ts: datetime, run_id: int) -> DataFrame:
    """Run table with one more running row."""
    row = runs.sparkSession.createDataFrame([(run_id, source, ts, "running")], "id long, source string, started_at timestamp, status string")
    zero = {c: F.lit(0) for c in ("properties_found", "properties_new", "properties_duplicate", "properties_updated")}
    return with_columns_of(runs, RUN_COLUMNS).unionByName(with_columns_of(row.withColumns(zero), RUN_COLUMNS))


def finish_run(
    runs: DataFrame, run_id: int, outcome: DataFrame, ts: datetime, status: str = "completed", error: str | None = None
) -> DataFrame:
    """Run table with the row closed; ``outcome`` is the one-row found/new/duplicate table of a batch."""
    hit = F.col("id") == run_id

    def count(c: str):
        return outcome.select(F.max(c).cast("int")).scalar()

    new = {
        "finished_at": F.lit(ts).cast("timestamp"),
        "properties_found": F.coalesce(count("found"), F.lit(0)),
        "properties_new": F.coalesce(count("new"), F.lit(0)),
        "properties_duplicate": F.coalesce(count("duplicate"), F.lit(0)),
        "status": F.lit(status),
        "error_message": F.lit(error).cast("string"),
    }
    return runs.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()})
