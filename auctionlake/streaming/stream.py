"""Structured Streaming: incremental notices, continuous upsert, bid clock."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from auctionlake.functions.base import truthy
from auctionlake.operators.upsert import upsert
from auctionlake.streaming.store import read_table, stored, write_changes


def stream_files(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", glob: str | None = None,
                 files_per_batch: int = 1000) -> DataFrame:
    """Files as they land. The checkpoint remembers which were read, and only after success."""
    reader = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def writer_of(spark: SparkSession, checkpoint: str) -> str:
    """The id that Structured Streaming gave the query of a checkpoint: a fresh checkpoint is another writer."""
    return spark.read.json(f"{checkpoint}/metadata").first()["id"].replace("-", "")


def stream_notices(hits: DataFrame, path: str, checkpoint: str, ident: str = "id", trigger: dict | None = None) -> StreamingQuery:
    """Append each notice once to the table under ``path``, however late it comes.

    A batch leaves out the ids that other batches have written; run again, it replaces its own rows.
    """
    shape = hits.schema

    def fresh(batch: DataFrame, batch_id: int) -> None:
        spark, writer = batch.sparkSession, writer_of(batch.sparkSession, checkpoint)
        rows = batch.where(truthy(F.col(ident).cast("string"))).dropDuplicates([ident])
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            known = spark.read.schema(f"`{ident}` {shape[ident].dataType.simpleString()}, writer string, batch bigint").parquet(path)
            rows = rows.join(known.where(~((F.col("writer") == writer) & (F.col("batch") == batch_id))).select(ident), ident, "left_anti")
        rows.select(*shape.names).write.mode("overwrite").parquet(f"{path}/writer={writer}/batch={batch_id}")

    return start(hits.writeStream.foreachBatch(fresh).option("checkpointLocation", checkpoint), trigger)


def start(writer, trigger: dict | None) -> StreamingQuery:
    """All that has landed and then stop, unless a trigger such as ``processingTime`` is given."""
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def write_stream(sdf: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    writer = sdf.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return start(writer.outputMode("append"), trigger)


def stream_upsert(
    sightings: DataFrame, root: str, checkpoint: str, order: str = "ord", trigger: dict | None = None,
    today: date | None = None,
) -> StreamingQuery:
    """Fold arriving sightings into the property table under ``root``.

    Every micro-batch folds into the newest version and stores the rows it created or touched, unless the store already holds that
    batch, so a batch that runs twice has the effect of one and writes in proportion to itself.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        writer = writer_of(spark, checkpoint)
        if not stored(spark, root, writer, batch_id):
            write_changes(upsert(read_table(spark, root), batch, today or date.today(), order).changes, root, writer, batch_id)

    writer = sightings.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return start(writer, trigger)


def run_every(minutes: int = 360) -> dict:
    """Trigger of a job that polls; a failed run is retried by the cluster's restart policy."""
    return {"processingTime": f"{minutes} minutes"}


PERIOD = "struct<first_bid:timestamp,last_bid:timestamp,amount:double,bids:bigint,rejected:bigint>"


def bid_periods(bids: Column, gap: str, percent: float, least_raise: float) -> Column:
    """Upset-bid periods of one listing's bids (array of (ts, amount), any order), as an array of ``PERIOD``.

    A bid counts if it raises the last accepted one by ``percent`` and by ``least_raise`` at least, and then restarts the clock. One that
    comes when the clock has run out opens a new period, whatever its amount.
    """
    length = F.expr(f"interval {gap}")

    def take(periods: Column, bid: Column) -> Column:
        last = F.try_element_at(periods, F.lit(-1))
        opened = F.struct(
            bid["ts"].alias("first_bid"), bid["ts"].alias("last_bid"), bid["amount"].alias("amount"),
            F.lit(1).cast("bigint").alias("bids"), F.lit(0).cast("bigint").alias("rejected"),
        ).cast(PERIOD)
        high = F.coalesce(last["amount"], F.lit(0.0))
        counts = F.coalesce(bid["amount"] >= high + F.greatest(high * (percent / 100), F.lit(float(least_raise))), F.lit(False))
        raised = F.struct(
            last["first_bid"].alias("first_bid"), F.when(counts, bid["ts"]).otherwise(last["last_bid"]).alias("last_bid"),
            F.when(counts, bid["amount"]).otherwise(last["amount"]).alias("amount"),
            (last["bids"] + counts.cast("bigint")).alias("bids"), (last["rejected"] + (~counts).cast("bigint")).alias("rejected"),
        ).cast(PERIOD)
        before = F.slice(periods, F.lit(1), F.greatest(F.size(periods) - 1, F.lit(0)))
        new = F.coalesce(bid["ts"] >= last["last_bid"] + length, F.lit(True))
        return F.when(new, F.concat(periods, F.array(opened))).otherwise(F.concat(before, F.array(raised))).cast(f"array<{PERIOD}>")

    return F.aggregate(F.array_sort(bids), F.array().cast(f"array<{PERIOD}>"), take)


def bid_clock(
    bids: DataFrame, ts: str = "ts", keys: tuple[str, ...] = ("listing_id",), gap: str = "10 days", amount: str = "amount",
    percent: float = 5, least_raise: float = 750,
) -> DataFrame:
    """Upset-bid periods: each accepted bid restarts the clock; the period ends when it runs out.

    A bid must raise the last accepted one by 5% and by $750 at least; others are counted as rejected and change nothing. Follows the
    written rule rather than any code. Bids without a gap between them are gathered first, by session windows in which every bid
    restarts the clock: no period spans two of these, and as a stream they close by the watermark, so bids may come late and in
    any order. Inside one, the few bids of a listing are taken in order (ties: lower amount first). Bids without a time or an amount are
    left out.
    """
    moment, value = F.col(ts).cast("timestamp"), F.col(amount).cast("double")
    given = bids.select(*keys, moment.alias("_ts"), value.alias("_amount")).where("_ts is not null and _amount is not null")
    near = given.withWatermark("_ts", gap).groupBy(*keys, F.session_window("_ts", gap).alias("w"))
    taken = near.agg(F.collect_list(F.struct(F.col("_ts").alias("ts"), F.col("_amount").alias("amount"))).alias("taken"))
    periods = taken.select(*keys, F.explode(bid_periods(F.col("taken"), gap, percent, least_raise)).alias("p"))
    return periods.select(
        *keys, F.col("p.first_bid").alias("first_bid"), (F.col("p.last_bid") + F.expr(f"interval {gap}")).alias("closes"),
        F.col("p.bids").alias("bids"), F.col("p.rejected").alias("rejected"), F.col("p.amount").alias("high_bid"),
    )
