"""The stored table under repeated and interrupted batches."""

import os
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from auctionlake.operators.upsert import upsert
from auctionlake.schema import SIGHTING_COLUMNS, struct
from auctionlake.shared import new_folder
from auctionlake.streaming import pull, stream
from auctionlake.streaming.store import read_table, snapshots, stored, write_changes, write_table

TODAY = date(2026, 3, 1)


def batch(spark, *rows):
    schema = struct(SIGHTING_COLUMNS).add("ord", "long")
    full = [{**{c: None for c in SIGHTING_COLUMNS}, "source": "s", **r} for r in rows]
    return spark.createDataFrame([tuple(r[c] for c in schema.names) for r in full], schema)


def test_fresh_checkpoint_keeps_the_table(spark):
    landing, root = new_folder(spark, "in"), new_folder(spark, "table")
    for k, name in enumerate(("a", "b", "z")):
        own = f"{landing}/{k}"
        batch(spark, {"ord": k, "source_listing_id": name}).write.parquet(own)
        rows = stream.stream_files(spark, own, struct(SIGHTING_COLUMNS).add("ord", "long"))
        stream.stream_upsert(rows, root, new_folder(spark, "mark"), today=TODAY).awaitTermination()
    got = {r["source_listing_id"]: r["id"] for r in read_table(spark, root).collect()}
    assert sorted(got) == ["a", "b", "z"] and len(set(got.values())) == 3


def test_interrupted_and_crossing_snapshots(spark, tmp_path):
    root = str(tmp_path / "table")
    assert read_table(spark, root).count() == 0
    table = upsert(read_table(spark, root), batch(spark, {"ord": 1, "source_listing_id": "a"}), TODAY).snapshot
    for k in range(5):
        write_table(table, root, "w", k)
    assert [v for v, _, _ in snapshots(spark, root)] == [2, 3, 4]
    os.makedirs(f"{root}/v000000000005-w-9")  # no success marker
    assert read_table(spark, root).count() == 1
    table.write.parquet(f"{root}/v000000000005-x-0")
    write_table(table, root, "w", 6)
    assert snapshots(spark, root)[-1] == (6, "w", 6)


def test_late_notices_come_once(spark):
    landing, out, mark = (new_folder(spark, n) for n in ("in", "out", "mark"))
    for ids in (["n1", "n2"], ["n2", "n3", None], ["n1", "n0", "n0"]):
        spark.createDataFrame([(i,) for i in ids], "id string").coalesce(1).write.mode("append").parquet(landing)
        rows = stream.stream_files(spark, landing, spark.read.parquet(landing).schema, files_per_batch=1)
        stream.stream_notices(rows, out, mark).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["n0", "n1", "n2", "n3"]


def test_stream_resumes(spark):
    landing, root, mark = (new_folder(spark, n) for n in ("in", "table", "mark"))
    for i in range(2):
        batch(spark, {"ord": i, "source_listing_id": "a", "price_cents": i}).write.mode("append").parquet(landing)
        rows = stream.stream_files(spark, landing, struct(SIGHTING_COLUMNS).add("ord", "long"))
        for _ in range(2):
            stream.stream_upsert(rows, root, mark, today=TODAY).awaitTermination()
    assert read_table(spark, root).first()["seen_count"] == 2


def notices(spark, *rows):
    return spark.createDataFrame([(i, date.fromisoformat(d)) for i, d in rows], "id string, date_start date")


def test_pull_reads_late_notices_and_survives_a_failed_run(spark):
    root = new_folder(spark, "pulls")
    first = notices(spark, ("a", "2026-01-01"), ("b", "2026-02-27"), ("old", "2025-06-01"), (None, "2026-02-27"), ("b", "2026-02-27"))
    assert pull.pulled(spark, root) is None and pull.last_mark(spark, root) == (-1, None)
    assert pull.pull(first, root, TODAY) == 0 and pull.last_mark(spark, root) == (0, TODAY)
    late = first.union(notices(spark, ("late", "2026-02-25"), ("c", "2026-03-02"), ("gone", "2026-02-01")))
    broken = late.withColumn("date_start", F.when(F.col("id") == "c", F.raise_error(F.lit("cut off")).cast("date")).otherwise(F.col("date_start")))
    with pytest.raises(Exception, match="cut off"):
        pull.pull(broken, root, date(2026, 3, 3))
    late.write.mode("overwrite").parquet(f"{root}/rows/run=1")  # rows stored, the mark not
    assert pull.last_mark(spark, root) == (0, TODAY) and sorted(r.id for r in pull.pulled(spark, root).collect()) == ["a", "b"]
    assert pull.pull(late, root, date(2026, 3, 3)) == 1
    got = {r.id: r.run for r in pull.pulled(spark, root).collect()}
    assert got == {"a": 0, "b": 0, "late": 1, "c": 1}
    # After a long pause the window starts at the mark, not a week back.
    assert pull.pull(notices(spark, ("d", "2026-03-04"), ("e", "2026-04-30")), root, date(2026, 5, 1)) == 2
    assert pull.pulled(spark, root).where("run = 2").count() == 2


BIDS = [  # day, amount, accepted
    (0, 10_000, True), (2, 10_700, False), (3, 10_750, True), (12.9, 11_400, False), (12.95, 11_500, True), (14, 20_000, True),
    (15, 20_900, False), (23, 21_000, True), (33, 100, True), (60, 100, True),
]


def test_bids_under_the_least_raise_do_not_restart_the_clock(spark):
    start = datetime(2026, 1, 1)
    at = lambda day: start + timedelta(days=day)
    rows = [("x", at(d), float(a)) for d, a, _ in BIDS] + [("y", at(1), 5.0), ("y", at(9), 700.0), ("y", at(10.5), 5.0), ("y", None, 1.0), ("y", at(2), None)]
    want = {
        ("x", at(0), at(33), 5, 3, 21_000.0), ("x", at(33), at(43), 1, 0, 100.0), ("x", at(60), at(70), 1, 0, 100.0),
        ("y", at(1), at(11), 1, 2, 5.0),
    }
    shape = "listing_id string, ts timestamp, amount double"
    assert {tuple(r) for r in stream.bid_clock(spark.createDataFrame(rows, shape)).collect()} == want
    landing, out, mark = (new_folder(spark, n) for n in ("bids", "periods", "mark"))
    order = [r for r in rows if r[1]]
    batches = [order[1:5:2], order[0:5:2], order[5:], [("z", at(200), 1.0)], [("z", at(201), 1.0)]]  # bids also come before earlier ones
    for part in batches:
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(landing)
        bids = stream.stream_files(spark, landing, spark.read.parquet(landing).schema)
        stream.write_stream(stream.bid_clock(bids), out, mark).awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == want


def test_batches_write_what_they_touch_and_are_known_ever_after(spark, tmp_path):
    root = str(tmp_path / "table")
    many = upsert(read_table(spark, root), batch(spark, *[{"ord": k, "source_listing_id": f"L{k}", "description": "x" * 500} for k in range(300)]), TODAY).snapshot
    write_table(many, root, "first", 7)
    for k in range(3):
        one = upsert(read_table(spark, root), batch(spark, {"ord": k, "source_listing_id": "L5", "price_cents": k}, {"ord": 50 + k, "source_listing_id": f"new{k}"}), TODAY)
        write_changes(one.changes, root, "w", k, every=2)
    deltas = [d for d in os.listdir(root) if d.startswith("d")]
    assert len(deltas) == 3 and len(snapshots(spark, root)) == 5
    assert [spark.read.parquet(f"{root}/{d}").count() for d in deltas] == [2, 2, 2]
    table = read_table(spark, root)
    row = table.where("source_listing_id = 'L5'").first()
    assert table.count() == 303 == table.select("id").distinct().count() and (row["seen_count"], row["price_cents"]) == (4, 2)
    for k in range(4):
        write_table(read_table(spark, root), root, "other", k)
    assert "v000000000000-first-7" not in os.listdir(root)
    assert stored(spark, root, "first", 7) and stored(spark, root, "w", 2) and not stored(spark, root, "w", 3) and not stored(spark, root, "x", 0)
