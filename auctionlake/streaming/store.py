"""Property table as whole snapshots and the changes after them; the newest complete version is the table.

A folder is named after its kind (``v`` whole, ``d`` changes), its version, which the store counts up, and the writer and its batch.
Changes hold only the rows that a batch created or touched, so a batch writes in proportion to itself; after some of them a whole
snapshot follows. Spark's success marker makes a version complete, so an interrupted one is never read. Beside it, written before, stands the last
batch of every writer: a batch that runs again, however much later, finds itself stored. One writer at a time: two that meet in
a version raise an error.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auctionlake.schema import PROPERTY_COLUMNS, struct, with_columns_of

NAME = re.compile(r"([vd])(\d+)-(.+)-(\d+)")


def _folder(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _versions(spark: SparkSession, root: str) -> list[tuple[int, str, str, int]]:
    """(version, kind, writer, batch) of all complete versions, oldest first; none only where the root does not exist."""
    store, target = _folder(spark, root)
    if not store.exists(target):
        return []
    names = [(NAME.fullmatch(s.getPath().getName()), s.getPath()) for s in store.listStatus(target)]
    done = [m for m, path in names if m and store.exists(_folder(spark, f"{path}/_SUCCESS")[1])]
    return sorted((int(m[2]), m[1], m[3], int(m[4])) for m in done)


def snapshots(spark: SparkSession, root: str) -> list[tuple[int, str, int]]:
    """(version, writer, batch) of all complete versions, oldest first."""
    return [(v, w, b) for v, _, w, b in _versions(spark, root)]


def _path(root: str, version: int, kind: str, writer: str, batch: int) -> str:
    return f"{root}/{kind}{version:012d}-{writer}-{batch}"


def read_table(spark: SparkSession, root: str) -> DataFrame:
    """The newest whole snapshot with the changes after it; empty only when nothing was ever stored."""
    known = _versions(spark, root)
    if not known:
        return spark.createDataFrame([], struct(PROPERTY_COLUMNS))
    whole = max((k for k, v in enumerate(known) if v[1] == "v"), default=None)
    read = lambda at: with_columns_of(spark.read.parquet(_path(root, *at)), PROPERTY_COLUMNS)
    base = read(known[whole]) if whole is not None else spark.createDataFrame([], struct(PROPERTY_COLUMNS))
    later = known[0 if whole is None else whole + 1:]
    if not later:
        return base
    changes = None
    for at in later:
        own = read(at).withColumn("_version", F.lit(at[0]).cast("bigint"))
        changes = own if changes is None else changes.unionByName(own)
    newest = changes.groupBy("id").agg(F.max("_version").alias("_version"))
    return base.join(newest, "id", "left_anti").unionByName(changes.join(newest, ["id", "_version"], "left_semi").drop("_version"))


def _writers(spark: SparkSession, root: str) -> dict[str, int]:
    """The last stored batch of each writer."""
    known = _versions(spark, root)
    if not known:
        return {}
    own = {}
    for _, _, writer, batch in known:
        own[writer] = max(batch, own.get(writer, -1))
    store, record = _folder(spark, f"{root}/_writers/{_path('', *known[-1])[1:]}")
    if store.exists(record):
        told = json.loads("".join(r["value"] for r in spark.read.text(record.toString()).collect()))
        own = {w: max(told.get(w, -1), own.get(w, -1)) for w in {*told, *own}}
    return own


def stored(spark: SparkSession, root: str, writer: str, batch: int) -> bool:
    """Whether this batch of this writer is in the table, however many versions ago."""
    return _writers(spark, root).get(writer, -1) >= batch


def _store(rows: DataFrame, root: str, kind: str, writer: str, batch: int) -> None:
    spark = rows.sparkSession
    known = _versions(spark, root)
    version = known[-1][0] + 1 if known else 0
    path = _path(root, version, kind, writer, batch)
    record = json.dumps({**_writers(spark, root), writer: batch})
    store, target = _folder(spark, f"{root}/_writers/{path.rsplit('/', 1)[1]}")
    out = store.create(target, True)
    out.write(bytearray(record.encode()))
    out.close()
    with_columns_of(rows, PROPERTY_COLUMNS).write.mode("overwrite").parquet(path)
    if sum(v[0] == version for v in _versions(spark, root)) > 1:
        raise RuntimeError(f"two writers stored version {version} of {root}")


def write_table(table: DataFrame, root: str, writer: str, batch: int, keep: int = 3) -> None:
    """Store a whole snapshot after the newest version and remove what only snapshots before the last ``keep`` need. Those who still read
    such a one must ask for more to be kept."""
    spark = table.sparkSession
    _store(table, root, "v", writer, batch)
    known = _versions(spark, root)
    whole = [v[0] for v in known if v[1] == "v"]
    for old in known:
        if len(whole) > keep and old[0] < whole[-keep]:
            for path in (_path(root, *old), f"{root}/_writers/{_path('', *old)[1:]}"):
                store, target = _folder(spark, path)
                store.delete(target, True)


def write_changes(changes: DataFrame, root: str, writer: str, batch: int, keep: int = 3, every: int = 12) -> None:
    """Store the rows that a batch created or touched; after ``every`` of these also a whole snapshot, under the same batch."""
    spark = changes.sparkSession
    _store(changes, root, "d", writer, batch)
    kinds = [v[1] for v in _versions(spark, root)]
    if "v" not in kinds[-every:] and len(kinds) >= every:
        write_table(read_table(spark, root), root, writer, batch, keep)
