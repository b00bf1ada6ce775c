"""Reading, staging and word splitting shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auctionlake.shared import new_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: What separates words, as a regular expression; bytes.split() splits at the same six characters.
BLANKS = r"[\x20\x09-\x0D]+"


_tables: list = []


def kept_in_worker(most: int) -> Callable:
    """Marks a function whose ``most`` last results a Python worker keeps from task to task, until ``make_room`` lets them go."""

    def mark(make: Callable) -> Callable:
        kept = lru_cache(maxsize=most)(make)
        _tables.append(kept)
        return kept

    return mark


def make_room(*needed: Callable) -> None:
    """Let go of what this Python worker keeps from tasks of other operators: Spark hands the same workers from stage to stage."""
    for kept in _tables:
        if kept not in needed:
            kept.cache_clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32(text: Column) -> Column:
    """Unsigned crc32 of the UTF-8 bytes; of no bytes where the text is null."""
    return F.crc32(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def text_key(ident: Column, text: Column) -> Column:
    """128 bits of a row's id and whole text, as text: what tells rows apart where ids are null or repeat. Null differs from empty."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))
    return F.substring(F.sha2(F.concat(part(ident), F.lit("\n"), part(text)), 256), 1, 32)


def bounded_batches(spark: SparkSession, most: str = "8m") -> None:
    """Arrow batches of this session hold ``most`` bytes at most, so that whole texts fit in small executors; a lower limit stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = lambda text: spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(str(text))
    now = spark.conf.get(name, "64m")
    if size(now) <= 0 or size(now) > size(most):
        spark.conf.set(name, most)


def fold(text: Column) -> Column:
    """Letters A-Z in lower case, all others as they are."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text as an array: runs of anything but ASCII blanks, A-Z lower-cased; null text has none."""
    split = F.split(fold(F.coalesce(text.cast("string"), F.lit(""))), BLANKS)
    return F.filter(split, lambda w: w != "")


def write(df: DataFrame, name: str, codec: str = "zstd") -> str:
    """Write rows to a new shared folder and return its path."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return path


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The rows as a table in the shared folder, computed once: a lost executor costs a re-read only."""
    return df.sparkSession.read.schema(df.schema).parquet(write(df, name, codec))


def drop(spark: SparkSession, path: str) -> None:
    """Remove a staged folder that no later step reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
