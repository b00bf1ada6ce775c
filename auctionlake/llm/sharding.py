"""Uniform sharding by a hypergeometric communication matrix (operator 3)."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32, staged


def capacities(total: int, shards: int) -> np.ndarray:
    """Exact shard sizes, at most one row apart; the first shards take the odd rows."""
    return np.asarray([total // shards + (k < total % shards) for k in range(shards)], np.int64)


def split(counts: np.ndarray, taken: int, seed: tuple[int, ...]) -> np.ndarray:
    """How many of ``taken`` rows, drawn without replacement, go to each shard with room for ``counts``."""
    rng, out, left, rest = np.random.default_rng(seed), np.zeros_like(counts), int(taken), int(counts.sum())
    for k, n in enumerate(counts):
        rest -= int(n)
        out[k] = rng.hypergeometric(int(n), rest, left) if left and n else 0
        left -= int(out[k])
    return out


def matrix_row(ends: list[int], shards: int, seed: int, part: int) -> np.ndarray:
    """Row ``part`` of the communication matrix: rows that it sends to each shard.

    ``ends`` are running totals of rows per partition. Partitions are halved again and again; at each halving the shards'
    rows are divided between the halves by a multivariate hypergeometric draw seeded with the halving's place, so any
    task computes any row of the one matrix by itself, in log(partitions) draws.
    """
    low, high, counts = 0, len(ends), capacities(ends[-1], shards)
    before = lambda k: ends[k - 1] if k else 0
    while high - low > 1:
        mid = (low + high) // 2
        left = split(counts, before(mid) - before(low), (seed, low, high))
        low, high, counts = (low, mid, left) if part < mid else (mid, high, counts - left)
    return counts


def shard(docs: DataFrame, shards: int, seed: int = 0, slot_rows: int = 1_000_000, slot_bytes: int = 128 << 20) -> DataFrame:
    """All rows with ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... in each shard): a uniform random permutation
    dealt to shards whose row counts differ by one at most.

    Draw: each input partition learns how many of its rows every shard gets. Local permutation: each row takes its place in a
    random permutation of its partition, which any task draws from the partition's number and size; the first go to shard 0, and so
    on. Exchange and second permutation: whole rows go to their shard and are ordered by a fresh key, in slices of about ``slot_rows``
    rows or ``slot_bytes`` bytes of text so that no task holds a whole shard. The rows are first
    written with their partition and place, which later steps and lost executors then agree on. Only counts per
    partition reach the driver. Rows may hold nulls and repeat each other; columns ``shard`` and ``slot`` of the input
    are replaced; no rows give no rows.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = docs.sparkSession
    own = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    placed = staged(
        docs.select(F.struct(*own).alias("row"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")),
        "shard",
    )
    texts = [f.name for f in placed.schema["row"].dataType if f.dataType.typeName() in ("string", "binary")]
    wide = sum((F.coalesce(F.octet_length(F.col("row")[c]), F.lit(0)).cast("bigint") for c in texts), F.lit(16).cast("bigint"))
    found = placed.groupBy("part").agg(F.count("*").alias("n"), F.min("place").alias("first"), F.sum(wide).alias("bytes")).collect()
    sizes, firsts = {r["part"]: r["n"] for r in found}, {r["part"]: r["first"] for r in found}
    parts = sorted(sizes)
    ends = np.cumsum([sizes[p] for p in parts]).tolist()
    total = ends[-1] if ends else 0
    slices = max(1, -(-total // (shards * slot_rows)), -(-sum(r["bytes"] for r in found) // (shards * slot_bytes)))

    @F.pandas_udf("int")
    def pick(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        last, ranks, bounds = None, None, None
        for part, place in batches:
            out = np.empty(len(part), np.int32)
            for p in part.unique():
                if p != last:
                    last, ranks = p, np.random.default_rng((seed, 1, int(p))).permutation(sizes[p])
                    bounds = np.cumsum(matrix_row(ends, shards, seed, bisect_right(parts, int(p)) - 1))
                at = (part == p).to_numpy()
                out[at] = np.searchsorted(bounds, ranks[place[at].to_numpy() - firsts[p]], side="right")
            yield pd.Series(out)

    key = lambda k: F.xxhash64(F.lit(seed), F.lit(k), "place")
    slice_of = F.pmod(key("slice"), F.lit(slices)).cast("int").alias("slice")
    dealt = placed.select("row", "place", pick("part", "place").alias("shard"), slice_of)
    if slices > 1:
        held = placed.select(pick("part", "place").alias("shard"), slice_of).groupBy("shard", "slice").agg(F.count("*").alias("n"))
        before = Window.partitionBy("shard").orderBy("slice")
        first = held.select("shard", "slice", (F.sum("n").over(before) - F.col("n")).alias("first"))
        dealt = dealt.join(first, ["shard", "slice"])
    else:
        dealt = dealt.withColumn("first", F.lit(0))
    again = Window.partitionBy("shard", "slice").orderBy(key("slot"), "place")
    return dealt.withColumn("slot", (F.row_number().over(again) - 1 + F.col("first")).cast("bigint")).select("row.*", "shard", "slot")


def keyed(docs: DataFrame, *kept: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of rows: id, size (UTF-8 bytes plus 16) and checksum, and the columns ``kept``; a null text has no bytes."""
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("bigint").alias("size"),
        crc32(text).alias("text_crc32"), *kept,
    )
