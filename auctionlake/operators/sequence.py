"""Operators that depend on the order of rows, laid out so that no task sees an unbounded group.

A window over a hot key would put all rows of that key into one task. Here the order
column is cut into levels of bounded fan-out (for a long: the upper, middle and lower 21
bits), windows run inside one level at a time, and the levels are stitched by joins on
their far smaller summaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auctionlake.shared import stage

BITS = 21


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order.

    Spark keeps one row per key and partition before it shuffles (WindowGroupLimit), so
    hot keys do not gather.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def long_levels(name: str, ascending: bool = True, bits: int = 63) -> list[tuple[str, Column, bool]]:
    """Levels of a non-negative unique long below 2^bits, each of at most two million children."""
    c = F.col(name)
    levels = [(f"_{name}_lo", c, ascending), (f"_{name}_mid", F.shiftright(c, BITS), ascending)]
    if bits > 2 * BITS:
        levels.append((f"_{name}_hi", F.shiftright(c, 2 * BITS), ascending))
    return levels[::-1]


def in_ranges(df: DataFrame, by: Column) -> DataFrame:
    """The rows dealt to tasks by ranges of a column and stored so, with the number ``_range`` of each; ranges ascend in ``by``'s order."""
    return stage(df.repartitionByRange(by).withColumn("_range", F.spark_partition_id()), "ranges")


def _link_ranges(df: DataFrame, name: str, ascending: bool, first: str, last: str) -> DataFrame:
    """``_link`` over the whole table by one unique column: windows run inside ranges of it, and the first and last row of each range,
    as many as there are tasks, are stitched on the driver."""
    rows = in_ranges(df, F.col(name).asc() if ascending else F.col(name).desc())
    front, back = (F.min_by, F.max_by) if ascending else (F.max_by, F.min_by)
    ends = sorted(rows.groupBy("_range").agg(front(first, name).alias("f"), back(last, name).alias("l")).collect())
    kind = f"struct<_range:int,_gprev:{rows.schema[last].dataType.simpleString()},_gnext:{rows.schema[first].dataType.simpleString()}>"
    stitched = [(r["_range"], ends[k - 1]["l"] if k else None, ends[k + 1]["f"] if k + 1 < len(ends) else None) for k, r in enumerate(ends)]
    outside = df.sparkSession.createDataFrame(stitched, kind)
    w = Window.partitionBy("_range").orderBy(F.col(name).asc() if ascending else F.col(name).desc())
    linked = rows.withColumns({"_prev": F.lag(last).over(w), "_next": F.lead(first).over(w)}).join(outside, "_range", "left")
    return linked.withColumns({"_prev": F.coalesce("_prev", "_gprev"), "_next": F.coalesce("_next", "_gnext")}).drop("_gprev", "_gnext", "_range")


def running_before(df: DataFrame, name: str, value: str, out: str) -> DataFrame:
    """Each row with the sum of ``value`` over all rows before it in the order of the unique column ``name``: sums run inside ranges, whose
    totals, as many as there are tasks, are added up on the driver."""
    rows = in_ranges(df, F.col(name).asc_nulls_first())
    before, totals = 0, []
    for r in sorted(rows.groupBy("_range").agg(F.sum(value).alias("n")).collect()):
        totals.append((r["_range"], before))
        before += r["n"] or 0
    offsets = df.sparkSession.createDataFrame(totals, "_range int, _offset bigint")
    w = Window.partitionBy("_range").orderBy(F.col(name).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_inside", F.coalesce(F.sum(value).over(w), F.lit(0))).join(offsets, "_range").withColumn(
        out, F.col("_inside") + F.col("_offset")
    ).drop("_inside", "_offset", "_range")


def _link(df: DataFrame, part: list[str], levels: list[tuple[str, bool]], first: str, last: str) -> DataFrame:
    """Adds ``_prev`` (last payload before the row) and ``_next`` (first payload after it)."""
    outer, (inner, ascending) = levels[:-1], levels[-1]
    group = part + [n for n, _ in outer]
    by = F.col(inner).asc() if ascending else F.col(inner).desc()
    w = Window.partitionBy(*group).orderBy(by)
    if not group:
        return _link_ranges(df, inner, ascending, first, last)
    linked = df.withColumns({"_prev": F.lag(last).over(w), "_next": F.lead(first).over(w)})
    if not outer:
        return linked
    front, back = (F.min_by, F.max_by) if ascending else (F.max_by, F.min_by)
    groups = df.groupBy(*group).agg(front(first, inner).alias("_gf"), back(last, inner).alias("_gl"))
    groups = _link(groups, part, outer, "_gf", "_gl").select(
        *group, F.col("_prev").alias("_gprev"), F.col("_next").alias("_gnext")
    )
    return linked.join(groups, group, "left").withColumns(
        {"_prev": F.coalesce("_prev", "_gprev"), "_next": F.coalesce("_next", "_gnext")}
    ).drop("_gprev", "_gnext")


def neighbours(
    df: DataFrame, part: list[str], levels: list[tuple[str, Column, bool]], payload: Column,
    previous: str = "previous", following: str = "next",
) -> DataFrame:
    """Each row with the payloads of the rows right before and right after it.

    ``levels`` are (name, expression, ascending) from coarse to fine; together they must
    order the rows of a partition totally and hold no nulls.
    """
    names = [n for n, _, _ in levels]
    staged = df.withColumns({**{n: e for n, e, _ in levels}, "_pay": payload})
    out = _link(staged, part, [(n, a) for n, _, a in levels], "_pay", "_pay")
    return out.withColumnsRenamed({"_prev": previous, "_next": following}).drop("_pay", *names)


def dense_index(df: DataFrame, name: str, out: str = "index") -> DataFrame:
    """1-based rank of a unique non-negative long over the whole table, without a global sort."""
    hi, mid = f"_{name}_hi", f"_{name}_mid"
    c = F.col(name)
    staged = df.withColumns({hi: F.shiftright(c, 2 * BITS), mid: F.shiftright(c, BITS)})
    mids = staged.groupBy(hi, mid).agg(F.count(F.lit(1)).alias("_n"))
    before = (Window.unboundedPreceding, -1)
    tops = mids.groupBy(hi).agg(F.sum("_n").alias("_n"))
    tops = tops.select(hi, F.coalesce(F.sum("_n").over(Window.orderBy(hi).rowsBetween(*before)), F.lit(0)).alias("_top"))
    inside = F.sum("_n").over(Window.partitionBy(hi).orderBy(mid).rowsBetween(*before))
    mids = mids.select(hi, mid, F.coalesce(inside, F.lit(0)).alias("_before")).join(tops, hi)
    mids = mids.select(hi, mid, (F.col("_before") + F.col("_top")).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy(hi, mid).orderBy(name))
    return (
        staged.withColumn("_inner", rank)
        .join(mids, [hi, mid])
        .withColumn(out, F.col("_inner") + F.col("_offset"))
        .drop(hi, mid, "_inner", "_offset")
    )


def change_events(
    sightings: DataFrame, keys: list[str], order: str = "ord",
    tracked: tuple[str, ...] = ("auction_date", "price_cents", "upset_bid"),
) -> DataFrame:
    """Sightings whose sale details differ from the sighting before, null and blank text taken alike. Sightings of one number follow in
    the order of their details, in a block of numbers as at its ends, so that each is compared with the one row before it."""
    details = []
    for c, t in sightings.select(*tracked).dtypes:
        details.append((F.coalesce(F.btrim(c), F.lit("")) if t == "string" else F.coalesce(c, F.lit(0))).alias(c))
    *coarse, (name, number, ascending) = long_levels(order)
    levels = [*coarse, (name, F.struct(number, *details), ascending)]
    df = neighbours(sightings, keys, levels, F.struct(*details), "_before", "_after")
    now = F.struct(*details)
    return df.where(F.col("_before").isNotNull() & (F.col("_before") != now)).withColumnsRenamed(
        {"_before": "before"}
    ).drop("_after")
