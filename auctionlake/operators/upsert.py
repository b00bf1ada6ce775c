"""Folding a batch of sightings into the property table.

Sightings are meant to be taken one by one in arrival order ``ord`` (a unique,
non-negative long), later ones seeing what earlier ones left. Done set-wise:

1. Every sighting has a route: its natural key (source, listing id), or its address hash
   when it has no listing id, or itself when it has a listing id but no source.
2. Sightings are folded per route by mergeable aggregates: last values are the maximum of
   (ord, values), first filled values the minimum, changes show as minimum <> maximum.
   Spark combines them before the shuffle, so a hot property costs one row per task.
3. Routes, far fewer than sightings, are resolved to an existing property or to the
   sighting that creates one, and the partial folds meeting in one property are merged.
4. The outcome is joined to the table on its id: unique on both sides, so without skew.

The batch is shuffled once and read a second time only for per-sighting actions. ``upsert`` runs
the folding when it is called and leaves the writing of its results to the caller.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionlake.functions.base import BLANKS, filled, truthy
from auctionlake.functions.keys import dedup_hash
from auctionlake.operators.sequence import dense_index
from auctionlake.schema import PROPERTY_COLUMNS, SIGHTING_COLUMNS, with_columns_of
from auctionlake.shared import stage

# Rules by column; everything else keeps the value it was created with.
LAST = (
    "price_cents", "description", "auction_date", "close_date", "upset_bid", "foreclosure_key", "deed_book", "acres",
)
FIRST_FILLED = ("parcel_number", "extracted_pin", "extracted_deed_plat", "court_case")
LAST_FILLED = ("google_maps_url", "google_maps_topo_url", "gis_url", "parcel_screenshot")
LAST_KNOWN = ("elevation_ft",)
LAST_SPELLED = ("initial_auction_date", "upset_bid_end")
BASE = tuple(
    c for c in SIGHTING_COLUMNS if c not in LAST + FIRST_FILLED + LAST_FILLED + LAST_KNOWN + LAST_SPELLED + ("last_seen",)
)
ROUTE = ("_kind", "_a", "_b")


@dataclass
class UpsertResult:
    """``snapshot``: the whole new table; ``changes``: its created and touched rows; ``actions``: one
    row per sighting; ``counts``: found, new, duplicate."""

    snapshot: DataFrame
    changes: DataFrame
    actions: DataFrame
    counts: DataFrame


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def _prints(*values: Column) -> list[Column]:
    """Two independent 64-bit hashes, which a hash aggregate can keep where it cannot keep texts."""
    return [F.xxhash64(*values), F.xxhash64(F.lit("second"), *values)]


def _sale_prints() -> list[Column]:
    """What counts as a change of the sale, null and blank taken alike."""
    text = lambda c: F.coalesce(_trim(F.col(c)), F.lit(""))
    return _prints(text("auction_date"), F.coalesce(F.col("price_cents"), F.lit(0).cast("long")), text("upset_bid"))


def routed(batch: DataFrame, order: str = "ord") -> DataFrame:
    """Batch with ``ord``, ``dedup_hash`` and its route."""
    keep = {"ord": batch.schema[order].dataType, **SIGHTING_COLUMNS}
    df = with_columns_of(batch.withColumnRenamed(order, "ord"), keep)
    df = df.withColumn("dedup_hash", dedup_hash())
    lid, source = truthy(F.col("source_listing_id")), truthy(F.col("source"))
    kind = F.when(~lid, "hash").when(source, "key").otherwise("self")
    return df.withColumns(
        {
            "_kind": kind,
            "_a": F.when(kind == "hash", F.col("dedup_hash")).when(kind == "key", F.col("source"))
            .otherwise(F.col("ord").cast("string")),
            "_b": F.when(kind == "key", F.col("source_listing_id")).otherwise(""),
        }
    )


def _fold_routes(rows: DataFrame) -> DataFrame:
    """Mergeable state per route, of numbers only: which sighting comes first, last, first filled and so on, and hashes that tell
    whether values differ. Spark hash-aggregates it before the shuffle and never reads the wide columns for it."""
    ord_ = F.col("ord")
    aggs = [F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.count(F.lit(1)).alias("n")]
    for k, value in enumerate(_sale_prints()):
        aggs += [F.min(value).alias(f"low_{k}"), F.max(value).alias(f"high_{k}")]
    aggs += [F.min(F.when(truthy(F.col(c)), ord_)).alias(f"ff_{c}") for c in FIRST_FILLED]
    aggs += [F.max(F.when(truthy(F.col(c)), ord_)).alias(f"lf_{c}") for c in LAST_FILLED]
    aggs += [F.max(F.when(F.col(c).isNotNull(), ord_)).alias(f"lk_{c}") for c in LAST_KNOWN]
    for c in LAST_SPELLED:
        v = F.col(c)
        aggs.append(F.max(F.when(v.isNotNull(), ord_)).alias(f"ls_{c}"))
        for k, value in enumerate(_prints(_trim(v))):
            aggs += [F.min(F.when(v.isNotNull(), value)).alias(f"lo{k}_{c}"), F.max(F.when(v.isNotNull(), value)).alias(f"hi{k}_{c}")]
        aggs.append(F.max(F.coalesce((v != _trim(v)).cast("int"), F.lit(0))).alias(f"pad_{c}"))
    return rows.groupBy(*ROUTE).agg(*aggs)


def _possible(rows: DataFrame, marks: DataFrame, words: int = 1 << 17) -> DataFrame:
    """The rows whose ``ord`` is among those of ``marks``, and some others: all that share a bit of a map of ``words`` longs with one.

    The map is broadcast (2 MB at most, whatever the input), so rows that no mark names are left out before rows and marks are shuffled
    to meet. Nothing is lost; the more marks, the more rows pass.
    """
    bit = F.pmod(F.xxhash64("ord"), F.lit(words * 64))
    at = {"_word": F.shiftright(bit, 6), "_flag": F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % 64).cast("int"))}
    listed = marks.select("ord").withColumns(at).groupBy("_word").agg(F.bit_or("_flag").alias("_bits"))
    met = rows.withColumns(at).join(F.broadcast(listed), "_word")
    return met.where(F.col("_bits").bitwiseAND(F.col("_flag")) != 0).select(*rows.columns)


def _merge_folds(states: DataFrame) -> DataFrame:
    """The same state per property, from the states of its routes."""
    least = ("first_ord", "low_", "ff_", "lo0_", "lo1_")
    how = {c: F.min if c.startswith(least) else F.sum if c == "n" else F.max for c in states.columns if c not in (*ROUTE, "pid", "made_hash")}
    return states.groupBy("pid").agg(*[f(c).alias(c) for c, f in how.items()])


def _resolve(states: DataFrame, current: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds ``match_id`` (existing property) or ``created_ord`` (sighting that creates the property), and
    ``pid``, one number for either."""
    keyed = truthy(F.col("source")) & truthy(F.col("source_listing_id"))
    ways = F.array(
        F.struct(F.when(keyed, "key").alias("_kind"), F.col("source").alias("_a"), F.col("source_listing_id").alias("_b")),
        F.struct(F.lit("hash").alias("_kind"), F.col("dedup_hash").alias("_a"), F.lit("").alias("_b")),
    )
    # The table meets the staged routes first, so a small batch is broadcast and the table is not shuffled.
    stored = current.select("id", F.inline(ways)).where("_kind is not null and _a is not null")
    known = stored.join(states.select(*ROUTE), list(ROUTE)).groupBy(*ROUTE).agg(F.min("id").alias("match_id"))
    routes, states = states, states.join(known, list(ROUTE), "left")
    # A hash route may meet a property that a keyed sighting of the same batch created before it.
    hashes = states.where("_kind = 'hash'").select(F.col("_a").alias("dedup_hash"))
    firsts = _possible(rows.where("_kind <> 'hash'"), routes.where("_kind <> 'hash'").select(F.col("first_ord").alias("ord")))
    shared = firsts.select("ord", "dedup_hash").join(hashes, "dedup_hash", "left_semi")
    made = (
        states.where("_kind <> 'hash' and match_id is null").select(F.col("first_ord").alias("ord")).join(shared, "ord")
        .groupBy(F.col("dedup_hash").alias("_a"))
        .agg(F.min("ord").alias("made_ord"))
        .withColumn("_kind", F.lit("hash"))
    )
    created = F.when(F.col("match_id").isNull(), F.least("first_ord", "made_ord"))
    states = states.join(made, ["_kind", "_a"], "left").withColumn("created_ord", created).drop("made_ord")
    return states.withColumn("pid", F.coalesce("match_id", -1 - F.col("created_ord")))


def route_matches(batch: DataFrame, current: DataFrame, today: date, order: str = "ord") -> DataFrame:
    """Natural keys and address hashes of a batch: sightings, and the property each one meets or creates."""
    rows = routed(batch, order)
    folds = stage(rows.groupBy(*ROUTE).agg(F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("n")), "routes")
    states = _resolve(folds, with_columns_of(current, PROPERTY_COLUMNS), rows)
    first = rows.select(F.col("ord").alias("first_ord"), "source", "address")
    return states.join(first, "first_ord").select(
        F.col("_kind").alias("route"), "source", F.col("_b").alias("source_listing_id"), "address",
        F.col("n").alias("sightings"), "match_id", "created_ord",
    )


def _spelled_ord(rows: DataFrame, states: DataFrame, folds: DataFrame, c: str, salts: int = 32) -> DataFrame:
    """(pid, spelled ord) of properties met with padded values: the first sighting in the final run of values that are equal but
    for padding; of blank values the last one.

    The end of the run before is found on one row per route and distinct value. Only then do sightings meet their property's number,
    spread over ``salts`` so that a property with a third of all sightings is not gathered in one task, and leave as minima.
    """
    routes = states.select(*ROUTE, "pid").join(folds.where(f"pad_{c} = 1").select("pid", F.col(f"ls_{c}").alias("end_ord")), "pid")
    value = F.struct(*[p.alias(f"p{k}") for k, p in enumerate(_prints(_trim(F.col(c))))])
    filled_in = rows.where(F.col(c).isNotNull())
    distinct = filled_in.withColumn("v", value).groupBy(*ROUTE, "v").agg(F.max("ord").alias("ord")).join(routes, list(ROUTE))
    ends = distinct.where("ord = end_ord").select("pid", F.col("v").alias("end"))
    stops = distinct.join(ends, "pid").groupBy("pid").agg(F.max(F.when(F.col("v") != F.col("end"), F.col("ord"))).alias("stop"))
    wanted = routes.join(stops, "pid").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = filled_in.select(*ROUTE, "ord", (_trim(F.col(c)) == "").alias("blank"), F.pmod(F.xxhash64("ord"), F.lit(salts)).cast("int").alias("_salt"))
    run = salted.join(wanted, [*ROUTE, "_salt"]).where(F.col("stop").isNull() | (F.col("ord") > F.col("stop")))
    blank = F.max(F.col("blank").cast("int")) == 1
    return run.groupBy("pid").agg(F.when(blank, F.max("ord")).otherwise(F.min("ord")).alias(f"sp_{c}"))


def _winners(rows: DataFrame, folds: DataFrame, today: date) -> DataFrame:
    """(pid, seen): the few sightings whose values a property keeps, at most one per rule. The batch's wide columns meet only these."""
    made = F.col("match_id").isNull()
    kept = [F.when(made, F.col("first_ord")).alias("k_first"), F.col("last_ord").alias("k_last")]
    kept += [F.col(c).alias(f"k_{c}") for c in folds.columns if c.startswith(("ff_", "lf_", "lk_", "sp_"))]
    marks = folds.select("pid", *kept)
    names = [c for c in marks.columns if c != "pid"]
    each = marks.select("pid", F.explode(F.array_distinct(F.array_compact(F.array(*names)))).alias("ord"), *names)
    of = lambda *marks_: F.coalesce(reduce(lambda a, b: a | b, [F.col("ord").eqNullSafe(F.col(f"k_{m}")) for m in marks_]), F.lit(False))
    uses = {c: ["first"] for c in (*BASE, "dedup_hash")} | {c: ["last"] for c in (*LAST, "last_seen")}
    uses |= {c: [f"ff_{c}", "first"] for c in FIRST_FILLED} | {c: [f"lf_{c}", "first"] for c in LAST_FILLED}
    uses |= {c: [f"lk_{c}"] for c in LAST_KNOWN} | {c: [f"sp_{c}"] for c in LAST_SPELLED}
    wide = rows.select("ord", *[c for c in uses if c != "last_seen"], F.coalesce("last_seen", F.lit(today)).alias("last_seen"))
    met = each.join(_possible(wide, each), "ord").select("pid", F.struct("ord", *[F.when(of(*m), F.col(c)).alias(c) for c, m in uses.items()]).alias("s"))
    return met.groupBy("pid").agg(F.collect_list("s").alias("seen"))


def _at(mark: str, c: str) -> Column:
    """Value of the sighting that a fold names; null if it names none."""
    return F.get(F.filter("seen", lambda s: s["ord"] == F.col(mark)), F.lit(0))[c]


def fold_batch(batch: DataFrame, current: DataFrame, today: date, order: str = "ord") -> DataFrame:
    """One row per touched property: match_id or created_ord, and the folded state with the values it keeps.

    The folds of the routes, and then of the properties, are staged as tables: all results of an upsert read them. Only date texts
    seen with blanks around them need a further look at the batch; without padding equal values have one spelling.
    """
    rows = routed(batch, order)
    routes = stage(_fold_routes(rows), "routes")
    padded = routes.agg(*[F.max(f"pad_{c}").alias(c) for c in LAST_SPELLED]).first()
    states = stage(_resolve(routes, current, rows), "states")
    merged = _merge_folds(states)
    folds = merged
    for c in LAST_SPELLED:
        last = F.col(f"ls_{c}")
        if padded[c]:
            folds = folds.join(_spelled_ord(rows, states, merged, c), "pid", "left")
            last = F.coalesce(f"sp_{c}", last)
        folds = folds.withColumn(f"sp_{c}", last)
    folds = stage(folds, "marks")
    full = folds.join(_winners(rows, folds, today), "pid")
    made = F.col("match_id").isNull()
    base = F.when(made, F.struct(*[_at("first_ord", c).alias(c) for c in (*BASE, "dedup_hash")], *[_at("first_ord", c).alias(f"was_{c}") for c in FIRST_FILLED + LAST_FILLED]))
    last = F.struct(*[_at("last_ord", c).alias(c) for c in (*LAST, "last_seen")])
    values = [_at(f"{m}_{c}", c).alias(f"{m}_{c}") for m, cs in (("ff", FIRST_FILLED), ("lf", LAST_FILLED), ("lk", LAST_KNOWN)) for c in cs]
    values += [_at(f"sp_{c}", c).alias(f"spelled_{c}") for c in LAST_SPELLED]
    plain = [c for c in folds.columns if c.startswith(("pid", "match_id", "created_ord", "n", "low_", "high_", "lo0_", "lo1_", "hi0_", "hi1_"))]
    return stage(full.select(*plain, base.alias("base"), last.alias("last"), *values), "folds")


def _created(folds: DataFrame, today: date, current: DataFrame) -> DataFrame:
    new = dense_index(folds.where("match_id is null"), "created_ord", "_rank")
    base, last = F.col("base"), F.col("last")
    top = F.coalesce(current.agg(F.max("id")).scalar(), F.lit(0).cast("long"))
    out = {
        "id": top + F.col("_rank"),
        **{c: base[c] for c in BASE},
        **{c: last[c] for c in LAST},
        **{c: F.coalesce(F.col(f"ff_{c}"), base[f"was_{c}"]) for c in FIRST_FILLED},
        **{c: F.coalesce(F.col(f"lf_{c}"), base[f"was_{c}"]) for c in LAST_FILLED},
        **{c: F.col(f"lk_{c}") for c in LAST_KNOWN},
        **{c: F.col(f"spelled_{c}") for c in LAST_SPELLED},
        "first_seen": F.coalesce(base["first_seen"], F.lit(today)),
        "last_seen": last["last_seen"],
        "last_updated": F.when(_differs(), F.lit(today)),
        "seen_count": F.col("n").cast("int"),
        "dedup_hash": base["dedup_hash"],
        "status": F.lit("active"),
    }
    return with_columns_of(new.select(*[v.alias(k) for k, v in out.items()]), PROPERTY_COLUMNS)


def _differs(prefix: str = "") -> Column:
    """Whether the folded sightings told of more than one state of the sale."""
    unlike = [F.col(f"{prefix}low_{k}") != F.col(f"{prefix}high_{k}") for k in (0, 1)]
    return unlike[0] | unlike[1]


def _touched(current: DataFrame, folds: DataFrame, today: date, how: str) -> DataFrame:
    """Current rows with the batch folded in; rows the batch does not meet pass through when ``how`` is left."""
    hits = folds.where("match_id is not null").drop("pid", "created_ord", "base")
    hits = hits.withColumnsRenamed({c: f"_f_{c}" for c in hits.columns})
    df = current.join(hits, F.col("id") == F.col("_f_match_id"), how)
    hit = F.col("_f_match_id").isNotNull()
    last = F.col("_f_last")
    out: dict[str, Column] = {c: F.when(hit, last[c]).otherwise(F.col(c)) for c in LAST}
    out["acres"] = F.when(hit & ~filled(F.col("manual_acres_set")), last["acres"]).otherwise(F.col("acres"))
    for c in FIRST_FILLED:
        out[c] = F.when(truthy(F.col(c)), F.col(c)).otherwise(F.coalesce(F.col(f"_f_ff_{c}"), F.col(c)))
    for c in LAST_FILLED:
        out[c] = F.coalesce(F.col(f"_f_lf_{c}"), F.col(c))
    for c in LAST_KNOWN:
        out[c] = F.coalesce(F.col(f"_f_lk_{c}"), F.col(c))
    for c in LAST_SPELLED:
        stored = zip(_prints(_trim(F.col(c))), ("0", "1"), strict=True)
        same = [(F.col(f"_f_lo{k}_{c}") == F.col(f"_f_hi{k}_{c}")) & (F.col(f"_f_lo{k}_{c}") == p) for p, k in stored]
        same = F.coalesce(same[0] & same[1] & (_trim(F.col(c)) != ""), F.lit(False))
        out[c] = F.when(F.col(f"_f_lo0_{c}").isNull() | same, F.col(c)).otherwise(F.col(f"_f_spelled_{c}"))
    before = [F.col(f"_f_low_{k}") != p for k, p in enumerate(_sale_prints())]
    changed = hit & (_differs("_f_") | before[0] | before[1])
    out["last_seen"] = F.when(hit, last["last_seen"]).otherwise(F.col("last_seen"))
    out["last_updated"] = F.when(changed, F.lit(today)).otherwise(F.col("last_updated"))
    out["seen_count"] = F.when(hit, F.col("seen_count") + F.col("_f_n")).otherwise(F.col("seen_count")).cast("int")
    return df.select(*[out.get(c, F.col(c)).alias(c) for c in PROPERTY_COLUMNS])


def batch_actions(batch: DataFrame, folds: DataFrame, order: str = "ord") -> DataFrame:
    """(ord, action): ``new`` for the sighting that created a property, else ``duplicate``."""
    created = folds.where("match_id is null").select(F.col("created_ord").alias("ord"), F.lit(True).alias("_new"))
    return batch.select(F.col(order).alias("ord")).join(created, "ord", "left").select(
        "ord", F.when(F.col("_new"), "new").otherwise("duplicate").alias("action")
    )


def outcome_counts(folds: DataFrame) -> DataFrame:
    """found, new and duplicate sightings of a batch, from its folds alone."""
    found, new = F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("match_id").isNull())
    return folds.select("n", "match_id").agg(
        found.cast("long").alias("found"), new.alias("new"), (found - new).cast("long").alias("duplicate")
    )


def upsert(current: DataFrame, batch: DataFrame, today: date, order: str = "ord") -> UpsertResult:
    current = with_columns_of(current, PROPERTY_COLUMNS)
    folds = fold_batch(batch, current, today, order)
    created = _created(folds, today, current)
    return UpsertResult(
        snapshot=_touched(current, folds, today, "left").unionByName(created),
        changes=_touched(current, folds, today, "inner").unionByName(created),
        actions=batch_actions(batch, folds, order),
        counts=outcome_counts(folds),
    )


def batch_outcome(actions: DataFrame) -> DataFrame:
    """found, new and duplicate sightings, from their actions."""
    return actions.agg(
        F.count(F.lit(1)).alias("found"),
        F.count_if(F.col("action") == "new").alias("new"),
        F.count_if(F.col("action") == "duplicate").alias("duplicate"),
    )
