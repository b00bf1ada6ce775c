"""The set-wise upsert against taking sightings one at a time."""

import hashlib
import random
from datetime import date

import pytest

from auctionlake.operators.upsert import _fold_routes, batch_outcome, routed, upsert
from auctionlake.schema import PROPERTY_COLUMNS, SIGHTING_COLUMNS, struct

TODAY = date(2026, 3, 1)
COMPARED = [
    "id", "source", "source_listing_id", "address", "price_cents", "acres", "description", "auction_date", "upset_bid", "parcel_number",
    "gis_url", "elevation_ft", "initial_auction_date", "upset_bid_end", "first_seen", "last_seen", "last_updated", "seen_count",
    "status", "court_case", "dedup_hash",
]


def hash_of(row):
    parts = [(row.get(c) or "").strip().lower() for c in ("address", "city", "county", "state")] + [(row.get("zip_code") or "").strip()]
    text = "|".join(parts)
    if row.get("latitude") is not None and row.get("longitude") is not None:
        text += f"|{row['latitude']:.6f},{row['longitude']:.6f}"
    return hashlib.sha256(text.encode()).hexdigest()


def one_by_one(current, batch):
    """Plain model: look a property up, change it or add it."""
    table = [dict(r) for r in sorted(current, key=lambda r: r["id"])]
    actions = {}
    for s in sorted(batch, key=lambda r: r["ord"]):
        h = hash_of(s)
        hit = None
        if s["source"] and s["source_listing_id"]:
            hit = next((r for r in table if (r["source"], r["source_listing_id"]) == (s["source"], s["source_listing_id"])), None)
        elif not s["source_listing_id"]:
            hit = next((r for r in table if r["dedup_hash"] == h), None)
        if hit is None:
            new = {c: None for c in PROPERTY_COLUMNS}
            new.update({c: s.get(c) for c in SIGHTING_COLUMNS})
            new.update(id=max([r["id"] for r in table], default=0) + 1, seen_count=1, status="active", dedup_hash=h,
                       first_seen=s.get("first_seen") or TODAY, last_seen=s.get("last_seen") or TODAY)
            table.append(new)
            actions[s["ord"]] = "new"
            continue
        actions[s["ord"]] = "duplicate"
        trim = lambda v: (v or "").strip()
        changed = (trim(s["auction_date"]) != trim(hit["auction_date"]) or (s["price_cents"] or 0) != (hit["price_cents"] or 0)
                   or trim(s["upset_bid"]) != trim(hit["upset_bid"]))
        hit["last_seen"] = s.get("last_seen") or TODAY
        hit["seen_count"] += 1
        if not trim(hit["manual_acres_set"]):
            hit["acres"] = s["acres"]
        for c in ("price_cents", "description", "auction_date", "close_date", "upset_bid", "foreclosure_key", "deed_book"):
            hit[c] = s.get(c)
        for c in ("parcel_number", "extracted_pin", "extracted_deed_plat", "court_case"):
            hit[c] = hit[c] or s.get(c) or hit[c]
        for c in ("google_maps_url", "google_maps_topo_url", "gis_url", "parcel_screenshot"):
            hit[c] = s.get(c) or hit[c]
        if s["elevation_ft"] is not None:
            hit["elevation_ft"] = s["elevation_ft"]
        if changed:
            hit["last_updated"] = TODAY
        for c in ("initial_auction_date", "upset_bid_end"):
            if s[c] is not None and (not trim(hit[c]) or trim(hit[c]) != trim(s[c])):
                hit[c] = s[c]
    return table, actions


def sighting(rng, ord_, universe):
    pick = rng.choice
    row = {c: None for c in SIGHTING_COLUMNS}
    row.update(
        ord=ord_ * 3 + (1 << 43) * (ord_ % 2), source=pick(["a", "b", "", None]) if rng.random() < 0.3 else "a",
        source_listing_id=pick([None, "", *[f"L{i}" for i in range(universe)]]), address=f"{rng.randrange(universe)} Oak ",
        latitude=pick([None, None, 35.25]), longitude=pick([None, -82.5]), price_cents=pick([None, 0, 100, 200]),
        acres=pick([None, 1.5, 3.0]), description=pick([None, "d1", "d2"]), auction_date=pick([None, "", "x", " x"]),
        upset_bid=pick([None, "u", "v"]), parcel_number=pick([None, "", "p1", "p2"]), gis_url=pick([None, "", "g1", "g2"]),
        elevation_ft=pick([None, 1.0, 2.0]), initial_auction_date=pick([None, "", " ", "i", " i", "i ", "j"]),
        upset_bid_end=pick([None, "e", " e", "f"]), court_case=pick([None, "c"]), last_seen=pick([None, date(2026, 2, 2)]),
    )
    return row


def stored_row(rng, ident, universe):
    row = {c: None for c in PROPERTY_COLUMNS}
    row.update({k: v for k, v in sighting(rng, 1, universe).items() if k in PROPERTY_COLUMNS})
    row.update(id=ident, seen_count=rng.randrange(1, 4), status=rng.choice(["active", "archived"]), first_seen=date(2026, 1, 1),
               last_seen=date(2026, 1, 2), manual_acres_set=rng.choice([None, "", " ", "set"]))
    row["dedup_hash"] = hash_of(row)
    return row


def frames(spark, current, batch):
    schema = struct(SIGHTING_COLUMNS).add("ord", "long")
    b = spark.createDataFrame([tuple(r[c] for c in schema.names) for r in batch], schema)
    c = spark.createDataFrame([tuple(r[c] for c in PROPERTY_COLUMNS) for r in current], struct(PROPERTY_COLUMNS))
    return c, b


def check(spark, current, batch):
    c, b = frames(spark, current, batch)
    want, actions = one_by_one(current, batch)
    got = upsert(c, b, TODAY)
    rows = {r["id"]: r for r in got.snapshot.collect()}
    assert sorted(rows) == sorted(r["id"] for r in want)
    for w in want:
        g = rows[w["id"]]
        assert {k: g[k] for k in COMPARED} == {k: w[k] for k in COMPARED}
    assert {r["ord"]: r["action"] for r in got.actions.collect()} == actions
    new = sum(a == "new" for a in actions.values())
    counts = (len(actions), new, len(actions) - new)
    assert tuple(got.counts.first()) == counts
    assert tuple(batch_outcome(got.actions).first()) == counts
    return got


@pytest.mark.parametrize("seed", range(4))
def test_random_batches(spark, seed):
    rng = random.Random(seed)
    universe = rng.choice([2, 5, 12])
    current = [stored_row(rng, i + 1, universe) for i in range(rng.choice([0, 4, 15]))]
    check(spark, current, [sighting(rng, i, universe) for i in range(150)])


def test_flow(spark):
    """New, updated, locked by hand, archived: the lock keeps its acreage and the archive its status."""
    base = {c: None for c in SIGHTING_COLUMNS}
    first = {**base, "ord": 1, "source": "s", "source_listing_id": "1", "price_cents": 100, "acres": 5.0, "gis_url": "g"}
    table = [r.asDict() for r in check(spark, [], [first]).snapshot.collect()]
    assert table[0]["id"] == 1 and table[0]["last_updated"] is None
    table[0].update(manual_acres_set="2026", acres=7.5, status="archived")
    again = {**first, "ord": 2, "price_cents": 200, "acres": 9.0, "gis_url": None}
    row = check(spark, table, [again]).snapshot.first()
    assert (row["acres"], row["price_cents"], row["gis_url"], row["status"]) == (7.5, 200, "g", "archived")
    assert row["last_updated"] == TODAY and row["seen_count"] == 2


def test_hot_property(spark):
    """A third of all sightings belong to one property, and all hash rows to one address."""
    base = {c: None for c in SIGHTING_COLUMNS}
    batch = [
        {**base, "ord": i, "source": "s", "source_listing_id": None if i % 3 == 1 else ("hot" if i % 3 == 0 else f"L{i}"),
         "address": "1 Main", "price_cents": i, "initial_auction_date": " x" if i % 2 else "x"} for i in range(600)
    ]
    check(spark, [], batch)


def test_fold_is_hash_aggregated_over_narrow_rows(spark):
    """No sort before the first shuffle, and none of the wide texts in it."""
    _, batch = frames(spark, [], [sighting(random.Random(1), i, 5) for i in range(20)])
    text = _fold_routes(routed(batch))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in text and text.count("HashAggregate") == 2
    assert "raw_source_text" not in text.split("HashAggregate")[1]
