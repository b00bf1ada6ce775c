"""What the findings of round 3 named."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from auctionlake import dims
from auctionlake.functions import patterns as P, text
from auctionlake.functions.base import first_found
from auctionlake.functions.parcel import words_overlap
from auctionlake.operators import enrich, upsert
from auctionlake.operators.sequence import change_events
from auctionlake.plans.catalog_text import parcels
from auctionlake.plans.views import TEXT_VIEWS, view
from auctionlake.llm import langid
from auctionlake.sources import feeds, notices


def chain(spark, rows, parts):
    df = spark.createDataFrame(rows, "entity string, ord long, auction_date string, price_cents long, upset_bid string").repartition(parts)
    out = change_events(df, ["entity"]).select("entity", "ord", "price_cents", "before.price_cents").collect()
    return sorted(tuple(r) for r in out)


def test_change_events_of_one_number(spark):
    """Sightings of one number, also at the ends of a block of numbers, are one chain whatever order they come in."""
    block = 1 << 21
    rows = [("a", n * block + 5, "d", price, "N") for n in range(3) for price in (30, 10, 20)]
    want, before = [], None
    for _, n, _, price, _ in sorted(rows):
        if before not in (None, price):
            want.append(("a", n, price, before))
        before = price
    assert chain(spark, rows, 1) == chain(spark, rows[::-1], 1) == chain(spark, rows, 5) == sorted(want)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_made_after_rows_are_dealt(spark):
    for name, (_, key) in TEXT_VIEWS.items():
        plan = plan_of(view(spark, "/root/testdata/sf0.001", name))
        dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "REPARTITION" in line]
        assert dealt and all(f"({key}#" in line for line in dealt), plan


def test_grid_rows_are_cut_once(spark):
    pages = spark.createDataFrame([(1, '<tr class="GridRow_WebBlue">' + "<td>x</td>" * 8 + "</tr>")], "tid int, html string")
    lines = plan_of(feeds.sales_grid_rows(pages)).splitlines()
    assert not [line for line in lines if "Filter" in line and "regexp_extract_all" in line]
    assert sum("regexp_extract_all" in line for line in lines) == 1


def test_wordings_are_tried_by_words_they_need(spark):
    """Other letters that ignoring case takes for i and s count, as the patterns alone do."""
    rows = [("Parcel İD: 123-45",), ("pın 1234-56 acres",), ("Date of ſale: ſep 3, 2026 containing 5 acres",), ("REİD 12345",), ("nothing",), (None,), ("On Mar 1, 2026 PLAT FILE",)]
    df = spark.createDataFrame(rows, "text string")
    plain = F.regexp_replace(first_found(F.col("text"), P.PIN), P.PIN_SEPARATORS, "-")
    assert df.where(~text.pin("text").eqNullSafe(plain)).count() == 0
    dated = F.coalesce(F.nullif(F.regexp_extract("text", P.DATE_OF_SALE, 3), F.lit("")), F.nullif(F.regexp_extract("text", P.ON_DATE, 3), F.lit("")))
    assert df.where(~F.substring_index(text.auction_date("text"), "-", 1).eqNullSafe(dated)).count() == 0
    assert P.PIN_NEEDS and len(P.PIN_NEEDS) == len(P.PIN)


def test_dates_of_a_page_are_read_once(spark):
    pages = spark.createDataFrame([(1, "Jan 5, 2026 and March 16 2026")], "page_id int, html string")
    five = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.struct(F.lit("s").alias("slug"), i.cast("string").alias("uid")))
    out = pages.select(F.inline(notices.assign_dates(five, F.regexp_extract_all("html", F.lit(P.LONG_DATE), F.lit(0)))))
    generate = next(line for line in plan_of(out).splitlines() if "Generate inline" in line)
    assert generate.count("regexp_extract_all") == 1
    assert [r["date"] for r in out.collect()] == ["Jan 5, 2026", "March 16 2026"] * 2 + ["Jan 5, 2026"]


def test_relevant_notices_make_their_text_once(spark):
    rows = spark.createDataFrame([("NOTICE", f"about {dims.RELEVANT_STEMS[0]} land"), ("Notice", "x"), (None, None)], "title string, content string").repartition(1)
    out = notices.relevant_notices(rows)
    assert plan_of(out).count("concat_ws") == 1
    assert out.count() == 1


def test_lowest_score_counts_every_row_kept_from_training(spark):
    """2,000 rows of the least hashes would leave low scores out; all rows count, a score by its step of a ten-thousandth."""
    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"lang": "en", "score": texts.astype(float)})

    scores = [k / 3000 for k in range(3000)]
    held = spark.createDataFrame([("en", str(x), k) for k, x in enumerate(scores)] + [("de", "0.0", 9000), (None, "0.0", 9001)], "lang string, text string, doc_id long")
    want = math.floor(scores[60] * 10_000) / 10_000
    assert langid.lowest_score(held, predict, lost=0.02) == pytest.approx(0.9 * want)
    assert langid.lowest_score(held.where("lang = 'de'"), predict) == 0.0


def test_parcels_are_dealt_before_they_are_copied(spark):
    lines = plan_of(enrich.parcel_keys(parcels(spark, "/root/testdata/sf0.001"))).splitlines()
    copied = next(k for k, line in enumerate(lines) if "Generate explode" in line)
    assert any("Exchange hashpartitioning(feature_id" in line for line in lines[copied:])


def test_rows_that_no_mark_names_stay_out_of_the_shuffle(spark):
    rows = spark.range(200_000).select((F.col("id") * 1048576 + 7).alias("ord"), F.lit("x").alias("wide"))
    marks = rows.where("ord % 4001 = 0").select("ord")
    met = upsert._possible(rows, marks)
    assert met.columns == rows.columns
    assert met.join(marks, "ord").count() == marks.count() > 40
    assert met.count() < 2 * marks.count()
    assert upsert._possible(rows, marks.limit(0)).count() == 0
    assert upsert._possible(rows.limit(3000), rows, words=4).count() == 3000


def test_overlap_of_sets_needs_no_union(spark):
    rng = random.Random(5)
    rows = [(rng.sample("abcdefg", rng.randint(0, 6)), rng.sample("abcdefg", rng.randint(0, 6))) for _ in range(400)]
    overlap = words_overlap(F.col("a"), F.col("b"))
    assert "union" not in str(overlap)
    for a, b, found in spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", overlap).collect():
        both = len({*a} & {*b})
        assert found == (both >= 2 and 2 * both > len({*a} | {*b}))
