"""Matching listings to parcels, and writing the matches back.

Each lookup is one equi-join per index, never an OR or a LIKE join: the ways a listing may
find its parcel become rows of (rank, key), and the parcels' side is reduced to one row per
key first, so neither hot keys nor popular addresses multiply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionlake import dims
from auctionlake.functions.base import blank_to_null, filled, strip, truthy
from auctionlake.functions.links import maps_url, topo_url, viewer_url
from auctionlake.functions.parcel import (
    address_words, county_matches, normalise_street, number_list, parcel_variants, word_set,
    words_overlap,
)
from auctionlake.operators.filters import in_need, needs_address_enrichment, needs_enrichment
from auctionlake.schema import PROPERTY_COLUMNS
from auctionlake.shared import stage

PARCEL_FIELDS = (
    "parno", "cntyname", "acres", "owner_name", "land_use", "latitude", "longitude", "is_clean", "feature_id",
)
WRITTEN = (
    "acres", "acres_source", "gis_county", "owner_name", "parcel_number", "land_use", "gis_url", "google_maps_url",
    "google_maps_topo_url", "latitude", "longitude",
)
LINK_FIELDS = ("latitude", "longitude", "gis_url", "google_maps_url", "google_maps_topo_url")


def _parcel() -> Column:
    return F.struct(*PARCEL_FIELDS)


def _key(kind: str, fips: Column, key: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), fips.alias("fips"), key.alias("key"))


def dealt(df: DataFrame, by: str) -> DataFrame:
    """The rows in at least two tasks per core, and as many as shuffles have."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), by)


def parcel_keys(parcels: DataFrame) -> DataFrame:
    """(kind, fips, key, parcel): for every way to look parcels up, the first feature under each key.

    Parcels are dealt to tasks before they are copied: a stored table of few bytes is read by one task, which would sort five copies of it all.
    """
    parcels = dealt(parcels, "feature_id")
    anywhere = F.lit("")
    fips = F.col("cntyfips")
    keys = F.array(
        _key("nparno", fips, F.col("nparno")),
        _key("altparno", fips, F.col("altparno")),
        _key("parno", fips, F.col("parno")),
        _key("parno", anywhere, F.col("parno")),
        _key("altparno", anywhere, F.col("altparno")),
    )
    rows = parcels.select(F.explode(keys).alias("k"), _parcel().alias("p")).select("k.*", "p")
    return (
        rows.where(truthy(F.col("key")) & F.col("fips").isNotNull())
        .groupBy("kind", "fips", "key")
        .agg(F.min_by("p", "p.feature_id").alias("parcel"))
    )


def _lookups(probes: DataFrame, policy: str) -> DataFrame:
    """Probes (county, parcel) with one row per lookup, in the order they are tried."""
    fips = dims.nc_fips(F.col("county"))
    spellings = parcel_variants("parcel_number") if policy == "default" else F.array(strip(F.col("parcel_number")))
    v = F.col("spelling")
    steps = F.array(
        _key("nparno", fips, F.concat(F.lit("37"), fips, F.lit("_"), v)),
        _key("altparno", fips, v),
        _key("parno", fips, v),
        _key("parno", F.lit(""), v),
        _key("altparno", F.lit(""), v),
    )
    tried = probes.select("county", "parcel_number", F.posexplode(spellings).alias("variant", "spelling"))
    tried = tried.select("county", "parcel_number", "variant", F.posexplode(steps).alias("step", "k"))
    return tried.select(
        "county", "parcel_number", (F.col("variant") * 5 + F.col("step")).alias("rank"), "step", "k.*"
    ).where(F.col("fips").isNotNull())


def lookup_parcels(probes: DataFrame, parcels: DataFrame, policy: str = "default") -> DataFrame:
    """(county, parcel_number, match): the first acceptable parcel of each distinct probe.

    The county-bound lookups pass over parcels without acreage or of another county. The
    ``default`` policy then takes any parcel of the same number, and a hit without acreage ends the
    search empty-handed. ``strict`` tries the number as written only and never accepts another county.
    """
    probes = probes.where(filled(F.col("parcel_number"))).select("county", "parcel_number").distinct()
    hits = _lookups(probes, policy).join(parcel_keys(parcels), ["kind", "fips", "key"])
    p, step = F.col("parcel"), F.col("step")
    clean, same = p["is_clean"], county_matches(p["cntyname"], F.col("county"))
    if policy == "strict":
        ends, good = (step >= 2) | (clean & same), clean & same
    else:
        ends, good = (step >= 3) | (clean & ((step == 2) | same)), clean
    found = hits.where(ends).groupBy("county", "parcel_number").agg(
        F.min_by(F.struct(good.alias("good"), p.alias("parcel")), "rank").alias("hit")
    )
    return found.where("hit.good").select("county", "parcel_number", F.col("hit.parcel").alias("match"))


def match_parcels(
    listings: DataFrame, parcels: DataFrame, policy: str = "default", split_candidates: bool = False
) -> DataFrame:
    """Listings with a ``match`` struct, null where no parcel was found.

    ``split_candidates`` takes the parcel text as a list parted by blanks; each number is tried as
    written and then without dashes, and the first with an acreage wins, else the last result stands.
    """
    if not split_candidates:
        found = lookup_parcels(listings, parcels, policy)
        return _left(listings, found)
    words = F.filter(F.split(strip(F.col("parcel_number")), r"(?U)\s+"), truthy)
    flat = lambda w: F.regexp_replace(w, r"(?U)[-\s]", "")
    tries = F.flatten(
        F.transform(words, lambda w: F.array(w, F.when((flat(w) != w) & (flat(w) != ""), flat(w))))
    )
    texts = listings.where(filled(F.col("parcel_number"))).select("county", "parcel_number").distinct()
    attempts = texts.select(
        "county", F.col("parcel_number").alias("text"), F.posexplode(tries).alias("attempt", "parcel_number")
    ).where(F.col("parcel_number").isNotNull())
    results = _left(attempts, lookup_parcels(attempts, parcels, policy))
    best = results.groupBy("county", "text").agg(
        F.min_by("match", F.when(F.col("match.acres") > 0, F.col("attempt"))).alias("good"),
        F.max_by(F.struct("match"), "attempt").alias("last"),
    )
    best = best.select(
        "county", F.col("text").alias("parcel_number"), F.coalesce("good", F.col("last.match")).alias("match")
    )
    return _left(listings, best)


def _left(listings: DataFrame, found: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Left join on county and parcel text, a null county meeting a null county. Blank parcel texts, and rows that are not ``wanted``,
    meet nothing; they get keys of their own, so that they do not gather by county."""
    found = found.withColumnsRenamed({"county": "_c", "parcel_number": "_p"})
    number = F.col("parcel_number")
    loose = F.concat(F.lit("\u0000"), F.xxhash64(*listings.columns).cast("string"))
    asks = filled(number) if wanted is None else filled(number) & wanted
    keyed = listings.withColumn("_k", F.when(asks, number).otherwise(loose))
    on = keyed["county"].eqNullSafe(found["_c"]) & (keyed["_k"] == found["_p"])
    return keyed.join(found, on, "left").drop("_c", "_p", "_k")


def _split_hot(index: DataFrame, asked: DataFrame, keys: list[str], counts: DataFrame, spread: str, block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``_part`` to join on as well: postings of a key with more than ``block`` are dealt to parts by ``spread``, and
    what asks for that key is sent to each. ``counts`` has the postings ``df`` of each key."""
    hot = counts.where(F.col("df") > block).select(*keys, F.ceil(F.col("df") / block).cast("int").alias("_parts"))
    part = F.coalesce(F.pmod(F.xxhash64(spread), F.col("_parts")).cast("int"), F.lit(0))
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    return (
        index.join(hot, keys, "left").withColumn("_part", part).drop("_parts"),
        asked.join(hot, keys, "left").withColumn("_part", every).drop("_parts"),
    )


# ---------------------------------------------------------------------------
# Address search
# ---------------------------------------------------------------------------

GRAM = 3


def _grams(text: Column, q: Column) -> Column:
    """Distinct substrings of length q."""
    ends = F.sequence(F.lit(1), F.greatest(F.length(text) - q + 1, F.lit(1)))
    return F.array_distinct(F.transform(ends, lambda i: F.substr(text, i, q)))


def _street_patterns(addresses: DataFrame) -> DataFrame:
    """(fips, address, prio, head, tail): text to contain, then text to follow later ('' for none)."""
    street = normalise_street("address")
    df = addresses.withColumns({"fips": dims.address_fips(F.col("county")), "_street": street})
    words = F.split("_street", " ")
    ways = F.array(
        F.struct(F.lit(1).alias("prio"), F.col("_street").alias("head"), F.lit("").alias("tail")),
        F.struct(F.lit(2).alias("prio"), words[0].alias("head"), F.coalesce(F.try_element_at(words, F.lit(2)), F.lit("")).alias("tail")),
    )
    return df.where("fips is not null").select("fips", "address", F.inline(ways)).where("head is not null")


def match_addresses(listings: DataFrame, parcels: DataFrame, block: int = 50_000) -> DataFrame:
    """Listings with the parcel whose site address contains their street in ``match``.

    First the whole normalised street is searched, then its first two words in that order; the first
    feature found must have an acreage, else the next way is tried.

    A pattern can only be contained in an address that has all its three-letter grams, so each
    distinct pattern is sent to the addresses of its rarest gram alone and compared there. Shorter
    patterns use grams of their own length, kept for the (at most 26) counties that have such patterns. A gram found in
    more than ``block`` addresses is split. Only the feature's number goes through the comparison; its parcel is fetched for the first hit.
    Distinct addresses and patterns are staged, as every step reads them.
    """
    sites = (
        parcels.where(F.col("cntyfips").isNotNull() & F.col("site_address").isNotNull())
        .groupBy(F.col("cntyfips").alias("fips"), F.upper("site_address").alias("site"))
        .agg(F.min_by(_parcel(), "feature_id").alias("parcel"))
    )
    wanted = listings.where(truthy(F.col("address")) & truthy(F.col("county"))).select("county", "address").distinct()
    sites, ways = stage(sites, "sites"), stage(_street_patterns(wanted).distinct(), "patterns")
    patterns = ways.select("fips", "head", "tail").distinct()

    longest = F.when(F.length("tail") > F.length("head"), F.col("tail")).otherwise(F.col("head"))
    size = F.least(F.length(longest), F.lit(GRAM))
    tiny = patterns.where(size < GRAM).select("fips").distinct()

    def index(of: DataFrame, q: int) -> DataFrame:
        kept = of.where(F.length("site") >= q)
        return kept.select("fips", "site", F.col("parcel.feature_id").alias("fid"), F.explode(_grams(F.col("site"), F.lit(q))).alias("gram"))

    small = sites.join(F.broadcast(tiny), "fips", "left_semi")
    grams = index(sites, GRAM)
    for q in range(1, GRAM):
        grams = grams.unionByName(index(small, q))
    counts = grams.groupBy("fips", "gram").agg(F.count(F.lit(1)).alias("df"))
    wanted_grams = patterns.select("fips", "head", "tail", F.explode(_grams(longest, size)).alias("gram"))
    # a gram found nowhere sorts first and ends the search for its pattern
    rarest = wanted_grams.join(counts, ["fips", "gram"], "left").groupBy("fips", "head", "tail").agg(
        F.min_by("gram", F.struct(F.coalesce("df", F.lit(0)), "gram")).alias("gram")
    )
    grams, rarest = _split_hot(grams, rarest, ["fips", "gram"], counts, "site", block)
    pairs = rarest.join(grams, ["fips", "gram", "_part"]).select("fips", "head", "tail", "site", "fid")
    at = F.call_function("instr", F.col("site"), F.col("head"))
    after = F.substr(F.col("site"), at + F.length("head"))
    hit = (at > 0) & ((F.col("tail") == "") | after.contains(F.col("tail")))
    firsts = pairs.where(hit).groupBy("fips", "head", "tail").agg(F.min("fid").alias("fid"))
    firsts = firsts.join(sites.select("fips", F.col("parcel.feature_id").alias("fid"), "parcel"), ["fips", "fid"]).drop("fid")
    best = (
        ways.join(firsts, ["fips", "head", "tail"]).where("parcel.is_clean and parcel.acres > 0")
        .groupBy("fips", "address").agg(F.min_by("parcel", "prio").alias("match"))
    )
    keyed = listings.withColumn("_fips", dims.address_fips(F.col("county")))
    found = best.withColumnsRenamed({"fips": "_f", "address": "_a"})
    return keyed.join(found, (keyed["_fips"] == found["_f"]) & (keyed["address"] == found["_a"]), "left").drop(
        "_fips", "_f", "_a"
    )


# ---------------------------------------------------------------------------
# Fuzzy match inside a county
# ---------------------------------------------------------------------------

TN_FIELDS = {
    "tnmap_owner": "OWNER", "tnmap_owner2": "OWNER2", "tnmap_address": "ADDRESS", "tnmap_city": "CITY",
    "tnmap_deeded_acres": "DEEDAC", "tnmap_calculated_acres": "CALCAC", "tnmap_gislink": "GISLINK",
    "tnmap_cmap": "CMAP", "tnmap_gp": "GP", "tnmap_parcel": "PARCEL", "tnmap_subdivision": "SUBDIV",
}


def _needed_words(words: Column) -> Column:
    """Fewest words another set must share for more than half of the union, and at least two."""
    return F.greatest(F.floor(F.size(words) / 2) + 1, F.lit(2)).cast("int")


def match_fuzzy(listings: DataFrame, parcels: DataFrame, min_score: int = 15, block: int = 50_000) -> DataFrame:
    """Listings with the ``tnmap_*`` columns of the first best parcel of their county.

    A parcel scores 5 for the county and 10 more for a matching address. With the default only
    address matches count; at 5 or below a listing without one takes the county's first parcel.
    Parcels are ordered by ``ord``.

    Addresses match by equal number lists, an equi-join on the list, or by shared words. Two word sets
    sharing enough words have one in common among the rarest few of each (all but the needed number
    less one), so only those words are joined on and the pairs verified; a word of more than ``block`` sets is split. Distinct addresses
    are staged. Listings without a match fetch their details by keys of their own that meet nothing.
    """
    county = dims.tn_county_id(F.col("county"))
    sites = parcels.where(filled(F.col("ADDRESS")) & F.col("COUNTY_ID").isNotNull()).select(
        F.col("COUNTY_ID").alias("cid"), F.upper(strip(F.col("ADDRESS"))).alias("site"), "ord"
    )
    firsts = sites.groupBy("cid", "site").agg(F.min("ord").alias("ord"))
    firsts = firsts.withColumns({"_t": address_words("site")}).withColumns(
        {"nums": F.array_join(number_list(F.col("_t")), " "), "words": word_set(F.col("_t"))}
    ).drop("_t")
    wanted = (
        listings.select(county.alias("cid"), F.upper(strip(F.col("address"))).alias("addr"))
        .where("cid is not null and addr <> ''").distinct()
        .withColumn("_t", address_words("addr"))
        .withColumns({"nums": F.array_join(number_list(F.col("_t")), " "), "words": word_set(F.col("_t"))}).drop("_t")
    )
    firsts, wanted = stage(firsts, "sites"), stage(wanted, "addresses")
    by_numbers = wanted.join(
        firsts.groupBy("cid", "nums").agg(F.min("ord").alias("ord")), ["cid", "nums"]
    ).select("cid", "addr", "ord")

    frequency = (
        firsts.select("cid", F.explode("words").alias("word")).groupBy("cid", "word").agg(F.count(F.lit(1)).alias("df"))
    )

    def rarest(df: DataFrame, *kept: str) -> DataFrame:
        """The sets of two words and more, one row per word that a match must include one of."""
        sets = df.where(F.size("words") >= 2).select("cid", "words", *kept)
        each = sets.select("*", F.explode("words").alias("word")).join(frequency, ["cid", "word"], "left")
        ranked = each.groupBy("cid", "words", *kept).agg(
            F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word"))).alias("ws")
        )
        few = F.slice("ws", F.lit(1), F.greatest(F.size("ws") - _needed_words(F.col("words")) + 1, F.lit(1)))
        return ranked.select("cid", "words", *kept, F.explode(few).alias("w")).withColumn("word", F.col("w.word")).drop("w")

    asked = rarest(wanted, "addr").withColumnRenamed("words", "asked")
    known = stage(rarest(firsts, "ord"), "words")
    postings = known.groupBy("cid", "word").agg(F.count(F.lit(1)).alias("df"))
    known, asked = _split_hot(known, asked, ["cid", "word"], postings, "ord", block)
    by_words = (
        asked.join(known, ["cid", "word", "_part"])
        .where(words_overlap(F.col("asked"), F.col("words")))
        .groupBy("cid", "addr").agg(F.min("ord").alias("ord"))
    )
    best = by_numbers.unionByName(by_words).groupBy("cid", "addr").agg(F.min("ord").alias("_ord"))
    if min_score > 15:
        best = best.where(F.lit(False))
    keyed = listings.withColumns({"cid": county, "addr": F.upper(strip(F.coalesce("address", F.lit(""))))})
    keyed = keyed.join(best, ["cid", "addr"], "left")
    if min_score <= 5:
        county_first = sites.groupBy("cid").agg(F.min("ord").alias("_first"))
        keyed = keyed.join(county_first, "cid", "left").withColumn("_ord", F.coalesce("_ord", "_first")).drop("_first")
    details = parcels.select(F.col("ord").alias("_ord"), *[F.col(src).alias(n) for n, src in TN_FIELDS.items()])
    kept = [c for c in keyed.columns if c not in TN_FIELDS]
    loose = -1 - F.abs(F.xxhash64(*listings.columns) % 1_000_000)
    keyed = keyed.select(*kept).withColumn("_ord", F.coalesce(F.col("_ord").cast("bigint"), loose))
    return keyed.join(details, "_ord", "left").drop("_ord", "cid", "addr")


# ---------------------------------------------------------------------------
# Writing matches back
# ---------------------------------------------------------------------------


def _located(lat: Column, lng: Column) -> Column:
    return F.coalesce((lat != 0) & (lng != 0), F.lit(False))


def apply_parcels(matched: DataFrame, number_may_lack: bool = True) -> DataFrame:
    """Table rows with the acreage, canonical number, owner, land use, place and links of their ``match``.

    Rows whose match has no acreage stay as they are. ``number_may_lack`` keeps the listing's own
    number when the parcel has none. Columns the table lacks are added.
    """
    missing = [c for c in WRITTEN if c not in matched.columns]
    matched = matched.withColumns({c: F.lit(None).cast(PROPERTY_COLUMNS[c]) for c in missing})
    m = F.col("match")
    ok = F.coalesce(m["acres"] > 0, F.lit(False))
    county = F.coalesce(blank_to_null(m["cntyname"]), F.col("county"))
    number = F.coalesce(empty(m["parno"]), F.col("parcel_number")) if number_may_lack else m["parno"]
    placed = ok & _located(m["latitude"], m["longitude"])
    place = (m["longitude"], m["latitude"], F.col("address"), F.col("city"), county)
    new = {
        "acres": m["acres"],
        "acres_source": F.lit("gis"),
        "gis_county": county,
        "owner_name": m["owner_name"],
        "parcel_number": number,
        "land_use": m["land_use"],
        "gis_url": viewer_url(m["longitude"], m["latitude"], F.coalesce(empty(m["parno"]), strip(F.col("parcel_number")))),
        "google_maps_url": maps_url(*place),
        "google_maps_topo_url": topo_url(*place),
    }
    out = {c: F.when(ok, v).otherwise(F.col(c)) for c, v in new.items()}
    out["latitude"] = F.when(placed, m["latitude"]).otherwise(F.col("latitude"))
    out["longitude"] = F.when(placed, m["longitude"]).otherwise(F.col("longitude"))
    return matched.withColumns(out).drop("match")


def empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def enrich(df: DataFrame, parcels: DataFrame, source: str | None = None, limit: int | None = None) -> DataFrame:
    """(outcome, listing columns) of the listings in need of enrichment: enriched, failed or skipped_no_parcel."""
    matched = match_parcels(needs_enrichment(df, source, limit), parcels)
    return _with_outcome(matched, filled(F.col("parcel_number")), "skipped_no_parcel", True)


def enrich_in_place(table: DataFrame, parcels: DataFrame) -> DataFrame:
    """The whole table, listings in need of it enriched: all rows pass once, and only those in need meet what was found for them."""
    found = lookup_parcels(table.where(in_need()), parcels)
    return apply_parcels(_left(table, found, in_need()), True)


def enrich_by_address(df: DataFrame, parcels: DataFrame, source: str = "hutchens_law") -> DataFrame:
    """The same by street address, for a source without parcel numbers."""
    matched = match_addresses(needs_address_enrichment(df, source), parcels)
    return _with_outcome(matched, truthy(F.col("address")), "skipped_no_address", False).withColumn(
        "land_use", F.when(F.col("outcome") == "enriched", F.lit(None)).otherwise(F.col("land_use"))
    )


def _with_outcome(matched: DataFrame, asked: Column, skipped: str, number_may_lack: bool) -> DataFrame:
    done = F.coalesce(F.col("match.acres") > 0, F.lit(False))
    outcome = F.when(~asked, skipped).when(done, "enriched").otherwise("failed")
    return apply_parcels(matched.withColumn("outcome", outcome), number_may_lack)


def enrichment_outcome(enriched: DataFrame) -> DataFrame:
    """Counts of the outcomes of one pass, one row."""
    o = F.col("outcome")
    return enriched.agg(
        F.count_if(o == "enriched").alias("enriched"),
        F.count_if(o.startswith("skipped")).alias("skipped"),
        F.count_if(o == "failed").alias("failed"),
    )


def repair_links(df: DataFrame, parcels: DataFrame, source: str | None = None) -> DataFrame:
    """Rows whose coordinates or links change when rebuilt, with the new values.

    Active rows without coordinates are looked up by parcel number, then by address; archived rows
    only get their links rebuilt.
    """
    rows = df if not source or source == "all" else df.where(F.col("source") == source)
    lacking = ~_located(F.col("latitude"), F.col("longitude")) & (F.col("status") == "active")
    lost = rows.where(lacking)
    tidy = {c: blank_to_null(F.col(c)) for c in ("parcel_number", "address", "city")}
    old = {c: f"_old_{c}" for c in LINK_FIELDS}

    def staged(d: DataFrame) -> DataFrame:
        d = d.withColumns({v: F.col(k) for k, v in old.items()}).withColumn("_county_raw", F.col("county"))
        return d.withColumns({**tidy, "county": strip(F.coalesce("county", F.lit("")))})

    by_number = match_parcels(staged(lost), parcels).withColumnRenamed("match", "_m1")
    both = match_addresses(by_number, parcels).withColumnRenamed("match", "_m2")
    m1, m2 = F.col("_m1"), F.col("_m2")
    first = _located(m1["latitude"], m1["longitude"])
    second = ~first & m2.isNotNull()
    number = F.coalesce(F.when(second, empty(m2["parno"])), empty(m1["parno"]), F.col("parcel_number"))

    def looked(c: str) -> Column:
        return F.when(second, m2[c]).when(m1.isNotNull(), m1[c]).otherwise(F.col(c))

    found = both.withColumns(
        {"latitude": looked("latitude"), "longitude": looked("longitude"), "parcel_number": number}
    ).drop("_m1", "_m2")
    rebuilt = found.unionByName(staged(rows.where(~lacking | lacking.isNull())))
    place = ("longitude", "latitude", "address", "city", "county")
    rebuilt = rebuilt.withColumns(
        {
            "gis_url": viewer_url("longitude", "latitude", "parcel_number"),
            "google_maps_url": maps_url(*place),
            "google_maps_topo_url": topo_url(*place),
        }
    )
    same = F.lit(True)
    for c, o in old.items():
        same = same & F.col(c).eqNullSafe(F.col(o))
    return rebuilt.where(~same).withColumn("county", F.col("_county_raw")).drop("_county_raw", *old.values())


