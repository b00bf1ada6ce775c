"""Benchmark passages in documents by SimHash windows, multi-index Hamming blocks and exact similarity (operator 10).

Only DataFrame functions. Words are runs between ASCII blanks of the lower-cased text; shingles have ``width`` words, and an
item of fewer words is one shingle of all of them. A shingle weighs more the fewer items hold it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, staged, text_key

FILTER_BITS = 23  #: the shingle filter has 2^23 bits (1 MB) whatever the benchmark's size
BLOCKS, BLOCK_BITS = 4, 16


def word_array(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), BLANKS), lambda w: w != "")


def shingle_hashes(words: Column, width: int) -> Column:
    """64-bit hashes of all runs of ``width`` words, in order."""
    last = F.size(words) - width
    one = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)])
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), one)).otherwise(F.array().cast("array<bigint>"))


def places(h: Column) -> list[Column]:
    """The two bits of a shingle in the filter."""
    return [F.shiftright(h, s).bitwiseAND((1 << FILTER_BITS) - 1) for s in (0, FILTER_BITS)]


def shingle_filter(shingles: DataFrame) -> Column:
    """A Bloom filter of fixed size as a scalar subquery: an array of longs, evaluated once."""
    bits = shingles.select(F.explode(F.array(*places(F.col("h")))).alias("bit"))
    held = bits.groupBy(F.shiftright("bit", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("bits"))
    slots = shingles.sparkSession.range(1 << (FILTER_BITS - 6)).join(held, "id", "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    return slots.agg(F.sort_array(F.collect_list(F.struct("id", "bits"))).alias("s")).select(F.col("s.bits")).scalar()


def weigh(shingles: DataFrame, items: int) -> DataFrame:
    """(h, weight): 1000 ln(1 + items / items with the shingle), rounded."""
    return shingles.groupBy("h").agg(F.countDistinct("item_id").alias("df")).select("h", F.round(1000 * F.log(1 + F.lit(items) / F.col("df"))).cast("bigint").alias("weight"))


def fingerprints(shingles: DataFrame, keys: list[str]) -> DataFrame:
    """SimHash and total weight per key: bit b is set if the shingles with bit b weigh more than those without."""
    sums = [F.sum(F.when(F.getbit("h", F.lit(b)) == 1, F.col("weight")).otherwise(-F.col("weight"))).alias(f"s{b}") for b in range(64)]
    bits = [F.when(F.col(f"s{b}") > 0, F.expr(f"shiftleft(1L, {b})")).otherwise(F.lit(0).cast("bigint")) for b in range(64)]
    whole = reduce(lambda x, y: x.bitwiseOR(y), bits)
    return shingles.groupBy(*keys).agg(F.sum("weight").alias("total"), *sums).select(*keys, "total", whole.alias("print"))


def block_values(value: Column) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("block"), F.shiftright(value, BLOCK_BITS * k).bitwiseAND((1 << BLOCK_BITS) - 1).alias("value")) for k in range(BLOCKS)])


def within(windows: DataFrame, items: DataFrame, radius: int) -> DataFrame:
    """(uid, start, size, item_id) of all windows and items of one size with at most ``radius`` differing bits.

    Of four blocks one differs in radius // 4 bits or fewer, so each item block is listed with all values that near, and a window
    is looked up by its own four values.
    """
    masks = ",".join(str(m) for m in range(1 << BLOCK_BITS) if m.bit_count() <= radius // BLOCKS)
    listed = items.select("item_id", "size", F.col("print").alias("item_print"), F.inline(block_values(F.col("print"))))
    listed = listed.withColumn("mask", F.explode(F.split(F.lit(masks), ","))).withColumn("value", F.col("value").bitwiseXOR(F.col("mask").cast("bigint"))).drop("mask")
    asked = windows.select("uid", "start", "size", "print", F.inline(block_values(F.col("print"))))
    met = asked.join(listed.hint("merge"), ["size", "block", "value"])
    return met.where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius).select("uid", "start", "size", "item_id").distinct()


def _of_width(docs: DataFrame, items: DataFrame, n_items: int, width: int, percent: int, radius: int) -> DataFrame:
    listed = items.select("item_id", F.size("words").alias("size"), F.posexplode_outer(shingle_hashes(F.col("words"), width)).alias("k", "h"))
    listed = staged(listed, "items")
    weights = weigh(listed, n_items)
    top = 1000 * F.log(1 + F.lit(n_items) / F.lit(1))
    present = shingle_filter(listed)
    bit = lambda p: F.getbit(F.get(present, F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int")) == 1
    reach = listed.agg(F.max("k").alias("k")).first()["k"]  # shingles of the longest item, less one
    split = docs.select("doc_id", "text_key", word_array(F.col("text")).alias("words"))
    hashed = split.select("doc_id", "text_key", shingle_hashes(F.col("words"), width).alias("hs"))
    hits = hashed.select("doc_id", "text_key", "hs", F.posexplode_outer("hs").alias("at", "h")).where(bit(places(F.col("h"))[0]) & bit(places(F.col("h"))[1]))
    first = F.greatest(F.col("at") - reach, F.lit(0))
    near = hits.select(
        "doc_id", "text_key", "at", "h", F.size("hs").alias("many"), first.alias("first"), F.slice("hs", first + 1, F.lit(2 * reach + 1)).alias("near")
    )

    # windows of an item's size, laid where a shingle of the item stands at its place in the item
    aligned = near.join(listed.select("h", "size", "k").distinct(), "h")
    start = F.greatest(F.lit(0), F.least(F.col("at") - F.col("k"), F.col("many") - (F.col("size") - width + 1)))
    windows = aligned.withColumn("start", start).dropDuplicates(["text_key", "size", "start"])
    windows = staged(windows.select(
        "doc_id", F.col("text_key").alias("uid"), "size", "start",
        F.array_distinct(F.slice("near", F.col("start") - F.col("first") + 1, F.col("size") - width + 1)).alias("hs"),
    ), "found")
    inside = windows.select("uid", "start", "size", F.explode("hs").alias("h"))
    inside = staged(
        inside.join(weights, "h", "left").select("uid", "start", "size", "h", F.coalesce("weight", F.round(top).cast("bigint")).alias("weight")),
        "windows",
    )
    of_items = listed.select("item_id", "size", "h").distinct().join(weights, "h")
    window_prints = fingerprints(inside, ["uid", "start", "size"])
    item_prints = fingerprints(of_items, ["item_id", "size"])
    pairs = staged(within(window_prints, item_prints, radius), "pairs")

    # exact weighted similarity of the candidates
    shared = (
        pairs.join(inside, ["uid", "start", "size"]).join(of_items.select("item_id", "h"), ["item_id", "h"])
        .groupBy("uid", "start", "size", "item_id").agg(F.sum("weight").alias("both"))
    )
    sized = shared.join(window_prints.select("uid", "start", "size", F.col("total").alias("of_window")), ["uid", "start", "size"]).join(
        item_prints.select("item_id", F.col("total").alias("of_item")), "item_id"
    )
    union = F.col("of_window") + F.col("of_item") - F.col("both")
    alike = sized.where(100 * F.col("both") >= percent * union).select("uid", "item_id", "start", "size", F.floor(1000 * F.col("both") / union).cast("bigint").alias("similarity"))
    best = alike.groupBy("uid", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "size")).alias("b"))
    return best.join(windows.select("uid", "doc_id").distinct(), "uid").select(
        "doc_id", F.col("uid").alias("text_key"), "item_id", (-F.col("b.back")).cast("bigint").alias("start_word"), F.col("b.size").cast("bigint").alias("n_words"),
        F.col("b.similarity").alias("similarity"),
    )


def matches(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", width: int = 5, percent: int = 80, radius: int = 19,
) -> DataFrame:
    """(doc_id, text_key, item_id, start_word, n_words, similarity): the best window of each document for each item whose
    weighted shingle similarity with it is ``percent`` or more; similarity in thousandths.

    Whole texts are hashed in one scan, where a filter of fixed size lets through places that may hold a benchmark
    shingle; without one no window can be similar, so this loses nothing. Windows of an item's size around them are fingerprinted
    and matched within ``radius`` of 64 bits; two sets at exactly 0.8 differ in 9.7 bits on average, and in more than 19
    once in two thousand. Null, empty and blank texts match nothing; rows that repeat an id and a text are listed once, repeated
    items each; null ids stay null; other columns are not read; an empty side gives no rows.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(id_col), F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    split = items.select(F.col(item_id_col).alias("item_id"), word_array(F.col(item_text_col)).alias("words")).where("size(words) > 0")
    counts = split.groupBy(F.least(F.size("words"), F.lit(width)).alias("width")).agg(F.count("*").alias("n")).collect()
    total = sum(r["n"] for r in counts)
    found = [
        _of_width(source, split.where(F.least(F.size("words"), F.lit(width)) == r["width"]), total, r["width"], percent, radius)
        for r in sorted(counts)
    ]
    if not found:
        return source.where("false").selectExpr("doc_id", "text_key", "0L item_id", "0L start_word", "0L n_words", "0L similarity")
    return reduce(DataFrame.unionByName, found)


def clean(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without a match, their columns as they were. A match removes the rows of its id and its whole text, told
    by 128 bits of both, never other texts under that id or other rows without one."""
    hit = found.select(F.col("text_key").alias("_hit")).distinct()
    return docs.join(hit, text_key(docs[id_col], docs[text_col]) == hit["_hit"], "left_anti")


#: The same rows without fingerprints: every aligned window compared exactly.
SQL = r"""
WITH items AS (
  SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM benchmark
), docs AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), total AS (SELECT count(*) AS n FROM items WHERE len(words) > 0
), item_shingles AS (
  SELECT item_id, len(words) AS size, k, array_to_string(words[k + 1:k + 5], ' ') AS h FROM items, range(0, len(words) - 4) r(k) WHERE len(words) >= 5
), weights AS (
  SELECT h, CAST(round(1000 * ln(1 + (SELECT n FROM total) / count(DISTINCT item_id))) AS BIGINT) AS weight FROM item_shingles GROUP BY h
), doc_shingles AS (
  SELECT doc_id, len(words) - 4 AS many, p, array_to_string(words[p + 1:p + 5], ' ') AS h FROM docs, range(0, len(words) - 4) r(p) WHERE len(words) >= 5
), windows AS (
  SELECT DISTINCT doc_id, size, greatest(0, least(p - k, many - (size - 4))) AS start
  FROM doc_shingles JOIN (SELECT DISTINCT h, size, k FROM item_shingles) USING (h)
), inside AS (
  SELECT DISTINCT w.doc_id, w.size, w.start, d.h,
    coalesce(weight, (SELECT CAST(round(1000 * ln(1 + n)) AS BIGINT) FROM total)) AS weight
  FROM windows w JOIN doc_shingles d ON d.doc_id = w.doc_id AND d.p >= w.start AND d.p < w.start + w.size - 4
  LEFT JOIN weights ON weights.h = d.h
), of_window AS (SELECT doc_id, size, start, sum(weight) AS total FROM inside GROUP BY ALL
), of_items AS (SELECT DISTINCT item_id, size, h, weight FROM item_shingles JOIN weights USING (h)
), of_item AS (SELECT item_id, sum(weight) AS total FROM of_items GROUP BY item_id
), shared AS (
  SELECT doc_id, size, start, item_id, sum(inside.weight) AS common FROM inside JOIN of_items USING (size, h) GROUP BY ALL
), alike AS (
  SELECT doc_id, item_id, start, size, common, w.total + i.total - common AS whole
  FROM shared JOIN of_window w USING (doc_id, size, start) JOIN of_item i USING (item_id)
), best AS (
  SELECT *, CAST(common * 1000 // whole AS BIGINT) AS similarity FROM alike WHERE 100 * common >= 80 * whole
)
SELECT doc_id, item_id, CAST(start AS BIGINT) AS start_word, CAST(size AS BIGINT) AS n_words, similarity FROM best
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""
