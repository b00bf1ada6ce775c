"""URL filter: rules, and for the rest two character Markov models (operator 4). Only DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, staged

#: The contract's rules: verdict, host and path; the longest that fits wins.
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
ORDER = 3  #: characters of context in the longest model
ALPHABET = 256  #: below the shortest context every character is taken as one of so many


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and where no ``://`` stands."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return fold(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def ruling(rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, from columns host and path; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(F.col("path"), F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def grams(texts: DataFrame, keep: list[str]) -> DataFrame:
    """A row per character of ``text`` and per end: ``g``, the character after its ORDER predecessors."""
    padded = texts.withColumn("padded", F.concat(F.lit("\x02" * ORDER), F.col("text"), F.lit("\x03")))
    return padded.select(*keep, F.explode(F.transform(F.sequence(F.lit(1), F.length("text") + 1), lambda i: F.substring(F.col("padded"), i, F.lit(ORDER + 1)))).alias("g"))


def log_ratio(counts: DataFrame, all_grams: DataFrame) -> DataFrame:
    """(g, ratio) for every gram: 1000 (ln P(accepted) - ln P(rejected)), rounded, of its last character after the others.

    Per class, an order's estimate mixes its counts with the next shorter context's (Witten and Bell): a context that has
    many different followers trusts the shorter one more, an unseen one altogether.
    """
    table = all_grams
    for label in ("allow", "block"):
        own = counts.where(F.col("label") == label)
        table = table.withColumn("p", F.lit(1.0 / ALPHABET))
        for k in range(ORDER + 1):
            tail = lambda c, k=k: F.substring(c, ORDER + 1 - k, k + 1)
            seen = own.groupBy(tail(F.col("g")).alias("s")).agg(F.sum("n").alias("n"))
            contexts = seen.groupBy(F.substring("s", 1, k).alias("c")).agg(F.sum("n").alias("of"), F.count("*").alias("kinds"))
            table = table.withColumn("s", tail(F.col("g"))).withColumn("c", F.substring("s", 1, k)).join(seen, "s", "left").join(contexts, "c", "left")
            mixed = (F.coalesce("n", F.lit(0)) + F.col("kinds") * F.col("p")) / (F.col("of") + F.col("kinds"))
            table = table.withColumn("p", F.when(F.col("of").isNull(), F.col("p")).otherwise(mixed)).drop("s", "c", "n", "of", "kinds")
        table = table.withColumnRenamed("p", label)
    return table.select("g", F.round(1000 * (F.log("allow") - F.log("block"))).cast("bigint").alias("ratio"))


def threshold(scored: DataFrame) -> Column:
    """The score from which URLs are accepted, as a scalar subquery: that with the least sum of both classes' error shares on
    labelled URLs, ties by score; 0 unless both classes occur. Scores are whole thousandths, so their histogram is small."""
    sums = scored.groupBy("score").agg(*[F.sum(F.when(F.col("label") == x, F.col("pages")).otherwise(0)).alias(x) for x in ("allow", "block")])
    bins = sums.agg(F.sort_array(F.collect_list(F.struct("score", "allow", "block"))).alias("b"), F.sum("allow").alias("of_allow"), F.sum("block").alias("of_block"))
    first = F.struct(F.lit(0).cast("bigint").alias("lost"), F.col("of_block").alias("passed"), F.struct(F.lit(9.0).alias("error"), F.lit(0).cast("bigint").alias("score")).alias("best"))
    error = lambda a: a["lost"] / F.col("of_allow") + a["passed"] / F.col("of_block")
    step = lambda a, x: F.struct(
        (a["lost"] + x["allow"]).alias("lost"), (a["passed"] - x["block"]).alias("passed"),
        F.least(a["best"], F.struct(error(a).alias("error"), x["score"].alias("score"))).alias("best"),
    )
    both = (F.col("of_allow") > 0) & (F.col("of_block") > 0)
    return F.coalesce(bins.select(F.when(both, F.aggregate("b", first, step)["best"]["score"]).otherwise(F.lit(0)).alias("t")).scalar(), F.lit(0))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every page.

    URLs that a rule fits are labelled: those of even checksum train the two models, the others set the threshold. Models see host and
    path; the score is their log-likelihood difference per character in thousandths. Texts are counted and scored once
    each however many pages share them, so a hot host costs one row per task. Null, empty and malformed URLs have an empty host
    and path and are scored as such; repeated pages are each listed; without labels of both kinds the threshold is 0.
    """
    host, path = parts(F.col(url_col).cast("string"))
    split = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = ruling(rules)
    split = split.withColumns({"rule": rule, "label": verdict, "text": F.concat("host", "path")})
    texts = staged(split.groupBy("text", "label").agg(F.count("*").alias("pages")).withColumn("part", F.crc32(F.col("text").cast("binary")) % 2), "urls")
    pieces = staged(grams(texts, ["text", "label", "part", "pages"]).groupBy("g", "label", "part").agg(F.sum("pages").alias("n")), "grams")
    ratios = staged(log_ratio(pieces.where("part = 0 and label is not null"), pieces.select("g").distinct()), "ratios")
    scored = grams(texts.select("text").distinct(), ["text"]).join(ratios, "g").groupBy("text").agg(F.floor(F.sum("ratio") / F.count("*")).cast("bigint").alias("score"))
    scored = staged(scored, "scores")
    limit = threshold(texts.where("part = 1 and label is not null").join(scored, "text").select("score", "label", "pages"))
    return split.join(scored, "text").select(
        "page_id", "host", "path", "rule", F.coalesce("label", F.when(F.col("score") >= limit, "allow").otherwise("block")).alias("verdict"), "score"
    )
