"""Quality rules: a table of thresholds compiled into one projection (operator 13)."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionlake.functions.base import bind

from .common import BLANKS

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he", "this", "are", "or",
    "de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "est", "dans", "qui", "par", "pour", "au", "sur",
    "der", "die", "und", "das", "von", "den", "zu", "mit", "dem", "ist", "ein", "eine", "nicht", "auf", "als", "auch",
    "el", "los", "las", "y", "se", "del", "con", "al", "su", "para", "es", "lo",
)

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"


class Rule(NamedTuple):
    """1000 * top must lie between least * bottom and most * bottom; a bound of None is not tested."""

    name: str
    top: str
    bottom: str
    least: int | None
    most: int | None


#: The rules after the base (at least 50 words, at most half of them in repeated windows).
RULES = (
    Rule("word_count", "n_words", "one", 50_000, 500_000_000),
    Rule("word_length", "word_chars", "n_words", 2_000, 12_000),
    Rule("symbols", "n_symbols", "n_words", None, 150),
    Rule("stop_words", "n_stop_words", "n_words", 20, None),
    Rule("stop_word_count", "n_stop_words", "one", 2_000, None),
    Rule("letters", "n_letter_words", "n_words", 700, None),
    Rule("shouted_words", "n_shouted_words", "n_words", None, 300),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 400),
)


def broken(rule: Rule) -> Column:
    """Whether a row breaks the rule; false where the bottom is 0 and so is the top."""
    top, bottom = F.col(rule.top) * 1000, F.lit(1) if rule.bottom == "one" else F.col(rule.bottom)
    tests = [top < bottom * rule.least] if rule.least is not None else []
    tests += [top > bottom * rule.most] if rule.most is not None else []
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _repeated(words: Column, width: int = 3) -> Column:
    """How many words lie in a window of ``width`` words that the text holds twice or more.

    Windows are sorted as text with their place behind a line feed, which no word holds; equal windows are neighbours then.
    """
    last = F.size(words) - width

    def window(i: Column) -> Column:
        return F.concat_ws(" ", *[F.get(words, i + k) for k in range(width)])

    def within(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda w, i: F.concat(w, F.lit("\n"), i.cast("string"))))

        def covered(order: Column) -> Column:
            def same(x: Column, y: Column) -> Column:
                return F.substring_index(x, "\n", 1) == F.substring_index(y, "\n", 1)

            twice = F.filter(order, lambda x, i: F.coalesce(same(x, F.get(order, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(order, i + 1)), F.lit(False)))
            places = F.transform(twice, lambda x: F.substring_index(x, "\n", -1).cast("int"))
            return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(*[p + k for k in range(width)])))))

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(bind(placed, covered))

    return F.when(last < 1, 0).otherwise(bind(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), window), within)).cast("bigint")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts that rules speak of, each of the whole text, as long integers.

    Words and lines are bound, not named as columns: a filter on the result that is pushed down never splits a text once per word.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counted(w: Column) -> Column:
        found = {
            "n_words": F.size(w),
            "word_chars": F.length(F.array_join(w, "")),
            "n_repeat_words": _repeated(w),
            "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))),
            "n_letter_words": F.size(F.filter(w, lambda x: x.rlike(r"[A-Za-zÀ-ɏͰ-￿]"))),
            "n_shouted_words": F.size(F.filter(w, lambda x: x.rlike("^[A-ZÀ-ÖØ-Þ]{2,}[^A-Za-z]*$"))),
        }
        return F.struct(*[c.cast("bigint").alias(k) for k, c in found.items()])

    def lined(x: Column) -> Column:
        return F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))

    symbols = F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("bigint")
    counts = docs.select(F.col(id_col).alias("doc_id"), bind(words, counted).alias("of_words"), bind(lines, lined).alias("of_lines"), symbols.alias("n_symbols"))
    return counts.select("doc_id", "n_symbols", "of_words.*", "of_lines.*")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed) of every row.

    ``failed`` names the rules broken, joined by commas. Every row is measured and judged by itself in one projection, without a
    shuffle: ties and repeated rows are judged alike, no rows give no rows, and no other column is read, whatever its name. Null,
    empty and blank texts have no words and fail the base. Texts are measured whole, however long.
    """
    names = F.concat_ws(",", *[F.when(broken(rule), rule.name) for rule in rules])
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    judged = measures(docs, id_col, text_col).withColumns({"base_failed": base, "failed": names})
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("failed") == "")).alias("kept"), "failed",
    )


def _rule_sql(rule: Rule) -> str:
    bottom = "1" if rule.bottom == "one" else rule.bottom
    tests = [f"1000 * {rule.top} < {rule.least} * {bottom}"] if rule.least is not None else []
    tests += [f"1000 * {rule.top} > {rule.most} * {bottom}"] if rule.most is not None else []
    return f"case when {' or '.join(tests)} then '{rule.name}' end"


#: Reference SQL of ``op13_quality``.
SQL = rf"""
with base as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
tokens as (select r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as w,
    unnest(range(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')))) as i from base),
counts as (select r, count(*) as n_words, sum(length(w)) as word_chars,
    count(*) filter (lower(w) in ({", ".join(f"'{w}'" for w in STOP_WORDS)})) as n_stop_words,
    count(*) filter (regexp_matches(w, '[A-Za-z\x{{00C0}}-\x{{024F}}\x{{0370}}-\x{{FFFF}}]')) as n_letter_words,
    count(*) filter (regexp_matches(w, '^[A-Z\x{{00C0}}-\x{{00D6}}\x{{00D8}}-\x{{00DE}}]{{2,}}[^A-Za-z]*$')) as n_shouted_words
    from tokens group by r),
windows as (select r, i, w as a, lead(w, 1) over t as b, lead(w, 2) over t as c from tokens window t as (partition by r order by i)),
twice as (select r, i from (select r, i, count(*) over (partition by r, a, b, c) as k from windows where c is not null) where k > 1),
repeated as (select r, count(distinct i + d) as n_repeat_words from twice, (values (0), (1), (2)) as v(d) group by r),
lines as (select r, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
    from (select r, unnest(string_split(text, chr(10))) as line from base) where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
measured as (select doc_id, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0)::bigint as word_chars,
    length(regexp_replace(text, '[^{SYMBOLS}]+', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
    coalesce(n_stop_words, 0) as n_stop_words, coalesce(n_letter_words, 0) as n_letter_words,
    coalesce(n_shouted_words, 0) as n_shouted_words, coalesce(n_lines, 0) as n_lines
    from base left join counts using (r) left join repeated using (r) left join lines using (r)),
judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, concat_ws(',', {", ".join(map(_rule_sql, RULES))}) as failed from measured)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and failed = '' as kept, failed from judged
"""
