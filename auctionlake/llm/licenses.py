"""Licences in texts by known sentences and ordered rules on their sequences (operator 8). Only DataFrame functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionlake.functions.base import bind

from .licence_texts import LINES, NOTICES, SPDX

#: A sentence ends at a stop before a blank and at an empty line, also one that holds comment signs only; single line breaks do not end it.
ENDS, BREAKS, SIGNS = r"[.!?]+\s+|\r?\n[^A-Za-z0-9\n]*\n", r"[\r\n]+", "[^a-z0-9]+"


def plain(sentence: str) -> str:
    return re.sub(SIGNS, " ", sentence.lower()).strip()


def sentences_of(notice: str) -> tuple[str, ...]:
    """A notice cut as texts are cut; single words, such as the numbers of a list, are left out."""
    return tuple(s for s in map(plain, re.split(ENDS, notice)) if " " in s)


def _tables() -> tuple[list[str], list[tuple[str, tuple[int, ...]]]]:
    """Sentences by number (from 1), and rules in order: whole notices, long ones first, then beginnings that suffice, then lines.

    Each notice counts as published, with its lines joined by paragraph, and all in one line, where paragraphs run together.
    """
    numbers: dict[str, int] = {}
    number = lambda s: numbers.setdefault(s, len(numbers) + 1)
    whole, begun = [], []
    for licence, enough, text in NOTICES:
        for form in (text, " ".join(text.split())):
            ids = tuple(map(number, sentences_of(form)))
            if len(ids) > 1 and (licence, ids) not in whole:
                whole.append((licence, ids))
            begun.append((licence, ids[:enough]))
    short = [(licence, (number(plain(s)),)) for licence, s in LINES]
    short += [(licence, (number(plain(f"SPDX-License-Identifier: {licence}")),)) for licence in SPDX]
    rules = sorted(whole, key=lambda r: -len(r[1])) + sorted(begun, key=lambda r: -len(r[1])) + short
    seen: set[tuple[int, ...]] = set()
    kept = [r for r in rules if not (r[1] in seen or seen.add(r[1]))]
    return list(numbers), kept


#: A sentence's number is its place, from 1. A rule is a licence and the sentences that must follow one another, others left out.
SENTENCES, RULES = _tables()

#: Words of the longest sentence: no more lines than this can hold a known one.
LONGEST = max(len(s.split()) for s in SENTENCES)

#: Every rule's first sentence has one of these; texts without them are not split.
CUES = ("licen", "permission", "reserved", "warrant", "redistribut")


def marked(numbers: tuple[int, ...]) -> str:
    return "".join(f"|{n}|" for n in numbers)


def taken(numbers: tuple[int, ...]) -> str:
    return "|-|" * len(numbers)


def sentence_numbers(text: Column) -> Column:
    """The numbers of a text's sentences in order, 0 for unknown ones.

    Where a sentence is unknown as a whole, its longest known end that begins at a line break counts, and each line above it (which
    had no stop) by itself; without such an end, each of its lines.
    """
    known = F.create_map(*[F.lit(x) for k, s in enumerate(SENTENCES) for x in (s, k + 1)])
    of = lambda s: F.coalesce(F.try_element_at(known, F.trim(F.regexp_replace(F.lower(s), SIGNS, " "))), F.lit(0))

    def by_lines(lines: Column) -> Column:
        first = F.greatest(F.size(lines) - LONGEST + 1, F.lit(2))
        end = lambda k: F.struct(k.alias("k"), of(F.array_join(F.slice(lines, k, F.lit(LONGEST)), " ")).alias("n"))
        ends = F.transform(F.sequence(first, F.size(lines)), end)
        above = lambda found: F.transform(F.slice(lines, F.lit(1), found[0]["k"] - 1), of)
        best = lambda found: F.when(F.size(found) > 0, F.concat(above(found), F.array(found[0]["n"]))).otherwise(F.transform(lines, of))
        return F.when(F.size(lines) < 2, F.array(F.lit(0))).otherwise(bind(F.filter(ends, lambda e: e["n"] > 0), best))

    def numbers(s: Column) -> Column:
        return bind(of(s), lambda n: F.when(n > 0, F.array(n)).otherwise(bind(F.split(s, BREAKS), by_lines)))

    return F.flatten(F.transform(F.split(text, ENDS), numbers))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rule, licence, sentences, first_sentence): one row per rule that a whole text matches.

    ``sentences`` lists the known sentences in order, unknown ones left out; ``first_sentence`` is where (from 0, all sentences
    counted) the first match of the rule begins. Rules go in order, and what one took no later one sees or bridges. Every row is
    scanned by itself: no shuffle, no limit, and a rule's repeats in a text count once. Null, empty and unmatched texts give no
    rows; repeated rows are listed as often; a null id stays null; no rows give no rows; texts are read whole, however long; other
    columns are not read, whatever their names.
    """
    text = F.col(text_col).cast("string")
    low = F.lower(text)
    cue = F.lit(False)
    for word in CUES:
        cue = cue | F.contains(low, F.lit(word))
    # Numbers are bound and pass a generator: no filter above it is pushed below, where it would split texts again.
    shaped = lambda n: F.struct(F.array_compact(F.transform(n, lambda x, i: F.when(x > 0, i))).alias("at"), F.filter(n, lambda x: x > 0).alias("seen"))
    told = F.filter(F.transform(F.array(sentence_numbers(text)), shaped), lambda t: F.size(t["seen"]) > 0)
    known = docs.where(cue).select(F.col(id_col).alias("doc_id"), F.inline(told))
    rules = F.array(*[
        F.struct(F.lit(k + 1).alias("rule"), F.lit(name).alias("licence"), F.lit(marked(ids)).alias("ids"), F.lit(taken(ids)).alias("off"), F.lit(0).alias("place"))
        for k, (name, ids) in enumerate(RULES)
    ])
    empty = F.filter(rules, lambda r: F.lit(False))
    left = F.concat(F.lit("|"), F.array_join(F.col("seen").cast("array<string>"), "||"), F.lit("|"))
    start = F.struct(left.alias("left"), empty.alias("found"))

    def step(acc: Column, r: Column) -> Column:
        head = F.split_part(acc["left"], r["ids"], F.lit(1))
        place = F.floor((F.length(head) - F.length(F.replace(head, F.lit("|"), F.lit("")))) / 2).cast("int")
        hit = F.struct(r["rule"].alias("rule"), r["licence"].alias("licence"), r["ids"].alias("ids"), r["off"].alias("off"), place.alias("place"))
        gone = F.struct(F.replace(acc["left"], r["ids"], r["off"]).alias("left"), F.array_append(acc["found"], hit).alias("found"))
        return F.when(F.contains(acc["left"], r["ids"]), gone).otherwise(acc)

    found = known.select("doc_id", "at", "seen", F.explode(F.aggregate(rules, start, step)["found"]).alias("r"))
    return found.select(
        "doc_id", F.col("r.rule").alias("rule"), F.col("r.licence").alias("licence"), F.array_join(F.col("seen").cast("array<string>"), "|").alias("sentences"),
        F.get("at", F.col("r.place")).cast("bigint").alias("first_sentence"),
    )


def _sql() -> str:
    known = ", ".join(f"'{s}': {k + 1}" for k, s in enumerate(SENTENCES))
    of = lambda s: f"coalesce(names[trim(regexp_replace(lower({s}), '{SIGNS}', ' ', 'g'))], 0)"
    steps, last = [], "s0"
    for k, (_, ids) in enumerate(RULES):
        steps.append(
            f"s{k + 1} AS (SELECT doc_id, at_, seen, contains(left_, '{marked(ids)}') AS m{k + 1}, split_part(left_, '{marked(ids)}', 1) AS head{k + 1}, "
            f"replace(left_, '{marked(ids)}', '{taken(ids)}') AS left_ {''.join(f', m{j}, head{j}' for j in range(1, k + 1))} FROM s{k})"
        )
        last = f"s{k + 1}"
    rows = " UNION ALL ".join(
        f"SELECT doc_id, {k + 1} AS rule, '{name}' AS licence, array_to_string(seen, '|') AS sentences, "
        f"CAST(at_[1 + (length(head{k + 1}) - length(replace(head{k + 1}, '|', ''))) // 2] AS BIGINT) AS first_sentence FROM {last} WHERE m{k + 1}"
        for k, (name, _) in enumerate(RULES)
    )
    return f"""
WITH known AS (SELECT MAP {{{known}}} AS names), cut AS (
  SELECT row_number() OVER () AS r, doc_id, names, unnest(string_split_regex(text, '{ENDS}')) AS s, unnest(range(len(string_split_regex(text, '{ENDS}')))) AS i
  FROM documents, known WHERE text IS NOT NULL
), lined AS (SELECT *, {of("s")} AS n, string_split_regex(s, '{BREAKS}') AS lines FROM cut
), ended AS (SELECT *, list_filter(list_transform(range(greatest(2, len(lines) - {LONGEST} + 1), len(lines) + 1),
    lambda k: {{'k': k, 'n': {of("array_to_string(lines[k:], ' ')")}}}), lambda x: x.n > 0) AS ends FROM lined
), told AS (SELECT r, doc_id, i, CASE WHEN n > 0 THEN [n] WHEN len(lines) < 2 THEN [0] 
    WHEN len(ends) > 0 THEN list_append(list_transform(lines[1:ends[1].k - 1], lambda x: {of("x")}), ends[1].n)
    ELSE list_transform(lines, lambda x: {of("x")}) END AS numbers FROM ended
), numbered AS (SELECT doc_id, flatten(list(numbers ORDER BY i)) AS numbers FROM told GROUP BY r, doc_id
), s0 AS (
  SELECT doc_id, list_filter(range(len(numbers)), lambda k: numbers[k + 1] > 0) AS at_, list_filter(numbers, lambda n: n > 0) AS seen,
    '|' || array_to_string(seen, '||') || '|' AS left_ FROM numbered WHERE len(list_filter(numbers, lambda n: n > 0)) > 0
), {', '.join(steps)}
{rows}"""


SQL = _sql()
