"""Spelling variants: words one edit apart, by bit-sliced position indexes (operator 11)."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, staged, write

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def tallied(text: bytes, doc_id: int | None, shortest: int, damage: int | None, counts: Counter) -> None:
    """Add the words of one text. With ``damage``, every run whose checksum with the id that number divides loses a letter."""
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, many in Counter(RUN.findall(text.lower().decode())).items():
        if len(word) < shortest:
            continue
        if damage:
            h = zlib.crc32(word.encode(), head)
            if h % damage == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1:]
                if len(word) < shortest:
                    continue
        counts[word] += many


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 6, fewest: int = 5, damage: int | None = None, kept: int = 200_000) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, of ``shortest`` code points and ``fewest`` occurrences at least.

    Tasks add up what they meet and send sums on when ``kept`` distinct words (or a tenth of that in kB of text) are reached, so a word
    with a third of all occurrences crosses the shuffle as a few rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        room = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_py()
                if data:
                    tallied(data, doc_id, shortest, damage, counts)
                    room += len(data)
                    if len(counts) >= kept or room >= 100 * kept and sum(map(len, counts)) >= 100 * kept:
                        yield out()
                        counts.clear()
                        room = 0
                    elif room >= 100 * kept:
                        room = sum(map(len, counts))
        if counts:
            yield out()

    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return source.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


class PositionIndex:
    """Per (position, letter) the set of words with that letter there, as one big integer; bit k is the k-th most frequent word."""

    def __init__(self, words: list[str], keys: list[int]):
        self.words = words
        self.slices: dict[tuple[int, str], int] = defaultdict(int)
        self.long: dict[int, int] = defaultdict(int)
        self.groups: dict[int, int] = defaultdict(int)
        for k, (word, key) in enumerate(zip(words, keys, strict=True)):
            bit = 1 << k
            self.long[len(word)] |= bit
            self.groups[key] |= bit
            for i, letter in enumerate(word):
                self.slices[i, letter] |= bit

    def near(self, word: str, key: int, shorter: int, suffix: bool) -> int:
        """The words of the key's group exactly one edit away, as bits.

        After i letters of ``word`` four sets hold the words that agree so far: without an error, with one letter replaced, with
        one letter more (their next letters are looked up one position later) and with one letter less (one position earlier).
        In the group of a suffix those are left out whose prefix is also equal: the prefix's group has them.
        """
        at, none = self.slices.get, 0
        zero = self.groups.get(key, 0)
        replaced = longer = briefer = same_prefix = 0
        for i, letter in enumerate(word):
            if i == shorter // 2:
                same_prefix = zero
            here = at((i, letter), none)
            longer = (longer | zero) & at((i + 1, letter), none)
            briefer = briefer & at((i - 1, letter), none) | zero
            replaced = replaced & here | zero & ~here
            zero &= here
        size = len(word)
        if size == shorter:
            found = replaced & self.long.get(size, 0) | (longer | zero) & self.long.get(size + 1, 0)
        else:
            found = briefer & self.long.get(size - 1, 0)
        return found & ~same_prefix if suffix else found


def near_words(words: DataFrame, shortest: int = 6, block: int = 4096) -> DataFrame:
    """(word, n_near, best_n, best): the words one edit apart are counted, and of them the most frequent named (ties: the least).

    An edit leaves the first half of the shorter word's length or its rest as it is. So each word joins four groups, by prefix and
    by suffix, once as the shorter and once as the longer of a pair; every pair meets there, and exactly once. Groups share tasks by
    hash. A group of more than ``block`` words is split: each task holds the index of one block, and the group's words pass over
    all its blocks. What leaves is one row per word and group, never the pairs.
    """
    size = F.length("word")
    sides = []
    for less in (0, 1):
        short = size - less
        half = F.floor(short / 2).cast("int")
        for suffix, part in ((False, F.substring("word", F.lit(1), half)), (True, F.substring("word", size - (short - half) + 1, short - half))):
            named = F.struct(F.xxhash64(F.lit(suffix), short, part).alias("key"), short.alias("shorter"), F.lit(suffix).alias("suffix"))
            sides.append(F.when(short >= shortest, named))
    placed = words.select("word", "n", F.explode(F.array_compact(F.array(*sides))).alias("side")).select("word", "n", "side.*")
    crowded = placed.groupBy("key").agg(F.count("*").alias("many")).where(F.col("many") > block)
    parts = F.coalesce(F.ceil(F.col("many") / block), F.lit(1)).cast("int")
    dealt = placed.join(crowded, "key", "left").withColumns({"parts": parts, "own": F.pmod(F.xxhash64("word"), parts).cast("int")})
    tasks = max(1, words.count() * 4 // (2 * block))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    task = F.when(F.col("parts") > 1, F.xxhash64("key", "part")).otherwise(F.pmod("key", F.lit(tasks)))

    def find(group: pd.DataFrame) -> pd.DataFrame:
        members = group[group["own"] == group["part"]].sort_values(["n", "word"], ascending=[False, True])
        index = PositionIndex(members["word"].tolist(), members["key"].tolist())
        often, out = members["n"].tolist(), []
        for word, key, shorter, suffix in zip(*(group[c].tolist() for c in ("word", "key", "shorter", "suffix")), strict=True):
            bits = index.near(word, key, shorter, suffix)
            if bits:
                first = (bits & -bits).bit_length() - 1
                out.append((word, bits.bit_count(), often[first], index.words[first]))
        return pd.DataFrame(out, columns=["word", "n_near", "best_n", "best"])

    shape = "word string, n_near bigint, best_n bigint, best string"
    found = dealt.select("word", "n", "key", "shorter", "suffix", "own", "part", task.alias("task")).groupBy("task").applyInPandas(find, shape)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    one = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("top"))
    return one.select("word", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.word").alias("best"))


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form: forms followed to the last, twice as far in each round."""
    spark = forms.sparkSession
    path = write(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        now = spark.read.parquet(path)
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if now.join(onward, "root", "left_semi").isEmpty():
            return now
        new = write(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        drop(spark, path)
        path = new


def variants(words: DataFrame, shortest: int = 6, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words`` (word, n; words are distinct).

    A word's form is the most frequent word one edit away (ties: the least in code-point order) if that is at least ``times`` as
    frequent; root follows forms to the end. No rows give no rows; words under ``shortest`` code points must not be there. Other
    columns are not read.
    """
    words = staged(words.select("word", "n"), "words")
    near = near_words(words, shortest)
    joined = words.join(near, "word", "left")
    is_form = F.col("best_n") >= F.col("n") * times
    joined = staged(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "forms")
    roots = rooted(joined.where("form is not null"))
    return joined.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int | None = None) -> DataFrame:
    """``variants`` of the vocabulary of ``docs``. Null, empty and letterless texts add no words; rows that repeat count as often; a
    null id stands for the empty text in the checksum of ``damage``. Texts are read whole. Other columns are not read."""
    return variants(vocabulary(docs, id_col, text_col, damage=damage))
