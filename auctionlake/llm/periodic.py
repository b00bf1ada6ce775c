"""Periodic runs of words by an online sparse diagonal dynamic program (operator 12)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, crc32


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers, equal words alike; those that occur once are -1."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    return np.where(np.bincount(ids, minlength=1)[ids] > 1, ids, -1) if len(ids) else ids


def doubled(names: np.ndarray, gap: int) -> np.ndarray:
    """Exact names of the blocks made of a block and the one ``gap`` words on; -1 where it occurs once or leaves the text."""
    out = np.full(len(names), -1, np.int64)
    if gap < len(names):
        at = np.flatnonzero((names[:-gap] >= 0) & (names[gap:] >= 0))
        if len(at):
            _, name, many = np.unique(names[at] * (names.max() + 1) + names[at + gap], return_inverse=True, return_counts=True)
            again = many[name] > 1
            out[at[again]] = name[again]
    return out


def near_repeats(names: np.ndarray, reach: int) -> np.ndarray:
    """Places whose block occurs again at most ``reach`` words before or after, ascending."""
    at = np.flatnonzero(names >= 0)
    at = at[np.argsort(names[at], kind="stable")]
    close = (np.diff(at) <= reach) & (np.diff(names[at]) == 0)
    mark = np.zeros(len(at), bool)
    mark[1:] |= close
    mark[:-1] |= close
    return np.sort(at[mark])


class Diagonals:
    """Match lengths along the lags of one range, over blocks of ``block`` words; ended diagonals of sufficient length become runs."""

    def __init__(self, block: int, low: int, high: int, least: int, found: dict[tuple[int, int], int]):
        self.block, self.low, self.high, self.least, self.found = block, low, high, least, found
        self.active: dict[int, list[int]] = {}  # lag -> [first place, last place known to match]
        self.ends: list[tuple[int, int]] = []

    def end(self, lag: int) -> None:
        first, last = self.active.pop(lag)
        match = last - first + self.block
        if match >= max(self.least - lag, lag):
            key = (first - lag, match + lag)
            self.found[key] = min(lag, self.found.get(key, lag))

    def close_before(self, place: int) -> None:
        """End the diagonals that did not reach the place before this one."""
        while self.ends and self.ends[0][0] < place - 1:
            _, lag = heapq.heappop(self.ends)
            if lag in self.active:
                last = self.active[lag][1]
                if last < place - 1:
                    self.end(lag)
                else:
                    heapq.heappush(self.ends, (last, lag))

    def match(self, place: int, lag: int, sure: int) -> None:
        """The blocks at ``place`` and ``lag`` before it are equal, and so are the next ``sure`` pairs."""
        own = self.active.get(lag)
        if own is None:
            self.active[lag] = [place, place + sure]
            heapq.heappush(self.ends, (place + sure, lag))
        else:
            own[1] = max(own[1], place + sure)

    def run(self, names: np.ndarray, zones: list[tuple[int, int]]) -> None:
        """Pass over the text once. ``zones`` are (first, last) places of blocks inside runs of at most half a block's period."""
        zone = np.full(len(names), -1, np.int64)
        for k, (first, last) in enumerate(zones):
            zone[first:last + 1] = k
        places = near_repeats(names, self.high)
        earlier: dict[int, list[int]] = {}
        starts: dict[int, list[int]] = {}
        for i, name, z in zip(places.tolist(), names[places].tolist(), zone[places].tolist(), strict=True):
            self.close_before(i)
            before = earlier.setdefault(name, [])
            opens = z >= 0 and zones[z][0] == i
            for j in reversed(before if z < 0 or opens else starts.get(name, ())):
                lag = i - j
                if lag > self.high:
                    break
                if lag > self.low:
                    if z < 0:
                        self.match(i, lag, 0)
                    elif (y := int(zone[j])) != z:
                        self.match(i, lag, min(zones[z][1] - i, zones[y][1] - j))
            before.append(i)
            if opens:
                starts.setdefault(name, []).append(i)
        for lag in list(self.active):
            self.end(lag)


def runs(words: list[bytes], least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of at least ``least`` words and twice its smallest period, sorted.

    Each word's earlier occurrences extend the match lengths of their lags, and a diagonal that ends long enough gives a run at
    once. A run of period q matches itself over at least max(least - q, q) words, so lags are taken in ranges of powers of two, and
    in each only places count whose block of that many words occurs before within the range. Blocks have exact names, doubled from
    range to range. A block that is not periodic itself has at most two such occurrences; inside a run of a short period, found in an
    earlier range, only the run's first place meets all others, and the match goes on to the nearer end of both runs at once. So the
    work stays near n log n also for one word repeated throughout. Two lags that give the same stretch keep the smaller, its
    smallest period.
    """
    found: dict[tuple[int, int], int] = {}
    names, width = numbered(words), 1
    half = max(1, (least + 1) // 2)
    while width * 2 <= half and (names >= 0).any():
        names, width = doubled(names, width), width * 2
    low, high = 0, 1 << (half - 1).bit_length()
    seeds = doubled(names, half - width) if half > width else names
    if (seeds >= 0).any():
        Diagonals(half, low, high, least, found).run(seeds, [])
    while width < high and (names >= 0).any():
        names, width = doubled(names, width), width * 2
    while 2 * high + 2 <= len(words) and (names >= 0).any():
        low, high = high, 2 * high
        zones = []
        if width >= least:
            zones = [(s, s + size - width) for (s, size), q in found.items() if size >= width and 2 * q <= width]
        Diagonals(width, low, high, least, found).run(names, zones)
        names, width = doubled(names, width), width * 2
    return sorted((start, size, lag) for (start, size), lag in found.items())


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words outside runs and in the first period of each, joined by blanks; a word goes if any run has it later on."""
    keep = np.ones(len(words), bool)
    for start, size, period in found:
        keep[start + period:start + size] = False
    return b" ".join([w for w, kept in zip(words, keep.tolist(), strict=True) if kept]) if found else b" ".join(words)


SHAPE = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12, rows: int = 512) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: its periodic runs by start and period, and the text without their repetitions.

    Rows are handled one by one, without a shuffle; repeated rows give repeated results and no rows give no rows. Null, empty and blank
    texts have no runs and an empty collapsed text. A null id stays null. Texts are read whole. No other column is read. ``rows`` bounds
    the rows of a batch that goes back to Spark.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                sizes, all_runs, texts = [], [], []
                for text in batch.column(1):
                    words = (text.as_py() or b"").split()
                    got = runs(words, least)
                    sizes.append(len(words))
                    all_runs.append([{"start": s, "length": n, "period": q} for s, n, q in got])
                    texts.append(collapsed(words, got).decode())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(all_runs, kind), pa.array(texts, pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return source.mapInArrow(find, SHAPE)


def with_loops(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document, by the crc32 of its id, goes round in a loop from some word on. A null id is left alone."""
    h = crc32(F.col("doc_id"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), BLANKS), lambda w: w != "")
    loop = F.col("doc_id").isNotNull() & (h % 10 == 0)
    split = docs.select("doc_id", "text", F.when(loop, words).alias("words"), F.floor(h / 10).alias("g"))
    n = F.size("words")
    some = split.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    cut = some.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    turned = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", F.col("a") + (i - F.col("a")) % F.col("p"))))
    return cut.select("doc_id", F.when(n > 0, F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The longest run of each document and checksums of all its runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    told = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.array_join(lines, "").alias("lines"), "collapsed")
    return told.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
