"""Near-duplicate documents by MinHash bands, signatures and exact shingle sets (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, kept_in_worker, make_room, staged, text_key
from .components import components

#: Odd multipliers of the shingle hash.
MIX = np.asarray([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class WordHashes(dict):
    """64-bit hashes of words, each computed once per worker; starts again from empty at ``kept`` words. Long words are not kept,
    so that the table holds some 20 MB at most."""

    kept, longest = 120_000, 40

    def __missing__(self, word: bytes) -> int:
        if len(word) > self.longest:
            return xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.kept:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


@kept_in_worker(1)
def word_hashes() -> WordHashes:
    return WordHashes()


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's shingles of ``width`` words; of all its words if it has fewer."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))
    span = min(width, len(words))
    out = np.full(len(words) - span + 1, span, np.uint64)
    for k in range(span):
        out = (out ^ hashes[k:len(words) - span + 1 + k]) * MIX[0]
        out ^= out >> np.uint64(29)
    out *= MIX[1]
    out ^= out >> np.uint64(32)
    return np.unique(out)


def class_of(found: np.ndarray) -> int:
    """One number per shingle set: equal sets share it."""
    if not len(found):
        return 0
    parts = (len(found), int(found.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(found * MIX[2])))
    return xxhash.xxh3_64_intdigest(np.asarray(parts, np.uint64).tobytes()) - (1 << 63)


@lru_cache(maxsize=4)
def functions(many: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of universal hash functions x -> a x + b modulo 2^64."""
    rng = np.random.default_rng(seed)
    draw = lambda: rng.integers(0, 1 << 63, (many, 1), np.uint64) * np.uint64(2)
    return draw() + np.uint64(1), draw() + rng.integers(0, 2, (many, 1)).astype(np.uint64)


def minima(found: np.ndarray, many: int, seed: int) -> np.ndarray:
    """The least value of each hash function over a whole set."""
    a, b = functions(many, seed)
    least = np.full(many, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), 1024):
        values = a * found[k:k + 1024]
        values += b
        np.minimum(least, values.min(axis=1), out=least)
    return least


def signatures(docs: DataFrame, width: int, bands: int, rows: int, seed: int) -> DataFrame:
    """(doc_id, row_key, n, cls, bands, sig): set size, class of equal sets, band keys, and one byte of each minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(word_hashes)
        for batch in batches:
            sizes, classes, keys, sigs = [], [], [], []
            for text in batch.column("text"):
                found = shingles(text.as_py(), width)
                least = minima(found, bands * rows, seed)
                sizes.append(len(found))
                classes.append(class_of(found))
                tops = (least >> np.uint64(32)).astype("<u4")
                keys.append([xxhash.xxh3_64_intdigest(tops[k * rows:(k + 1) * rows].tobytes(), k) - (1 << 63) for k in range(bands)] if len(found) else [])
                sigs.append((tops & 0xFF).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                ["doc_id", "row_key", "n", "cls", "bands", "sig"],
            )

    return docs.mapInArrow(run, "doc_id bigint, row_key string, n bigint, cls bigint, bands array<bigint>, sig binary")


def alike(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Estimated similarity of signatures, row by row, with chance agreement of bytes taken out."""
    return ((left == right).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def promising(pairs: DataFrame, classes: DataFrame, percent: int, least: float) -> DataFrame:
    """Pairs of classes whose set sizes allow the similarity and whose signatures come near it, with the set size of the second."""
    one = classes.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    two = classes.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))

    @F.pandas_udf("double")
    def estimate(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        both = [np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (x, y)]
        return pd.Series(alike(*both))

    sized = pairs.join(one, "a").join(two, "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    return sized.where(estimate("sig_a", "sig_b") >= least).select("a", "b", "n_b")


def full_sets(classes: DataFrame, wanted: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(cls, found): the whole shingle sets of the classes wanted, computed again from one member's text."""
    keys = classes.join(wanted.select("cls").distinct(), "cls", "left_semi").select("row_key").distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(word_hashes)
        for batch in batches:
            found = [shingles(x.as_py(), width) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array([class_of(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["cls", "found"])

    return docs.join(keys, "row_key", "left_semi").select("doc_id", "text").mapInArrow(sets, "cls bigint, found binary")


#: Shingles that the sets of a group hold together, about: 4 MB.
MOST = 1 << 19


def parts(rows: str, sizes: str, block: int, most: int) -> Column:
    """Into how many parts to deal sets, so that each holds about ``block`` of them and ``most`` shingles."""
    return F.greatest(F.ceil(F.count(rows) / block), F.ceil(F.sum(sizes) / most))


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    at = np.searchsorted(x, y)
    both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int, block: int = 256, most: int = MOST) -> DataFrame:
    """Those pairs (a, b, n_b: size of b) whose full shingle sets are similar enough.

    Sets are sent to groups of one class and up to about ``block`` partners of ``most`` shingles in all: a class with very many partners,
    or long ones, is spread over many tasks.
    """
    degree = pairs.groupBy("a").agg(parts("*", "n_b", block, most).alias("d"))
    placed = pairs.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), "d").alias("salt"))
    members = placed.select("a", "salt", F.col("b").alias("cls")).union(placed.select("a", "salt", F.col("a").alias("cls")).distinct())

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        own = {c: np.frombuffer(x, np.uint64) for c, x in zip(group["cls"], group["found"], strict=True)}
        hub = own.pop(key[0])
        return pd.DataFrame([(key[0], c) for c, x in own.items() if linked(hub, x, percent)], columns=["a", "b"]).astype("int64")

    full = full_sets(classes, members, docs, width)
    return members.join(full, "cls").groupBy("a", "salt").applyInPandas(compare, "a bigint, b bigint")


def candidates(group: pd.DataFrame, percent: int, least: float) -> Iterator[tuple[int, int]]:
    """Row numbers of promising pairs of a task's buckets: of different components, in the first bucket that both share."""
    key, block, n, label = (group[c].to_numpy() for c in ("key", "own", "n", "label"))
    low, high = group["low"].iloc[0], group["high"].iloc[0]
    sig = np.frombuffer(b"".join(group["sig"]), np.uint8).reshape(len(group), -1)
    bands = np.stack(group["bands"].to_list())
    order = np.argsort(key, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        left, right = rows[block[rows] == low], rows[block[rows] == high]
        for i in left:
            js = right[label[right] != label[i]]
            js = js[np.minimum(n[js], n[i]) * 100 >= np.maximum(n[js], n[i]) * percent]
            if low == high:
                js = js[js > i]
            js = js[alike(sig[js], sig[i]) >= least] if len(js) else js
            if len(js):
                same = bands[js] == bands[i]
                js = js[bands[i][same.argmax(axis=1)] == key[i]]
            for j in js:
                yield int(i), int(j)


def crossing(
    bands: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int, least: float, block: int = 512,
    most: int = MOST,
) -> DataFrame:
    """Links between classes that share a bucket (key, cls, n: set size) but not a component yet.

    Buckets inside one component, however large, are left out. The others are cut into blocks of up to about ``block`` classes and
    ``most`` shingles, and each two blocks of a bucket meet in a task of their own (small buckets share tasks, up to about the same sizes). There signatures are compared as matrices; what leaves are the
    classes of promising pairs, not the pairs. Where their full sets meet again in the same way, the pairs are checked exactly,
    and only links leave.
    """
    label = F.coalesce("component", "cls")
    marked = bands.join(labels.select(F.col("node").alias("cls"), "component"), "cls", "left").select("key", "cls", "n", label.alias("label"))
    mixed = marked.groupBy("key").agg(parts("*", "n", block, most).alias("blocks"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    cut = marked.join(mixed.select("key", "blocks"), "key").withColumn("own", F.pmod(F.xxhash64("cls"), "blocks"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    dealt = staged(dealt.select(
        "key", "cls", "n", "label", "own", "blocks", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    ), "dealt")
    small = dealt.where("blocks = 1").agg(F.greatest(F.ceil(F.count("*") / (2 * block)), F.ceil(F.sum("n") / most))).first()[0]
    tasks = max(1, small or 0)
    where = F.when(F.col("blocks") > 1, F.col("key")).otherwise(F.pmod("key", F.lit(tasks)))
    traits = classes.select("cls", "sig", "bands")
    met = dealt.withColumn("task", where).join(traits, "cls")

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        rows = sorted({k for pair in candidates(group, percent, least) for k in pair})
        return group.iloc[rows][["key", "cls", "label", "own", "low", "high", "task", "n", "sig", "bands"]]

    shape = "key bigint, cls bigint, label bigint, own bigint, low bigint, high bigint, task bigint, n bigint, sig binary, bands array<bigint>"
    members = staged(met.groupBy("task", "low", "high").applyInPandas(meet, shape), "members")

    def check(group: pd.DataFrame) -> pd.DataFrame:
        found, cls, label = [np.frombuffer(x, np.uint64) for x in group["found"]], group["cls"].to_numpy(), group["label"].to_numpy()
        joined: dict[int, int] = {}

        def root(x: int) -> int:
            while joined.get(x, x) != x:
                x = joined[x]
            return x

        out = []
        for i, j in candidates(group, percent, least):
            one, two = root(label[i]), root(label[j])
            if one != two and linked(found[i], found[j], percent):
                joined[one] = two
                out.append((cls[i], cls[j]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    full = full_sets(classes, members, docs, width)
    return members.join(full, "cls").groupBy("task", "low", "high").applyInPandas(check, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 85,
    bands: int = 30, rows: int = 6, seed: int = 11, slack: float = 0.15,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, row_key, first) of every row.

    Documents are linked if their sets of ``width``-word shingles have a Jaccard similarity of ``percent`` or more; a pair at
    exactly 0.85 misses all of 30 bands of 6 minima with probability 7e-7. Documents with equal sets are one class; classes
    go on alone. In each bucket all classes are first paired with the least one, checked by signatures (up to ``slack`` below the
    threshold, over five standard errors) and by full sets, and joined to components. Then the pairs of a bucket that are
    still in different components are checked in the same way, so no link between components is lost.

    Two more columns follow: ``row_key``, 128 bits of the id and the text, and ``first``, true for the row that stands for its
    component: that of least id (nulls last), then of least key. Rows that repeat an id and a text share both.

    Null, empty and blank texts have no shingles and are linked with nothing. Rows that repeat an id and a text are listed as often
    and share a component. A null id is linked like any other; component_id is null where no row of the component has an id, and
    such rows are all kept (``first`` chooses one). Other columns are not read; no rows give no rows.
    """
    bounded_batches(docs.sparkSession)
    least = percent / 100 - slack
    ident, text = F.col(id_col).cast("bigint"), F.col(text_col).cast("string")
    source = docs.select(ident.alias("doc_id"), text_key(ident, text).alias("row_key"), text.cast("binary").alias("text"))
    signed = staged(signatures(source, width, bands, rows, seed), "signatures")
    lead = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("row_key").alias("row_key"))
    heads = signed.where("n > 0").groupBy("cls").agg(F.min(lead).alias("lead"))
    classes = staged(
        signed.join(heads, "cls").where(F.col("row_key") == F.col("lead.row_key")).select("cls", "lead", "row_key", "n", "bands", "sig").dropDuplicates(["cls"]),
        "classes",
    )
    every = classes.select("cls", "n", F.explode("bands").alias("key"))
    shared = every.groupBy("key").agg(F.min("cls").alias("hub"), F.count("*").alias("many")).where("many > 1")
    buckets = staged(every.join(shared, "key").select("key", "cls", "n", "hub"), "buckets")
    stars = staged(buckets.where("cls <> hub").select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct(), "stars")
    links = staged(verified(promising(stars, classes, percent, least), classes, source, width, percent), "links")
    labels = staged(components(links), "labels")
    more = staged(crossing(buckets.select("key", "cls", "n"), labels, classes, source, width, percent, least), "links")
    labels = components(links.union(more))
    named = classes.select("cls", "lead").join(labels.withColumnRenamed("node", "cls"), "cls", "left")
    named = named.select("cls", "lead", F.coalesce("component", "cls").alias("component"))
    leads = named.groupBy("component").agg(F.min("lead").alias("lead"))
    names = named.select("cls", "component").join(leads, "component").select(
        F.col("cls").alias("own"), F.col("lead.doc_id").alias("component_id"), F.col("lead.row_key").alias("lead_key")
    )
    full = signed.select("doc_id", "row_key", "n", F.when(F.col("n") > 0, F.col("cls")).alias("own")).join(names, "own", "left")
    component = F.when(F.col("own").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return full.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"),
        "row_key", F.coalesce(F.col("row_key") == F.col("lead_key"), F.lit(True)).alias("first"),
    )
