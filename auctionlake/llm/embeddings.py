"""Near-duplicate vectors by spherical-cap filters from random product codes (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .components import components


@lru_cache(maxsize=4)
def code(dim: int, blocks: int, words: int, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A random rotation, and for each block of its coordinates so many random unit vectors, scaled so that every choice of
    one word per block is a unit vector: words ** blocks filter directions."""
    rng = np.random.default_rng((seed, dim))
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    parts = []
    for own in np.array_split(np.arange(dim), blocks):
        w = rng.standard_normal((words, len(own)))
        parts.append(w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-300) / np.sqrt(blocks))
    return turn, parts


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows in double precision and of length one, first scaled by their largest number against overflow."""
    m = rows.astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def filters(unit: np.ndarray, blocks: int, words: int, bound: float, seed: int) -> list[np.ndarray]:
    """For each unit vector the ascending numbers of all filter directions whose inner product with it is ``bound`` or more.

    List decoding: partial sums over the first blocks are dropped as soon as the best words of the others cannot lift
    them to the bound, so the work is near the number of filters found, not of all filters.
    """
    turn, parts = code(unit.shape[1], blocks, words, seed)
    turned, at, scores = unit @ turn, 0, []
    for w in parts:
        scores.append(turned[:, at:at + w.shape[1]] @ w.T)
        at += w.shape[1]
    best = np.stack([s.max(axis=1) for s in scores], axis=1)
    rest = np.cumsum(best[:, ::-1], axis=1)[:, ::-1]
    out = []
    for i in range(len(unit)):
        names, sums = np.zeros(1, np.int64), np.zeros(1)
        for k, s in enumerate(scores):
            left = rest[i, k + 1] if k + 1 < blocks else 0.0
            total = sums[:, None] + s[i][None, :]
            x, y = np.nonzero(total + left >= bound)
            names, sums = names[x] * words + y, total[x, y]
        out.append(np.sort(names))
    return out


def cap(dim: int, directions: int, expected: float) -> float:
    """The bound that a random vector reaches for ``expected`` of the directions on average."""
    return NormalDist().inv_cdf(1 - min(0.5, expected / directions)) / np.sqrt(dim)


def _missed(dim: int, blocks: int, words: int, expected: float, least: float, seed: int, pairs: int) -> tuple[float, float]:
    """(bound, share of pairs at cosine ``least`` that no filter of one code holds together), measured with ``filters`` on random
    pairs over several codes; of the share the upper end of what so many pairs can tell."""
    rng = np.random.default_rng((seed, dim, words))
    x, turn = (rng.standard_normal((pairs, dim)) for _ in range(2))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn -= (turn * x).sum(axis=1, keepdims=True) * x
    turn /= np.maximum(np.linalg.norm(turn, axis=1, keepdims=True), 1e-300)
    y = least * x + np.sqrt(max(0.0, 1 - least * least)) * turn if dim > 1 else x
    bound = cap(dim, words**blocks, expected)
    while bound > 1e-3 and np.mean([len(f) for f in filters(x[:500], blocks, words, bound, seed)]) < expected:
        bound *= 0.98
    missed = 0
    for k, at in enumerate(np.array_split(np.arange(pairs), 10)):
        sides = (filters(side[at], blocks, words, bound, seed + 1000 + k) for side in (x, y))
        missed += sum(len(np.intersect1d(a, b, assume_unique=True)) == 0 for a, b in zip(*sides, strict=True))
    return float(bound), min(0.95, (missed + 2 * np.sqrt(missed) + 2) / pairs)


@lru_cache(maxsize=16)
def chosen(dim: int, blocks: int, share: float, least: float, miss: float, seed: int, pairs: int = 2000) -> tuple[int, float, int]:
    """(words, bound, codes) with the fewest caps a vector, such that a cap holds about ``share`` of all vectors and two vectors at
    cosine ``least`` have no cap in common with chance ``miss`` at most.

    A code's rotation is uniform, so any pair of that cosine is missed by a code as often as random ones are, whatever the
    data; codes are independent, so their chances multiply. Many codes with few caps each come near independent directions and need
    far fewer caps than few codes with many, whose directions share block words.
    """
    best: tuple[float, int, float, int] | None = None
    for expected in (2, 3, 4, 6, 8, 12):
        words = max(2, int(np.ceil((expected / share) ** (1 / blocks))))
        bound, missed = _missed(dim, blocks, words, expected, least, seed, pairs)
        codes = max(1, int(np.ceil(np.log(miss) / np.log(missed))))
        if best is None or expected * codes < best[0]:
            best = expected * codes, words, bound, codes
    return best[1:]


def near_vectors(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93,
    blocks: int = 2, fill: int = 100, seed: int = 5, block: int = 512, miss: float = 0.001,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Rows are linked if their labels are equal and their cosine in double precision is ``least`` or more. Equal vectors of a label
    are one class that goes on alone with its number of rows. Each class is decoded to all filters whose cap it lies
    in; directions grow with the largest label so that a cap holds about ``fill`` classes of it (an eighth of a small label). Near
    vectors share fewer caps when caps are smaller, so the number of directions follows from the wanted ``miss`` and the share of a
    cap (``chosen``): about 20 caps a vector for small labels, 35 for labels of a million. Classes meet in
    the filters they share, larger ones cut into blocks of which each two meet in a task of their own, and each pair is
    checked in the first filter both share. Vectors travel as they are stored and are widened to doubles where they meet. Tasks
    return counts per class and the links that join components, not pairs.

    Vectors that are null, zero or hold null or non-finite numbers, and rows without a label or id, link with nothing and are kept.
    Rows that repeat an id count as vectors of their own. Other columns are not read; no rows give no rows.
    """
    kind = "array<float>" if rows.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    vector = F.col(vector_col).cast(kind)
    good = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    taken = rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"), vector.alias("v")).withColumn("good", F.coalesce(good, F.lit(False)))
    keyed = taken.withColumn("cls", F.when(F.col("good"), F.xxhash64("label", "v")))
    classes = staged(
        keyed.where("good").groupBy("label", "v").agg(F.min("vec_id").alias("head"), F.count("*").alias("copies")).select("label", "v", F.size("v").alias("dim"), "head", "copies", F.xxhash64("label", "v").alias("cls")),
        "vectors",
    )
    largest = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 1
    share = min(1 / 8, fill / largest)
    plans = {r["dim"]: chosen(r["dim"], blocks, share, least, miss, seed) for r in classes.select("dim").distinct().collect()}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy(zero_copy_only=False)
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            first = np.cumsum(dims) - dims
            names: list[np.ndarray] = [np.empty(0, np.int64)] * len(dims)
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                m = unit(values[first[own][:, None] + np.arange(dim)])
                words, bound, codes = plans[int(dim)]
                of_code = [filters(m, blocks, words, bound, seed + k) for k in range(codes)]
                for i, *found in zip(own, *of_code, strict=True):
                    names[i] = np.concatenate([f + k * words**blocks for k, f in enumerate(found)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.list_(pa.int64()))], ["cls", "names"])

    names = staged(classes.select("cls", "v", "dim").mapInArrow(decode, "cls bigint, names array<bigint>"), "caps")
    traits = classes.select("cls", "label", "dim", "v", "copies").join(names, "cls")
    members = classes.select("cls", "label", "dim").join(names, "cls").select("cls", "label", "dim", F.explode("names").alias("name"))
    many = members.groupBy("label", "dim", "name").agg(F.count("*").alias("many")).where("many > 1")
    cut = members.join(many, ["label", "dim", "name"]).withColumn("blocks", F.ceil(F.col("many") / block)).withColumn("own", F.pmod(F.xxhash64("cls"), "blocks"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    dealt = dealt.select("cls", "name", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    met = dealt.join(traits, "cls").withColumn("names", F.filter("names", lambda x: x < F.col("name")))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        own, cls, copies = (group[c].to_numpy() for c in ("own", "cls", "copies"))
        low, high = (group[c].iloc[0] for c in ("low", "high"))
        m = unit(np.stack(group["v"].to_list()))
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        hit = m[left] @ m[right].T >= least
        if low == high:
            hit = np.triu(hit, 1)
        i, j = np.nonzero(hit)
        if len(i):  # of the filters that both share, this must be the first
            listed, kinds, many = np.unique(np.concatenate(group["names"].to_list()), return_inverse=True, return_counts=True)
            of = np.repeat(np.arange(len(group)), group["names"].map(len))
            shared = np.cumsum(many > 1) - 1  # names that one row alone has tell nothing
            of, kinds = of[many[kinds] > 1], shared[kinds[many[kinds] > 1]]
            earlier = np.zeros(len(i), bool)
            for at in range(0, int((many > 1).sum()), 4096):  # some names at a time
                here = (kinds >= at) & (kinds < at + 4096)
                before = np.zeros((len(group), 4096), np.float32)
                before[of[here], kinds[here] - at] = 1
                earlier |= (before[left] @ before[right].T)[i, j] > 0
            i, j = left[i[~earlier]], right[j[~earlier]]
        n = np.bincount(i, copies[j], len(group)) + np.bincount(j, copies[i], len(group)) if len(i) else np.zeros(len(group))
        joined: dict[int, int] = {}

        def root(x: int) -> int:
            while joined.get(x, x) != x:
                x = joined[x]
            return x

        links = []
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            one, two = root(a), root(b)
            if one != two:
                joined[one] = two
                links.append((cls[a], cls[b], 0))
        some = np.flatnonzero(n)
        return pd.DataFrame([*((cls[k], cls[k], int(n[k])) for k in some), *links], columns=["a", "b", "n"]).astype("int64")

    found = staged(met.groupBy("label", "dim", "name", "low", "high").applyInPandas(meet, "a bigint, b bigint, n bigint"), "links")
    counts = found.groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("others"))
    labels = components(found.select("a", "b")).withColumnRenamed("node", "cls")
    named = classes.select("cls", "head", "copies").join(labels, "cls", "left").select("cls", "head", "copies", F.coalesce("component", "cls").alias("component"))
    least_ids = named.groupBy("component").agg(F.min("head").alias("component_id"))
    whole = named.join(least_ids, "component").join(counts, "cls", "left").select("cls", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    own = keyed.select("vec_id", "cls").join(whole, "cls", "left")
    component = F.coalesce("component_id", "vec_id").cast("bigint")
    return own.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
