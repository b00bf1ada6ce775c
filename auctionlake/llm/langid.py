"""Language identification in two levels: family, then one-versus-one linear support vector machines (operator 6)."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, crc32, make_room

#: Language families by ISO 639-1 code. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}

DIMS, ORDERS = 4096, (1, 2, 3, 4)
LETTER = r"\p{L}"
#: ASCII bytes other than letters become blanks; bytes of other scripts stay.
SHOWN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def profile(text: str) -> np.ndarray:
    """Square roots of relative frequencies of hashed byte n-grams of a whole text, so that the vector has length one."""
    b = np.frombuffer((" ".join(text.lower().encode("utf-8", "replace").translate(SHOWN).decode("utf-8", "replace").split()) + " ").encode(), np.uint8).astype(np.uint32)
    counts, h = np.zeros(DIMS), np.zeros(len(b) + 1, np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(b) < n:
            break
        h = (h[:len(b) - n + 1] * np.uint32(0x01000193)) ^ b[n - 1:]
        if n in ORDERS:
            mixed = (h * np.uint32(0x9E3779B1)) >> np.uint32(20)
            counts += np.bincount(mixed, minlength=DIMS)[:DIMS] / (len(b) - n + 1)
    return np.sqrt(counts / max(1e-12, counts.sum())).astype(np.float32)


def machine(x: np.ndarray, y: np.ndarray, cost: float = 20.0, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine (squared hinge) by accelerated gradient descent; classes weigh the same."""
    return machine_of(np.hstack([x, np.ones((len(x), 1), np.float32)]), y, cost, rounds)


def machine_of(x: np.ndarray, y: np.ndarray, cost: float = 20.0, rounds: int = 150) -> tuple[np.ndarray, float]:
    """The same of vectors whose last component is 1."""
    each = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32) * cost
    w = v = np.zeros(x.shape[1], np.float32)
    step, t = 1 / (1 + 2 * cost * 2), 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (v - 2 * (x.T @ (each * y * slack)))
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        w, v = new, new + (before - 1) / t * (new - w)
    return w[:-1].astype(np.float32), float(w[-1])


def snippets(text: str) -> list[str]:
    """A training text whole, and short pieces of it, so that short texts are met in training."""
    mid = len(text) // 2
    return [text, *(s for s in (text[mid:mid + 40], text[mid // 2:mid // 2 + 120]) if regex.search(LETTER, s))]


def sampled(docs: DataFrame, most: int) -> DataFrame | None:
    """At most ``most`` lettered rows of each language from rows (lang, text, doc_id), those of least hash of id and text; none if
    nothing is labelled. A bound on the hash from the language's size keeps all but some of them from moving."""
    sizes = docs.where("lang is not null").groupBy("lang").agg(F.count("*").alias("rows")).collect()  # as many as the labels to learn
    if not sizes:
        return None
    rows_of = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], r["rows"])])
    hashed = docs.where("lang is not null").withColumns({"rows": F.try_element_at(rows_of, F.col("lang")), "hash": F.xxhash64("doc_id", "text")})
    share = F.col("hash").cast("double") / 2.0**64 + 0.5  # even between 0 and 1, so about four times ``most`` rows go on
    few = hashed.where((share < 4 * most / F.col("rows")) & F.col("text").rlike(LETTER))
    rank = Window.partitionBy("lang").orderBy("hash", "doc_id")
    return few.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= most)


def train(docs: DataFrame, most: int = 300) -> list[tuple[str, str, str, bytes, float]]:
    """Machines (level, one, two, weights, bias) from rows (lang, text, doc_id): level "" tells families apart, others languages.

    At most ``most`` rows of each language are used (``sampled``). Each level is trained in a task of
    its own; what reaches the driver is one weight vector of 4,096 numbers per pair.
    """
    sample = sampled(docs, most)
    if sample is None:
        return []
    known = F.create_map(*[F.lit(x) for pair in FAMILY.items() for x in pair])
    family = F.coalesce(F.get(F.array(known[F.col("lang")]), F.lit(0)), F.col("lang"))
    rows = sample.select("text", F.explode(F.array(
        F.struct(F.lit("").alias("level"), family.alias("label")), F.struct(family.alias("level"), F.col("lang").alias("label")),
    )).alias("at")).select("text", "at.level", "at.label")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        make_room()
        made = [(label, s) for text, label in zip(group["text"], group["label"], strict=True) for s in snippets(text)]
        x, labels = np.ones((len(made), DIMS + 1), np.float32), np.asarray([k for k, _ in made])
        for k, (_, s) in enumerate(made):
            x[k, :DIMS] = profile(s)
        out = []
        for one, two in combinations(sorted(set(labels)), 2):
            mine = (labels == one) | (labels == two)
            w, b = machine_of(x if mine.all() else x[mine], np.where(labels[mine] == one, 1, -1).astype(np.float32))
            out.append((group["level"].iloc[0], one, two, w.tobytes(), b))
        return pd.DataFrame(out or [(group["level"].iloc[0], labels[0], labels[0], b"", 0.0)], columns=["level", "one", "two", "w", "b"])

    made = rows.groupBy("level").applyInPandas(fit, "level string, one string, two string, w binary, b double").collect()
    return sorted((r["level"], r["one"], r["two"], bytes(r["w"]), r["b"]) for r in made)


def decide(margins: dict[tuple[str, str], float]) -> tuple[str, float]:
    """The label with most wins over the others, then the largest sum of margins; its confidence from its least margin."""
    wins: dict[str, list[float]] = {}
    for (one, two), m in margins.items():
        wins.setdefault(one, []).append(m)
        wins.setdefault(two, []).append(-m)
    best = max(sorted(wins), key=lambda k: (sum(m > 0 for m in wins[k]), sum(wins[k])))
    return best, float(1 / (1 + np.exp(-4 * min(wins[best]))))


def predictor(machines: list[tuple[str, str, str, bytes, float]]):
    """A column function: text -> (lang, score), from the whole text alone. ``und`` and 0 for null or letterless texts."""
    pairs = [(level, one, two) for level, one, two, *_ in machines]
    weights = np.stack([np.frombuffer(w, np.float32) if w else np.zeros(DIMS, np.float32) for *_, w, _ in machines]) if machines else None
    bias = np.asarray([b for *_, b in machines])
    letter = LETTER

    def one_text(text: str | None) -> tuple[str, float]:
        if not machines or text is None or not regex.search(letter, text):
            return "und", 0.0
        margin = weights @ profile(text) + bias
        level, score = "", 1.0
        for _ in range(2):
            here = {(a, b): float(m) for (at, a, b), m in zip(pairs, margin, strict=True) if at == level}
            if all(a == b for a, b in here):
                level = next(iter(here))[0] if here else level
            else:
                level, sure = decide({k: m for k, m in here.items() if k[0] != k[1]})
                score *= sure
        return level, score

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        make_room()
        return pd.DataFrame([one_text(t) for t in texts], columns=["lang", "score"])

    return predict


def held_out(doc_id: Column, parts: int = 5) -> Column:
    """Rows kept from training: crc32 of the id as text divisible by ``parts``; a null id counts as an empty text."""
    return crc32(doc_id) % parts == 0


def identify(docs: DataFrame, train_on: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All rows and columns with ``lang_pred`` and ``score`` (0 to 1).

    Learns from the labelled rows of ``train_on`` (``docs`` unless given) that are not held out. Null and letterless texts get
    ``und``; so does every row if nothing is labelled. Repeated rows and null ids are predicted like others.
    """
    bounded_batches(docs.sparkSession)
    own = train_on if train_on is not None else docs
    rows = own.where(~held_out(F.col(id_col))).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    predict = predictor(train(rows))
    return docs.withColumn("_found", predict(F.col(text_col).cast("string"))).withColumns({"lang_pred": F.col("_found.lang"), "score": F.col("_found.score")}).drop("_found")


def lowest_score(held: DataFrame, predict, lost: float = 0.002, slack: float = 0.9, steps: int = 10_000) -> float:
    """The score under which a text counts as of no learned language: nine tenths of the score that all but the share ``lost`` of the
    rightly predicted rows (lang, text, doc_id) kept from training reach; 0 without such rows.

    All those rows are predicted and counted by scores cut to ``steps`` steps, so the driver gets at most one row per step.
    """
    score = F.col("_found.score")
    right = held.where("lang is not null").withColumn("_found", predict("text")).where("_found.lang = lang")
    counts = sorted(tuple(r) for r in right.groupBy(F.floor(score * steps).alias("step")).agg(F.count(F.lit(1)).alias("n")).collect())
    below = lost * sum(n for _, n in counts)
    for step, n in counts:
        below -= n
        if below < 0:
            return slack * step / steps
    return 0.0


def recognised(docs: DataFrame, lowest: float | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows, with the columns as they were, whose language is known with at least the score ``lowest``, which is calibrated on the
    labelled rows kept from training (``lowest_score``) unless given."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    kept = held_out(F.col("doc_id"))
    predict = predictor(train(rows.where(~kept)))
    least = lowest_score(rows.where(kept), predict) if lowest is None else lowest
    found = docs.withColumn("_found", predict(F.col(text_col).cast("string")))
    return found.where((F.col("_found.lang") != "und") & (F.col("_found.score") >= least)).drop("_found")


def share_right(found: Iterable[tuple[str, str]]) -> float:
    """Share of (true, predicted) pairs that agree."""
    pairs = list(found)
    return sum(a == b for a, b in pairs) / max(1, len(pairs))
