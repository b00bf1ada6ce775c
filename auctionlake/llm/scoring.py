"""Language-model scores of whole texts: causal self-attention on subword ids (operator 1)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32, staged
from .subwords import subwords

WINDOW, STRIDE = 32, 24  #: positions per attention window, and how many of them are scored; the others are context only
BEFORE = WINDOW - STRIDE
WIDTH, HIDDEN = 16, 32
SETS, SIZE, BINS = 32, 48, 8  #: classes of frequent ids and ids in each; classes of all other ids


@dataclass
class Model:
    """Two-level model of the next id: attention gives its class and, in the classes of frequent ids, the id in the class;
    in the other classes counts of the whole corpus give the id."""

    weights: dict[str, np.ndarray]
    classes: np.ndarray  #: class of each id; the last id ends a text
    slots: np.ndarray  #: place of a frequent id in its class
    inside: np.ndarray  #: ln P(id | class) of the other ids, 0 of frequent ones
    wide: dict[str, np.ndarray] | None = None  #: ``widened`` weights, where they are kept

    @property
    def end(self) -> int:
        return len(self.classes) - 1


def start(counts: np.ndarray, seed: int = 3) -> Model:
    """The model before training: ids by descending count fill the classes of frequent ids, the others bins of about equal mass.
    The output biases are the logarithms of counts plus one."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    order, mass = np.lexsort((np.arange(len(counts)), -counts)), counts + 1.0
    classes, slots = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    top, rest = np.split(order, [SETS * SIZE])
    classes[top], slots[top] = np.divmod(np.arange(len(top)), SIZE)
    if len(rest):
        share = np.cumsum(mass[rest]) / mass[rest].sum()
        classes[rest] = SETS + np.minimum((share * BINS).astype(np.int64), BINS - 1)
    total = np.bincount(classes, mass, SETS + BINS)
    odds = np.log(mass / total[classes]).astype(np.float32)
    ids, first = np.full((SETS, SIZE), -1e4, np.float32), np.full(SETS + BINS, -1e4, np.float32)  # places without an id get no chance
    ids[classes[top], slots[top]] = odds[top]
    first[total > 0] = np.log(total[total > 0] / total.sum())
    odds[top] = 0
    weights = {
        "E": draw(len(counts), WIDTH, scale=0.3), "P": draw(WINDOW, WIDTH, scale=0.05), "A": draw(WIDTH, 3 * WIDTH, scale=0.2),
        "B": draw(WIDTH, HIDDEN, scale=0.3), "b": np.zeros(HIDDEN, np.float32), "C": draw(HIDDEN, SETS + BINS, scale=0.2), "c": first,
        "D": draw(SETS, HIDDEN, SIZE, scale=0.1), "d": ids,
    }
    return Model(weights, classes, slots, odds)


def row_sums(z: np.ndarray) -> np.ndarray:
    """Sums over the last axis; a product with ones is faster than adding up many short rows."""
    return (z.reshape(-1, z.shape[-1]) @ np.ones(z.shape[-1], z.dtype)).reshape(z.shape[:-1])


def product(a: np.ndarray, b: np.ndarray, rows: int = 128) -> np.ndarray:
    """``a.T @ b`` of long and narrow matrices, by pieces that fit the kernels for small ones."""
    whole = len(a) // rows * rows
    if whole <= rows:
        return a.T @ b
    out = a[whole:].T @ b[whole:]
    out += np.matmul(a[:whole].reshape(-1, rows, a.shape[1]).transpose(0, 2, 1), b[:whole].reshape(-1, rows, b.shape[1])).sum(axis=0)
    return out


def turned(z: np.ndarray) -> np.ndarray:
    """The last two axes exchanged, in memory too: products with it are faster."""
    return np.ascontiguousarray(z.swapaxes(-1, -2))


def with_one(z: np.ndarray) -> np.ndarray:
    """Rows with a one as their last place, which meets the biases in ``widened`` weights."""
    out = np.ones((len(z), z.shape[1] + 1), z.dtype)
    out[:, :-1] = z
    return out


def widened(w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Output weights with their biases as a last row; "B" makes the hidden state's last place a one."""
    into = np.zeros((WIDTH + 1, HIDDEN + 1), w["B"].dtype)
    into[:-1, :-1], into[-1, :-1], into[-1, -1] = w["B"], w["b"], 1
    return {"B": into, "C": np.vstack([w["C"], w["c"]]), "D": np.concatenate([w["D"], w["d"][:, None]], axis=1)}


def attended(w: dict[str, np.ndarray], x: np.ndarray, first: int) -> tuple[np.ndarray, tuple]:
    """What attention makes of positions ``first`` and later of windows of ids; each attends to itself and those before."""
    n, length = x.shape
    e = w["E"].take(x, axis=0)
    e += w["P"]
    q, k, v = np.split((e.reshape(-1, WIDTH) @ w["A"]).reshape(n, length, 3 * WIDTH), 3, axis=2)
    a = np.matmul(q[:, first:], turned(k))
    np.clip(a, -30, 30, out=a)
    np.exp(a, out=a)
    a *= np.tri(length, dtype=np.float32)[first:]
    total = row_sums(a)[..., None]  # divides the sums of values, which are fewer than the weights
    h = np.matmul(a, v)
    h /= total
    h += e[:, first:]
    return h.reshape(-1, WIDTH), (e, q, k, v, a, total)


def hidden(wide: dict[str, np.ndarray], h: np.ndarray) -> np.ndarray:
    """Hidden states, and a one as last place."""
    r = with_one(h) @ wide["B"]
    return np.clip(r, 0, np.inf, out=r)


def by_class(model: Model, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The order that sorts ids by class, their classes in it, and where each class of frequent ids begins and ends in it."""
    own = model.classes[y].astype(np.int16)
    order = np.argsort(own, kind="stable")
    own = own[order]
    return order, own, np.searchsorted(own, np.arange(SETS + 1)).tolist()


def in_class(wide: dict[str, np.ndarray], r: np.ndarray, bounds: list[int]) -> np.ndarray:
    """Logits of the ids of each row's class from hidden states sorted by class."""
    z = np.empty((bounds[-1], SIZE), r.dtype)
    for s in range(SETS):
        i, j = bounds[s], bounds[s + 1]
        if i < j:
            np.matmul(r[i:j], wide["D"][s], out=z[i:j])
    return z


def softmax(z: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ln P of the places ``at`` from logits, which become their exponentials, the sums of these, and where the places are in all logits.
    Rows are moved to a maximum of zero only where a sum could overflow or vanish."""
    spots = np.arange(len(z)) * z.shape[1] + at
    got = z.ravel().take(spots)
    if len(z) and not (z.max() < 80 and got.min() > -80):
        z -= z.max(axis=1, keepdims=True)
        got = z.ravel().take(spots)
    np.exp(z, out=z)
    total = row_sums(z)
    got -= np.log(total)
    return got, total, spots


def chances(model: Model, r: np.ndarray, y: np.ndarray) -> np.ndarray:
    """ln P of ids ``y`` from hidden states: of the class, and of the id among its class."""
    wide = model.wide or widened(model.weights)
    order, own, bounds = by_class(model, y)
    r, y, few = with_one(r[:, :HIDDEN].take(order, axis=0)), y[order], bounds[-1]
    got, *_ = softmax(r @ wide["C"], own)
    got += model.inside[y]
    got[:few] += softmax(in_class(wide, r, bounds), model.slots[y[:few]])[0]
    out = np.empty_like(got)
    out[order] = got
    return out


def error(z: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Softmax of logits in place: ln P of the places ``at``, and the gradient of their mean loss over ``n`` rows."""
    got, total, spots = softmax(z, at)
    total *= n
    z *= (1 / total)[:, None]
    z.ravel()[spots] -= 1 / n
    return got, z


def gradients(model: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """Mean loss of next ids ``y`` over whole windows, its gradients, and the ids that the rows of gradient "E" belong to."""
    w, y, wide = model.weights, y.ravel(), model.wide or widened(model.weights)
    h, (e, q, k, v, a, total) = attended(w, x, 0)
    n = len(y)
    order, own, bounds = by_class(model, y)
    sorted_h, y, few = h.take(order, axis=0), y[order], bounds[-1]
    r = hidden(wide, sorted_h)
    got, p = error(r @ wide["C"], own, n)
    loss = got.sum() + model.inside[y].sum()
    classes, ids = product(r, p), np.zeros_like(wide["D"])
    dr = p @ turned(w["C"])
    got, p = error(in_class(wide, r, bounds), model.slots[y[:few]], n)
    loss += got.sum()
    back, more = turned(w["D"]), np.empty((few, HIDDEN), r.dtype)
    for s in range(SETS):
        i, j = bounds[s], bounds[s + 1]
        if i < j:
            ids[s] = product(r[i:j], p[i:j])
            np.matmul(p[i:j], back[s], out=more[i:j])
    dr[:few] += more
    dr *= r[:, :-1] > 0
    into = product(with_one(sorted_h), dr)
    g = {"B": into[:-1], "b": into[-1], "C": classes[:-1], "c": classes[-1], "D": ids[:, :-1], "d": ids[:, -1]}
    dh = np.empty_like(h)
    dh[order] = dr @ turned(w["B"])
    dh = dh.reshape(e.shape)
    part = dh / total
    ds = np.matmul(part, turned(v))
    ds -= row_sums(part * (h.reshape(e.shape) - e))[..., None]  # sums of ds * a: h - e is what attention added
    ds *= a
    dqkv = np.empty((*x.shape, 3 * WIDTH), ds.dtype)
    np.matmul(ds, k, out=dqkv[..., :WIDTH])
    np.matmul(ds.transpose(0, 2, 1), q, out=dqkv[..., WIDTH:2 * WIDTH])
    np.matmul(a.transpose(0, 2, 1), part, out=dqkv[..., 2 * WIDTH:])
    dqkv = dqkv.reshape(-1, 3 * WIDTH)
    g["A"] = product(e.reshape(-1, WIDTH), dqkv)
    de = dh + (dqkv @ turned(w["A"])).reshape(dh.shape)
    g["P"] = de.sum(axis=0)
    flat = x.ravel()
    flat = flat.astype(np.uint16) if len(model.classes) <= 1 << 16 else flat  # short numbers are sorted faster
    order = np.argsort(flat, kind="stable")
    listed = flat[order]
    first = np.flatnonzero(np.r_[True, listed[1:] != listed[:-1]])
    g["E"] = np.add.reduceat(de.reshape(-1, WIDTH).take(order, axis=0), first, axis=0)
    return float(-loss / n), g, listed[first]


def places(n: int, least: int, rng: np.random.Generator, turn: int, rounds: int) -> np.ndarray:
    """Where the windows of round ``turn`` begin in ``n`` ids: all rounds together go through every window, in random order, and start
    over until each round has ``least``. ``rng`` must be in the same state in every round."""
    first = np.append(np.arange(0, n - 1 - WINDOW, WINDOW), n - 1 - WINDOW)
    share = max(-(-len(first) // rounds), least)
    return first[rng.permutation(len(first))[np.arange(turn * share, (turn + 1) * share) % len(first)]]


def adam(first: np.ndarray, second: np.ndarray, g: np.ndarray, t: int, rate: float) -> np.ndarray:
    """What step ``t`` takes off the weights; the moments change in place."""
    part = g - first
    part *= 0.1
    first += part
    np.multiply(g, g, out=part)
    part -= second
    part *= 0.01
    second += part
    np.multiply(second, 1 / (1 - 0.99**t), out=part)
    np.sqrt(part, out=part)
    part += 1e-8
    return np.divide(first * (rate / (1 - 0.9**t)), part, out=part)


def descend(
    model: Model, second: dict[str, np.ndarray], flat: np.ndarray, steps: int, rng: np.random.Generator, turn: int = 0, rounds: int = 1, batch: int = 192, rate: float = 2e-2,
) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Weights and second moments after round ``turn`` of Adam over ``flat``, whose windows are all met in ``rounds`` rounds of at least
    ``steps`` steps each; rows of "E" whose id is not met stay."""
    w, second = ({k: v.copy() for k, v in part.items()} for part in (model.weights, second))
    first_ids = places(len(flat), steps * batch, rng, turn, rounds)
    steps = -(-len(first_ids) // batch)
    small = [k for k in w if k != "E"]
    joined, moments = (np.concatenate([part[k].ravel() for k in small]) for part in (w, second))
    at = 0
    for k in small:  # become views of the joined ones
        w[k], second[k] = (part[at:at + w[k].size].reshape(w[k].shape) for part in (joined, moments))
        at += w[k].size
    means, rows = np.zeros_like(joined), np.zeros_like(w["E"])
    here = replace(model, weights=w)
    for t, begun in enumerate(np.array_split(first_ids, steps), turn * steps + 1):
        at = begun[:, None] + np.arange(WINDOW)
        _, g, met = gradients(here, flat[at], flat[at + 1])
        now = rate * min(1, t / 30, 2.5 * (1 - t / (rounds * steps + 1)) + 0.02)
        joined -= adam(means, moments, np.concatenate([g[k].ravel() for k in small]), t, now)
        one, two = rows[met], second["E"][met]
        w["E"][met] -= adam(one, two, g["E"], t, now)
        rows[met], second["E"][met] = one, two
    return w, second


def cell(listed: pa.ListScalar) -> np.ndarray:
    """The values of an array in a column."""
    return listed.values.to_numpy(zero_copy_only=False)


def training_ids(held: np.ndarray, lengths: np.ndarray, codes: np.ndarray, sub_lengths: np.ndarray, subs: np.ndarray, end: int) -> np.ndarray:
    """The ids of a block's training documents, each after a context of ends and closed by one."""
    own, n = codes[~np.repeat(held, lengths)], lengths[~held]
    own = np.insert(own, np.cumsum(n) - n, len(sub_lengths))  # what stands between texts is a word more, of BEFORE + 2 ends
    many = np.append(sub_lengths, BEFORE + 2)
    starts, subs = np.cumsum(many) - many, np.append(subs.astype(np.int32), np.full(BEFORE + 2, end, np.int32))
    many = many[own]
    ends = np.cumsum(many)
    kind = np.int32 if len(ends) and ends[-1] < 1 << 31 else np.int64
    at = np.repeat((starts[own] - (ends - many)).astype(kind), many)
    at += np.arange(len(at), dtype=kind)
    return np.append(subs.take(at[1:]), np.full(min(1, len(n)), end, np.int32))  # one end goes from the front to the back


def fit(blocks: DataFrame, tokenizer: str, counts: np.ndarray, rounds: int = 5, steps: int = 100, pieces: int = 64, seed: int = 3) -> Model:
    """The model fitted on the training documents of all blocks, in the tasks that hold them.

    In each round every block takes the common weights through steps of its own, over its share of the windows of its training documents:
    in ``rounds`` rounds every training id, ends included, is learned from. Where there are few windows they are met again, for ``steps`` steps
    a round in the largest block, in others in proportion to their ids. The next weights, and Adam's second moments, are the
    means over blocks, each weighing as many ids as it has. Embeddings travel for ids that occur. A task returns one mean, and means
    meet piece by piece, so the driver gets one set of weights a round.
    """
    spark, kind = blocks.sparkSession, subwords(tokenizer).dtype
    model = start(counts, seed)
    used, end = np.flatnonzero(counts), model.end
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    heard = F.aggregate(F.arrays_zip("counts", "sub_lengths"), F.lit(0).cast("bigint"), lambda acc, x: acc + x["counts"] * x["sub_lengths"])
    largest = blocks.select((heard + F.get("counts", F.lit(0)) * (BEFORE + 2)).alias("n")).agg(F.max("n")).first()[0] or 0
    if not largest:
        return model
    source = blocks.select("block", "held", "lengths", "codes", "sub_lengths", "subs")
    for turn in range(rounds):
        common = spark.sparkContext.broadcast((model, second, used))

        def local(batches: Iterator[pa.RecordBatch], turn: int = turn, common=common) -> Iterator[pa.RecordBatch]:
            begun, moments, used = common.value
            total, weight = 0.0, 0
            for batch in batches:
                for block, held, lengths, codes, sub_lengths, subs in zip(*batch.columns, strict=True):
                    flat = training_ids(
                        cell(held), cell(lengths).astype(np.int64), np.frombuffer(codes.as_buffer(), "<i4"), cell(sub_lengths).astype(np.int64),
                        np.frombuffer(subs.as_buffer(), kind), end)
                    if len(flat):
                        own = max(1, -(-steps * len(flat) // largest))
                        flat = np.r_[np.full(max(0, WINDOW + 2 - len(flat)), end, flat.dtype), flat]
                        sets = descend(begun, moments, flat, own, np.random.default_rng((seed, block.as_py())), turn, rounds)
                        total = total + len(flat) * np.concatenate([(v[used] if k == "E" else v).ravel() for part in sets for k, v in part.items()]).astype(np.float64)
                        weight += len(flat)
            if weight:
                parts = [x.astype("<f4").tobytes() for x in np.array_split(total / weight, pieces)]
                yield pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int32()), pa.array([weight] * pieces, pa.int64()), pa.array(parts, pa.binary())], ["piece", "n", "mean"])

        def join(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["n", "mean"])
            total = sum(n * np.frombuffer(x, "<f4").astype(np.float64) for n, x in zip(group["n"], group["mean"], strict=True))
            return pd.DataFrame({"piece": group["piece"].iloc[:1].to_numpy(), "mean": [(total / group["n"].sum()).astype("<f4").tobytes()]})

        means = source.mapInArrow(local, "piece int, n bigint, mean binary").groupBy("piece").applyInPandas(join, "piece int, mean binary").collect()
        if not means:
            break
        flat = np.concatenate([np.frombuffer(r["mean"], "<f4") for r in sorted(means, key=lambda r: r["piece"])])
        for part in (model.weights, second):
            for k, v in part.items():
                rows = used if k == "E" else slice(None)
                own, flat = np.split(flat, [v[rows].size])
                v[rows] = own.reshape(v[rows].shape)
        common.unpersist()
    return model


def log_probabilities(model: Model, ids: np.ndarray, lengths: np.ndarray, most: int = 256) -> np.ndarray:
    """ln P of every id of consecutive texts and of each text's end, in order (lengths plus one per text).

    A text is laid out after a context of end ids and cut into overlapping windows; in each window the last STRIDE positions
    are scored, so every id is scored once, with at least BEFORE positions of context.
    """
    targets = lengths + 1
    windows = -(-targets // STRIDE)
    sizes = BEFORE + STRIDE * windows + 1
    offsets = np.cumsum(sizes) - sizes
    z = np.full(int(sizes.sum()), model.end, np.int32)
    starts = np.cumsum(lengths) - lengths
    z[np.arange(len(ids)) + np.repeat(offsets + BEFORE + 1 - starts, lengths)] = ids
    ends = np.cumsum(windows)
    first = np.repeat(offsets - STRIDE * (ends - windows), windows) + STRIDE * np.arange(int(ends[-1]) if len(ends) else 0)
    out = np.empty((len(first), STRIDE), np.float32)
    model = replace(model, wide=widened(model.weights))
    for k in range(0, len(first), most):
        x = z[first[k:k + most, None] + np.arange(WINDOW + 1)]
        h, _ = attended(model.weights, x[:, :WINDOW], BEFORE)
        out[k:k + most] = chances(model, hidden(model.wide, h), x[:, BEFORE + 1:].ravel()).reshape(-1, STRIDE)
    place = np.arange(len(first))[:, None] * STRIDE + np.arange(STRIDE) - np.repeat((ends - windows) * STRIDE, windows)[:, None]
    return out[place < np.repeat(targets, windows)[:, None]]


def held_out(doc_id: Column) -> Column:
    """Rows that are not learned from: crc32 of the id as text is 2 modulo 7; a null id counts as an empty text."""
    return crc32(doc_id) % 7 == 2


def numbered() -> defaultdict[bytes, int]:
    """Words by number, in the order in which they are looked up first; the end of a text is 0."""
    words: defaultdict[bytes, int] = defaultdict()
    words.default_factory = words.__len__
    words[b""]  # noqa: B018
    return words


def blocks_of(docs: DataFrame, tokenizer: str, block_bytes: int) -> DataFrame:
    """One row per block of consecutive documents: ids and word numbers, and the block's words with subword ids and training counts.
    Word 0 is the end of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = subwords(tokenizer)
        base, seen = TaskContext.get().partitionId() << 32, 0
        names: list = []
        held: list[bool] = []
        codes: list[np.ndarray] = []
        words = numbered()
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal seen, names, held, codes, words, size
            train = [c for c, out in zip(codes, held, strict=True) if not out]
            counts = np.bincount(np.concatenate(train), minlength=len(words)) if train else np.zeros(len(words), np.int64)
            counts[0] = len(train)
            listed = list(words)
            subs = [b"", *map(coder.one, listed[1:])]
            row = {
                "block": base + seen, "doc_ids": names, "held": held, "lengths": [len(c) for c in codes],
                "codes": np.concatenate(codes).astype("<i4").tobytes(), "words": listed, "counts": counts.tolist(),
                "sub_lengths": (np.asarray([len(s) for s in subs]) // coder.dtype.itemsize).tolist(), "subs": b"".join(subs),
            }
            seen += 1
            words.default_factory = None  # else the words would stay until the next collection of garbage
            names, held, codes, words, size = [], [], [], numbered(), 0
            return pa.RecordBatch.from_pylist([row], BLOCK)

        for batch in batches:
            for name, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = text.as_py() or b""
                own = raw.lower().split()
                codes.append(np.fromiter(map(words.__getitem__, own), np.int32, len(own)))
                names.append(name)
                held.append(out)
                size += len(raw)
                if size >= block_bytes:
                    yield flush()
        if names:
            yield flush()
        coder.settle()

    return docs.mapInArrow(run, "block bigint, doc_ids array<bigint>, held array<boolean>, lengths array<int>, codes binary, words array<binary>, counts array<bigint>, sub_lengths array<int>, subs binary")


BLOCK = pa.schema([
    ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())), ("codes", pa.binary()),
    ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())), ("sub_lengths", pa.list_(pa.int32())), ("subs", pa.binary()),
])


def subword_counts(blocks: DataFrame, tokenizer: str) -> np.ndarray:
    """Training counts of all subword ids, the end of a text last; one row per id of the vocabulary reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = subwords(tokenizer).dtype
        for batch in batches:
            for counts, lengths, subs in zip(*batch.columns, strict=True):
                n = cell(counts)
                total = np.bincount(np.frombuffer(subs.as_buffer(), kind), np.repeat(n, cell(lengths)))
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([-1, *some], pa.int64()), pa.array([n[0], *total[some].astype(np.int64)], pa.int64())], ["id", "n"])

    rows = blocks.select("counts", "sub_lengths", "subs").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(subwords(tokenizer).tokenizer.get_vocab_size(with_added_tokens=True) + 1, np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


def score(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 12 << 20,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    Documents are cut into blocks once, with each block's distinct words; words are counted over all training documents, and the
    counts are joined to each block's words, so a frequent word is one row per block. The attention model is fitted on
    all windows of all training documents (``fit``); its classes, and the odds of rare ids inside theirs, come from the counts of all. Weights
    are averaged over blocks, so scores differ slightly where the same rows are dealt to other partitions. The
    score is the model's log10 probability of all ids of the text and its end, each from what stands before it; word counts only give
    the base score. Null and empty texts are their end alone; null ids and repeated rows are scored like others;
    other columns are not read; no rows give no rows.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out(F.col(id_col)).alias("held"), F.col(text_col).cast("string").cast("binary").alias("text"))
    blocks = staged(blocks_of(source, tokenizer, block_bytes), "blocks")
    listed = blocks.select("block", F.posexplode("words").alias("place", "word"), "counts").select("block", "place", "word", F.get("counts", F.col("place")).alias("n"))
    totals = listed.where("n > 0").groupBy("word").agg(F.sum("n").alias("c"))
    totals = staged(totals, "word-counts")
    whole = totals.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = whole["n"] or 0, whole["v"] or 0
    known = listed.join(totals, "word").select(F.col("block").alias("of"), "place", "c")

    model = spark.sparkContext.broadcast(fit(blocks, tokenizer, subword_counts(blocks, tokenizer)))
    kind = subwords(tokenizer).dtype

    def judge(block: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in block.itertuples():
            lengths, sub_lengths = np.asarray(row.lengths, np.int64), np.asarray(row.sub_lengths, np.int64)
            c = np.zeros(len(sub_lengths), np.int64)
            c[words["place"].to_numpy()] = words["c"].to_numpy()
            base = np.log10((c + 1) / (n_all + v_all + 1))
            codes, subs = np.frombuffer(row.codes, "<i4"), np.frombuffer(row.subs, kind)
            sub_starts, ends = np.cumsum(sub_lengths) - sub_lengths, np.cumsum(lengths)
            first = 0
            while first < len(lengths):  # some documents at a time
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + 100_000)))
                at = ends[first] - lengths[first]
                own, n = codes[at:ends[last - 1]], lengths[first:last]
                many = sub_lengths[own]
                starts = np.cumsum(many) - many
                ids = subs[np.arange(int(many.sum())) + np.repeat(sub_starts[own] - starts, many)].astype(np.int64)
                doc_of = np.repeat(np.arange(len(n)), n)
                id_counts = np.bincount(doc_of, many, len(n)).astype(np.int64)
                text_of = np.repeat(np.arange(len(n)), id_counts + 1)
                score = np.bincount(text_of, log_probabilities(model.value, ids, id_counts), len(n)) / np.log(10)
                bases = np.bincount(doc_of, base[own], len(n)) + base[0]
                seen = np.bincount(doc_of, c[own] > 0, len(n)) + (c[0] > 0)
                out.append(pd.DataFrame({
                    "doc_id": pd.array(list(row.doc_ids[first:last]), "Int64"), "held_out": row.held[first:last], "n_tokens": n + 1, "n_known": seen.astype(np.int64),
                    "train_tokens": n_all, "base_score": bases, "score": score,
                }))
                first = last
        return pd.concat(out) if out else pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    narrow = blocks.drop("words", "counts")
    return narrow.groupBy("block").cogroup(known.groupBy("of")).applyInPandas(
        judge, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    )
