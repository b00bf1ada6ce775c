"""Hierarchical multi-length packing of token ids (operator 9)."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import make_room
from .subwords import subwords

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, "
    "context bigint, step_group bigint"
)
ARROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("context", pa.int64()), ("step_group", pa.int64()),
])


def plan(lengths: list[int], tiers: tuple[int, ...]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences as (context size, [(document, start, length)]) for documents of the given lengths.

    1. Whole windows of the largest tier are cut from long documents.
    2. What remains of a document is routed to the smallest tier that holds it.
    3. From the largest tier down, each item opens a window; its gap takes the largest items that fit, which are of shorter
       tiers, and then the front of the smallest item that does not fit, whose rest is routed anew.
    4. Only the last window can stay short: it is cut into sequences of powers of two.
    """
    top = tiers[-1]
    out: list[tuple[int, list[tuple[int, int, int]]]] = []
    pool: list[tuple[int, int, int]] = []  # (length, document, start), ascending
    for doc, n in enumerate(lengths):
        full = n // top
        out += [(top, [(doc, k * top, top)]) for k in range(full)]
        if n % top:
            pool.append((n % top, doc, full * top))
    pool.sort()
    for tier, below in zip(reversed(tiers), [*reversed(tiers[:-1]), 0], strict=True):
        while pool and pool[-1][0] > below:
            n, doc, start = pool.pop()
            inside, gap = [(doc, start, n)], tier - n
            while gap and pool:
                k = bisect_right(pool, (gap, len(lengths), 0))
                if k:
                    n, doc, start = pool.pop(k - 1)
                else:
                    n, doc, start = pool.pop(0)
                    insort(pool, (n - gap, doc, start + gap))
                    n = gap
                inside.append((doc, start, n))
                gap -= n
            if gap:
                out += powers(inside)
            else:
                out.append((tier, inside))
    return out


def powers(inside: list[tuple[int, int, int]]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """One short window as full sequences of falling powers of two."""
    total, out, rest = sum(n for _, _, n in inside), [], list(reversed(inside))
    while total:
        size = gap = 1 << (total.bit_length() - 1)
        taken = []
        while gap:
            doc, start, n = rest.pop()
            if n > gap:
                rest.append((doc, start + gap, n - gap))
                n = gap
            taken.append((doc, start, n))
            gap -= n
        out.append((size, taken))
        total -= size
    return out


def steps(sequences: list[tuple[int, list[tuple[int, int, int]]]], step_tokens: int) -> list[int]:
    """A step group per sequence: groups hold one context size and as many tokens, and attention cost (squares of piece
    lengths) is evened out by dealing sequences back and forth in order of cost."""
    groups, first = [0] * len(sequences), 0
    for size in sorted({s for s, _ in sequences}):
        own = sorted((i for i, (s, _) in enumerate(sequences) if s == size), key=lambda i: -sum(n * n for _, _, n in sequences[i][1]))
        many = -(-len(own) * size // step_tokens)
        for k, i in enumerate(own):
            turn, at = divmod(k, many)
            groups[i] = first + (at if turn % 2 == 0 else many - 1 - at)
        first += many
    return groups


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    tiers: tuple[int, ...] = (512, 1024, 2048, 4096), block_tokens: int = 4_000_000, step_tokens: int = 65_536,
) -> DataFrame:
    """Pieces of documents in packed sequences, with their ids (little-endian unsigned 32-bit) and step groups.

    Every block of about ``block_tokens`` ids of an input partition is packed by itself, in one pass and without a shuffle:
    the ids never move, memory is one block, and a lost task packs the same block again. Sequences are full: of a tier's
    size, or, for what is left of a block, of a smaller power of two, so nothing is padded. A null or empty text is its end id
    alone; null and repeated ids are documents like all others; no rows give no pieces. ``sequence_id`` is unique
    (partition, then running number); ``step_group`` likewise.
    """
    if list(tiers) != sorted(set(tiers)) or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be rising powers of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(subwords)
        coder = subwords(tokenizer)
        end = np.asarray([end_id], coder.dtype).tobytes()
        task = TaskContext.get().partitionId() << 40
        seen = grouped = held = 0
        ids: list[bytes] = []
        names: list[int | None] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seen, grouped, held, ids, names
            flat = [np.frombuffer(x, coder.dtype).astype("<u4") for x in ids]
            sequences = plan([len(x) for x in flat], tiers)
            groups = steps(sequences, step_tokens)
            rows: list[tuple] = []
            for k, ((size, inside), group) in enumerate(zip(sequences, groups, strict=True)):
                offset = 0
                for doc, start, n in inside:
                    part = flat[doc][start:start + n].tobytes()
                    rows.append((names[doc], start, n, part, len(flat[doc]), task + seen + k, offset, size, task + grouped + group))
                    offset += n
            seen, grouped = seen + len(sequences), grouped + max(groups, default=-1) + 1
            held, ids, names = 0, [], []
            for k in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k:k + 4096], strict=True), ARROW, strict=True)], schema=ARROW)

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = coder.text(text.as_py()) + end
                ids.append(got)
                names.append(name)
                held += len(got) // coder.dtype.itemsize
                if held >= block_tokens:
                    yield from flush()
        if ids:
            yield from flush()
        coder.settle()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """The contract's columns of packed pieces, checksums taken from the ids packed."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "context", "step_group"
    )
