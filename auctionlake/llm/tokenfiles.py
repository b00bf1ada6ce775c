"""Token ids in files of byte-aligned variable-length codes (operator 5).

A file is a run of chunks. Each chunk: magic ``SVB1``; little-endian unsigned 64-bit numbers of documents, control bytes and
data bytes; one validity byte, one signed 64-bit document id and one unsigned 32-bit id count per document; the control
bytes; the data bytes. Ids are stored as their rank by frequency. A control byte holds the byte lengths, less one, of four
ranks in two bits each, the first rank in the lowest bits; the data bytes hold the ranks' low bytes. Each document
starts a new control byte. ``ranks.bin`` beside the files lists the ids in order of rank (unsigned 32-bit).
"""

from __future__ import annotations

import posixpath
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auctionlake.shared import new_folder

from .common import crc32, drop, write
from .subwords import subwords

MAGIC, HEAD = b"SVB1", "<4sQQQ"

#: Number of data bytes that each control byte stands for, and where in them the 16 bytes of its four ranks lie (-1: no byte).
LENGTHS = np.asarray([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.int64)
USED = LENGTHS.sum(axis=1)
PLACES = np.asarray([
    [first + b if b < n else -1 for first, n in zip(np.cumsum(row) - row, row, strict=True) for b in range(4)] for row in LENGTHS
], np.int64)


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values; the last control byte is filled up with ones of no data."""
    values = np.ascontiguousarray(values, "<u4")
    sizes = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[:len(values)] = sizes
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= sizes[:, None]]
    return control.tobytes(), data.tobytes()


def decode(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values of documents of the given counts, by one look-up of the table per control byte."""
    controls = -(-counts // 4)
    spare = controls * 4 - counts  # filled-up codes have length one and no data
    ends, used = np.cumsum(controls), USED[control]
    lasts = ends[controls > 0] - 1
    used[lasts] -= spare[controls > 0]
    first = np.cumsum(used) - used
    padded = np.append(data, np.zeros(20, np.uint8))
    at = PLACES[control]
    gathered = padded[np.where(at < 0, len(data) + 4, np.minimum(first[:, None] + at, len(data)))]
    values = gathered.reshape(-1, 4).view("<u4").ravel()
    if not spare.any():
        return values
    keep = np.ones(len(values), bool)
    for k in range(1, 4):
        keep[(ends * 4 - k)[spare >= k]] = False
    return values[keep]


def token_ids(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_crc32, n, ids): all ids of each whole text and the end id, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, press = subwords(tokenizer), zstandard.ZstdCompressor(level=1).compress
        end = np.asarray([end_id], coder.dtype).tobytes()
        for batch in batches:
            ids, counts = [], []
            for text in batch.column(2):
                got = coder.text(text.as_py()) + end
                counts.append(len(got) // coder.dtype.itemsize)
                ids.append(press(got))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "text_crc32", "n", "ids"])
        coder.settle()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), crc32(F.col(text_col)).alias("text_crc32"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, text_crc32 bigint, n bigint, ids binary")


def ranking(ids: DataFrame, tokenizer: str) -> np.ndarray:
    """All ids of the vocabulary, most frequent over all documents first, equal counts by id. Counts per task are summed by
    Spark; what reaches the driver is one row per id of the vocabulary file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, open_ = subwords(tokenizer), zstandard.ZstdDecompressor().decompress
        total = np.zeros(0, np.int64)
        for batch in batches:
            got = np.bincount(np.frombuffer(b"".join(open_(x.as_py()) for x in batch.column(0)), coder.dtype), minlength=len(total))
            got[:len(total)] += total
            total = got
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["id", "n"])

    counts = ids.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    size = max([subwords(tokenizer).tokenizer.get_vocab_size(with_added_tokens=True), *(r["id"] + 1 for r in counts)])
    freq = np.zeros(size, np.int64)
    for r in counts:
        freq[r["id"]] = r["n"]
    return np.lexsort((np.arange(size), -freq)).astype("<u4")


def chunk(docs: list[tuple[int | None, int, bytes, bytes]]) -> bytes:
    control, data = b"".join(c for _, _, c, _ in docs), b"".join(d for _, _, _, d in docs)
    return b"".join((
        struct.pack(HEAD, MAGIC, len(docs), len(control), len(data)), bytes(d is not None for d, *_ in docs),
        np.asarray([d or 0 for d, *_ in docs], "<i8").tobytes(), np.asarray([n for _, n, *_ in docs], "<u4").tobytes(), control, data,
    ))


def write_files(
    spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    folder: str | None = None, chunk_bytes: int = 4 << 20,
) -> tuple[str, list[tuple[str, int, int]]]:
    """Encode all documents into files of ascending ids in ``folder`` (a new shared one unless given); returns the folder and its
    manifest: (file, documents, ids) in order.

    Whole texts are encoded once and staged compressed. Ids are ranked by their counts over all documents. The staged
    ids, not the texts, are range-partitioned by id, checksum and place, so one often repeated id spreads over files. A task
    writes its file under a name of its own attempt and renames it, so a second attempt does no harm. The folder must be in
    a store that pyarrow can open. The manifest has one row per file.
    """
    folder = folder or new_folder(spark, "token-files")
    path = write(token_ids(docs, tokenizer, end_id, id_col, text_col), "token-ids", "none")
    ids = spark.read.parquet(path)
    ranks = ranking(ids, tokenizer)
    store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(posixpath.join(root, "ranks.bin")) as out:
        out.write(ranks.tobytes())
    places = np.argsort(ranks).astype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, open_ = subwords(tokenizer), zstandard.ZstdDecompressor().decompress
        name = f"part-{TaskContext.get().partitionId():06d}.svb"
        target, trial = posixpath.join(root, name), posixpath.join(root, f".{name}-{uuid.uuid4().hex}")
        n_docs = n_ids = held = 0
        waiting: list[tuple[int | None, int, bytes, bytes]] = []
        out = None
        for batch in batches:
            for doc, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out = out or store.open_output_stream(trial)
                values = places[np.frombuffer(open_(packed.as_py()), coder.dtype)]
                control, data = encode(values)
                waiting.append((doc, len(values), control, data))
                n_docs, n_ids, held = n_docs + 1, n_ids + len(values), held + len(control) + len(data)
                if held >= chunk_bytes:
                    out.write(chunk(waiting))
                    waiting, held = [], 0
        if out:
            if waiting:
                out.write(chunk(waiting))
            out.close()
            store.move(trial, target)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())], ["file", "n_docs", "n_ids"])

    keys = ["doc_id", "text_crc32", "place"]
    ordered = ids.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    made = ordered.select("doc_id", "ids").mapInArrow(run, "file string, n_docs bigint, n_ids bigint").collect()
    drop(spark, path)
    return folder, sorted((r["file"], r["n_docs"], r["n_ids"]) for r in made)


def read_files(spark: SparkSession, folder: str, manifest: list[tuple[str, int, int]], batch_ids: int = 2_000_000) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files; ids as little-endian unsigned 32-bit integers,
    ``start`` the ids of all documents before it. A task streams its file chunk by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        with store.open_input_file(posixpath.join(root, "ranks.bin")) as file:
            ranks = np.frombuffer(file.read(), "<u4")
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_stream(posixpath.join(root, name), buffer_size=1 << 20) as file:
                    while head := file.read(struct.calcsize(HEAD)):
                        magic, n, n_control, n_data = struct.unpack(HEAD, head)
                        if magic != MAGIC:
                            raise ValueError(f"{name} is not a token file")
                        valid = np.frombuffer(file.read(n), np.uint8)
                        docs, counts = np.frombuffer(file.read(8 * n), "<i8"), np.frombuffer(file.read(4 * n), "<u4").astype(np.int64)
                        ids = ranks[decode(np.frombuffer(file.read(n_control), np.uint8), np.frombuffer(file.read(n_data), np.uint8), counts)]
                        ends = np.cumsum(counts)
                        raw = [ids[e - c:e].tobytes() for c, e in zip(counts, ends, strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(docs, pa.int64(), mask=valid == 0), pa.array(start + ends - counts, pa.int64()), pa.array(counts), pa.array(raw, pa.binary())],
                            ["doc_id", "start", "n_tokens", "ids"],
                        )
                        start += int(ends[-1])

    starts, total = [], 0
    for name, _, n_ids in manifest:
        starts.append((name, total))
        total += n_ids
    files = spark.createDataFrame(starts, "file string, start bigint")
    if starts:
        files = files.repartitionByRange(len(starts), "file")
    return files.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents to token files and read them back.

    A null or empty text is its end id alone; a null id comes first; repeated ids are documents of their own, by checksum;
    other columns are not read; no rows give no files and no rows.
    """
    folder, manifest = write_files(spark, docs, tokenizer, end_id, id_col, text_col)
    return read_files(spark, folder, manifest)
