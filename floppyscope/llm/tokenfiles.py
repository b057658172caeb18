"""Token-id files of patched frame-of-reference blocks.

File layout, all integers little-endian:

    magic "FPTOKEN1"
    blocks, each: u32 minimum, u8 width, u8 exceptions, then for each exception its place (u8),
        then for each its offset from the minimum (u32), then BLOCK offsets of ``width`` bits
    u64 start of every block, and one more: the end of the last
    i64 doc_id of every document, u8 "doc_id is null" of every document, u64 end (in ids) of each
    u64 documents, u64 ids, u64 blocks, magic

A block's width is that which holds PERCENTILE of its offsets; the others are exceptions. The
block starts let a reader decode any range of ids without what precedes it. A file ends with
the document that brings it to FILE_IDS ids or FILE_DOCS documents; then the next begins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floppyscope.llm.common import in_batches, ragged, scratch_path, table
from floppyscope.llm.tokens import encoder

MAGIC = b"FPTOKEN1"
BLOCK = 128
PERCENTILE = 0.9
END_ID = 2
#: Ids that the writer holds before it packs them, and that the reader decodes at once.
HELD = 1 << 18
READ_IDS = 1 << 20
#: Ids and documents that close a file.
FILE_IDS = 1 << 26
FILE_DOCS = 1 << 20


def encode_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """The blocks of ``ids`` (the last filled up with its minimum) and each block's size."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return b"", np.zeros(0, np.int64)
    x = np.empty(n * BLOCK, np.uint32)
    x[: len(ids)] = ids
    x[len(ids) :] = ids[(n - 1) * BLOCK :].min()
    x = x.reshape(n, BLOCK)
    low = x.min(axis=1)
    x = x - low[:, None]
    bits = np.frexp(x.astype(np.float64))[1].astype(np.uint8)  # length in bits; exact below 2**53
    width = np.sort(bits, axis=1)[:, max(0, int(np.ceil(percentile * BLOCK)) - 1)]
    over = bits > width[:, None]
    many = over.sum(axis=1)
    size = 6 + 5 * many + BLOCK // 8 * width.astype(np.int64)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    out[at[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(n, 4)
    out[at + 4] = width
    out[at + 5] = many
    if many.any():
        row, place = np.nonzero(over)
        out[ragged(at + 6, many)] = place
        values = x[row, place].astype("<u4").view(np.uint8)
        out[ragged(at + 6 + many, 4 * many)] = values
    packed = at + 6 + 5 * many
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        for part in np.array_split(rows, -(-len(rows) // 2048)) if w else ():
            b = (x[part][:, :, None] >> np.arange(w, dtype=np.uint32) & np.uint32(1)).astype(np.uint8)
            out[packed[part][:, None] + np.arange(BLOCK // 8 * w)] = np.packbits(b.reshape(len(part), -1), axis=1, bitorder="little")
    return out.tobytes(), size


def decode_blocks(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at ``starts`` in ``data``, BLOCK for each."""
    n = len(starts)
    low = data[starts[:, None] + np.arange(4)].reshape(-1).view("<u4")
    width, many = data[starts + 4], data[starts + 5].astype(np.int64)
    out = np.zeros((n, BLOCK), np.uint32)
    packed = starts + 6 + 5 * many
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        for part in np.array_split(rows, -(-len(rows) // 2048)) if w else ():
            raw = data[packed[part][:, None] + np.arange(BLOCK // 8 * w)]
            b = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(part), BLOCK, w)
            out[part] = b @ (np.uint32(1) << np.arange(w, dtype=np.uint32))
    if many.any():
        row = np.repeat(np.arange(n), many)
        out[row, data[ragged(starts + 6, many)]] = data[ragged(starts + 6 + many, 4 * many)].view("<u4")
    return (out + low[:, None]).reshape(-1)


class FileWriter:
    """Writes documents to one file as they come; holds HELD ids and the index."""

    def __init__(self, out):
        self.out, self.held, self.waiting = out, [], 0
        self.doc_ids: list[int | None] = []
        self.lengths: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.ids = 0
        out.write(MAGIC)

    def add(self, doc_ids: list, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.doc_ids += doc_ids
        self.lengths.append(lengths)
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= HELD:
            self._flush(self.waiting - self.waiting % BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        data, sizes = encode_blocks(ids[:n])
        self.out.write(data)
        self.sizes.append(sizes)
        self.ids += n
        self.held, self.waiting = [ids[n:]], len(ids) - n

    def close(self) -> tuple[int, int]:
        """Writes the rest and the index; the counts of documents and of ids."""
        self._flush(self.waiting)
        sizes = np.concatenate(self.sizes)
        starts = len(MAGIC) + np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum(np.concatenate([*self.lengths, np.zeros(0, np.int64)]))
        null = np.array([d is None for d in self.doc_ids], np.uint8)
        self.out.write(starts.astype("<u8").tobytes())
        self.out.write(np.array([d or 0 for d in self.doc_ids], "<i8").tobytes())
        self.out.write(null.tobytes())
        self.out.write(ends.astype("<u8").tobytes())
        self.out.write(np.array([len(null), self.ids, len(sizes)], "<u8").tobytes() + MAGIC)
        return len(null), self.ids


@dataclass(frozen=True)
class Index:
    """The index of a file: where blocks start (and the last ends), doc ids, whether each is null, ends in ids."""

    starts: np.ndarray
    doc_ids: np.ndarray
    null: np.ndarray
    ends: np.ndarray


def read_index(source) -> Index:
    """The index of an open file that can seek; its blocks aren't read."""
    size = source.seek(0, 2)
    source.seek(max(0, size - 32))
    tail = source.read(32)
    source.seek(0)
    if len(tail) < 32 or tail[-8:] != MAGIC or source.read(8) != MAGIC:
        raise ValueError("not a token file, or not a whole one")
    docs, _ids, blocks = (int(v) for v in np.frombuffer(tail[:24], "<u8"))
    source.seek(size - 32 - 17 * docs - 8 * (blocks + 1))
    starts, doc_ids, null, ends = (np.frombuffer(source.read(n * np.dtype(t).itemsize), t) for n, t in ((blocks + 1, "<u8"), (docs, "<i8"), (docs, "u1"), (docs, "<u8")))
    return Index(starts.astype(np.int64), doc_ids, null.astype(bool), ends.astype(np.int64))


def read_ids(source, index: Index, first: int, end: int) -> np.ndarray:
    """The ids first .. end - 1 of an open file: only the blocks that hold them are read."""
    a, b = first // BLOCK, -(-end // BLOCK)
    source.seek(int(index.starts[a]))
    data = np.frombuffer(source.read(int(index.starts[b] - index.starts[a])), np.uint8)
    return decode_blocks(data, index.starts[a:b] - index.starts[a])[first - a * BLOCK : end - a * BLOCK]


WRITTEN = "part long, file long, docs long, ids long"


def write_files(documents: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, fold: bool = False) -> list[tuple[str, int]]:
    """Writes the ids of all documents into files under ``folder``, in ascending order of
    doc_id over the files (nulls first; equal ids by the first HEAD characters of the text,
    then by a hash of it). Returns each file's name and the count of ids before it.

    ``fold``: the vocabulary lower-cases and drops white space.

    A task writes under names of its attempt and renames at the end of each file, so an attempt
    that is lost or repeated leaves whole files: a task that runs again cuts its files alike.
    """
    from pyarrow import fs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        ids_of = encoder(vocabulary, fold)
        part, file, out, writer = context.partitionId(), 0, None, None
        attempt = f"{root}/_{part:08d}-{context.taskAttemptId()}"

        def close() -> pa.RecordBatch:
            docs, ids = writer.close()
            out.close()
            store.move(attempt, f"{root}/{file_name(part, file)}")
            return pa.RecordBatch.from_pydict({"part": [part], "file": [file], "docs": [docs], "ids": [ids]})

        for batch in batches:
            docs = batch.column(0).to_pylist()
            for first, ids, counts in ids_of.rows(batch.column(1)):
                ids, lengths = np.insert(ids, np.cumsum(counts), end_id), counts + 1
                ends = np.cumsum(lengths)
                a = 0
                while a < len(lengths):
                    if writer is None:
                        out = store.open_output_stream(attempt)
                        writer = FileWriter(out)
                    before = int(ends[a - 1]) if a else 0
                    room = FILE_IDS - writer.ids - writer.waiting
                    b = min(int(np.searchsorted(ends, before + room)) + 1, len(lengths), a + FILE_DOCS - len(writer.doc_ids))
                    writer.add(docs[first + a : first + b], ids[before : int(ends[b - 1])], lengths[a:b])
                    if writer.ids + writer.waiting >= FILE_IDS or len(writer.doc_ids) >= FILE_DOCS:
                        yield close()
                        writer, file = None, file + 1
                    a = b
        if writer is not None:
            yield close()

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)
    # Ids alone would put all rows of one id, null among them, into one task.
    rows = documents.select("doc_id", "text", F.substring("text", 1, HEAD).alias("head"), F.xxhash64("text").alias("key"))
    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "head", "key")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    done = in_batches(ordered).mapInArrow(run, WRITTEN).collect()  # a row for each file of FILE_IDS ids
    out, before = [], 0
    for r in sorted(done, key=lambda r: (r["part"], r["file"])):
        out.append((file_name(r["part"], r["file"]), before))
        before += r["ids"]
    return out


#: Characters of the text that put rows of one id in order.
HEAD = 64


def file_name(part: int, file: int) -> str:
    return f"{part:08d}-{file:06d}.ids"


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_files(spark: SparkSession, folder: str, files: list[tuple[str, int]]) -> DataFrame:
    """One row per document of the files: its place among all ids, its count of ids and their
    crc32. A task reads a file's index and then some blocks at a time, by their starts."""
    from pyarrow import fs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, before in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(f"{root}/{name}") as source:
                    index = read_index(source)
                    ends = index.ends
                    begins = np.concatenate([[0], ends[:-1]])
                    k = 0
                    while k < len(ends):
                        last = max(k + 1, int(np.searchsorted(ends, begins[k] + READ_IDS, "right")))
                        a = int(begins[k])
                        raw = memoryview(read_ids(source, index, a, int(ends[last - 1])).astype("<u4", copy=False).tobytes())
                        crc = [zlib.crc32(raw[4 * (x - a) : 4 * (y - a)]) for x, y in zip(begins[k:last].tolist(), ends[k:last].tolist())]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(index.doc_ids[k:last], mask=index.null[k:last]), pa.array(before + begins[k:last]), pa.array(ends[k:last] - begins[k:last]), pa.array(crc, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        k = last

    names = spark.createDataFrame(files, "name string, before long")
    # A task for each file, as far as tasks are worth their start.
    return names.repartition(max(1, min(len(files), 10_000))).mapInArrow(run, READ)


def op10_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents (null text: empty), written to token files and read back from them."""
    import public_tokenizers

    folder = scratch_path(spark, "token-files")
    files = write_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), fold=True)
    return read_files(spark, folder, files)
