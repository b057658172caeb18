"""Sum-of-squares online packing of documents into sequences of fixed size.

A document longer than a sequence gives whole sequences of its own; what remains is placed,
as it arrives, into the fill level whose choice leaves the least sum of squared counts of
partially filled sequences. The counts stand in a level array. Every task packs the
documents it reads, so there is no shuffle.

At most MAX_OPEN sequences stay open, which bounds a task's memory at MAX_OPEN * size ids.
Beyond that, and at the task's end, the fullest open sequence is closed where it stands: what
it lacks is cut off the emptiest one. So only what would be padded is split.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from floppyscope.llm.common import in_batches, table
from floppyscope.llm.tokens import encoder

SIZE = 1024
END_ID = 0
#: Partially filled sequences that a task holds at most.
MAX_OPEN = 4096

PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Places pieces of documents; rows come out once their sequence is closed."""

    def __init__(self, size: int = SIZE, first_sequence: int = 0, max_open: int = MAX_OPEN):
        self.size = size
        self.max_open = max_open
        self.filled = 0  # ids cut off one open sequence to fill another
        self.next = first_sequence
        self.levels = np.zeros(size + 1, np.int64)  # levels[f]: open sequences that hold f ids
        self.open: list[list[tuple[int, list]]] = [[] for _ in range(size + 1)]
        self.rows: list[tuple] = []

    def _sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def _row(self, piece: tuple, sequence: int, offset: int) -> None:
        doc, start, ids, total = piece
        self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset))

    def level_for(self, n: int) -> int:
        """The fill level to place ``n`` ids on; 0 opens a sequence.

        Moving a sequence from level f to f + n changes the sum of squares by
        2 (count[f + n] - count[f] + 1), opening one by 2 count[n] + 1, and a sequence that
        gets full leaves the counts: 1 - 2 count[f].
        """
        fits = self.levels[1 : self.size - n + 1]
        cost = 2 * (self.levels[n + 1 : self.size + 1] - fits + 1)
        if len(cost):
            cost[-1] = 1 - 2 * fits[-1]
            cost = np.where(fits > 0, cost, np.iinfo(np.int64).max)
            f = int(cost.argmin()) + 1
            if cost[f - 1] <= 2 * self.levels[n] + 1:
                return f
        return 0

    def add(self, doc, ids: np.ndarray) -> None:
        total = len(ids)
        whole = total - total % self.size
        for start in range(0, whole, self.size):
            self._row((doc, start, ids[start : start + self.size], total), self._sequence(), 0)
        if n := total - whole:
            piece = (doc, whole, ids[whole:].copy(), total)
            f = self.level_for(n)
            if f:
                self.levels[f] -= 1
                sequence, pieces = self.open[f].pop()
            else:
                sequence, pieces = self._sequence(), []
            pieces.append(piece)
            if f + n == self.size:
                self._close(sequence, pieces)
            else:
                self._keep(f + n, sequence, pieces)
                if self.levels.sum() > self.max_open:
                    self._close_fullest()

    def _keep(self, level: int, sequence: int, pieces: list) -> None:
        self.levels[level] += 1
        self.open[level].append((sequence, pieces))

    def _close(self, sequence: int, pieces: list) -> None:
        offset = 0
        for piece in pieces:
            self._row(piece, sequence, offset)
            offset += len(piece[2])

    def _take(self, level: int) -> tuple[int, list]:
        self.levels[level] -= 1
        return self.open[level].pop()

    def _close_fullest(self) -> None:
        """Closes the fullest of two or more open sequences; the emptiest ones fill it up."""
        level = int(np.flatnonzero(self.levels)[-1])
        sequence, pieces = self._take(level)
        while level < self.size and self.levels.any():
            low = int(np.flatnonzero(self.levels)[0])
            other, left = self._take(low)
            n = min(self.size - level, low)
            self.filled += n
            level += n
            low -= n
            while n:
                doc, start, ids, total = left.pop()
                cut = max(0, len(ids) - n)
                if cut:
                    left.append((doc, start, ids[:cut], total))
                pieces.append((doc, start + cut, ids[cut:], total))
                n -= len(ids) - cut
            if low:
                self._keep(low, other, left)
        if level == self.size:
            self._close(sequence, pieces)
        else:
            self._keep(level, sequence, pieces)

    def finish(self) -> None:
        """Closes what is open. The ids of the last sequence, if they don't fill it, are cut
        into sequences of falling powers of two, which need no padding."""
        while self.levels.sum() > 1:
            self._close_fullest()
        if not self.levels.any():
            return
        level = int(np.flatnonzero(self.levels)[0])
        left = self._take(level)[1]
        sizes = [1 << k for k in range(self.size.bit_length() + 1) if level >> k & 1]
        room, sequence, offset = 0, -1, 0
        for doc, start, ids, whole in left:
            at = 0
            while at < len(ids):
                if not room:
                    room, sequence, offset = sizes.pop(), self._sequence(), 0
                n = min(room, len(ids) - at)
                self._row((doc, start + at, ids[at : at + n], whole), sequence, offset)
                at, room, offset = at + n, room - n, offset + n

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(documents: DataFrame, vocabulary: str, end_id: int = END_ID, size: int = SIZE) -> DataFrame:
    """Packs every document (its ids, then ``end_id``) into sequences of ``size`` ids (a power of two).

    One row per piece. A null text counts as empty and packs as its end id alone; a null or
    repeated doc_id packs like any other row. ``sequence_id`` holds the task's partition in
    its upper bits, so a task that is run again gives the same rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(vocabulary)
        packer = Packer(size, TaskContext.get().partitionId() << 40)
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for first, ids, counts in ids_of.rows(batch.column(1)):
                ends = np.cumsum(counts)
                for k, (b, n) in enumerate(zip(ends.tolist(), counts.tolist())):
                    packer.add(docs[first + k], np.append(ids[b - n : b], np.uint32(end_id)))
            yield _batch(packer.taken())
        packer.finish()
        yield _batch(packer.taken())

    return in_batches(documents.select("doc_id", "text")).mapInArrow(run, PACKED)


_NAMES = [c.split()[0] for c in PACKED.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _NAMES)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
