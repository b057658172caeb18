"""Token ids by the tokenizers library, with each distinct piece of text encoded once.

Neither vocabulary lets a token reach from a visible character into white space, or from a
letter into punctuation other than the apostrophe. So a text may be cut before a blank or a
line feed that follows a visible character, and before such a mark that follows a letter: its
ids are the ids of the pieces, in order. Pieces repeat (words do), so a worker encodes a piece
when it first meets it and copies the ids after that. Pieces are looked up by a hash and then
compared byte by byte, so two pieces of one hash each get their own ids. Cuts are made only after characters that
are white space under no definition. A vocabulary that lower-cases and drops white space
(``fold``) gives a piece the ids of its lower-cased form without the blank before it.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from floppyscope.llm.common import LOWER, WIDE_BYTES, byte_table, ragged, same_bytes, span_hashes, string_chunks

#: Distinct pieces that a worker remembers at most, and their bytes; then it starts anew. Bounds memory only.
MAX_PIECES = 2_500_000
MAX_PIECE_BYTES = 32 << 20


class PieceEncoder:
    """Encodes columns of text into one array of ids and the count of ids of each row."""

    def __init__(self, path: str, fold: bool = False):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fold = fold
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # sorted
        self.slots = np.zeros(0, np.int32)  # of each hash, its place in the next two
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int32)
        self.ids = np.zeros(1 << 16, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.used = 0
        self.text = np.zeros(1 << 16, np.uint8)  # the bytes of all pieces
        self.text_start = np.zeros(0, np.int64)
        self.text_length = np.zeros(0, np.int64)
        self.text_used = 0

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        """Encodes spans of ``data`` that the worker doesn't hold, given in the order of their hashes."""
        raw = data.tobytes()
        encoded = self._encoded([raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())])
        n = ends - starts
        size = int(n.sum())
        while self.text_used + size > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        self.text[self.text_used : self.text_used + size] = data[ragged(starts, n)]
        self.text_start = np.concatenate([self.text_start, self.text_used + np.cumsum(n) - n])
        self.text_length = np.concatenate([self.text_length, n])
        self.text_used += size
        lengths = np.fromiter(map(len, encoded), np.int32, len(encoded))
        total, first = int(lengths.sum()), len(self.start)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(encoded), self.ids.dtype, total)
        self.start = np.concatenate([self.start, self.used + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.used += total
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.slots = np.insert(self.slots, at, np.arange(first, first + len(hashes), dtype=np.int32))

    def _encoded(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = _cuts(data, offsets)
        ends = np.append(starts[1:], len(data))
        row = np.searchsorted(starts, offsets)
        if self.fold:
            data = LOWER[data]
            starts = starts + ((data[starts] == 0x20) | (data[starts] == 0x0A))
        hashes = span_hashes(data, starts, ends)
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        n = ends - starts
        if len(self.hashes) + len(unique) > MAX_PIECES or self.text_used + int(n[first].sum()) > MAX_PIECE_BYTES:
            self._forget()
        at = np.searchsorted(self.hashes, unique)
        held = np.zeros(len(unique), bool)
        inside = at < len(self.hashes)
        held[inside] = self.hashes[at[inside]] == unique[inside]
        new = np.flatnonzero(~held)
        if len(new):
            self._learn(data, starts[first[new]], ends[first[new]], unique[new])
            at = np.searchsorted(self.hashes, unique)
        slot = self.slots[at][inverse]
        lengths = self.length[slot].astype(np.int64)
        # Every piece is compared with the one that its hash stands for; those that differ are encoded by themselves.
        alike = self.text_length[slot] == n
        some = np.flatnonzero(alike)
        alike[some] = same_bytes(data, starts[some], self.text, self.text_start[slot[some]], n[some])
        if alike.all():
            ids = self.ids[ragged(self.start[slot], lengths)].astype(np.uint32)
        else:
            raw, apart = data.tobytes(), np.flatnonzero(~alike)
            own = dict(zip(apart.tolist(), self._encoded([raw[a:b].decode() for a, b in zip(starts[apart].tolist(), ends[apart].tolist())])))
            parts = [own[k] if k in own else self.ids[self.start[i] : self.start[i] + self.length[i]] for k, i in enumerate(slot.tolist())]
            lengths = np.fromiter(map(len, parts), np.int64, len(parts))
            ids = np.concatenate([np.asarray(x, np.uint32) for x in parts])
        sums = np.concatenate([[0], np.cumsum(lengths)])
        return ids, sums[row[1:]] - sums[row[:-1]]

    def rows(self, column: pa.Array):
        """Yields (first row, ids of a run of rows, count of ids of each of them)."""
        for a, _b, data, offsets in string_chunks(column, WIDE_BYTES):
            if len(data):
                yield a, *self._chunk(data, offsets)
            else:
                yield a, np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)


@lru_cache(maxsize=2)
def encoder(path: str, fold: bool = False) -> PieceEncoder:
    """The encoder of this worker process, which goes on from task to task."""
    return PieceEncoder(path, fold)


#: ASCII letters, and ASCII punctuation without the apostrophe, and without the bar, which
#: follows a letter within special tokens.
_LETTER = byte_table(bytes([*range(65, 91), *range(97, 123)]))
_MARK = byte_table(bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'|"))


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces start: at each row, before blanks and line feeds after a character that is
    surely visible (ASCII 0x21 to 0x7E, or a letter of U+00C0 to U+00FF, lead byte 0xC3), and
    before marks after an ASCII letter."""
    blank = (data == 0x20) | (data == 0x0A)
    at = np.flatnonzero(blank[1:]) + 1
    before = data[at - 1]
    sure = (before > 0x20) & (before < 0x7F)
    sure |= (before >= 0x80) & (data[np.maximum(at - 2, 0)] == 0xC3) & (at >= 2)
    # A special token may hold a blank or swallow one beside it; neither vocabulary has such.
    cut = np.zeros(len(data) + 1, bool)
    cut[at[sure]] = True
    cut[1:-1] |= _LETTER[data[:-1]] & _MARK[data[1:]]
    cut[offsets] = True
    cut[-1] = False
    return np.flatnonzero(cut)
