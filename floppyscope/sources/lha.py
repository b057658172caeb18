"""LHA-family archives: the member list, and the content of most members.

Stored: lh0, lz4, pm0. Packed: lh4 to lh7 (sliding window, codes per block), lh1 (sliding window,
one adaptive code), lzs and lz5 (plain sliding windows). Members packed otherwise are listed
with ``decodable`` false.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STORED = {"-lh0-", "-lz4-", "-pm0-"}
#: Bits of the window, and of the number that tells how many distance codes there are.
PACKED = {"-lh4-": (12, 4), "-lh5-": (13, 4), "-lh6-": (15, 5), "-lh7-": (16, 5)}


def crc16(data: bytes) -> int:
    """Reflected CRC-16 with the polynomial A001."""
    crc = 0
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ 0xA001 if crc & 1 else crc >> 1
    return crc


def members(data: bytes) -> list[dict]:
    """Members in order; a zero byte or the end of data ends the list."""
    out, at = [], 0
    while at < len(data) and data[at]:
        if at + 21 > len(data) or data[at + 2] != 0x2D:
            raise ValueError("archive header is damaged")
        method, level = data[at + 2 : at + 7].decode("latin-1"), data[at + 20]
        packed, size, stamp = (int.from_bytes(data[at + k : at + k + 4], "little") for k in (7, 11, 15))
        name, folder = b"", b""
        if level < 2:
            n = data[at + 21]
            name = data[at + 22 : at + 22 + n]
            crc = int.from_bytes(data[at + 22 + n : at + 24 + n], "little")
            start = at + 2 + data[at]
            extra = int.from_bytes(data[start - 2 : start], "little") if level == 1 else 0
        else:
            crc = int.from_bytes(data[at + 21 : at + 23], "little")
            extra, start = int.from_bytes(data[at + 24 : at + 26], "little"), at + 26
        end = start + packed if level < 2 else at + int.from_bytes(data[at : at + 2], "little") + packed
        if end > len(data):
            raise ValueError("archive member is cut off")
        while extra:  # extension headers: length, kind, body
            kind, body = data[start], data[start + 1 : start + extra - 2]
            name, folder = (body if kind == 1 else name), (body.replace(b"\xff", b"/") if kind == 2 else folder)
            start += extra
            extra = int.from_bytes(data[start - 2 : start], "little")
        path = (folder + name).decode("latin-1").replace("\\", "/")
        date, time = stamp >> 16, stamp & 0xFFFF
        month, day = date >> 5 & 15, date & 31
        modified = f"{1980 + (date >> 9):04}-{month:02}-{day:02} {time >> 11:02}:{time >> 5 & 63:02}" if level < 2 and month and day else None
        directory = method == "-lhd-"
        body_start = start if level < 2 else end - packed
        out.append({"idx": len(out), "path": path, "method": method, "original_size": size, "compressed_size": end - body_start, "modified": modified, "crc": crc, "is_directory": directory, "decodable": not directory and (method in STORED or method in PACKED or method in OTHERS), "start": body_start, "end": end})
        at = end
    return out


def extract(data: bytes, index: int) -> bytes:
    m = members(data)[index]
    body = data[m["start"] : m["end"]]
    if m["method"] in STORED:
        return body[: m["original_size"]]
    if m["method"] in OTHERS:
        return OTHERS[m["method"]](body, m["original_size"])
    if m["method"] not in PACKED:
        raise ValueError(f"{m['method']} can't be unpacked")
    return unpack(body, m["original_size"], *PACKED[m["method"]])


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.count = data, 0, 0, 0

    def peek(self, n: int) -> int:
        while self.count < n:
            self.held = self.held << 8 | (self.data[self.at] if self.at < len(self.data) else 0)
            self.at += 1
            self.count += 8
        return self.held >> self.count - n & (1 << n) - 1

    def skip(self, n: int) -> None:
        self.peek(n)
        self.count -= n
        self.held &= (1 << self.count) - 1

    def take(self, n: int) -> int:
        out = self.peek(n) if n else 0
        if n:
            self.skip(n)
        return out


class _Code:
    """A canonical prefix code from code lengths; a single symbol takes no bits."""

    def __init__(self, lengths: list[int], only: int | None = None):
        self.only, self.table = only, {}
        code = 0
        for n in range(1, 17):
            for symbol, length in enumerate(lengths):
                if length == n:
                    self.table[n, code] = symbol
                    code += 1
            code <<= 1

    def read(self, bits: _Bits) -> int:
        if self.only is not None:
            return self.only
        code = 0
        for n in range(1, 17):
            code = code << 1 | bits.take(1)
            if (n, code) in self.table:
                return self.table[n, code]
        raise ValueError("no such code")


def _lengths(bits: _Bits, width: int, gap: int | None) -> _Code:
    """A code whose lengths are three bits each, seven going on in unary; after ``gap`` of them
    two bits tell how many are zero."""
    n = bits.take(width)
    if not n:
        return _Code([], bits.take(width))
    lengths: list[int] = []
    while len(lengths) < n:
        k = bits.take(3)
        if k == 7:
            while bits.take(1):
                k += 1
        lengths.append(k)
        if len(lengths) == gap:
            lengths += [0] * bits.take(2)
    return _Code(lengths)


def _symbols(bits: _Bits, code: _Code) -> _Code:
    n = bits.take(9)
    if not n:
        return _Code([], bits.take(9))
    lengths: list[int] = []
    while len(lengths) < n:
        k = code.read(bits)
        lengths += [0] * (1, bits.take(4) + 3 if k == 1 else 0, bits.take(9) + 20 if k == 2 else 0)[k] if k < 3 else [k - 2]
    return _Code(lengths)


def unpack(data: bytes, size: int, window: int, width: int) -> bytes:
    """Blocks of symbols, each with its codes: literals, or a length and a distance class."""
    bits, out, left = _Bits(data), bytearray(), 0
    symbols = distances = _Code([], 0)
    while len(out) < size:
        if not left:
            left = bits.take(16) or 1 << 16
            symbols = _symbols(bits, _lengths(bits, 5, 3))
            distances = _lengths(bits, width, None)
        left -= 1
        s = symbols.read(bits)
        if s < 256:
            out.append(s)
            continue
        k = distances.read(bits)
        back = 1 + (k if k < 2 else (1 << k - 1) + bits.take(k - 1))
        for _ in range(min(s - 253, size - len(out))):
            out.append(out[-back] if back <= len(out) else 0x20)
        if bits.at > len(data) + 8:
            raise ValueError("archive data ends early")
    del window
    return bytes(out)


class AdaptiveCode:
    """A prefix code over ``n`` symbols that adapts with every use.

    Nodes stand in falling order of their counts, leaves and inner nodes alike, and siblings
    side by side, the root last; a node whose count outgrows its neighbours changes places with
    the last of them. When the root's count is full, all are halved and the tree is rebuilt.
    """

    FULL = 0x8000

    def __init__(self, n: int):
        self.n, self.root = n, 2 * n - 2
        self.count = [1] * n + [0] * (n - 1)
        self.child: list = [("leaf", k) for k in range(n)] + [None] * (n - 1)  # a leaf's symbol, or the first of two siblings
        self.parent = [0] * (2 * n)
        self.place = list(range(n))  # of each symbol's leaf
        self._pair(0, n)

    def _pair(self, first: int, at: int) -> None:
        while at <= self.root:
            self.count[at] = self.count[first] + self.count[first + 1]
            self.child[at] = first
            self.parent[first] = self.parent[first + 1] = at
            first, at = first + 2, at + 1

    def _rebuild(self) -> None:
        leaves = [((self.count[k] + 1) // 2, self.child[k]) for k in range(self.root + 1) if isinstance(self.child[k], tuple)]
        count, child = [c for c, _ in leaves], [s for _, s in leaves]
        first = 0
        for _ in range(self.n - 1):  # the two least make a node, placed before none of its own count
            total = count[first] + count[first + 1]
            at = len(count)
            while at and count[at - 1] > total:
                at -= 1
            count.insert(at, total)
            child.insert(at, first)
            first += 2
        self.count, self.child = count, child
        for k, c in enumerate(child):
            if isinstance(c, tuple):
                self.place[c[1]] = k
            else:
                self.parent[c] = self.parent[c + 1] = k

    def used(self, symbol: int) -> None:
        if self.count[self.root] == self.FULL:
            self._rebuild()
        k = self.place[symbol]
        while True:
            self.count[k] += 1
            value = self.count[k]
            last = k
            while last < self.root and self.count[last + 1] < value:
                last += 1
            if last != k:
                self.count[k], self.count[last] = self.count[last], value
                a, b = self.child[k], self.child[last]
                self.child[k], self.child[last] = b, a
                for node, c in ((last, a), (k, b)):
                    if isinstance(c, tuple):
                        self.place[c[1]] = node
                    else:
                        self.parent[c] = self.parent[c + 1] = node
                k = last
            if k == self.root:
                return
            k = self.parent[k]

    def read(self, bits: _Bits) -> int:
        node = self.child[self.root]
        while not isinstance(node, tuple):
            node = self.child[node + bits.take(1)]
        self.used(node[1])
        return node[1]

    def path(self, symbol: int) -> list[int]:
        """The bits that lead to a symbol, for an encoder."""
        out, k = [], self.place[symbol]
        while k != self.root:
            up = self.parent[k]
            out.append(k - self.child[up])
            k = up
        return out[::-1]


#: Code lengths of the upper six bits of a distance.
HIGH = [3] + [4] * 3 + [5] * 8 + [6] * 12 + [7] * 24 + [8] * 16


def unpack_lh1(data: bytes, size: int) -> bytes:
    bits, out = _Bits(data), bytearray()
    symbols, high = AdaptiveCode(314), _Code(HIGH)
    while len(out) < size:
        if bits.at > len(data) + 8:
            raise ValueError("archive data ends early")
        s = symbols.read(bits)
        if s < 256:
            out.append(s)
            continue
        back = (high.read(bits) << 6 | bits.take(6)) + 1
        for _ in range(min(s - 253, size - len(out))):
            out.append(out[-back] if back <= len(out) else 0x20)
    return bytes(out)


def _ring(size: int, ring: bytearray, start: int, steps: Iterator[tuple]) -> bytes:
    """Literals, and copies from places of a ring that is written along."""
    out, at = bytearray(), start
    for step in steps:
        source, n = step if len(step) == 2 else (None, 1)
        for k in range(n):
            b = step[0] if source is None else ring[(source + k) % len(ring)]
            ring[at] = b
            at = (at + 1) % len(ring)
            out.append(b)
            if len(out) == size:
                return bytes(out)
    raise ValueError("archive data ends early")


def unpack_lzs(data: bytes, size: int) -> bytes:
    def steps() -> Iterator[tuple]:
        bits = _Bits(data)
        while bits.at <= len(data) + 2:
            if bits.take(1):
                yield (bits.take(8),)
            else:
                place = bits.take(11)
                yield place, bits.take(4) + 2

    return _ring(size, bytearray(b" " * 2048), 2048 - 17, steps()) if size else b""


def unpack_lz5(data: bytes, size: int) -> bytes:
    ring = bytearray(b"".join(bytes([k]) * 13 for k in range(256)) + bytes(range(256)) + bytes(range(255, -1, -1)) + bytes(128) + b" " * 128)

    def steps() -> Iterator[tuple]:
        at = 0
        while at < len(data):
            flags = data[at]
            at += 1
            for k in range(8):
                if at >= len(data):
                    return
                if flags >> k & 1:
                    yield (data[at],)
                    at += 1
                elif at + 1 < len(data):
                    yield data[at] | (data[at + 1] & 0xF0) << 4, (data[at + 1] & 15) + 3
                    at += 2
                else:
                    return

    return _ring(size, ring, 4096 - 18, steps()) if size else b""


OTHERS = {"-lh1-": unpack_lh1, "-lzs-": unpack_lzs, "-lz5-": unpack_lz5}

MEMBERS = "file_path string, idx int, path string, original_size long, compressed_size long, method string, modified string, is_directory boolean, decodable boolean, error string"


def member_table(files: DataFrame) -> DataFrame:
    """One row per member of archive files (path, content); a damaged archive gives one row with its error."""
    fields = pa.schema([("file_path", pa.string()), ("idx", pa.int32()), ("path", pa.string()), ("original_size", pa.int64()), ("compressed_size", pa.int64()), ("method", pa.string()), ("modified", pa.string()), ("is_directory", pa.bool_()), ("decodable", pa.bool_()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows = [{"file_path": path, **{k: m[k] for k in fields.names[1:-1]}, "error": None} for m in members(content or b"")]
                except (ValueError, IndexError) as e:
                    rows = [{"file_path": path, "error": str(e)}]
                yield pa.RecordBatch.from_pylist(rows, fields)

    return files.select("path", "content").mapInArrow(run, MEMBERS).withColumn("modified", F.try_to_timestamp("modified", F.lit("yyyy-MM-dd HH:mm")))
