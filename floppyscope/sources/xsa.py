"""The XSA container: LZ77 with an adaptive code for distances.

A bit 0 is followed by a literal byte, a bit 1 by a length and a distance. Flag bits are read
from the lowest of a byte that is fetched when the last is used up; literal bytes stand
between them. Lengths: 0 is 2, 10 is 3, 110 is 4; 111 is followed by one-bits (up to five,
closed by a zero below that), and then two more bits than there were of these, which after a
leading one give the length less one; 255 ends. Distances: one of 16 classes by the code, then
its extra bits; from eight extra bits on the low byte is literal.
"""

from __future__ import annotations

MAGIC = b"PCK\x08"
#: Extra bits of the distance classes; their first distances follow one another.
EXTRA = (0, 0, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)
FIRST = tuple(1 + sum(1 << e for e in EXTRA[:k]) for k in range(len(EXTRA)))
MAX_SECTORS = 65_536
MAX_LENGTH = 254
WINDOW = FIRST[-1] + (1 << EXTRA[-1]) - 1
#: Places with the same next bytes that the compressor tries at most.
TRIES = 64


class DistanceCode:
    """Prefix code over the 16 classes, rebuilt after every 128 uses from halved counts."""

    def __init__(self):
        self.uses = [0] * len(EXTRA)
        self._rebuild()

    def _rebuild(self) -> None:
        self.uses = [u >> 1 for u in self.uses]
        nodes: list = list(range(len(EXTRA)))  # a class, or a pair of nodes
        weight = [1 + u for u in self.uses]
        alive = list(range(len(EXTRA)))
        while len(alive) > 1:
            # The two lightest, of equal ones the first made; the lighter is the branch of bit 0.
            a, b = sorted(alive, key=lambda k: (weight[k], k))[:2]
            nodes.append((nodes[a], nodes[b]))
            weight.append(weight[a] + weight[b])
            alive = [k for k in alive if k not in (a, b)] + [len(nodes) - 1]
        self.tree = nodes[alive[0]]
        self.left = 127
        self._codes: list[tuple[int, ...]] | None = None

    def used(self, k: int) -> None:
        self.uses[k] += 1
        self.left -= 1
        if self.left < 0:
            self._rebuild()

    def code(self, k: int) -> tuple[int, ...]:
        if self._codes is None:
            found: dict[int, tuple[int, ...]] = {}
            todo = [(self.tree, ())]
            while todo:
                node, path = todo.pop()
                if isinstance(node, int):
                    found[node] = path
                else:
                    todo += [(node[0], (*path, 0)), (node[1], (*path, 1))]
            self._codes = [found[k] for k in range(len(EXTRA))]
        return self._codes[k]


def decompress(data: bytes) -> bytes:
    """The sectors of an XSA file; ValueError where it isn't one or is damaged."""
    if data[:4] != MAGIC or len(data) < 13:
        raise ValueError("not an XSA file")
    sectors = -(-int.from_bytes(data[4:8], "little") // 512)
    end = data.find(b"\0", 12)
    if not 0 < sectors <= MAX_SECTORS or end < 0:
        raise ValueError("XSA header out of range")
    pos, flags, count = end + 1, 0, 0
    size, out, code = sectors * 512, bytearray(), DistanceCode()

    def byte() -> int:
        nonlocal pos
        if pos >= len(data):
            raise ValueError("XSA data ends early")
        pos += 1
        return data[pos - 1]

    def bit() -> int:
        nonlocal flags, count
        if not count:
            flags, count = byte(), 8
        count -= 1
        flags, low = flags >> 1, flags & 1
        return low

    def bits(n: int, start: int = 0) -> int:
        for _ in range(n):
            start = start << 1 | bit()
        return start

    while True:
        if not bit():
            if len(out) == size:
                raise ValueError("XSA data is longer than declared")
            out.append(byte())
            continue
        length = 2
        while length < 5 and bit():
            length += 1
        if length == 5:
            n = 2
            while n < 7 and bit():
                n += 1
            length = bits(n, 1) + 1
        if length > MAX_LENGTH:
            return bytes(out) + bytes(size - len(out))
        node = code.tree
        while not isinstance(node, int):
            node = node[bit()]
        extra = EXTRA[node]
        low = byte() if extra >= 8 else 0
        distance = FIRST[node] + (low + 256 * bits(extra - 8) if extra >= 8 else bits(extra))
        code.used(node)
        if distance > len(out) or len(out) + length > size:
            raise ValueError("XSA reference out of range")
        for _ in range(length):
            out.append(out[-distance])


def compress(data: bytes, name: str = "image.dsk") -> bytes:
    """An XSA file that ``decompress`` turns back into ``data`` (filled up to whole sectors)."""
    out, code = bytearray(), DistanceCode()
    flag_at, count = -1, 8

    def bit(b: int) -> None:
        nonlocal flag_at, count
        if count == 8:
            flag_at, count = len(out), 0
            out.append(0)
        out[flag_at] |= b << count
        count += 1

    def bits(value: int, n: int) -> None:
        for k in range(n - 1, -1, -1):
            bit(value >> k & 1)

    def length_code(n: int) -> None:
        if n < 5:
            for _ in range(n - 2):
                bit(1)
            bit(0)
            return
        bits(7, 3)
        width = (n - 1).bit_length() - 1
        for _ in range(width - 2):
            bit(1)
        if width < 7:
            bit(0)
        bits(n - 1 - (1 << width), width)

    seen: dict[bytes, list[int]] = {}
    at = 0
    while at < len(data):
        best = distance = 0
        for p in reversed(seen.get(data[at : at + 3], [])[-TRIES:]):
            if at - p > WINDOW:
                break
            n = 3
            most = min(MAX_LENGTH, len(data) - at)
            while n < most and data[p + n] == data[at + n]:
                n += 1
            if n > best:
                best, distance = n, at - p
        if best < 3:
            bit(0)
            out.append(data[at])
            step = 1
        else:
            bit(1)
            length_code(best)
            k = max(c for c in range(len(FIRST)) if FIRST[c] <= distance)
            for b in code.code(k):
                bit(b)
            rest = distance - FIRST[k]
            if EXTRA[k] >= 8:
                out.append(rest & 255)
                bits(rest >> 8, EXTRA[k] - 8)
            else:
                bits(rest, EXTRA[k])
            code.used(k)
            step = best
        for p in range(at, at + step):
            if p + 3 <= len(data):
                seen.setdefault(data[p : p + 3], []).append(p)
        at += step
    bit(1)
    length_code(255)
    head = MAGIC + len(data).to_bytes(4, "little") + len(out).to_bytes(4, "little") + name.encode("ascii", "replace") + b"\0"
    return head + bytes(out)
