"""Pictures of paint programs that pack their pixels: PI, MAG, G9B, DD-Graph, Dynamic Publisher, MIF and MIG.

Each decoder gives 0x00RRGGBB pixels or None.
"""

from __future__ import annotations

import numpy as np

from floppyscope.functions import pictures


class Bits:
    """Bits of bytes, the highest first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at * 8

    def take(self, n: int = 1) -> int:
        if self.at + n > len(self.data) * 8:
            raise ValueError("picture data ends early")
        value = 0
        for k in range(self.at, self.at + n):
            value = value << 1 | self.data[k >> 3] >> (7 - (k & 7)) & 1
        self.at += n
        return value


class Mixed:
    """Bits of bytes that are fetched when the last is used up, with whole bytes between them."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.held, self.left = data, at, 0, 0

    def byte(self) -> int:
        if self.at >= len(self.data):
            raise ValueError("picture data ends early")
        self.at += 1
        return self.data[self.at - 1]

    def bits(self, n: int = 1) -> int:
        value = 0
        for _ in range(n):
            if not self.left:
                self.held, self.left = self.byte(), 8
            self.left -= 1
            value = value << 1 | self.held >> self.left & 1
        return value

    def distance(self) -> int:
        """One to 128 in a byte; from 128 on four more bits are the upper part."""
        low = self.byte()
        return low + 1 if low < 128 else low + 1 + (self.bits(4) - 1 << 7)

    def skip(self, n: int) -> None:
        """A mark between blocks: lengths that tell nothing new, then fresh bits."""
        self.at, self.left = self.at + n, 0


def _copy(out: bytearray, distance: int, n: int, most: int) -> None:
    if not 0 < distance <= len(out) or len(out) + n > most:
        raise ValueError("picture reference out of range")
    for _ in range(n):
        out.append(out[-distance])


def three_bits(triples: bytes, order: str) -> np.ndarray:
    """A palette of eight-bit triples with the machine's three bits a component."""
    raw = np.frombuffer(triples, np.uint8).astype(np.int64).reshape(-1, 3) >> 5
    part = {c: raw[:, k] for k, c in enumerate(order)}
    return pictures.expand(part["r"], part["g"], part["b"])


# ------------------------------------------------------------------ PI


def _pi_indexes(data: bytes, at: int, width: int, height: int, depth: int) -> np.ndarray:
    """Colours, two at a time: copies from five places, or literals, which are ranks in a list of
    recent colours that is kept for every colour before."""
    bits, n = Bits(data, at), width * height
    recent = [[(c - k) % (1 << depth) for k in range(1 << depth)] for c in range(1 << depth)]
    out = [0] * (n + 2)

    def number(low: int, most: int) -> int:
        while low < most and bits.take():
            low += 1
        return 1 << low | (bits.take(low) if low else 0)

    def literals(k: int) -> None:
        for i in range(k, min(k + 2, n)):
            rank = bits.take() if bits.take() else number(1, depth - 1)
            row = recent[out[i - 1] if i else 0]
            out[i] = row.pop(rank)
            row.insert(0, out[i])

    literals(0)
    k, before = 0, None
    while k < n:
        place = bits.take(2)
        if place == 3:
            place += bits.take()
        if place == before:
            while True:
                literals(k)
                k += 2
                if k >= n or not bits.take():
                    break
            before = None
            continue
        before = place
        count = 2 * number(0, 23)
        last = max(k - 2, 0)
        step = (2 if out[last] == out[last + 1] else 4, width, 2 * width, width - 1, width + 1)[place]
        for i in range(k, min(k + count, n)):
            out[i] = out[i - step if i >= step else (i - step) & 1]
        k += count
    return np.array(out[:n]).reshape(height, width)


def pi(data: bytes, _mode: int, _more: dict[str, bytes]) -> np.ndarray | None:
    comment = data.find(b"\x1a", 2)
    head = data.find(b"\0", comment + 1) + 1 if comment >= 0 else 0
    if data[:2] != b"Pi" or not head or head + 14 > len(data) or data[head]:
        return None
    depth = data[head + 3]
    if depth not in (4, 8) or data[head + 4 : head + 8] not in (b"MSX1", b"MSX2", b"MSXP", b"MSXR"):
        return None
    at = head + 8 + 256 * data[head + 8] + data[head + 9]
    if at + 6 + (3 << depth) >= len(data):
        return None
    width, height = int.from_bytes(data[at + 2 : at + 4], "big"), int.from_bytes(data[at + 4 : at + 6], "big")
    if not 0 < width * height <= pictures.MAX_PIXELS:
        return None
    colours = three_bits(data[at + 6 : at + 6 + (3 << depth)], "rgb")
    try:
        image = colours[_pi_indexes(data, at + 6 + (3 << depth), width, height, depth)]
    except (ValueError, IndexError):
        return None
    return np.repeat(image, 2, axis=0) if data[head + 1 : head + 3] == b"\2\1" else image


# ------------------------------------------------------------------ MAG

#: Where a nibble points: pairs of (bytes to the left, lines up); 0 is a byte of its own.
SOURCES = ((0, 0), (2, 0), (4, 0), (8, 0), (0, 1), (2, 1), (0, 2), (2, 2), (4, 2), (0, 4), (2, 4), (4, 4), (0, 8), (2, 8), (4, 8), (0, 16))


def _mag_bytes(data: bytes, head: int, across: int, height: int) -> np.ndarray:
    word = lambda k: head + int.from_bytes(data[head + k : head + k + 4], "little")
    flags, flag_bytes, pixels = Bits(data, word(12)), word(16), word(24)
    groups = -(-across // 4)
    state = [0] * groups
    out = np.zeros((height, 4 * groups), np.uint8)
    for y in range(height):
        for g in range(groups):
            if flags.take():
                state[g] ^= data[flag_bytes]
                flag_bytes += 1
            for half, code in enumerate((state[g] >> 4, state[g] & 15)):
                x = 4 * g + 2 * half
                if code:
                    left, up = SOURCES[code]
                    if x < left or y < up:
                        raise ValueError("MAG source out of range")
                    out[y, x : x + 2] = out[y - up, x - left : x - left + 2]
                else:
                    out[y, x : x + 2] = np.frombuffer(data[pixels : pixels + 2].ljust(2, b"\0"), np.uint8)
                    if pixels >= len(data):
                        raise ValueError("MAG data ends early")
                    pixels += 2
    return out[:, :across].astype(np.int64)


def mag(data: bytes, _mode: int, _more: dict[str, bytes]) -> np.ndarray | None:
    head = data.find(b"\x1a") + 1
    if data[:8] != b"MAKI02  " or not head or head + 80 > len(data) or data[head] or data[head + 1] != 3:
        return None
    word = lambda k: int.from_bytes(data[head + k : head + k + 2], "little")
    many = data[head + 3] >= 0x80
    if many and head + 32 + 768 >= len(data):
        return None
    width = word(8) + 1 - (word(4) & ~(3 if many else 7))
    height = word(10) - word(6) + 1
    across = width if many else width + 1 >> 1
    if width < 1 or height < 1 or width * height > pictures.MAX_PIXELS:
        return None
    mode = data[head + 2] & 0xFC
    try:
        raw = _mag_bytes(data, head, across, height)
    except (ValueError, IndexError):
        return None
    colours = three_bits(data[head + 32 : head + 32 + (768 if many else 48)], "grb")
    if mode in (0x20, 0x24, 0x40, 0x44):
        image = pictures.yjk(raw, colours if mode in (0x20, 0x24) else None)
        return np.repeat(image, 2, axis=1) if mode in (0x20, 0x40) else image
    if mode in (0x60, 0x64):
        image = colours[pictures._parts(raw, 2)]
        return np.repeat(image, 2, axis=0) if mode == 0x64 else image
    if mode not in (0x00, 0x14, 0x54, 0x04, 0x10, 0x50):
        return None
    image = colours[raw if many else pictures._parts(raw, 4)][:, :width]
    return np.repeat(image, 2, axis=0) if mode == 0x04 else np.repeat(image, 2, axis=1) if mode in (0x10, 0x50) else image


# ------------------------------------------------------------------ G9B


def _g9b_bytes(data: bytes, head: int, size: int) -> bytes:
    """Literals, and copies whose length comes bit by bit, each announced by a one; a length of
    sixteen bits marks the end of a block."""
    stream, out = Mixed(data, head + 3), bytearray()
    while len(out) < size:
        if not stream.bits():
            out.append(stream.byte())
            continue
        n = 1
        while n < 1 << 16 and stream.bits():
            n = n << 1 | stream.bits()
        if n >= 1 << 16:
            stream.skip(2)
        else:
            _copy(out, stream.distance(), n + 1, size)
    return bytes(out)


def g9b(data: bytes, _mode: int, _more: dict[str, bytes]) -> np.ndarray | None:
    if data[:5] != b"G9B\x0b\0" or len(data) < 17 or data[12] > 1:
        return None
    depth, kind, colours = data[5], data[6], data[7]
    width, height = int.from_bytes(data[8:10], "little"), int.from_bytes(data[10:12], "little")
    head, across = 16 + 3 * colours, -(-width * depth // 8)
    if depth not in (2, 4, 8, 16) or not 0 < width * height <= pictures.MAX_PIXELS:
        return None
    if data[12]:
        try:
            data = data[:head] + _g9b_bytes(data, head, across * height)
        except ValueError:
            return None
    if len(data) != head + across * height:
        return None
    if depth < 8 and colours != 1 << depth or depth == 8 and colours not in (0, 64):
        return None
    raw = pictures._bytes(data, head, height, across)
    if depth == 16:
        c = raw[:, 0::2] | raw[:, 1::2] << 8
        return pictures.expand(c >> 5 & 31, c >> 10 & 31, c & 31, 5)
    if colours:
        triples = np.frombuffer(data[16:head], np.uint8).astype(np.int64).reshape(-1, 3)
        if (triples > 31).any():
            return None
        table = np.zeros(256, np.int64)
        table[:colours] = pictures.expand(triples[:, 0], triples[:, 1], triples[:, 2], 5)
        return table[pictures._parts(raw, depth)[:, :width]]
    if width & 3:
        return None
    if kind == 0x40:
        return pictures.grb332()[raw]
    if kind == 0x80:
        return pictures.yjk(raw, None)
    if kind != 0xC0:
        return None
    y, low = raw >> 3, (raw & 7).reshape(height, -1, 4)
    signed = lambda v: np.repeat(v - ((v & 0x20) << 1), 4, axis=1)
    v, u = signed(low[:, :, 0] | low[:, :, 1] << 3), signed(low[:, :, 2] | low[:, :, 3] << 3)
    clip = lambda c: np.clip(c, 0, 31)
    return pictures.expand(clip(y + u), clip(((5 * y - v >> 1) - u) >> 1), clip(y + v), 5)


# ------------------------------------------------------------------ DD-Graph and Dynamic Publisher


def dd_graph(data: bytes, _mode: int, more: dict[str, bytes]) -> np.ndarray | None:
    """Zeros are left out under two layers of presence bits; lines after the first ones are
    differences from the line above. All of the file has to be used."""
    if len(data) < 4 or not 0 < data[0] <= 128 or not 0 < data[1] <= 212 or not 0 < data[2] <= data[1]:
        return None
    width, height, plain = data[:3]
    at, out = 3, bytearray()

    def some(mask: int) -> bytes:
        nonlocal at
        n = mask.bit_count()
        if at + n > len(data):
            raise ValueError("picture data ends early")
        given = iter(data[at : at + n])
        at += n
        return bytes(next(given) if mask >> k & 1 else 0 for k in range(7, -1, -1))

    need = width * height
    try:
        while len(out) < need:
            if at >= len(data):
                return None
            at += 1
            masks = some(data[at - 1])
            for mask in masks:
                left = need - len(out)
                if left <= 0:
                    break
                # Of the last group only what the picture needs is there.
                out += some(mask if left >= 8 else mask & (0xFF00 >> left) & 0xFF)
    except ValueError:
        return None
    if at != len(data):
        return None
    raw = np.frombuffer(bytes(out[:need]), np.uint8).astype(np.int64).reshape(height, width)
    raw = np.concatenate([raw[: plain - 1], np.bitwise_xor.accumulate(raw[plain - 1 :], axis=0)]) if plain < height else raw
    own = more.get("pl5", b"")
    return (pictures.palette(own) if len(own) >= 32 else pictures.palette(pictures.DEFAULT))[pictures._parts(raw, 4)]


def publisher(data: bytes, _mode: int, _more: dict[str, bytes]) -> np.ndarray | None:
    """Black on white, 512 across, in runs: up to 127 as literals less one, else copies."""
    if len(data) < 384 or data[:7] not in (b"DYNAMIC", b"E U R O") or data[7:18] != b" PUBLISHER ":
        return None
    lines, at = (704, 0x180) if data[18:24] == b"SCREEN" else (160, 0x200) if data[18:22] == b"FONT" else (0, 0)
    out, need = bytearray(), 64 * lines
    while len(out) < need and at < len(data):
        b = data[at]
        if b < 128:
            out += data[at + 1 : at + 2 + b]
            at += 2 + b
        else:
            out += data[at + 1 : at + 2] * (b - 127)
            at += 2
    if not need or len(out) < need:
        return None
    raw = pictures._bytes(bytes(out), 0, lines, 64)
    bits = pictures._parts(raw >> 4 | raw << 4 & 0xF0, 1)  # the low nibble stands to the left
    return np.repeat(np.where(bits, 0, 0xFFFFFF), 2, axis=0)


# ------------------------------------------------------------------ MIF


def _mif_bytes(data: bytes, at: int, size: int) -> bytes:
    """Literal bytes, or codes that name an earlier step: its bytes and the one after them. The
    newest code starts the list anew; the last code and the end of the file have to meet."""
    stream, out = Mixed(data, at), bytearray()
    steps: list[int] = []
    width = 2
    while len(out) < size:
        if len(steps) >= 16384 // 3:
            raise ValueError("too many steps")
        steps.append(len(out))
        if len(steps) >> width:
            width += 1
        if stream.bits():
            out.append(stream.bits(8))
            continue
        code = stream.bits(width)
        if code >= len(steps):
            raise ValueError("no such step")
        if code == len(steps) - 1:
            steps, width = [], 2
            continue
        first, last = steps[code], steps[code + 1]
        if len(out) + last - first >= size:
            raise ValueError("picture reference out of range")
        for k in range(first, last + 1):
            out.append(out[k])
    if stream.bits() or stream.bits(width) <= len(steps) or stream.at != len(data):
        raise ValueError("picture data doesn't end here")
    return bytes(out)


#: Video mode by the first byte; from 16 on the picture has 424 lines.
MIF_MODES = {0: 5, 1: 6, 2: 7, 3: 8, 4: 10, 5: 12, 8: 4, 9: 3}


def mif(data: bytes, _mode: int, _more: dict[str, bytes]) -> np.ndarray | None:
    kind, tall = (data[0] & 15, data[0] >> 4 == 1) if data else (0, False)
    mode = MIF_MODES.get(kind)
    if len(data) < 35 or data[0] > 0x15 or mode is None or tall and kind > 5:
        return None
    lines = 424 if tall else 212
    size = {4: 14336, 3: 1536}.get(mode) or lines * (128 if mode <= 6 else 256)
    own = kind not in (3, 5)
    try:
        raw = _mif_bytes(data, 34 if own else 2, size)
    except ValueError:
        return None
    colours = pictures.palette(data, 2) if own else pictures.grb332()
    if mode == 4:
        return pictures.pattern_screen(bytes(7) + raw, colours)
    if mode == 3:
        return pictures.block_screen(bytes(7) + raw, colours, False)
    image = pictures.bitmap(raw, 0, lines, mode, colours)
    if mode in (6, 7):
        return image if tall else np.repeat(image, 2, axis=0)
    return np.repeat(image, 2, axis=1) if tall else image


# ------------------------------------------------------------------ MIG

MIG_MOST = 108_800
#: Video mode by the mode bits of registers 0, 1 and 25, and by the count of 256-byte rows.
MIG_MODES = {(0x02, 0, 0, 0x38): 2, (0, 0x08, 0, 0x06): 3, (0x06, 0, 0, 0x6A): 5, (0x08, 0, 0, 0x6A): 6, (0x0A, 0, 0, 0xD4): 7, (0x0E, 0, 0, 0xD4): 8, (0x0E, 0, 0x18, 0xD4): 10, (0x0E, 0, 0x08, 0xD4): 12}


def _mig_bytes(data: bytes) -> bytes:
    stream, out = Mixed(data, 15), bytearray()
    while len(out) < MIG_MOST:
        if not stream.bits():
            out.append(stream.byte())
            continue
        distance, n = stream.distance(), 0
        if distance > len(out):
            raise ValueError("picture reference out of range")
        while stream.bits():
            n += 1
        length = stream.bits(n)
        if n < 16:
            _copy(out, distance, length + (1 << n) + 1, MIG_MOST)
        else:
            stream.skip(4)
            if stream.at >= len(data):
                return bytes(out)
    raise ValueError("picture is too long")


def mig(data: bytes, _mode: int, _more: dict[str, bytes]) -> np.ndarray | None:
    """A stream of register writes, colours and one or two fields of a screen."""
    if len(data) < 16 or data[:6] != b"MSXMIG" or int.from_bytes(data[6:10], "little") != len(data) - 6:
        return None
    try:
        raw = _mig_bytes(data)
    except ValueError:
        return None
    registers, colours, at = [0] * 256, np.zeros(0, np.int64), 0
    while at + 2 < len(raw):
        if raw[at] == 0:
            for k in range(raw[at + 1]):
                r, value, mask = raw[at + 2 + 3 * k : at + 5 + 3 * k].ljust(3, b"\0")
                registers[r] = registers[r] & ~mask | value & mask
            at += 2 + 3 * raw[at + 1]
        elif raw[at] == 1 and not raw[at + 1]:
            colours = pictures.palette(raw, at + 3, raw[at + 2])
            at += 3 + 2 * raw[at + 2]
        elif raw[at] == 2 and at + 7 < len(raw) and not any(raw[at + 1 : at + 5]) and not raw[at + 6]:
            return _mig_screen(raw, at + 7, raw[at + 5], registers, colours)
        else:
            return None
    return None


def _mig_screen(raw: bytes, at: int, rows: int, registers: list[int], colours: np.ndarray) -> np.ndarray | None:
    mode = MIG_MODES.get((registers[0] & 0x0E, registers[1] & 0x18, registers[25] & 0x18, rows))
    fields = {0x00: 1, 0x0C: 2}.get(registers[9] & 0x0C)
    if mode is None or fields is None or len(raw) != at + fields * 256 * rows + (fields - 1) * 7 + 1:
        return None
    if len(colours) < {6: 4, 8: 0, 12: 0}.get(mode, 16) or mode < 5 and fields > 1:
        return None
    if mode == 2:
        return pictures.pattern_screen(raw[at - 7 :], colours)
    if mode == 3:
        return pictures.block_screen(raw[at - 7 :], colours, False)
    colours = pictures.grb332() if mode == 8 else colours
    if fields == 2 and (raw[at + 256 * rows] != 2 or raw[at + 256 * rows + 5] != rows):
        return None
    images = [pictures.bitmap(raw, at + k * (256 * rows + 7), 212, mode, colours) for k in range(fields)]
    if fields == 2:
        both = np.stack(images, axis=1).reshape(424, -1)
        return both if mode in (6, 7) else np.repeat(both, 2, axis=1)
    return np.repeat(images[0], 2, axis=0) if mode in (6, 7) else images[0]


pictures.BY_EXTENSION.update({"pi": (pi, 0), **dict.fromkeys(("mag", "mki", "max"), (mag, 0)), "g9b": (g9b, 0), "cmp": (dd_graph, 0), "mif": (mif, 0), "mig": (mig, 0), **dict.fromkeys(("pct", "fnt", "mis"), (publisher, 0))})
pictures.MAGICS += [(b"G9B\x0b\0", (g9b, 0)), (b"MAKI02  ", (mag, 0)), (b"Pi", (pi, 0))]
