"""Pictures of the video chip's screen modes, as 0x00RRGGBB arrays.

A picture is decoded by its extension, and where that fails by the shape of its content. Modes
of 512 pixels to a line show every line twice; a second field (a companion file) makes 424
lines of a picture of 212.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MAX_PIXELS = 2_000_000
# The first chip's colours, the second's default palette (bytes RB, 0G) and the colours of its four-colour mode.
FIRST_CHIP = (0x000800, 0x000400, 0x3ABB43, 0x70D377, 0x5459D7, 0x7B7BE8, 0xB3634B, 0x61DFE7, 0xD46A53, 0xF88E77, 0xC7C759, 0xD9D481, 0x36A53B, 0xB06BAE, 0xC7D0C5, 0xFAFFF8)
DEFAULT = bytes.fromhex("0000000011063307170127035101270671017303610664061104650255057707")
FOUR = (0x000000, 0x249224, 0x24DB24, 0x6DFF6D)
# Colours of sprites in the 256-colour mode.
SPRITES = bytes.fromhex("0000020030003200000302033003320372040700700077000007070770077707")
BLUES = np.array([0, 2, 4, 7])


def expand(r, g, b, bits: int = 3):
    """Components of three or five bits as eight."""
    wide = (lambda v: v << 5 | v << 2 | v >> 1) if bits == 3 else (lambda v: v << 3 | v >> 2)
    return wide(r) << 16 | wide(g) << 8 | wide(b)


def palette(data: bytes, at: int = 0, colours: int = 16) -> np.ndarray:
    pairs = np.frombuffer(data[at : at + 2 * colours].ljust(2 * colours, b"\0"), np.uint8).astype(np.int64).reshape(-1, 2)
    return expand(pairs[:, 0] >> 4 & 7, pairs[:, 1] & 7, pairs[:, 0] & 7)


def is_palette(data: bytes, at: int) -> bool:
    raw = data[at : at + 32]
    return len(raw) == 32 and any(raw) and not any(b & (0x88, 0xF8)[k & 1] for k, b in enumerate(raw))


def grb332() -> np.ndarray:
    c = np.arange(256)
    return expand(c >> 2 & 7, c >> 5, BLUES[c & 3])


def end_address(data: bytes) -> int:
    """The end word of a header whose other words are zero; -1 without one."""
    return data[3] | data[4] << 8 if len(data) >= 7 and data[1:3] == b"\0\0" and data[5:7] == b"\0\0" else -1


def unpack_saurus(data: bytes, size: int) -> bytes:
    """Runs: 0 and a count (0 is 256) and a value, 1 to 15 as the count and a value, else a byte
    itself. Data that ends early leaves zeros."""
    out, at = bytearray(), 0
    while len(out) < size and at < len(data):
        b = data[at]
        if b >= 16:
            out.append(b)
            at += 1
            continue
        skip = 2 if b else 3
        if at + skip > len(data):
            break
        count = b or data[at + 1] or 256
        out += bytes([data[at + skip - 1]]) * count
        at += skip
    return bytes(out[:size]).ljust(size, b"\0")


def _bytes(data: bytes, at: int, rows: int, width: int) -> np.ndarray:
    need = rows * width
    return np.frombuffer(data[at : at + need].ljust(need, b"\0"), np.uint8).reshape(rows, width).astype(np.int64)


def _parts(raw: np.ndarray, bits: int) -> np.ndarray:
    """Pixels of ``bits`` bits from bytes, the highest first."""
    per = 8 // bits
    return (raw[:, :, None] >> np.arange(per - 1, -1, -1) * bits & (1 << bits) - 1).reshape(raw.shape[0], -1)


def yjk(raw: np.ndarray, colours: np.ndarray | None) -> np.ndarray:
    """Brightness of each pixel and chroma of every four; with a palette odd brightness is a
    palette colour. Pixels of an incomplete four are grey."""
    y = raw >> 3
    whole = raw.shape[1] & ~3
    low = (raw[:, :whole] & 7).reshape(raw.shape[0], -1, 4)
    signed = lambda v: v - ((v & 0x20) << 1)
    k = np.repeat(signed(low[:, :, 0] | low[:, :, 1] << 3), 4, axis=1)
    j = np.repeat(signed(low[:, :, 2] | low[:, :, 3] << 3), 4, axis=1)
    out = expand(y, y, y, 5)
    b = y[:, :whole]
    clip = lambda v: np.clip(v, 0, 31)
    out[:, :whole] = expand(clip(b + j), clip(b + k), clip(5 * b - 2 * j - k + 2 >> 2), 5)
    return out if colours is None else np.where(y & 1, colours[np.minimum(y >> 1, len(colours) - 1)], out)


def pattern_screen(data: bytes, colours: np.ndarray) -> np.ndarray:
    """256 x 192 from patterns and colours of eight bytes a character, in thirds."""
    raw = np.frombuffer(data[7:].ljust(0x3800, b"\0"), np.uint8).astype(np.int64)
    y, x = np.mgrid[0:192, 0:256]
    name = raw[0x1800 + (y >> 3) * 32 + (x >> 3)]
    at = (y >> 6) * 0x800 + name * 8 + (y & 7)
    bit = raw[at] >> (7 - (x & 7)) & 1
    both = raw[0x2000 + at]
    return colours[np.where(bit, both >> 4, both & 15)]


def block_screen(data: bytes, colours: np.ndarray, named: bool) -> np.ndarray:
    """256 x 192 of blocks of four pixels."""
    raw = np.frombuffer(data[7:].ljust(0x4000, b"\0"), np.uint8).astype(np.int64)
    y, x = np.mgrid[0:192, 0:256]
    name = raw[0x800 + (y >> 3) * 32 + (x >> 3)] if named else (y & 0xE0) + (x >> 3)
    return colours[raw[name * 8 + (y >> 2 & 7)] >> np.where(x & 4, 0, 4) & 15]


def bitmap(data: bytes, at: int, lines: int, mode: int, colours: np.ndarray | None) -> np.ndarray:
    """Lines of a bitmap mode, each once: 5 (16 colours), 6 (4 of 512 pixels), 7 (16 of 512), 8 (256), 10 and 12 (chroma)."""
    raw = _bytes(data, at, lines, 128 if mode <= 6 else 256)
    if mode >= 10:
        return yjk(raw, colours if mode == 10 else None)
    return colours[_parts(raw, {5: 4, 6: 2, 7: 4, 8: 8}[mode])]


def sprites(image: np.ndarray, data: bytes, mode: int, attributes: int, patterns: int, colours: np.ndarray) -> None:
    """Draws the 32 sprites of 16 x 16 over an image: four to a line, or eight in later modes,
    where a colour with bit 6 is mixed into that of the sprite before it."""
    rd = lambda k: data[k] if 0 <= k < len(data) else 0
    later = mode >= 4
    wide = image.shape[1] // 256
    tall = image.shape[0] // (192 if mode <= 4 else 212)
    for y in range(192 if mode <= 4 else 212):
        shown, solid = np.zeros(256, np.int64), np.zeros(256, bool)  # colour so far; closed to further sprites
        opened = np.zeros(256, bool)
        left = 8 if later else 4
        for s in range(32):
            at = attributes + 4 * s
            top = rd(at)
            if top == (216 if later else 208):
                break
            row = (y - top - 1) & 0xFF
            if row >= 16:
                continue
            left -= 1
            if left < 0:
                break
            c = rd(attributes - 0x200 + 16 * s + row) if later else rd(at + 3)
            if not later or not c & 0x40:
                solid |= shown != 0
                opened |= ~solid
                open_here = ~solid
            else:
                open_here = ~solid & opened
            x0 = rd(at + 1) - (32 if c >= 0x80 else 0)
            place = patterns + ((rd(at + 2) & 0xFC) << 3) + row
            bits = rd(place) << 8 | rd(place + 16)
            for k in range(16):
                x = x0 + k
                if 0 <= x < 256 and bits >> (15 - k) & 1 and open_here[x]:
                    shown[x] |= c | (0x10 if later else 0)
        if shown.any():
            hit = np.flatnonzero(shown)
            for d in range(tall):
                line = image[y * tall + d]
                if mode == 6:
                    line[2 * hit], line[2 * hit + 1] = colours[shown[hit] >> 2 & 3], colours[shown[hit] & 3]
                else:
                    for e in range(wide):
                        line[wide * hit + e] = colours[shown[hit] & 15]


def _lines_128(data: bytes, all_lines: bool = False) -> int:
    end = end_address(data)
    if len(data) < 135 or data[0] != 0xFE or end < 127:
        return 0
    n = end + 1 >> 7
    if len(data) < 7 + 128 * n:
        return 0
    return n if all_lines and n == 256 else min(n, 212)


def _dump(data: bytes) -> bytes | None:
    """A raw or packed dump of 212 lines of 256 bytes."""
    end = end_address(data)
    if data[:1] == b"\xfe" and len(data) >= 54279 and end >= 0xD3FF:
        return data
    if data[:1] == b"\xfd" and end >= 0 and 7 + end == len(data):
        return bytes(7) + unpack_saurus(data[7:], 54272)
    return None


def _is_256(data: bytes) -> bool:
    return len(data) == 65543 and data[0] == 0xFE and end_address(data) == 0xFFFF


def _double(image: np.ndarray) -> np.ndarray:
    return np.repeat(image, 2, axis=0)


def _with_field(data: bytes, second: bytes | None, lines: int, mode: int, colours: np.ndarray | None) -> tuple[np.ndarray, bool]:
    """The image, and whether a second field made its odd lines."""
    need = 7 + lines * (128 if mode <= 6 else 256)
    first = bitmap(data, 7, lines, mode, colours)
    if second and len(second) >= need and second[0] == 0xFE and end_address(second) >= need - 8:
        both = np.stack([first, bitmap(second, 7, lines, mode, colours)], axis=1).reshape(2 * lines, -1)
        return (both if mode in (6, 7) else np.repeat(both, 2, axis=1)), True
    return (_double(first) if mode in (6, 7) else first), False


def screen(data: bytes, mode: int, more: dict[str, bytes]) -> np.ndarray | None:
    """A dump of one of the chip's screens with the FE header."""
    if data[:1] not in (b"\xfe", b"\xfd"):
        return None
    if mode in (2, 4):
        if len(data) < 14343 or end_address(data) < 0x37FF:
            return None
        own = is_palette(data, 0x1B87)
        colours = palette(data, 0x1B87) if own else np.array(FIRST_CHIP) if mode == 2 else palette(DEFAULT)
        image = pattern_screen(data, colours)
        if len(data) == 16391 or mode == 4 and len(data) > 16391:
            sprites(image, data, mode, 0x1B07 if mode == 2 else 0x1E07, 0x3807, colours)
        return image
    if mode == 3:
        if len(data) < 1543 or end_address(data) < 0x5FF:
            return None
        colours = palette(data, 0x2027) if is_palette(data, 0x2027) else np.array(FIRST_CHIP)
        image = block_screen(data, colours, len(data) >= 0xB07)
        if len(data) == 16391:
            sprites(image, data, 3, 0x1B07, 0x3807, colours)
        return image
    if mode in (5, 6):
        lines = _lines_128(data)
        if not lines:
            return None
        colours = palette(data, 0x7687) if len(data) >= 0x7687 + 32 else palette(DEFAULT)
        if mode == 6:
            colours = palette(data, 0x7687, 4) if len(data) >= 30351 else np.array(FOUR)
        image, field = _with_field(data, more.get(f"s1{mode}"), lines, mode, colours)
        if not field and len(data) == 32775:
            sprites(image, data, mode, 0x7607, 0x7807, colours)
        return image
    if mode == 7:
        if len(data) < 54279 or data[0] != 0xFE or end_address(data) < 0xD3FF:
            return None
        colours = palette(data, 0xFA87) if len(data) >= 0xFA87 + 32 else palette(DEFAULT)
        image, field = _with_field(data, more.get("s17"), 212, 7, colours)
        if not field and len(data) == 64167:
            sprites(image, data, 7, 0xFA07, 0xF007, colours)
        return image
    lines, source = (256, data) if _is_256(data) else (212, _dump(data))
    if mode == 12 and lines == 212 and data[0] == 0xFE and len(data) >= 49159 and end_address(data) == 0xBFFF:
        lines, source = 192, data
    if mode == 10 and (len(data) < 64167 or data[0] != 0xFE or end_address(data) < 0xD3FF):
        return None
    if source is None:
        return None
    colours = grb332() if mode == 8 else None
    if mode == 10:
        colours = (palette(more["pla"]) if len(more.get("pla", b"")) >= 32 else palette(DEFAULT)) if lines == 256 else palette(data, 0xFA87)
    image, field = _with_field(source, more.get({8: "s18", 10: "s1a", 12: "s1c"}[mode]), lines, mode, colours)
    if not field and len(data) == 64167 and data[0] == 0xFE:
        sprites(image, data, mode, 0xFA07, 0xF007, palette(SPRITES) if mode == 8 else palette(data, 0xFA87))
    return image


def saurus(data: bytes, mode: int, more: dict[str, bytes]) -> np.ndarray | None:
    """Dumps whose palette is a companion file."""
    own = more.get(f"pl{mode}", b"")
    colours = palette(own) if len(own) >= 32 else palette(DEFAULT)
    if mode in (5, 6):
        lines = _lines_128(data, True)
        if mode == 6:
            colours = palette(own, 0, 4) if len(own) >= 8 else np.array(FOUR)
        image = bitmap(data, 7, lines, mode, colours) if lines else None
        return _double(image) if lines and mode == 6 else image
    lines, source = (256, data) if _is_256(data) else (212, _dump(data))
    return None if source is None else _double(bitmap(source, 7, lines, 7, colours))


def shape(data: bytes, mode: int, more: dict[str, bytes]) -> np.ndarray | None:
    """Width and height words and packed pixels, which run on from line to line."""
    if len(data) < 5:
        return None
    width, height = int.from_bytes(data[:2], "little"), int.from_bytes(data[2:4], "little")
    n, bits = width * height, {5: 4, 6: 2, 7: 4, 8: 8, 10: 8, 12: 8}[mode]
    need = -(-n * bits // 8)
    if not 0 < n * (2 if mode in (6, 7) else 1) <= MAX_PIXELS or len(data) < 4 + need or bits == 8 and len(data) != 4 + need:
        return None
    raw = np.frombuffer(data[4 : 4 + need], np.uint8).astype(np.int64)
    if mode >= 10:
        return yjk(raw.reshape(height, width), (palette(more["pla"]) if len(more.get("pla", b"")) >= 32 else palette(DEFAULT)) if mode == 10 else None)
    own = more.get(f"pl{mode}", b"")
    colours = grb332() if mode == 8 else palette(own, 0, 1 << bits) if len(own) >= 2 << bits else np.array(FOUR) if mode == 6 else palette(DEFAULT)
    image = colours[_parts(raw[None, :], bits)[0, :n].reshape(height, width)]
    return _double(image) if mode in (6, 7) else image


#: Decoders by extension.
BY_EXTENSION = {
    **{e: (screen, 2) for e in ("sc2", "grp")}, "sc3": (screen, 3), "sc4": (screen, 4), **{e: (screen, 5) for e in ("sc5", "ge5")}, "sc6": (screen, 6), **{e: (screen, 7) for e in ("sc7", "ge7")},
    **{e: (screen, 8) for e in ("sc8", "ge8", "sr8", "pic")}, **{e: (screen, 10) for e in ("sca", "scb", "sra")}, **{e: (screen, 12) for e in ("scc", "s12", "srs", "yjk")},
    "sr5": (saurus, 5), "sr6": (saurus, 6), "sr7": (saurus, 7), **{e: (shape, 5) for e in ("gl5", "sh5")}, **{e: (shape, 6) for e in ("gl6", "sh6")}, **{e: (shape, 7) for e in ("gl7", "sh7")},
    **{e: (shape, 8) for e in ("gl8", "sh8")}, **{e: (shape, 12) for e in ("shc", "glc", "gls")}, **{e: (shape, 10) for e in ("gla", "glb", "sha", "shb")},
}


#: Decoders by first bytes, which ``packed_pictures`` adds.
MAGICS: list[tuple[bytes, tuple]] = []


def sniff(data: bytes) -> tuple | None:
    """The format that the first bytes name, or the shape format whose length fits its header exactly."""
    for magic, found in MAGICS:
        if data.startswith(magic):
            return found
    if len(data) < 5:
        return None
    width, height = int.from_bytes(data[:2], "little"), int.from_bytes(data[2:4], "little")
    if width not in (256, 512) or not 0 < height <= 512:
        return None
    n, rest = width * height, len(data) - 4
    if rest == n and width == 256:
        return shape, 8
    if rest == n + 1 >> 1:
        return shape, 5 if width == 256 else 7
    return (shape, 6) if rest == n + 3 >> 2 and width == 512 else None


def decode(name: str, data: bytes, more: dict[str, bytes] | None = None) -> np.ndarray | None:
    """The pixels of a picture, or None. ``more``: companion files by extension."""
    from floppyscope.functions import packed_pictures  # noqa: F401 - adds its decoders

    ext = name.rpartition(".")[2].lower() if "." in name else ""
    for found in (BY_EXTENSION.get(ext), sniff(data)):
        if found:
            image = found[0](data, found[1], more or {})
            if image is not None and image.size <= MAX_PIXELS:
                return image
    return None


def rgba(image: np.ndarray) -> bytes:
    """Red, green, blue and 255 of each pixel."""
    out = np.empty((*image.shape, 4), np.uint8)
    for k, shift in enumerate((16, 8, 0)):
        out[..., k] = image >> shift & 255
    out[..., 3] = 255
    return out.tobytes()


def picture_table(files: DataFrame) -> DataFrame:
    """(name, width, height, rgba, error) of picture files (name, content, companions: a map of
    extensions to contents), a picture at a time."""
    schema = "name string, width int, height int, rgba binary, error string"
    fields = pa.schema([("name", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("rgba", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, content, more = (batch.column(c)[k].as_py() for c in range(3))
                image = decode(name, content or b"", dict(more or {}))
                row = {"name": name, "error": "no picture"} if image is None else {"name": name, "width": image.shape[1], "height": image.shape[0], "rgba": rgba(image)}
                yield pa.RecordBatch.from_pylist([row], fields)

    return files.select("name", "content", "companions").mapInArrow(run, schema)
