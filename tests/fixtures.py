"""Media made for the tests by the package's own writer."""

from __future__ import annotations

import struct
import zlib

from floppyscope.sources import containers, fatfs
from floppyscope.sources.tapes import SYNC, TSX_MAGIC


def two_files() -> bytes:
    data = fatfs.blank("ds720")
    data = fatfs.Volume(data).add("BIG.BIN", b"\xab" * 5000)
    data = fatfs.Volume(data).mkdir("SUB")
    return fatfs.Volume(data).add("SUB/HI.TXT", b"hello")


def populated() -> bytes:
    data = fatfs.Volume(fatfs.blank("ds720")).mkdir("UTILS")
    data = fatfs.Volume(data).add("HELLO.TXT", b"hi there")
    return fatfs.Volume(data).add("UTILS/GAME.COM", b"\xc9" * 16)


def fat16(entries: dict[int, int], slots: list[tuple[bytes, int, int, int]]) -> bytes:
    """A volume of 8000 sectors with the given table entries and root slots (name, attributes, cluster, size)."""
    layout = fatfs.Layout(1, 1, 2, 512, 8000, 0xF0, 64, 9, 2)
    data = bytearray(8000 * 512)
    data[:512] = fatfs.boot_sector(layout)
    for c, v in entries.items():
        data[512 + 2 * c : 514 + 2 * c] = struct.pack("<H", v)
    for k, (name, attributes, cluster, size) in enumerate(slots):
        at = layout.root_start * 512 + 32 * k
        data[at : at + 32] = name + bytes([attributes]) + bytes(14) + struct.pack("<HI", cluster, size)
    return bytes(data)


def partitioned() -> bytes:
    """Four slots in falling order of their first sectors, the second of which ends past the image."""
    sizes = [(1, 400), (401, 500), (901, 600)]
    data = bytearray(1500 * 512)
    for k, (lba, n) in enumerate(reversed(sizes)):
        at = 0x1BE + 16 * k
        data[at + 4] = 1
        data[at + 8 : at + 16] = struct.pack("<II", lba, n if lba != 901 else 9000)
        layout = fatfs.Layout(2, 1, 2, 112, n, 0xF0, 2, 9, 2)
        part = bytearray(fatfs.boot_sector(layout).ljust(n * 512, b"\0"))
        part[512:515] = b"\xf0\xff\xff"
        part = bytearray(fatfs.Volume(bytes(part), "partition").add(f"P{lba}.TXT", b"x" * lba))
        data[lba * 512 : lba * 512 + len(part[: len(data) - lba * 512])] = part[: len(data) - lba * 512]
    data[510:512] = b"\x55\xaa"
    return bytes(data)


def dmk(tracks: int = 80, sides: int = 2, bad: tuple[int, int] | None = None, head: int | None = None) -> bytes:
    """A raw-track image with nine sectors a track; the first byte of a sector is its place."""
    size = 128 + 9 * 600
    out = bytearray([0, tracks, size & 255, size >> 8, 0x10 if sides == 1 else 0]).ljust(16, b"\0")
    for t in range(tracks):
        for s in range(sides):
            track = bytearray(size)
            for k in range(9):
                at = 128 + 600 * k + 3
                track[2 * k : 2 * k + 2] = struct.pack("<H", 0x8000 | at)
                mark = bytes([0xFE, t, s if head is None else head, k + 1, 2])
                track[at - 3 : at] = b"\xa1\xa1\xa1"
                track[at : at + 5] = mark
                track[at + 5 : at + 7] = struct.pack(">H", containers.crc_ccitt(b"\xa1\xa1\xa1" + mark))
                lba = (t * sides + s) * 9 + k
                body = b"\xfb" + bytes([lba & 255]) * 512
                track[at + 27 : at + 30] = b"\xa1\xa1\xa1"
                track[at + 30 : at + 543] = body
                crc = containers.crc_ccitt(b"\xa1\xa1\xa1" + body) ^ ((t, k) == bad)
                track[at + 543 : at + 545] = struct.pack(">H", crc)
            out += track
    return bytes(out)


def sav(records: list[tuple[int, int]]) -> bytes:
    return b"".join(struct.pack("<I", k) + bytes([v]) * 512 for k, v in records)


def zip_of(members: list[tuple[str, bytes, int]], flags: int = 0) -> bytes:
    """(name, content, method 0 or 8)"""
    out, central = bytearray(), bytearray()
    for name, body, method in members:
        raw = name.encode()
        packed = body
        if method == 8:
            c = zlib.compressobj(9, zlib.DEFLATED, -15)
            packed = c.compress(body) + c.flush()
        at = len(out)
        out += struct.pack("<IHHHHHIIIHH", 0x04034B50, 20, flags, method, 0, 0, 0, len(packed), len(body), len(raw), 0) + raw + packed
        central += struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 20, 20, flags, method, 0, 0, 0, len(packed), len(body), len(raw), 0, 0, 0, 0, 0, at) + raw
    start = len(out)
    return bytes(out + central + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, len(members), len(members), len(central), start, 0))


def cas(*blocks: bytes) -> bytes:
    return b"".join(SYNC + b for b in blocks)


def cas_header(kind: int, name: bytes) -> bytes:
    return bytes([kind]) * 10 + name.ljust(6)


def tsx(*blocks: bytes) -> bytes:
    return TSX_MAGIC + b"\x01\x15" + b"".join(blocks)


def tsx_data(body: bytes) -> bytes:
    return b"\x4b" + struct.pack("<I", len(body) + 12) + bytes(12) + body


def program(*lines: tuple[int, bytes]) -> bytes:
    return b"\xff" + b"".join(b"\x01\x80" + struct.pack("<H", n) + tokens + b"\0" for n, tokens in lines) + b"\0\0"


def lha(name: bytes, body: bytes, method: bytes = b"-lh0-", size: int | None = None) -> bytes:
    head = method + struct.pack("<III", len(body), len(body) if size is None else size, (30 << 25 | 6 << 21 | 15 << 16) | 12 << 11 | 30 << 5) + b"\x20\x00" + bytes([len(name)]) + name + struct.pack("<H", 0)
    return bytes([len(head), sum(head) & 255]) + head + body
