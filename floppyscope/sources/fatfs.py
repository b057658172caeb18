"""FAT volumes in memory: mounting, reading, checking and editing.

A volume is one value of bytes, at most some 32 MB, so whoever holds it can walk it without
any shuffle; the tables of ``plans.media`` come from here, one volume a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

SECTOR = 512
SIZE_360K, SIZE_720K = 368_640, 737_280
MAX_DEPTH = 64
#: Bytes that a short name can't hold.
FORBIDDEN = frozenset(b'"*+,/:;<=>?[\\]|')


def u16(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 2], "little")


def u32(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 4], "little")


@dataclass(frozen=True)
class Layout:
    """The fields of a boot sector."""

    spc: int
    reserved: int
    fats: int
    roots: int
    total: int
    media: int
    spf: int
    spt: int
    heads: int

    @property
    def fat_start(self) -> int:
        return self.reserved

    @property
    def root_start(self) -> int:
        return self.reserved + self.fats * self.spf

    @property
    def data_start(self) -> int:
        return self.root_start + -(-self.roots * 32 // SECTOR)


#: The standard layouts that can be created.
FORMATS = {
    "ss360": Layout(2, 1, 2, 112, 720, 0xF8, 2, 9, 1),
    "ds720": Layout(2, 1, 2, 112, 1440, 0xF9, 3, 9, 2),
    "ss180": Layout(1, 1, 2, 64, 360, 0xFC, 2, 9, 1),
    "ds360": Layout(2, 1, 2, 112, 720, 0xFD, 2, 9, 2),
}


def parse_layout(data: bytes) -> Layout | None:
    """The boot sector's fields if they can be a layout at all."""
    if len(data) < SECTOR or u16(data, 11) != SECTOR:
        return None
    found = Layout(data[13], u16(data, 14), data[16], u16(data, 17), u16(data, 19), data[21], u16(data, 22), u16(data, 24), u16(data, 26))
    return found if found.spc and found.fats and found.spf else None


def is_sound(found: Layout | None) -> bool:
    """The stricter test that a floppy has to pass to be mounted as it is."""
    return bool(
        found and found.spc & (found.spc - 1) == 0 and found.fats in (1, 2) and found.reserved and found.roots and found.roots * 32 % SECTOR == 0 and 1 <= found.spf <= 15 and found.total > found.data_start
    )


def boot_sector(layout: Layout, old: bytes = bytes(SECTOR)) -> bytes:
    """``old`` with the fields of a layout, the fields of later systems cleared, and the signature."""
    out = bytearray(old[:SECTOR])
    if out[0] not in (0xEB, 0xE9):
        out[:3] = b"\xeb\x3c\x90"
    out[11:13] = SECTOR.to_bytes(2, "little")
    out[13] = layout.spc
    out[14:16] = layout.reserved.to_bytes(2, "little")
    out[16] = layout.fats
    out[17:19] = layout.roots.to_bytes(2, "little")
    out[19:21] = layout.total.to_bytes(2, "little")
    out[21] = layout.media
    out[22:24] = layout.spf.to_bytes(2, "little")
    out[24:26] = layout.spt.to_bytes(2, "little")
    out[26:28] = layout.heads.to_bytes(2, "little")
    out[28:39] = bytes(11)
    out[510:512] = b"\x55\xaa"
    return bytes(out)


def floppy_layout(data: bytes) -> Layout:
    """The layout that a floppy is mounted with: its own if sound, else the standard one of its size."""
    found = parse_layout(data)
    if is_sound(found):
        return found
    standard = {SIZE_720K: "ds720", SIZE_360K: "ss360"}.get(len(data))
    if not standard:
        raise ValueError("no sound boot sector and no standard size")
    return FORMATS[standard]


def short_name(raw: bytes) -> str:
    """Name and extension up to their first blank; high bytes as U+F080 on."""
    text = ["".join(chr(b) if b < 0x80 else chr(0xF000 + b) for b in part.split(b" ")[0]) for part in (raw[:8], raw[8:11])]
    return ".".join(t for t in text if t) if text[1] else text[0]


def raw_name(name: str) -> bytes:
    """The eleven bytes of a short name; ValueError if it isn't one."""
    if name.startswith(".") or name.count(".") > 1:
        raise ValueError(f"{name} is no 8.3 name")
    base, _, ext = name.partition(".")
    parts = []
    for part, width in ((base, 8), (ext, 3)):
        codes = [ord(c) - 0xF000 if 0xF080 <= ord(c) <= 0xF0FF else ord(c) for c in part]
        if len(codes) > width or any(c > 255 or c < 0x20 or c in FORBIDDEN or c in (0x20, 0x7F) for c in codes):
            raise ValueError(f"{name} is no 8.3 name")
        parts.append(bytes(codes).upper().ljust(width))
    if not base:
        raise ValueError("a name needs a stem")
    return (b"\x05" + parts[0][1:] if parts[0][0] == 0xE5 else parts[0]) + parts[1]


@dataclass(frozen=True)
class Entry:
    path: str
    name: str
    is_dir: bool
    size: int
    first: int
    attributes: int
    date: int
    time: int
    depth: int
    order: tuple[int, ...]
    slot: int  # byte offset of the 32 bytes


class Volume:
    """A mounted volume. ``kind``: "floppy" or "partition", which differ in what they reject."""

    def __init__(self, data: bytes, kind: str = "floppy"):
        self.data, self.kind = bytes(data), kind
        own = parse_layout(data)
        self.layout = own if kind != "floppy" and own else floppy_layout(data)
        self.sectors = len(data) // SECTOR
        self.clusters = max(0, (self.sectors - self.layout.data_start) // self.layout.spc)
        # The table is twelve bits wide if there are few clusters, or if sixteen wouldn't fit.
        self.width = 12 if self.clusters < 4085 or (self.clusters + 2) * 2 > self.layout.spf * SECTOR else 16
        self.cluster_bytes = self.layout.spc * SECTOR

    # ---- the allocation table

    def entry(self, cluster: int, data: bytes | None = None) -> int:
        data = self.data if data is None else data
        base = self.layout.fat_start * SECTOR
        if self.width == 16:
            at = base + 2 * cluster
            return u16(data, at) if at + 2 <= len(data) else 0xFFFF
        at = base + cluster * 3 // 2
        if at + 2 > len(data):
            return 0xFFF
        pair = u16(data, at)
        return pair >> 4 if cluster & 1 else pair & 0xFFF

    def kind_of(self, value: int) -> str:
        top = 0xFFF0 if self.width == 16 else 0xFF0
        if value == 0:
            return "Free"
        if 2 <= value < top:
            return "Next" if value < self.clusters + 2 else "OutOfRange"
        if top <= value <= top + 6:
            return "Reserved"
        return "Bad" if value == top + 7 else "End"

    def chain(self, first: int) -> list[int]:
        """Clusters of a file as it is read: on while the value is a data pointer, within the guard."""
        out, cluster = [], first
        top = 0xFFF0 if self.width == 16 else 0xFF0
        while 2 <= cluster < top and len(out) < self.sectors // self.layout.spc + 2:
            out.append(cluster)
            cluster = self.entry(cluster)
        return out

    def cluster_data(self, cluster: int) -> bytes:
        at = (self.layout.data_start + (cluster - 2) * self.layout.spc) * SECTOR
        end = min(at + self.cluster_bytes, self.sectors * SECTOR)
        return self.data[at:end] if at < end else b""

    # ---- directories

    def _slots(self, first: int | None) -> Iterator[tuple[int, bytes]]:
        """(offset, 32 bytes) of a directory up to its end mark; the root for None."""
        if first is None:
            spans = [(self.layout.root_start * SECTOR, self.layout.data_start * SECTOR)]
        else:
            start = self.layout.data_start
            spans = [((start + (c - 2) * self.layout.spc) * SECTOR, (start + (c - 1) * self.layout.spc) * SECTOR) for c in dict.fromkeys(self.chain(first))]
        for a, b in spans:
            for at in range(a, min(b, len(self.data) - 31), 32):
                raw = self.data[at : at + 32]
                if raw[0] == 0:
                    return
                yield at, raw

    def reject_reason(self, raw: bytes) -> str | None:
        """Why a root slot of a floppy is no entry."""
        first, size = u16(raw, 26), u32(raw, 28)
        if raw[11] & 0xC0:
            return "attribute"
        if first == 1 or first > self.clusters + 1:
            return "cluster"
        return "size" if size > self.clusters * self.cluster_bytes else None

    def _is_junk(self, raw: bytes) -> bool:
        bad = any((b < 0x20 and not (k == 0 and b == 5)) or b in FORBIDDEN for k, b in enumerate(raw[:11])) or raw[11] & 0xC0
        first = u16(raw, 26)
        return bool(bad) and (first == 1 or first >= 2 + self.clusters)

    def _entries(self, first: int | None) -> Iterator[tuple[int, bytes]]:
        root = [raw for _, raw in self._slots(None) if raw[0] != 0xE5 and raw[11] != 0x0F and not raw[11] & 8] if first is None and self.kind == "floppy" else []
        if root and all(self.reject_reason(raw) for raw in root):
            return  # data that happens to stand where the root would be
        for at, raw in self._slots(first):
            if raw[0] == 0xE5 or raw[11] & 0x0F == 0x0F or raw[11] & 8 or raw[0] == 0x2E:
                continue
            if self.kind == "floppy":
                if first is None and self.reject_reason(raw):
                    continue
            elif self._is_junk(raw):
                continue
            yield at, raw

    def walk(self) -> Iterator[Entry]:
        """All entries in pre-order; a directory that holds itself isn't entered again."""

        def level(first: int | None, prefix: str, depth: int, order: tuple[int, ...], active: tuple[int, ...]) -> Iterator[Entry]:
            for k, (at, raw) in enumerate(self._entries(first)):
                name = short_name(raw)
                e = Entry(prefix + name, name, bool(raw[11] & 0x10), u32(raw, 28), u16(raw, 26), raw[11], u16(raw, 24), u16(raw, 22), depth, (*order, k), at)
                yield e
                if e.is_dir and e.first >= 2 and e.first not in active and depth + 1 < MAX_DEPTH:
                    yield from level(e.first, e.path + "/", depth + 1, e.order, (*active, e.first))

        yield from level(None, "", 0, (), ())

    def find(self, path: str) -> Entry | None:
        wanted = path.strip("/").translate(_UPPER)
        return next((e for e in self.walk() if e.path.translate(_UPPER) == wanted), None)

    def read(self, entry: Entry) -> bytes:
        return b"".join(map(self.cluster_data, self.chain(entry.first)))[: entry.size]

    def label(self) -> str | None:
        for _, raw in self._slots(None):
            if raw[0] != 0xE5 and raw[11] & 8 and raw[11] & 0x0F != 0x0F and raw[:11].strip():
                return raw[:11].rstrip().decode("latin-1")
        return None

    def dos_version(self) -> int:
        root = [e for e in self.walk() if not e.depth]
        return 2 if self.data[0x20:0x26] == b"VOL_ID" or any(e.is_dir or e.name.translate(_UPPER) == "MSXDOS2.SYS" for e in root) else 1

    # ---- checks

    def integrity(self) -> dict:
        """Clusters that are lost, cross-linked, and pointers out of range, by walking every
        chain of files and directories; a chain ends at its first repeat."""
        refs: dict[int, int] = {}
        bad: list[tuple[int, int]] = []
        files = broken = 0
        for e in self.walk():
            chain, cluster, seen = [], e.first, set()
            while 2 <= cluster < self.clusters + 2 and cluster not in seen:
                value = self.entry(cluster)
                kind = self.kind_of(value)
                if kind in ("Free", "Bad", "Reserved"):
                    break
                seen.add(cluster)
                chain.append(cluster)
                refs[cluster] = refs.get(cluster, 0) + 1
                if kind == "OutOfRange":
                    bad.append((cluster, value))
                if kind != "Next":
                    break
                cluster = value
            if not e.is_dir:
                files += 1
                broken += any(b - a != 1 for a, b in zip(chain, chain[1:]))
        kinds = {c: self.kind_of(self.entry(c)) for c in range(2, self.clusters + 2)}
        lost = [c for c, k in kinds.items() if c not in refs and k not in ("Free", "Bad", "Reserved")]
        crossed = sorted(c for c, n in refs.items() if n > 1)
        return {"lost": lost, "cross_linked": crossed, "bad_pointers": bad, "fragmented_percent": 100.0 * broken / files if files else 0.0}

    def free_clusters(self) -> int:
        return sum(self.entry(c) == 0 for c in range(2, self.clusters + 2))

    # ---- editing; every call gives new bytes or raises, and leaves this volume as it is

    def _edit(self) -> _Edit:
        return _Edit(self)

    def add(self, path: str, content: bytes, date: int = 0x21, time: int = 0) -> bytes:
        """The image with a file created or overwritten."""
        edit = self._edit()
        edit.put(path, content, 0x20, date, time)
        return edit.done()

    def mkdir(self, path: str, date: int = 0x21, time: int = 0) -> bytes:
        edit = self._edit()
        edit.mkdir(path, date, time)
        return edit.done()

    def delete(self, path: str) -> bytes:
        edit = self._edit()
        edit.delete(path)
        return edit.done()

    def rename(self, old: str, new: str) -> bytes:
        edit = self._edit()
        edit.rename(old, new)
        return edit.done()


_UPPER = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


class _Edit:
    """One transaction: a working copy with a sound boot sector, whose first sector is put back at the end."""

    def __init__(self, volume: Volume):
        self.boot = volume.data[:SECTOR]
        self.data = bytearray(volume.data)
        if not is_sound(parse_layout(volume.data)) and volume.kind == "floppy":
            self.data[:SECTOR] = boot_sector(volume.layout, self.boot)
        self.kind = volume.kind

    @property
    def volume(self) -> Volume:
        return Volume(bytes(self.data), self.kind)

    def done(self) -> bytes:
        return self.boot + bytes(self.data[SECTOR:])

    def _set(self, v: Volume, cluster: int, value: int) -> None:
        for k in range(v.layout.fats):
            base = (v.layout.fat_start + k * v.layout.spf) * SECTOR
            if v.width == 16:
                self.data[base + 2 * cluster : base + 2 * cluster + 2] = value.to_bytes(2, "little")
                continue
            at = base + cluster * 3 // 2
            pair = u16(self.data, at)
            pair = pair & 0x000F | value << 4 if cluster & 1 else pair & 0xF000 | value
            self.data[at : at + 2] = pair.to_bytes(2, "little")

    def _free(self, v: Volume, first: int) -> None:
        for c in dict.fromkeys(v.chain(first)):
            if c < v.clusters + 2:
                self._set(v, c, 0)

    def _store(self, v: Volume, content: bytes) -> int:
        """The first cluster of newly stored content, 0 for none."""
        need = -(-len(content) // v.cluster_bytes)
        room = [c for c in range(2, v.clusters + 2) if v.entry(c, self.data) == 0][:need]
        if len(room) < need:
            raise ValueError("the disk is full")
        for k, c in enumerate(room):
            self._set(v, c, room[k + 1] if k + 1 < need else (0xFFFF if v.width == 16 else 0xFFF))
            at = (v.layout.data_start + (c - 2) * v.layout.spc) * SECTOR
            self.data[at : at + v.cluster_bytes] = content[k * v.cluster_bytes : (k + 1) * v.cluster_bytes].ljust(v.cluster_bytes, b"\0")
        return room[0] if room else 0

    def _parent(self, v: Volume, path: str) -> tuple[int | None, str]:
        above, _, name = path.strip("/").rpartition("/")
        if not above:
            return None, name
        found = v.find(above)
        if not found or not found.is_dir:
            raise ValueError(f"{above} is no directory")
        return found.first, name

    def _slot(self, v: Volume, first: int | None) -> int:
        """The offset of a free slot; a full directory, but not the root, gets one more cluster."""
        if first is None:
            spans = [(v.layout.root_start * SECTOR, v.layout.data_start * SECTOR)]
        else:
            spans = [((v.layout.data_start + (c - 2) * v.layout.spc) * SECTOR, (v.layout.data_start + (c - 1) * v.layout.spc) * SECTOR) for c in v.chain(first)]
        for a, b in spans:
            for at in range(a, b, 32):
                if self.data[at] in (0, 0xE5):
                    return at
        if first is None:
            raise ValueError("the root directory is full")
        new = self._store(v, bytes(v.cluster_bytes))
        self._set(v, v.chain(first)[-1], new)
        return (v.layout.data_start + (new - 2) * v.layout.spc) * SECTOR

    def _write_slot(self, at: int, name: str, attributes: int, first: int, size: int, date: int, time: int) -> None:
        self.data[at : at + 32] = raw_name(name) + bytes([attributes]) + bytes(10) + time.to_bytes(2, "little") + date.to_bytes(2, "little") + first.to_bytes(2, "little") + size.to_bytes(4, "little")

    def put(self, path: str, content: bytes, attributes: int, date: int, time: int) -> None:
        v = self.volume
        found = v.find(path)
        if found and found.is_dir:
            raise ValueError(f"{path} is a directory")
        if found:
            self._free(v, found.first)
            first = self._store(self.volume, content)
            self._write_slot(found.slot, found.name, attributes, first, len(content), date, time)
            return
        above, name = self._parent(v, path)
        raw_name(name)
        first = self._store(v, content)
        self._write_slot(self._slot(self.volume, above), name, attributes, first, len(content), date, time)

    def mkdir(self, path: str, date: int, time: int) -> None:
        v = self.volume
        if v.find(path):
            raise ValueError(f"{path} exists")
        above, name = self._parent(v, path)
        raw_name(name)
        first = self._store(v, bytes(v.cluster_bytes))
        at = (v.layout.data_start + (first - 2) * v.layout.spc) * SECTOR
        for k, (dots, cluster) in enumerate(((b".", first), (b"..", above or 0))):
            self.data[at + 32 * k : at + 32 * k + 32] = dots.ljust(11) + b"\x10" + bytes(10) + time.to_bytes(2, "little") + date.to_bytes(2, "little") + cluster.to_bytes(2, "little") + bytes(4)
        self._write_slot(self._slot(self.volume, above), name, 0x10, first, 0, date, time)

    def delete(self, path: str) -> None:
        v = self.volume
        found = v.find(path)
        if not found:
            raise ValueError(f"{path} doesn't exist")
        if found.is_dir and any(e.path.startswith(found.path + "/") for e in v.walk()):
            raise ValueError(f"{path} isn't empty")
        self._free(v, found.first)
        self.data[found.slot] = 0xE5

    def rename(self, old: str, new: str) -> None:
        v = self.volume
        found = v.find(old)
        if not found:
            raise ValueError(f"{old} doesn't exist")
        if v.find(new):
            raise ValueError(f"{new} exists")
        if new.translate(_UPPER).startswith(found.path.translate(_UPPER) + "/"):
            raise ValueError("a directory can't go into itself")
        above, name = self._parent(v, new)
        slot = bytes(self.data[found.slot : found.slot + 32])
        at = self._slot(v, above)
        self.data[found.slot] = 0xE5
        self.data[at : at + 32] = raw_name(name) + slot[11:]
        if found.is_dir and found.first >= 2:  # its .. entry points to the new place
            dots = (v.layout.data_start + (found.first - 2) * v.layout.spc) * SECTOR + 32
            if self.data[dots : dots + 2] == b"..":
                self.data[dots + 26 : dots + 28] = (above or 0).to_bytes(2, "little")


def blank(format: str = "ds720") -> bytes:
    """An empty disk of a standard format."""
    layout = FORMATS[format]
    data = bytearray(layout.total * SECTOR)
    data[:SECTOR] = boot_sector(layout)
    for k in range(layout.fats):
        at = (layout.fat_start + k * layout.spf) * SECTOR
        data[at : at + 3] = bytes([layout.media, 0xFF, 0xFF])
    return bytes(data)


def with_layout(data: bytes, **fields: int) -> bytes:
    """An image whose boot sector declares other fields."""
    return boot_sector(replace(floppy_layout(data), **fields), data[:SECTOR]) + data[SECTOR:]


def install_boot_block(data: bytes, block: bytes, serial: int | None = None) -> bytes:
    """An image with a boot block that the caller has, its own layout fields and signature kept;
    ``serial`` goes where later systems look for it."""
    if len(block) != SECTOR:
        raise ValueError("a boot block is one sector")
    out = bytearray(block)
    out[11:30], out[510:512] = data[11:30], data[510:512]
    if serial is not None:
        out[0x27:0x2B] = serial.to_bytes(4, "little")
    return bytes(out) + data[SECTOR:]


def write_sector(data: bytes, lba: int, sector: bytes) -> bytes:
    """An image with one sector replaced."""
    if len(sector) != SECTOR or not 0 <= lba < len(data) // SECTOR:
        raise ValueError("no such sector")
    return data[: lba * SECTOR] + sector + data[(lba + 1) * SECTOR :]


# ------------------------------------------------------------------ several volumes in one image


def split_disks(data: bytes) -> list[tuple[int, int]]:
    """(first sector, sectors) of concatenated disks: at least two whole slices of 720 K, else
    of 360 K, each of which declares its own size; a 720 K slice may declare 720 sectors."""
    for size in (SIZE_720K, SIZE_360K):
        n, rest = divmod(len(data), size)
        if n < 2 or rest:
            continue
        declared = [parse_layout(data[k * size : k * size + SECTOR]) for k in range(n)]
        fits = {size // SECTOR, 720} if size == SIZE_720K else {720}
        if all(d and d.total in fits for d in declared):
            return [(k * size // SECTOR, size // SECTOR) for k in range(n)]
    return []


def partitions(data: bytes) -> list[tuple[int, int]]:
    """(first sector, sectors) of live partitions in order; none unless sector 0 is a partition
    table and no boot sector itself."""
    if len(data) < SECTOR or data[510:512] != b"\x55\xaa" or parse_layout(data):
        return []
    total, out = len(data) // SECTOR, []
    for k in range(4):
        at = 0x1BE + 16 * k
        kind, lba, count = data[at + 4], u32(data, at + 8), u32(data, at + 12)
        if kind and lba and count and lba < total and parse_layout(data[lba * SECTOR : (lba + 1) * SECTOR]):
            out.append((lba, min(count, total - lba)))
    return sorted(out)


def volumes(data: bytes, members: list[tuple[str, int]] | None = None) -> list[tuple[str, str, int, int, Volume]]:
    """(name, kind, first sector, sectors, volume) of an image. ``members``: names and lengths
    of archive members. Volumes that can't be mounted are passed over before numbering."""
    if members:
        spans, at = [], 0
        for name, length in members:
            spans.append((name, "zip", at, length // SECTOR))
            at += length // SECTOR
    elif found := partitions(data):
        spans = [("P", "partition", a, n) for a, n in found]
    elif found := split_disks(data):
        spans = [("D", "disk", a, n) for a, n in found]
    else:
        spans = [("", "single", 0, len(data) // SECTOR)]
    out = []
    for name, kind, a, n in spans:
        try:
            volume = Volume(data[a * SECTOR : (a + n) * SECTOR], "partition" if kind == "partition" else "floppy")
        except ValueError:
            continue
        out.append((f"{name}{len(out) + 1}" if kind in ("partition", "disk") else name, kind, a, n, volume))
    return out


# ------------------------------------------------------------------ size mismatches


def size_mismatch(data: bytes) -> tuple[str, int] | None:
    """(fix, size) where the layout of a standard floppy and its length disagree: "boot" (the
    fields are wrong), "pad", "truncate" (what follows is empty), or "none"."""
    found = parse_layout(data)
    if len(data) not in (SIZE_360K, SIZE_720K) or not found or found.spf not in (2, 3):
        return None
    size = SIZE_360K if found.spf == 2 else SIZE_720K
    fields = found.total == len(data) // SECTOR
    if size == len(data):
        return None if fields else ("boot", size)
    if size > len(data):
        return "pad", size
    if not data[size:].strip(b"\0"):
        return "truncate", size
    return ("none", size) if found.total == size // SECTOR else ("boot", len(data))


def repair_size(data: bytes) -> bytes:
    """The image after the fix that ``size_mismatch`` names."""
    found = size_mismatch(data)
    if not found or found[0] == "none":
        return data
    fix, size = found
    data = data[:size] if fix == "truncate" else data.ljust(size, b"\0")
    standard = FORMATS["ds720" if size == SIZE_720K else "ss360"]
    own = parse_layout(data)
    out = bytearray(boot_sector(replace(own, total=standard.total, media=standard.media, spt=standard.spt, heads=standard.heads), data[:SECTOR]) + data[SECTOR:])
    for k in range(own.fats):
        out[(own.reserved + k * own.spf) * SECTOR] = standard.media
    return bytes(out)
