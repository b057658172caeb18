"""Disk-image containers: which one a file is, and its linear sectors.

Every decoder takes whole bytes and gives (prefix, sectors) or raises ValueError; the image
table keeps the message in its ``error`` column, so a bad file never fails a job.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floppyscope.functions.binary import col
from floppyscope.functions.names import extension
from floppyscope.sources import xsa

SECTOR = 512
SIZE_360K, SIZE_720K = 368_640, 737_280
#: Formats by extension, and the headers that tell where the extension is unknown.
BY_EXTENSION = {"dsk": "Dsk", "di1": "Dsk", "ds1": "Dsk", "di2": "Dsk", "ds2": "Dsk", "img": "Img", "msx": "Msx", "ddi": "Ddi", "xsa": "Xsa", "dmk": "Dmk", "sav": "Sav", "zip": "Zip"}
MAGICS = (("Xsa", b"PCK\x08"), ("Ddi", b"IM"), ("Zip", b"PK\x03\x04"))


def format_of(path: Column | str, content: Column | str) -> Column:
    """The container of a file: by extension, else by its first bytes; null if neither tells."""
    ext = extension(path)
    out = None
    for e, name in BY_EXTENSION.items():
        out = F.when(ext == e, name) if out is None else out.when(ext == e, name)
    for name, magic in MAGICS:
        out = out.when(F.substring(col(content), 1, len(magic)) == F.lit(magic), name)
    return out


def raw(data: bytes) -> tuple[bytes, bytes]:
    if not data or len(data) % SECTOR:
        raise ValueError("not whole sectors")
    return b"", data


def img(data: bytes) -> tuple[bytes, bytes]:
    """Whole sectors, or whole sectors after one byte that is kept as the prefix."""
    if len(data) < SECTOR or len(data) % SECTOR > 1:
        raise ValueError("not whole sectors")
    k = len(data) % SECTOR
    return data[:k], data[k:]


def msx(data: bytes) -> tuple[bytes, bytes]:
    if len(data) != SIZE_720K:
        raise ValueError("not 720 K")
    return b"", data


def ddi(data: bytes) -> tuple[bytes, bytes]:
    for head in (0x1200, 0x1800):
        if len(data) - head in (SIZE_360K, SIZE_720K):
            return data[:head], data[head:]
    raise ValueError("no 360 K or 720 K after the header")


SAV_RECORD = 4 + SECTOR
SAV_SECTORS = SIZE_720K // SECTOR


def _blank_boot() -> bytes:
    from floppyscope.sources.fatfs import FORMATS, boot_sector

    return boot_sector(FORMATS["ds720"])


def sav(data: bytes) -> tuple[bytes, bytes]:
    """Replays a journal of (sector, bytes) records over an empty disk; the last record of a
    sector holds. Sector 0 is made up where no record has it."""
    if len(data) % SAV_RECORD:
        raise ValueError("not whole records")
    disk, boot = bytearray(SIZE_720K), False
    for at in range(0, len(data), SAV_RECORD):
        sector = int.from_bytes(data[at : at + 4], "little")
        if sector >= SAV_SECTORS:
            raise ValueError(f"sector {sector} out of range")
        boot |= sector == 0
        disk[sector * SECTOR : (sector + 1) * SECTOR] = data[at + 4 : at + SAV_RECORD]
    if not boot:
        disk[:SECTOR] = _blank_boot()
    return b"", bytes(disk)


def encode_sav(disk: bytes) -> bytes:
    """A journal of the sectors that aren't empty, in ascending order; a made-up sector 0 is left out."""
    if len(disk) != SIZE_720K:
        raise ValueError("not 720 K")
    out = []
    for k in range(SAV_SECTORS):
        s = disk[k * SECTOR : (k + 1) * SECTOR]
        if s.strip(b"\0") and not (k == 0 and s == _blank_boot()):
            out.append(k.to_bytes(4, "little") + s)
    return b"".join(out)


# ------------------------------------------------------------------ raw tracks


def crc_ccitt(data: bytes, crc: int = 0xFFFF) -> int:
    for b in data:
        crc ^= b << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x1021 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def dmk_tracks(data: bytes) -> tuple[int, int, int]:
    """Tracks, sides and bytes of a track from the 16-byte header."""
    if len(data) < 16:
        raise ValueError("no raw-track header")
    tracks, size = data[1], int.from_bytes(data[2:4], "little")
    sides = 1 if data[4] & 0x10 else 2
    if not tracks or size <= 128:
        raise ValueError("raw-track header out of range")
    return tracks, sides, size


def track_sectors(track: bytes) -> list[dict]:
    """The sectors that a track's pointer table names. A pointer's top bit says double density;
    CRCs start with the three A1 bytes before a mark where they are there."""
    out = []
    for k in range(64):
        pointer = int.from_bytes(track[2 * k : 2 * k + 2], "little")
        if not pointer:
            break
        at, double = pointer & 0x3FFF, bool(pointer & 0x8000)
        if at + 7 > len(track) or track[at] != 0xFE:
            continue
        cyl, head, sector, n = track[at + 1 : at + 5]

        def checked(start: int, end: int) -> bool:
            lead = track[start - 3 : start] if start >= 3 and track[start - 3 : start] == b"\xa1\xa1\xa1" else b""
            return end + 2 <= len(track) and crc_ccitt(lead + track[start:end]) == int.from_bytes(track[end : end + 2], "big")

        size = 128 << (n & 3)
        mark = next((p for p in range(at + 7, min(at + 7 + 64, len(track))) if 0xF8 <= track[p] <= 0xFB), -1)
        has = mark >= 0 and mark + 1 + size <= len(track)
        out.append({
            "cyl": cyl, "head": head, "sector": sector, "size": size, "density": "MFM" if double else "FM", "id_crc_ok": checked(at, at + 5),
            "data_crc_ok": has and checked(mark, mark + 1 + size), "has_data": has, "data": track[mark + 1 : mark + 1 + size] if has else b"",
        })
    return out


def dmk_sectors(data: bytes) -> Iterator[dict]:
    """Every sector of a raw-track image, with its track, side and order."""
    tracks, sides, size = dmk_tracks(data)
    for t in range(tracks):
        for s in range(sides):
            at = 16 + (t * sides + s) * size
            for k, sector in enumerate(track_sectors(data[at : at + size])):
                yield {"track": t, "side": s, "ord": k, **sector}


def dmk(data: bytes) -> tuple[bytes, bytes]:
    """Recorded 512-byte sectors at their linear places; of duplicates the last holds."""
    found = [s for s in dmk_sectors(data) if s["has_data"] and s["size"] == SECTOR and s["sector"]]
    if not found:
        raise ValueError("no sectors recorded")
    spt, sides = max(s["sector"] for s in found), 2 if any(s["head"] == 1 for s in found) else 1
    places = {(s["cyl"] * sides + s["head"]) * spt + s["sector"] - 1: s["data"] for s in found}
    end = (max(places) + 1) * SECTOR
    size = SIZE_720K if end >= SIZE_720K else SIZE_360K
    disk = bytearray(size)
    for k, s in places.items():
        if (k + 1) * SECTOR <= size:
            disk[k * SECTOR : (k + 1) * SECTOR] = s
    return b"", bytes(disk)


# ------------------------------------------------------------------ zip


def zip_members(data: bytes, depth: int = 0) -> list[tuple[str, bytes]]:
    """(name, sectors) of the disk images in an archive; members of other kinds are passed over.
    Stored and deflated members are read; encrypted ones and zip64 are refused."""
    end = data.rfind(b"PK\x05\x06")
    if end < 0 or end + 22 > len(data):
        raise ValueError("no end of a zip directory")
    count, size, start = struct.unpack_from("<H4xI", data, end + 8)[0], *struct.unpack_from("<II", data, end + 12)
    if count == 0xFFFF or start == 0xFFFFFFFF:
        raise ValueError("zip64 is not read")
    out, names, at = [], [], start
    for _ in range(count):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("zip directory is damaged")
        flags, method, packed, plain, n, extra, comment, local = struct.unpack_from("<HH8xIIHHH8xI", data, at + 8)
        name = data[at + 46 : at + 46 + n].decode("cp437")
        at += 46 + n + extra + comment
        names.append(name)
        ext = name.rpartition("/")[2].rpartition(".")[2].lower() if "." in name else ""
        if ext not in BY_EXTENSION:
            continue
        if flags & 1:
            raise ValueError(f"{name} is encrypted")
        if 0xFFFFFFFF in (packed, plain, local):
            raise ValueError("zip64 is not read")
        if data[local : local + 4] != b"PK\x03\x04":
            raise ValueError(f"{name} has no local header")
        skip = sum(struct.unpack_from("<HH", data, local + 26))
        body = data[local + 30 + skip : local + 30 + skip + packed]
        if method == 8:
            body = zlib.decompressobj(-15).decompress(body, plain + 1)
        elif method:
            raise ValueError(f"{name} is packed by an unknown method")
        if len(body) != plain:
            raise ValueError(f"{name} isn't as long as declared")
        if ext == "zip":
            if depth >= 4:
                raise ValueError("archives nested too deep")
            out += zip_members(body, depth + 1)
        else:
            out.append((name.rpartition("/")[2], DECODERS[BY_EXTENSION[ext]](body)[1]))
    if not out:
        raise ValueError("no disk image among " + ", ".join(names))
    return out


def zipped(data: bytes) -> tuple[bytes, bytes]:
    return b"", b"".join(s for _, s in zip_members(data))


DECODERS = {"Dsk": raw, "Img": img, "Msx": msx, "Ddi": ddi, "Xsa": lambda d: (b"", xsa.decompress(d)), "Dmk": dmk, "Sav": sav, "Zip": zipped}


def normalise(format: str | None, data: bytes) -> tuple[bytes, bytes]:
    if format not in DECODERS:
        raise ValueError("unknown format")
    prefix, sectors = DECODERS[format](data)
    if not sectors or len(sectors) % SECTOR:
        raise ValueError("not whole sectors")
    return prefix, sectors


def encode(format: str, sectors: bytes, prefix: bytes = b"") -> bytes:
    """Sectors in a container that can be written: the dump formats with their prefix, Xsa and Sav."""
    if format in ("Dsk", "Img", "Msx", "Ddi"):
        return prefix + sectors
    if format == "Xsa":
        return xsa.compress(sectors)
    if format == "Sav":
        return encode_sav(sectors)
    raise ValueError(f"{format} can't be written")


IMAGES = "image_id long, path string, format string, prefix binary, data binary, sector_count int, members array<struct<name:string,length:int>>, error struct<kind:string,msg:string>"
_MEMBERS = pa.list_(pa.struct([("name", pa.string()), ("length", pa.int32())]))
_ERROR = pa.struct([("kind", pa.string()), ("msg", pa.string())])


def decode_images(files: DataFrame) -> DataFrame:
    """The image table of ``files`` (path, content): one row per file, an error in place of data
    where it can't be read. ``image_id`` is a hash of the path; ``members`` has the disks of an archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a row at a time: an image may be 32 MB
                image_id, path, format, content = (batch.column(c)[k].as_py() for c in range(4))
                prefix = data = members = error = None
                try:
                    if format == "Zip":
                        found = zip_members(content or b"")
                        members = [{"name": n, "length": len(d)} for n, d in found]
                        prefix, data = b"", b"".join(d for _, d in found)
                    else:
                        prefix, data = normalise(format, content or b"")
                except (ValueError, IndexError, struct.error, zlib.error) as e:
                    error = {"kind": "UnknownFormat" if format is None else "Malformed", "msg": str(e)}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([image_id]), pa.array([path]), pa.array([format], pa.string()), pa.array([prefix], pa.binary()), pa.array([data], pa.binary()), pa.array([len(data) // SECTOR if data else None], pa.int32()), pa.array([members], _MEMBERS), pa.array([error], _ERROR)],
                    ["image_id", "path", "format", "prefix", "data", "sector_count", "members", "error"],
                )

    return files.select(F.xxhash64("path").alias("image_id"), "path", format_of("path", "content").alias("format"), "content").mapInArrow(run, IMAGES)


def images(spark: SparkSession, path: str, glob: str = "*.{dsk,di1,ds1,di2,ds2,img,msx,ddi,xsa,dmk,sav,zip,DSK,DI1,DS1,DI2,DS2,IMG,MSX,DDI,XSA,DMK,SAV,ZIP}") -> DataFrame:
    """The image table of all files under ``path`` whose name fits the glob, which is applied
    before any content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return decode_images(files)


def dmk_table(files: DataFrame) -> DataFrame:
    """One row per recorded sector of raw-track files (path, content)."""
    schema = "image_id long, track int, side int, ord int, cyl int, head int, sector int, size int, density string, id_crc_ok boolean, data_crc_ok boolean, has_data boolean, data binary"
    fields = pa.schema([("image_id", pa.int64()), *((c, pa.int32()) for c in ("track", "side", "ord", "cyl", "head", "sector", "size")), ("density", pa.string()), *((c, pa.bool_()) for c in ("id_crc_ok", "data_crc_ok", "has_data")), ("data", pa.binary())])

    def run(batches):
        for batch in batches:
            for image_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows = [{"image_id": image_id, **s} for s in dmk_sectors(content or b"")]
                except ValueError:
                    rows = []
                yield pa.RecordBatch.from_pylist(rows, fields)

    return files.select(F.xxhash64("path").alias("image_id"), "content").mapInArrow(run, schema)
