"""Queries over images that they make themselves, since the driver's tables hold none. Their
SQL states the rows that the images were made to give."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floppyscope.contract import query, rows_of
from floppyscope.functions import basic, disasm, music, pictures
from floppyscope.operators import hexrows
from floppyscope.plans import media
from floppyscope.sources import containers, fatfs, lha, tapes, xsa


def _disk() -> bytes:
    """720 K with four files, one of them in a directory, and a label."""
    data = fatfs.Volume(fatfs.blank("ds720")).add("BIG.BIN", b"\xab" * 5000, 30 << 9 | 6 << 5 | 15, 12 << 11 | 30 << 5)
    data = fatfs.Volume(data).mkdir("SUB")
    data = fatfs.Volume(data).add("SUB/HI.TXT", b"hello")
    data = fatfs.Volume(data).add("A.TXT", b"line one\r\nline two\r\n")
    data = fatfs.Volume(data).add("NOEXT", b"\xc9" * 7)
    out = bytearray(data)
    at = fatfs.FORMATS["ds720"].root_start * 512
    free = next(k for k in range(at, at + 112 * 32, 32) if out[k] == 0)
    out[free : free + 12] = b"MYDISK     \x08"
    return bytes(out)


def _images(spark: SparkSession, files: dict[str, bytes]) -> DataFrame:
    rows = rows_of(spark, "path string, content binary", [(p, bytearray(c)) for p, c in files.items()])
    return containers.decode_images(rows.repartition(4, "path"))


def _volumes(spark: SparkSession, files: dict[str, bytes]) -> DataFrame:
    images = _images(spark, files)
    return media.volumes(images).join(images.select("image_id", "path"), "image_id")


def _values(columns: str, rows: list[tuple]) -> str:
    def text(v) -> str:
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({columns})"


FORMAT_ROWS = [("a.dsk", "Dsk", 1440, None), ("b.img", "Img", 1440, None), ("c.xsa", "Xsa", 1440, None), ("d.sav", "Sav", 1440, None), ("e.ddi", "Ddi", 1440, None), ("f.dat", "Xsa", 1440, None), ("g.xyz", None, None, "UnknownFormat"), ("h.dsk", "Dsk", None, "Malformed")]


@query("media_formats", _values("path, format, sectors, error", FORMAT_ROWS))
def media_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _disk()
    packed = xsa.compress(d)
    files = {"a.dsk": d, "b.img": b"\2" + d, "c.xsa": packed, "d.sav": containers.encode_sav(d), "e.ddi": bytes(0x1200) + d, "f.dat": packed, "g.xyz": b"?", "h.dsk": d[:700]}
    return _images(spark, files).select("path", "format", F.col("sector_count").alias("sectors"), F.col("error.kind").alias("error"))


TREE = [("BIG.BIN", 0, False, 5000, "----a", "2010-06-15 12:30"), ("SUB", 0, True, 0, "d----", None), ("SUB/HI.TXT", 1, False, 5, "----a", None), ("A.TXT", 0, False, 20, "----a", None), ("NOEXT", 0, False, 7, "----a", None)]


@query("media_ls", _values("path, depth, is_dir, size, flags, modified", TREE))
def media_ls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.entries(_volumes(spark, {"a.dsk": _disk()}))
    return rows.select("path", "depth", "is_dir", "size", "flags", F.date_format("modified", "yyyy-MM-dd HH:mm").alias("modified"))


@query("media_stats", _values("path, label, dos_version, total_bytes, used_bytes, free_bytes, file_count, dir_count, file_bytes, permille, clean", [("a.dsk", "MYDISK", 2, 737280, 9216, 720896, 4, 1, 5032, 0, True), ("b.dsk", None, 1, 368640, 0, 362496, 0, 0, 0, 0, True)]))
def media_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _volumes(spark, {"a.dsk": _disk(), "b.dsk": fatfs.blank("ss360")})
    out = media.statistics(v, media.entries(v)).join(v.select("volume_id", "path"), "volume_id")
    return out.select("path", "label", "dos_version", "total_bytes", "used_bytes", "free_bytes", "file_count", "dir_count", "file_bytes", F.round(F.col("fragmented_percent") * 10).cast("long").alias("permille"), "clean")


@query("media_extensions", _values("ext, description, files, bytes", [("bin", "Binary program", 1, 5000), ("txt", "Text", 2, 25), ("", None, 1, 7)]))
def media_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.extensions(media.entries(_volumes(spark, {"a.dsk": _disk()}))).drop("volume_id")


@query("media_largest", _values("path, size, rank", [("BIG.BIN", 5000, 1), ("A.TXT", 20, 2)]))
def media_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.largest_files(media.entries(_volumes(spark, {"a.dsk": _disk()})), 2).drop("volume_id")


@query("media_fat", _values("kind, entries, first", [("Next", 4, 2), ("End", 5, 6), ("Free", 704, 11)]))
def media_fat(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = media.table_entries(_volumes(spark, {"a.dsk": _disk()}))
    return table.groupBy("kind").agg(F.count("*").alias("entries"), F.min("cluster").alias("first"))


@query("media_sector_map", _values("kind, sectors", [("Reserved", 1), ("Fat", 6), ("RootDir", 7), ("Used", 18), ("Free", 1408)]))
def media_sector_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.sector_map(_volumes(spark, {"a.dsk": _disk()})).groupBy("kind").agg(F.count("*").alias("sectors"))


def _damaged() -> bytes:
    """A lost cluster, two files that share one, and a pointer out of range."""
    d = bytearray(_disk())
    v = fatfs.Volume(bytes(d))
    edit = v._edit()
    edit._set(v, 20, 0xFFF)
    edit._set(v, v.find("A.TXT").first, 0xF00)
    d = bytearray(edit.done())
    slot = v.find("NOEXT").slot
    d[slot + 26 : slot + 28] = (3).to_bytes(2, "little")
    return bytes(d)


@query("media_integrity", _values("lost, cross_linked, bad_pointers, clean", [("10,20", "3,4,5,6", "9:3840", False)]))
def media_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.integrity(_volumes(spark, {"a.dsk": _damaged()}))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    pointers = F.array_join(F.transform("bad_pointers", lambda p: F.concat_ws(":", p["cluster"], p["entry"])), ",")
    return found.select(joined("lost"), joined("cross_linked"), pointers.alias("bad_pointers"), "clean")


@query("media_checksums", _values("path, crc32, sha1", [("SUB/HI.TXT", "3610A686", "aaf4c61ddcc5e8a2dabede0f3b482cd9aea9434d")]))
def media_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = media.entries(_volumes(spark, {"a.dsk": _disk()}), content=True)
    return media.checksums(files.where("name = 'HI.TXT'")).drop("volume_id")


@query("media_glob", _values("path", [("SUB",), ("SUB/HI.TXT",), ("A.TXT",)]))
def media_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.matching(media.entries(_volumes(spark, {"a.dsk": _disk()})), "*.t?t").select("path")


@query("media_sectors", _values("lba, bytes, first", [(0, 512, 235), (1, 512, 249), (7, 512, 66)]))
def media_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.sectors(_images(spark, {"a.dsk": _disk()})).where(F.col("lba").isin(0, 1, 7))
    return rows.select("lba", F.length("data").alias("bytes"), F.conv(F.hex(F.substring("data", 1, 1)), 16, 10).cast("int").alias("first"))


@query("media_multidisk", _values("name, lba_start, sector_count, files", [("D1", 0, 1440, 4), ("D2", 1440, 1440, 0)]))
def media_multidisk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _volumes(spark, {"set.dsk": _disk() + fatfs.blank("ds720")})
    files = media.entries(v).where("NOT is_dir").groupBy("volume_id").agg(F.count("*").alias("files"))
    return v.join(files, "volume_id", "left").select("name", "lba_start", "sector_count", F.coalesce("files", F.lit(0)).alias("files"))


@query("media_split", _values("name, length", [("set (Disk 1).dsk", 737280), ("set (Disk 2).dsk", 737280)]))
def media_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.split_images(_images(spark, {"dir/set.dsk": _disk() + fatfs.blank("ds720")}))
    return out.select("name", F.length("content").alias("length"))


@query("media_convert", _values("path, same", [("a.dsk", True)]))
def media_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _images(spark, {"a.dsk": _disk()})
    packed = media.encoded(images, "Xsa").select(F.replace("path", F.lit(".dsk"), F.lit(".xsa")).alias("path"), "content")
    again = containers.decode_images(packed).select(F.replace("path", F.lit(".xsa"), F.lit(".dsk")).alias("path"), F.col("data").alias("unpacked"))
    return images.join(again, "path").select("path", (F.col("data") == F.col("unpacked")).alias("same"))


@query("media_edit", _values("path, size", [("BIG.BIN", 5000), ("SUB", 0), ("SUB/HI.TXT", 5), ("NEW", 0), ("NEW/B.TXT", 20), ("NOEXT", 3)]))
def media_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _images(spark, {"a.dsk": _disk()})
    steps = [(1, "mkdir", "NEW", None, None), (2, "rename", "A.TXT", "NEW/B.TXT", None), (3, "add", "NOEXT", None, bytearray(b"new"))]
    edits = rows_of(spark, "ord int, op string, path string, target string, content binary", steps).crossJoin(F.broadcast(images.select("image_id")))  # one image
    return media.entries(media.volumes(media.apply_edits(images, edits))).select("path", "size")


@query("media_repair", _values("fix, size, length", [("truncate", 368640, 368640)]))
def media_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.repaired(_images(spark, {"a.dsk": fatfs.blank("ss360") + bytes(368640), "b.dsk": _disk()}))
    return rows.select("fix", "size", F.length("data").alias("length"))


def _tape() -> bytes:
    head = lambda kind, name: bytes([kind]) * 10 + name.ljust(6)
    blocks = [b"lost", head(0xEA, b"README"), b"a" * 256, b"b" * 100, head(0xD3, b"GAME"), b"\xff\0\0", head(0xD3, b"GAME"), b"two"]
    return b"junk" + b"".join(tapes.SYNC + b for b in blocks)


@query("media_tape", _values("file, kind, name, key, length", [(1, "ascii", "README", "README", 356), (2, "basic", "GAME", "GAME", 3), (3, "basic", "GAME", "GAME.1", 3)]))
def media_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = rows_of(spark, "path string, content binary", [("t.cas", bytearray(_tape()))])
    return tapes.tape_files(tapes.blocks(files)).select("file", "kind", "name", "key", F.length("data").alias("length"))


@query("media_archive", _values("idx, path, method, original_size, decodable", [(0, "A.TXT", "-lh0-", 5, True), (1, "B.BIN", "-pm2-", 9, False)]))
def media_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    def member(name: bytes, body: bytes, method: bytes, size: int) -> bytes:
        head = method + len(body).to_bytes(4, "little") + size.to_bytes(4, "little") + bytes(4) + b"\x20\x00" + bytes([len(name)]) + name + bytes(2)
        return bytes([len(head), sum(head) & 255]) + head + body

    data = member(b"A.TXT", b"hello", b"-lh0-", 5) + member(b"B.BIN", b"\1\2", b"-pm2-", 9) + b"\0"
    files = rows_of(spark, "path string, content binary", [("x.lzh", bytearray(data))])
    return lha.member_table(files).select("idx", "path", "method", "original_size", "decodable")


@query("media_basic", _values("number, text", [(10, 'PRINT"HI"'), (20, "GOTO 10")]))
def media_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    program = b"\xff" + b"\1\x80\x0a\0" + b'\x91"HI"\0' + b"\1\x80\x14\0" + b"\x89 \x0e\x0a\0\0" + b"\0\0"
    files = rows_of(spark, "name string, content binary", [("A.BAS", bytearray(program))])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [line for content in batch.column(1).to_pylist() for line in basic.lines(content)]
            yield pa.RecordBatch.from_pydict({"number": pa.array([n for n, _ in found], pa.int32()), "text": [t for _, t in found]})

    return files.mapInArrow(run, "number int, text string")


@query("media_disasm", _values("address, bytes, text", [(32768, "3E05", "LD A,0x05"), (32770, "CD0041", "CALL 0x4100"), (32773, "18F9", "JR 0x8000")]))
def media_disasm(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = bytes.fromhex("FE00800680008 03E05CD004118F9".replace(" ", ""))
    files = rows_of(spark, "name string, content binary", [("A.BIN", bytearray(code))])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                origin, _, body = disasm.locate(name, content)
                found += disasm.rows(body, origin)
            yield pa.RecordBatch.from_pydict({"address": pa.array([a for a, _, _ in found], pa.int32()), "bytes": [b.hex().upper() for _, b, _ in found], "text": [t for _, _, t in found]})

    return files.mapInArrow(run, "address int, bytes string, text string")


@query("media_hex", _values("address, bytes, shown", [("000000", "41 42 43 00", "ABC."), ("000004", "FF", ".   ")]))
def media_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = rows_of(spark, "name string, data binary", [("x", bytearray(b"ABC\0\xff"))])
    return hexrows.hex_rows(files, "name", "data", 4).select("address", "bytes", "shown")


def _dump(body: bytes) -> bytes:
    """A memory dump from address 0 with its header."""
    return b"\xfe\0\0" + (len(body) - 1).to_bytes(2, "little") + b"\0\0" + body


@query("media_pictures", _values("name, width, height, first, last", [("a.sc5", 256, 212, "000000FF", "FFFFFFFF"), ("b.sc7", 512, 424, "FFFFFFFF", "000000FF"), ("c.sc8", 256, 212, "FF0000FF", "FF0000FF"), ("d.gl5", 256, 2, "FFFFFFFF", "000000FF"), ("e.sc5", None, None, None, None)]))
def media_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = {"a.sc5": _dump(b"\x0f" * (128 * 212)), "b.sc7": _dump(b"\xf0" * (256 * 212)), "c.sc8": _dump(b"\x1c" * (256 * 212)), "d.gl5": b"\0\1\2\0" + b"\xf0" * 256, "e.sc5": b"no picture"}
    rows = rows_of(spark, "name string, content binary, companions map<string,binary>", [(n, bytearray(c), None) for n, c in files.items()])
    found = pictures.picture_table(rows)
    return found.select("name", "width", "height", F.hex(F.substring("rgba", 1, 4)).alias("first"), F.hex(F.substring(F.col("rgba"), F.length("rgba") - 3, F.lit(4))).alias("last"))


@query("media_music", _values("name, format, title, channels", [("a.mod", "Amiga module", "Tune", 8), ("b.mid", "Standard MIDI", "Song", None), ("c.saa", "E-Tracker compiled", None, 6)]))
def media_music(spark: SparkSession, sf_dir: str) -> DataFrame:
    song = b"MThd\0\0\0\6\0\1\0\2\0\x60MTrk\0\0\0\x0d\0\xff\x03\x04Song\0\xff\x2f\0"
    files = {"a.mod": b"Tune".ljust(1080, b"\0") + b"8CHN", "b.mid": song, "c.saa": bytes(10) + b"ETracker (C) BY ESI.", "d.mid": b"no song"}
    rows = rows_of(spark, "name string, content binary", [(n, bytearray(c)) for n, c in files.items()])
    return music.music_table(rows).select("name", "format", "title", "channels")


@query("media_zip", _values("n, kind, name, lba_start, sector_count, files", [(1, "zip", "one.dsk", 0, 1440, 4), (2, "zip", "two.xsa", 1440, 720, 0)]))
def media_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("readme.txt", "disks")
        z.writestr("set/one.dsk", _disk())
        z.writestr("two.xsa", xsa.compress(fatfs.blank("ss360")))
    v = _volumes(spark, {"set.zip": out.getvalue()})
    files = media.entries(v).where("NOT is_dir").groupBy("volume_id").agg(F.count("*").alias("files"))
    return v.join(files, "volume_id", "left").select("n", "kind", "name", "lba_start", "sector_count", F.coalesce("files", F.lit(0)).alias("files"))


@query("media_partitions", _values("name, lba_start, sector_count, clusters", [("P1", 1, 400, 194), ("P2", 401, 500, 244)]))
def media_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = bytearray(901 * 512)
    for k, (lba, n) in enumerate([(401, 500), (1, 400)]):
        at = 0x1BE + 16 * k
        data[at + 4] = 1
        data[at + 8 : at + 16] = lba.to_bytes(4, "little") + n.to_bytes(4, "little")
        data[lba * 512 : lba * 512 + 512] = fatfs.boot_sector(fatfs.Layout(2, 1, 2, 112, n, 0xF0, 2, 9, 2))
    data[510:512] = b"\x55\xaa"
    return _volumes(spark, {"hd.dsk": bytes(data)}).select("name", "lba_start", "sector_count", "clusters")


@query("media_journal", _values("lba, first", [(0, 235), (5, 51), (9, 34)]))
def media_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = b"".join(k.to_bytes(4, "little") + bytes([v]) * 512 for k, v in ((5, 0x11), (9, 0x22), (5, 0x33)))
    rows = media.sectors(_images(spark, {"x.sav": records}))
    first = F.conv(F.hex(F.substring("data", 1, 1)), 16, 10).cast("int")
    return rows.select("lba", first.alias("first")).where("first <> 0")


@query("media_listing", _values("line", [("----a     5000 2010-06-15 12:30 BIG.BIN",), ("d----    <DIR>                  SUB",), ("  ----a        5                  HI.TXT",), ("----a       20                  A.TXT",), ("----a        7                  NOEXT",)]))
def media_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.listing(media.entries(_volumes(spark, {"a.dsk": _disk()}))).select("line")


@query("media_archive_content", _values("path, text", [("A.TXT", "hello"), ("B.TXT", "ABABA")]))
def media_archive_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    def member(name: bytes, body: bytes, method: bytes, size: int) -> bytes:
        head = method + len(body).to_bytes(4, "little") + size.to_bytes(4, "little") + bytes(4) + b"\x20\x00" + bytes([len(name)]) + name + bytes(2)
        return bytes([len(head), sum(head) & 255]) + head + body

    place = 4096 - 18
    data = member(b"A.TXT", b"hello", b"-lh0-", 5) + member(b"B.TXT", bytes([3, 65, 66, place & 255, place >> 4 & 0xF0]), b"-lz5-", 5) + b"\0"
    files = rows_of(spark, "path string, content binary", [("x.lzh", bytearray(data))])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column(1).to_pylist():
                found = [m for m in lha.members(content) if m["decodable"]]
                yield pa.RecordBatch.from_pydict({"path": [m["path"] for m in found], "text": [lha.extract(content, m["idx"]).decode("latin-1") for m in found]})

    return files.mapInArrow(run, "path string, text string")
