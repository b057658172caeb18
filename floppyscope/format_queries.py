"""Queries over bytes that are laid out here by hand, as the formats say, and by no writer of
this package. Their SQL states what the formats say of them."""

from __future__ import annotations

import binascii
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floppyscope.contract import query, rows_of
from floppyscope.functions import bitmap, charsets, content, music, names, pictures
from floppyscope.media_queries import _values
from floppyscope.plans import media
from floppyscope.plans.describe import describe_files
from floppyscope.sources import containers, fatfs, tapes


def _files(spark: SparkSession, files: dict[str, bytes], name: str = "path") -> DataFrame:
    return rows_of(spark, f"{name} string, content binary", [(p, bytearray(c)) for p, c in files.items()])


# ---------------------------------------------------------------- raw tracks


def _checked(mark: bytes) -> bytes:
    return mark + struct.pack(">H", binascii.crc_hqx(b"\xa1\xa1\xa1" + mark, 0xFFFF))


def _track(cyl: int, bad: int | None = None) -> bytes:
    """A double-density track of nine sectors, whose first payload byte is the sector's linear number."""
    pointers, body = b"", bytes(128)
    for n in range(1, 10):
        body += bytes(12) + b"\xa1\xa1\xa1"
        pointers += struct.pack("<H", len(body) | 0x8000)
        body += _checked(bytes([0xFE, cyl, 0, n, 2])) + b"\x4e" * 22 + bytes(12) + b"\xa1\xa1\xa1"
        data = _checked(b"\xfb" + bytes([cyl * 9 + n - 1]) + bytes(511))
        body += data[:-1] + bytes([data[-1] ^ (n == bad)])
    return (pointers.ljust(128, b"\0") + body[128:]).ljust(6272, b"\x4e")


def _raw_tracks() -> bytes:
    return bytes([0, 2]) + struct.pack("<H", 6272) + b"\x10" + bytes(11) + _track(0) + _track(1, bad=4)


@query("media_dmk", _values("track, ord, cyl, sector, size, density, good, first", [(t, k, t, k + 1, 512, "MFM", (t, k) != (1, 3), f"{t * 9 + k:02X}") for t in (0, 1) for k in range(9)]))
def media_dmk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = containers.dmk_table(_files(spark, {"a.dmk": _raw_tracks(), "b.dmk": b"short"}))
    return found.select("track", "ord", "cyl", "sector", "size", "density", (F.col("id_crc_ok") & F.col("data_crc_ok")).alias("good"), F.hex(F.substring("data", 1, 1)).alias("first"))


@query("media_dmk_report", _values("track, side, sectors, size, density, bad, standard", [(0, 0, 9, 512, "MFM", 0, True), (1, 0, 9, 512, "MFM", 1, False)]))
def media_dmk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.track_report(containers.dmk_table(_files(spark, {"a.dmk": _raw_tracks()}))).drop("image_id")


@query("media_raw_images", _values("path, format, sectors, error", [("a.dmk", "Dmk", 720, None), ("b.dmk", "Dmk", None, "Malformed"), ("c.msx", "Msx", 1440, None), ("d.msx", "Msx", None, "Malformed")]))
def media_raw_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = containers.decode_images(_files(spark, {"a.dmk": _raw_tracks(), "b.dmk": b"short", "c.msx": bytes(737280), "d.msx": bytes(512)}))
    return images.select("path", "format", F.col("sector_count").alias("sectors"), F.col("error.kind").alias("error"))


# ---------------------------------------------------------------- cassettes


def _cassette() -> bytes:
    info = bytes([2, 0, 4]) + b"Game" + bytes([3, 4]) + b"1986"
    block = lambda body: b"\x4b" + struct.pack("<I", len(body) + 12) + bytes(12) + body
    return b"ZXTape!\x1a\x01\x15" + b"\x35" + b"POKEs".ljust(16) + struct.pack("<I", 3) + b"abc" + b"\x32" + struct.pack("<H", len(info)) + info + block(b"\xd0" * 10 + b"GAME  ") + b"\x20\x01\x00" + block(b"more") + b"\x99"


@query("media_tsx", _values("ord, block_type, id, text, title, bytes", [(0, "custom", "35", "POKEs", None, 3), (1, "info", "32", None, "Game", None), (2, "data", "4B", None, None, 16), (3, "other", "20", None, None, None), (4, "data", "4B", None, None, 4)]))
def media_tsx(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tapes.blocks(_files(spark, {"a.tsx": _cassette(), "b.tsx": b"no tape"}))
    return found.select("ord", "block_type", "id", "text", F.get(F.filter("info", lambda x: x["k"] == "Title"), F.lit(0))["v"].alias("title"), F.length("data").alias("bytes"))


@query("media_tsx_files", _values("key, content", [("GAME", "more")]))
def media_tsx_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tapes.tape_files(tapes.blocks(_files(spark, {"a.tsx": _cassette()})))
    return found.select("key", F.decode("data", "ISO-8859-1").alias("content"))


# ---------------------------------------------------------------- texts and numbers

_SET_BYTES = ["80", "84", "9E", "B1", "C0", "DB", "E1", "FF"]
_SET_CHARACTERS = {"International": "Çä₧ã▂█ß█", "Japanese": "♠○せｱﾀﾛち█", "Russian": "▂▬▐±юшА█", "Korean": "♠○ㅔ노로쑤유█", "Brazilian": "ÇÁ₢ã▂█ß█"}


@query("charset_tables", _values('id, "International", "Japanese", "Russian", "Korean", "Brazilian"', [(k, *(_SET_CHARACTERS[c][k] for c in ("International", "Japanese", "Russian", "Korean", "Brazilian"))) for k in range(len(_SET_BYTES))]))
def charset_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, "id int, data binary", [(k, bytearray.fromhex(h)) for k, h in enumerate(_SET_BYTES)])
    return rows.select("id", *(charsets.text_of("data", c).alias(c) for c in ("International", "Japanese", "Russian", "Korean", "Brazilian")))


@query("charset_arabic", "SELECT * FROM (VALUES (0, chr(1642)), (1, chr(1632)), (2, chr(65164)), (3, chr(1569)), (4, chr(9608))) t(id, text)")
def charset_arabic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, "id int, data binary", [(k, bytearray([b])) for k, b in enumerate((0x85, 0x90, 0xA1, 0xF0, 0xFF))])
    return rows.select("id", charsets.text_of("data", "Arabic").alias("text"))


_VIEWED = [b"hi\r\nthere\rnow\nend", b"A\tB\tC", b"12345678\tX", b"a\x00b\x1b\x7f", b"\x80\xe1", b"one\n\ttwo\r\n\r\n", b""]


@query(
    "text_view",
    "SELECT * FROM (VALUES (0, 'hi' || chr(10) || 'there' || chr(10) || 'now' || chr(10) || 'end', 'hi' || chr(10) || 'there' || chr(10) || 'now' || chr(10) || 'end'), (1, 'A       B       C', 'A       B       C'),"
    " (2, '12345678        X', '12345678        X'), (3, 'a.b..', 'a' || chr(0) || 'b' || chr(27) || chr(127)), (4, 'Çß', 'Çß'), (5, 'one' || chr(10) || '        two' || chr(10) || chr(10), 'one' || chr(10) || '        two' || chr(10) || chr(10)), (6, '', '')) t(id, dots, shown)",
)
def text_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, "id int, data binary", [(k, bytearray(v)) for k, v in enumerate(_VIEWED)])
    return rows.select("id", charsets.text_view("data", "International").alias("dots"), charsets.text_view("data", "International", show_all=True).alias("shown"))


@query("typed_keys", "SELECT * FROM (VALUES ('game.bas', 'GAME.BAS'), ('ｱ.txt', chr(61617) || '.TXT'), ('é', NULL)) t(path, key)")
def typed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, "path string", [("game.bas",), ("ｱ.txt",), ("é",)])
    return rows.select("path", charsets.typed_key("path", "Japanese").alias("key"))


@query("hex_patterns", _values("pattern, bytes", [("C9", "C9"), ("cd 05 00", "CD0500"), (" 0a\t0B ", "0A0B"), ("C", None), ("xy", None), ("", None)]).replace("\t", "' || chr(9) || '"))
def hex_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, "pattern string", [("C9",), ("cd 05 00",), (" 0a\t0B ",), ("C",), ("xy",), ("",)])
    return rows.select("pattern", F.hex(content.parse_hex("pattern")).alias("bytes"))


@query(
    "human_sizes",
    """SELECT doc_id, CASE WHEN n < 1000 THEN n::VARCHAR || ' B' WHEN n < 1000000 THEN printf('%.2f', n / 1000.0) || ' kB' ELSE printf('%.2f', n / 1000000.0) || ' MB' END AS shown
       FROM (SELECT doc_id, n_chars - n_chars % 10 AS n FROM documents)""",
)
def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from floppyscope.contract import table

    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") - F.col("n_chars") % 10).alias("n"))
    return rows.select("doc_id", names.human_size("n").alias("shown"))


_PROGRAM = bytes.fromhex("FE00800280008021C9C9")


@query("bload_headers", "SELECT * FROM (VALUES (0, 32768, 32770, 32768, 3), (1, NULL, NULL, NULL, NULL), (2, NULL, NULL, NULL, NULL)) t(id, start, stop, entry, length)")
def bload_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, "id int, data binary", [(0, bytearray(_PROGRAM)), (1, bytearray(b"\xfe\0")), (2, bytearray(b"no program"))])
    h = content.bload_header("data")
    return rows.select("id", h["start"].alias("start"), h["end"].alias("stop"), h["entry"].alias("entry"), h["length"].alias("length"))


# ---------------------------------------------------------------- music, pictures, descriptions

_SONGS = {
    "a.mbm": bytes([12]) + bytes(206) + b"Blaster".ljust(41) + b"KIT     ",
    "b.mwm": b"MBMS\x10\x08" + bytes([9]) + bytes(219) + b"Wave".ljust(50) + b"KIT".ljust(8),
    "c.mfm": b"MBMS\x10\x01" + bytes([4]) + bytes(717) + b"FM".ljust(50),
    "d.pro": b"PT10" + bytes(60),
    "e.sbm": b"Blaf NT Song    " + b"Scc".ljust(67) + b"DRUMS   " + b"KIT" + bytes([7]) + bytes(300),
    "f.sng": bytes(1920) + bytes([33]),
    "h.mwm": b"nothing",
}


@query(
    "media_songs",
    _values("name, format, title, positions, channels", [("a.mbm", "MoonBlaster 1.4", "Blaster", 12, None), ("b.mwm", "MoonBlaster for MoonSound Wave", "Wave", 9, 24), ("c.mfm", "MoonBlaster for MoonSound FM", "FM", 4, 6), ("d.pro", "Pro-Tracker", None, None, None), ("e.sbm", "SCC Blaffer NT", "Scc", 8, 5), ("f.sng", "SCC-Musixx", None, 33, 5)]),
)
def media_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = music.music_table(_files(spark, _SONGS, "name"))
    return found.select("name", "format", "title", "positions", "channels")


def _saved(body: bytes) -> bytes:
    return b"\xfe\0\0" + struct.pack("<H", len(body) - 1) + b"\0\0" + body


def _patterns() -> bytes:
    """A SCREEN 2 dump: every pattern row FF, colours F4 (white on dark blue), no sprites."""
    memory = bytearray(0x4000)
    memory[0:0x1800] = b"\xff" * 0x1800
    memory[0x1800:0x1B00] = bytes(k & 255 for k in range(0x300))
    memory[0x1B00] = 0xD0
    memory[0x2000:0x3800] = b"\xf4" * 0x1800
    return bytes(memory[:0x3800])


_SCREENS = {
    "a.sc2": _saved(_patterns()),
    "b.sc3": _saved(b"\xf4" * 0x600),
    "c.sc6": _saved(bytes(128 * 212)),
    "d.sc5": _saved(bytes(128 * 212)),
    "e.sc8": _saved(b"\xff" * (256 * 212)),
}


@query("media_screens", _values("name, width, height, first", [("a.sc2", 256, 192, "FAFFF8FF"), ("b.sc3", 256, 192, "FAFFF8FF"), ("c.sc6", 512, 424, "000000FF"), ("d.sc5", 256, 212, "000000FF"), ("e.sc8", 256, 212, "FFFFFFFF")]))
def media_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _files(spark, _SCREENS, "name").withColumn("companions", F.lit(None).cast("map<string,binary>"))
    return pictures.picture_table(rows).select("name", "width", "height", F.hex(F.substring("rgba", 1, 4)).alias("first"))


@query("media_described", _values("name, description, view, start, width, format", [("d.sc5", "SCREEN 5 picture", "screen", None, 256, None), ("g.bin", "Binary program", "code", 32768, None, None), ("h.mfm", "MoonSound FM music", "music", None, None, "MoonBlaster for MoonSound FM"), ("i.txt", "Text", "text", None, None, None), ("k.zzz", None, "hex", None, None, None)]))
def media_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = {"d.sc5": _SCREENS["d.sc5"], "g.bin": _PROGRAM, "h.mfm": _SONGS["c.mfm"], "i.txt": b"a line\r\n", "k.zzz": b"\0\1"}
    found = describe_files(_files(spark, files, "name"))
    # A dump of a picture has a program's header, too.
    return found.select("name", "description", "view", F.when(F.col("width").isNull(), F.col("header.start")).alias("start"), "width", "format")


@query("raw_bitmap", _values("id, width, height, first, last", [(0, 8, 2, "000000", "FFFFFF")]))
def raw_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = bitmap.render(b"\x00\xff", bitmap.View(width=8, height=2))
    return rows_of(spark, "id int, width int, height int, first string, last string", [(0, image.shape[1], image.shape[0], f"{int(image[0, 0]):06X}", f"{int(image[-1, -1]):06X}")])


# ---------------------------------------------------------------- sectors


@query("sector_writes", _values("id, sectors, here, beside, rest", [(0, 8, 7, 0, True)]))
def sector_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fatfs.write_sector(bytes(8 * 512), 3, b"\7" * 512)
    return rows_of(spark, "id int, sectors int, here int, beside int, rest boolean", [(0, len(out) // 512, out[3 * 512], out[4 * 512], not any(out[: 3 * 512]))])


@query("boot_blocks", _values("id, jump, layout, serial, mark", [(0, "EB", "F9", "78563412", "55AA")]))
def boot_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    disk = bytearray(737280)
    disk[21], disk[510:512] = 0xF9, b"\x55\xaa"
    out = fatfs.install_boot_block(bytes(disk), b"\xeb" * 512, 0x12345678)
    return rows_of(spark, "id int, jump string, layout string, serial string, mark string", [(0, out[:1].hex().upper(), out[21:22].hex().upper(), out[0x27:0x2B].hex().upper(), out[510:512].hex().upper())])


@query("capped_listings", "SELECT * FROM (VALUES (0, 65536, 65537, true), (1, 65536, 65536, false), (2, 0, 0, false), (3, NULL, NULL, NULL)) t(id, shown, size, cut)")
def capped_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, "id int, data binary", [(0, bytearray(65537)), (1, bytearray(65536)), (2, bytearray()), (3, None)])
    return rows.select("id", content.capped("data").alias("c")).select("id", F.length("c.shown").alias("shown"), "c.size", "c.cut")
