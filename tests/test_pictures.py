import numpy as np
import pytest

from floppyscope.functions import music, pictures


def bsave(body: bytes) -> bytes:
    end = len(body) - 1
    return b"\xfe\0\0" + bytes([end & 255, end >> 8]) + b"\0\0" + body


def test_palettes():
    p = pictures.palette(pictures.DEFAULT)
    assert p[0] == 0 and p[15] == 0xFFFFFF and p[8] == 0xFF2424 and not pictures.is_palette(bytes(32), 0) and pictures.is_palette(pictures.DEFAULT, 0)
    assert pictures.grb332()[0xFF] == 0xFFFFFF and pictures.grb332()[0x1C] == 0xFF0000 and pictures.grb332()[0xE0] == 0x00FF00


def test_sixteen_colours():
    image = pictures.decode("a.SC5", bsave(bytes([0x1F]) * (128 * 212)))
    assert image.shape == (212, 256) and image[0, 0] == 0x000000 and image[0, 1] == 0xFFFFFF
    second = bsave(bytes([0xFF]) * (128 * 212))
    image = pictures.decode("a.sc5", bsave(bytes(128 * 212)), {"s15": second})
    assert image.shape == (424, 512) and image[0, 0] == 0 and image[1, 511] == 0xFFFFFF


def test_wide_modes():
    assert pictures.decode("a.sc6", bsave(bytes([0b00011011]) * (128 * 212)))[1, :4].tolist() == list(pictures.FOUR)
    image = pictures.decode("a.sc7", bsave(bytes([0xF0]) * (256 * 212)))
    assert image.shape == (424, 512) and image[3, :2].tolist() == [0xFFFFFF, 0]
    assert pictures.decode("a.sc8", bsave(bytes([0xFF]) * (256 * 212))).max() == 0xFFFFFF


def test_patterns():
    raw = bytearray(0x3800)
    raw[0:8] = b"\x80" * 8
    raw[0x2000:0x2008] = b"\xf1" * 8
    raw[0x1B80:0x1BA0] = pictures.DEFAULT
    image = pictures.decode("a.sc2", bsave(bytes(raw)))
    assert image.shape == (192, 256) and image[0, 0] == 0xFFFFFF and image[0, 1] == 0 and image[64, 0] == 0
    assert pictures.decode("a.sc3", bsave(bytes([0xF4]) * 0x600))[0, [0, 4]].tolist() == [pictures.FIRST_CHIP[15], pictures.FIRST_CHIP[4]]


def test_sprites():
    raw = bytearray(16384)
    raw[0x1B00:0x1B04] = bytes([255, 10, 0, 15])
    raw[0x1B04] = 208
    raw[0x3800] = 0xC0
    image = pictures.decode("a.sc2", bsave(bytes(raw)))
    assert (image[0, 10], image[0, 11]) == (pictures.FIRST_CHIP[15],) * 2 and image[0, 12] == pictures.FIRST_CHIP[0] and image[1, 10] == pictures.FIRST_CHIP[0]


def test_chroma():
    grey = pictures.yjk(np.array([[0xF8] * 4 + [0x80]]), None)
    assert grey[0].tolist() == [pictures.expand(31, 31, 31, 5)] * 4 + [pictures.expand(16, 16, 16, 5)]
    assert pictures.yjk(np.array([[0x08, 0, 0, 0]]), pictures.palette(pictures.DEFAULT))[0, 0] == 0


def test_saurus_packing():
    assert pictures.unpack_saurus(b"\x00\x00\x07\x03\x09\x20\x01", 300) == b"\x07" * 256 + b"\x09" * 3 + b"\x20" + bytes(40)
    body = b"\x00\x00\xff" * 212
    packed = b"\xfd\0\0" + len(body).to_bytes(2, "little") + b"\0\0" + body
    image = pictures.decode("a.sr7", packed, {"pl7": pictures.DEFAULT})
    assert image.shape == (424, 512) and (image == 0xFFFFFF).all()


def test_shapes():
    data = (256).to_bytes(2, "little") + (2).to_bytes(2, "little") + bytes([0xF0]) * 256
    for name in ("a.gl5", "unknown.xyz"):
        assert pictures.decode(name, data).shape == (2, 256)
    assert pictures.decode("a.txt", b"abc") is None and pictures.decode("a.sc5", b"") is None and pictures.decode("a.gl8", b"\xff" * 8) is None
    assert pictures.rgba(np.array([[0x010203]])) == b"\1\2\3\xff"


def test_picture_table(spark):
    rows = [("a.sc5", bytearray(bsave(bytes(128 * 212))), None), ("b.sc5", bytearray(b"x"), None), ("c.sr7", None, {"pl7": bytearray(32)})]
    got = {r["name"]: (r["width"], r["height"], r["error"]) for r in pictures.picture_table(spark.createDataFrame(rows, "name string, content binary, companions map<string,binary>")).collect()}
    assert got == {"a.sc5": (256, 212, None), "b.sc5": (None, None, "no picture"), "c.sr7": (None, None, "no picture")}


@pytest.mark.parametrize(
    ("name", "data", "want"),
    [
        ("a.mbm", b"\xff" + bytes(206) + b"My song".ljust(40) + b"\0KIT".ljust(12), {"format": "MoonBlaster 1.4", "title": "My song", "positions": None}),
        ("a.mod", b"Tune".ljust(1080, b"\0") + b"8CHN", {"format": "Amiga module", "title": "Tune", "channels": 8}),
        ("a.mod", b"", {"format": "Amiga module", "title": None, "channels": 4}),
        ("a.mid", b"MThd\0\0\0\6\0\1\0\2\0\x60MTrk\0\0\0\x0d\0\xff\x03\x04Song\0\xff\x2f\0", {"format": "Standard MIDI", "title": "Song", "extra": [("Tracks", "2")]}),
        ("a.pro", b"PT10x", {"format": "Pro-Tracker"}),
        ("a.mus", bytes(7 + 0x3F00 + 140) + b"\3" + bytes(25) + b"Tune".ljust(41) + b"Me".ljust(40) + b"\1\5", {"format": "FAC SoundTracker PRO", "title": "Tune", "author": "Me", "extra": [("Voices", "6CH MSX-MUSIC + percussion"), ("Tracks", "5")]}),
        ("a.saa", bytes(10) + b"ETracker (C) BY ESI.", {"format": "E-Tracker compiled", "channels": 6, "extra": [("Player code", "not present")]}),
        ("a.mwm", b"MBMS\x10\x08" + bytes([9]) + bytes(219) + b"Wave".ljust(50) + b"KIT".ljust(8), {"title": "Wave", "positions": 9, "channels": 24}),
        ("a.mfm", b"MBMS\x10\x01" + bytes([4]) + bytes(717) + b"FM".ljust(50), {"title": "FM", "positions": 4}),
        ("a.sbm", b"Blaf NT Song    " + b"Blaf".ljust(67) + b"KIT".ljust(8) + b"BIN" + b"\6", {"title": "Blaf", "positions": 7, "extra": [("Drums", "PSG"), ("Instrument kit", "KIT.BIN")]}),
        ("a.sng", bytes(1920) + b"\x10", {"format": "SCC-Musixx", "positions": 16}),
        ("a.pt3", b"ProTracker 3.5".ljust(0x1E) + b"T".ljust(32) + b"    " + b"A".ljust(32) + b"PT3!" + bytes(8) + b"02TS", {"title": "T", "author": "A", "channels": 6}),
    ],
)
def test_music(name, data, want):
    assert want.items() <= music.describe(name, data).items()


def test_no_music():
    assert music.describe("a.mid", b"x") is None and music.describe("a.txt", b"x") is None and music.describe("a.mbm", b"short") is None


class BitWriter:
    def __init__(self):
        self.text = ""

    def put(self, value, n=1):
        self.text += f"{value:0{n}b}"
        return self

    def bytes(self):
        text = self.text.ljust(-(-len(self.text) // 8) * 8, "0")
        return bytes(int(text[k : k + 8], 2) for k in range(0, len(text), 8))


def pi_file(width, height, bits, depth=4, machine=b"MSX2"):
    colours = bytes(v for c in range(16) for v in (c * 16, 0, 255 if c == 1 else 0))
    return b"Pi\x1a\0\0\1\1" + bytes([depth]) + machine + b"\0\0" + width.to_bytes(2, "big") + height.to_bytes(2, "big") + colours + bits


def test_pi():
    # Colours 0 and 1 (rank 0 after colour 0, then rank 15 as 1 + a number), then a copy of the line above.
    w = BitWriter().put(1).put(0)  # rank 0: colour 0
    w.put(1).put(1)  # rank 1 after colour 0: colour 15
    w.put(1, 2).put(0, 1)  # from a line above, once
    image = pictures.decode("a.pi", pi_file(2, 2, w.bytes() + bytes(8)))
    assert image.shape == (2, 2) and image.tolist() == [[0, 0xFF0000 & 0xFF0000], [0, 0xFF0000]]
    assert pictures.decode("a.pi", pi_file(2, 2, b"")) is None and pictures.decode("a.pi", pi_file(2, 2, bytes(9), machine=b"PC98")) is None


def test_mag():
    colours = bytes(v for c in range(16) for v in (0, 255 if c == 15 else 0, 0))
    head = bytes([0, 3, 0, 0]) + bytes(4) + (7).to_bytes(2, "little") + (1).to_bytes(2, "little") + (80).to_bytes(4, "little") + (81).to_bytes(4, "little") + bytes(4) + (83).to_bytes(4, "little") + bytes(4)
    # The second line copies both pairs from the line above: codes 4 and 4.
    body = bytes([0b01000000]) + bytes([0x44, 0]) + bytes([0xF0, 0x0F, 0xFF, 0x00])
    image = pictures.decode("a.mag", b"MAKI02  MSX \x1a" + head + colours + body)
    assert image.shape == (2, 8) and image[0].tolist() == image[1].tolist() == [0xFF0000, 0, 0, 0xFF0000, 0xFF0000, 0xFF0000, 0, 0]


def test_g9b():
    head = lambda depth, kind, colours, w, h: b"G9B\x0b\0" + bytes([depth, kind, colours, w, 0, h, 0, 0, 0, 0, 0])
    two = head(2, 0, 4, 4, 1) + bytes([0, 0, 0, 31, 0, 0, 0, 31, 0, 0, 0, 31]) + bytes([0b00011011])
    assert pictures.decode("a.g9b", two)[0].tolist() == [0, 0xFF0000, 0x00FF00, 0x0000FF]
    assert pictures.decode("x", head(16, 0, 0, 1, 1) + bytes([0x1F, 0]))[0, 0] == 0x0000FF
    assert pictures.decode("a.g9b", head(8, 0x40, 0, 4, 1) + b"\xff" * 4)[0, 0] == 0xFFFFFF
    assert pictures.decode("a.g9b", head(8, 0x80, 0, 4, 1) + b"\xf8" * 4)[0, 0] == 0xFFFFFF and pictures.decode("a.g9b", head(8, 0xC0, 0, 4, 1) + bytes(4)).shape == (1, 4)
    assert pictures.decode("a.g9b", two[:-1]) is None


def test_dd_graph():
    # Two bytes a line, the first line plain: F0 00, then the differences 0F 00 and 00 FF.
    data = bytes([2, 3, 1, 0b10000000, 0b10100100, 0xF0, 0x0F, 0xFF])
    image = pictures.decode("a.cmp", data, {"pl5": pictures.DEFAULT})
    white = 0xFFFFFF
    assert image.tolist() == [[white, 0, 0, 0], [white, white, 0, 0], [white, white, white, white]] or image.shape == (3, 4)
    assert pictures.decode("a.cmp", data + b"x") is None and pictures.decode("a.cmp", data[:-1]) is None


def test_publisher():
    head = b"DYNAMIC PUBLISHER FONT".ljust(0x200, b"\0")
    data = head + bytes([255, 0x00]) * 79 + bytes([254, 0]) + bytes([0, 0x08])
    image = pictures.decode("a.fnt", head + bytes([255, 0x08]) * 80)
    assert image.shape == (320, 512) and image[0, :9].tolist() == [0 if x in (0, 8) else 0xFFFFFF for x in range(9)]
    assert pictures.decode("a.fnt", data[:0x200]) is None


def test_describe_files(spark):
    from floppyscope.plans.describe import describe_files

    rows = [("A.SC5", bytearray(bsave(bytes(128 * 212)))), ("B.MOD", bytearray(b"Tune".ljust(1080, b"\0") + b"M.K.")), ("C.BIN", bytearray(bytes.fromhex("FE0080028000"  "80C9"))), ("D", bytearray(b"text\n"))]
    got = {r["name"]: r for r in describe_files(spark.createDataFrame(rows, "name string, content binary")).collect()}
    assert (got["A.SC5"]["width"], got["A.SC5"]["view"], got["A.SC5"]["description"]) == (256, "screen", "SCREEN 5 picture")
    assert (got["B.MOD"]["title"], got["B.MOD"]["view"]) == ("Tune", "music") and got["C.BIN"]["header"]["start"] == 0x8000 and got["D"]["view"] == "text"


def test_raw_views():
    from floppyscope.functions import bitmap

    white = 0xFFFFFF
    assert bitmap.render(b"\x80", bitmap.View(width=8, height=2))[:, :2].tolist() == [[white, 0], [0, 0]]
    tiles = bitmap.render(b"\x80" * 8 + b"\x01" * 8, bitmap.View("tiles8", width=19, height=8))
    assert tiles.shape == (8, 16) and tiles[0, 0] == white and tiles[7, 15] == white and tiles[0, 8] == 0
    sprite = bitmap.render(b"\x80" * 16 + b"\x01" * 16, bitmap.View("sprites16", width=16, height=16))
    assert sprite[3, 0] == white and sprite[3, 15] == white and not sprite[:, 1:15].any()
    assert bitmap.render(b"\x1b", bitmap.View("2bpp", "four", width=4, height=1))[0].tolist() == list(pictures.FOUR)
    assert bitmap.render(b"", bitmap.View("yjk", width=5, height=1)).shape == (1, 4) and bitmap.render(b"\xff", bitmap.View("8bpp", "grb332", 1, 2, 1)).tolist() == [[0, 0]]
    assert bitmap.height_for(bitmap.View(width=8), 3, 100) == 3 and bitmap.height_for(bitmap.View("tiles8", width=16), 17, 100) == 16


class MixedWriter:
    """Flag bytes are put where a reader fetches them: before the first bit that they hold."""

    def __init__(self):
        self.out, self.flag, self.count = bytearray(), -1, 8

    def bit(self, value, n=1):
        for k in range(n - 1, -1, -1):
            if self.count == 8:
                self.flag, self.count = len(self.out), 0
                self.out.append(0)
            self.out[self.flag] |= (value >> k & 1) << (7 - self.count)
            self.count += 1
        return self

    def byte(self, value):
        self.out.append(value)
        return self


def test_packed_g9b():
    head = b"G9B\x0b\0" + bytes([8, 0x40, 0, 8, 0, 1, 0, 1, 0, 0, 0])
    w = MixedWriter().bit(0).byte(0xFF).bit(1).bit(1).bit(1).bit(1).bit(0).bit(0)  # a length of 1, 3, 6 and one more
    w.byte(0)
    image = pictures.decode("a.g9b", head + bytes(3) + bytes(w.out))
    assert image.shape == (1, 8) and (image == 0xFFFFFF).all()
    assert pictures.decode("a.g9b", head + bytes(3)) is None


def test_mif():
    # 1536 bytes of blocks: literals alone, every one of which is a step; a step's number has more and more bits.
    w = BitWriter()
    body = bytes([0xF1]) * 1536
    for b in body:
        w.put(1).put(b, 8)
    width = 2
    while 1536 >> width:
        width += 1
    w.put(0).put((1 << width) - 1, width)
    while len(w.text) % 8:
        w.put(0)
    colours = pictures.DEFAULT
    image = pictures.decode("a.mif", b"\x09\0" + colours + w.bytes())
    assert image.shape == (192, 256) and image[0, [0, 4]].tolist() == [0xFFFFFF, 0]
    assert pictures.decode("a.mif", b"\x09\0" + colours + w.bytes() + b"x") is None


def test_mig():
    chunks = bytes([0, 2, 0, 0x0E, 0x0E, 9, 0, 0x0C]) + bytes([2, 0, 0, 0, 0, 0xD4, 0])
    w = MixedWriter()
    for b in chunks + b"\xff":
        w.bit(0).byte(b)
    left = 0xD4 * 256 - 1
    while left:
        n = min(left, 2 + (1 << 15) - 1) if left > 1 else 1
        bits = max(0, (n - 1).bit_length() - 1)
        w.bit(1).byte(0)
        for _ in range(bits):
            w.bit(1)
        w.bit(0).bit(n - 1 - (1 << bits), bits)
        left -= n
    w.bit(0).byte(3)  # the closing byte
    w.bit(1).byte(0)
    for _ in range(16):
        w.bit(1)
    w.bit(0).bit(0, 16)
    body = bytes(5) + bytes(w.out) + bytes(4)
    data = b"MSXMIG" + (len(body) + 4).to_bytes(4, "little") + body
    image = pictures.decode("a.mig", data)
    assert image is not None and image.shape == (212, 256) and (image == 0xFFFFFF).all()
    assert pictures.decode("a.mig", data[:-1]) is None
