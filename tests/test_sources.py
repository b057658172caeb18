import random

import fixtures as fx
import pytest

from floppyscope.sources import containers, fatfs, lha, tapes, xsa


# ---------------------------------------------------------------- containers


@pytest.mark.parametrize("data", [b"", b"a", b"ab" * 700, bytes(5000), random.Random(1).randbytes(3000), bytes(range(256)) * 8, b"abc" * 4000 + random.Random(2).randbytes(500) + b"abc" * 3000])
def test_xsa_round_trip(data):
    packed = xsa.compress(data)
    if data:
        assert xsa.decompress(packed)[: len(data)] == data
    else:
        with pytest.raises(ValueError):
            xsa.decompress(packed)


def test_xsa_shrinks_and_refuses():
    disk = fx.two_files()
    packed = xsa.compress(disk)
    assert len(packed) < len(disk) // 20 and xsa.decompress(packed) == disk
    for bad in (b"", b"PCK\x08", packed[:100], b"XXXX" + packed[4:], packed[:4] + b"\xff\xff\xff\xff" + packed[8:]):
        with pytest.raises(ValueError):
            xsa.decompress(bad)


def test_distance_code_changes():
    code = xsa.DistanceCode()
    first = [code.code(k) for k in range(16)]
    for _ in range(300):
        code.used(3)
    assert len(code.code(3)) < len(first[3])
    assert sum(2.0 ** -len(code.code(k)) for k in range(16)) == 1.0


def test_dumps():
    sector = bytes(512)
    assert containers.raw(sector) == (b"", sector)
    assert containers.img(b"\x01" + sector) == (b"\x01", sector)
    assert containers.ddi(bytes(0x1200) + bytes(368640))[0] == bytes(0x1200)
    for f, bad in ((containers.raw, b"x"), (containers.raw, b""), (containers.img, bytes(514)), (containers.msx, sector), (containers.ddi, bytes(0x1200))):
        with pytest.raises(ValueError):
            f(bad)


def test_sav():
    _, disk = containers.sav(fx.sav([(5, 0x11), (9, 0x22), (5, 0x33)]))
    assert disk[5 * 512] == 0x33 and disk[9 * 512] == 0x22 and disk[:1] == b"\xeb" and len(disk) == 737280
    again = containers.encode_sav(disk)
    assert len(again) == 2 * 516 and containers.sav(again)[1] == disk
    with pytest.raises(ValueError):
        containers.sav(fx.sav([(1440, 1)]))


def test_dmk():
    image = fx.dmk(bad=(3, 4))
    rows = list(containers.dmk_sectors(image))
    assert len(rows) == 80 * 2 * 9 and all(r["id_crc_ok"] for r in rows)
    assert [(r["track"], r["ord"]) for r in rows if not r["data_crc_ok"]] == [(3, 4), (3, 4)]
    _, disk = containers.dmk(image)
    assert len(disk) == 737280 and all(disk[k * 512] == k & 255 for k in range(1440))
    assert len(containers.dmk(fx.dmk(sides=2, head=0))[1]) == 368640


def test_zip():
    disk = fx.two_files()
    image = fx.zip_of([("a/readme.txt", b"x", 0), ("a/one.dsk", disk, 8), ("two.xsa", xsa.compress(disk), 0), ("in.zip", fx.zip_of([("three.dsk", disk, 8)]), 0)])
    assert [(n, d == disk) for n, d in containers.zip_members(image)] == [("one.dsk", True), ("two.xsa", True), ("three.dsk", True)]
    for bad, say in ((fx.zip_of([("r.txt", b"x", 0)]), "r.txt"), (fx.zip_of([("a.dsk", disk, 0)], flags=1), "encrypted"), (b"PK", "end")):
        with pytest.raises(ValueError, match=say):
            containers.zip_members(bad)


# ---------------------------------------------------------------- volumes


def test_blank_disk():
    v = fatfs.Volume(bytes(737280))
    assert (v.clusters, v.free_clusters(), v.width) == (713, 713, 12) and not list(v.walk())
    for name, layout in fatfs.FORMATS.items():
        v = fatfs.Volume(fatfs.blank(name))
        assert v.sectors == layout.total and v.free_clusters() == v.clusters


def test_files():
    v = fatfs.Volume(fx.two_files())
    assert [(e.path, e.is_dir, e.size) for e in v.walk()] == [("BIG.BIN", False, 5000), ("SUB", True, 0), ("SUB/HI.TXT", False, 5)]
    assert v.read(v.find("sub/hi.txt")) == b"hello" and v.read(v.find("BIG.BIN")) == b"\xab" * 5000
    assert v.integrity() == {"lost": [], "cross_linked": [], "bad_pointers": [], "fragmented_percent": 0.0}
    assert v.dos_version() == 2 and fatfs.Volume(fatfs.blank()).dos_version() == 1


def test_edits():
    v = fatfs.Volume(fx.populated())
    assert [e.path for e in v.walk()] == ["UTILS", "UTILS/GAME.COM", "HELLO.TXT"]
    v = fatfs.Volume(v.rename("HELLO.TXT", "UTILS/BYE.TXT"))
    assert [e.path for e in v.walk()] == ["UTILS", "UTILS/GAME.COM", "UTILS/BYE.TXT"] and v.read(v.find("UTILS/BYE.TXT")) == b"hi there"
    for refused in (lambda: v.delete("UTILS"), lambda: v.mkdir("UTILS"), lambda: v.add("NO/X.TXT", b""), lambda: v.add("TOO.LONG", b""), lambda: v.delete("X"), lambda: v.add("BIG", bytes(800_000)), lambda: v.rename("UTILS", "UTILS/IN")):
        with pytest.raises(ValueError):
            refused()
    for p in ("UTILS/BYE.TXT", "UTILS/GAME.COM", "UTILS"):
        v = fatfs.Volume(v.delete(p))
    assert not list(v.walk()) and v.free_clusters() == 713
    data = fatfs.Volume(fatfs.blank()).mkdir("D")
    for k in range(40):  # the directory grows
        data = fatfs.Volume(data).add(f"D/F{k}.TXT", b"x" * k)
    assert len(list(fatfs.Volume(data).walk())) == 41 and fatfs.Volume(data).integrity()["lost"] == []
    assert data[:512] == fatfs.blank()[:512]


def test_integrity():
    end = 0xFFFF
    slots = [(b"A       BIN", 0x20, 2, 1024), (b"B       BIN", 0x20, 5, 1500), (b"C       BIN", 0x20, 5, 600)]
    v = fatfs.Volume(fx.fat16({2: 4, 4: end, 5: 6, 6: end, 7: end, 9: 0xFFF1, 11: 1}, slots), "partition")
    found = v.integrity()
    assert v.width == 16 and found["lost"] == [7, 11] and found["cross_linked"] == [5, 6] and round(found["fragmented_percent"]) == 33
    v = fatfs.Volume(fx.fat16({2: 3, 3: 2, 4: 0xF000}, [(b"LOOP       ", 0x20, 2, 9000), (b"OUT        ", 0x20, 4, 600)]), "partition")
    found = v.integrity()
    assert found["bad_pointers"] == [(4, 0xF000)] and found["lost"] == []
    assert len(v.chain(2)) == 8000 + 2


def test_width_rule():
    assert [fatfs.Volume(fatfs.boot_sector(fatfs.Layout(1, 1, 2, 112, 4200, 0xF0, 12, 9, 2)).ljust(4200 * 512, b"\0")).width] == [12]
    assert fatfs.Volume(fatfs.boot_sector(fatfs.Layout(1, 1, 2, 112, 5200, 0xF0, 15, 9, 2)).ljust(5200 * 512, b"\0")).width == 12  # sixteen bits wouldn't fit
    assert fatfs.Volume(fx.fat16({}, []), "partition").width == 16


def test_root_slots():
    good, data = b"OK      TXT", bytearray(fatfs.blank())
    at = fatfs.FORMATS["ds720"].root_start * 512
    for k, (attr, first, size) in enumerate([(0x20, 0, 0), (0x60, 0, 0), (0x20, 1, 0), (0x20, 715, 0), (0x20, 2, 800_000), (0x20, 2, 100)]):
        data[at + 32 * k : at + 32 * k + 32] = good + bytes([attr]) + bytes(14) + first.to_bytes(2, "little") + size.to_bytes(4, "little")
    v = fatfs.Volume(bytes(data))
    assert [v.reject_reason(raw) for _, raw in v._slots(None)] == [None, "attribute", "cluster", "cluster", "size", None]
    assert len(list(v.walk())) == 2


def test_split_and_partitions():
    disk = fx.two_files()
    assert fatfs.split_disks(disk * 3) == [(0, 1440), (1440, 1440), (2880, 1440)]
    assert fatfs.split_disks(fatfs.blank("ss360") * 2) == [(0, 720), (720, 720)]
    assert fatfs.split_disks(disk) == [] and fatfs.split_disks(disk + bytes(737280)) == []
    image = fx.partitioned()
    assert fatfs.partitions(image) == [(1, 400), (401, 500), (901, 599)]
    assert [(name, lba, [e.name for e in v.walk()]) for name, _, lba, _, v in fatfs.volumes(image)] == [("P1", 1, ["P1.TXT"]), ("P2", 401, ["P401.TXT"]), ("P3", 901, ["P901.TXT"])]
    assert [v[0] for v in fatfs.volumes(disk * 2)] == ["D1", "D2"]


def test_size_fix():
    small, big = fatfs.blank("ss360"), fatfs.blank("ds720")
    assert fatfs.size_mismatch(small) is None and fatfs.size_mismatch(big) is None
    assert fatfs.size_mismatch(small + bytes(368640)) == ("truncate", 368640) and fatfs.repair_size(small + bytes(368640)) == small
    assert fatfs.size_mismatch(small + b"x" * 368640) == ("none", 368640)
    assert fatfs.size_mismatch(big[:368640]) == ("pad", 737280) and len(fatfs.repair_size(big[:368640])) == 737280
    assert fatfs.size_mismatch(fatfs.with_layout(big, total=720)) == ("boot", 737280)


# ---------------------------------------------------------------- tapes and archives


def test_tsx():
    info = b"\x32" + (2 + 1 + 2 + 4 + 2 + 4).to_bytes(2, "little") + b"" 
    body = bytes([2, 0, 4]) + b"Game" + bytes([3, 4]) + b"1986"
    info = b"\x32" + len(body).to_bytes(2, "little") + body
    custom = b"\x35" + b"POKEs".ljust(16) + (3).to_bytes(4, "little") + b"abc"
    image = fx.tsx(custom, info, fx.tsx_data(b"hello"), b"\x20\x01\x00", fx.tsx_data(b"more"), b"\x99")
    found = list(tapes.tsx_blocks(image))
    assert [(b["block_type"], b["id"]) for b in found] == [("custom", "35"), ("info", "32"), ("data", "4B"), ("other", "20"), ("data", "4B")]
    assert found[1]["info"] == [{"k": "Title", "v": "Game"}, {"k": "Year", "v": "1986"}] and found[2]["data"] == b"hello" and found[0]["text"] == "POKEs"
    assert list(tapes.tsx_blocks(image[:-6])) == found[:4] and not list(tapes.tsx_blocks(b"nope"))


def test_lha():
    image = fx.lha(b"A.TXT", b"hello") + fx.lha(b"DIR/B.BIN", b"\1\2", b"-pm2-", 9) + b"\0"
    found = lha.members(image)
    assert [(m["path"], m["method"], m["original_size"], m["decodable"]) for m in found] == [("A.TXT", "-lh0-", 5, True), ("DIR/B.BIN", "-pm2-", 9, False)]
    assert found[0]["modified"] == "2010-06-15 12:30" and lha.extract(image, 0) == b"hello"
    assert lha.members(b"") == [] and lha.members(b"\0") == []
    with pytest.raises(ValueError):
        lha.extract(image, 1)
    with pytest.raises(ValueError):
        lha.members(image[:20])
    assert lha.crc16(b"123456789") == 0xBB3D


class BitWriter:
    def __init__(self):
        self.text = ""

    def put(self, value, n):
        self.text += f"{value:0{n}b}" if n else ""
        return self

    def bytes(self):
        return int(self.text.ljust(-(-len(self.text) // 8) * 8, "0"), 2).to_bytes(-(-len(self.text) // 8), "big")


def test_lh5_single_symbol_block():
    w = BitWriter().put(4, 16).put(0, 5).put(0, 5).put(0, 9).put(65, 9).put(0, 4).put(0, 4)
    assert lha.unpack(w.bytes(), 4, 13, 4) == b"AAAA"


def test_lh5_match():
    # Three symbols: A, B and a length of three; code lengths of one and two bits, written with a
    # code whose symbols 3 and 4 (lengths 1 and 2) take a bit each and 2 (a run of zeros) two bits.
    w = BitWriter().put(3, 16)
    w.put(5, 5)
    for n in (0, 0, 2):
        w.put(n, 3)
    w.put(0, 2).put(1, 3).put(2, 3)  # lengths of the symbols 2, 3 and 4: 2, 1, 2
    w.put(257, 9)
    w.put(0b10, 2).put(65 - 20, 9)  # 65 zeros
    w.put(0, 1)  # A: one bit
    w.put(0b11, 2)  # B: two bits
    w.put(0b10, 2).put(256 - 67 - 20, 9)
    w.put(0b11, 2)  # 256, a match of three: two bits
    w.put(0, 4).put(1, 4)  # the only distance class is 1: two back
    w.put(0, 1).put(0b10, 2).put(0b11, 2)
    assert lha.unpack(w.bytes(), 5, 13, 4) == b"ABABA"


def test_lh1_round_trip():
    """An encoder that walks the same adaptive code, over enough symbols to halve the counts."""
    rnd = random.Random(4)
    text = bytes(rnd.choice(b"aaaabbcd e") for _ in range(40_000))
    code, w = lha.AdaptiveCode(314), BitWriter()
    bits, at = [], 0
    lengths, high = lha.HIGH, {}
    value = 0
    for n in range(1, 9):
        for k, length in enumerate(lengths):
            if length == n:
                high[k] = (value, n)
                value += 1
        value <<= 1
    while at < len(text):
        back = text.rfind(text[at : at + 5], max(0, at - 4000), at + 4) if at > 5 else -1
        if back >= 0 and at - back >= 1 and len(text) - at >= 5:
            bits += code.path(5 + 253)
            code.used(5 + 253)
            d = at - back - 1
            v, n = high[d >> 6]
            bits += [v >> k & 1 for k in range(n - 1, -1, -1)] + [d >> k & 1 for k in range(5, -1, -1)]
            at += 5
        else:
            bits += code.path(text[at])
            code.used(text[at])
            at += 1
    w.text = "".join(map(str, bits))
    assert lha.unpack_lh1(w.bytes(), len(text)) == text


def test_adaptive_code_halves():
    a, b = lha.AdaptiveCode(20), random.Random(1)
    for _ in range(70_000):
        a.used(b.choice([0, 0, 0, 1, 2, 19]))
    assert len(a.path(0)) < len(a.path(7)) and sum(2.0 ** -len(a.path(k)) for k in range(20)) == 1.0
    assert a.count[a.root] <= a.FULL and all(a.count[k] <= a.count[k + 1] for k in range(a.root))


def test_plain_windows():
    # Literals A, B, then three bytes from where A was put.
    w = BitWriter().put(1, 1).put(65, 8).put(1, 1).put(66, 8).put(0, 1).put(2048 - 17, 11).put(1, 4)
    assert lha.unpack_lzs(w.bytes(), 5) == b"ABABA"
    place = 4096 - 18
    assert lha.unpack_lz5(bytes([0b011, 65, 66, place & 255, place >> 4 & 0xF0 | 0]), 5) == b"ABABA"
    assert lha.unpack_lz5(bytes([0, 7 * 13 & 255, 0]), 3) == bytes([7] * 3)
    with pytest.raises(ValueError):
        lha.unpack_lz5(b"\1A", 5)
