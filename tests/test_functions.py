import fixtures as fx
import pytest
from pyspark.sql import functions as F

from floppyscope.functions import basic, binary, content, disasm, disk, names, timing


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(data: bytes):
    return F.unhex(F.lit(data.hex()))


def test_checksums(spark):
    nine = lit(b"123456789")
    assert one(spark, binary.crc32_hex(nine)) == "CBF43926" and one(spark, binary.crc32_hex(lit(b""))) == "00000000"
    assert one(spark, binary.crc16_arc(nine)) == 0xBB3D and one(spark, binary.crc16_ccitt(nine)) == 0x29B1 and one(spark, binary.crc16_arc(lit(b""))) == 0
    assert one(spark, binary.sha1_hex(lit(b"abc"))) == "a9993e364706816aba3e25717850c26c9cd0d89d"


def test_numbers(spark):
    data = lit(bytes([0xFE, 0xFF, 0x80, 0x01, 0x02]))
    assert one(spark, binary.u16le(data, 0)) == 0xFFFE and one(spark, binary.u32le(data, 1)) == 0x020180FF and one(spark, binary.u16be(data, 3)) == 0x0102
    assert one(spark, binary.byte_at(data, 9)) is None and one(spark, binary.signed(binary.byte_at(data, 0), 8)) == -2


@pytest.mark.parametrize(("needle", "fold", "places"), [("aa", False, [0, 1, 2]), ("", False, []), ("aaaaa", False, []), ("AA", True, [0, 1, 2]), ("AA", False, [])])
def test_find_all(spark, needle, fold, places):
    assert one(spark, content.find_all(F.lit("aaaa"), needle, fold)) == places


def test_find_bytes(spark):
    assert one(spark, content.find_bytes(lit(b"\xff\x00\xff\x00\xff"), b"\xff\x00")) == [0, 2]
    assert one(spark, content.find_bytes(lit(b"Hello hello"), b"HELLO", True)) == [0, 6] and one(spark, content.find_bytes(lit(b"Hello hello"), b"hello")) == [6]


@pytest.mark.parametrize(("text", "data"), [("DE AD BE EF", b"\xde\xad\xbe\xef"), ("", None), ("ABC", None), ("ZZ", None), (" 0a\n0B ", b"\n\x0b")])
def test_parse_hex(spark, text, data):
    assert one(spark, content.parse_hex(F.lit(text))) == data


@pytest.mark.parametrize(("path", "ext"), [("a/B.TXT", "txt"), ("a.b/c", None), ("x\\Y.Z", "z"), (".lzh", "lzh"), ("a.", None), ("", None)])
def test_extension(spark, path, ext):
    assert one(spark, names.extension(F.lit(path))) == ext


def test_names(spark):
    assert one(spark, names.extension(F.lit(".lzh"), need_stem=True)) is None
    assert one(spark, names.safe_component(F.lit('a/b:c\x07\x7f"é'))) == "a_b_c␇␡_é"
    assert one(spark, names.short_name(F.lit("hello world.text"))) == "HELLOWOR.TEX" and one(spark, names.short_name(F.lit("é.x"))) == "FILE.X"
    assert one(spark, names.truncate(F.lit("abcdef"), 4)) == "abc…" and one(spark, names.attribute_flags(F.lit(0x33))) == "drh-a"
    assert one(spark, names.human_size(F.lit(999))) == "999 B" and one(spark, names.human_size(F.lit(1125))) == "1.12 kB" and one(spark, names.human_size(F.lit(2_500_000))) == "2.50 MB"
    assert one(spark, names.ancestors(F.lit("a/b/c"))) == ["a", "a/b", "a/b/c"]


@pytest.mark.parametrize(("pattern", "name", "hit"), [("*.txt", "A.TXT", True), ("?.txt", "ab.txt", False), ("%", "x", True), ("a+b*", "a+bc", True), ("*", "", True), ("É", "é", False)])
def test_glob(spark, pattern, name, hit):
    assert one(spark, names.glob_match(F.lit(name), pattern)) == hit


@pytest.mark.parametrize(("a", "b", "newer"), [("v1.2.3", "1.2.2", True), ("1.10.0", "1.9.0", True), ("1.2", "1.0.0", False), ("x", "1.0.0", False), ("1.0.0", "1.0.0", False)])
def test_versions(spark, a, b, newer):
    assert one(spark, names.is_newer(F.lit(a), F.lit(b))) == newer


@pytest.mark.parametrize(("kind", "entry", "want"), [("FAT12", 0, "Free"), ("FAT12", 2, "Next"), ("FAT12", 0xFEF, "OutOfRange"), ("FAT12", 1, "End"), ("FAT12", 0xFF0, "Reserved"), ("FAT12", 0xFF7, "Bad"), ("FAT12", 0xFF8, "End"), ("FAT16", 0xFFF7, "Bad"), ("FAT16", 0xFFEF, "OutOfRange"), ("FAT16", 0xFFFF, "End")])
def test_pointers(spark, kind, entry, want):
    assert one(spark, disk.pointer_kind(F.lit(kind), F.lit(entry), F.lit(713))) == want


def test_dos_stamps(spark):
    assert str(one(spark, disk.unpack_dos(F.lit(30 << 9 | 6 << 5 | 15), F.lit(12 << 11 | 30 << 5)))) == "2010-06-15 12:30:00"
    assert one(spark, disk.unpack_dos(F.lit(1 << 5 | 1), F.lit(0))) is None and one(spark, disk.unpack_dos(F.lit(30 << 9 | 2 << 5 | 31), F.lit(0))) is None


def test_text(spark):
    yes = [b"a\r\n", b"\tx\n\x1a\x00\x00", b"caf\x82\n", b"\x01\x41\n"]
    no = [b"", b"abc", b"a\x00\n", b"a\n\x1ab", b"\x01\x20\n"]
    assert [one(spark, content.looks_like_text(lit(d))) for d in yes + no] == [True] * 4 + [False] * 5
    assert one(spark, content.expand_tabs(F.lit("a\tbc\t\td"))) == "a       bc              d" and one(spark, content.normalise_breaks(F.lit("a\r\nb\rc\n\rd"))) == "a\nb\nc\n\nd"


def test_headers(spark):
    bload = one(spark, content.bload_header(lit(bytes.fromhex("FE0080028000 80C9".replace(" ", "")))))
    assert (bload["start"], bload["end"], bload["entry"], bload["length"]) == (0x8000, 0x8002, 0x8000, 3)
    assert one(spark, content.bload_header(lit(b"\xfe\0"))) is None
    assert one(spark, content.cas_header(lit(fx.cas_header(0xD3, b"GAME"))))["name"] == "GAME"
    assert one(spark, content.view_of(F.lit("x.lzh"), lit(b"a"))) == "archive" and one(spark, content.view_of(F.lit("readme"), lit(b"hi\n"))) == "text" and one(spark, content.view_of(F.lit(".lzh"), lit(b"a"))) == "hex"


@pytest.mark.parametrize(
    ("tokens", "text"),
    [
        ((10, b'\x91"HI"'), '10 PRINT"HI"'), ((10, b"\x89 \x0e\x00\x01"), "10 GOTO 256"), ((20, b"\x8b A \xda B \x3a\xa1 C"), "20 IF A THEN B ELSE C"),
        ((30, b'\x91\xff\x81("X",\x12)'), '30 PRINTLEFT$("X",1)'), ((40, b"\x1d\x41\x15\x00\x00"), "40 1.5!"), ((10, b"\x8f hi:t"), "10 REM hi:t"), ((10, b'\xc1 "AB'), '10 PLAY "AB'),
        ((5, b"\x3a\x8f\xe6 x"), "5 ' x"), ((5, b"\x0c\xff\x00\x0b\x08\x00\x0f\x07\x1c\x39\x30"), "5 &HFF&O10712345"), ((5, b"\x1f\x42\x12\x34\x50\x00\x00\x00\x00"), "5 12.345#"),
        ((5, b"\x1d\x50\x12\x00\x00"), "5 1.2E+15"), ((5, b"\x1d\x00\x00\x00\x00"), "5 0!"), ((5, b'\x84 a,":",b:\x81'), '5 DATA a,":",b:END'), ((5, b"\x1d\x40\x25\x00\x00"), "5 .25!"),
    ],
)
def test_basic(tokens, text):
    assert basic.listing(fx.program(tokens)) == text + "\n"


def test_basic_text():
    assert basic.listing(b"10 PRINT\r\n20 END\r\n\x1axx") == "10 PRINT\n20 END\n" and basic.lines(b"x") == []


VECTORS = {
    "00": "NOP", "76": "HALT", "3E05": "LD A,0x05", "013412": "LD BC,0x1234", "41": "LD B,C", "46": "LD B,(HL)", "77": "LD (HL),A", "04": "INC B", "09": "ADD HL,BC", "3200C0": "LD (0xC000),A",
    "2A00C0": "LD HL,(0xC000)", "C9": "RET", "E9": "JP (HL)", "EB": "EX DE,HL", "08": "EX AF,AF'", "D9": "EXX", "F3": "DI", "FF": "RST 0x38", "D3A8": "OUT (0xA8),A", "DBA8": "IN A,(0xA8)",
    "80": "ADD A,B", "90": "SUB B", "A8": "XOR B", "BE": "CP (HL)", "C610": "ADD A,0x10", "FE00": "CP 0x00", "CD0040": "CALL 0x4000", "C23412": "JP NZ,0x1234", "CC3412": "CALL Z,0x1234", "C0": "RET NZ",
    "1800": "JR 0x0102", "18FE": "JR 0x0100", "2080": "JR NZ,0x0082", "CB00": "RLC B", "CB06": "RLC (HL)", "CB3F": "SRL A", "CB30": "SLL B", "CB7E": "BIT 7,(HL)", "CB86": "RES 0,(HL)", "CBFF": "SET 7,A",
    "EDB0": "LDIR", "EDA0": "LDI", "ED42": "SBC HL,BC", "ED4A": "ADC HL,BC", "ED4300C0": "LD (0xC000),BC", "ED4B00C0": "LD BC,(0xC000)", "ED44": "NEG", "ED4D": "RETI", "ED45": "RETN", "ED5E": "IM 2",
    "ED47": "LD I,A", "ED67": "RRD", "ED70": "IN F,(C)", "ED71": "OUT (C),0", "ED00": "DB 0xED, 0x00", "EDC1": "MULUB A,B", "EDD9": "MULUB A,E", "EDC3": "MULUW HL,BC", "EDF3": "MULUW HL,SP",
    "DD2100C0": "LD IX,0xC000", "DD09": "ADD IX,BC", "DD29": "ADD IX,IX", "DDE5": "PUSH IX", "DDE9": "JP (IX)", "DD7E05": "LD A,(IX+0x05)", "DD70FB": "LD (IX-0x05),B", "DD3602FF": "LD (IX+0x02),0xFF",
    "DD3400": "INC (IX+0x00)", "DD8604": "ADD A,(IX+0x04)", "DD2610": "LD IXH,0x10", "DD65": "LD IXH,IXL", "DD6601": "LD H,(IX+0x01)", "DDCB0546": "BIT 0,(IX+0x05)", "FDCBFE7E": "BIT 7,(IY-0x02)",
    "DDCB0506": "RLC (IX+0x05)", "DDCB0500": "RLC (IX+0x05),B", "DDCB05C0": "SET 0,(IX+0x05),B", "CD00": "DB 0xCD, 0x00", "DD": "DB 0xDD", "E3": "EX (SP),HL", "FDE3": "EX (SP),IY", "F9": "LD SP,HL", "27": "DAA",
}


@pytest.mark.parametrize("code", VECTORS)
def test_disassembly(code):
    raw = bytes.fromhex(code)
    assert disasm.decode(raw, 0x100) == (len(raw), VECTORS[code])


def test_disassembly_listing():
    assert disasm.decode(b"\xdd\xfd\x00") == (1, "DB 0xDD")
    assert disasm.listing(b"\x3e\x05\xc9", 0x100, 0x100).splitlines() == ["; origin 0x0100", "; exec   0x0100", "0100  3E 05        LD A,0x05", "0102  C9           RET"]
    assert disasm.locate("GAME.COM", b"\xc9") == (0x100, None, b"\xc9") and disasm.locate("A.BIN", bytes.fromhex("FE008002800080C9")) == (0x8000, 0x8000, b"\xc9")
    assert [a for a, _, _ in disasm.rows(b"\0\0\0", 0xFFFF)] == [0xFFFF, 0, 1]
    assert all(disasm.decode(bytes([a, b, 1, 2]))[0] for a in range(256) for b in range(256))


def test_charsets(spark):
    from floppyscope.functions import charsets

    name = charsets.name_of_bytes(lit(bytes([0x41, 0x80, 0xB1, 0xC1, 0xFF])))
    assert one(spark, name) == "A" and one(spark, charsets.bytes_of_name(name)) == bytes([0x41, 0x80, 0xB1, 0xC1, 0xFF])
    assert one(spark, charsets.shown_name(name, "International"))[:2] == "AÇ" and one(spark, charsets.shown_name(name, "Japanese"))[2] == "ｱ" and one(spark, charsets.shown_name(name, "Russian"))[3] == "а"
    assert one(spark, charsets.shown_name(name, "Russian"))[-1] == "█" and one(spark, charsets.bytes_of_name(F.lit("é"))) is None
    assert one(spark, charsets.typed_key(F.lit("dir/çÇx"), "International")) == "DIR/X" and one(spark, charsets.typed_key(F.lit("東"), "International")) is None
    assert one(spark, charsets.text_of(lit(bytes([0xE9, 0xCC])), "Japanese")) == "のﾌ" and all(len(charsets.high_half(c)) == 128 for c in charsets.SETS)
    assert [tuple(r) for r in one(spark, charsets.control_effects(F.lit("a\x07\x01\x07")))] == [(1, None), (7, "beep")]
    with pytest.raises(ValueError):
        charsets.high_half("short")


def test_file_control_block(spark):
    ok = lit(b"\0HELLO   TXT" + bytes(10))
    assert one(spark, content.fcb_header(ok))["name"] == "HELLO.TXT" and one(spark, content.fcb_header(lit(b"\x09HELLO   TXT" + bytes(10)))) is None
    assert [one(spark, content.volume_of_path(F.lit(p))) for p in ("P0/A", "X1/A", "D")] == [None] * 3 and one(spark, content.volume_of_path(F.lit("d2")))["n"] == 2


def test_hex_rows(spark):
    from floppyscope.operators.hexrows import hex_rows

    data = spark.createDataFrame([(1, bytearray(b"ABC\x00\x11\x22\x33\x44"))], "id int, data binary")
    rows = hex_rows(data, "id", "data", 8, base=0x100, group=2).collect()
    assert [(r["address"], r["bytes"], r["shown"]) for r in rows] == [("000100", "4142 4300 1122 3344", 'ABC.."3D')]
    assert hex_rows(data, "id", "data", 3, decimal=True).orderBy("offset").collect()[-1]["address"] == "000006"


def test_hold_rate(spark):
    shown = [one(spark, timing.hold_rate(F.lit(v).cast("double"))) for v in (0.0, 0.34, 0.35, 1.35, 2.35, 60.0, None)]
    assert shown == [0.0, 0.0, 20.0, 85.0, 150.0, 150.0, None]
