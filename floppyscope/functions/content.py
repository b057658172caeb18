"""Looking into contents: searches, text tests, hex rows, headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from floppyscope.functions.binary import byte_at, col, u16le
from floppyscope.functions.names import ascii_lower, extension

#: Extensions by the view that opens them, first match first.
VIEWS = {
    "archive": ("lzh", "lha", "pma", "lzs"),
    "screen": ("sc2", "sc3", "sc4", "sc5", "sc6", "sc7", "sc8", "sca", "scc", "sr5", "sr6", "sr7", "sr8", "ge5", "g9b", "pi", "mag"),
    "basic": ("bas",),
    "music": ("mbm", "mwm", "mfm", "mus", "pro", "sbm", "sng", "pt3", "mod", "mid"),
    "code": ("com", "cpm", "bin"),
}


def find_all(haystack: Column | str, needle: str, ignore_case: bool = False) -> Column:
    """Every place (from 0) where ``needle`` starts, overlaps included; none for an empty needle."""
    text = ascii_lower(haystack) if ignore_case else col(haystack)
    wanted = needle.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) if ignore_case else needle
    n = F.char_length(text) - len(needle)
    none = F.array().cast("array<int>")
    if not needle:
        return F.when(text.isNotNull(), none)
    places = F.transform(F.filter(F.sequence(F.lit(1), n + 1), lambda i: F.substring(text, i, F.lit(len(needle))) == wanted), lambda i: i - 1)
    return F.when(n >= 0, places).otherwise(F.when(text.isNotNull(), none))


def find_bytes(haystack: Column | str, needle: bytes, ignore_case: bool = False) -> Column:
    """``find_all`` over bytes, which are read one character each."""
    return find_all(F.decode(col(haystack), "ISO-8859-1"), needle.decode("latin-1"), ignore_case)


def parse_hex(text: Column | str) -> Column:
    """The bytes of a hex string with blanks; null if empty, odd or not hex."""
    digits = F.regexp_replace(col(text), r"\s+", "")
    return F.when(digits.rlike("^([0-9A-Fa-f]{2})+$"), F.unhex(digits))


def looks_like_text(data: Column | str) -> Column:
    """Whether bytes up to the first 1A are text: a line break, and only tabs, breaks, form
    feeds, escapes, printables, high bytes or 01 before 40 to 5F; after it 1A and 00 only."""
    text = F.decode(col(data), "ISO-8859-1")
    # Possessive runs: the matcher's depth grows with the count of runs and not of characters.
    return text.rlike(r"(?s)^(?=[^\x1A]*[\x0A\x0D])(?:[\x09\x0A\x0C\x0D\x1B\x20-\x7E\x80-\xFF]++|\x01[\x40-\x5F])*+(?:\x1A[\x1A\x00]*)?$")


def view_of(path: Column | str, data: Column | None = None) -> Column:
    """The view that opens a file first: by its extension, else text or hex."""
    ext = extension(path)
    out = F.when(extension(path, need_stem=True).isin(*VIEWS["archive"]), "archive")
    for view in ("screen", "basic", "music", "code"):
        out = out.when(ext.isin(*VIEWS[view]), view)
    return out.when(looks_like_text(data), "text").otherwise("hex") if data is not None else out.otherwise("hex")


def bload_header(data: Column | str) -> Column:
    """Start, end, entry and length of a binary with the FE header; null without one."""
    fields = F.struct(u16le(data, 1).alias("start"), u16le(data, 3).alias("end"), u16le(data, 5).alias("entry"), (F.pmod(u16le(data, 3) - u16le(data, 1), F.lit(65536)) + 1).alias("length"))
    return F.when((F.length(col(data)) >= 7) & (byte_at(data, 0) == 0xFE), fields)


def normalise_breaks(text: Column | str) -> Column:
    """CR, LF and CRLF as one line feed each."""
    return F.regexp_replace(col(text), "\r\n?", "\n")


def expand_tabs(line: Column | str, stop: int = 8) -> Column:
    """Tabs of one line as blanks up to the next stop."""
    parts = F.split(col(line), "\t", -1)
    pad = lambda s: F.concat(s, F.repeat(F.lit(" "), F.lit(stop) - F.char_length(s) % stop))
    return F.aggregate(F.slice(parts, 2, F.size(parts)), F.element_at(parts, 1), lambda s, p: F.concat(pad(s), p))


def cas_header(block: Column | str) -> Column:
    """Kind and name of a tape header block: ten equal bytes D0, D3 or EA, then six characters."""
    text = F.decode(col(block), "ISO-8859-1")
    kind = F.when(text.rlike(r"(?s)^\xD0{10}"), "binary").when(text.rlike(r"(?s)^\xD3{10}"), "basic").when(text.rlike(r"(?s)^\xEA{10}"), "ascii")
    return F.when(kind.isNotNull() & (F.length(col(block)) >= 16), F.struct(kind.alias("kind"), F.regexp_replace(F.substring(text, 11, 6), r"^[\s\x00]+|[\s\x00]+$", "").alias("name")))


def fcb_header(data: Column | str) -> Column:
    """Drive and name of a file control block; null unless the first 20 bytes can be one: drive
    up to 8, eleven printable name bytes, the first no blank."""
    name = F.decode(F.substring(col(data), 2, 11), "ISO-8859-1")
    base, ext = F.rtrim(F.substring(name, 1, 8)), F.rtrim(F.substring(name, 9, 3))
    whole = F.when(ext == "", base).otherwise(F.concat_ws(".", base, ext))
    fields = F.struct(byte_at(data, 0).alias("drive"), whole.alias("name"))
    return F.when((F.length(col(data)) >= 20) & (byte_at(data, 0) <= 8) & name.rlike(r"^[\x20-\x7E]{11}$") & (base != ""), fields)


def volume_of_path(path: Column | str, letters: str = "PD") -> Column:
    """Volume number and rest of a path like P2/DIR/FILE; null where it names none."""
    pattern = f"^[{letters}{letters.lower()}]([0-9]{{1,9}})(?:/(.*))?$"
    number = F.regexp_extract(col(path), pattern, 1)
    return F.when((number != "") & (number.rlike("[1-9]")), F.struct(number.cast("int").alias("n"), F.regexp_extract(col(path), pattern, 2).alias("rest")))


#: Bytes of code that a listing shows: the processor's whole address space.
LISTED_CODE = 64 * 1024


def capped(data: Column | str, cap: int = LISTED_CODE) -> Column:
    """(shown, size, cut): the first ``cap`` bytes for a listing, the whole size, and whether more follow."""
    size = F.length(col(data))
    return F.struct(F.substring(col(data), 1, cap).alias("shown"), size.alias("size"), (size > cap).alias("cut"))
