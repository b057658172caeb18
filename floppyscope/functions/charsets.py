"""Character sets of file names and texts: six sets of the machine's models, of 128 characters each.

A cell that no machine defines is U+FFFD. FF is the cursor block in all. Another set is given by
the caller as 128 characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from floppyscope.functions.binary import col
from floppyscope.functions.names import LOWER, UPPER

#: Names carry a byte from 80 on as the character U+F000 + byte.
NAME_BASE = 0xF000
BLOCK = "█"
#: What a control character does on the screen.
CONTROL_EFFECTS = {0x07: "beep", 0x08: "cursor left", 0x09: "tab", 0x0A: "line feed", 0x0B: "home", 0x0C: "clear screen", 0x0D: "carriage return", 0x1B: "escape sequence", 0x1C: "cursor right", 0x1D: "cursor left", 0x1E: "cursor up", 0x1F: "cursor down", 0x7F: "delete"}


# What the machines show for the bytes from 80 on, sixteen a line. These lines are
# parts of more than one set.
_WESTERN = "ÉæÆôöòûùÿÖÜ¢£¥"
_MARKS = "áíóúñÑªº¿⌐¬½¼¡«»"
_GRAPHICS = "▂▚▆🮂▬🮅▎▞▊🮇🮊🮙🮘🭭🭯🭬" "🭮🮚🮛▘▗▝▖🮖Δ‡ω█▄▌▐▀"
_GREEK = "αßΓπΣσµτΦΘΩδ∞{}∈∩" "≡±≥≤⌠⌡÷≈°∙·√ⁿ²■"

_INTERNATIONAL = "ÇüéâäàåçêëèïîìÄÅ" + _WESTERN + "₧ƒ" + _MARKS + "ÃãĨĩÕõŰűĲĳ¾∽◊‰¶§" + _GRAPHICS + _GREEK.format("⌀") + BLOCK
_BRAZILIAN = "ÇüéâÁà¨çêÍÓÚÂÊÔÀ" + _WESTERN + "₢ƒ" + _MARKS + "ÃãĨĩÕõŨũĲĳ¾∽◇‰¶§" + _GRAPHICS + _GREEK.format("∅") + BLOCK
_RUSSIAN = _GRAPHICS + _GREEK.format("∅") + "¤" + "юабцдефгхийклмно" "пярстужвьызшэщчъ" "ЮАБЦДЕФГХИЙКЛМНО" "ПЯРСТУЖВЬЫЗШЭЩЧ" + BLOCK
_JAPANESE = (
    "♠♥♣♦○●をぁぃぅぇぉゃゅょっ"
    "�あいうえおかきくけこさしすせそ"
    "�｡｢｣､･ｦｧｨｩｪｫｬｭｮｯ"
    "ｰｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿ"
    "ﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏ"
    "ﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝﾞﾟ"
    "たちつてとなにぬねのはひふへほま"
    "みむめもやゆよらりるれろわん�"
) + BLOCK
_KOREAN = (
    "♠♥♣♦○●ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅ"
    "ㅆㅇㅈㅉㅊㅋㅌㅍㅎㅏㅐㅑㅒㅓㅔㅕ"
    "ㅖㅗㅛㅜㅠㅡㅣ고교구규그꼬꾜꾸뀨"
    "끄노뇨누뉴느도됴두듀드또뚀뚜뜌뜨"
    "로료루류르모묘무뮤므보뵤부뷰브뽀"
    "뾰뿌쀼쁘소쇼수슈스쏘쑈쑤쓔쓰오요"
    "우유으조죠주쥬즈쪼쬬쭈쮸쯔초쵸추"
    "츄츠코쿄쿠큐크토툐투튜트���"
) + BLOCK
# Code points, since marks that combine and letters that run from the right can't be read in a line.
_ARABIC = "".join(
    chr(int(c, 16))
    for c in (
        "FFFD FFFD FFFD FFFD FFFD 066A FFFD FFFD FFFD FFFD FFFD FFFD 060C FFFD FFFD FFFD "
        "0660 0661 0662 0663 0664 0665 0666 0667 0668 0669 FFFD 061B FFFD FFFD FFFD 061F "
        "FFFD FE8C 0626 FE92 0628 FE98 062A FE9C 062B FEA0 062C FEA4 062D FEA8 062E FEB4 "
        "0633 FEB8 0634 FEBC 0635 FEC0 0636 0637 0638 FECB 0639 FFFD FFFD FFFD FFFD FFFD "
        "FECC FECA FECF 063A FED0 FECE FED4 0641 FED8 0642 FEDC 0643 FEE0 0644 FEE4 0645 "
        "FEE8 0646 FEEC 0647 FEF4 064A FEF2 0622 FE82 0623 FE84 FFFD FFFD FFFD FFFD 0624 "
        "0625 FE88 0627 FE8E 0629 062F 0630 0631 0632 0648 0649 FEF0 FEFC FEF8 FEF6 FEFA "
        "0621 0640 064B 064C 064D 064E FE77 064F FE79 0650 FE7B 0651 FE7D 0652 FE7F 2588"
    ).split()
)
SETS = {"International": _INTERNATIONAL, "Japanese": _JAPANESE, "Russian": _RUSSIAN, "Korean": _KOREAN, "Arabic": _ARABIC, "Brazilian": _BRAZILIAN}


def high_half(charset: str) -> str:
    """The characters of 80 to FF: a known set, or the caller's own 128 characters."""
    table = SETS.get(charset, charset)
    if len(table) != 128:
        raise ValueError("a set has 128 characters from 80 on")
    return table


_PRIVATE = "".join(chr(NAME_BASE + b) for b in range(0x80, 0x100))


def name_of_bytes(raw: Column | str) -> Column:
    """A name as text that keeps its bytes: those from 80 on as private characters."""
    return F.translate(F.decode(col(raw), "ISO-8859-1"), "".join(map(chr, range(0x80, 0x100))), _PRIVATE)


def bytes_of_name(name: Column | str) -> Column:
    """The bytes of such a name; null if it holds other characters."""
    back = F.translate(col(name), _PRIVATE, "".join(map(chr, range(0x80, 0x100))))
    return F.when(~col(name).rlike("[^\\x00-\\x7F\\uF080-\\uF0FF]"), F.encode(back, "ISO-8859-1"))


def shown_name(name: Column | str, charset: str) -> Column:
    """A name with its bytes as the characters of a set; others pass."""
    return F.translate(col(name), _PRIVATE, high_half(charset))


def typed_key(path: Column | str, charset: str) -> Column:
    """The key of a typed path: ASCII upper case, the set's characters as private ones; null if
    any character is in no set."""
    table = high_half(charset)
    known = [(c, p) for k, (c, p) in enumerate(zip(table, _PRIVATE)) if c != "�" and table.index(c) == k]
    upper = F.translate(col(path), LOWER, UPPER)
    key = F.translate(upper, "".join(c for c, _ in known), "".join(p for _, p in known))
    return F.when(~key.rlike("[^\\x00-\\x7F\\uF080-\\uF0FF]"), key)


def text_of(data: Column | str, charset: str) -> Column:
    """Bytes as text of a set."""
    return F.translate(F.decode(col(data), "ISO-8859-1"), "".join(map(chr, range(0x80, 0x100))), high_half(charset))


#: Columns between tab stops.
TAB_STOP = 8


def text_view(data: Column | str, charset: str, show_all: bool = False) -> Column:
    """Bytes as the lines of a text view: CR, LF and both together end a line, a tab goes on to
    the next stop, other control characters are dots (or themselves with ``show_all``), and
    bytes from 80 on are characters of the set."""
    text = F.regexp_replace(text_of(data, charset), "\\r\\n?", "\n")
    if not show_all:
        text = F.regexp_replace(text, "[\\x00-\\x08\\x0B-\\x1F\\x7F]", ".")

    def step(line: Column, cell: Column) -> Column:
        # A cell is what stands between tabs; all but the last are filled up to the next stop.
        return F.concat(line, F.rpad(cell, F.char_length(cell) + TAB_STOP - (F.char_length(line) + F.char_length(cell)) % TAB_STOP, " "))

    def spread(line: Column) -> Column:
        cells = F.split(line, "\t", -1)
        filled = F.aggregate(F.slice(cells, 1, F.size(cells) - 1), F.lit(""), step)
        return F.concat(filled, F.element_at(cells, -1))

    return F.array_join(F.transform(F.split(text, "\n", -1), spread), "\n")


def control_effects(name: Column | str) -> Column:
    """(code, effect) of the distinct control characters of a name, ascending."""
    codes = F.array_sort(F.array_distinct(F.transform(F.filter(F.split(col(name), "", -1), lambda c: c.rlike("^[\\x00-\\x1F\\x7F]$")), lambda c: F.ascii(c))))
    effects = F.create_map(*(F.lit(v) for pair in CONTROL_EFFECTS.items() for v in pair))
    return F.transform(codes, lambda c: F.struct(c.alias("code"), F.try_element_at(effects, c).alias("effect")))
