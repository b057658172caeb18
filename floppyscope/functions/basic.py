"""Listings of tokenised MSX-BASIC programs."""

from __future__ import annotations

from collections.abc import Callable

# The keywords of the token bytes 81 to FC, and of 81 to B0 after FF.
KEYWORDS = (
    "END FOR NEXT DATA INPUT DIM READ LET GOTO RUN IF RESTORE GOSUB RETURN REM STOP PRINT CLEAR LIST NEW ON WAIT DEF POKE CONT CSAVE CLOAD OUT LPRINT LLIST CLS WIDTH "
    "ELSE TRON TROFF SWAP ERASE ERROR RESUME DELETE AUTO RENUM DEFSTR DEFINT DEFSNG DEFDBL LINE OPEN FIELD GET PUT CLOSE LOAD MERGE FILES LSET RSET SAVE LFILES CIRCLE COLOR DRAW PAINT BEEP PLAY "
    "PSET PRESET SOUND SCREEN VPOKE SPRITE VDP BASE CALL TIME KEY MAX MOTOR BLOAD BSAVE DSKO$ SET NAME KILL IPL COPY CMD LOCATE TO THEN TAB( STEP USR FN SPC( NOT ERL ERR STRING$ USING INSTR ' "
    "VARPTR CSRLIN ATTR$ DSKI$ OFF INKEY$ POINT > = < + - * / ^ AND OR XOR EQV IMP MOD \\"
).split()
FUNCTIONS = (
    "LEFT$ RIGHT$ MID$ SGN INT ABS SQR RND SIN LOG EXP COS TAN ATN FRE INP POS LEN STR$ VAL ASC CHR$ PEEK VPEEK SPACE$ OCT$ HEX$ LPOS BIN$ CINT CSNG CDBL FIX STICK STRIG PDL PAD DSKF FPOS CVI CVS CVD "
    "EOF LOC LOF MKI$ MKS$ MKD$"
).split()
SINGLE = {0x81 + k: w for k, w in enumerate(KEYWORDS)}
DOUBLE = {0x81 + k: w for k, w in enumerate(FUNCTIONS)}


def real(raw: bytes) -> str:
    """A decimal floating-point literal: an exponent byte and packed digits."""
    mark, power = ("!", "E") if len(raw) == 4 else ("#", "D")
    if not any(raw):
        return "0" + mark
    digits = "".join(f"{min(b >> 4, 9)}{min(b & 15, 9)}" for b in raw[1:])
    exponent = (raw[0] & 0x7F) - 0x40
    sign = "-" if raw[0] & 0x80 else ""
    if exponent > 14 or exponent <= -2:
        rest = digits[1:].rstrip("0")
        return f"{sign}{digits[0]}{'.' + rest if rest else ''}{power}{exponent - 1:+d}"
    whole = digits[: max(exponent, 0)].ljust(max(exponent, 0), "0").lstrip("0")
    part = ("0" * max(-exponent, 0) + digits[max(exponent, 0) :]).rstrip("0")
    return sign + (whole + ("." + part if part else "") or "0") + mark


def lines(data: bytes, glyph: Callable[[int], str] = chr) -> list[tuple[int, str]]:
    """(line number, text) of a tokenised program; empty if it isn't one. ``glyph`` gives the
    character of a byte in strings, remarks and data."""
    if data[:1] != b"\xff":
        return []
    out, at = [], 1
    while at + 4 <= len(data) and data[at : at + 2] != b"\0\0":
        number = int.from_bytes(data[at + 2 : at + 4], "little")
        text, at = _line(data, at + 4, glyph)
        out.append((number, text))
    return out


def _line(data: bytes, at: int, glyph: Callable[[int], str]) -> tuple[str, int]:
    out: list[str] = []
    end = len(data)

    def word(k: int, n: int = 2) -> int:
        return int.from_bytes(data[k : k + n], "little")

    def literal(at: int, stop: Callable[[int, bool], bool]) -> int:
        """Bytes as they are, up to the end of the line or where ``stop`` says so."""
        quoted = False
        while at < end and data[at] and not stop(data[at], quoted):
            quoted ^= data[at] == 0x22
            out.append(glyph(data[at]))
            at += 1
        return at

    while at < end:
        b = data[at]
        at += 1
        if b == 0:
            break
        if b in (0x0B, 0x0C):
            out.append(f"&O{word(at):o}" if b == 0x0B else f"&H{word(at):X}")
            at += 2
        elif b in (0x0D, 0x0E, 0x1C):
            out.append(str(word(at)))
            at += 2
        elif b == 0x0F:
            out.append(str(word(at, 1)))
            at += 1
        elif 0x11 <= b <= 0x1A:
            out.append(str(b - 0x11))
        elif b in (0x1D, 0x1F):
            n = 4 if b == 0x1D else 8
            if at + n > end:
                return "".join(out), end
            out.append(real(data[at : at + n]))
            at += n
        elif b == 0x22:
            out.append('"')
            at = literal(at, lambda c, q: c == 0x22)
            if at < end and data[at] == 0x22:
                out.append('"')
                at += 1
        elif b == 0x3A and data[at : at + 1] == b"\xa1":
            out.append("ELSE")
            at += 1
        elif b == 0x3A and data[at : at + 2] == b"\x8f\xe6":
            out.append("'")
            at = literal(at + 2, lambda c, q: False)
        elif b == 0x8F:
            out.append("REM")
            at = literal(at, lambda c, q: False)
        elif b == 0x84:
            out.append("DATA")
            at = literal(at, lambda c, q: c == 0x3A and not q)
        elif b == 0xFF:
            out.append(DOUBLE.get(word(at, 1)) or glyph(word(at, 1)))
            at += 1
        elif b in SINGLE:
            out.append(SINGLE[b])
        else:
            out.append(glyph(b) if b >= 0x80 else chr(b))
    return "".join(out), at


def listing(data: bytes, glyph: Callable[[int], str] = chr) -> str:
    """The listing of a program; a file without the token mark is shown as text."""
    if data[:1] != b"\xff":
        text = "".join(glyph(b) if b >= 0x80 else chr(b) for b in data.split(b"\x1a")[0])
        return text.replace("\r\n", "\n").replace("\r", "\n")
    return "".join(f"{n} {t}\n" for n, t in lines(data, glyph))
