"""Facts in the headers of music files: format, title, author, positions, channels, and what else a header tells."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def field(data: bytes, at: int, n: int) -> str | None:
    """A text field up to its first zero, blanks and controls cut off its end; None if empty or outside."""
    if at + n > len(data):
        return None
    text = data[at : at + n].split(b"\0")[0].decode("latin-1")
    return re.sub(r"[\x00-\x20]+$", "", text) or None


def _at(data: bytes, k: int) -> int | None:
    return data[k] if k < len(data) else None


def _facts(format: str, title: str | None = None, author: str | None = None, positions: int | None = None, channels: int | None = None, **extra) -> dict:
    told = [(k.replace("_", " ").capitalize(), str(v)) for k, v in extra.items() if v is not None]
    return {"format": format, "title": title, "author": author, "positions": positions, "channels": channels, "extra": told}


def moonblaster(data: bytes) -> dict | None:
    if len(data) < 247:
        return None
    edit, drums = data[0] == 0xFF, data[206] & 0x20
    voices = "9CH MSX-AUDIO + " + ("6CH MSX-MUSIC + percussion" if drums else "9CH MSX-MUSIC")
    return _facts("MoonBlaster 1.4", field(data, 207, 40), positions=None if edit else data[0], file="EDIT" if edit else "USER", voices=voices, sample_kit=field(data, 248, 8))


def moonsound_wave(data: bytes) -> dict | None:
    if data[:5] != b"MBMS\x10" or _at(data, 5) not in (7, 8):
        return None
    edit = data[5] == 7
    at = 226 if edit else 6
    rate = {None: None, 0: "60 Hz", 1: "50 Hz"}.get(_at(data, at + 27), f"custom ({_at(data, at + 27)})")
    return _facts("MoonBlaster for MoonSound Wave", field(data, at + 220, 50), positions=None if edit else _at(data, at), channels=24, file="EDIT" if edit else "USER", replay=rate, wave_kit=field(data, at + 270, 8))


def moonsound_fm(data: bytes) -> dict | None:
    kind = {1: "USER", 2: "EDIT", 0: "RAW"}.get(_at(data, 5)) if data[:5] == b"MBMS\x10" else None
    if kind is None:
        return None
    at = 6 if kind == "USER" else 226
    return _facts("MoonBlaster for MoonSound FM", field(data, at + 718, 50), positions=_at(data, at) if kind == "USER" else None, channels=6, file=kind)


def fac_soundtracker(data: bytes) -> dict | None:
    at = 7 + 0x3F00
    version = _at(data, at + 140)
    if version is None or version > 3:
        return None
    n = 35 if version == 3 else 40
    voices = "6CH MSX-MUSIC + percussion" if _at(data, at + 247) == 1 else "9CH MSX-AUDIO"
    return _facts("FAC SoundTracker " + ("1.0", "1.0", "2.0", "PRO")[version], field(data, at + 166, n), field(data, at + 207, n), voices=voices, tracks=_at(data, at + 248), sample_kit=field(data, at + 132, 8))


def pro_tracker(data: bytes) -> dict | None:
    return _facts("Pro-Tracker") if data[:4] == b"PT10" else None


def blaffer(data: bytes) -> dict | None:
    if data[:16] != b"Blaf NT Song    ":
        return None
    kit = ".".join(t for t in (field(data, 83, 8), field(data, 91, 3)) if t) or None
    last = _at(data, 94)
    return _facts("SCC Blaffer NT", field(data, 16, 67), positions=None if last is None else last + 1, channels=5, drums="PSG", instrument_kit=kit, tempo=_at(data, 353))


def musixx(data: bytes) -> dict | None:
    n = _at(data, 1920)
    return None if n is None else _facts("SCC-Musixx", positions=n if 1 <= n <= 100 else None, channels=5)


def pt3(data: bytes) -> dict | None:
    if not data.startswith((b"ProTracker", b"Vortex")):
        return None
    double = data[-16:-12] == b"PT3!" and data[-4:] == b"02TS"
    return _facts("ProTracker 3 / Vortex Tracker II", field(data, 0x1E, 32), field(data, 0x42, 32), channels=6 if double else 3)


def e_tracker(data: bytes) -> dict | None:
    sign = b"ETracker (C) BY ESI."
    at = next((at for at in (10, 0x4BD) if data[at : at + len(sign)] == sign), None)
    return None if at is None else _facts("E-Tracker compiled", channels=6, player_code="not present" if at == 10 else "included")


# Channels by the tag of a module.
TAGS = {"M.K.": 4, "M!K!": 4, "FLT4": 4, "4CHN": 4, "6CHN": 6, "8CHN": 8, "FLT8": 8, "CD81": 8, "OKTA": 8, "OCTA": 8}


def module(data: bytes) -> dict | None:
    tag = data[1080:1084].decode("latin-1")
    m = re.fullmatch(r"([0-9]{1,2})CHN?", tag)
    return _facts("Amiga module", field(data, 0, 20), channels=TAGS.get(tag) or (int(m[1]) if m else 4), samples=31)


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A number of seven bits a byte, four bytes at most."""
    value = 0
    for k in range(4):
        value = value << 7 | data[at + k] & 0x7F
        if data[at + k] < 0x80:
            return value, at + k + 1
    raise ValueError("number is too long")


def midi(data: bytes) -> dict | None:
    if data[:4] != b"MThd" or int.from_bytes(data[4:8], "big") != 6 or len(data) < 14 or int.from_bytes(data[8:10], "big") > 2:
        return None
    texts: dict[int, str] = {}
    at, end, status = 22, min(len(data), 22 + int.from_bytes(data[18:22], "big")), 0
    try:
        while at < end and data[14:18] == b"MTrk":
            _, at = _number(data, at)
            b = data[at]
            if b == 0xFF:
                kind = data[at + 1]
                n, at = _number(data, at + 2)
                if kind == 0x2F:
                    break
                texts.setdefault(kind, field(data, at, n) or "")
                at += n
            elif b in (0xF0, 0xF7):
                n, at = _number(data, at + 1)
                at += n
            else:
                if b >= 0x80:
                    status, at = b, at + 1
                at += 1 if status & 0xE0 == 0xC0 else 2
    except (ValueError, IndexError):
        pass  # a cut-off track tells what came before
    return _facts("Standard MIDI", texts.get(3) or texts.get(1) or None, tracks=int.from_bytes(data[10:12], "big"), copyright=texts.get(2) or None)


BY_EXTENSION = {
    "mbm": moonblaster, "mus": fac_soundtracker, "pro": pro_tracker, "mwm": moonsound_wave, "mfm": moonsound_fm, "mid": midi, "sbm": blaffer, "sng": musixx, "pt3": pt3, "mod": module,
    "etc": e_tracker, "cop": e_tracker, "saa": e_tracker,
}


def describe(name: str, data: bytes) -> dict | None:
    parse = BY_EXTENSION.get(name.rpartition(".")[2].lower()) if "." in name else None
    return parse(data) if parse else None


def music_table(files: DataFrame) -> DataFrame:
    """A row per music file of ``files`` (name, content) whose header can be read."""
    schema = "name string, format string, title string, author string, positions int, channels int, extra array<struct<k:string,v:string>>"
    fields = pa.schema([*((c, pa.string()) for c in ("name", "format", "title", "author")), ("positions", pa.int32()), ("channels", pa.int32()), ("extra", pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if found := describe(name or "", content or b""):
                    rows.append({"name": name, **found, "extra": [{"k": k, "v": v} for k, v in found["extra"]]})
            yield pa.RecordBatch.from_pylist(rows, fields)

    return files.select("name", "content").mapInArrow(run, schema)
