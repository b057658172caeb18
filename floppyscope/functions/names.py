"""Names and paths: extensions, globs, host-safe and display forms, listings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from floppyscope.functions.binary import col

LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
#: Characters that a host file system may refuse.
RESERVED = '/\\:*?"<>|'
SIZE_UNITS = ("B", "kB", "MB", "GB", "TB", "PB")


def ascii_upper(text: Column | str) -> Column:
    return F.translate(col(text), LOWER, UPPER)


def ascii_lower(text: Column | str) -> Column:
    return F.translate(col(text), UPPER, LOWER)


def last_part(path: Column | str) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(col(path), r"[^/\\]*$", 0)


def extension(path: Column | str, need_stem: bool = False) -> Column:
    """The lower-case extension of the last part; null without a dot, or empty. With
    ``need_stem`` a name that starts with its only dot has none."""
    last = last_part(path)
    ext = ascii_lower(F.substring_index(last, ".", -1))
    stem = F.char_length(last) - F.char_length(ext) - 1
    has = (F.instr(last, ".") > 0) & (ext != "")
    return F.when(has & (stem > 0) if need_stem else has, ext)


def parent(path: Column | str) -> Column:
    """The path without its last part; empty at the root."""
    return F.regexp_replace(col(path), r"/?[^/]*$", "")


def stem(path: Column | str) -> Column:
    """The last part up to its first dot."""
    return F.substring_index(last_part(path), ".", 1)


def ancestors(path: Column | str) -> Column:
    """All leading parts of a path, itself included: a, a/b, a/b/c."""
    parts = F.split(col(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def glob_regex(pattern: str) -> str:
    """A regular expression for a whole name: * any run, ? and % one character, ASCII case ignored."""
    parts = {"*": ".*", "?": ".", "%": "."}
    return "(?is)^" + "".join(parts.get(c, re.escape(c)) for c in pattern) + "$"


def glob_match(name: Column | str, pattern: str) -> Column:
    return col(name).rlike(glob_regex(pattern))


def control_safe(text: Column | str) -> Column:
    """Control characters as their pictures: 00 to 1F as U+2400 on, 7F as U+2421."""
    codes = [*range(32), 127]
    return F.translate(col(text), "".join(map(chr, codes)), "".join(chr(0x2421 if c == 127 else 0x2400 + c) for c in codes))


def safe_component(text: Column | str) -> Column:
    """A control-safe name without characters that hosts reserve."""
    return F.translate(control_safe(text), RESERVED, "_" * len(RESERVED))


def short_name(name: Column | str, allowed: str = "A-Z0-9_") -> Column:
    """The 8.3 form: upper case, allowed characters only, FILE where the stem is empty."""
    upper = ascii_upper(name)
    dotted = F.instr(upper, ".") > 0
    keep = lambda c: F.regexp_replace(c, f"[^{allowed}]", "")
    ext = F.when(dotted, F.substring(keep(F.substring_index(upper, ".", -1)), 1, 3)).otherwise("")
    whole = F.when(dotted, F.regexp_replace(upper, r"\.[^.]*$", "")).otherwise(upper)
    base = F.substring(keep(whole), 1, 8)
    base = F.when(base == "", "FILE").otherwise(base)
    return F.when(ext == "", base).otherwise(F.concat_ws(".", base, ext))


def truncate(text: Column | str, limit: int) -> Column:
    """At most ``limit`` characters, the last an ellipsis where text was cut."""
    text = col(text)
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def attribute_flags(bits: Column) -> Column:
    """drhsa: directory (10), read-only (01), hidden (02), system (04), archive (20); - where unset."""
    marks = (("d", 0x10), ("r", 0x01), ("h", 0x02), ("s", 0x04), ("a", 0x20))
    return F.concat(*(F.when(bits.bitwiseAND(v) != 0, m).otherwise("-") for m, v in marks))


def human_size(size: Column | str) -> Column:
    """A size in units of a thousand, two decimals above bytes."""
    n = col(size).cast("double")
    out = F.concat(col(size).cast("string"), F.lit(" B"))
    for power, unit in enumerate(SIZE_UNITS[1:], 1):
        out = F.when(n >= 10.0 ** (3 * power), F.concat(F.replace(F.format_number(n / 10.0 ** (3 * power), 2), F.lit(",")), F.lit(f" {unit}"))).otherwise(out)
    return out


def version_parts(text: Column | str) -> Column:
    """(major, minor, patch) of a version; null unless there are exactly three numbers.
    A leading v and a suffix after - or + are left out."""
    core = F.regexp_extract(F.trim(col(text)), r"^[vV]?([0-9]{1,9}\.[0-9]{1,9}\.[0-9]{1,9})(?:[-+].*)?$", 1)
    part = lambda k: F.split_part(core, F.lit("."), F.lit(k)).cast("long")
    return F.when(core != "", F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def is_newer(candidate: Column | str, current: Column | str) -> Column:
    """Whether a version follows another; false where either can't be read."""
    return F.coalesce(version_parts(candidate) > version_parts(current), F.lit(False))
