"""Reading numbers out of BINARY columns, and checksums over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def byte_at(data: Column | str, offset: Column | int) -> Column:
    """The unsigned byte at ``offset`` (from 0); null past the end."""
    return F.conv(F.nullif(F.hex(F.substring(col(data), offset + F.lit(1), F.lit(1))), F.lit("")), 16, 10).cast("int")


def u16le(data: Column | str, offset: Column | int) -> Column:
    return byte_at(data, offset) + byte_at(data, offset + F.lit(1)) * 256


def u24le(data: Column | str, offset: Column | int) -> Column:
    return u16le(data, offset) + byte_at(data, offset + F.lit(2)) * 65536


def u32le(data: Column | str, offset: Column | int) -> Column:
    return u16le(data, offset).cast("long") + u16le(data, offset + F.lit(2)).cast("long") * 65536


def u16be(data: Column | str, offset: Column | int) -> Column:
    return byte_at(data, offset) * 256 + byte_at(data, offset + F.lit(1))


def signed(value: Column, bits: int) -> Column:
    """An unsigned number of ``bits`` bits read as two's complement."""
    return F.when(value >= 1 << bits - 1, value - (1 << bits)).otherwise(value)


def bytes_of(data: Column | str) -> Column:
    """All bytes as an array of integers; empty for empty input."""
    text = F.decode(col(data), "ISO-8859-1")
    return F.when(F.char_length(text) > 0, F.transform(F.split(text, "", -1), lambda c: F.ascii(c))).otherwise(F.array().cast("array<int>"))


def inspect(data: Column | str) -> dict[str, Column]:
    """What the first bytes read as: the numbers that fit, others null."""
    n = F.length(col(data))
    u8, u16, u24, u32 = byte_at(data, 0), u16le(data, 0), u24le(data, 0), u32le(data, 0)
    return {
        "u8": u8,
        "i8": signed(u8, 8),
        "hex": F.lpad(F.hex(u8.cast("long")), 2, "0"),
        "bits": F.lpad(F.bin(u8.cast("long")), 8, "0"),
        "u16": F.when(n >= 2, u16),
        "i16": F.when(n >= 2, signed(u16, 16)),
        "u24": F.when(n >= 3, u24),
        "u32": F.when(n >= 4, u32),
    }


def crc32_hex(data: Column | str) -> Column:
    """IEEE CRC-32 as eight upper-case hex digits."""
    return F.lpad(F.hex(F.crc32(col(data))), 8, "0")


def sha1_hex(data: Column | str) -> Column:
    return F.sha1(col(data))


def crc16_arc(data: Column | str) -> Column:
    """Reflected CRC-16, polynomial A001, from 0."""

    def bit(crc: Column, _: Column) -> Column:
        half = F.shiftright(crc, 1)
        return F.when(crc.bitwiseAND(1) == 1, half.bitwiseXOR(0xA001)).otherwise(half)

    return F.aggregate(bytes_of(data), F.lit(0), lambda crc, b: F.aggregate(F.sequence(F.lit(1), F.lit(8)), crc.bitwiseXOR(b), bit))


def crc16_ccitt(data: Column | str, start: int = 0xFFFF) -> Column:
    """CRC-16 with the highest bit first, polynomial 1021."""

    def bit(crc: Column, _: Column) -> Column:
        twice = F.shiftleft(crc, 1).bitwiseAND(0xFFFF)
        return F.when(crc.bitwiseAND(0x8000) != 0, twice.bitwiseXOR(0x1021)).otherwise(twice)

    return F.aggregate(bytes_of(data), F.lit(start), lambda crc, b: F.aggregate(F.sequence(F.lit(1), F.lit(8)), crc.bitwiseXOR(F.shiftleft(b, 8)), bit))


def masked_write(register: Column, mask: Column, value: Column) -> Column:
    """A register after a write that touches the bits of ``mask`` only."""
    return register.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(value.bitwiseAND(mask))
