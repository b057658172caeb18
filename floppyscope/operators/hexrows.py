"""Hex dumps as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hex_rows(df: DataFrame, key: str, data: str, width: int, base: int = 0, decimal: bool = False, group: int = 1) -> DataFrame:
    """A row for every ``width`` bytes: address, hex by groups, and printable characters padded to the width."""
    spread = df.where(F.length(data) > 0).select(key, data, F.explode(F.sequence(F.lit(0), F.length(data) - 1, F.lit(width))).alias("offset"))
    part = F.substring(F.col(data), F.col("offset") + 1, F.lit(width))
    digits = F.hex(part)
    groups = F.transform(F.sequence(F.lit(1), F.char_length(digits), F.lit(2 * group)), lambda i: F.substring(digits, i, F.lit(2 * group)))
    shown = F.regexp_replace(F.decode(part, "ISO-8859-1"), r"[^\x20-\x7E]", ".")
    address = F.col("offset") + base
    place = F.lpad(address.cast("string"), 6, "0") if decimal else F.lpad(F.hex(address.cast("long")), 6, "0")
    return spread.select(key, "offset", place.alias("address"), F.array_join(groups, " ").alias("bytes"), F.rpad(shown, width, " ").alias("shown"))
