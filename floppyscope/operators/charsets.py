"""Guessing a character set from the distribution of bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def detect_by(df: DataFrame, key: str, data: str) -> DataFrame:
    """Counts of high bytes, of A1 to DF and of E0 on by ``key``, and the verdict: Japanese from
    two kana on, if three fifths of the high bytes are kana or hiragana.

    Bytes are counted within each row first, so rows and not bytes are shuffled.
    """
    # Characters that translate drops are what the text loses in length: no regular expression runs.
    text = F.decode(data, "ISO-8859-1")
    count = lambda a, b: (F.char_length(text) - F.char_length(F.translate(text, "".join(map(chr, range(a, b + 1))), ""))).cast("long")
    rows = df.select(key, count(0x80, 0xFF).alias("h"), count(0xA1, 0xDF).alias("k"), count(0xE0, 0xFF).alias("r"))
    sums = rows.groupBy(key).agg(F.sum("h").alias("high"), F.sum("k").alias("kana"), F.sum("r").alias("hira"))
    japanese = (F.col("kana") >= 2) & (5 * (F.col("kana") + F.col("hira")) >= 3 * F.col("high"))
    return sums.withColumn("verdict", F.when(japanese, "Japanese").otherwise("International"))
