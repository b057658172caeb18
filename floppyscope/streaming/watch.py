"""Streams: a watched folder of images, and journals and key presses that arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floppyscope.plans import media
from floppyscope.sources import containers

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch_images(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """The image table of files as they appear in a folder."""
    stream = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return containers.decode_images(stream)


def watch_volumes(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    return media.volumes(watch_images(spark, folder, glob))


def latest_records(journal: DataFrame, key: str, time: str, order: str, value: str, late: str) -> DataFrame:
    """The last value of each key in every day of event time; records more than ``late`` behind are dropped."""
    day = F.window(time, "1 day")
    return journal.withWatermark(time, late).groupBy(day.alias("day"), key).agg(F.max_by(value, F.struct(time, order)).alias(value))


def typed_prefixes(keys: DataFrame, user: str, time: str, letter: str, pause: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """What each user typed between pauses."""
    session = F.session_window(time, pause)
    typed = F.array_sort(F.collect_list(F.struct(time, letter)))
    return keys.withWatermark(time, late).groupBy(user, session.alias("session")).agg(F.array_join(F.transform(typed, lambda k: k[letter]), "").alias("prefix"))
