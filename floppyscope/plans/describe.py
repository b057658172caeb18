"""What is known about a file: its extension's description, program header, picture size and music header."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floppyscope.functions import content, music, names, pictures
from floppyscope.plans.media import DESCRIPTIONS


def describe_files(files: DataFrame) -> DataFrame:
    """(name, description, view, header, width, height, format, title) of ``files`` (name,
    content), a row per name; names must be distinct."""
    words = files.sparkSession.createDataFrame(sorted(DESCRIPTIONS.items()), "ext string, description string")
    plain = files.select("name", "content", names.extension("name").alias("ext"), content.view_of("name", F.col("content")).alias("view"), content.bload_header("content").alias("header"))
    plain = plain.join(F.broadcast(words), "ext", "left")  # a dimension of its own
    shown = plain.where(F.col("ext").isin(sorted(pictures.BY_EXTENSION))).select("name", "content", F.lit(None).cast("map<string,binary>").alias("companions"))
    sizes = pictures.picture_table(shown).where("error IS NULL").select("name", "width", "height")
    tunes = music.music_table(plain.where(F.col("ext").isin(sorted(music.BY_EXTENSION)))).select("name", "format", "title")
    return plain.join(sizes, "name", "left").join(tunes, "name", "left").select("name", "description", "view", "header", "width", "height", "format", "title")
