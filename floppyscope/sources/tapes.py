"""Cassette images: blocks of both container formats, and the files they hold."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floppyscope.functions.content import cas_header
from floppyscope.functions.names import extension

SYNC = bytes.fromhex("1FA6DEBACC137D74")
TSX_MAGIC = b"ZXTape!\x1a"
# Names of the fields of an archive-info block.
INFO = {0: "Title", 1: "Publisher", 2: "Author", 3: "Year", 4: "Language", 5: "Type", 6: "Price", 7: "Protection", 8: "Origin", 0xFF: "Comment"}
# Where a block of each kind says how long it is: (offset of the length, its bytes,
# what a unit is, bytes before the counted ones). None: the block has a fixed length.
LENGTHS = {
    0x10: (2, 2, 1, 4), 0x11: (15, 3, 1, 18), 0x12: (None, 0, 0, 4), 0x13: (0, 1, 2, 1), 0x14: (7, 3, 1, 10), 0x15: (5, 3, 1, 8), 0x18: (0, 4, 1, 4), 0x19: (0, 4, 1, 4),
    0x20: (None, 0, 0, 2), 0x21: (0, 1, 1, 1), 0x22: (None, 0, 0, 0), 0x23: (None, 0, 0, 2), 0x24: (None, 0, 0, 2), 0x25: (None, 0, 0, 0), 0x26: (0, 2, 2, 2), 0x27: (None, 0, 0, 0),
    0x28: (0, 2, 1, 2), 0x2A: (None, 0, 0, 4), 0x2B: (0, 4, 1, 4), 0x30: (0, 1, 1, 1), 0x31: (1, 1, 1, 2), 0x32: (0, 2, 1, 2), 0x33: (0, 1, 3, 1), 0x35: (16, 4, 1, 20), 0x4B: (0, 4, 1, 4), 0x5A: (None, 0, 0, 9),
}


def tsx_blocks(data: bytes) -> Iterator[dict]:
    """Blocks in order; an unknown kind or a cut-off block ends the walk."""
    if data[:8] != TSX_MAGIC:
        return
    at = 10
    while at < len(data) and data[at] in LENGTHS:
        kind, body = data[at], at + 1
        place, width, unit, head = LENGTHS[kind]
        length = head + (unit * int.from_bytes(data[body + place : body + place + width], "little") if place is not None else 0)
        if body + length > len(data):
            return
        raw = data[body : body + length]
        block = {"block_type": "other", "id": f"{kind:02X}", "text": None, "info": [], "data": None}
        if kind == 0x4B:
            block |= {"block_type": "data", "data": raw[16:]}  # the length and twelve bytes of timing
        elif kind == 0x35:
            block |= {"block_type": "custom", "text": raw[:16].decode("latin-1").strip(" \0"), "data": raw[20:]}
        elif kind == 0x32:
            block |= {"block_type": "info", "info": list(_info(raw[2:]))}
        yield block
        at = body + length


def _info(raw: bytes) -> Iterator[dict]:
    at = 1
    for _ in range(raw[0] if raw else 0):
        if at + 2 > len(raw):
            return
        n = raw[at + 1]
        yield {"k": INFO.get(raw[at], "Other"), "v": raw[at + 2 : at + 2 + n].decode("latin-1").strip(" \0\r\n")}
        at += 2 + n


BLOCKS = "image_id long, ord int, block_type string, id string, text string, info array<struct<k:string,v:string>>, data binary"


def cas_blocks(files: DataFrame) -> DataFrame:
    """Blocks of .cas files (path, content): what stands between sync marks, wherever they are."""
    text = F.decode("content", "ISO-8859-1")
    mark = "\\Q" + SYNC.decode("latin-1") + "\\E"
    blocks = files.select(F.xxhash64("path").alias("image_id"), F.posexplode(F.split(text, mark, -1)).alias("ord", "body")).where("ord > 0")
    none = F.array().cast("array<struct<k:string,v:string>>")
    return blocks.select("image_id", (F.col("ord") - 1).alias("ord"), F.lit("data").alias("block_type"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("text"), none.alias("info"), F.encode("body", "ISO-8859-1").alias("data"))


def tsx_table(files: DataFrame) -> DataFrame:
    fields = pa.schema([("image_id", pa.int64()), ("ord", pa.int32()), ("block_type", pa.string()), ("id", pa.string()), ("text", pa.string()), ("info", pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())]))), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_pylist([{"image_id": image_id, "ord": k, **b} for k, b in enumerate(tsx_blocks(content or b""))], fields)

    return files.select(F.xxhash64("path").alias("image_id"), "content").mapInArrow(run, BLOCKS)


def blocks(files: DataFrame) -> DataFrame:
    """Blocks of all cassette files (path, content), by extension."""
    ext = extension("path")
    return cas_blocks(files.where(ext == "cas")).unionByName(tsx_table(files.where(ext == "tsx")))


def tape_files(tape_blocks: DataFrame) -> DataFrame:
    """(image_id, file, kind, name, key, data): a header block opens a file, the data blocks up
    to the next header are its content; data before the first header is dropped."""
    data = tape_blocks.where("block_type = 'data'").withColumn("header", cas_header("data"))
    order = Window.partitionBy("image_id").orderBy("ord")
    number = F.sum(F.when(F.col("header").isNotNull(), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    parts = F.array_sort(F.collect_list(F.when(F.col("header").isNull(), F.struct("ord", "data"))))
    joined = F.aggregate(parts, F.unhex(F.lit("")), lambda out, p: F.concat(out, p["data"]))
    files = data.withColumn("file", number).where("file > 0").groupBy("image_id", "file").agg(F.max("header.kind").alias("kind"), F.max("header.name").alias("name"), joined.alias("data"))
    base = F.when(F.col("name") == "", "FILE").otherwise(F.col("name"))
    k = F.row_number().over(Window.partitionBy("image_id", base).orderBy("file")) - 1
    return files.withColumn("key", F.when(k == 0, base).otherwise(F.concat_ws(".", base, k)))
