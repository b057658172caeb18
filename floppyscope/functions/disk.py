"""Disk arithmetic: geometry, boot sectors, allocation tables, packed dates, directory slots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from floppyscope.functions.binary import byte_at, col, u16le, u32le

SECTOR = 512
SIZE_360K = 368_640
SIZE_720K = 737_280


def chs_of_lba(lba: Column, spt: Column | int, sides: Column | int) -> dict[str, Column]:
    """Track, head and sector of a linear sector; a zero geometry counts as one."""
    spt, sides = F.greatest(F.lit(spt), F.lit(1)), F.greatest(F.lit(sides), F.lit(1))
    return {"track": F.floor(lba / (spt * sides)).cast("int"), "head": (F.floor(lba / spt) % sides).cast("int"), "sector": (lba % spt).cast("int")}


def locate_offset(offset: Column) -> dict[str, Column]:
    return {"sector": F.floor(offset / SECTOR).cast("long"), "inner": (offset % SECTOR).cast("long")}


def geometry(length: Column) -> Column:
    """Sides, tracks and sectors per track that a raw length stands for; null if it isn't whole sectors."""
    total = F.floor(length / SECTOR)
    sides = F.when(length == SIZE_360K, 1).when(length == SIZE_720K, 2).otherwise(F.when(total >= 1440, 2).otherwise(1))
    tracks = F.ceil(F.ceil(total / sides) / 9)
    return F.when((length > 0) & (length % SECTOR == 0), F.struct(sides.cast("int").alias("sides"), tracks.cast("int").alias("tracks"), F.lit(9).alias("spt")))


def boot_record(data: Column | str) -> Column:
    """The layout fields of a boot sector; null if they can't be one."""
    fields = F.struct(
        u16le(data, 11).alias("bytes_per_sector"), byte_at(data, 13).alias("spc"), u16le(data, 14).alias("reserved"), byte_at(data, 16).alias("fats"),
        u16le(data, 17).alias("root_entries"), u16le(data, 19).alias("total16"), byte_at(data, 21).alias("media"), u16le(data, 22).alias("spf"),
        u16le(data, 24).alias("spt"), u16le(data, 26).alias("heads"),
    )
    return F.when((fields["bytes_per_sector"] == SECTOR) & (fields["spc"] > 0) & (fields["fats"] > 0) & (fields["spf"] > 0), fields)


def layout(record: Column, total_sectors: Column) -> dict[str, Column]:
    """First sectors of the areas, clusters, and the width of table entries."""
    fat_start = record["reserved"]
    root_start = fat_start + record["fats"] * record["spf"]
    data_start = root_start + F.ceil(record["root_entries"] * 32 / SECTOR).cast("int")
    clusters = F.greatest(F.floor((total_sectors - data_start) / record["spc"]).cast("int"), F.lit(0))
    wide = (clusters >= 4085) & ((clusters + 2) * 2 <= record["spf"] * SECTOR)
    return {"fat_start": fat_start, "root_start": root_start, "data_start": data_start, "clusters": clusters, "fat_type": F.when(wide, "FAT16").otherwise("FAT12")}


def fat12_entry(table: Column | str, cluster: Column) -> Column:
    """The 12-bit entry of a cluster: three bytes hold two."""
    at = F.floor(cluster * 3 / 2).cast("int")
    pair = u16le(table, at)
    return F.coalesce(F.when(cluster % 2 == 1, F.shiftright(pair, 4)).otherwise(pair.bitwiseAND(0xFFF)), F.lit(0xFFF))


def fat16_entry(table: Column | str, cluster: Column) -> Column:
    return F.coalesce(u16le(table, cluster * 2), F.lit(0xFFFF))


def pointer_kind(fat_type: Column | str, entry: Column | str, clusters: Column) -> Column:
    """What a table entry says: Free, Next, OutOfRange, Reserved, Bad or End (1 is End, too)."""
    fat_type, entry = col(fat_type), col(entry)
    low = F.when(fat_type == "FAT16", 0xFFF0).otherwise(0xFF0)
    return (
        F.when(entry == 0, "Free")
        .when((entry >= 2) & (entry < low), F.when(entry < clusters + 2, "Next").otherwise("OutOfRange"))
        .when((entry >= low) & (entry <= low + 6), "Reserved")
        .when(entry == low + 7, "Bad")
        .otherwise("End")
    )


def sector_kind(lba: Column, fat_start: Column | int, root_start: Column | int, data_start: Column | int) -> Column:
    return F.when(lba < fat_start, "Reserved").when(lba < root_start, "Fat").when(lba < data_start, "RootDir").otherwise("Data")


def dos_date(date: Column) -> dict[str, Column]:
    return {"year": F.shiftright(date, 9) + 1980, "month": F.shiftright(date, 5).bitwiseAND(15), "day": date.bitwiseAND(31)}


def dos_time(time: Column) -> dict[str, Column]:
    return {"hour": F.shiftright(time, 11), "minute": F.shiftright(time, 5).bitwiseAND(63)}


def pack_dos(ts: Column) -> dict[str, Column]:
    """The packed date and time words of a timestamp; seconds are dropped."""
    date = F.shiftleft(F.year(ts) - 1980, 9).bitwiseOR(F.shiftleft(F.month(ts), 5)).bitwiseOR(F.dayofmonth(ts))
    return {"date": date, "time": F.shiftleft(F.hour(ts), 11).bitwiseOR(F.shiftleft(F.minute(ts), 5))}


def unpack_dos(date: Column, time: Column) -> Column:
    """The timestamp of packed words, to the minute; null up to 1980 and for impossible dates."""
    d, t = dos_date(date), dos_time(time)
    made = F.try_make_timestamp_ntz(d["year"], d["month"], d["day"], t["hour"], t["minute"], F.lit(0)) if hasattr(F, "try_make_timestamp_ntz") else F.try_make_timestamp(d["year"], d["month"], d["day"], t["hour"], t["minute"], F.lit(0)).cast("timestamp_ntz")
    return F.when(d["year"] > 1980, made)


def reject_reason(attributes: Column, first_cluster: Column, size: Column, clusters: Column, cluster_bytes: Column | int) -> Column:
    """Why a root directory slot can't be an entry: the first that holds of attribute, cluster, size."""
    return (
        F.when(attributes.bitwiseAND(0xC0) != 0, "attribute")
        .when((first_cluster == 1) | (first_cluster > clusters + 1), "cluster")
        .when(size > clusters.cast("long") * cluster_bytes, "size")
    )


def partition_entries(data: Column | str) -> Column:
    """The four slots of a partition table: index, type, first sector and count of sectors."""
    slot = lambda k: F.struct(F.lit(k).alias("slot"), byte_at(data, 0x1BE + 16 * k + 4).alias("type"), u32le(data, 0x1BE + 16 * k + 8).alias("lba"), u32le(data, 0x1BE + 16 * k + 12).alias("sectors"))
    return F.array(*map(slot, range(4)))


def expand_rgb333(rgb: Column) -> Column:
    """0x00RRGGBB of nine bits GGGRRRBBB-style triples given as 0b0rrr_0ggg_0bbb packed in octal digits."""
    out = F.lit(0)
    for shift_in, shift_out in ((6, 16), (3, 8), (0, 0)):
        v = F.shiftright(rgb, shift_in).bitwiseAND(7)
        wide = F.shiftleft(v, 5).bitwiseOR(F.shiftleft(v, 2)).bitwiseOR(F.shiftright(v, 1))
        out = out.bitwiseOR(F.shiftleft(wide, shift_out))
    return out


def yjk_rgb(y: Column, j: Column, k: Column) -> dict[str, Column]:
    """Red, green and blue of 0 to 31 from brightness and two signed chroma values."""
    clamp = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(31))
    return {"r": clamp(y + j), "g": clamp(y + k), "b": clamp(F.shiftright(y * 5 - j * 2 - k + 2, 2))}
