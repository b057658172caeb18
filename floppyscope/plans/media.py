"""The tables of disk images: images, volumes, table entries, directory entries, files, statistics.

An image or a volume is one row, and a volume is walked inside its row; so nothing is shuffled
until rows of different volumes are added up.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floppyscope.functions import binary, disk, names
from floppyscope.operators import relational as ops
from floppyscope.sources import containers, fatfs

#: Descriptions of common extensions; unknown ones stay without.
DESCRIPTIONS = {
    "asc": "BASIC program as text", "asm": "Assembler source", "bas": "BASIC program", "bat": "Batch file", "bin": "Binary program", "c": "C source", "cas": "Cassette image", "cmp": "DD-Graph picture",
    "com": "MSX-DOS command", "cop": "E-Tracker song", "cpm": "CP/M command", "dat": "Data", "ddi": "Disk image", "di1": "Disk image, first side", "di2": "Disk image, second side", "dmk": "Raw-track disk image",
    "doc": "Document", "dsk": "Disk image", "etc": "E-Tracker song", "fnt": "Font", "g9b": "GFX9000 picture", "ge5": "SCREEN 5 picture", "ge7": "SCREEN 7 picture", "ge8": "SCREEN 8 picture", "gl5": "SCREEN 5 shape",
    "gl6": "SCREEN 6 shape", "gl7": "SCREEN 7 shape", "gl8": "SCREEN 8 shape", "glb": "SCREEN 11 shape", "glc": "SCREEN 12 shape", "grp": "SCREEN 2 picture", "h": "C header", "hlp": "Help text", "img": "Disk image",
    "lha": "LHA archive", "lzh": "LHA archive", "lzs": "LArc archive", "mac": "Macro assembler source", "mag": "Maki-chan picture", "mbk": "MoonBlaster sample kit", "mbm": "MoonBlaster music", "me": "Read-me text",
    "mfm": "MoonSound FM music", "mid": "MIDI music", "mif": "Interchange picture", "mki": "Maki-chan picture", "mod": "Amiga module", "mus": "FAC SoundTracker music", "mwk": "MoonSound wave kit", "mwm": "MoonSound wave music",
    "pas": "Pascal source", "pct": "Dynamic Publisher page", "pi": "Yanagisawa picture", "pic": "SCREEN 8 picture", "pl5": "SCREEN 5 palette", "pl6": "SCREEN 6 palette", "pl7": "SCREEN 7 palette", "pma": "PMarc archive",
    "pro": "Pro-Tracker music", "pt3": "ProTracker 3 music", "rom": "Cartridge image", "s10": "SCREEN 10 picture", "s12": "SCREEN 12 picture", "saa": "E-Tracker song", "sav": "Disk changes", "sbm": "SCC Blaffer music",
    "sc2": "SCREEN 2 picture", "sc3": "SCREEN 3 picture", "sc4": "SCREEN 4 picture", "sc5": "SCREEN 5 picture", "sc6": "SCREEN 6 picture", "sc7": "SCREEN 7 picture", "sc8": "SCREEN 8 picture", "sca": "SCREEN 10 picture",
    "scc": "SCREEN 12 picture", "sng": "SCC-Musixx music", "sri": "Interlaced SCREEN 7 picture", "srs": "SCREEN 12 picture", "stp": "Dynamic Publisher stamp", "sys": "System file", "tsx": "Cassette image", "txt": "Text",
    "xsa": "Packed disk image", "zip": "Zip archive",
    "arc": "ARC archive", "arj": "ARJ archive", "bmp": "Bitmap picture", "btm": "MSX-DOS 2 batch file", "ds1": "Disk image, first side", "ds2": "Disk image, second side", "exe": "SymbOS program", "gen": "GEN80 assembler source",
    "gif": "GIF picture", "gz": "Gzip file", "inc": "Assembler include file", "ips": "Patch", "ish": "Binary as text", "jpg": "JPEG picture", "kss": "Music with its player", "ldr": "BASIC loader", "max": "Maki-chan picture",
    "mbs": "MoonBlaster sample", "mbv": "MoonBlaster voices", "mbw": "MoonBlaster wave music", "mdx": "X68000 music", "meg": "MegaAssembler source or image", "mgs": "MGSDRV music", "mp3": "MP3 sound", "opx": "OPLL music",
    "pac": "Cartridge memory", "prn": "Assembler listing", "s3m": "ScreamTracker module", "sc0": "SCREEN 0 picture", "sc1": "SCREEN 1 picture", "tsr": "Resident program", "vgm": "Logged music", "wav": "Sampled sound", "xm": "FastTracker module",
}

VOLUMES = (
    "image_id long, volume_id string, n int, kind string, name string, lba_start int, sector_count int, spc int, reserved int, fats int, root_entries int, spf int, "
    "fat_type string, clusters int, free_clusters int, label string, dos_version int, data binary"
)


def _per_row(df: DataFrame, schema: str, fields: list[tuple[str, pa.DataType]], of: Callable[..., Iterator[dict]]) -> DataFrame:
    """Rows of ``of`` for each row of ``df``, taken one at a time since a row may be an image."""
    arrow = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = list(of(*(c[k].as_py() for c in batch.columns)))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return df.mapInArrow(run, schema)


def volumes(images: DataFrame) -> DataFrame:
    """One row per volume that can be mounted; images with an error have none."""
    ints = ("n", "lba_start", "sector_count", "spc", "reserved", "fats", "root_entries", "spf", "clusters", "free_clusters", "dos_version")
    texts = ("volume_id", "kind", "name", "fat_type", "label")
    order = [c.split()[0] for c in VOLUMES.split(", ")]
    kinds = {"image_id": pa.int64(), "data": pa.binary(), **{c: pa.int32() for c in ints}, **{c: pa.string() for c in texts}}

    def of(image_id: int, data: bytes, members: list[dict] | None) -> Iterator[dict]:
        parts = [(m["name"], m["length"]) for m in members or []]
        for n, (name, kind, lba, count, v) in enumerate(fatfs.volumes(data, parts), 1):
            yield {
                "image_id": image_id, "volume_id": f"{image_id}/{n}", "n": n, "kind": kind, "name": name, "lba_start": lba, "sector_count": count, "spc": v.layout.spc, "reserved": v.layout.reserved,
                "fats": v.layout.fats, "root_entries": v.layout.roots, "spf": v.layout.spf, "fat_type": f"FAT{v.width}", "clusters": v.clusters, "free_clusters": v.free_clusters(), "label": v.label(),
                "dos_version": v.dos_version(), "data": v.data,
            }

    good = images.where("data IS NOT NULL").select("image_id", "data", "members")
    return _per_row(good, VOLUMES, [(c, kinds[c]) for c in order], of)


def _volume(kind: str, data: bytes) -> fatfs.Volume:
    return fatfs.Volume(data, "partition" if kind == "partition" else "floppy")


def entries(volumes: DataFrame, content: bool = False) -> DataFrame:
    """The directory entries of every volume in pre-order; with ``content`` the bytes of files, too."""
    schema = "volume_id string, path string, parent_path string, depth int, ord_path array<int>, name string, is_dir boolean, size long, first_cluster int, attributes int, date int, time int"
    fields = [("volume_id", pa.string()), ("path", pa.string()), ("parent_path", pa.string()), ("depth", pa.int32()), ("ord_path", pa.list_(pa.int32())), ("name", pa.string()), ("is_dir", pa.bool_()), ("size", pa.int64()), ("first_cluster", pa.int32()), ("attributes", pa.int32()), ("date", pa.int32()), ("time", pa.int32())]
    if content:
        schema, fields = schema + ", content binary", [*fields, ("content", pa.binary())]

    def of(volume_id: str, kind: str, data: bytes) -> Iterator[dict]:
        v = _volume(kind, data)
        for e in v.walk():
            row = {"volume_id": volume_id, "path": e.path, "parent_path": e.path.rpartition("/")[0], "depth": e.depth, "ord_path": list(e.order), "name": e.name, "is_dir": e.is_dir, "size": e.size, "first_cluster": e.first, "attributes": e.attributes, "date": e.date, "time": e.time}
            yield row | ({"content": None if e.is_dir else v.read(e)} if content else {})

    rows = _per_row(volumes.select("volume_id", "kind", "data"), schema, fields, of)
    stamped = rows.withColumn("modified", disk.unpack_dos(F.col("date"), F.col("time"))).withColumn("flags", names.attribute_flags(F.col("attributes")))
    return stamped.drop("date", "time")


def root_slots(volumes: DataFrame) -> DataFrame:
    """(volume_id, slot, name, reason): the live root slots of floppies and why any is no entry.
    A root whose slots are all rejected holds no file system."""
    fields = [("volume_id", pa.string()), ("slot", pa.int32()), ("name", pa.string()), ("reason", pa.string())]

    def of(volume_id: str, kind: str, data: bytes) -> Iterator[dict]:
        v = _volume(kind, data)
        for k, (_, raw) in enumerate(v._slots(None)):
            if raw[0] != 0xE5 and raw[11] != 0x0F and not raw[11] & 8:
                yield {"volume_id": volume_id, "slot": k, "name": fatfs.short_name(raw), "reason": v.reject_reason(raw)}

    return _per_row(volumes.where("kind <> 'partition'").select("volume_id", "kind", "data"), "volume_id string, slot int, name string, reason string", fields, of)


def charset_of(files: DataFrame) -> DataFrame:
    """(volume_id, high, kana, hira, verdict): the character set that a volume's names suggest."""
    from floppyscope.functions.charsets import bytes_of_name
    from floppyscope.operators.charsets import detect_by

    return detect_by(files.select("volume_id", bytes_of_name("name").alias("data")), "volume_id", "data")


def track_report(sectors: DataFrame) -> DataFrame:
    """A row per recorded track and side: sectors, size and density of the first, bad ones, and
    whether it is a standard track."""
    good = F.col("id_crc_ok") & F.col("data_crc_ok") & F.col("has_data")
    standard = (F.count("*") == 9) & F.bool_and(good & (F.col("size") == disk.SECTOR) & (F.col("density") == "MFM"))
    first = lambda c: F.min_by(c, "ord").alias(c)
    return sectors.groupBy("image_id", "track", "side").agg(F.count("*").alias("sectors"), first("size"), first("density"), F.count_if(~good).alias("bad"), standard.alias("standard"))


def table_entries(volumes: DataFrame) -> DataFrame:
    """(volume_id, cluster, entry, kind, next): every entry of the allocation tables, read from
    the volume's bytes by expressions."""
    table = F.substring(F.col("data"), F.col("reserved") * disk.SECTOR + 1, F.length("data"))
    spread = volumes.select("volume_id", "fat_type", "clusters", table.alias("table"), F.explode(F.sequence(F.lit(2), F.col("clusters") + 1)).alias("cluster"))
    entry = F.when(F.col("fat_type") == "FAT16", disk.fat16_entry("table", F.col("cluster"))).otherwise(disk.fat12_entry("table", F.col("cluster")))
    named = spread.select("volume_id", "cluster", entry.alias("entry"), "fat_type", "clusters")
    kind = disk.pointer_kind("fat_type", "entry", F.col("clusters"))
    return named.select("volume_id", "cluster", "entry", kind.alias("kind"), F.when(kind == "Next", F.col("entry")).alias("next"))


def sectors(images: DataFrame) -> DataFrame:
    """(image_id, lba, data) of every sector."""
    spread = images.where("data IS NOT NULL").select("image_id", "data", F.explode(F.sequence(F.lit(0), F.col("sector_count") - 1)).alias("lba"))
    return spread.select("image_id", "lba", F.substring(F.col("data"), F.col("lba") * disk.SECTOR + 1, F.lit(disk.SECTOR)).alias("data"))


def sector_map(volumes: DataFrame) -> DataFrame:
    """(volume_id, lba, kind) with data sectors told used from free by their cluster's entry."""
    root = F.col("reserved") + F.col("fats") * F.col("spf")
    data = root + F.ceil(F.col("root_entries") * 32 / disk.SECTOR).cast("int")
    spread = volumes.select("volume_id", "spc", "clusters", "reserved", root.alias("root"), data.alias("start"), F.explode(F.sequence(F.lit(0), F.col("sector_count") - 1)).alias("lba"))
    area = disk.sector_kind(F.col("lba"), F.col("reserved"), F.col("root"), F.col("start"))
    spread = spread.select("volume_id", "lba", area.alias("area"), F.when(area == "Data", F.floor((F.col("lba") - F.col("start")) / F.col("spc")).cast("int") + 2).alias("cluster"))
    used = table_entries(volumes).select("volume_id", "cluster", (F.col("entry") != 0).alias("used"))
    kind = F.when(F.col("area") != "Data", F.col("area")).when(F.col("used"), "Used").otherwise("Free")
    return spread.join(used, ["volume_id", "cluster"], "left").select("volume_id", "lba", kind.alias("kind"))


def integrity(volumes: DataFrame) -> DataFrame:
    """Lost and cross-linked clusters, pointers out of range, the share of fragmented files and
    the verdict, a row per volume."""
    schema = "volume_id string, lost array<int>, cross_linked array<int>, bad_pointers array<struct<cluster:int,entry:int>>, fragmented_percent double, clean boolean"
    pointer = pa.struct([("cluster", pa.int32()), ("entry", pa.int32())])
    fields = [("volume_id", pa.string()), ("lost", pa.list_(pa.int32())), ("cross_linked", pa.list_(pa.int32())), ("bad_pointers", pa.list_(pointer)), ("fragmented_percent", pa.float64()), ("clean", pa.bool_())]

    def of(volume_id: str, kind: str, data: bytes) -> Iterator[dict]:
        found = _volume(kind, data).integrity()
        clean = not (found["lost"] or found["cross_linked"] or found["bad_pointers"])
        yield {"volume_id": volume_id, **found, "bad_pointers": [{"cluster": a, "entry": b} for a, b in found["bad_pointers"]], "clean": clean}

    return _per_row(volumes.select("volume_id", "kind", "data"), schema, fields, of)


def extensions(files: DataFrame) -> DataFrame:
    """Per volume and extension: description, files and bytes, most bytes first."""
    spark = files.sparkSession
    words = spark.createDataFrame(sorted(DESCRIPTIONS.items()), "ext string, description string")
    rows = files.where("NOT is_dir").select("volume_id", F.coalesce(names.extension("name"), F.lit("")).alias("ext"), "size")
    sums = rows.groupBy("volume_id", "ext").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return sums.join(F.broadcast(words), "ext", "left").select("volume_id", "ext", "description", "files", "bytes")


def statistics(volumes: DataFrame, files: DataFrame) -> DataFrame:
    """A row per volume: sizes, counts and the verdict. ``used`` counts bad clusters, too."""
    cluster = F.col("spc") * disk.SECTOR
    sums = files.groupBy("volume_id").agg(F.count_if(~F.col("is_dir")).alias("file_count"), F.count_if(F.col("is_dir")).alias("dir_count"), F.sum(F.when(~F.col("is_dir"), F.col("size"))).alias("file_bytes"))
    sizes = volumes.select(
        "volume_id", "label", "dos_version", (F.col("sector_count").cast("long") * disk.SECTOR).alias("total_bytes"),
        ((F.col("clusters") - F.col("free_clusters")).cast("long") * cluster).alias("used_bytes"), (F.col("free_clusters").cast("long") * cluster).alias("free_bytes"),
    )
    out = sizes.join(sums, "volume_id", "left").join(integrity(volumes).select("volume_id", "fragmented_percent", "clean"), "volume_id")
    return out.fillna(0, ["file_count", "dir_count", "file_bytes"])


def largest_files(files: DataFrame, n: int = 12) -> DataFrame:
    return ops.largest(files.where("NOT is_dir").select("volume_id", "path", "size"), "size", "path", n, "volume_id")


def checksums(files: DataFrame) -> DataFrame:
    """CRC-32, CRC-16 and SHA-1 of files with content."""
    return files.where("content IS NOT NULL").select("volume_id", "path", binary.crc32_hex("content").alias("crc32"), binary.sha1_hex("content").alias("sha1"))


def matching(files: DataFrame, pattern: str) -> DataFrame:
    """Files whose name fits a glob, and the directories above them."""
    hits = files.where(~F.col("is_dir") & names.glob_match("name", pattern))
    keep = hits.select("volume_id", F.explode(names.ancestors("path")).alias("path")).distinct()
    return files.join(keep, ["volume_id", "path"], "left_semi")


def listing(files: DataFrame) -> DataFrame:
    """Lines of a long listing in pre-order."""
    size = F.when(F.col("is_dir"), "<DIR>").otherwise(F.col("size").cast("string"))
    stamp = F.coalesce(F.date_format("modified", "yyyy-MM-dd HH:mm"), F.lit(" " * 16))
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("flags"), F.lit(" "), F.lpad(size, 8, " "), F.lit(" "), stamp, F.lit(" "), names.control_safe("name"))
    return files.select("volume_id", "ord_path", line.alias("line"))


# ------------------------------------------------------------------ edits and conversions: a new images row for each

EDITED = "image_id long, path string, format string, prefix binary, data binary, sector_count int, members array<struct<name:string,length:int>>, error struct<kind:string,msg:string>"
_EDITED = [("image_id", pa.int64()), ("path", pa.string()), ("format", pa.string()), ("prefix", pa.binary()), ("data", pa.binary()), ("sector_count", pa.int32()), ("members", pa.list_(pa.struct([("name", pa.string()), ("length", pa.int32())]))), ("error", pa.struct([("kind", pa.string()), ("msg", pa.string())]))]


def apply_edits(images: DataFrame, edits: DataFrame) -> DataFrame:
    """Images after their ``edits`` (image_id, ord, op, path, target, content), in order and all
    or none: op is add, mkdir, delete or rename. A refused edit leaves the data and sets the error."""
    steps = edits.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("ord", "op", "path", "target", "content"))).alias("steps"))

    def of(image_id, path, format, prefix, data, steps) -> Iterator[dict]:
        row = {"image_id": image_id, "path": path, "format": format, "prefix": prefix, "data": data, "sector_count": len(data) // 512, "members": None, "error": None}
        try:
            for s in steps:
                v = fatfs.Volume(data)
                do = {"add": lambda: v.add(s["path"], s["content"] or b""), "mkdir": lambda: v.mkdir(s["path"]), "delete": lambda: v.delete(s["path"]), "rename": lambda: v.rename(s["path"], s["target"])}
                data = do[s["op"]]()
            row["data"] = data
        except (ValueError, KeyError) as e:
            row["error"] = {"kind": "Refused", "msg": str(e)}
        yield row

    joined = images.where("data IS NOT NULL").join(steps, "image_id").select("image_id", "path", "format", "prefix", "data", "steps")
    return _per_row(joined, EDITED, _EDITED, of)


def encoded(images: DataFrame, format: str | None = None) -> DataFrame:
    """(path, content, error): images in a container, their own if none is given."""
    schema, fields = "path string, content binary, error string", [("path", pa.string()), ("content", pa.binary()), ("error", pa.string())]

    def of(path: str, own: str, prefix: bytes, data: bytes) -> Iterator[dict]:
        row = {"path": path, "content": None, "error": None}
        try:
            row["content"] = containers.encode(format or own, data, (prefix or b"") if format in (None, own) else b"")
        except (ValueError, struct.error) as e:
            row["error"] = str(e)
        yield row

    return _per_row(images.where("data IS NOT NULL").select("path", "format", "prefix", "data"), schema, fields, of)


def split_images(images: DataFrame) -> DataFrame:
    """(path, name, content): a row per disk of concatenated images, named after the image."""
    schema, fields = "path string, name string, content binary", [("path", pa.string()), ("name", pa.string()), ("content", pa.binary())]

    def of(path: str, data: bytes) -> Iterator[dict]:
        stem = path.rpartition("/")[2].rpartition(".")[0]
        for n, (lba, count) in enumerate(fatfs.split_disks(data), 1):
            yield {"path": path, "name": f"{stem} (Disk {n}).dsk", "content": data[lba * 512 : (lba + count) * 512]}

    return _per_row(images.where("data IS NOT NULL").select("path", "data"), schema, fields, of)


def repaired(images: DataFrame) -> DataFrame:
    """(image_id, fix, data): images whose length and layout disagree, after the fix."""
    schema, fields = "image_id long, fix string, size long, data binary", [("image_id", pa.int64()), ("fix", pa.string()), ("size", pa.int64()), ("data", pa.binary())]

    def of(image_id: int, data: bytes) -> Iterator[dict]:
        if found := fatfs.size_mismatch(data):
            yield {"image_id": image_id, "fix": found[0], "size": found[1], "data": fatfs.repair_size(data)}

    return _per_row(images.where("data IS NOT NULL").select("image_id", "data"), schema, fields, of)


def write_out(rows: DataFrame, folder: str) -> DataFrame:
    """Writes (name, content) rows as files under ``folder``, a URI that all executors reach;
    returns the table of names and lengths. A file is written under another name and renamed,
    so a task that is run again leaves whole files."""
    schema = "name string, length long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for k in range(batch.num_rows):
                name, content = batch.column(0)[k].as_py(), batch.column(1)[k].as_py() or b""
                target = f"{root}/{name}"
                store.create_dir(target.rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{target}.{attempt}.tmp") as out:
                    out.write(content)
                store.move(f"{target}.{attempt}.tmp", target)
                yield pa.RecordBatch.from_pydict({"name": [name], "length": [len(content)]})

    return rows.select("name", "content").mapInArrow(run, schema)


def extract_plan(files: DataFrame) -> DataFrame:
    """(name, content) of all files, host-safe and below a folder per volume."""
    safe = F.array_join(F.transform(F.split("path", "/"), names.safe_component), "/")
    volume = F.regexp_replace("volume_id", "[^0-9]", "_")
    return files.where("NOT is_dir").select(F.concat_ws("/", volume, safe).alias("name"), "content")
