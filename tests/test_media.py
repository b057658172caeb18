import fixtures as fx
import pytest
from pyspark.sql import functions as F

from floppyscope import __main__ as cli
from floppyscope.plans import media
from floppyscope.sources import containers, fatfs
from floppyscope.streaming import watch


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.dsk").write_bytes(fx.two_files())
    (tmp_path / "sub" / "p.dsk").write_bytes(fx.partitioned())
    (tmp_path / "z.zip").write_bytes(fx.zip_of([("in.dsk", fx.populated(), 8)]))
    (tmp_path / "bad.dsk").write_bytes(b"short")
    (tmp_path / "track.dmk").write_bytes(fx.dmk(bad=(1, 2)))
    (tmp_path / "notes.md").write_text("no image")
    return tmp_path


def test_images_of_a_folder(spark, folder):
    images = containers.images(spark, str(folder))
    got = {r["path"].rpartition("/")[2]: (r["format"], r["sector_count"], r["error"] and r["error"]["kind"]) for r in images.collect()}
    assert got == {"a.dsk": ("Dsk", 1440, None), "p.dsk": ("Dsk", 1500, None), "z.zip": ("Zip", 1440, None), "bad.dsk": ("Dsk", None, "Malformed"), "track.dmk": ("Dmk", 1440, None)}
    volumes = media.volumes(images)
    found = {(r["path"].rpartition("/")[2], r["kind"], r["name"]) for r in volumes.join(images.select("image_id", "path"), "image_id").select("path", "kind", "name").collect()}
    assert found == {("a.dsk", "single", ""), ("p.dsk", "partition", "P1"), ("p.dsk", "partition", "P2"), ("p.dsk", "partition", "P3"), ("z.zip", "zip", "in.dsk"), ("track.dmk", "single", "")}
    files = media.entries(volumes, content=True)
    assert {(r["path"], len(r["content"])) for r in files.where("NOT is_dir").collect()} >= {("BIG.BIN", 5000), ("SUB/HI.TXT", 5), ("P401.TXT", 401), ("UTILS/GAME.COM", 16)}
    lines = [r["line"] for r in media.listing(files.where("path LIKE 'SUB%'")).orderBy("ord_path").collect()]
    assert lines[0].startswith("d----    <DIR>") and lines[1].startswith("  ----a") and lines[1].endswith("HI.TXT")


def test_raw_tracks(spark, folder):
    rows = containers.dmk_table(spark.read.format("binaryFile").load(str(folder / "track.dmk")))
    report = rows.groupBy("track", "side").agg(F.count("*").alias("n"), F.count_if(~F.col("data_crc_ok")).alias("bad"))
    assert {(r["track"], r["side"]) for r in report.where("bad = 1").collect()} == {(1, 0), (1, 1)} and report.where("n <> 9").count() == 0


def test_table_agrees_with_volume(spark):
    from floppyscope.media_queries import _volumes

    v = _volumes(spark, {"a.dsk": fx.two_files()})
    own = fatfs.Volume(fx.two_files())
    got = {r["cluster"]: (r["entry"], r["kind"]) for r in media.table_entries(v).collect()}
    assert got == {c: (own.entry(c), own.kind_of(own.entry(c))) for c in range(2, own.clusters + 2)}


def test_write_out(spark, folder, tmp_path):
    files = media.entries(media.volumes(containers.images(spark, str(folder / "a.dsk"))), content=True)
    done = media.write_out(media.extract_plan(files), f"file://{tmp_path}/out").collect()
    assert sorted(r["length"] for r in done) == [5, 5000]
    assert sorted(p.name for p in (tmp_path / "out").rglob("*") if p.is_file()) == ["BIG.BIN", "HI.TXT"]


def test_refused_edit(spark):
    from floppyscope.media_queries import _images

    images = _images(spark, {"a.dsk": fx.two_files()})
    edits = spark.createDataFrame([(images.first()["image_id"], 1, "delete", "SUB", None, None)], "image_id long, ord int, op string, path string, target string, content binary")
    row = media.apply_edits(images, edits).first()
    assert row["error"]["kind"] == "Refused" and bytes(row["data"]) == fx.two_files()


def test_watch_folder(spark, folder, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.dsk").write_bytes(fx.two_files())
    stream = watch.watch_volumes(spark, str(tmp_path / "in"), "*.dsk").select("volume_id", "clusters")
    run = stream.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert spark.table("seen").select("clusters").first()["clusters"] == 713


def test_typed_prefixes(spark, tmp_path):
    rows = [("2024-01-01 00:00:00.0", "u", "a"), ("2024-01-01 00:00:00.5", "u", "b"), ("2024-01-01 00:00:03.0", "u", "c"), ("2024-01-02 00:00:00", "u", "z")]
    spark.createDataFrame(rows, "t string, user string, key string").selectExpr("to_timestamp(t) AS t", "user", "key").write.parquet(str(tmp_path / "keys"))
    keys = spark.readStream.schema("t timestamp, user string, key string").parquet(str(tmp_path / "keys"))
    out = watch.typed_prefixes(keys, "user", "t", "key")
    run = out.writeStream.format("memory").queryName("typed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert {r["prefix"] for r in spark.table("typed").collect()} >= {"ab", "c"}


def test_latest_records(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", 1, 1, "old"), ("2024-01-01 05:00:00", 1, 2, "new"), ("2024-01-03 00:00:00", 2, 3, "x")]
    spark.createDataFrame(rows, "t string, k int, o int, v string").selectExpr("to_timestamp(t) AS t", "k", "o", "v").write.parquet(str(tmp_path / "j"))
    journal = spark.readStream.schema("t timestamp, k int, o int, v string").parquet(str(tmp_path / "j"))
    run = watch.latest_records(journal, "k", "t", "o", "v", "1 hour").writeStream.format("memory").queryName("latest").outputMode("append").option("checkpointLocation", str(tmp_path / "cp3")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert [(r["k"], r["v"]) for r in spark.table("latest").collect()] == [(1, "new")]


def test_command_line(tmp_path, capsys):
    image, host = str(tmp_path / "x.dsk"), tmp_path / "hello.txt"
    host.write_text("hi there")
    assert cli.main(["new", image]) == 0 and cli.main(["mkdir", "-p", image, "A/B"]) == 0 and cli.main(["add", image, str(host), "--dest", "A/B"]) == 0
    assert cli.main(["add", image, str(host), "--dest", "A/B"]) == 1 and cli.main(["rm", image, "A"]) == 1
    assert cli.main(["mv", image, "A/B/HELLO.TXT", "A"]) == 0 and cli.main(["convert", image, str(tmp_path / "x.xsa")]) == 0
    capsys.readouterr()
    assert cli.main(["ls", str(tmp_path / "x.xsa")]) == 0 and capsys.readouterr().out.split() == ["A", "B", "HELLO.TXT"]
    assert cli.main(["extract", image, "--to", str(tmp_path / "out")]) == 0 and (tmp_path / "out/A/HELLO.TXT").read_text() == "hi there"
    assert cli.main(["rm", "-r", image, "A"]) == 0 and not list(fatfs.Volume((tmp_path / "x.dsk").read_bytes()).walk())
    (tmp_path / "set.dsk").write_bytes(fx.two_files() * 2)
    assert cli.main(["split", str(tmp_path / "set.dsk")]) == 0 and (tmp_path / "set (Disk 2).dsk").read_bytes() == fx.two_files() and cli.main(["split", str(tmp_path / "set.dsk")]) == 1


def test_track_report(spark, folder):
    report = media.track_report(containers.dmk_table(spark.read.format("binaryFile").load(str(folder / "track.dmk"))))
    rows = {(r["track"], r["side"]): r for r in report.collect()}
    assert len(rows) == 160 and not rows[1, 0]["standard"] and rows[1, 0]["bad"] == 1 and rows[2, 1]["standard"] and (rows[0, 0]["size"], rows[0, 0]["density"]) == (512, "MFM")


def test_root_slots_and_charset(spark):
    from floppyscope.media_queries import _volumes

    data = bytearray(fatfs.Volume(fatfs.blank()).add("AAA.TXT", b"x"))
    at = fatfs.FORMATS["ds720"].root_start * 512
    data[at + 32 : at + 64] = b"BAD     TXT\x60" + bytes(20)
    data[at + 64 : at + 96] = b"\xb1\xb2\xb3     TXT\x20" + bytes(20)
    v = _volumes(spark, {"a.dsk": bytes(data)})
    assert [(r["slot"], r["reason"]) for r in media.root_slots(v).orderBy("slot").collect()] == [(0, None), (1, "attribute"), (2, None)]
    assert media.charset_of(media.entries(v)).first()["verdict"] == "Japanese"


def test_boot_block_and_sector():
    data, block = fatfs.blank(), bytes(range(256)) * 2
    out = fatfs.install_boot_block(data, block, 0x12345678)
    assert out[11:30] == data[11:30] and out[510:512] == b"\x55\xaa" and out[0x27:0x2B] == bytes.fromhex("78563412") and out[0x40] == 0x40
    assert fatfs.write_sector(data, 5, b"\1" * 512)[5 * 512] == 1
    for bad in (lambda: fatfs.install_boot_block(data, b""), lambda: fatfs.write_sector(data, 1440, bytes(512)), lambda: fatfs.write_sector(data, 0, b"")):
        with pytest.raises(ValueError):
            bad()


def test_command_line_boot_and_times(tmp_path):
    image, block = tmp_path / "x.dsk", tmp_path / "boot.bin"
    image.write_bytes(fatfs.Volume(fatfs.blank()).add("A.TXT", b"x", 30 << 9 | 6 << 5 | 15, 12 << 11 | 30 << 5))
    block.write_bytes(bytes([0xEB, 0xFE, 0x90]).ljust(512, b"\7"))
    assert cli.main(["bootsector", str(image), str(block), "--serial", "DEADBEEF"]) == 0
    data = image.read_bytes()
    assert data[0x27:0x2B] == bytes.fromhex("EFBEADDE") and data[100] == 7 and fatfs.Volume(data).find("A.TXT")
    assert cli.main(["extract", str(image), "--to", str(tmp_path / "out")]) == 0
    assert __import__("datetime").datetime.fromtimestamp((tmp_path / "out/A.TXT").stat().st_mtime).strftime("%Y-%m-%d %H:%M") == "2010-06-15 12:30"
    (tmp_path / "two.dsk").write_bytes(fatfs.blank() * 2)
    assert cli.main(["mkdir", str(tmp_path / "two.dsk"), "D"]) == 1 and cli.main(["ls", str(tmp_path / "none.dsk")]) == 1
