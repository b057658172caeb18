"""Command line for single images: ls, add, extract, rm, mv, mkdir, new, bootsector, convert, split."""

from __future__ import annotations

import argparse
import os
import sys
from datetime import datetime
from pathlib import Path

from floppyscope.sources import containers, fatfs


def _open(path: str) -> tuple[str, bytes, bytes]:
    data = Path(path).read_bytes()
    ext = Path(path).suffix[1:].lower()
    format = containers.BY_EXTENSION.get(ext) or next((name for name, magic in containers.MAGICS if data.startswith(magic)), None)
    return (format or "", *containers.normalise(format, data))


def _save(path: str, format: str, prefix: bytes, data: bytes) -> None:
    target = Path(path)
    part = target.with_name(target.name + ".tmp")
    part.write_bytes(containers.encode(format, data, prefix))
    part.replace(target)


def _edited(args: argparse.Namespace, change) -> None:
    format, prefix, data = _open(args.image)
    if fatfs.partitions(data) or fatfs.split_disks(data):
        raise ValueError("an image of several volumes isn't edited")
    _save(args.image, format, prefix, change(data))


def ls(args: argparse.Namespace) -> None:
    _, _, data = _open(args.image)
    for name, _kind, _lba, _count, volume in fatfs.volumes(data):
        if name:
            print(f"{name}:")
        for e in volume.walk():
            size = "<DIR>" if e.is_dir else str(e.size)
            print(f"{'  ' * (e.depth + bool(name))}{size:>8} {e.name}" if args.long else "  " * (e.depth + bool(name)) + e.name)


def add(args: argparse.Namespace) -> None:
    def change(data: bytes) -> bytes:
        for file in args.files:
            name = (f"{args.dest}/" if args.dest else "") + Path(file).name.upper()
            if fatfs.Volume(data).find(name) and not args.force:
                raise ValueError(f"{name} exists")
            data = fatfs.Volume(data).add(name, Path(file).read_bytes())
        return data

    _edited(args, change)


def _modified(e: fatfs.Entry) -> float | None:
    """The time of an entry in this machine's zone; None up to 1980 and for impossible dates."""
    try:
        stamp = datetime(1980 + (e.date >> 9), e.date >> 5 & 15, e.date & 31, e.time >> 11, e.time >> 5 & 63)
    except ValueError:
        return None
    return stamp.timestamp() if stamp.year > 1980 else None


def extract(args: argparse.Namespace) -> None:
    _, _, data = _open(args.image)
    for name, _kind, _lba, _count, volume in fatfs.volumes(data):
        for e in volume.walk():
            if not e.is_dir and (not args.path or (e.path + "/").upper().startswith(args.path.strip("/").upper() + "/")):
                target = Path(args.to, name, *(p.translate(str.maketrans('\\:*?"<>|', "________")) for p in e.path.split("/")))
                target.parent.mkdir(parents=True, exist_ok=True)
                target.write_bytes(volume.read(e))
                if stamp := _modified(e):
                    os.utime(target, (stamp, stamp))


def rm(args: argparse.Namespace) -> None:
    def change(data: bytes) -> bytes:
        for path in args.paths:
            found = fatfs.Volume(data).find(path)
            if not found and args.force:
                continue
            if found and found.is_dir and not args.recursive:
                raise ValueError(f"{path} is a directory")
            below = [e.path for e in fatfs.Volume(data).walk() if found and e.path.startswith(found.path + "/")]
            for p in [*sorted(below, key=lambda p: -p.count("/")), path]:
                data = fatfs.Volume(data).delete(p)
        return data

    _edited(args, change)


def mv(args: argparse.Namespace) -> None:
    def change(data: bytes) -> bytes:
        v = fatfs.Volume(data)
        target = v.find(args.target)
        name = args.target
        if target and target.is_dir:
            name = f"{target.path}/{args.source.strip('/').rpartition('/')[2]}"
        elif target and args.force:
            data = v.delete(args.target)
        return fatfs.Volume(data).rename(args.source, name)

    _edited(args, change)


def mkdir(args: argparse.Namespace) -> None:
    def change(data: bytes) -> bytes:
        for path in args.paths:
            parts = path.strip("/").split("/")
            for k in range(1 if args.parents else len(parts), len(parts) + 1):
                step = "/".join(parts[:k])
                found = fatfs.Volume(data).find(step)
                if found and (not args.parents or not found.is_dir):
                    raise ValueError(f"{step} exists")
                data = data if found else fatfs.Volume(data).mkdir(step.upper())
        return data

    _edited(args, change)


def new(args: argparse.Namespace) -> None:
    Path(args.image).write_bytes(fatfs.blank(args.format))


def bootsector(args: argparse.Namespace) -> None:
    block = Path(args.block).read_bytes()
    _edited(args, lambda data: fatfs.install_boot_block(data, block, None if args.serial is None else int(args.serial, 16)))


def convert(args: argparse.Namespace) -> None:
    _, _, data = _open(args.image)
    _save(args.target, containers.BY_EXTENSION.get(Path(args.target).suffix[1:].lower(), ""), b"", data)


def split(args: argparse.Namespace) -> None:
    _, _, data = _open(args.image)
    disks = fatfs.split_disks(data)
    targets = [Path(args.image).with_name(f"{Path(args.image).stem} (Disk {n}).dsk") for n in range(1, len(disks) + 1)]
    if not disks or any(t.exists() for t in targets):
        raise ValueError("a single disk, or a target exists")
    for target, (lba, count) in zip(targets, disks):
        target.write_bytes(data[lba * 512 : (lba + count) * 512])


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="floppyscope", description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)

    def verb(f, *arguments: tuple) -> None:
        p = verbs.add_parser(f.__name__)
        p.set_defaults(run=f)
        for names, options in arguments:
            p.add_argument(*names, **options)

    image = (("image",), {})
    flag = {"action": "store_true"}
    verb(ls, image, (("-l", "--long"), flag))
    verb(add, image, (("files",), {"nargs": "+"}), (("--dest",), {}), (("-f", "--force"), flag))
    verb(extract, image, (("path",), {"nargs": "?"}), (("--to",), {"default": "."}))
    verb(rm, image, (("paths",), {"nargs": "+"}), (("-r", "--recursive"), flag), (("-f", "--force"), flag))
    verb(mv, image, (("source",), {}), (("target",), {}), (("-f", "--force"), flag))
    verb(mkdir, image, (("paths",), {"nargs": "+"}), (("-p", "--parents"), flag))
    verb(new, image, (("--format",), {"choices": sorted(fatfs.FORMATS), "default": "ds720"}))
    verb(bootsector, image, (("block",), {}), (("--serial",), {}))
    verb(convert, image, (("target",), {}))
    verb(split, image)
    args = parser.parse_args(argv)
    try:
        args.run(args)
    except (ValueError, OSError) as e:
        print(f"floppyscope: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
