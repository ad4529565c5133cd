"""Zip archives read by their directories: whole, large, damaged."""

import io
import os
import struct
import zipfile

import pytest

from storymetrics.sources import archives


def zipped(path, members, **more):
    with zipfile.ZipFile(path, "w", **more) as archive:
        for name, content, method in members:
            archive.writestr(zipfile.ZipInfo(name), content, method)


def rows(df):
    return sorted(((r["path"].rsplit("/", 1)[-1], r["idx"], r["name"], bytes(r["content"]) if r["content"] is not None else None, r["status"]) for r in df.collect()), key=repr)


def test_members_of_every_kind(spark, tmp_path):
    random, zeros = os.urandom(3_000_000), bytes(5_000_000)
    zipped(tmp_path / "a.zip", [("a.mp4", random, zipfile.ZIP_DEFLATED), ("ü/b.MOV", zeros, zipfile.ZIP_DEFLATED), ("c.jpg", b"no", 0), ("__MACOSX/x.mp4", b"no", 0), ("d.avi", b"", 0), ("e.mkv", random, zipfile.ZIP_STORED)])
    (tmp_path / "after.zip").write_bytes(b"something before the archive" + (tmp_path / "a.zip").read_bytes())
    wanted = [("a.mp4", random), ("ü/b.MOV", zeros), ("d.avi", b""), ("e.mkv", random)]
    got = rows(archives.unpacked(archives.members(spark, str(tmp_path))))
    assert got == sorted(((z, i, n, c, "success") for z in ("a.zip", "after.zip") for i, (n, c) in enumerate(wanted, 1)), key=repr)
    every = archives.members(spark, str(tmp_path), (".jpg", ".jpeg", ".png"), "a.zip").collect()
    assert [(r["idx"], r["name"], r["size"]) for r in every] == [(1, "c.jpg", 2)]


def test_a_task_for_each_member(spark, tmp_path):
    zipped(tmp_path / "m.zip", [(f"{i:03d}.mp4", b"x" * i, 0) for i in range(60)])
    held = archives.unpacked(archives.members(spark, str(tmp_path)))
    assert held.rdd.getNumPartitions() == 60 and held.count() == 60


def test_only_names_come_from_the_reader(spark, tmp_path):
    zipped(tmp_path / "m.zip", [("a.mp4", b"x", 0)])
    plan = archives.members(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string>" in plan


def test_large_numbers_stand_elsewhere(spark, tmp_path):
    """An archive with ZIP64 records, made from a plain one: the end record and one member point there."""
    out = io.BytesIO()
    zipped(out, [("a.mp4", b"hello", 0)])
    raw = bytearray(out.getvalue())
    end, central = raw.rfind(archives.END), raw.rfind(archives.CENTRAL)
    head = raw[central:end]
    extra = struct.pack("<HHQQQ", 1, 24, 5, 5, 0)
    head[20:28], head[42:46] = b"\xff" * 8, b"\xff" * 4
    struct.pack_into("<H", head, 30, len(extra))
    head = head[:51] + extra + head[51:]
    record = archives.END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(head), central)
    locator = archives.LOCATOR64 + struct.pack("<IQI", 0, central + len(head), 1)
    last = archives.END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    (tmp_path / "z.zip").write_bytes(raw[:central] + head + record + locator + last)
    with zipfile.ZipFile(tmp_path / "z.zip") as check:
        assert check.read("a.mp4") == b"hello"
    assert rows(archives.unpacked(archives.members(spark, str(tmp_path)))) == [("z.zip", 1, "a.mp4", b"hello", "success")]


def test_offsets_beyond_four_gigabytes(spark, tmp_path):
    """A sparse file: 5 GB of nothing, then the archive, whose offsets say so."""
    out = io.BytesIO()
    zipped(out, [("a.mp4", b"far" * 1000, zipfile.ZIP_DEFLATED)])
    with open(tmp_path / "far.zip", "wb") as f:
        f.truncate(5 << 30)
        f.seek(5 << 30)
        f.write(out.getvalue())
    assert rows(archives.unpacked(archives.members(spark, str(tmp_path)))) == [("far.zip", 1, "a.mp4", b"far" * 1000, "success")]


@pytest.mark.parametrize("kind", ["nothing", "cut", "directory", "end"])
def test_damaged_archives_are_rows(spark, tmp_path, kind):
    zipped(tmp_path / "a.zip", [("a.mp4", b"x" * 500, 0), ("b.mp4", b"y" * 500, 0)])
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    second = raw.rfind(archives.CENTRAL)
    if kind == "nothing":
        raw = bytearray(b"PK")
    elif kind == "cut":
        raw = raw[:-30]
    elif kind == "directory":
        raw[second] = 0
    else:
        struct.pack_into("<I", raw, raw.rfind(archives.END) + 12, 1 << 30)
    (tmp_path / "a.zip").write_bytes(raw)
    got = rows(archives.unpacked(archives.members(spark, str(tmp_path))))
    assert [(r[1], r[2], r[4]) for r in got] == ([(1, "a.mp4", "success")] if kind == "directory" else []) + [(2 if kind == "directory" else 1, None, "error")]


def test_damaged_members_are_rows(spark, tmp_path):
    zipped(tmp_path / "a.zip", [("crc.mp4", b"x" * 500, 0), ("bits.mp4", os.urandom(500), zipfile.ZIP_DEFLATED), ("flag.mp4", b"z" * 50, 0), ("method.mp4", b"w" * 50, zipfile.ZIP_BZIP2), ("bomb.mp4", bytes(1 << 22), zipfile.ZIP_DEFLATED), ("good.mp4", b"good", 0)])
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        at = {i.filename: i.header_offset for i in z.infolist()}
    raw[at["crc.mp4"] + 100] ^= 1
    raw[at["bits.mp4"] + 60] ^= 0xFF
    central = {n: raw.find(n.encode(), raw.find(archives.CENTRAL)) - 46 for n in at}
    raw[central["flag.mp4"] + 8] |= 1
    struct.pack_into("<I", raw, central["bomb.mp4"] + 24, 1000)
    (tmp_path / "a.zip").write_bytes(raw)
    got = archives.unpacked(archives.members(spark, str(tmp_path))).collect()
    assert {r["name"]: r["status"] for r in got} == {n: "success" if n == "good.mp4" else "error" for n in at}
    told = {r["name"]: r["error"] for r in got}
    assert "checksum" in told["crc.mp4"] and "encrypted" in told["flag.mp4"] and "compression 12" in told["method.mp4"] and "longer" in told["bomb.mp4"]
    files = archives.extracted(archives.members(spark, str(tmp_path)), f"{tmp_path}/out").collect()
    assert {r["name"]: r["status"] for r in files} == {n: "success" if n == "good.mp4" else "error" for n in at}
    assert [f.read_bytes() for f in (tmp_path / "out").iterdir()] == [b"good"]
