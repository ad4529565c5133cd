"""Containers made by hand: what their headers tell, and where they break off."""

import struct

import pytest
from pyspark.sql import functions as F

from storymetrics.operators import frames
from storymetrics.sources import video


def box(kind, *content, large=False):
    body = b"".join(content)
    return (struct.pack(">I4sQ", 1, kind, len(body) + 16) if large else struct.pack(">I4s", len(body) + 8, kind)) + body


def header(long, scale, length):
    return (struct.pack(">IQQIQ", 1 << 24, 0, 0, scale, length) if long else struct.pack(">IIIII", 0, 0, 0, scale, length)) + bytes(16)


def track(kind=b"vide", width=1920, height=1080, runs=((90, 1),), scale=30, length=90, long=False):
    tkhd = (struct.pack(">I", 1 << 24) + bytes(84) if long else bytes(76)) + struct.pack(">II", width << 16, height << 16)
    stts = bytes(4) + struct.pack(">I", len(runs)) + b"".join(struct.pack(">II", *r) for r in runs)
    return box(b"trak", box(b"tkhd", tkhd), box(b"mdia", box(b"mdhd", header(long, scale, length)), box(b"hdlr", bytes(8), kind, bytes(12)), box(b"minf", box(b"stbl", box(b"stts", stts)))))


def movie(*tracks, long=False, end=False, large=False):
    moov = box(b"moov", box(b"mvhd", header(long, 600, 1800)), *tracks)
    data = box(b"mdat", bytes(5000), large=large)
    return box(b"ftyp", b"isom", bytes(4)) + (data + moov if end else moov + data)


def chunk(kind, body):
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi(micro=40_000, frames_=100, width=640, height=480, streams=((b"vids", 1, 25, 100),)):
    main = struct.pack("<IIIIIIIIII", micro, 0, 0, 0, frames_, 0, len(streams), 0, width, height) + bytes(16)
    lists = b"".join(chunk(b"LIST", b"strl" + chunk(b"strh", kind + bytes(16) + struct.pack("<IIII", scale, rate, 0, length) + bytes(20))) for kind, scale, rate, length in streams)
    return chunk(b"RIFF", b"AVI " + chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + lists) + chunk(b"LIST", b"movi" + bytes(301)))


CASES = {
    "plain.mp4": (movie(track()), ("mp4", 1920, 1080, 90, 30.0, 3.0)),
    "long.mp4": (movie(track(long=True), long=True), ("mp4", 1920, 1080, 90, 30.0, 3.0)),
    "end.mp4": (movie(track(), end=True), ("mp4", 1920, 1080, 90, 30.0, 3.0)),
    "large.mp4": (movie(track(), end=True, large=True), ("mp4", 1920, 1080, 90, 30.0, 3.0)),
    "sound.mov": (movie(track(b"soun", 0, 0, ((7, 1),)), track(height=720)), ("mp4", 1920, 720, 90, 30.0, 3.0)),
    "runs.mp4": (movie(track(runs=((10, 1), (5, 2)), scale=10, length=20)), ("mp4", 1920, 1080, 15, 7.5, 2.0)),
    "still.mp4": (movie(track(length=0)), ("mp4", 1920, 1080, 90, None, 0.0)),
    "timeless.mp4": (movie(track(scale=0)), ("mp4", 1920, 1080, 90, None, None)),
    "none.mp4": (movie(track(runs=())), ("mp4", 1920, 1080, 0, 0.0, 3.0)),
    "plain.avi": (avi(), ("avi", 640, 480, 100, 25.0, 4.0)),
    "micro.avi": (avi(streams=()), ("avi", 640, 480, 100, 25.0, 4.0)),
    "sound.avi": (avi(streams=((b"auds", 1, 44100, 9), (b"vids", 1001, 30000, 60))), ("avi", 640, 480, 60, 30000 / 1001, 60 * 1001 / 30000)),
    "still.avi": (avi(micro=0, streams=()), ("avi", 640, 480, 100, None, None)),
    "mute.mp4": (movie(track(b"soun")), "no track of pictures"),
    "empty.mp4": (box(b"ftyp", b"isom"), "no description"),
    "cut.mp4": (movie(track(), end=True)[:-40], "longer"),
    "cut.avi": (avi()[:40], "ends too early"),
    "headless.avi": (chunk(b"RIFF", b"AVI " + chunk(b"LIST", b"movi" + bytes(30))), "no main header"),
    "other.mkv": (b"\x1aE\xdf\xa3" + bytes(100), "unknown container"),
    "short.mp4": (b"\0\0", "unknown container"),
}


def test_containers(spark, tmp_path):
    for name, (content, _) in CASES.items():
        (tmp_path / name).write_bytes(content)
    paths = spark.createDataFrame([(f"file:{tmp_path}/{n}",) for n in [*CASES, "missing.mp4"]], "path string").repartition(3)
    got = {r["path"].rsplit("/", 1)[-1]: r for r in video.properties(paths).collect()}
    assert "missing" in got["missing.mp4"]["error"] or "No such file" in got["missing.mp4"]["error"]
    for name, (_, wanted) in CASES.items():
        r = got[name]
        if isinstance(wanted, str):
            assert wanted in r["error"] and r["height"] is None, name
        else:
            assert r["error"] is None and tuple(r[c] for c in ("container", "width", "height", "frames")) == wanted[:4], name
            assert [r["fps"], r["duration"]] == [v if v is None else pytest.approx(v) for v in wanted[4:]], name


def test_tall_videos_are_told_by_their_headers(spark, tmp_path):
    for height in (719, 720, 721):
        (tmp_path / f"{height}.mp4").write_bytes(movie(track(height=height)))
    paths = spark.createDataFrame([(f"file:{tmp_path}/{h}.mp4",) for h in (719, 720, 721)], "path string")
    rows = video.properties(paths).select("height", frames.tall(F.col("height")).alias("tall")).orderBy("height").collect()
    assert [tuple(r) for r in rows] == [(719, False), (720, False), (721, True)]
