"""What a video's container tells of it, without decoding: height, frames, rate, duration.

Boxes (MP4, MOV) and chunks (AVI) are walked by their headers, so only those and the descriptions of tracks are read,
wherever they stand in the file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .archives import Opener, opened, read

#: Boxes that hold boxes, and lists that hold chunks.
NESTED, LISTS = (b"moov", b"trak", b"mdia", b"minf", b"stbl"), (b"RIFF", b"LIST")
#: A description that is larger than this isn't one.
LARGEST = 64 << 20

PROPERTIES = "path string, container string, width int, height int, frames bigint, fps double, duration double, error string"


def boxes(file: pa.NativeFile, at: int, stop: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, where its content starts, where it ends) of the boxes between two places, those inside of others too."""
    while at + 8 <= stop:
        size, kind = struct.unpack(">I4s", read(file, at, 8))
        start = at + 8
        if size == 1:
            size, start = struct.unpack(">Q", read(file, start, 8))[0], at + 16
        end = stop if size == 0 else at + size
        if end < start or end > stop:
            raise ValueError(f"box {kind!r} is longer than what holds it")
        yield kind, start, end
        if kind in NESTED:
            yield from boxes(file, start, end)
        at = end


def of_boxes(file: pa.NativeFile) -> dict:
    """Properties of the first track of pictures: its own duration and sample counts."""
    tracks: list[dict] = []
    movie = {}
    for kind, start, end in boxes(file, 0, file.size()):
        if kind == b"trak":
            tracks.append({})
        if kind not in (b"mvhd", b"tkhd", b"mdhd", b"hdlr", b"stts"):
            continue
        if end - start > LARGEST:
            raise ValueError(f"box {kind!r} is too large")
        body = read(file, start, end - start)
        long = body[:1] == b"\1"
        if kind in (b"mvhd", b"mdhd"):
            scale, length = struct.unpack_from(">IQ", body, 20) if long else struct.unpack_from(">II", body, 12)
            (movie if kind == b"mvhd" else tracks[-1]).update(scale=scale, length=length)
        elif kind == b"tkhd":
            width, height = struct.unpack_from(">II", body, 88 if long else 76)
            tracks[-1].update(width=width >> 16, height=height >> 16)
        elif kind == b"hdlr":
            tracks[-1].setdefault("kind", body[8:12])
        else:
            (count,) = struct.unpack_from(">I", body, 4)
            tracks[-1]["frames"] = sum(struct.unpack_from(">I", body, 8 + 8 * i)[0] for i in range(count))
    found = next((t for t in tracks if t.get("kind") == b"vide"), None)
    if found is None:
        raise ValueError("no track of pictures" if movie or tracks else "no description of the movie")
    scale, length = (found if "scale" in found else movie).get("scale"), (found if "scale" in found else movie).get("length")
    return {**{c: found.get(c) for c in ("width", "height", "frames")}, "duration": length / scale if scale and length is not None else None}


def chunks(file: pa.NativeFile, at: int, stop: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, where its content starts, where it ends) of the chunks between two places; of lists, those in headers."""
    while at + 8 <= stop:
        kind, size = struct.unpack("<4sI", read(file, at, 8))
        start, end = at + 8, at + 8 + size
        if kind in LISTS:
            name = read(file, start, 4)
            if name in (b"AVI ", b"hdrl", b"strl"):
                yield from chunks(file, start + 4, min(end, stop))
        else:
            yield kind, start, end
        at = end + (size & 1)


def of_chunks(file: pa.NativeFile) -> dict:
    """Properties of the main header, and rate and length of the first stream of pictures."""
    found: dict = {}
    for kind, start, end in chunks(file, 0, file.size()):
        if kind == b"avih":
            micro, *_ = struct.unpack("<I", read(file, start, 4))
            frames, width, height = (struct.unpack("<I", read(file, start + k, 4))[0] for k in (16, 32, 36))
            found.update(frames=frames, width=width, height=height, fps=1e6 / micro if micro else None)
        elif kind == b"strh" and read(file, start, 4) == b"vids" and "stream" not in found:
            scale, rate, _, length = struct.unpack("<IIII", read(file, start + 20, 16))
            found.update(stream=True, fps=rate / scale if scale else found.get("fps"), frames=length or found.get("frames"))
    if "width" not in found:
        raise ValueError("no main header")
    fps, frames = found.get("fps"), found.get("frames")
    return {**{c: found.get(c) for c in ("width", "height", "frames", "fps")}, "duration": frames / fps if fps and frames is not None else None}


def described(file: pa.NativeFile) -> dict:
    head = file.read(12)
    if head[:4] == b"RIFF" and head[8:12] == b"AVI ":
        return {"container": "avi", **of_chunks(file)}
    if head[4:8] not in (b"ftyp", b"moov", b"mdat", b"free", b"wide", b"skip"):
        raise ValueError("unknown container")
    found = {"container": "mp4", **of_boxes(file)}
    frames, duration = found.get("frames"), found.get("duration")
    return {**found, "fps": frames / duration if frames is not None and duration else None}


def properties(paths: DataFrame, opener: Opener = opened) -> DataFrame:
    """paths (path) -> PROPERTIES: what each container tells; what can't be read, or breaks off, is a row with an error.

    frames are those that the container claims; fps is their number over the duration, or as an AVI header says.
    """
    schema = pa.schema([("path", pa.string()), ("container", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("frames", pa.int64()), ("fps", pa.float64()), ("duration", pa.float64()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                row = dict.fromkeys(schema.names) | {"path": path}
                try:
                    with opener(path) as file:
                        row |= described(file)
                except (ValueError, OSError, struct.error, IndexError) as e:  # a damaged or missing file is a result, not a failure
                    row["error"] = str(e) or type(e).__name__
                yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)

    return paths.select("path").mapInArrow(run, PROPERTIES)
