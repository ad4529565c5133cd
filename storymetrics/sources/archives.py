"""Zip archives of any size: the central directory is read by seeking, then each member by its own range, in a task of its own."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..schemas import VIDEO

#: Fixed values of the format: signatures, the longest end record with its comment, and what says that a field stands elsewhere.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
END_BYTES, ELSEWHERE16, ELSEWHERE32, ZIP64_FIELD = 22 + 65535, 0xFFFF, 0xFFFFFFFF, 1
STORED, DEFLATED, ENCRYPTED, UTF8_NAME = 0, 8, 1, 0x800
#: Bytes that are read at once, and those that a value may have.
BLOCK, LARGEST = 1 << 20, (1 << 31) - 1

MEMBERS = "path string, idx int, name string, method int, flags int, packed bigint, size bigint, crc bigint, offset bigint, error string"
CONTENT = "path string, idx int, name string, content binary, status string, error string"
EXTRACTED = "path string, idx int, name string, file string, size bigint, status string, error string"
#: What opens a path for reading at any place. It runs in tasks.
Opener = Callable[[str], pa.NativeFile]


def uri(path: str) -> str:
    """A path as readers name it, with the slashes that file systems ask for."""
    return re.sub("^file:/+", "file:///", path)


def opened(path: str) -> pa.NativeFile:
    """A file of any store that Arrow knows, without reading it."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(uri(path))
    return store.open_input_file(name)


def read(file: pa.NativeFile, at: int, n: int) -> bytes:
    """n bytes from `at` on; fewer are an error."""
    if at < 0 or n < 0:
        raise ValueError("a record points outside of the archive")
    file.seek(at)
    got = file.read(n)
    if len(got) < n:
        raise ValueError("the archive ends too early")
    return got


def end_of(file: pa.NativeFile) -> tuple[int, int, int]:
    """(where the central directory starts, its bytes, by how much all offsets are off since something stands before the archive)."""
    length = file.size()
    tail_at = max(0, length - END_BYTES)
    tail = read(file, tail_at, length - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (len(tail) < at + 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] > len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no central directory")
    count, size, start = struct.unpack_from("<HII", tail, at + 10)
    stop = tail_at + at
    if count == ELSEWHERE16 or ELSEWHERE32 in (size, start):
        locator = read(file, stop - 20, 20)
        if not locator.startswith(LOCATOR64):
            raise ValueError("no locator of the large directory")
        stop = struct.unpack_from("<Q", locator, 8)[0]
        record = read(file, stop, 56)
        if not record.startswith(END64):
            raise ValueError("no end of the large directory")
        size, start = struct.unpack_from("<QQ", record, 40)
    shift = stop - size - start
    if shift < 0:
        raise ValueError("the directory is longer than what stands before its end")
    return start + shift, size, shift


def directory(file: pa.NativeFile) -> Iterator[tuple]:
    """(name, method, flags, packed, size, crc, offset) of each member in the order of the directory, which is read block by block."""
    at, left, shift = end_of(file)
    held = b""

    def more(n: int) -> None:
        nonlocal held, at, left
        while len(held) < n:
            if not left:
                raise ValueError("the central directory is damaged")
            some = read(file, at, min(left, max(BLOCK, n - len(held))))
            held, at, left = held + some, at + len(some), left - len(some)

    while held or left:
        more(46)
        if not held.startswith(CENTRAL):
            raise ValueError("the central directory is damaged")
        flags, method = struct.unpack_from("<HH", held, 8)
        crc, packed, size, name_n, extra_n, comment_n = struct.unpack_from("<IIIHHH", held, 16)
        offset = struct.unpack_from("<I", held, 42)[0]
        more(46 + name_n + extra_n + comment_n)
        name, extra = held[46 : 46 + name_n], held[46 + name_n : 46 + name_n + extra_n]
        held = held[46 + name_n + extra_n + comment_n :]
        while len(extra) >= 4:  # large numbers stand in a field of their own, in this order
            kind, n = struct.unpack_from("<HH", extra)
            if kind == ZIP64_FIELD:
                large = list(struct.unpack_from(f"<{min(n, len(extra) - 4) // 8}Q", extra, 4))
                size, packed, offset = (large.pop(0) if v == ELSEWHERE32 and large else v for v in (size, packed, offset))
            extra = extra[4 + n :]
        yield name.decode("utf-8" if flags & UTF8_NAME else "cp437", "replace"), method, flags, packed, size, crc, offset + shift


def blocks(file: pa.NativeFile, method: int, flags: int, packed: int, size: int, crc: int, offset: int) -> Iterator[bytes]:
    """The content of a member, block by block; what differs from the directory's size and checksum is an error."""
    if flags & ENCRYPTED:
        raise ValueError("the member is encrypted")
    if method not in (STORED, DEFLATED):
        raise ValueError(f"compression {method} is not supported")
    head = read(file, offset, 30)
    if not head.startswith(LOCAL):
        raise ValueError("no member where the directory says")
    at = offset + 30 + sum(struct.unpack_from("<HH", head, 26))
    inflate = zlib.decompressobj(-15) if method == DEFLATED else None
    made, check = 0, 0
    for start in range(0, packed, BLOCK):
        some = read(file, at + start, min(BLOCK, packed - start))
        while some:
            # never more than a block at once, and never more than one byte beyond what the directory tells
            out = inflate.decompress(some, min(BLOCK, size - made + 1)) if inflate else some
            some = inflate.unconsumed_tail if inflate else b""
            made, check = made + len(out), zlib.crc32(out, check)
            if made > size:
                raise ValueError("the member is longer than the directory says")
            if out:
                yield out
    if made != size or inflate and not inflate.eof:
        raise ValueError("the member is shorter than the directory says")
    if check != crc:
        raise ValueError("the checksum of the member is wrong")


def members(spark: SparkSession, path: str, suffixes: tuple[str, ...] = VIDEO, pattern: str = "*", opener: Opener = opened) -> DataFrame:
    """One row for each member with one of the suffixes (case aside; none: all) outside of __MACOSX, numbered from 1 in each archive.

    Only names and lengths of archives come from the reader; tasks read the directories by seeking. An archive whose
    directory is damaged is a row with an error after what it told until then; Spark lists no files of 0 bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive in b.column(0).to_pylist():
                rows = found(archive)
                while some := [r for _, r in zip(range(4096), rows)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)

    def found(archive: str) -> Iterator[tuple]:
        idx = 0
        try:
            with opener(archive) as file:
                for name, *rest in directory(file):
                    if not name.endswith("/") and name.lower().endswith(suffixes or ("",)) and not name.startswith("__MACOSX"):
                        idx += 1
                        yield archive, idx, name, *rest, None
        except (ValueError, OSError, struct.error) as e:  # a damaged archive is a result, not a failure
            yield archive, idx + 1, *[None] * 7, str(e)

    schema = pa.schema([("path", pa.string()), ("idx", pa.int32()), ("name", pa.string()), ("method", pa.int32()), ("flags", pa.int32()), *((c, pa.int64()) for c in ("packed", "size", "crc", "offset")), ("error", pa.string())])
    archives = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path")  # names only: no content is read
    return archives.mapInArrow(run, MEMBERS)


def spread(found: DataFrame) -> DataFrame:
    """The rows of members() in as many partitions as there are rows (65,536 at most), so that a task has a member."""
    held = scratch.saved(found, "members")
    return held.repartition(max(1, min(65_536, held.count())))


def unpacked(found: DataFrame, opener: Opener = opened) -> DataFrame:
    """(path, idx, name, content, status, error) of members(); a task holds one member at a time.

    A member that is damaged, encrypted, packed by another method, or larger than a value may be is a row with an error.
    """

    def take(file: pa.NativeFile, row: dict) -> tuple[bytes | None, int]:
        if row["size"] > LARGEST:
            raise ValueError("the member is larger than a value may be; extract it to a file")
        return b"".join(blocks(file, *(row[c] for c in ("method", "flags", "packed", "size", "crc", "offset")))), 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, result, error in each(batches, opener, take):
            content = result[0] if result else None
            values = (row["path"], row["idx"], row["name"], content, "error" if error else "success", error)
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

    schema = pa.schema([("path", pa.string()), ("idx", pa.int32()), ("name", pa.string()), ("content", pa.binary()), ("status", pa.string()), ("error", pa.string())])
    return spread(found).mapInArrow(run, CONTENT)


def extracted(found: DataFrame, folder: str, opener: Opener = opened) -> DataFrame:
    """(path, idx, name, file, size, status, error): members() as files of a folder, however large, block by block.

    A file has a name of archive, number and member, and gets it once it is whole, so a task that is run again does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri(folder))
        store.create_dir(root, recursive=True)

        def take(file: pa.NativeFile, row: dict) -> tuple[str, int]:
            base = re.sub(r"[^A-Za-z0-9._-]", "_", row["name"].rsplit("/", 1)[-1])
            name = f"{root}/{zlib.crc32(row['path'].encode()):08x}_{row['idx']:06d}_{base}"
            made, part = 0, f"{name}.{TaskContext.get().taskAttemptId()}"
            try:
                with store.open_output_stream(part) as out:
                    for some in blocks(file, *(row[c] for c in ("method", "flags", "packed", "size", "crc", "offset"))):
                        out.write(some)
                        made += len(some)
            except Exception:
                store.delete_file(part)
                raise
            store.move(part, name)
            return name, made

        for row, result, error in each(batches, opener, take):
            file, size = result or (None, None)
            values = (row["path"], row["idx"], row["name"], file, size, "error" if error else "success", error)
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

    schema = pa.schema([("path", pa.string()), ("idx", pa.int32()), ("name", pa.string()), ("file", pa.string()), ("size", pa.int64()), ("status", pa.string()), ("error", pa.string())])
    return spread(found).mapInArrow(run, EXTRACTED)


def each(batches: Iterator[pa.RecordBatch], opener: Opener, take: Callable) -> Iterator[tuple[dict, tuple | None, str | None]]:
    """(row, what `take` made of it, error) of every member."""
    for b in batches:
        for row in b.to_pylist():
            result, error = None, row["error"]
            if not error:
                try:
                    with opener(row["path"]) as file:
                        result = take(file, row)
                except (ValueError, OSError, struct.error, zlib.error) as e:  # a damaged member is a result, not a failure
                    error = str(e)
            yield row, result, error
