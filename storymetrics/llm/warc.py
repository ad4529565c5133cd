"""WARC archives of pages with revisit records, and a globally ordered index of them by external merging.

Writing: records are made with DataFrame functions and written by Spark's text writer, whose line separator is the
CRLF CRLF that ends a record, so the archives (one gzip member each, as the text writer makes them) lie wherever Spark
can write. Pages tell no time of capture: WARC-Date is a fixed day plus page_id seconds. A record's id is its page_id. Of records with equal
payloads of at least LEAST bytes, that with the largest page_id is the response and the others revisit it; smaller
payloads are always responses. Only digests meet in the grouping, and its result is joined back to the pages.

Reading: archives are read as binary files, in record order by Content-Length, and every payload is digested anew. Each
archive gives a capture run, sorted where it is read. The index is an external merge: runs are cut at common bounds of
(URL key, timestamp, page), which also divide a URL that holds many captures, and each range merges its k runs with a
loser tree. The bounds come from a bounded sample (SAMPLED_KEYS per range); results don't depend on them.

Defined results: null html is an empty payload; a null url is an empty one; a null page_id is kept and is never the one
that others revisit; rows with the same page_id and payload are all responses if that id is the largest; an empty table
gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LEAST, CRLF = 1000, "\r\n"
RECORDS_PER_FILE, RANGE_BYTES, SAMPLED_KEYS = 20_000, 64_000_000, 50
#: Spark reads a file as binary only below 2 GB.
FILE_BYTES = 1_900_000_000
CAPTURES = "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
RUNS = f"run long, {CAPTURES}"
HISTORY = f"part int, nth long, {CAPTURES}"


def lines(*parts: tuple[str, Column | str]) -> Column:
    return F.concat(*(x for name, value in parts for x in (F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit(CRLF))))


def records(pages: DataFrame) -> DataFrame:
    """page_id and the WARC record, without the CRLF CRLF that ends it."""
    html = F.coalesce(F.col("html"), F.lit(""))
    light = pages.select("page_id", F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", "").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    shared = light.where(F.col("bytes") >= LEAST).groupBy("digest", "bytes").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    both = light.join(shared, ["digest", "bytes"], "left").withColumn("revisit", F.coalesce(~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False)) & F.col("first_id").isNotNull())
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    date = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}"), lines(("Content-Type", "text/html; charset=utf-8"), ("Content-Length", F.col("bytes").cast("string"))), F.lit(CRLF))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("html")))
    revisit = lines(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name("first_id")))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        lines(("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))), ("WARC-Record-ID", name("page_id")), ("WARC-Target-URI", F.col("url")), ("WARC-Date", date), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))),
        F.when(F.col("revisit"), revisit).otherwise(F.lit("")),
        lines(("Content-Type", "application/http; msgtype=response"), ("Content-Length", F.octet_length(block).cast("string"))),
        F.lit(CRLF),
    )
    return both.select("page_id", F.concat(head, block).alias("record"))


def write(pages: DataFrame, path: str) -> None:
    """Archives of RECORDS_PER_FILE records, or of so few that even the largest ones stay below FILE_BYTES."""
    largest = pages.agg(F.max(F.octet_length("html")).alias("n")).first()["n"] or 0
    each = max(1, min(RECORDS_PER_FILE, FILE_BYTES // (largest + 4096)))
    records(pages).select("record").write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", each).text(path)


def url_key(url: str) -> str:
    """The host's labels in reverse order, then ")" and the path with the query: lower case, without scheme, www. and fragment."""
    rest = re.sub(r"^[a-z]+://", "", url.lower())
    rest = re.sub(r"^www\.", "", rest).split("#", 1)[0]
    host, slash, path = rest.partition("/")
    return ",".join(host.split(".")[::-1]) + ")" + slash + path


def headers(stream: io.BufferedIOBase) -> dict[str, str]:
    out = {}
    while (line := stream.readline().strip()) != b"":
        name, _, value = line.decode().partition(":")
        out[name.lower()] = value.strip()
    return out


def number(urn: str | None) -> int | None:
    digits = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(digits[1]) if digits else None


def parse(stream: io.BufferedIOBase) -> Iterator[tuple]:
    """The captures of one archive; a payload that differs from its declared digest or length is an error."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        head = headers(stream)
        block = io.BytesIO(stream.read(int(head["content-length"])))
        block.readline()
        http = headers(block)
        payload, kind = block.read(), head["warc-type"]
        digest, size = head["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
        if kind == "response" and (hashlib.sha1(payload).hexdigest(), len(payload)) != (digest, size):
            raise ValueError(f"{head['warc-record-id']} does not hold what it declares")
        yield url_key(head["warc-target-uri"]), head["warc-date"], number(head["warc-record-id"]), size, digest, kind, number(head.get("warc-refers-to"))


def order(capture: tuple) -> tuple:
    """URL key, time, page (nulls last)."""
    return capture[0], capture[1], capture[2] is None, capture[2] or 0


def read(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives under a path, a sorted run for each archive."""
    schema = common.arrow_schema(RUNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                captures = sorted(parse(gzip.GzipFile(fileobj=pa.BufferReader(content.as_buffer()))), key=order)
                if captures:
                    number = int.from_bytes(hashlib.sha1(name.encode()).digest()[:7], "big")
                    yield common.batch(schema, [number] * len(captures), *zip(*captures))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RUNS)


def loser_tree(runs: list[list[tuple]]) -> Iterator[tuple]:
    """Merges k sorted runs: inner nodes hold losers, so that each step replays one path from a leaf to the root."""
    k = len(runs)
    heads = [0] * k
    done = (1,)
    top = [(0, order(r[0])) if r else done for r in runs]
    tree = [-1] * k

    def play(leaf: int) -> int:
        node, winner = (leaf + k) // 2, leaf
        while node:
            other = tree[node]
            if other < 0:
                tree[node] = winner
                return -1
            if top[other] < top[winner]:
                tree[node], winner = winner, other
            node //= 2
        return winner

    winner = -1
    for leaf in range(k):
        winner = max(winner, play(leaf)) if k > 1 else 0
    while k and top[winner] != done:
        yield runs[winner][heads[winner]]
        heads[winner] += 1
        top[winner] = (0, order(runs[winner][heads[winner]])) if heads[winner] < len(runs[winner]) else done
        winner = play(winner)


def history(captures: DataFrame) -> DataFrame:
    """The captures with their position (from 0) in the order of URL key, time and page over all archives."""
    spark = captures.sparkSession
    held = common.saved(captures, "captures")
    ranges = common.dealt(common.size_hint(held), RANGE_BYTES, 8, 4096)
    total = held.count()
    share = min(1.0, 2 * ranges * SAMPLED_KEYS / max(total, 1))
    sample = held.select("url_key", "captured", "page_id").sample(share, 7).limit(4 * ranges * SAMPLED_KEYS).collect()
    keys = sorted(order(tuple(r)) for r in sample)
    bounds = [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []
    columns = CAPTURES.replace(" long", "").replace(" string", "").split(", ")
    types = {c: f"array<{'long' if f'{c} long' in CAPTURES else 'string'}>" for c in columns}
    segment = "part int, run long, " + ", ".join(f"{c} {t}" for c, t in types.items())
    segment_schema, out_schema = common.arrow_schema(segment), common.arrow_schema(HISTORY)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.groups(batches, "run"):
            rows = sorted(zip(*(group[c].to_pylist() for c in columns)), key=order)
            number, at = group["run"][0].as_py(), [bisect_right(bounds, order(r)) for r in rows]
            edges = [0, *(i for i in range(1, len(at)) if at[i] != at[i - 1]), len(at)]
            out = [(at[i], number, *map(list, zip(*rows[i:j]))) for i, j in zip(edges, edges[1:])]
            yield common.batch(segment_schema, *zip(*out))

    def merge(group: pa.Table) -> pa.Table:
        runs = [list(zip(*(r[c] for c in columns))) for r in group.to_pylist()]
        rows = list(loser_tree(runs))
        return pa.Table.from_batches([common.batch(out_schema, [group["part"][0].as_py()] * len(rows), range(len(rows)), *zip(*rows))])

    merged = common.saved(held.mapInArrow(cut, segment).groupBy("part").applyInArrow(merge, HISTORY), "history")
    sizes = merged.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = spark.createDataFrame([(r["part"], r["before"]) for r in sizes.select("part", before.alias("before")).collect()], "part int, before long")  # at most 4096 rows
    return merged.join(F.broadcast(starts), "part").select(*columns, (F.col("nth") + F.col("before")).alias("position"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The captures of all pages, written and read back; pages have no capture time, so `captured` follows page_id."""
    path = common.claimed(spark, "warc")
    write(common.table(spark, sf_dir, "pages"), path)
    found = history(read(spark, path))
    common.delete(spark, path)  # the captures are tables by now
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "position")
