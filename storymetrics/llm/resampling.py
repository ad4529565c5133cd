"""Importance resampling towards a target distribution, over hashed n-grams.

Features are runs of one to three words, hashed by CRC-32. The CRC of a span of bytes is the XOR of what each byte adds,
which depends on its value and its distance from the span's end only, and of a constant of the span's length. So the
CRCs of all features of a run of texts come from one look-up for every byte of every span and one `bitwise_xor.reduceat`;
spans longer than the table are cut into blocks, which are folded pairwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from . import common, text

#: Fixed value: the reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Distances from the end that the position table has, and bytes of spans that are looked up at once.
REACH, CHUNK = 128, 1 << 21
#: Words in a feature at most; buckets; least words of a document that may be drawn; documents drawn of a hundred; seed.
GRAMS, BUCKETS, LEAST_WORDS, PERCENT, SEED = 3, 10_000, 20, 5, 42

ALL_ONES = np.uint32(0xFFFFFFFF)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def byte_table() -> np.ndarray:
    """What one byte leaves in an empty register."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(POLYNOMIAL), x >> 1).astype(np.uint32)
    return x


_BYTE = byte_table()


def zero_byte(state: np.ndarray) -> np.ndarray:
    """The registers after one more byte of 0."""
    return (state >> np.uint32(8)) ^ _BYTE[state & np.uint32(255)]


def position_table() -> tuple[np.ndarray, np.ndarray]:
    """(what a byte adds by distance from the end and value, the register after so many zero bytes from all ones)."""
    far, start = [_BYTE], [ALL_ONES]
    for _ in range(REACH - 1):
        far.append(zero_byte(far[-1]))
    for _ in range(REACH):
        start.append(zero_byte(np.asarray(start[-1])))
    return np.concatenate(far), np.array(start, np.uint32)


_TABLE, _LENGTHS = position_table()


def after(state: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The registers after as many zero bytes as the tables `shift` stand for: a XOR over the four bytes of a register."""
    out = shift[0][state & np.uint32(255)]
    for i in (1, 2, 3):
        out = out ^ shift[i][(state >> np.uint32(8 * i)) & np.uint32(255)]
    return out


def reach_shift() -> np.ndarray:
    """Tables of REACH zero bytes."""
    state = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])
    for _ in range(REACH):
        state = zero_byte(state)
    return state


_SHIFT = reach_shift()


def added(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What the bytes of each span (of 1 to REACH bytes) add to its CRC."""
    out, done = np.empty(len(start), np.uint32), np.cumsum(length)
    i = 0
    while i < len(start):
        before = done[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(done, before + CHUNK, "right")))
        stop = done[i:j] - before
        begin = stop - length[i:j]
        place = np.arange(stop[-1])
        from_end = np.repeat(stop - 1, length[i:j]) - place
        byte = data[place + np.repeat(start[i:j] - begin, length[i:j])]
        out[i:j] = np.bitwise_xor.reduceat(_TABLE[(from_end << 8) | byte], begin)
        i = j
    return out


def crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC-32 of every span [start, end) of bytes; none is empty."""
    if not len(start):
        return np.zeros(0, np.uint32)
    length = end - start
    blocks = -(-length // REACH)
    first = length - (blocks - 1) * REACH  # the first block takes what is left over
    of = np.repeat(np.arange(len(start)), blocks)
    at = np.cumsum(blocks) - blocks
    nth = np.arange(len(of)) - at[of]
    value = added(data, start[of] + np.where(nth > 0, first[of] + (nth - 1) * REACH, 0), np.where(nth > 0, REACH, first[of]))
    value[at] ^= _LENGTHS[first]
    shift = _SHIFT
    out = value[at]
    many = np.flatnonzero(blocks > 1)
    held, count = value[np.isin(of, many)] if len(many) else value[:0], blocks[many]
    while len(many):  # neighbours are folded in pairs, counted from the end, so that the first block may stay alone
        of = np.repeat(np.arange(len(many)), count)
        nth = np.arange(len(of)) - (np.cumsum(count) - count)[of]
        left = (count[of] - 1 - nth) & 1 == 1
        held[left] = after(held[left], shift)
        pair = (nth + (count[of] & 1)) // 2
        held = np.bitwise_xor.reduceat(held, np.flatnonzero((nth == 0) | (pair != np.roll(pair, 1))))
        count = (count + 1) // 2
        single = count == 1
        ends = np.cumsum(count)
        out[many[single]] = held[ends[single] - 1]
        held, many, count = held[np.repeat(~single, count)], many[~single], count[~single]
        shift = np.stack([after(row, shift) for row in shift])  # twice as far
    return out ^ ALL_ONES


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS, grams: int = GRAMS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every feature of a run of texts, repeats included, and the words of each text."""
    data, rows = _FOLD[data], len(offsets) - 1
    inside = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    if len(data):
        starts[1:] &= ~inside[:-1] | edge[1:-1]
        ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    size = end - start
    end = np.cumsum(size + 1) - 1  # all words again, each followed by one space
    start = end - size
    joined = np.full(int(end[-1]) + 1 if len(end) else 0, 32, np.uint8)
    joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = data[inside]
    found = []
    for n in range(1, grams + 1):
        last = np.arange(n - 1, len(doc))
        last = last[doc[last] == doc[last - n + 1]]
        found.append((doc[last], crcs(joined, start[last - n + 1], end[last]).astype(np.int64) % buckets))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]), np.bincount(doc, minlength=rows)


def counted(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts lie in each bucket; tasks send sums, the driver gets one number a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, data, offsets in text.runs(b.column(0)):
                total += np.bincount(features(data, offsets, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield common.batch(schema, some, total[some])

    schema = common.arrow_schema("bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a weight: a thousand times the log of how much likelier the target has it."""
    s_all, t_all, n = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighed(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, n_words) of every document; target: texts that the drawn ones shall be like.

    Both are counted whole; then documents are hashed again rather than kept as hashes, which would be several times their
    size. Null and empty texts have no features and weigh 0. What goes to tasks is one number a bucket.
    """
    gain = gains(counted(documents, buckets), counted(target, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, offsets in text.runs(b.column(1)):
                rows = len(offsets) - 1
                doc, bucket, words = features(data, offsets, buckets)
                weight = np.zeros(rows, np.int64)
                np.add.at(weight, doc, gain[bucket])
                yield common.batch(schema, b.column(0).slice(at, rows), np.bincount(doc, minlength=rows), weight, words)

    kind = dict(documents.dtypes)["doc_id"]
    out = f"doc_id {kind}, n_features long, weight long, n_words long"
    schema = common.arrow_schema(out.replace("bigint", "long"))
    return documents.select("doc_id", "text").mapInArrow(run, out)


def drawn(weights: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """weights with score and rank: floor(percent N / 100) of the N documents with enough words, by the highest scores.

    A score is the weight plus seeded Gumbel noise, so that drawing the highest ones draws without replacement by weight.
    Ties go to the smaller doc_id. Ranks are counted off by ranges. Rows without doc_id have no score and are never drawn;
    rows that repeat a doc_id are documents of their own.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    since = common.written()
    scored = common.saved(weights, "drawn").withColumn("score", F.col("weight") + noise).withColumn("_in", (F.col("n_words") >= least_words) & F.col("score").isNotNull())
    out = ranked(scored, ["_in"], [F.col("score").desc(), "doc_id"], "_at", total="_of")
    few = F.col("_in") & (F.col("_at") < F.floor(F.col("_of") * percent / 100))
    return common.alone(out.withColumn("rank", F.when(few, F.col("_at") + 1)).drop("_in", "_at", "_of"), "drawn", since)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = weighed(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return drawn(weights).select("doc_id", "n_features", "weight", "score", "rank", "n_words")
