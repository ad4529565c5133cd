"""MinHash fingerprints of documents, banded joins of them, and likeness to an edited text and to the next document.

A fingerprint holds, for each of PERMUTATIONS universal hash permutations a x + b modulo 2**32 (a odd), the low 16 bits
of the least value over the document's word shingles; all of it is vectorised numpy over runs of documents. Documents
whose fingerprints agree on a band are joined in Spark, and what a group of them links is verified by exact Jaccard
similarity of the shingle sets. Letters A-Z count as a-z throughout.

For the next document in descending order of doc_id, documents are dealt to ranges of doc_id, and the first of each
range goes to the range before as well (that of the first range to the last), so no order over all rows is made.

Defined results: a null text is empty; texts without words share one fingerprint; equal doc_ids are ordered by text; a
null doc_id comes last; the only document is its own next; an empty table gives an empty result; extra columns stay out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, ngram_join, text

WORDS, PERMUTATIONS, BANDS, PERCENT = 5, 128, 25, 80
RANGE_BYTES = 6_000_000
#: Band values that a task combines at a time.
HELD_KEYS = 1 << 21
#: Characters whose fingerprints a task makes at a time.
HELD_CHARS = 4_000_000
FIRST = np.iinfo(np.int64).min
EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
BANDED = "a long, b long, part int, keys binary, ids binary"
DEALT = "bucket int, guest boolean, doc_id long, text string"
_random = np.random.default_rng(8)
_A = _random.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _random.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)


def signatures(column: pa.Array, k: int = WORDS) -> np.ndarray:
    """A row of PERMUTATIONS 16-bit values for each text."""
    out = np.full((len(column), PERMUTATIONS), 0xFFFF, np.uint16)
    for first, data, offsets in text.runs(column, 1 << 18):
        doc, h = text.shingles(text.words(data, offsets, fold=True), k)
        if not len(doc):
            continue
        x = (h >> np.uint64(32)).astype(np.uint32)
        start = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        rows = first + doc[start]
        value = np.empty_like(x)
        for p in range(PERMUTATIONS):
            np.multiply(x, _A[p], out=value)
            value += _B[p]
            out[rows, p] = np.minimum.reduceat(value, start).astype(np.uint16)
    return out


def shown(signature: np.ndarray) -> list[str]:
    """The fingerprints as hexadecimal digits, four for each permutation."""
    return [row.tobytes().hex() for row in signature.astype(">u2")]


def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x == y).mean(axis=1)


def bands(signature: np.ndarray) -> np.ndarray:
    """(documents, BANDS) hashes of each band's number and values."""
    each = PERMUTATIONS // BANDS
    values = signature[:, : BANDS * each].reshape(-1, BANDS, each).astype(np.uint64)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), values.shape[:2])
    for i in range(each):
        keys = text.mix(keys * np.uint64(text.WINDOW_BASE) + values[:, :, i] + np.uint64(1))
    return keys


def starred(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (smallest id, other id) pairs of equal keys, and the keys, sorted, with their smallest ids."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    low = ids[new][np.cumsum(new) - 1] if len(ids) else ids
    apart = low != ids
    return np.unique(np.stack([low[apart], ids[apart]]), axis=1), keys[new], ids[new]


def banded(documents: DataFrame, k: int = WORDS) -> DataFrame:
    """(a, b): links of documents that share a band, a star for each band's value.

    A task makes one entry of all its documents with the same value, so that a value of a third of all documents costs
    an entry a task; entries meet by ranges of values.
    """
    schema, ranges = common.arrow_schema(BANDED), common.dealt(common.size_hint(documents), 64_000_000, 24, 1 << 16)

    def sent(keys: list[np.ndarray], ids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        pairs, key, low = starred(np.concatenate(keys), np.concatenate(ids))
        cuts = np.searchsorted(key, (np.arange(1, ranges, dtype=np.float64) * (2.0**64 / ranges)).astype(np.uint64))
        rows = [(None, None, i, *ngram_join.packed(x, y)) for i, (x, y) in enumerate(zip(np.split(key, cuts), np.split(low, cuts))) if len(x)]
        yield common.batch(schema, pairs[0], pairs[1], *[[None] * pairs.shape[1]] * 3)
        yield common.batch(schema, *(zip(*rows) if rows else [[]] * 5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, held = [], [], 0
        for b in batches:
            found = bands(signatures(b.column(1), k))
            keys.append(found.ravel())
            ids.append(np.repeat(b.column(0).to_numpy(), BANDS))
            held += found.size
            if held >= HELD_KEYS:
                yield from sent(keys, ids)
                keys, ids, held = [], [], 0
        if held:
            yield from sent(keys, ids)

    def meet(group: pa.Table) -> pa.Table:
        keys, ids = (np.concatenate(x) for x in zip(*(ngram_join.unpacked(a.as_py(), b.as_py()) for a, b in zip(group["keys"], group["ids"]))))
        pairs = starred(keys, ids)[0]
        return pa.table([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    made = common.saved(common.texts(documents).where("doc_id IS NOT NULL").mapInArrow(run, BANDED), "bands")
    far = made.where("part IS NOT NULL").select("part", "keys", "ids").groupBy("part").applyInArrow(meet, "a long, b long")
    return made.where("part IS NULL").select("a", "b").union(far)


def near_duplicates(documents: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, component_id of the documents that have links: the smallest doc_id reached over verified links.

    Documents with equal sets are linked; of others, those that share a band, directly or over others, are compared by
    the exact Jaccard similarity of their sets. With BANDS bands of five values the chance to miss a pair at a
    similarity of 0.8 is below one in ten thousand.
    """
    since = common.written()
    classed = ngram_join.classes(documents, k)
    group = common.components(banded(documents, k), "groups")
    reps = classed.where("doc_id = rep").select("doc_id").distinct().join(group.withColumnRenamed("node", "doc_id"), "doc_id")
    several = reps.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    chosen = common.saved(reps.join(several, "component").select("doc_id", F.col("component").alias("block")), "chosen")
    found = common.components(ngram_join.links(ngram_join.members(documents, chosen, k), percent, ngram_join.parts(documents)), "near").withColumnRenamed("node", "rep")
    linked = classed.where("doc_id IS NOT NULL").join(found, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    return common.alone(linked.groupBy("doc_id").agg(F.min("component_id").alias("component_id")).where("component_id <> doc_id"), "near", since)


def dealt(documents: DataFrame) -> DataFrame:
    """The documents by range of doc_id, the largest of each range also as a guest of the next higher range."""
    source = common.texts(documents).withColumn("doc_id", F.col("doc_id").cast("long"))
    n = common.dealt(common.size_hint(documents), RANGE_BYTES, 24, 4096)
    key = F.coalesce("doc_id", F.lit(FIRST))
    cuts = source.select(F.percentile_approx(key, [i / n for i in range(1, n)], 10 * n).alias("cuts")).first()["cuts"]
    bounds = np.unique(np.array(cuts or [], np.int64))
    of = lambda ids: np.searchsorted(bounds, ids, "left")

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, int] = {}
        for b in batches:
            ids = b.column(0).to_numpy()
            for k, i in zip(of(ids).tolist(), ids.tolist()):
                top[k] = max(top.get(k, i), i)
        yield pa.RecordBatch.from_arrays([pa.array(top.keys(), pa.int32()), pa.array(top.values(), pa.int64())], ["bucket", "top"])

    largest = {r["bucket"]: r["top"] for r in source.select(key.alias("id")).mapInArrow(tops, "bucket int, top long").groupBy("bucket").agg(F.max("top").alias("top")).collect()}
    order = sorted(largest)
    sent_to = {largest[k]: order[(i + 1) % len(order)] for i, k in enumerate(order)}
    guests = np.array(sorted(sent_to), np.int64)
    schema = common.arrow_schema(DEALT)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).fill_null(FIRST).to_numpy()
            yield common.batch(schema, of(ids), np.zeros(len(ids), bool), b.column(0), b.column(1))
            also = np.flatnonzero(np.isin(ids, guests))
            if len(also):
                rows = b.take(pa.array(also))
                yield common.batch(schema, [sent_to[i] for i in ids[also].tolist()], np.ones(len(also), bool), rows.column(0), rows.column(1))

    return source.mapInArrow(deal, DEALT).repartition("bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "text")


def edited_pairs(documents: DataFrame, k: int = WORDS) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how alike they and the next document's are.

    Edited: the last third of the code points (rounded down) is replaced by as many first ones of the next document.
    """
    schema = common.arrow_schema(EDITED)

    def judged(ids: list, texts: list[str], after: str) -> pa.RecordBatch:
        edited = []
        for mine, other in zip(texts, [*texts[1:], after]):
            cut = len(mine) // 3
            edited.append(mine[: len(mine) - cut] + other[:cut])
        own, changed = signatures(pa.array([*texts, after], pa.large_string()), k), signatures(pa.array(edited, pa.large_string()), k)
        hashes = [hashlib.sha256(t.encode()).hexdigest() for t in edited]
        return common.batch(schema, ids, [len(t) for t in texts], hashes, shown(own[:-1]), shown(changed), alike(own[:-1], changed), alike(own[:-1], own[1:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a range come in order, its guest last; HELD_CHARS of texts are judged at a time, with the row after them."""
        ids, texts, chars, now = [], [], 0, None
        for b in batches:
            for bucket, guest, doc_id, t in zip(*(b.column(i).to_pylist() for i in range(4))):
                if bucket != now and texts:
                    raise ValueError("a range has no guest")
                now = bucket
                if texts and (guest or chars >= HELD_CHARS):
                    yield judged(ids, texts, t)
                    ids, texts, chars = [], [], 0
                if not guest:
                    ids.append(doc_id)
                    texts.append(t)
                    chars += len(t)
        if texts:
            raise ValueError("a range has no guest")

    return dealt(documents).mapInArrow(run, EDITED)


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    near = near_duplicates(documents)
    found = edited_pairs(documents).join(common.sided(near), "doc_id", "left")
    return found.withColumn("component_id", F.coalesce("component_id", "doc_id"))
