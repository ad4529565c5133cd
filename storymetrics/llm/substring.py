"""Substring dedup: Rabin-Karp hashes of every window of consecutive words, counted over all documents.

Documents are dealt to blocks by a hash of their id, and every exchange is between blocks and hash buckets, so that a
window that a third of all documents share costs one entry a block. Two equal windows have the same least hash of ten
consecutive words, and one such hash is the least of about twenty windows in a row; windows whose least hash stands in
no other document are counted once where they are, without travelling. Of the rest, each block sends its distinct
window hashes (128 bits, from two independent hashes of the words) with the smallest id it has them from, gets back smaller ids that other blocks have, and
merges the repeated windows into maximal removal intervals.

Defined results: a null text has no words; a null doc_id counts as larger than any other; rows with the same doc_id are
one document as far as "smaller" goes, so they don't remove each other; texts shorter than a window stay whole; an
empty table gives an empty result; extra columns are left out unless they are named in `more`.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, text

WINDOW, GRAM = 50, 10
BLOCK_BYTES, BUCKET_BYTES = 3_000_000, 8_000_000
LAST = np.iinfo(np.int64).max
SENT = "block int, bucket int, a binary, b binary, ids binary"
BACK = "block int, a binary, ids binary"


def least(values: np.ndarray, k: int) -> np.ndarray:
    """The least of every k consecutive values, by doubling."""
    if len(values) < k:
        return values[:0]
    have, n = values, 1
    while 2 * n <= k:
        have, n = np.minimum(have[:-n], have[n:]), 2 * n
    return np.minimum(have[: len(have) - (k - n)], have[k - n :]) if n < k else have


class Run:
    """The windows of a run of documents: doc (row), at (first word), anchor (least gram hash), a and b (window hash)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, gram: int):
        self.words = w = text.words(data, offsets)
        n = max(0, len(w.hash) - window + 1)
        self.at = np.flatnonzero(w.doc[:n] == w.doc[window - 1 :]) if n else np.zeros(0, np.int64)
        self.doc = w.doc[self.at]
        self.anchor = least(text.windows(w.hash, gram), window - gram + 1)[self.at] if n else np.zeros(0, np.uint64)
        self.data, self.window = data, window

    def hashes(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.at[chosen]
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        second = text.second_hash(self.data, self.words)
        return text.windows(self.words.hash, self.window, text.WINDOW_BASE)[at], text.windows(second, self.window, text.WINDOW_BASE_2)[at]


def firsts(doc: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys, sorted by the first, each with its smallest and its largest document."""
    order = np.lexsort((doc, *keys[::-1]))
    doc, keys = doc[order], [k[order] for k in keys]
    new = np.ones(len(doc), bool)
    if len(doc):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return (*(k[first] for k in keys), doc[first], doc[last] if len(doc) else doc)


def member(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value: whether it is in the sorted array, and where."""
    if not len(known):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values, at


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(LAST).combine_chunks().to_numpy(zero_copy_only=False)


def sent(block: int, buckets: int, a: np.ndarray, *more: np.ndarray) -> pa.Table:
    """Sorted hashes a with what goes with them, a row for each bucket (range of a)."""
    cuts = np.searchsorted(a, (np.arange(1, buckets, dtype=np.float64) * (2.0**64 / buckets)).astype(np.uint64))
    edges = [0, *cuts.tolist(), len(a)]
    rows = [(block, k, a[i:j].tobytes(), *((m[i:j].tobytes() for m in more) if more else (None, None))) for k, (i, j) in enumerate(zip(edges, edges[1:])) if j > i]
    schema = common.arrow_schema(SENT)
    return pa.Table.from_batches([common.batch(schema, *(zip(*rows) if rows else [[]] * 5))])


def joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() or b"" for x in column), kind)


def elsewhere(group: pa.Table) -> pa.Table:
    """The hashes of a bucket that more than one block has, for each of those blocks."""
    a = joined(group["a"], np.uint64)
    block = np.repeat(numbers(group["block"]), [len(x.as_py()) // 8 for x in group["a"]])
    value, count = np.unique(a, return_counts=True)
    hit = member(a, value[count > 1])[0]
    return back(block[hit], a[hit], None)


def smaller(group: pa.Table) -> pa.Table:
    """The smallest id that has a window, for each block that has the window from larger ids only."""
    a, b, ids = joined(group["a"], np.uint64), joined(group["b"], np.uint64), joined(group["ids"], np.int64)
    block = np.repeat(numbers(group["block"]), [len(x.as_py()) // 8 for x in group["a"]])
    order = np.lexsort((ids, b, a))
    a, b, ids, block = a[order], b[order], ids[order], block[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    least_id = ids[new][np.cumsum(new) - 1]
    hit = least_id < ids
    return back(block[hit], a[hit], least_id[hit])


def back(block: np.ndarray, a: np.ndarray, ids: np.ndarray | None) -> pa.Table:
    order = np.argsort(block, kind="stable")
    block, a = block[order], a[order]
    ids = ids[order] if ids is not None else None
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)] if len(block) else [0]
    rows = [(int(block[i]), a[i:j].tobytes(), ids[i:j].tobytes() if ids is not None else None) for i, j in zip(edges, edges[1:])]
    return pa.Table.from_batches([common.batch(common.arrow_schema(BACK), *(zip(*rows) if rows else [[]] * 3))])


def dedup(documents: DataFrame, window: int = WINDOW, more: tuple[str, ...] = (), rejoin: bool = True) -> DataFrame:
    """doc_id, `more`, n_words, n_removed, kept (text), removed (list of [first word, end word) intervals).

    kept: the words that stay, joined by one space; with rejoin=False a document that loses nothing keeps its text as is.
    """
    gram = min(GRAM, window)
    hint = common.size_hint(documents)
    n_blocks, buckets = common.dealt(hint, BLOCK_BYTES, 48, 1 << 22), common.dealt(hint, BUCKET_BYTES, 24, 1 << 16)
    source = common.texts(documents, *more).withColumn("block", common.hashed("doc_id", n_blocks))
    by_block = source.groupBy("block")

    def parts(group: pa.Table):
        ids = numbers(group["doc_id"])
        for first, data, offsets in text.runs(group["text"]):
            yield first, ids[first : first + len(offsets) - 1], data, offsets, Run(data, offsets, window, gram)

    def anchors(group: pa.Table) -> pa.Table:
        found = [np.unique(r.anchor) for *_, r in parts(group)]
        return sent(group["block"][0].as_py(), buckets, np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64))

    def known(group: pa.Table, hits: pa.Table) -> tuple[np.ndarray, list]:
        """The least hashes that stand in other documents too, and the runs."""
        all_parts = list(parts(group))
        anchor, doc = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in ([r.anchor for *_, r in all_parts], [ids[r.doc] for _, ids, _, _, r in all_parts]))
        if not len(anchor):
            return np.zeros(0, np.uint64), all_parts
        value, low, high = firsts(doc, anchor.astype(np.uint64))
        return np.union1d(value[low < high], joined(hits["a"], np.uint64)), all_parts

    def candidates(group: pa.Table, hits: pa.Table):
        shared, all_parts = known(group, hits)
        for first, ids, data, offsets, r in all_parts:
            chosen = np.flatnonzero(member(r.anchor, shared)[0])
            yield first, ids, data, offsets, r, chosen, *r.hashes(chosen)

    def own(found: list) -> tuple[np.ndarray, ...]:
        a, b, doc = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in ([f[6] for f in found], [f[7] for f in found], [f[1][f[4].doc[f[5]]] for f in found]))
        return firsts(doc.astype(np.int64), a, b)

    def count(group: pa.Table, hits: pa.Table) -> pa.Table:
        if not group.num_rows:
            return common.arrow_schema(SENT).empty_table()
        a, b, low, _ = own(list(candidates(group, hits)))
        return sent(group["block"][0].as_py(), buckets, a, b, low)

    out_type = source.select("doc_id", *more).schema
    for name, kind in (("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept", T.StringType()), ("removed", T.ArrayType(T.ArrayType(T.LongType())))):
        out_type = out_type.add(name, kind)
    out_schema = common.arrow_schema(out_type)

    def remove(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            return out_schema.empty_table()
        hits = pa.table({"a": [x for x, i in zip(answers["a"].to_pylist(), answers["ids"].to_pylist()) if i is None]}, pa.schema([("a", pa.binary())]))
        found = list(candidates(group, hits))
        a, b, low, _ = own(found)
        far = [(x, i) for x, i in zip(answers["a"].to_pylist(), answers["ids"].to_pylist()) if i is not None]
        if far:
            fa, fi = np.frombuffer(b"".join(x for x, _ in far), np.uint64), np.frombuffer(b"".join(i for _, i in far), np.int64)
            order = np.lexsort((fi, fa))
            there, at = member(a, fa[order])
            low = np.where(there, np.minimum(low, fi[order][at]), low)
        kept, n_words, n_removed, removed = [], [], [], []
        for first, ids, data, offsets, r, chosen, ha, hb in found:
            cover = np.zeros(len(r.words.hash) + 1, np.int64)
            if len(chosen):
                at = np.searchsorted(a, ha)
                while True:  # equal first halves: step to the equal second half
                    wrong = b[at] != hb
                    if not wrong.any():
                        break
                    at = at + wrong
                gone = r.at[chosen][low[at] < ids[r.doc[chosen]]]
                np.add.at(cover, gone, 1)
                np.add.at(cover, gone + window, -1)
            stay = np.cumsum(cover[:-1]) == 0
            per_doc = np.diff(r.words.first)
            for k, n in enumerate(per_doc.tolist()):
                i = int(r.words.first[k])
                mask = stay[i : i + n]
                lost = n - int(mask.sum())
                raw = data[offsets[k] : offsets[k + 1]].tobytes()
                if lost or rejoin:
                    raw = b" ".join(compress(raw.split(), mask.tolist()) if lost else raw.split())
                kept.append(raw.decode("utf-8", "replace"))
                n_words.append(n)
                n_removed.append(lost)
                edge = np.flatnonzero(np.diff(np.concatenate([[True], mask, [True]]).astype(np.int8))) if lost else np.zeros(0, np.int64)
                removed.append(edge.reshape(-1, 2).tolist())
        done = {"n_words": n_words, "n_removed": n_removed, "kept": kept, "removed": removed}
        return pa.table([pa.array(done[f.name], f.type) if f.name in done else group[f.name].cast(f.type) for f in out_schema], schema=out_schema)

    hits = by_block.applyInArrow(anchors, SENT).select("block", "bucket", "a").groupBy("bucket").applyInArrow(elsewhere, BACK)
    windows = by_block.cogroup(hits.groupBy("block")).applyInArrow(count, SENT)
    answers = hits.union(windows.groupBy("bucket").applyInArrow(smaller, BACK))
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(remove, out_type)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
