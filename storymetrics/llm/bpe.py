"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Documents are cut into pre-tokens in blocks of about BLOCK_CHARS characters. A block writes the position stream of its
documents (which word stands where, as ranks by frequency) and its distinct words, packed by hash bucket; only those
words are shuffled. A bucket sees a word from every block that has it, encodes it once and sends the ids back to the
blocks (a bucketed table, so that the streams themselves are not shuffled), where they are put in place by the position
stream. Decoding joins the ids with the token-byte table, which has as many rows as the vocabulary, where they are put in
place. A very common word travels once per block, so no key is hot.

Defined results: null and empty texts have no ids; equal rows are encoded separately; an empty table gives an empty
result; extra columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCK_CHARS = 16_000_000
#: Bytes of input for each bucket of words, and the most buckets: a task streams its buckets and holds only their distinct
#: words, which grow far more slowly than the input, while more buckets would only cut the blocks' rows smaller.
BUCKET_BYTES, MOST_BUCKETS = 8_000_000, 4096
PARTS = "block long, bucket int, pack binary, doc_id binary, n_words binary"
ENCODED = "doc_id long, ids binary, decoded binary"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@lru_cache(2)
def merger(path: str):
    """A word (bytes) -> its ids, by the merges that the ranks define; the whole word is one piece."""
    import tiktoken

    whole = tiktoken.Encoding("word", pat_str=r"(?s:.+)", mergeable_ranks=ranks(path), special_tokens={})
    return lambda word: np.array(whole.encode_ordinary(word.decode()), "<u4")


@lru_cache(1)
def splitter():
    """text -> its pre-tokens.

    The pattern library may know letters and digits of a later Unicode version than the tokenizer library; those code
    points are asked for once and taken out of the classes, for texts that hold any byte that could begin one.
    """
    import public_tokenizers
    import tiktoken

    plain = regex.compile(public_tokenizers.PATTERN)
    single = {bytes([i]): i for i in range(256)}
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    classes = {}
    for kind in ("L", "N"):
        known = tiktoken.Encoding(kind, pat_str=rf"\p{{{kind}}}", mergeable_ranks=single, special_tokens={})
        have = set(bytes(known.encode_ordinary(every)).decode())
        odd = sorted(set(regex.findall(rf"\p{{{kind}}}", every)) ^ have)
        classes[kind] = odd, rf"[\p{{{kind}}}--[{''.join(map(regex.escape, odd))}]]" if odd else rf"\p{{{kind}}}"
    odd = [c for o, _ in classes.values() for c in o]
    if not odd:
        return plain.findall
    exact = public_tokenizers.PATTERN
    for kind, (_, known) in classes.items():
        exact = exact.replace(rf"\p{{{kind}}}", known)
    exact = regex.compile(f"(?V1){exact}")
    first = regex.compile(f"[{min(odd)}-\U0010ffff]")
    return lambda text: (plain if text.isascii() or not first.search(text) else exact).findall(text)


def packed(*arrays: np.ndarray | bytes) -> bytes:
    return zstandard.compress(b"".join(len(b := bytes(memoryview(a).cast("B")) if len(a) else b"").to_bytes(8, "little") + b for a in arrays), 3)


def unpacked(pack: bytes) -> list[bytes]:
    data, out, at = zstandard.decompress(pack), [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def planes(values: np.ndarray) -> bytes:
    """uint32 values, all lowest bytes first, then all second ones ...: small numbers compress well."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def block_rows(block: int, doc_ids: list, found: list[list[str]], buckets: int) -> Iterator[tuple]:
    """The rows of one block: its position stream (bucket -1), then its words by bucket, in order of frequency."""
    number: dict[str, int] = {}
    for words in found:
        for w in set(words):
            if w not in number:
                number[w] = len(number)
    total = sum(map(len, found))
    at = np.fromiter(chain.from_iterable(map(number.__getitem__, words) for words in found), np.int64, total)
    by_use = np.argsort(-np.bincount(at, minlength=len(number)), kind="stable")
    rank = np.empty(len(number), np.uint32)
    rank[by_use] = np.arange(len(number), dtype=np.uint32)
    names = [w.encode() for w in number]
    names = [names[i] for i in by_use.tolist()]
    bucket = np.fromiter((zlib.crc32(w) % buckets for w in names), np.uint16, len(names))
    ids = packed(np.array([d is None for d in doc_ids], bool), np.array([d or 0 for d in doc_ids], "<i8"))
    yield block, -1, packed(planes(rank[at]), bucket), ids, packed(np.array([len(w) for w in found], "<i8"))
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        chosen = [names[i] for i in part.tolist()]
        yield block, int(bucket[part[0]]), packed(planes(np.array([len(w) for w in chosen])), b"".join(chosen)), None, None


def blocks(documents: DataFrame, buckets: int, block_chars: int = BLOCK_CHARS) -> DataFrame:
    schema = common.arrow_schema(PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        findall, block = splitter(), TaskContext.get().partitionId() << 32
        ids, found, chars = [], [], 0

        def rows() -> pa.RecordBatch:
            return common.batch(schema, *zip(*block_rows(block, ids, found, buckets)))

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py() or ""
                ids.append(doc_id)
                found.append(findall(text))
                chars += len(text)
                if chars >= block_chars:
                    yield rows()
                    block, ids, found, chars = block + 1, [], [], 0
        if ids:
            yield rows()

    return common.texts(documents).mapInArrow(run, PARTS)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... start + count - 1 of every pair, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def encode(documents: DataFrame, path: str, digests: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) and the bytes that the ids decode to; digests: their count and SHA-256 instead."""
    hint = common.size_hint(documents)
    buckets = common.dealt(hint, BUCKET_BYTES, most=MOST_BUCKETS)
    parts = common.bucketed(blocks(documents, buckets, block_chars), "block", common.dealt(hint, block_chars), "bpe")
    ids_schema, out_schema = common.arrow_schema("block long, bucket int, ids binary"), common.arrow_schema(DIGEST if digests else ENCODED)

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, known = merger(path), {}
        for b in batches:
            out = []
            for block, bucket, pack in zip(*(b.column(c) for c in ("block", "bucket", "pack"))):
                lengths, joined = unpacked(pack.as_py())
                at, ids = 0, []
                for n in unplaned(lengths).tolist():
                    word = joined[at : at + n]
                    at += n
                    have = known.get(word)
                    if have is None:
                        have = known[word] = ids_of(word)
                    ids.append(have)
                counts = np.array([len(x) for x in ids], np.uint32)
                out.append((block.as_py(), bucket.as_py(), packed(planes(counts), planes(np.concatenate(ids)))))
            yield common.batch(ids_schema, *(zip(*out) if out else [[]] * 3))

    def reassemble(streams: pa.Table, words: pa.Table) -> pa.Table:
        table = sorted(ranks(path), key=ranks(path).get)
        size = np.array([len(t) for t in table])
        data, first = np.frombuffer(b"".join(table), np.uint8), np.cumsum(size) - size
        out = []
        for row in streams.to_pylist():
            stream, bucket = unpacked(row["pack"])
            stream, bucket = unplaned(stream), np.frombuffer(bucket, np.uint16)
            nulls, doc_ids = unpacked(row["doc_id"])
            doc_ids = np.where(np.frombuffer(nulls, bool), None, np.frombuffer(doc_ids, "<i8")).tolist()
            n_words = np.frombuffer(unpacked(row["n_words"])[0], "<i8")
            counts, ids = np.zeros(len(bucket), np.int64), []
            order = np.argsort(bucket, kind="stable")
            mine = sorted(zip(words.column("bucket").to_pylist(), words.column("ids").to_pylist()))
            sent = [[unplaned(x) for x in unpacked(pack)] for _, pack in mine]
            if sent:
                counts[order] = np.concatenate([c for c, _ in sent])
                ids = np.concatenate([i for _, i in sent])
            start = np.zeros(len(bucket), np.int64)
            start[order] = np.cumsum(counts[order]) - counts[order]
            ends = np.cumsum(n_words)
            for doc_id, i, j in zip(doc_ids, (ends - n_words).tolist(), ends.tolist()):
                here = stream[i:j]
                doc = ids[spread(start[here], counts[here])].astype("<u4") if j > i else np.zeros(0, "<u4")
                raw, decoded = doc.tobytes(), data[spread(first[doc], size[doc])].tobytes()
                out.append((doc_id, len(doc), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded).hexdigest()) if digests else (doc_id, raw, decoded))
        return pa.Table.from_batches([common.batch(out_schema, *(zip(*out) if out else [[]] * len(out_schema)))])

    words = parts.where("bucket >= 0").select("block", "bucket", "pack").repartition(buckets, "bucket").mapInArrow(encode_words, "block long, bucket int, ids binary")
    streams = parts.where("bucket < 0").drop("bucket")
    return streams.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(reassemble, DIGEST if digests else ENCODED)


def op2_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), digests=True)
