"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, over all overlapping windows.

A word goes in as its own embedding (words of the training sample's vocabulary, whose first coordinate starts at the
word's log odds of the label; one for all others) beside the mean embedding of its character trigrams. Windows of WINDOW words, STRIDE apart and the last one flush with the end, run
through a GRU in both directions; attention pools the states to a logit per window. A document's score comes from its
highest window and its number of windows by a logistic calibration to the labels' base rate. Training is numpy on the
driver, over a bounded sample: at most SAMPLE labelled documents of each label and of at most TRAIN_CHARS characters,
chosen by a hash of doc_id, none of them held out. Scoring reads whole texts, in tasks: the input gates are computed
once for each distinct word of a run of documents.

Defined results: null and empty texts (no words) get the base rate of the label; several labels of one doc_id count as
their maximum; without labels of both kinds every score is the base rate (0 if there are none); equal rows get equal
scores; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, text

#: Words of a window, and from one window to the next: a phrase of up to WINDOW - STRIDE + 1 words lies whole in some window.
WINDOW, STRIDE = 24, 8
SAMPLE, TRAIN_CHARS, VOCABULARY = 2000, 20_000, 20_000
HIDDEN, WORD_DIM, CHAR_DIM, CHAR_BUCKETS = 8, 6, 4, 4096
EPOCHS, BATCH, STEP = 8, 256, 0.01
CUT = 0.3
SCORED = "doc_id long, score double"


class Encoded(NamedTuple):
    """Distinct words: number in the vocabulary (0: none), and their trigram buckets one after the other, with starts."""

    number: np.ndarray
    buckets: np.ndarray
    starts: np.ndarray


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def encoded(data: np.ndarray, w: text.Words, vocabulary: np.ndarray) -> tuple[Encoded, np.ndarray]:
    """The distinct words of a run and the word number at each position; vocabulary: sorted hashes."""
    hashes, first, at = np.unique(w.hash, return_index=True, return_inverse=True)
    found = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
    number = np.where(vocabulary[found] == hashes, found + 1, 0) if len(vocabulary) else np.zeros(len(hashes), np.int64)
    folded = data.astype(np.int64)
    folded[(folded >= 65) & (folded <= 90)] += 32
    start, end = w.start[first], w.end[first]
    place = spread(start, end - start)
    size = end - start
    starts = np.cumsum(size) - size
    here = folded[place]
    before, after = np.roll(here, 1), np.roll(here, -1)
    if len(here):
        before[starts], after[starts + size - 1] = 0, 0
    buckets = ((before * 65_536 + here * 256 + after) * 2_654_435_761 >> 7) % CHAR_BUCKETS
    return Encoded(number, buckets, starts), at


def windows(w: text.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and length of every window."""
    count = np.diff(w.first)
    many = np.where(count > WINDOW, -(-(count - WINDOW) // STRIDE) + 1, (count > 0).astype(np.int64))
    row = np.repeat(np.arange(len(count)), many)
    number = np.arange(len(row)) - (np.cumsum(many) - many)[row]
    start = np.minimum(number * STRIDE, np.maximum(count[row] - WINDOW, 0))
    return row, w.first[row] + start, np.minimum(count[row], WINDOW)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * x.dtype.type(0.5)) * x.dtype.type(0.5) + x.dtype.type(0.5)


class Network:
    """Parameters by name; both directions of the recurrence stand in the first axis."""

    def __init__(self, vocabulary: np.ndarray, odds: np.ndarray):
        r = np.random.default_rng(4)
        dim = WORD_DIM + CHAR_DIM
        normal = lambda *shape: r.normal(0, 0.3, shape).astype(np.float32)
        self.vocabulary = vocabulary
        self.p = {"word": normal(len(vocabulary) + 1, WORD_DIM) * 0.3, "char": normal(CHAR_BUCKETS, CHAR_DIM), "x": normal(2, dim, 3 * HIDDEN), "h": normal(2, HIDDEN, 3 * HIDDEN), "bias": np.zeros((2, 1, 3 * HIDDEN), np.float32), "look": normal(2 * HIDDEN), "out": normal(2 * HIDDEN), "base": np.zeros(1, np.float32)}
        self.p["word"][1:, 0] = odds
        self.calibration = np.array([1.0, 0.0, 0.0])
        self.rate = 0.0

    def inputs(self, e: Encoded) -> np.ndarray:
        """The input vector of each distinct word."""
        size = np.diff(np.append(e.starts, len(e.buckets)))
        char = np.add.reduceat(self.p["char"][e.buckets], e.starts, axis=0) / size[:, None].astype(np.float32) if len(size) else np.zeros((0, CHAR_DIM), np.float32)
        return np.concatenate([self.p["word"][e.number], char], axis=1)

    def gates(self, x: np.ndarray) -> np.ndarray:
        return np.matmul(x[None], self.p["x"]) + self.p["bias"]

    def states(self, gates: np.ndarray, at: np.ndarray, length: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(steps, windows, 2 HIDDEN) states; at: (steps, windows) word numbers; keep: gets what back-propagation needs."""
        steps, n = at.shape
        out = np.empty((steps, n, 2 * HIDDEN), np.float32)
        h = np.zeros((2, n, HIDDEN), np.float32)
        full = bool((length == steps).all())
        for t in range(steps):
            both = at[t], at[steps - 1 - t]
            g = np.stack([gates[0][both[0]], gates[1][both[1]]])
            u = np.matmul(h, self.p["h"])
            zr = sigmoid(g[:, :, : 2 * HIDDEN] + u[:, :, : 2 * HIDDEN])
            z, r = zr[:, :, :HIDDEN], zr[:, :, HIDDEN:]
            c = np.tanh(g[:, :, 2 * HIDDEN :] + r * u[:, :, 2 * HIDDEN :])
            new = c + z * (h - c)
            mask = None
            if not full:
                mask = np.stack([t < length, steps - 1 - t < length])[:, :, None].astype(np.float32)
                new = h + mask * (new - h)
            if keep is not None:
                keep.append((both, h, z, r, c, u[:, :, 2 * HIDDEN :], mask))
            h = new
            out[t, :, :HIDDEN], out[steps - 1 - t, :, HIDDEN:] = h[0], h[1]
        return out

    def pooled(self, states: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        look = states @ self.p["look"]
        look[np.arange(len(look))[:, None] >= length[None]] = -1e9
        weight = np.exp(look - look.max(axis=0))
        weight /= weight.sum(axis=0)
        pool = (weight[:, :, None] * states).sum(axis=0)
        return pool @ self.p["out"] + self.p["base"], pool, weight

    def logits(self, e: Encoded, words: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        gates = self.gates(self.inputs(e))
        out = np.empty(len(first), np.float32)
        for i in range(0, len(first), 4096):
            f, n = first[i : i + 4096], length[i : i + 4096]
            at = words[np.minimum(f[None] + np.arange(WINDOW)[:, None], len(words) - 1)]
            out[i : i + 4096] = self.pooled(self.states(gates, at, n), n)[0]
        return out

    def gradient(self, e: Encoded, at: np.ndarray, length: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, x = self.p, self.inputs(e)
        kept: list = []
        states = self.states(self.gates(x), at, length, kept)
        logit, pool, weight = self.pooled(states, length)
        d = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
        out = {"out": pool.T @ d, "base": d.sum(keepdims=True)}
        d_pool = d[:, None] * p["out"]
        d_weight = (states * d_pool).sum(axis=2)
        d_look = weight * (d_weight - (weight * d_weight).sum(axis=0))
        out["look"] = np.einsum("tn,tnh->h", d_look, states)
        d_states = weight[:, :, None] * d_pool + d_look[:, :, None] * p["look"]
        steps = len(at)
        d_gates = np.zeros((2, len(x), 3 * HIDDEN), np.float32)
        out["h"], d_h = np.zeros_like(p["h"]), np.zeros_like(kept[0][1])
        for t in range(steps - 1, -1, -1):
            both, h, z, r, c, u, mask = kept[t]
            d_h = d_h + np.stack([d_states[t, :, :HIDDEN], d_states[steps - 1 - t, :, HIDDEN:]])
            d_new = d_h if mask is None else d_h * mask
            rest = 0 if mask is None else d_h * (1 - mask)
            d_c = d_new * (1 - z) * (1 - c * c)
            d_z = d_new * (h - c) * z * (1 - z)
            d_r = d_c * u * r * (1 - r)
            d_g, d_u = np.concatenate([d_z, d_r, d_c], axis=2), np.concatenate([d_z, d_r, d_c * r], axis=2)
            out["h"] += np.matmul(h.transpose(0, 2, 1), d_u)
            d_h = rest + d_new * z + np.matmul(d_u, p["h"].transpose(0, 2, 1))
            for k in (0, 1):
                np.add.at(d_gates[k], both[k], d_g[k])
        out["x"], out["bias"] = np.matmul(x.T[None], d_gates), d_gates.sum(axis=1, keepdims=True)
        d_x = np.matmul(d_gates, p["x"].transpose(0, 2, 1)).sum(axis=0)
        out["word"], out["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(out["word"], e.number, d_x[:, :WORD_DIM])
        size = np.diff(np.append(e.starts, len(e.buckets)))
        np.add.at(out["char"], e.buckets, np.repeat(d_x[:, WORD_DIM:] / size[:, None], size, axis=0))
        return out


def document_logits(network: Network, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The highest window logit and the number of windows of each row (no words: 0 windows)."""
    w = text.words(data, offsets, fold=True)
    row, first, length = windows(w)
    many = np.bincount(row, minlength=len(offsets) - 1)
    high = np.full(len(many), -np.inf)
    if len(row):
        e, at = encoded(data, w, network.vocabulary)
        high[many > 0] = np.maximum.reduceat(network.logits(e, at, first, length), (np.cumsum(many) - many)[many > 0])
    return high, many


def features(high: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.stack([high, np.log(np.maximum(many, 1)), np.ones(len(high))], axis=1)


def scores(network: Network, high: np.ndarray, many: np.ndarray) -> np.ndarray:
    x = features(np.where(many > 0, high, 0.0), many) @ network.calibration
    return np.where(many > 0, 1 / (1 + np.exp(-np.clip(x, -30, 30))), network.rate)


def train(texts: list[str], y: np.ndarray, rate: float) -> Network:
    """A network from labelled texts; rate: the share of label 1 among all labelled rows that are not held out.

    Every fourth text of each label is left to the calibration, unless there are fewer than 100 of a label.
    """
    if not len(y) or not 0 < y.sum() < len(y):
        network = Network(np.zeros(0, np.uint64), np.zeros(0))
        network.calibration, network.rate = np.array([0.0, 0.0, np.log((rate + 1e-9) / (1 - rate + 1e-9))]), rate
        return network
    order = np.concatenate([np.flatnonzero(y > 0), np.flatnonzero(y == 0)])
    turn = np.concatenate([np.arange((y > 0).sum()), np.arange((y == 0).sum())]) % 4 == 3
    spare = order[turn] if min((y > 0).sum(), (y == 0).sum()) >= 100 else order
    taught = order[~turn] if len(spare) < len(order) else order
    kept_texts, kept_y = [texts[i] for i in spare], y[spare]
    texts, y = [texts[i] for i in taught], y[taught]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    w = text.words(data, offsets, fold=True)
    doc, h = text.distinct(w.doc, w.hash)
    names, at = np.unique(h, return_inverse=True)
    of_one = np.bincount(at, y[doc], len(names))
    of_none = np.bincount(at, 1 - y[doc], len(names))
    ones, nones = y.sum(), (1 - y).sum()
    odds = np.log((of_one + 0.5) / (ones + 1)) - np.log((of_none + 0.5) / (nones + 1))
    odds /= np.sqrt(1 + 4 / (of_one + of_none))
    sure = np.abs(odds) * np.sqrt(of_one + of_none) > 4
    common_ones = np.sort(np.argsort(-(of_one + of_none) * ((of_one + of_none) >= 3), kind="stable")[:VOCABULARY])
    network = Network(names[common_ones], (odds * sure)[common_ones])
    weight = np.append(np.clip(odds * sure, 0, None), 0)
    evidence = np.append(0, np.cumsum(weight[np.searchsorted(names, w.hash)]))
    row, first, length = windows(w)
    gain = evidence[first + length] - evidence[first]
    random = np.random.default_rng(5)
    order = np.lexsort((random.random(len(row)), -gain, row))
    rank = np.arange(len(row)) - np.searchsorted(row[order], row[order])
    chosen = order[np.where(y[row[order]] > 0, rank < 1, (rank < 2) | (random.random(len(row)) < 2 / np.maximum(np.bincount(row, minlength=len(y))[row[order]], 2)))]
    e, words = encoded(data, w, network.vocabulary)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in network.p.items()}
    n = 0
    for epoch in range(EPOCHS):
        random.shuffle(chosen)
        for i in range(0, len(chosen), BATCH):
            part = chosen[i : i + BATCH]
            used, at = np.unique(words[np.minimum(first[part][None] + np.arange(WINDOW)[:, None], len(words) - 1)], return_inverse=True)
            size = np.diff(np.append(e.starts, len(e.buckets)))[used]
            some = Encoded(e.number[used], e.buckets[spread(e.starts[used], size)], np.cumsum(size) - size)
            n += 1
            for k, g in network.gradient(some, at.reshape(WINDOW, -1), length[part], y[row[part]].astype(np.float32)).items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                network.p[k] -= STEP * (0.5 if epoch >= EPOCHS // 2 else 1) * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.999**n)) + 1e-8)
    high, many = (np.concatenate(x) for x in zip(*(document_logits(network, d, o) for _, d, o in text.runs(pa.array(kept_texts, pa.large_string())))))
    has = many > 0
    x, target = features(high[has], many[has]), kept_y[has]
    balance = np.where(target > 0, rate / max(1, target.sum()), (1 - rate) / max(1, (1 - target).sum())) * len(target)
    beta = np.array([1.0, 0.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (balance * (p - target)) + 1e-2 * beta
        beta -= np.linalg.solve((x * (balance * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3), slope) * 0.7
    network.calibration, network.rate = beta, rate
    return network


def held_out(doc_id: str | Column) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(documents: DataFrame, labels: DataFrame) -> Network:
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = {r["toxic"] > 0: r["n"] for r in marked.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    rate = total.get(True, 0) / max(1, sum(total.values()))
    usable = documents.where(F.col("text").isNotNull() & (F.length("text") <= TRAIN_CHARS)).select("doc_id", "text")
    rows = []
    for side, of in ((F.col("toxic") > 0, True), (F.col("toxic") <= 0, False)):
        most, found = SAMPLE + SAMPLE // 2, []
        while True:  # more labels are taken while too many of them have no usable text; SAMPLE texts at most come here
            some = marked.where(side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
            found = usable.join(some.hint("broadcast" if most <= common.BROADCAST_ROWS else "merge"), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(SAMPLE).collect()
            if len(found) >= SAMPLE or most >= total.get(of, 0):
                break
            most *= 8
        rows += found
    return train([r["text"] for r in rows], np.array([float(r["toxic"] > 0) for r in rows]), rate)


def score(documents: DataFrame, network: Network) -> DataFrame:
    """doc_id and score; the network is broadcast: its size is bounded by VOCABULARY and CHAR_BUCKETS."""
    schema, shared = common.arrow_schema(SCORED), documents.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, offsets in text.runs(b.column(1)):
                yield common.batch(schema, b.column(0).slice(first, len(offsets) - 1), scores(shared.value, *document_logits(shared.value, data, offsets)))

    return common.texts(documents).mapInArrow(run, SCORED)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    found = score(documents, fit(documents, common.table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
