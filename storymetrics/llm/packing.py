"""Best-fit packing of tokenised documents into fixed-length sequences by a configuration linear program.

Tokenising is one narrow pass. All that meets on the driver is the histogram of piece lengths, which has at most
`capacity` entries whatever the corpus: a configuration (a multiset of lengths that fits one sequence) gets a
fractional multiplicity from a covering linear program, which is solved from nothing by multiplicative weights whose
pricing problem is an unbounded knapsack over `capacity` cells. The multiplicities are rounded, what the rounding leaves
is a smaller histogram that goes through the program again, and best fit places the last pieces, a few hundred at most. For some
hundred pieces in all rounding can cost more than best fit loses; then best fit's plan is taken, and logged. The plan is a list of runs (length, first rank, how many, first sequence, offset), a few thousand rows at most; each piece
finds its place by its rank among the pieces of its length.

Defined results: a null text is empty; an empty text is one piece holding the end id; equal rows are packed
separately; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import json
import logging
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

CAPACITY, END_ID = 1024, 2
#: Rounds of multiplicative weights; how much of a length's rest a round may cover; how strongly a covered length loses
#: weight (both are tried); how much more a longer piece is worth for its size; the share of the length that counts as none.
ROUNDS, RATE, SLOPES, FULLER, SETTLED = 120, 0.5, (0.3, 0.05), 0.1, 1e-4
#: How often the program covers a part of its solution anew, and which share of the full configurations at first.
TRIALS, SHARE = 3, 0.3
#: How often what rounding leaves is put through the program, and pieces that are left to best fit.
DIVES, FEW = 12, 48
LOG = logging.getLogger(__name__)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


@lru_cache(2)
def encoder(path: str):
    """texts -> list of ids, as the tokenizer file defines them.

    Ordinary texts go through the rank encoder, made from the vocabulary of the file; a text that holds the string of
    one of its added tokens goes through the file's own tokenizer, which cuts that string out as one id.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    added = [t["content"] for t in spec["added_tokens"]]
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(t in text for t in added):
            return own.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones at the end, the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece of every document, with its rank `nth` among the pieces of its length in its partition `part`."""
    schema = common.arrow_schema(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(path), TaskContext.get().partitionId(), Counter()
        for b in batches:
            out: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    out.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), part, seen[length]))
                    seen[length] += 1
            yield common.batch(schema, *(zip(*out) if out else [[]] * len(schema)))

    return common.texts(documents).mapInArrow(run, PIECES)


def knapsack(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to the capacity the most valuable configuration's value and the length that it takes first (0: none).

    value[s]: of one piece of length s, 0 if there is none.
    """
    worth = np.where(value[: capacity + 1] > 0, value[: capacity + 1], -np.inf)[1:]
    best, taken = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        gain = worth[:c] + best[c - 1 :: -1]  # by the length that is taken first, 1 to c
        i = int(gain.argmax())
        best[c] = best[c - 1]
        if gain[i] > best[c] + 1e-15:
            best[c], taken[c] = gain[i], i + 1
    return best, taken


def filled(taken: np.ndarray, first: int, capacity: int) -> Counter:
    """The configuration that holds one piece of length `first` and the most valuable rest."""
    out, room = Counter({first: 1}), capacity - first
    while room > 0:
        if taken[room]:
            out[int(taken[room])] += 1
            room -= int(taken[room])
        else:
            room -= 1
    return out


def covered(demand: np.ndarray, capacity: int, slope: float) -> tuple[dict[tuple[int, ...], float], float]:
    """Multiplicities of configurations that cover demand[s] pieces of each length s, by multiplicative weights, and a bound.

    A length's price is its size times a weight that falls exponentially with the share of its demand that is covered.
    One knapsack table prices, for every length, the best configuration that holds it; from the most valuable on, each is
    taken as often as leaves (1 - RATE) of what every length in it needed when the round began. The little that is left
    after ROUNDS is covered by configurations of one length. Prices divided by what the best configuration is worth are
    dual feasible, so the demand at these prices is below every cover: the best of all rounds is the bound.
    """
    size, left, out, bound = np.arange(capacity + 1), demand.copy(), defaultdict(float), float(demand @ np.arange(capacity + 1)) / capacity
    for _ in range(ROUNDS):
        if left @ size <= SETTLED * (demand @ size):
            break
        live = left > 1e-9 * demand
        value = np.where(live, size * (1 + FULLER * size / capacity) * np.exp(slope * (left / np.maximum(demand, 1e-300) - 1)), 0.0)
        best, taken = knapsack(value, capacity)
        bound = max(bound, float(demand @ value) / best[capacity])
        floor = (1 - RATE) * left
        lengths = np.flatnonzero(live)
        for s in lengths[np.argsort(-(value[lengths] + best[capacity - lengths]), kind="stable")].tolist():
            config = filled(taken, s, capacity)
            which, uses = np.array(list(config)), np.array(list(config.values()))
            amount = ((left[which] - floor[which]) / uses).min()
            if amount > 0:
                out[tuple(sorted(config.elements()))] += amount
                left[which] -= uses * amount
    for s in np.flatnonzero(left > 0).tolist():
        out[(s,) * (capacity // s)] += left[s] / (capacity // s)
    return out, bound


def fractional(histogram: dict[int, int], capacity: int, trials: int = TRIALS, slopes: tuple[float, ...] = SLOPES) -> tuple[dict[tuple[int, ...], float], float]:
    """A near-optimal solution of the configuration program, made of priced configurations only, and a bound below every solution.

    The whole histogram is covered with each of the slopes. Of the cheaper solution, a share of all full configurations and all
    of those with room to spare are then covered anew, `trials` times; a cheaper cover is kept, else the share halves.
    """
    demand = np.zeros(capacity + 1)
    for s, n in histogram.items():
        demand[s] = n
    found = [(*covered(demand, capacity, slope), slope) for slope in slopes]
    now, _, slope = min(found, key=lambda x: sum(x[0].values()))
    bound, share = max(b for _, b, _ in found), SHARE
    for _ in range(trials):
        if sum(now.values()) <= (1 + SETTLED) * bound:
            break
        kept, demand = defaultdict(float), np.zeros(capacity + 1)
        for config, x in now.items():
            free = x * (share if sum(config) == capacity else 1.0)
            kept[config] += x - free
            for s in config:
                demand[s] += free
        anew, _ = covered(demand, capacity, slope)
        if sum(kept.values()) + sum(anew.values()) < sum(now.values()):
            for config, x in anew.items():
                kept[config] += x
            now = {c: x for c, x in kept.items() if x > 0}
        else:
            share /= 2
    return dict(now), bound


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: equal bins are filled together."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for size in sorted(left, reverse=True):
        n = left[size]
        while n:
            room = min((r for r in bins if r >= size and bins[r]), default=None)
            config, many = bins[room].pop() if room is not None else ((), n)
            room = capacity if room is None else room
            each = min(room // size, n)
            use = min(many, n // each)
            if many > use and config:
                bins[room].append((config, many - use))
            bins[room - each * size].append((config + (size,) * each, use))
            n -= use * each
    return [x for group in bins.values() for x in group if x[0]]


def rounded(solution: dict[tuple[int, ...], float], histogram: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Configurations with whole multiplicities, and the pieces that they leave.

    Multiplicities are rounded down; then full configurations, the largest fraction first, are taken once where they still fit.
    """
    rest, out = Counter(histogram), Counter()
    up = [(c, 1) for c, x in sorted(solution.items(), key=lambda c: (-(c[1] % 1), c[0])) if sum(c) >= capacity - 1 and x % 1 > 1e-6]
    down = [(c, int(x + 1e-9)) for c, x in sorted(solution.items(), key=lambda c: (-c[1], c[0]))]
    for config, most in down + up:
        uses = Counter(config)
        n = min(most, *(rest[s] // k for s, k in uses.items()))
        if n > 0:
            out[config] += n
            rest.subtract({s: k * n for s, k in uses.items()})
    return list(out.items()), {s: n for s, n in rest.items() if n > 0}


def dived(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Priced configurations with whole multiplicities, and the pieces that they leave, a few hundred at most.

    The program is solved and rounded, and what the rounding leaves is the next one's histogram, until few pieces are left
    or rounding takes none.
    """
    out, left = Counter(), dict(histogram)
    for dive in range(DIVES):
        if sum(left.values()) <= FEW:
            break
        taken, rest = rounded(fractional(left, capacity, *((0, SLOPES[:1]) if dive else ()))[0], left, capacity)
        if not taken:
            break
        out.update(dict(taken))
        left = rest
    return list(out.items()), left


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Configurations with whole multiplicities that place exactly the pieces of the histogram.

    They come from the program, and the last ones from best fit. Best fit's plan is taken where it needs fewer sequences,
    as for some hundred pieces; which one it was is logged.
    """
    left = {s: n for s, n in histogram.items() if n and s < capacity}
    full = [((capacity,), histogram[capacity])] if histogram.get(capacity) else []
    if not left:
        return full
    priced, rest = dived(left, capacity)
    last, alone = best_fit(rest, capacity), best_fit(left, capacity)
    count = lambda p: sum(n for _, n in p)
    own = count(priced) + count(last) <= count(alone)
    LOG.info("sequences: program %d and best fit %d for its rest, best fit alone %d; taken: %s", count(priced), count(last), count(alone), "program" if own else "best fit")
    return full + (priced + last if own else alone)


def places(configs: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first sequence, offset), by first rank."""
    rank, out, sequence = Counter(), defaultdict(list), 0
    for config, many in configs:
        offset = 0
        for s in config:
            out[s].append((rank[s], sequence, offset))
            rank[s] += many
            offset += s
        sequence += many
    return {s: np.array(rows, np.int64) for s, rows in out.items()}


def pack(documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: where it starts in its document, its length and checksum, and its sequence and offset."""
    cutting = common.saved(pieces(documents, path, capacity, end_id), "pieces")
    here = cutting.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in cutting.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = places(plan(histogram, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    start = here.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = cutting.join(start, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("rank"))
    schema = common.arrow_schema(PLACED)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for s in np.unique(length):
                rows = np.flatnonzero(length == s)
                run = runs[int(s)]
                k = np.searchsorted(run[:, 0], rank[rows], "right") - 1
                sequence[rows] = run[k, 1] + rank[rows] - run[k, 0]
                offset[rows] = run[k, 2]
            yield common.batch(schema, *(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), sequence, offset)

    return ranked.mapInArrow(place, PLACED)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
