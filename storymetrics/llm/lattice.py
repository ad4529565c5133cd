"""Embedding near-dedup by lattice hashing: random projections decoded to E8 points, probed neighbours, exact cosine.

Each of TABLES tables projects a unit vector to BLOCKS x 8 coordinates; each eight are decoded to the nearest point of
the E8 lattice, and the points (with the label and the table) are the cell. A vector is entered in its own cell and in
PROBES neighbouring ones: those across the lattice's 240 shortest vectors that come nearest to it. Cells that hold
another vector besides, one of them at home there, are kept; vectors of a cell are compared exactly, in double
precision, by blocks. A pair that several cells hold is counted in the first of them only, which the vectors themselves
tell, so counts need no list of pairs, and only links that connect something are returned. A cell of more than CHUNK
vectors is compared chunk against chunk, in as many tasks as there are pairs of chunks. Equal vectors with equal labels
are one class; their links are counted by multiplicity.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label
(where labels count) or id, link with nothing; vectors of another length link only with their like; rows with the same
vec_id are one vector of the class; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .ngram_join import Forest
from .text import mix

THRESHOLD = 0.98
#: Of 20,000 random pairs at a cosine of exactly 0.98 in 64 dimensions these tables and probes found all; strangers rarely meet.
TABLES, BLOCKS, PROBES, WIDTH = 8, 2, 4, 1.8
#: Vectors of a chunk of a large cell; rows that are compared at a time; vectors that a task holds before it judges their pairs.
CHUNK, ROWS, HELD = 2048, 256, 4096
CELLS = "cell long, vec_id long, home boolean"
COUNTED = "vec_id long, links long, other long"


@lru_cache(1)
def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of 1 or -1, or all of 1/2 or -1/2 with an even number of minuses."""
    pairs = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            pairs.append(v)
    halves = [np.array(s) / 2 for s in product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(pairs + halves)


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest point with whole coordinates of even sum: where the sum is odd, the worst coordinate rounds the other way."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1) % 2)
    if len(odd):
        off = x[odd] - r[odd]
        worst = np.abs(off).argmax(axis=1)
        rows = np.arange(len(odd))
        r[odd, worst] += np.where(off[rows, worst] >= 0, 1, -1)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point: of D8 or of D8 moved by one half in all coordinates."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


@lru_cache(4)
def projection(dim: int) -> np.ndarray:
    return np.random.default_rng(dim).standard_normal((TABLES, BLOCKS, dim, 8)) / WIDTH


def hashed(points: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of lattice points (rows of eight halves)."""
    with np.errstate(over="ignore"):
        h = np.zeros(len(points), np.uint64) + np.uint64(seed)
        for i in range(8):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + (2 * points[:, i]).astype(np.int64).view(np.uint64))
        return h


def cells(unit: np.ndarray, label: np.ndarray) -> np.ndarray:
    """(vectors, TABLES, 1 + PROBES) cell numbers, the home cell first."""
    n, dim = unit.shape
    out = np.empty((n, TABLES, 1 + PROBES), np.uint64)
    near = shortest()
    each = PROBES // BLOCKS
    for t in range(TABLES):
        home, step = [], []
        for b in range(BLOCKS):
            y = unit @ projection(dim)[t, b]
            p = decode(y)
            gain = (y - p) @ near.T
            home.append(p)
            step.append(np.argpartition(-gain, each - 1, axis=1)[:, :each])
        with np.errstate(over="ignore"):
            base = mix(label.astype(np.int64).view(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(t * 8191 + dim))
            parts = [hashed(home[b], b) for b in range(BLOCKS)]
            out[:, t, 0] = mix(base + sum(parts))
            k = 1
            for b in range(BLOCKS):
                for j in range(each):
                    moved = hashed(home[b] + near[step[b][:, j]], b)
                    out[:, t, k] = mix(base + sum(parts) - parts[b] + moved)
                    k += 1
    return out


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows of unit vectors in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def first_shared(mine: np.ndarray, theirs: np.ndarray, mine_first: np.ndarray) -> np.ndarray:
    """For pairs of vectors: the cell that owns the pair, the first table's in which one's home is entered by the other.

    If both homes qualify, that of the vector with the smaller id (mine_first) owns the pair.
    """
    into_mine = (theirs == mine[:, :, :1]).any(axis=2)
    into_theirs = (mine == theirs[:, :, :1]).any(axis=2)
    shared = into_mine | into_theirs
    t = shared.argmax(axis=1)
    rows = np.arange(len(mine))
    use_mine = np.where(mine_first, into_mine[rows, t], ~into_theirs[rows, t])
    return np.where(use_mine, mine[rows, t, 0], theirs[rows, t, 0])


class Group(NamedTuple):
    """The vectors of a task (cell, a, b): ids, labels, how many rows are equal to each, unit vectors, and their chunks."""

    cell: np.uint64
    ids: np.ndarray
    label: np.ndarray
    many: np.ndarray
    unit: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def pairs(self, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs (row numbers) at the threshold, a few hundred rows against all others at a time."""
        same = self.left is self.right
        for s in range(0, len(self.left), ROWS):
            i, j = np.nonzero(self.unit[self.left[s : s + ROWS]] @ self.unit[self.right].T >= threshold)
            i, j = self.left[s + i], self.right[j]
            keep = (i < j if same else np.ones(len(i), bool)) & (self.label[i] == self.label[j])
            yield i[keep], j[keep]


def compare(groups: list[Group], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """For each group: how many vectors each one is linked with by pairs that its cell owns, and links that connect them.

    The cells of all vectors that are in a pair are found in one go for all groups, and once for each vector.
    """
    found = [list(g.pairs(threshold)) for g in groups]
    used = [np.unique(np.concatenate([x for pair in f for x in pair])) if f else np.zeros(0, np.int64) for f in found]
    ids = np.concatenate([g.ids[u] for g, u in zip(groups, used)])
    if not len(ids):
        return
    _, first, place = np.unique(ids, return_index=True, return_inverse=True)
    units, labels = (np.concatenate([getattr(g, name)[u] for g, u in zip(groups, used)])[first] for name in ("unit", "label"))
    known = np.concatenate([cells(units[s : s + 2000], labels[s : s + 2000]) for s in range(0, len(units), 2000)])
    at = 0
    for g, f, u in zip(groups, found, used):
        mine = place[at : at + len(u)]
        at += len(u)
        count, forest, links = np.zeros(len(g.ids), np.int64), Forest(len(g.ids)), []
        for i, j in f:
            for s in range(0, len(i), 20_000):
                x, y = i[s : s + 20_000], j[s : s + 20_000]
                own = first_shared(known[mine[np.searchsorted(u, x)]], known[mine[np.searchsorted(u, y)]], g.ids[x] < g.ids[y]) == g.cell
                x, y = x[own], y[own]
                np.add.at(count, x, g.many[y])
                np.add.at(count, y, g.many[x])
                apart = forest.roots(x) != forest.roots(y)
                for p, q in zip(x[apart].tolist(), y[apart].tolist()):
                    if forest.union(p, q):
                        links.append((int(g.ids[p]), int(g.ids[q])))
        yield g.ids, count, links


def link(vectors: DataFrame, threshold: float = THRESHOLD, by_label: bool = True) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    label = F.when(F.col("label").isNotNull(), F.xxhash64(F.col("label").cast("string"))) if by_label else F.lit(0).cast("long")
    source = vectors.select("vec_id", "embedding", label.alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    good = F.coalesce(finite & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    plus = F.transform("embedding", lambda x: x + F.lit(0.0).cast("float")).alias("embedding")
    usable = source.where(good).select("vec_id", "label", plus)
    grouped = usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many"))
    reps = common.saved(grouped.withColumn("dim", F.size("embedding")).select(F.col("rep").alias("vec_id"), "label", "many", "dim", "embedding"), "vectors")
    schema = common.arrow_schema(CELLS)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 2000) for i in range(0, whole.num_rows, 2000)):
                dims = b.column("dim").to_numpy()
                for dim in np.unique(dims).tolist():
                    some = b.filter(pa.array(dims == dim))
                    found = cells(matrix(some.column("embedding")), some.column("label").to_numpy()).reshape(some.num_rows, -1)
                    home = np.zeros(found.shape, bool)
                    home[:, :: 1 + PROBES] = True
                    yield common.batch(schema, found.ravel().view(np.int64), np.repeat(some.column("vec_id").to_numpy(), found.shape[1]), home.ravel())

    entries = common.saved(reps.mapInArrow(enter, CELLS), "cells")
    full = entries.groupBy("cell").agg(F.count("*").alias("n"), F.max("home").alias("any_home")).where("n > 1 AND any_home").select("cell", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    chosen = entries.join(full, "cell").join(reps, "vec_id")
    chosen = chosen.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tasks = chosen.select("cell", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "chunk", "vec_id", "label", "many", "embedding")
    out = common.arrow_schema(COUNTED)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def results() -> Iterator[pa.RecordBatch]:
            for ids, count, found in compare(held, threshold):
                counted, pairs = np.flatnonzero(count), np.array(found, np.int64).reshape(-1, 2)
                if len(counted):
                    yield common.batch(out, np.concatenate([ids[counted], pairs[:, 0]]), np.concatenate([count[counted], np.zeros(len(pairs), np.int64)]), pa.array([None] * len(counted) + pairs[:, 1].tolist(), pa.int64()))

        for table in common.groups(batches, ["cell", "a", "b"]):
            if table.num_rows < 2:
                continue
            ids, at = np.unique(table["vec_id"].to_numpy(), return_index=True)
            table = table.take(pa.array(at))
            cell, a, b = (table[c][0].as_py() for c in ("cell", "a", "b"))
            chunk = table["chunk"].to_numpy()
            left = np.flatnonzero(chunk == a)
            held.append(Group(np.uint64(cell & (2**64 - 1)), ids, table["label"].to_numpy(), table["many"].to_numpy(), matrix(table["embedding"]), left, left if a == b else np.flatnonzero(chunk == b)))
            n += len(ids)
            if n >= HELD:
                yield from results()
                held, n = [], 0
        if held:
            yield from results()

    counted = common.saved(tasks.repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b").mapInArrow(find, COUNTED), "counted")
    links = counted.where("other IS NULL").groupBy(F.col("vec_id").alias("rep")).agg(F.sum("links").alias("links"))
    component = common.components(counted.where("other IS NOT NULL").select(F.col("vec_id").alias("a"), F.col("other").alias("b")), "near").withColumnRenamed("node", "rep")
    whole = grouped.select("label", "embedding", "rep", "many").join(links, "rep", "left").join(component, "rep", "left")
    marked = source.withColumn("embedding", F.when(good, plus)).withColumn("label", F.when(good, F.col("label")))
    n_links = F.coalesce(F.coalesce("links", F.lit(0)) + F.col("many") - 1, F.lit(0)).cast("long").alias("n_links")
    found = marked.join(whole, ["label", "embedding"], "left").select("vec_id", n_links, F.coalesce("component", "rep", "vec_id").alias("component_id"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(common.table(spark, sf_dir, "embeddings"))
