"""What the operators share: the shared scratch folder, written tables, streams of groups, components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import BROADCAST_ROWS, alone, claimed, delete, dropped, owned, place, saved, scratch, sided, sweep, written, written_since  # noqa: F401


def bucketed(df: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """df as a written table in n buckets of the key: grouping it by the key needs no shuffle. No name stays in the catalogue."""
    path = place(df.sparkSession, name)
    known = path.rsplit("/", 1)[-1].replace("-", "_")
    df.write.option("path", path).option("compression", "zstd").bucketBy(n, key).saveAsTable(known, format="parquet")
    out = df.sparkSession.table(known)
    out.schema  # noqa: B018 - resolves the table, after which the files are read by their paths
    df.sparkSession.sql(f"DROP TABLE {known}")
    return owned(out, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(documents: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), and the named columns; whatever else the input has stays out."""
    return documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


_KINDS = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_()}


def _kind(name: str) -> pa.DataType:
    return pa.list_(_kind(name[6:-1])) if name.startswith("array<") else _KINDS[name]


def arrow_schema(schema: str | T.StructType) -> pa.Schema:
    """The Arrow schema of a Spark schema; a string ("name type, ...") of plain types and arrays also works in tasks."""
    if isinstance(schema, str):
        return pa.schema([(name, _kind(kind)) for name, kind in (field.split(" ") for field in schema.split(", "))])
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Consecutive values as lists of the given lengths."""
    at = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))


def groups(batches: Iterable[pa.RecordBatch], key: str | list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, whatever batches they come in; the partition must be sorted by the key."""
    keys = [key] if isinstance(key, str) else key
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            now = tuple(c[i] for c in cols)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def hashed(column: str | F.Column, n: int) -> F.Column:
    """0 ... n-1 by a hash of the column."""
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


#: Edges that a task reads before it keeps a forest of them, and up to which one task finishes the components (16 bytes each).
FOREST_EDGES, FEW_EDGES = 1 << 19, 1 << 20


def lowest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (x, y), and the smallest node of each one's component."""
    ids, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y, label = at[: len(x)], at[len(x) :], np.arange(len(ids))
    while True:  # every tree hangs itself under the lowest root that an edge leads to; then all nodes point at their roots
        low = label.copy()
        a, b = label[x], label[y]
        np.minimum.at(low, a, b)
        np.minimum.at(low, b, a)
        while (low[low] != low).any():
            low = low[low]
        if (low == label).all():
            return ids, ids[label]
        label = low


def forest(edges: DataFrame, whole: bool = False) -> DataFrame:
    """(a, b): edges that connect the same nodes, of every FOREST_EDGES that a task reads; a is the smallest of a tree.

    whole: of all that a task reads together, with (a, a) for each tree as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def kept() -> pa.RecordBatch:
            nodes, low = lowest(*(np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1)))
            use = slice(None) if whole else nodes != low
            return batch(schema, low[use], nodes[use])

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= FOREST_EDGES and not whole:
                yield kept()
                held, n = [], 0
        if n:
            yield kept()

    schema = arrow_schema("a long, b long")
    return edges.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable over the undirected edges (a, b); nodes without edges are absent.

    Contraction: in each round every node takes the label of its lowest neighbour or of itself, edges are rewritten to
    labels, and loops and repeats go. "Lowest" is by id in the first round, in which stars shrink to a point, and by a
    hash that changes with the round afterwards, so that also chains shrink by a part each time and the rounds are
    about log n. Edges never become more. Once FEW_EDGES or fewer are left, one task finishes them. Nothing but one
    count a round comes to the driver.
    """
    ends = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    left, label, turn = saved(forest(ends), name), None, 0
    while left.count() > FEW_EDGES:
        if label is None:
            label = saved(left.select(F.col("a").alias("node")).union(left.select(F.col("b").alias("node"))).distinct().select("node", F.col("node").alias("root")), name)
        rank = (lambda c: F.col(c)) if not turn else (lambda c: F.xxhash64(c, F.lit(turn)))  # noqa: B023
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("rank"), F.col("b").alias("id"))).alias("near"))
        mine = F.struct(rank("a").alias("rank"), F.col("a").alias("id"))
        pick = saved(near.select(F.col("a").alias("old"), F.least(mine, F.col("near"))["id"].alias("new")), name)
        after = saved(label.join(pick, label["root"] == pick["old"], "left").select("node", F.coalesce("new", "root").alias("root")), name)
        one = left.join(pick, left["a"] == pick["old"]).select(F.col("new").alias("a"), "b")
        two = one.join(pick, one["b"] == pick["old"]).select("a", F.col("new").alias("b"))
        rest = saved(forest(two.where("a <> b").distinct()), name)
        dropped(label, left, pick)
        label, left, turn = after, rest, turn + 1
    last = saved(forest(left.coalesce(1), whole=True).select(F.col("b").alias("node"), F.col("a").alias("component")), name)
    dropped(left)
    if label is None:
        return last
    rooted = label.join(last, label["root"] == last["node"], "left").select(label["node"], F.coalesce("component", "root").alias("root"))
    least = rooted.groupBy("root").agg(F.min("node").alias("component"))
    out = saved(rooted.join(least, "root").select("node", "component"), name)
    dropped(label, last)
    return out


def apply(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)


def size_hint(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes of df, from file sizes; used only to choose how many buckets work is dealt to.

    Where Catalyst has no file sizes to go by (it then assumes exabytes, or multiplies the sides of joins), texts are measured.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < 1 << 50:
        return size
    each = F.octet_length("text") if "text" in df.columns else F.lit(1000)
    return int(df.agg(F.coalesce(F.sum(each.cast("long")), F.lit(0))).first()[0])


def dealt(size: int, each: int, least: int = 24, most: int = 65536) -> int:
    """How many buckets of about `each` bytes."""
    return max(least, min(most, size // each))
