"""The prefix trie of conversations, by a Van Emde Boas recursion over whole tables.

Sequences of up to 2 h turns are cut after the h-th. The first halves are named by their content; equal ones are one from
then on, with the number of sequences they stand for, and make the upper trie. The second halves are sequences of their
own, in a forest below the node that their first half ends at. Upper trie and forests are cut again, all of them in one
job, until every piece is one turn: log2(longest) jobs. Totals of subtrees go the same way: at each cut, what stands in a
lower tree is summed and grafted onto the node that it hangs under, from the largest cut to the smallest.

A turn is a row throughout, never an element of an array of its conversation, so a conversation of any length will do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from . import common

GROUP, TURNS = 5, 9
EMPTY = hashlib.sha256(b"").hexdigest()


def name(*columns: str | Column) -> tuple[Column, Column]:
    """128 bits for a turn at its place; the XOR over the places of a prefix names the prefix."""
    return F.xxhash64(F.lit(0x51ED27), *columns).alias("hx"), F.xxhash64(F.lit("second"), *columns).alias("hy")


def ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, nth, turn_id, bytes): the turns of every conversation counted off from 0, by turn, null first.

    Null role and text are empty; turn_id is a digest of both. Equal turn numbers are ties, broken by the digest. Rows
    without conv_id belong to no conversation and stay out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    slim = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", digest.alias("turn_id"), F.octet_length(text).cast("long").alias("bytes"))
    return ranked(common.saved(slim, "turns"), ["conv_id"], ["turn", "turn_id"], "nth").drop("turn")


def rebuilt(held: DataFrame, group: int = GROUP, most: int = TURNS) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) after every conversation has got the first turns of the first one of its group in place of its own.

    held: ordered(). turns: (conv_id, length, pos from 1, turn_id, bytes), conversations: (conv_id, length). How many turns
    are replaced is the checksum of the id modulo `most`; a group has `group` conversations, so few turns are copied often.
    """
    base, h = F.col("conv_id") - F.col("conv_id") % group, F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    own = common.saved(held.groupBy("conv_id").agg(F.count("*").alias("n")), "turns")
    first = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    all_ = own.withColumn("base", base).withColumn("h", h).join(first, "base", "left")
    all_ = all_.withColumn("given", F.least("h", F.coalesce("base_n", F.lit(0)))).withColumn("length", F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    all_ = common.saved(all_.select("conv_id", "base", "h", "given", "length"), "turns")
    rest = held.join(all_.select("conv_id", "h", "given", "length"), "conv_id").where("nth >= h")
    rest = rest.select("conv_id", "length", (F.col("given") + F.col("nth") - F.col("h") + 1).alias("pos"), "turn_id", "bytes")
    head = held.where(F.col("nth") < most).withColumnRenamed("conv_id", "base").join(all_, "base").where("nth < h")
    head = head.select("conv_id", "length", (F.col("nth") + 1).alias("pos"), "turn_id", "bytes")
    return rest.unionByName(head), all_.select("conv_id", "length")


def cuts(turns: DataFrame, levels: int) -> DataFrame:
    """One row for every turn that is still told apart after all cuts, with the names of the prefixes it stands after.

    turns: (conv_id, length, pos, bytes, hx, hy). Added: n, the conversations that the row stands for; rx, ry, the name of
    the prefix before it; path, the names of the cuts that it stands below, the highest first.
    """
    piece = {"n": F.lit(1).cast("long"), "rx": F.lit(0).cast("long"), "ry": F.lit(0).cast("long"), "path": F.expr("cast(array() as array<struct<x: bigint, y: bigint>>)"), "at": F.lit(0).cast("long"), "left": F.col("length")}
    fresh = lambda low, high: turns.where((F.col("length") > low) & (F.col("length") <= high)).withColumns(piece)
    held = None
    for level in reversed(range(levels)):
        half = 1 << level
        new = fresh(half, 2 * half)  # sequences that no higher cut has touched
        now = new if held is None else held.unionByName(new)
        longer, upper = F.col("left") > half, F.col("pos") - F.col("at") <= half
        some = now.where(longer & upper).groupBy("conv_id", "at").agg(F.bit_xor("hx").alias("ux"), F.bit_xor("hy").alias("uy"), *(F.first(c).alias(c) for c in ("rx", "ry", "n")))
        named = some.withColumn("cx", F.col("rx").bitwiseXOR(F.col("ux"))).withColumn("cy", F.col("ry").bitwiseXOR(F.col("uy"))).select("conv_id", "at", "cx", "cy", "n")
        one = named.groupBy("at", "cx", "cy").agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("sum")).select("conv_id", "at", "sum")
        tops = now.where(longer & upper).join(one, ["conv_id", "at"]).withColumn("n", F.col("sum")).withColumn("left", F.lit(half).cast("long"))
        lows = now.where(longer & ~upper).join(named.drop("n"), ["conv_id", "at"]).withColumn("path", F.concat("path", F.array(F.struct(F.col("cx").alias("x"), F.col("cy").alias("y")))))
        lows = lows.withColumn("rx", F.col("cx")).withColumn("ry", F.col("cy")).withColumn("at", F.col("at") + half).withColumn("left", F.col("left") - half)
        columns = now.columns
        after = common.saved(now.where(~longer).unionByName(tops.select(columns)).unionByName(lows.select(columns)), "trie")
        if held is not None:
            common.dropped(held)
        held = after
    single = fresh(0, 1)
    return single if held is None else held.unionByName(single)


def grafted(nodes: DataFrame, levels: int) -> DataFrame:
    """nodes with n_leaves and saved_tokens summed over their subtrees; before, each holds its own."""
    held = nodes
    for level in reversed(range(levels)):
        half = 1 << level
        place = F.pmod(F.col("depth") - 1, F.lit(2 * half))
        below = F.get("path", F.bit_count(F.shiftright(F.col("depth") - 1, level + 1)))  # of the cuts, that of this level
        sums = held.where(place >= half).groupBy((F.floor((F.col("depth") - 1) / half) * half).cast("long").alias("depth"), below["x"].alias("x"), below["y"].alias("y"))
        sums = sums.agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        cut = place == half - 1
        grown = held.where(cut).join(sums, ["depth", "x", "y"], "left")
        for c, more in (("n_leaves", "more_leaves"), ("saved_tokens", "more_saved")):
            grown = grown.withColumn(c, F.col(c) + F.coalesce(more, F.lit(0)))
        after = common.saved(held.where(~cut).unionByName(grown.select(held.columns)), "trie")
        common.dropped(held)
        held = after
    return held


def ends(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """(depth, x, y, ends_sha256) of the nodes at which conversations end: a digest of their ids in ascending order.

    Ids are sorted by ranges and written as stretches of text; the digest then reads the stretches of a node in order. It
    is a chain by its definition, so one task reads a node's stretches, but it holds one at a time.
    """
    full = turns.groupBy("conv_id").agg(F.bit_xor("hx").alias("x"), F.bit_xor("hy").alias("y"))
    zero = F.lit(0).cast("long")
    whole = conversations.join(full, "conv_id", "left").select(F.col("length").alias("depth"), *(F.coalesce(c, zero).alias(c) for c in ("x", "y")), "conv_id")
    key = ["depth", "x", "y"]
    ids = common.saved(whole, "trie")

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.groups((b.slice(i, 4096) for b in batches for i in range(0, b.num_rows, 4096)), [*key, "stretch"]):
            column = group["conv_id"].to_pylist()
            yield common.batch(schema, *([group[k][0].as_py()] for k in key), [column[0]], [",".join(map(str, column))])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha = None, None
        for b in batches:
            for *node, _, some in zip(*(b.column(i).to_pylist() for i in range(5))):
                if node != last:
                    if sha:
                        yield common.batch(out_schema, *([x] for x in last), [sha.hexdigest()])
                    last, sha = node, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(some.encode())
        if sha:
            yield common.batch(out_schema, *([x] for x in last), [sha.hexdigest()])

    text, out = "depth long, x long, y long, first long, ids string", "depth long, x long, y long, ends_sha256 string"
    schema, out_schema = common.arrow_schema(text), common.arrow_schema(out)
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ids.repartitionByRange(parts, *key, "conv_id").sortWithinPartitions(*key, "conv_id").withColumn("stretch", F.shiftright(F.monotonically_increasing_id(), 12))
    return ranged.mapInArrow(stretches, text).repartition(parts, *key).sortWithinPartitions(*key, "first").mapInArrow(digest, out)


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of all sequences: every distinct prefix, the empty one too.

    turns: (conv_id, length, pos from 1, turn_id, bytes), conversations: (conv_id, length), also those without turns. Per
    node: conv_id, the smallest member; depth; parent_conv_id; n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    Without conversations there is no node.
    """
    since = common.written()
    conversations = common.saved(conversations, "trie")
    held = common.saved(turns.select("conv_id", "length", "pos", "bytes", *name("pos", "turn_id")), "trie")
    longest = held.agg(F.max("length")).first()[0] or 0
    levels = max(0, (longest - 1).bit_length())
    apart = cuts(held, levels)
    of = apart.groupBy(F.col("pos").alias("depth"), F.col("rx").alias("px"), F.col("ry").alias("py"), "hx", "hy")
    nodes = of.agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.first("bytes").alias("bytes"), F.first("path").alias("path"))
    nodes = nodes.withColumn("x", F.col("px").bitwiseXOR(F.col("hx"))).withColumn("y", F.col("py").bitwiseXOR(F.col("hy"))).drop("hx", "hy")
    nodes = common.saved(nodes, "trie")
    fans = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children"))
    own = nodes.join(fans, ["depth", "x", "y"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = own.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("bytes"))
    totals = grafted(common.saved(own, "trie"), levels)
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent"))
    first = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    tops = totals.where("depth = 1").agg(F.count("*").alias("n_children"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_leaves", "saved_tokens")))
    root_conv, root_n = first.first()
    children, leaves, saved = tops.first()
    root = held.sparkSession.range(1 if root_n else 0).select(*(F.lit(v).cast("long").alias(c) for c, v in (("depth", 0), ("x", 0), ("y", 0), ("conv_id", root_conv), ("parent_conv_id", None), ("n_convs", root_n), ("n_children", children), ("n_leaves", leaves or 1), ("saved_tokens", saved))))
    parents = totals.join(above, ["depth", "px", "py"], "left").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root_conv)).otherwise(F.col("parent")))
    every = parents.select(root.columns).unionByName(root).join(ends(held, conversations), ["depth", "x", "y"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    return common.alone(every.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"), "trie", since)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = common.written()
    turns, conversations = rebuilt(ordered(common.table(spark, sf_dir, "conversations")))
    return common.alone(prefix_trie(turns, conversations), "trie", since)
