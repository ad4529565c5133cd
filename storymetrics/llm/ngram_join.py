"""N-gram Jaccard join: T-occurrence search with DivideSkip inside blocks of documents that can be alike.

Candidates come from exact prefix filters. Sets with Jaccard similarity t share at least T(n) = ceil(t n) shingles, n
being the size of either, so of all but c(n) = n - T(n) + 1 of each set, in any order that all sets follow, they share
some: the 2 c(n) - 1 shingles that come first in the order of a hash hold c shared ones, c that of the smaller set. First
only these shingles are exchanged. Documents are dealt to blocks by a hash of doc_id; a block sends its distinct keys with
how many of its documents have them, by ranges of keys, and learns how many documents have each key in all, so that a
shingle of a third of all documents costs one entry a block. A document with fewer than c(T(n)) keys that others have has
no partner. The whole sets of the others are exchanged in the same way: those that share T(n) shingles or more keep the
keys that can be the first shared one, the rarest first. Nothing depends on how common a passage is, on sampling or on
tables of fixed size. Equal sets have one representative throughout. Documents that share a kept key, directly or over
others, are one group.

Inside a group every member looks for its partners over the inverted lists of its shingles: the longest lists are set
aside, the short ones are merged by heap, and documents that can still reach the required overlap T are looked up in the
long lists by binary search. Partners that are connected already are not looked up again, and only the links that
connect something are returned, so no group yields its pairs. A group of more than SHARD members is searched in rounds:
members are dealt to shards at random, each shard is searched, and one representative of each component goes on to the
next round. What is left then are pairs of different components, and for those all members outside the group's largest
component are the queries against all members that share a key with other components, shard against shard. A group of
near copies costs little more than a copy of its members; a group of q members that are like none of the others costs
q / SHARD copies of the group.

Defined results: documents without words have an empty set, link with nothing and are their own component; equal rows
are in one class; rows with one doc_id are one node, linked if any of them is; a null doc_id takes part in no link and
has no component of its own; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from . import common, text

WORDS, PERCENT = 3, 90
SHARD = 512
#: Rounds of representatives in groups of more than SHARD members before the rest is searched shard against shard.
ROUNDS = 4
#: Cost of a step of a merge against a look-up, as DivideSkip weighs them.
MERGE_COST = 0.0085
#: Entries that are merged by heap; more of them by a sort.
HEAP = 4096
#: Bytes of input for each block of documents and each range of keys.
BLOCK_BYTES, RANGE_BYTES = 3_000_000, 8_000_000
SIZED = "doc_id long, n long, s1 long, s2 long"
SENT = "block int, part int, keys binary, counts binary"
ANSWER = "block int, keys binary, counts binary"
CHOSEN = "doc_id long, keys array<long>, shingles binary"
MEMBERS = "block long, doc_id long, shingles binary"
KEY_SALT, ORDER_SALT = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x5851F42D4C957F2D)


def least(n: np.ndarray, percent: int) -> np.ndarray:
    """T(n): the least overlap of a set of n with any partner."""
    return -(-n * percent // 100)


def spare(n: np.ndarray, percent: int) -> np.ndarray:
    """c(n) = n - T(n) + 1."""
    return n - least(n, percent) + 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle) of the distinct shingles, the rows in order and each one's shingles by a hash, and the sets' sizes."""
    doc, h = text.shingles(text.words(data, offsets, fold=True), k)
    doc, h = text.distinct(doc, text.mix(h ^ ORDER_SALT))
    return doc, h, np.bincount(doc, minlength=len(offsets) - 1)


def key_of(h: np.ndarray) -> np.ndarray:
    """What is exchanged for a shingle: 56 bits."""
    return text.mix(h ^ KEY_SALT) >> np.uint64(8)


def bounds(n: np.ndarray, percent: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """How many of a set's first shingles are exchanged, and how many of these it shares with any partner at least."""
    return (n, least(n, percent)) if whole else (2 * spare(n, percent) - 1, spare(least(n, percent), percent))


def planes(values: np.ndarray) -> bytes:
    """64-bit values, all lowest bytes first, then all second ones ...: sorted steps and small numbers compress well."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def packed(keys: np.ndarray, values: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys and a number for each."""
    return zstandard.compress(planes(np.diff(keys, prepend=np.uint64(0))), 1), zstandard.compress(planes(values), 1)


def unpacked(keys: bytes, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(unplaned(keys), dtype=np.uint64), unplaned(values).view(np.int64)


def counted(group: pa.Table) -> pa.Table:
    """For each block of a range of keys: its keys that several documents have, and how many do."""
    blocks = group["block"].to_numpy()
    parts = [unpacked(k.as_py(), c.as_py()) for k, c in zip(group["keys"], group["counts"])]
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    _, at = np.unique(keys, return_inverse=True)
    total = np.bincount(at, counts).astype(np.int64)
    rows, first = [], 0
    for block, (mine, _) in zip(blocks.tolist(), parts):
        all_of = total[at[first : first + len(mine)]]
        first += len(mine)
        if (all_of > 1).any():
            rows.append((block, *packed(mine[all_of > 1], all_of[all_of > 1])))
    return pa.Table.from_batches([common.batch(common.arrow_schema(ANSWER), *(zip(*rows) if rows else [[]] * 3))])


def sizes(documents: DataFrame, k: int) -> DataFrame:
    """doc_id and the size and 128-bit hash of the set of each row."""
    schema = common.arrow_schema(SIZED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, offsets in text.runs(b.column(1)):
                _, h, n = shingle_sets(data, offsets, k)
                start = np.cumsum(n) - n
                total = [np.append(np.zeros(1, np.uint64), np.cumsum(text.mix(h ^ salt))) for salt in (KEY_SALT, ORDER_SALT)]
                yield common.batch(schema, b.column(0).slice(first, len(n)), n, *((t[start + n] - t[start]).view(np.int64) for t in total))

    return common.texts(documents).mapInArrow(run, SIZED)


def classes(documents: DataFrame, k: int) -> DataFrame:
    """doc_id, n and rep: the smallest doc_id with the same set (null for empty sets)."""
    sized = common.saved(sizes(documents, k), "sizes")
    same = sized.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    out = common.saved(sized.join(same, ["n", "s1", "s2"], "left").select("doc_id", "n", "rep"), "classes")
    common.dropped(sized)
    return out


Runs = Callable[[pa.Table, pa.Table | None], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]


def filtered(by_block: GroupedData, side: DataFrame, runs: Runs, ranges: int, percent: int, whole: bool) -> DataFrame:
    """The documents that share enough of their first shingles with others, with keys (whole sets only) and shingles.

    runs(group, answers): doc_ids, rows, shingles and sizes of the sets of a block; side: block and what else runs needs.
    Keys: of the shared shingles in the set, the rarest first, those that can be the first that a partner shares.
    """
    sent_schema, chosen_schema = common.arrow_schema(SENT), common.arrow_schema(CHOSEN)

    def prefixes(doc: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.arange(len(doc)) - (np.cumsum(n) - n)[doc] < bounds(n, percent, whole)[0][doc]
        return doc[first], key_of(h[first])

    def spread(group: pa.Table, answers: pa.Table) -> pa.Table:
        found = [prefixes(doc, h, n)[1] for _, doc, h, n in runs(group, answers)]
        keys, count = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        cuts = np.searchsorted(keys, (np.arange(1, ranges, dtype=np.float64) * (2.0**56 / ranges)).astype(np.uint64))
        rows = [(group["block"][0].as_py(), i, *packed(a, c)) for i, (a, c) in enumerate(zip(np.split(keys, cuts), np.split(count, cuts))) if len(a)]
        return pa.Table.from_batches([common.batch(sent_schema, *(zip(*rows) if rows else [[]] * 4))])

    def choose(group: pa.Table, answers: pa.Table) -> pa.Table:
        shared = [unpacked(a.as_py(), c.as_py()) for a, c in zip(answers["keys"], answers["counts"]) if a.is_valid]
        if not shared:
            return chosen_schema.empty_table()
        known, total = (np.concatenate(x) for x in zip(*shared))
        order = np.argsort(known)
        known, total, out = known[order], total[order], []
        for ids, doc, h, n in runs(group, answers):
            row, key = prefixes(doc, h, n)
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            hit = known[at] == key
            row, key, count = row[hit], key[hit], total[at[hit]]
            several, (size, need) = np.bincount(row, minlength=len(n)), bounds(n, percent, whole)
            enough = (several >= need)[row]
            row, key, count = row[enough], key[enough], count[enough]
            order = np.lexsort((key, count, row))
            row, key = row[order], key[order]
            mine, start = np.unique(row, return_index=True)
            place = np.arange(len(row)) - np.repeat(start, several[mine]) + (size - several)[row]
            kept = place < (size - need + 1)[row]
            ends = np.cumsum(np.bincount(row[kept], minlength=len(n)))[mine]
            key = key[kept].astype(np.int64)
            first, last = np.searchsorted(doc, mine), np.searchsorted(doc, mine, "right")
            out += [(int(ids[m]), key[i:j] if whole else None, h[p:q].tobytes()) for m, i, j, p, q in zip(mine.tolist(), [0, *ends], ends, first, last)]
        return pa.Table.from_batches([common.batch(chosen_schema, *(zip(*out) if out else [[]] * 3))])

    empty = [F.lit(None).cast("binary").alias(c) for c in ("keys", "counts")]
    side = side.select("block", *empty, *(c for c in side.columns if c != "block"))
    sent = by_block.cogroup(side.groupBy("block")).applyInArrow(spread, SENT)
    back = sent.groupBy("part").applyInArrow(counted, ANSWER)
    return by_block.cogroup(back.unionByName(side, allowMissingColumns=True).groupBy("block")).applyInArrow(choose, CHOSEN)


def candidates(documents: DataFrame, classed: DataFrame, k: int, percent: int) -> DataFrame:
    """The representatives that can have partners, with the keys by which they meet them and their whole sets."""
    hint = common.size_hint(documents)
    n_blocks, ranges = common.dealt(hint, BLOCK_BYTES, 48, 1 << 22), common.dealt(hint, RANGE_BYTES, 24, 1 << 16)
    block = common.hashed("doc_id", n_blocks).alias("block")
    reps = classed.where("doc_id = rep").select(block, "doc_id").groupBy("block").agg(F.collect_set("doc_id").alias("reps"))

    def of_texts(group: pa.Table, answers: pa.Table) -> Iterator[tuple]:
        known = [x.values.to_numpy(zero_copy_only=False) for x in answers["reps"] if x.is_valid]
        if not group.num_rows or not known:
            return
        group = group.filter(pa.array(np.isin(group["doc_id"].to_numpy(), known[0])))
        ids = group["doc_id"].to_numpy()
        for first, data, offsets in text.runs(group["text"]):
            doc, h, n = shingle_sets(data, offsets, k)
            yield ids[first : first + len(n)], doc, h, n

    def of_sets(group: pa.Table, answers: pa.Table) -> Iterator[tuple]:
        for b in group.to_batches(max_chunksize=2000):
            n = np.array([len(x.as_py()) // 8 for x in b.column("shingles")], np.int64)
            yield b.column("doc_id").to_numpy(), np.repeat(np.arange(len(n)), n), np.frombuffer(b"".join(x.as_py() for x in b.column("shingles")), np.uint64), n

    by_block = common.texts(documents).where("doc_id IS NOT NULL").select(block, "doc_id", "text").groupBy("block")
    some = common.saved(filtered(by_block, reps, of_texts, ranges, percent, False).select(block, "doc_id", "shingles"), "some")
    return filtered(some.groupBy("block"), reps.select("block"), of_sets, ranges, percent, True)


class Index:
    """Inverted lists over documents (numbers in order), by shingle."""

    def __init__(self, members: list[np.ndarray]):
        sizes = np.array([len(m) for m in members], np.int64)
        token, doc = np.concatenate(members), np.repeat(np.arange(len(members)), sizes)
        order = np.lexsort((doc, token))
        self.doc, token = doc[order], token[order]
        self.token, self.first = np.unique(token, return_index=True)
        self.end = np.append(self.first[1:], len(token))
        self.size = sizes

    def lists(self, shingles: np.ndarray, least: int) -> list[np.ndarray]:
        """The lists of the shingles that hold `least` documents or more, the shortest first."""
        at = np.minimum(np.searchsorted(self.token, shingles), len(self.token) - 1)
        at = at[self.token[at] == shingles]
        at = at[self.end[at] - self.first[at] >= least]
        at = at[np.argsort(self.end[at] - self.first[at], kind="stable")]
        return [self.doc[self.first[i] : self.end[i]] for i in at]


def merged(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents that stand in `least` of the lists or more, and in how many: a heap merge, by a sort beyond HEAP entries."""
    if sum(map(len, lists)) > HEAP:
        doc, count = np.unique(np.concatenate(lists), return_counts=True)
    else:
        found = [(d, sum(1 for _ in same)) for d, same in groupby(heapq.merge(*(x.tolist() for x in lists)))]
        doc, count = (np.array(x, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    return doc[count >= least], count[count >= least]


def occurring(index: Index, shingles: np.ndarray, needed: int, least: int, wanted) -> tuple[np.ndarray, np.ndarray]:
    """The documents that `wanted` leaves and that share `needed` or more of the shingles, and how many (DivideSkip)."""
    lists = index.lists(shingles, least)
    if len(lists) < max(needed, 1):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    longest = len(lists[-1])
    aside = min(needed - 1, int(needed / (MERGE_COST * np.log2(max(2, longest)) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    doc, count = merged(short, needed - aside)
    keep = wanted(doc)
    doc, count = doc[keep], count[keep]
    for left, one in zip(range(len(long) - 1, -1, -1), long):
        if not len(doc):
            break
        at = np.minimum(np.searchsorted(one, doc), len(one) - 1)
        count = count + (one[at] == doc)
        keep = count + left >= needed
        doc, count = doc[keep], count[keep]
    return doc, count


class Forest:
    """Union-find over document numbers; the root of a tree is its smallest number."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = int(self.up[x])
        return x

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while (self.up[r] != r).any():
            r = self.up[r]
        return r

    def union(self, x: int, y: int) -> bool:
        x, y = sorted((self.root(x), self.root(y)))
        self.up[y] = x
        return x != y


def search(ids: np.ndarray, members: list[np.ndarray], component: np.ndarray, data: np.ndarray, query: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Links (pairs of ids) that connect all similar pairs of a query and a datum (row numbers, in order) in different components."""
    index, forest = Index([members[i] for i in data]), Forest(len(ids))
    _, first, same = np.unique(component, return_index=True, return_inverse=True)
    forest.up = first[same]
    alone = np.array_equal(data, query)
    for x in query.tolist():
        n = len(members[x])
        mine = forest.root(x)

        def wanted(doc: np.ndarray) -> np.ndarray:
            return (data[doc] < x if alone else np.ones(len(doc), bool)) & (forest.roots(data[doc]) != mine)

        doc, count = occurring(index, members[x], int(least(n, percent)), 2 if alone else 1, wanted)
        for y in data[doc[100 * count >= percent * (n + index.size[doc] - count)]].tolist():
            if forest.union(x, y):
                yield int(ids[x]), int(ids[y])


def searched(tasks: DataFrame, percent: int, parts: int) -> DataFrame:
    """(a, b): links between the data and the queries of each task (block, i, j); rows: role 0 data, 1 query, 2 both.

    The tasks are dealt to `parts` partitions: they take far longer than their few bytes tell.
    """
    schema, task = common.arrow_schema("a long, b long"), ["block", "i", "j"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.groups(batches, task):
            role = group["role"].to_numpy()
            data, query = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
            if group.num_rows < 2 or not len(data) or not len(query):
                continue
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in group["shingles"]]
            found = list(search(group["doc_id"].to_numpy(), sets, group["component"].to_numpy(), data, query, percent))
            if found:
                yield common.batch(schema, *zip(*found))

    rows = tasks.select(*task, "role", "doc_id", "component", "shingles")
    return rows.repartition(parts, *task).sortWithinPartitions(*task).mapInArrow(find, "a long, b long")


def shards(n: Column) -> Column:
    return F.ceil(n / SHARD).cast("int")


def shard(n: str, salt: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.col(n)).cast("int")


def inside(members: DataFrame, salt: int) -> DataFrame:
    """Tasks that compare the members (block, doc_id, component, shingles) of each block with those of their own shard."""
    many = members.groupBy("block").agg(shards(F.count("*")).alias("shards"))
    i = shard("shards", salt)
    return members.join(many, "block").select("block", i.alias("i"), i.alias("j"), F.lit(2).alias("role"), "doc_id", "component", "shingles")


def across(members: DataFrame) -> DataFrame:
    """Tasks that compare, in each block, the members outside the largest component with all members, shard against shard."""
    sized = members.groupBy("block", "component").agg(F.count("*").alias("n"))
    of = sized.groupBy("block").agg(F.max(F.struct("n", "component"))["component"].alias("largest"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("q")).where("q > 0")
    rows = members.join(of.select("block", "largest", shards(F.col("n")).alias("n"), shards(F.col("q")).alias("q")), "block")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    data = rows.select("block", shard("n", 7).alias("i"), each("q").alias("j"), F.lit(0).alias("role"), "doc_id", "component", "shingles")
    query = rows.where("component <> largest").select("block", each("n").alias("i"), shard("q", 8).alias("j"), F.lit(1).alias("role"), "doc_id", "component", "shingles")
    return data.union(query)


def members(documents: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """block, doc_id and shingles of the documents in the written table `chosen` (doc_id, block)."""
    schema = common.arrow_schema(MEMBERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, offsets in text.runs(b.column(2)):
                doc, h, n = shingle_sets(data, offsets, k)
                cuts = np.append(0, np.cumsum(n)).tolist()
                yield common.batch(schema, *(b.column(c).slice(first, len(n)) for c in (0, 1)), [h[i:j].tobytes() for i, j in zip(cuts, cuts[1:])])

    return common.texts(documents).join(common.sided(chosen), "doc_id").select("block", "doc_id", "text").mapInArrow(run, MEMBERS)


def links(members: DataFrame, percent: int, parts: int, keys: DataFrame | None = None) -> DataFrame:
    """(a, b): links that connect the documents whose sets are `percent` alike.

    members: block, doc_id, shingles; documents that are to be compared are in one block. keys: (key, doc_id), if those
    share a key as well.
    """
    members = members.withColumn("component", F.col("doc_id"))
    large = members.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > SHARD).select("block")
    large = common.saved(members.join(large, "block").select(members.columns), "large")
    found = common.saved(searched(inside(members, 0), percent, parts), "links")
    if not large.limit(1).count():
        return found

    def labelled() -> DataFrame:
        of = common.components(found.join(large.select(F.col("doc_id").alias("a")).distinct(), "a", "left_semi"), "large")
        both = large.drop("component").join(of.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        return common.saved(both.withColumn("component", F.coalesce("component", "doc_id")), "labelled")

    now = labelled()
    for turn in range(1, ROUNDS + 1):
        reps = now.where("doc_id = component")
        found = common.saved(found.union(searched(inside(reps, turn), percent, parts)), "links")
        done = not reps.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > SHARD).limit(1).count()
        now = labelled()
        if done:
            break
    if keys is not None:
        apart = keys.join(now.select("block", "doc_id", "component").distinct(), "doc_id")
        mixed = apart.groupBy("key", "block").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        now = now.join(apart.join(mixed.select("key", "block"), ["key", "block"]).select("doc_id").distinct(), "doc_id", "left_semi")
    return common.saved(found.union(searched(across(now), percent, parts)), "links")


def parts(documents: DataFrame) -> int:
    """How many partitions the search in the groups of these documents is dealt to."""
    return common.dealt(common.size_hint(documents), BLOCK_BYTES, 24, 1 << 16)


def join(documents: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    member = classes(documents, k)
    since = common.written()
    chosen = common.saved(candidates(documents, member, k, percent), "candidates")
    keys = chosen.select(F.explode("keys").alias("key"), "doc_id")
    shared = keys.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    keys = common.saved(keys.join(shared, "key").select("key", "doc_id", "low"), "keys")
    group = common.components(keys.select(F.col("low").alias("a"), F.col("doc_id").alias("b")), "groups")
    members = chosen.join(group, chosen["doc_id"] == group["node"]).select(F.col("component").alias("block"), "doc_id", "shingles")
    found = common.alone(common.components(links(members, percent, parts(documents), keys), "linked").withColumnRenamed("node", "rep"), "found", since)
    component = F.coalesce("component", "rep", "doc_id").alias("component_id")
    return member.join(found, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), component)


def representatives(documents: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents that stay when one of each group (that with the smallest doc_id) does; rows with a null doc_id stay."""
    found = join(documents, k, percent)
    gone = common.saved(found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "gone")
    return documents.join(common.sided(gone), "doc_id", "left_anti").select(documents.columns)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"))
