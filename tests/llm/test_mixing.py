"""Importance resampling, the prefix trie and sharding against plain Python, and their edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from storymetrics.llm import resampling, sharding, trie

LONG = "y" * 3000
TEXTS = [None, "", " .,-", "One two THREE", "one", "one two", "Ünï cöde Über-all", f"{LONG} b {LONG}", "a1 b2\x00c3\x7fd4 " * 30, "the same words again and again " * 8, "the same words again and again " * 8]


def grams(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def test_crc_of_spans_of_any_length():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 40_000, dtype=np.uint8)
    reach = resampling.REACH
    length = np.concatenate([[1, reach - 1, reach, reach + 1, 2 * reach, 3 * reach + 1, 40_000 - 7], rng.integers(1, 40, 300), rng.integers(1, 2000, 200)])
    start = np.concatenate([[0, 5, 9, 0, 1, 2, 7], rng.integers(0, 38_000, 500)])
    wanted = [zlib.crc32(data[s : s + n].tobytes()) for s, n in zip(start, length)]
    assert resampling.crcs(data, start, start + length).tolist() == wanted
    assert resampling.crcs(data, start[:0], start[:0]).tolist() == []


def test_weights_and_draw_by_brute_force(spark):
    docs = [(i, t, "clash") for i, t in enumerate(TEXTS * 9)] + [(None, "words " * 40, "x"), (3, "a repeated id " * 20, "x")]
    target = [(0, "one two three over again"), (1, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, weight string").repartition(3)
    got = resampling.drawn(resampling.weighed(frame, spark.createDataFrame(target, "item_id long, text string"), 50), 20, 8)
    buckets = lambda rows: Counter(zlib.crc32(f.encode()) % 50 for t in rows for f in grams(t)[1])
    s, t = buckets([d[1] for d in docs]), buckets([d[1] for d in target])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 50) / ((s[b] + 1) * (t.total() + 50)))) for b in range(50)]
    wanted = []
    for i, text, _ in docs:
        words, found = grams(text)
        weight = sum(gain[zlib.crc32(f.encode()) % 50] for f in found)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        wanted.append([i, len(found), weight, len(words), score, None])
    able = sorted((r for r in wanted if r[3] >= 8 and r[4] is not None), key=lambda r: (-r[4], r[0]))
    for n, r in enumerate(able[: len(able) * 20 // 100], 1):
        r[5] = n
    assert sorted(map(repr, map(list, got.select("doc_id", "n_features", "weight", "n_words", "score", "rank").collect()))) == sorted(map(repr, wanted))
    assert sum(r[5] is not None for r in wanted) > 3


def test_nothing_to_draw_from(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.drawn(resampling.weighed(none, none)).collect() == []


def by_hand(rows):
    """The contract of the query in plain Python."""
    turns = defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((n is not None, n, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + mine[h:]
    members = defaultdict(list)
    for c, seq in sorted(whole.items()):
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    out = []
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = sum(not any(y[: len(x)] == x and len(y) > len(x) for y in below) for x in below)
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(str(c) for c in convs if len(whole[c]) == len(node))
        out.append((convs[0], len(node), members[node[:-1]][0] if node else None, len(convs), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of_trie(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    return sorted(map(tuple, trie.prefix_trie(*trie.rebuilt(trie.ordered(frame))).collect()), key=repr)


def test_trie_by_hand(spark):
    rng = np.random.default_rng(3)
    rows = [(int(c), int(t), "user" if t % 2 else None, f"text {rng.integers(0, 2)}") for c in range(-6, 40) for t in range(rng.integers(1, 12))]
    rows += [(50, None, "user", "before all"), (50, 1, None, None), (50, 1, "a", "tie"), (50, 1, "b", "tie"), (50, 1, "b", "tie"), (None, 0, "user", "nobody's"), (61, 0, "user", "one turn, whose base is absent")]
    rows += [(c, t, "user", f"long {t % 7}") for c in (70, 71, 75) for t in range(37)]
    assert rows_of_trie(spark, rows) == by_hand(rows)


def test_trie_of_nothing_and_of_many_alike(spark):
    assert rows_of_trie(spark, []) == []
    rows = [(5 * c, t, "user", "same") for c in range(3000) for t in range(2)]
    assert rows_of_trie(spark, rows) == by_hand(rows)


@pytest.fixture(scope="module")
def placed(spark):
    rows = [(i, f"s{0 if i % 3 else i % 7}" if i % 11 else None, f"t{i}") for i in range(1003)] + [(5, "s0", "again")] * 4 + [(None, "s1", None)] * 2
    frame = spark.createDataFrame(rows, "doc_id long, source string, shard_text string").repartition(3)
    return rows, sharding.interleaved(frame, 7)


def test_shards_hold_the_mixture(placed):
    rows, out = placed
    got = [r.asDict() for r in out.collect()]
    assert sorted(repr((r["doc_id"], r["source"], r["shard_text"])) for r in got) == sorted(map(repr, rows))
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(n))
    for source, n in Counter(r[1] for r in rows).items():
        each = Counter(r["shard"] for r in got if r["source"] == source)
        assert all(abs(each[s] - n / 7) <= 2 for s in range(7))


def test_shards_are_alike_on_every_run(spark, placed):
    rows, out = placed
    again = sharding.interleaved(spark.createDataFrame(rows, "doc_id long, source string, shard_text string").repartition(5), 7)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, out.collect()))
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert sharding.interleaved(empty, 7).collect() == []
    few = sharding.interleaved(spark.createDataFrame(rows[:3], "doc_id long, source string, shard_text string"), 7)
    assert sorted(r["slot"] for r in few.collect()) == [0, 0, 0]


def test_shard_files_keep_the_order(spark, tmp_path):
    rows = [(i, f"s{i % 3}", "x" * i) for i in range(200)]
    sharding.write(spark.createDataFrame(rows, "doc_id long, source string, text string"), f"{tmp_path}/shards", 4)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted((r["doc_id"], r["source"], r["text"]) for r in back.collect()) == rows
    for shard in range(4):
        files = sorted((tmp_path / f"shards/shard={shard}").glob("*.parquet"))
        slots = [r["slot"] for f in files for r in spark.read.parquet(str(f)).collect()]
        assert slots == list(range(50))
