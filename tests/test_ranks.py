"""Row numbers by range: hot groups, ties, nulls."""

from collections import defaultdict

from pyspark.sql import functions as F

from storymetrics.operators.ranks import ranked


def test_numbers_are_those_of_a_window(spark):
    rows = [(f"k{i % 5}" if i % 3 else "hot", (i * 7919) % 1000, "same") for i in range(3000)] + [(None, 5, None), (None, None, "x")]
    frame = spark.createDataFrame(rows, "job string, place long, n string").repartition(4)
    got = ranked(frame, ["job"], [F.col("place").desc_nulls_first()], "at", total="of", parts=16).collect()
    groups = defaultdict(list)
    for r in got:
        groups[r["job"]].append(r)
    assert sorted(map(repr, ((r["job"], r["place"], r["n"]) for r in got))) == sorted(map(repr, rows))
    for held in groups.values():
        held.sort(key=lambda r: r["at"])
        assert [r["at"] for r in held] == list(range(len(held))) and {r["of"] for r in held} == {len(held)}
        places = [r["place"] for r in held]
        assert places == sorted(places, key=lambda p: (p is not None, -(p or 0)))


def test_copies_beyond_a_partition_and_no_keys(spark):
    frame = spark.range(1000).select(F.lit("one").alias("job"), F.lit(1).alias("place"))
    assert sorted(r["at"] for r in ranked(frame, ["job"], ["place"], "at", parts=8).collect()) == list(range(1000))
    alone = ranked(spark.range(500), [], ["id"], "at", parts=8).collect()
    assert all(r["at"] == r["id"] for r in alone)
    assert ranked(spark.range(0), [], ["id"], "at", total="of", parts=8).collect() == []
