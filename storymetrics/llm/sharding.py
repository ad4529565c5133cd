"""Sharding by proportional stratified interleaving: every shard holds each source in the proportion of the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from . import common

SEED, SHARDS = 42, 40


def interleaved(rows: DataFrame, shards: int = SHARDS, stratum: str = "source", key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """rows with shard (0 ... shards - 1) and slot (from 0 without gaps in each shard).

    Rows of each stratum are put in the order of a seeded hash of their key; the r-th of n stands at (2 r + 1) / 2 n of the
    way. All rows are sorted by that and cut into shards of N / shards rows, whose counts differ by one at most, so each
    shard spans the same part of every stratum. Places are counted off by ranges: neither a stratum nor the whole is ever
    in one task. A null stratum is one of its own; null and repeated keys are ties, broken by a hash of the other columns; an empty
    table gives no rows.
    """
    rest = [c for c in rows.columns if c not in (stratum, key)]
    hashed = F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256), 1, 16)
    since = common.written()
    shuffled = common.saved(rows.withColumn("_hash", hashed).withColumn("_rest", F.xxhash64(*rest)), "shards")
    order = ["_hash", key, "_rest"]
    nth = ranked(shuffled, [stratum], order, "_nth", total="_of").withColumn("_along", (2 * F.col("_nth") + 1) / (2 * F.col("_of")).cast("double")).drop("_nth", "_of")
    nth = common.alone(nth, "shards", since)
    placed = ranked(nth, [], ["_along", stratum, *order], "_at", total="_all")
    shard = F.expr(f"_at * {shards} div _all")
    begin = F.expr(f"(shard * _all + {shards - 1}) div {shards}")  # the first place of the shard
    out = placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("_at") - begin)
    return common.alone(out.select(*rows.columns, "shard", "slot"), "shards", since)


def write(rows: DataFrame, path: str, shards: int = SHARDS, stratum: str = "source", key: str = "doc_id", seed: int = SEED) -> None:
    """Whole rows as files in a folder for each shard: the files of a shard follow each other in the order of their slots.

    Ranges of (shard, slot) are dealt to as many tasks as the session's shuffles have, so a shard may be larger than a task.
    """
    placed = interleaved(rows, shards, stratum, key, seed)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    common.dropped(placed)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `rows`: counts of shards are at most one apart. Texts themselves don't travel: a row is its size and checksum."""
    text = common.texts(common.table(spark, sf_dir, "documents"), "source")
    slim = text.select("doc_id", "source", (F.octet_length("text") + 16).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    out = interleaved(slim)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
