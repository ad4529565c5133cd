"""Row numbers by group and order, without a task that holds a group."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch


def ranked(rows: DataFrame, keys: list[str], order: list[str | Column], name: str, total: str | None = None, parts: int | None = None) -> DataFrame:
    """rows with `name`: the place of each row, from 0, among those with its keys; total: how many these are.

    Rows are dealt by ranges of keys and order, so that a group of any size lies in as many partitions as it needs; each
    partition is sorted and its rows are counted off. A group's run in a partition then starts where its runs in the
    partitions before it end, which takes one row for each run. Without keys all rows are one group. Null keys are a
    group of their own; ties are counted off in any order, also those of more copies than a partition holds. Parts: as
    many as the session's shuffles have.
    """
    spark = rows.sparkSession
    by = [*keys, *order, "_tie"]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *by)
    # the ranges come from a sample, anew in each execution, so they are only read as they were written
    placed = scratch.saved(dealt.sortWithinPartitions(*by).drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)  # the upper bits are the partition's number
    runs = placed.groupBy(*(F.col(k).alias(f"_of_{k}") for k in keys), part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    group = Window.partitionBy(*(f"_of_{k}" for k in keys))
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("_base", F.col("_first") - before).withColumn("_total", F.sum("_n").over(group)).drop("_first", "_n")
    starts = scratch.sided(scratch.saved(runs, "ranked"))
    same = part == starts["_part"]
    for k in keys:
        same = same & placed[k].eqNullSafe(starts[f"_of_{k}"])
    out = placed.join(starts, same).withColumn(name, F.col("_at") - F.col("_base"))
    return out.select(*rows.columns, name, *([F.col("_total").alias(total)] if total else []))
