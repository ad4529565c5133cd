"""Summaries of metrics, documents and exports."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import iso, iso_short
from ..schemas import EXPORT, FRACTIONS, METRIC_NAMES, SUMMARY
from .ranks import ranked


def summarize(observations: DataFrame, keys: list[str], value: str, order: Column) -> DataFrame:
    """max, min, avg and last (by `order`, over what isn't null or NaN) of each group."""
    held = observations.withColumn("_v", F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))).where("_v IS NOT NULL")
    return held.groupBy(*keys).agg(F.max("_v").alias("max"), F.min("_v").alias("min"), F.round(F.avg("_v"), 6).alias("avg"), F.max_by("_v", order).alias("last"))


def last_of(rows: DataFrame, keys: list[str], value: str, order: list[str], name: str, count: str) -> DataFrame:
    """The value of the last row of each group by the given columns, and how many rows it has."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(name), F.count("*").alias(count))


def long(frames: DataFrame) -> DataFrame:
    """(job_id, batch_id, pos, metric, value, whole) of the valid frames that are no duplicates; whole: the exact value of a count."""
    each = (F.struct(F.lit(n).alias("metric"), F.col(f"metrics.{n}").cast("double").alias("value"), (F.lit(None) if n in FRACTIONS else F.col(f"metrics.{n}")).cast("bigint").alias("whole")) for n in METRIC_NAMES)
    kept = unique(frames).where("is_valid").select("job_id", "batch_id", "pos", F.inline(F.filter(F.array(*each), lambda x: x["value"].isNotNull())))
    return kept


def unique(frames: DataFrame) -> DataFrame:
    return frames.where(~F.coalesce(F.col("is_duplicate"), F.lit(False)))


def summary(frames: DataFrame) -> DataFrame:
    """(job_id, metric, max, min, avg, last), the last one in the order of arrival."""
    return summarize(long(frames), ["job_id", "metric"], "value", F.struct("batch_id", "pos"))


def exact_summary(frames: DataFrame) -> DataFrame:
    """summary() with counts as whole numbers of any size: max, min and last are variants, avg is a double."""
    place = F.struct("batch_id", "pos")
    held = long(frames).withColumn("value", F.nanvl("value", F.lit(None).cast("double"))).where("value IS NOT NULL")
    of = held.groupBy("job_id", "metric").agg(*(f(c).alias(f"{n}_{c}") for n, f in (("max", F.max), ("min", F.min), ("last", lambda c: F.max_by(c, place))) for c in ("value", "whole")), F.round(F.avg("value"), 6).alias("avg"))
    exact = lambda n: F.coalesce(F.col(f"{n}_whole").cast("variant"), F.col(f"{n}_value").cast("variant")).alias(n)
    return of.select("job_id", "metric", exact("max"), exact("min"), "avg", exact("last"))


def counters(frames: DataFrame) -> DataFrame:
    """How many frames of each job were answered, and how many of them are unique, duplicates and invalid (neither of both)."""
    copy, valid = F.coalesce(F.col("is_duplicate"), F.lit(False)), F.col("is_valid")
    return frames.groupBy("job_id").agg(F.count("*").alias("answered_frames"), F.count_if(valid & ~copy).alias("unique_frames"), F.count_if(valid & copy).alias("duplicate_frames"), F.count_if(~valid).alias("invalid_frames"))


def sent_counters(frames: DataFrame, batches: DataFrame, counted: DataFrame) -> DataFrame:
    """counters() of every job that frames were sent for, with total_frames and unanswered_frames: those that no valid frame of a reply tells of."""
    key = ["job_id", "batch_id", "frame_index"]
    told = frames.where("is_valid").select(*key).distinct().withColumn("_told", F.lit(True))
    sent = batches.select(*key).join(told, key, "left").groupBy("job_id").agg(F.count("*").alias("_sent"), F.count_if(F.col("_told").isNull()).alias("_open"))
    both = counted.join(sent, "job_id", "full")
    counts = {c: F.coalesce(c, F.lit(0)) for c in counted.columns if c != "job_id"}
    return both.withColumns(counts | {"total_frames": F.coalesce("_sent", "answered_frames"), "unanswered_frames": F.coalesce("_open", F.lit(0))}).drop("_sent", "_open")


def document(frames: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One JSON document per key: its rows in order, nulls kept."""
    rest = [c for c in frames.columns if c not in keys]
    rows = F.array_sort(F.collect_list(F.struct(*order, *(c for c in rest if c not in order))))
    return frames.groupBy(*keys).agg(rows.alias("frames"), F.count("*").alias("total_frames")).select(*keys, F.to_json(F.struct("total_frames", "frames"), {"ignoreNullFields": "false"}).alias("document"))


def summary_of(counted: DataFrame, frames: DataFrame) -> DataFrame:
    """counted with summary: of each metric that has values, in the order of the model, max, min, avg and last."""
    entry = F.struct(F.col("metric").alias("key"), F.struct("max", "min", "avg", "last").alias("value"))
    sums = exact_summary(frames).groupBy("job_id").agg(F.collect_list(entry).alias("_sums"))  # as many as there are metrics
    in_order = F.transform(F.array(*map(F.lit, METRIC_NAMES)), lambda n: F.get(F.filter("_sums", lambda x: x["key"] == n), F.lit(0)))
    found = F.map_from_entries(F.filter(in_order, lambda x: x.isNotNull()))
    return counted.join(sums, "job_id", "left").withColumn("summary", F.coalesce(found, F.create_map().cast(SUMMARY))).drop("_sums")


def final_document(frames: DataFrame, counted: DataFrame, at: Column) -> DataFrame:
    """(job_id, document): the final JSON document of each counted job, of its valid frames in the order of arrival.

    counted: counters(), total_frames and unanswered_frames. The summary maps each metric that has values to max, min, avg and last.
    """
    held = frames.where("is_valid").select("job_id", F.struct("batch_id", "pos", "frame_index", "is_duplicate", "duplicate_of_frame", "metrics", "metadata", "actual_frame").alias("frame"))
    every = held.groupBy("job_id").agg(F.array_sort(F.collect_list("frame")).alias("all_frames_data"))
    rows = summary_of(counted, frames).join(every, "job_id", "left")
    data = F.coalesce("all_frames_data", F.array().cast(every.schema["all_frames_data"].dataType))
    unique_data = F.filter(data, lambda x: ~F.coalesce(x["is_duplicate"], F.lit(False)))
    whole = F.struct(
        iso(at).alias("extraction_date"), "total_frames", "unique_frames", "duplicate_frames", "invalid_frames", "unanswered_frames",
        data.alias("all_frames_data"), unique_data.alias("unique_metrics"), "summary",
    )
    return rows.select("job_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("document"))


def pieces(frames: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, place, text): document() in pieces, one for each row; put together by place they are the same text.

    No task holds the rows of a document, however many they are: each row is told its place and how many there are, and
    the first and the last one carry the head and the foot.
    """
    rest = [c for c in frames.columns if c not in keys]
    text = F.to_json(F.struct(*order, *(c for c in rest if c not in order)), {"ignoreNullFields": "false"})
    rows = ranked(frames.select(*keys, *order, text.alias("_text")), keys, [*order, "_text"], "place", total="_of")
    head = F.when(F.col("place") == 0, F.concat(F.lit('{"total_frames":'), F.col("_of").cast("string"), F.lit(',"frames":['))).otherwise(",")
    foot = F.when(F.col("place") == F.col("_of") - 1, "]}").otherwise("")
    return rows.select(*keys, "place", F.concat(head, "_text", foot).alias("text"))


def final_pieces(frames: DataFrame, counted: DataFrame, at: Column) -> DataFrame:
    """(job_id, part, place, text): final_document() in pieces, put together by part and place.

    The parts are the head with the counters, all valid frames, what is between, those that are no duplicates, and the
    summary; see pieces().
    """
    held = frames.where("is_valid").select("job_id", "batch_id", "pos", F.to_json(F.struct("batch_id", "pos", "frame_index", "is_duplicate", "duplicate_of_frame", "metrics", "metadata", "actual_frame"), {"ignoreNullFields": "false"}).alias("text"), F.coalesce("is_duplicate", F.lit(False)).alias("_copy"))
    body = held.select("*", F.explode(F.when(F.col("_copy"), F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(3)))).alias("part"))
    body = ranked(body.drop("_copy"), ["job_id", "part"], ["batch_id", "pos"], "place")
    body = body.select("job_id", "part", "place", F.concat(F.when(F.col("place") > 0, ",").otherwise(""), "text").alias("text"))
    counts = F.to_json(F.struct(iso(at).alias("extraction_date"), "total_frames", "unique_frames", "duplicate_frames", "invalid_frames", "unanswered_frames"))
    sums = summary_of(counted, frames)
    frame = lambda part, text: F.struct(F.lit(part).alias("part"), F.lit(0).cast("long").alias("place"), text.alias("text"))
    head = F.concat(F.substr(counts, F.lit(1), F.length(counts) - 1), F.lit(',"all_frames_data":['))
    foot = F.concat(F.lit('],"summary":'), F.to_json("summary", {"ignoreNullFields": "false"}), F.lit("}"))
    rest = sums.select("job_id", F.inline(F.array(frame(0, head), frame(2, F.lit('],"unique_metrics":[')), frame(4, foot))))
    return body.unionByName(rest)


def stored_summaries(job_metrics: DataFrame) -> DataFrame:
    """(job_id, metric, max, min, avg, last) from the stored documents, the numbers as they are written there."""
    found = F.from_json("metrics_json", "struct<summary:map<string,struct<max:string,min:string,avg:string,last:string>>>")["summary"]
    return job_metrics.select("job_id", F.explode(found).alias("metric", "_v")).select("job_id", "metric", "_v.*")


def pivoted(summaries: DataFrame, key: str, metric: str, value: str, names: list[str]) -> DataFrame:
    """A column for each named metric; the names are given, so no job looks for them."""
    return summaries.groupBy(key).agg(*(F.max(F.when(F.col(metric) == n, F.col(value))).alias(n) for n in names))


def export_rows(jobs: DataFrame, job_metrics: DataFrame, summaries: DataFrame, limit: int = 10_000) -> DataFrame:
    """The 33 columns of the export, the newest job first: dates as ISO text, counts as whole numbers, null where there is nothing."""
    wide = pivoted(summaries, "job_id", "metric", "max", list(METRIC_NAMES))
    rows = jobs.join(job_metrics.drop("created_at"), jobs["id"] == job_metrics["job_id"], "left").drop("job_id")
    rows = rows.join(wide, rows["id"] == wide["job_id"], "left").orderBy(F.col("created_at").desc_nulls_first(), "id").limit(limit)
    shown = {n: F.col(n).try_cast("double" if n in FRACTIONS else "bigint") for n in METRIC_NAMES}
    shown |= {n: iso_short(F.col(n)) for n in ("created_at", "completed_at")} | {"campaign_date": F.col("campaign_date").cast("string")}
    return rows.select(*(shown.get(n, F.col(n)).alias(n) for n, _, _ in EXPORT))
