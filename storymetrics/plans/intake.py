"""Intake manifests and the processing of replies to stored metrics."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..functions import names, replies
from ..operators import metrics
from ..operators.frames import named
from ..sources import documents
from ..sources.store import Store


def validate(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted with id, file_type and date; rejected with reason)."""
    day = names.campaign_date(F.col("campaign_date"))
    rows = manifest.withColumn("ext", names.suffix(F.col("filename"))).withColumn("file_type", names.file_type(F.col("ext"))).withColumn("_day", day)
    rows = rows.withColumn("reason", F.when(F.col("file_type").isNull(), "file type").when(F.col("_day").isNull(), "date"))
    good = rows.where("reason IS NULL").withColumn("campaign_date", F.col("_day")).withColumn("id", names.job_id(F.col("company"), F.col("campaign_name"), F.col("submitted_at")))
    return good.drop("_day", "reason", "ext"), rows.where("reason IS NOT NULL").drop("_day", "ext", "file_type")


def run_replies(store: Store, answered: DataFrame, at: Column, batches: DataFrame | None = None) -> DataFrame:
    """Parses the replies of jobs, stores each job's final document, counters and invalid frames, completes the jobs; returns the counters.

    batches: the frames that were sent (job_id, batch_id, frame_index, filename); they name the frames of the replies, the
    document's total_frames counts them, and unanswered_frames those of them that no valid frame of a reply tells of; a job whose batches
    all failed has a document too. Without them total_frames counts the frames that were answered.
    """
    since = scratch.written()
    frames = scratch.saved(replies.parse(answered), "frames")  # as a table: the plan of the parsing is large, and all that is stored comes from it
    counted = metrics.counters(frames)
    jobs = answered.select("job_id")
    total = counted.withColumn("total_frames", F.col("answered_frames")).withColumn("unanswered_frames", F.lit(0).cast("long"))
    if batches is not None:
        jobs = jobs.union(batches.select("job_id"))
        total = metrics.sent_counters(frames, batches, counted)
        frames = named(frames, batches)
    total = scratch.saved(total, "counters")
    stored = metrics.final_document(frames, total, at).join(total.select("job_id", F.col("total_frames").alias("_total")), "job_id")
    new = stored.select("job_id", F.col("_total").cast("int").alias("total_frames"), F.lit(None).cast("int").alias("good_frames"), F.lit(None).cast("int").alias("bad_frames"), F.lit(None).cast("int").alias("processing_time_seconds"), F.col("document").alias("metrics_json"), at.cast("timestamp_ntz").alias("created_at"))
    documents.put_pieces(metrics.final_pieces(frames, total, at), f"{store.root}/documents")
    store.quarantine(jobs.distinct(), frames.where("NOT is_valid").withColumn("created_at", at.cast("timestamp_ntz")))
    store.upsert_metrics(scratch.saved(new, "documents"))
    store.set_statuses(total.select(F.col("job_id").alias("id")), "completed", at)
    counts = total.collect()  # a row for each job of the call
    for path in scratch.written_since(since):
        scratch.delete(store.spark, path)
    return store.spark.createDataFrame(counts, total.schema)
