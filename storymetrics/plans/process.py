"""A job from its landed file to its stored document: frames, quality, batches, replies, summary, status."""

import base64
import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..functions import names
from ..operators import attempts, counters
from ..operators import frames as frame_ops
from ..operators import jobs as job_ops
from ..schemas import IMAGES
from ..settings import Settings
from ..sources import archives, documents, media
from ..sources.store import Store
from .asking import Clock, Pace, Provider, asked
from .intake import run_replies

#: What writes the frames of videos (path, name, content) as picture files to a folder.
Decoder = Callable[[DataFrame, str], None]


def data_url(content: bytes, kind: str = "image/jpeg") -> str:
    return f"data:{kind};base64,{base64.b64encode(content).decode()}"


def pictures(spark: SparkSession, job_id: str, path: str, file_type: str, decoder: Decoder | None, folder: str, root: str, at: Column, images: bool = False) -> str:
    """Where the pictures of a job lie: the file itself for an image, else the folder that the decoder writes to.

    images: pictures in an archive are put there too. Frames of several videos stay apart if the decoder puts them into a
    folder for each number of a video.
    """
    if file_type == "image":
        return path
    if decoder is None:
        raise ValueError(f"a {file_type} needs a decoder")
    if file_type == "zip":
        members = media.expand_archives(spark, path)
        decoder(members.where("status = 'success'"), folder)
        found = members.select("path", "idx", "name", "status", "error", F.lit(None).cast("long").alias("frames"))
        documents.put(media.campaign_summary(found, job_id, path.rsplit("/", 1)[-1], job_id, at), f"{root}/documents", job_id, "campaign_summary")
        if images:
            put = archives.extracted(archives.members(spark, path, IMAGES), f"{folder}/images")
            documents.put(put.select("name", "size", "status", "error"), f"{root}/documents", job_id, "archive_images")
    else:
        landed = media.files(spark, path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")
        decoder(landed, folder)
    return folder


def answer(store: Store, batches: DataFrame, provider: Provider, retries: int, at: Column, clock: Clock | None = None, pace: Pace | None = None) -> None:
    """Asks for a job's batches, keeps the log of attempts, and stores what the replies tell; the job's row is warned of batches without one."""
    log = asked(batches, provider, retries, clock, pace)
    keys = ["job_id", "batch_id"]
    held = attempts.answers(log, keys)
    run_replies(store, held.where("reply IS NOT NULL").select(*keys, "reply"), at, batches.select(*keys, "frame_index", "filename"))
    store.replace("attempts", log.select("job_id").distinct(), log.withColumn("created_at", at.cast("timestamp_ntz")))
    for r in held.where("reply IS NULL").groupBy("job_id").agg(F.count("*").alias("n")).collect():  # a row for each job of the call
        store.warn(r["job_id"], [f"{r['n']} batches without a usable reply"])
    scratch.dropped(log)


def warnings(counted: dict[str, int], file_type: str, limits: Settings) -> list[str]:
    """What a job's row is warned of although the job completes."""
    told = []
    if counted["failed_frames"]:
        told.append(f"{counted['failed_frames']} frames without a score")
    if not counted["good_frames"]:
        told.append("no good frames")
    elif file_type == "image" and limits.legacy_image_rule:
        told.append("uploaded pictures are not read")
    return told


def summarized(spark: SparkSession, counted: dict[str, int], seconds: float, at: Column) -> DataFrame:
    counts = [F.lit(counted[c]).cast("long").alias(c) for c in ("total_frames", "good_frames", "bad_frames", "failed_frames")]
    return spark.range(1).select(*counts, F.lit(seconds).alias("processing_time_seconds"), at.cast("string").alias("processed_date"))


def process(
    store: Store, job_id: str, path: str, file_type: str, provider: Provider, at: Column,
    scorer: Callable[[np.ndarray], float] = frame_ops.contrast_scorer, decoder: Decoder | None = None, delete_upload: bool = False,
    clock: Clock | None = None, pace: Pace | None = None,
) -> str:
    """Runs one job and returns its status: completed, or failed with the error's text as its message.

    Frames are scored and written by label; only good ones are sent to the provider, in batches by name. A job without
    good frames has an empty document. Processing seconds are whole seconds of wall clock. Limits come from the session's
    settings. delete_upload: the landed file goes in the end, whatever the outcome.
    """
    spark, began, root = store.spark, time.monotonic(), f"{store.root}/files/{job_id}"
    limits = Settings.of(spark)
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")  # noqa: E731 - readers write paths differently
    try:
        store.set_status(job_id, "processing", at)
        place = pictures(spark, job_id, path, file_type, decoder, f"{root}/pictures", store.root, at, limits.archive_images)
        scored = frame_ops.score(media.images(spark, place), scorer).withColumn("path", plain(F.col("path")))
        scored = scored.withColumn("label", frame_ops.labelled(F.col("confidence"), limits.threshold))
        scored, seen = counters.observed(scored, *counters.of_frames())
        scored = scratch.saved(scored, "scored")  # scored and counted in one pass
        counted = seen.get
        name = names.qualified(F.col("path"), plain(F.lit(place))) if limits.qualify_names and file_type != "image" else F.element_at(F.split("path", "/"), -1)
        files = media.files(spark, place).select(plain(F.col("path")).alias("path"), "content").withColumn("filename", name)
        files = files if limits.qualify_names else job_ops.last_wins(files, ["filename"], ["path"])
        media.organize(scored.join(files, "path").withColumn("job_id", F.lit(job_id)), f"{root}/frames")
        scratch.dropped(scored)
        documents.put(summarized(spark, counted, time.monotonic() - began, at), f"{store.root}/documents", job_id, "classification_summary")
        store.warn(job_id, warnings(counted, file_type, limits))
        if counted["good_frames"] and not (file_type == "image" and limits.legacy_image_rule):
            batches = frame_ops.batched(media.good(spark, f"{root}/frames", job_id), "job_id", ["filename"], limits.batch_size)
            answer(store, batches, provider, limits.retries, at, clock, pace)
        store.set_counts(job_id, counted["total_frames"], counted["good_frames"], counted["bad_frames"], int(time.monotonic() - began), at)
        store.set_status(job_id, "completed", at)
        return "completed"
    except Exception as e:  # noqa: BLE001 - whatever stops a job is its result
        store.set_status(job_id, "failed", at, str(e))
        return "failed"
    finally:
        if delete_upload:
            documents.delete(spark, path)
