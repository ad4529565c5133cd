"""Landing folders, archives and images."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..schemas import VIDEO
from . import archives


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(path)


def is_member(name: Column, suffixes: tuple[str, ...] = VIDEO) -> Column:
    """A video that isn't in the resource folder that some systems add to archives."""
    return names.suffix(name).isin(*suffixes) & ~F.startswith(name, F.lit("__MACOSX"))


def expand_archives(spark: SparkSession, path: str, suffixes: tuple[str, ...] = VIDEO) -> DataFrame:
    """(path, idx, name, content, status, error): the members of each archive that are videos; no other is read.

    Members are found by the archives' directories and read by their ranges, see `archives`.
    """
    return archives.unpacked(archives.members(spark, path, suffixes))


def organize(frames: DataFrame, root: str) -> None:
    """Writes labelled frames (job_id, label, filename, content and what else they have) to folders by job and label."""
    frames.where("label IS NOT NULL").write.mode("overwrite").partitionBy("job_id", "label").parquet(root)


def good(spark: SparkSession, root: str, job_id: str) -> DataFrame:
    """The good frames of a job that organize() wrote, by name; none if there are none."""
    rows = spark.read.parquet(root)
    return rows.where((F.col("job_id") == job_id) & (F.col("label") == "GOOD")).orderBy("filename")


def roll_up(members: DataFrame) -> DataFrame:
    ok = F.col("status") == "success"
    return members.groupBy("path").agg(F.count("*").alias("members"), F.count_if(ok).alias("successes"), F.sum(F.when(ok, F.col("frames")).otherwise(0)).alias("frames"))


def campaign_summary(members: DataFrame, campaign: str, original: str, job_id: str, at: Column) -> DataFrame:
    """One row of what an archive (path, idx, name, status, error, frames) gave: counts, and a result for each video in order."""
    result = F.array_sort(F.collect_list(F.struct("idx", "name", "status", "error", "frames")))
    found = members.agg(F.count("*").alias("total_videos"), F.count_if(F.col("status") == "success").alias("successful"), result.alias("results"))
    head = (F.lit(campaign).alias("campaign"), F.lit(original).alias("original_filename"), F.lit(job_id).alias("job_id"), at.cast("string").alias("processed_date"))
    return found.select(*head, "*")


def extraction_metadata(spark: SparkSession, claimed: int, extracted: int, fps: float, at: Column) -> DataFrame:
    """One row of what was read from a video: the frames that its container claims, those that were taken, and its rate."""
    return spark.createDataFrame([(claimed, extracted, float(fps))], "total_frames long, extracted_frames long, fps double").withColumn("extraction_date", at.cast("string"))
