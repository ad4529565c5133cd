"""Incremental intake: manifests that arrive in a folder become jobs, once each."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..plans.intake import validate
from ..sources.store import Store

MANIFEST = "filename string, campaign_date string, campaign_name string, product_name string, company string, submitted_at timestamp_ntz"
#: Fixed value: what Spark tells of a file.
FILE = "path string, modificationTime timestamp, length bigint, content binary"


def run_stream(spark: SparkSession, landing: str, checkpoint: str, store: Store) -> None:
    """Takes what is new in the folder (JSON lines) and stops; a rerun adds nothing, and taken ids are refused.

    Manifests that are not accepted go to the table `rejected` of the store, with the reason.
    """

    def take(batch: DataFrame, _: int) -> None:
        accepted, rejected = validate(batch)
        if rejected.limit(1).count():
            store.reject(rejected)
        store.add_jobs(accepted.withColumnRenamed("submitted_at", "created_at").withColumn("created_at", F.col("created_at").cast("timestamp_ntz")))

    source = spark.readStream.schema(MANIFEST).json(landing)
    source.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_uploads(spark: SparkSession, manifests: str, uploads: str, checkpoint: str, store: Store, wait: str = "1 hour", archive: str | None = None) -> None:
    """Joins what is new in two folders, manifests and the files that they name, in either order, and stops.

    A manifest and its file, each no more than `wait` before or after the other by their times of change, make one job,
    which knows where its file lies. What has waited longer, by the times of what has come since in both folders, goes to
    `rejected`: a manifest as "no upload", a file as "no manifest". Manifests that are not accepted go there too. Only
    names of uploads are read. archive: a folder to which manifests are moved once they are done. A rerun adds nothing.
    """
    told = spark.readStream.schema(MANIFEST)
    if archive:
        told = told.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    told = told.json(manifests).select("*", F.col("_metadata.file_modification_time").alias("_told")).withWatermark("_told", wait)
    landed = spark.readStream.format("binaryFile").schema(FILE).load(uploads).select("path", F.col("modificationTime").alias("_landed")).withWatermark("_landed", wait)
    landed = landed.withColumn("_name", F.element_at(F.split("path", "/"), -1))
    near = F.expr(f"filename = _name AND _landed >= _told - INTERVAL {wait} AND _landed <= _told + INTERVAL {wait}")
    met = F.col("filename").isNotNull() & F.col("_name").isNotNull()
    both = told.join(landed, near, "full_outer").observe("uploads", F.count_if(met).alias("met"), F.count_if(F.col("_name").isNull()).alias("no_upload"), F.count_if(F.col("filename").isNull()).alias("no_manifest"))

    def take(batch: DataFrame, _: int) -> None:
        held = scratch.saved(batch, "uploads")
        accepted, rejected = validate(held.where(met))
        alone = held.where(~met).withColumn("reason", F.when(F.col("filename").isNull(), "no manifest").otherwise("no upload")).withColumn("filename", F.coalesce("filename", "_name"))
        store.reject(rejected.unionByName(alone, allowMissingColumns=True))
        store.add_jobs(accepted.withColumn("created_at", F.col("submitted_at").cast("timestamp_ntz")))
        scratch.dropped(held)

    both.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
