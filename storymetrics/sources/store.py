"""A table store on files. One writer is assumed.

Tables with a key lie in folders by a hash of the key, about ROWS rows in each; a change rewrites the folders that hold
its keys (Spark's dynamic partition overwrite) and nothing else. Once folders have grown too large, the table is written
anew in twice as many, as the next version; the newest complete version counts.
"""

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas, scratch
from ..functions import names
from ..operators import jobs as ops

#: Versions of a table that are kept; rows that a folder of a new version holds, and bytes beyond which folders are too large.
KEPT, ROWS, BYTES = 3, 4096, 4 << 20
#: The keys of the tables that are changed by row.
KEYS = {"jobs": "id", "job_metrics": "job_id", "quarantine": "job_id", "attempts": "job_id"}
TABLES = {"jobs": schemas.JOBS, "job_metrics": schemas.JOB_METRICS, "quarantine": schemas.QUARANTINE, "attempts": schemas.ATTEMPTS, "users": schemas.USERS, "rejected": schemas.REJECTED}


class Store:
    def __init__(self, spark: SparkSession, root: str, salt: str):
        self.spark, self.root, self.salt = spark, root.rstrip("/"), salt
        for name, ddl in TABLES.items():
            if self.version(name) is None:
                self.put(name, spark.createDataFrame([], T.StructType.fromDDL(ddl)))

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _versions(self, name: str) -> list[tuple[int, int, str]]:
        """(version, folders, path) of all versions, also of those whose writer is under way."""
        fs, base = self._fs(f"{self.root}/{name}")
        found = [(re.fullmatch(r"v=(\d+)_of_(\d+)", s.getPath().getName()), s.getPath().toString()) for s in fs.listStatus(base)] if fs.exists(base) else []
        return sorted((int(m[1]), int(m[2]), path) for m, path in found if m)

    def _newest(self, name: str) -> tuple[int, int, str] | None:
        """The newest complete version: that whose writer has left its success mark."""
        return max((v for v in self._versions(name) if self._fs(f"{v[2]}/_SUCCESS")[0].exists(self._fs(f"{v[2]}/_SUCCESS")[1])), default=None)

    def version(self, name: str) -> int | None:
        newest = self._newest(name)
        return newest and newest[0]

    def _bucket(self, name: str, n: int, key: str | Column | None = None) -> Column:
        return F.pmod(F.xxhash64(KEYS[name] if key is None else key), F.lit(n)).cast("int")

    def put(self, name: str, rows: DataFrame, buckets: int | None = None) -> None:
        """Writes the next version; KEPT versions stay, for readers that are under way."""
        new = (self.version(name) or 0) + 1
        keyed = name in KEYS
        n = buckets or (1 << max(0, (rows.count() // ROWS).bit_length()) if keyed else 1)
        if keyed:
            rows = rows.withColumn("bucket", self._bucket(name, n)).repartition("bucket").sortWithinPartitions("bucket")
        (rows.write.partitionBy("bucket") if keyed else rows.write).parquet(f"{self.root}/{name}/v={new}_of_{n}")
        for version, _, path in self._versions(name):
            if version <= new - KEPT:
                fs, p = self._fs(path)
                fs.delete(p, True)

    def _read(self, name: str) -> tuple[DataFrame, int, str]:
        """(rows with their bucket, how many buckets, path) of the newest version."""
        _, n, path = self._newest(name)
        ddl = TABLES.get(name)
        reader = self.spark.read.schema(ddl + (", bucket int" if name in KEYS else "")) if ddl else self.spark.read
        return reader.parquet(path), n, path

    def table(self, name: str) -> DataFrame:
        return self._read(name)[0].drop("bucket")

    def rows_of(self, name: str, key: str) -> DataFrame:
        """The rows of one key, from its folder alone."""
        rows, n, _ = self._read(name)
        return rows.where((F.col("bucket") == self._bucket(name, n, F.lit(key))) & (F.col(KEYS[name]) == key)).drop("bucket")

    def near(self, name: str, keys: DataFrame, column: str) -> DataFrame:
        """The rows of the folders in which the keys of a column belong: what a change of these keys has to look at."""
        rows, n, _ = self._read(name)
        return rows.where(F.col("bucket").isin(self._touched(name, n, keys, column))).drop("bucket")

    def _touched(self, name: str, n: int, keys: DataFrame, column: str) -> list[int]:
        return [r[0] for r in keys.select(self._bucket(name, n, F.col(column))).distinct().collect()]  # at most one for each folder

    def append(self, name: str, rows: DataFrame) -> int:
        """Adds rows to the newest version without rewriting it; how many."""
        held, n, path = self._read(name)
        new = scratch.saved(held.drop("bucket").limit(0).unionByName(rows, allowMissingColumns=True), name)
        count = new.count()  # from the footers of what was just written
        if count and name in KEYS:
            new.withColumn("bucket", self._bucket(name, n)).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)
            self._spread(name)
        elif count:
            new.write.mode("append").parquet(path)
        scratch.dropped(new)
        return count

    def change(self, name: str, keys: DataFrame, column: str, rows: DataFrame) -> int:
        """The given rows replace all that near(name, keys, column) has; how many they are. Folders without keys stay untouched.

        The rows are made as a table of their own first, since they come from what they replace.
        """
        held, n, path = self._read(name)
        touched = self._touched(name, n, keys, column)
        new = scratch.saved(rows.select(held.drop("bucket").columns).withColumn("bucket", self._bucket(name, n)), name)
        filled = {r[0] for r in new.select("bucket").distinct().collect()}
        if filled:
            new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        for bucket in set(touched) - filled:  # what has no rows any more isn't overwritten
            fs, p = self._fs(f"{path}/bucket={bucket}")
            fs.delete(p, True)
        count = new.count()
        scratch.dropped(new)
        self._spread(name)
        return count

    def _spread(self, name: str) -> None:
        """Writes a table whose folders have grown too large in twice as many."""
        _, n, path = self._newest(name)
        fs, p = self._fs(path)
        if fs.getContentSummary(p).getLength() > n * BYTES:
            self.put(name, self.table(name), 2 * n)

    def add_jobs(self, new: DataFrame, order: list[str] | None = None) -> int:
        """How many were added; a taken id is refused, and of several new rows with one id the first is taken. New jobs are being processed."""
        return self.append("jobs", ops.add(self.near("jobs", new, "id"), new, "id", order).withColumn("status", F.lit("processing")))

    def reject(self, rows: DataFrame) -> int:
        """Keeps manifests that were not accepted, with the reason."""
        return self.append("rejected", rows)

    def set_status(self, job_id: str, status: str, at: Column, error: str | None = None) -> int:
        one = self.spark.createDataFrame([(job_id,)], "id string")
        hit = self.rows_of("jobs", job_id).count()
        if hit:
            self.set_statuses(one, status, at, error)
        return hit

    def set_statuses(self, ids: DataFrame, status: str, at: Column, error: str | None = None) -> None:
        """The status of all jobs with the ids (id), in one change."""
        jobs = self.near("jobs", ids, "id")
        chosen = jobs.join(ids.select("id").distinct().withColumn("_chosen", F.lit(True)), "id", "left")
        self.change("jobs", ids, "id", ops.set_status(chosen, F.coalesce("_chosen", F.lit(False)), status, at, F.lit(error).cast("string")))

    def warn(self, job_id: str, warnings: list[str]) -> None:
        """Adds warnings to a job's row."""
        if warnings:
            one = self.spark.createDataFrame([(job_id,)], "id string")
            more = F.concat(F.coalesce("warnings", F.array().cast("array<string>")), F.array(*map(F.lit, warnings)))
            self.change("jobs", one, "id", self.near("jobs", one, "id").withColumn("warnings", F.when(F.col("id") == job_id, more).otherwise(F.col("warnings"))))

    def upsert_metrics(self, new: DataFrame) -> int:
        """How many rows were written; rows of unknown jobs are refused."""
        known = ops.one_of(ops.with_parent(new, self.near("jobs", new, "job_id"), "job_id", "id"), "job_id", ["created_at"], last=True)
        n = known.count()
        self.change("job_metrics", new, "job_id", ops.upsert(self.near("job_metrics", new, "job_id"), known, "job_id", "created_at"))
        return n

    def set_counts(self, job_id: str, total: int, good: int, bad: int, seconds: int, at: Column) -> None:
        """The frame counters and seconds of a job, beside the document that it may have ({} if it has none)."""
        held = self.rows_of("job_metrics", job_id).select("metrics_json")
        row = self.spark.createDataFrame([(job_id, total, good, bad, seconds)], "job_id string, total_frames int, good_frames int, bad_frames int, processing_time_seconds int")
        new = row.join(held, F.lit(True), "left").withColumn("metrics_json", F.coalesce("metrics_json", F.lit("{}"))).withColumn("created_at", at.cast("timestamp_ntz"))
        self.upsert_metrics(new)

    def replace(self, name: str, answered: DataFrame, rows: DataFrame) -> None:
        """The rows replace what a table held of the answered jobs (job_id); those of unknown jobs are refused."""
        held, jobs = self.near(name, answered, "job_id"), self.near("jobs", answered, "job_id")
        new = ops.with_parent(rows.select(held.columns), jobs, "job_id", "id")
        self.change(name, answered, "job_id", held.join(answered.select("job_id"), "job_id", "left_anti").select(held.columns).unionByName(new))

    def quarantine(self, answered: DataFrame, invalid: DataFrame) -> None:
        """The invalid frames of the answered jobs replace what was held of these jobs; those of unknown jobs are refused."""
        self.replace("quarantine", answered, invalid)

    def job(self, job_id: str) -> DataFrame:
        return ops.with_metrics(self.rows_of("jobs", job_id), self.rows_of("job_metrics", job_id), "id", "job_id", "total_frames", "good_frames", "bad_frames", "processing_time_seconds", "metrics_json")

    def list_jobs(self, status: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
        shown = ops.page(self.table("jobs"), "created_at", "id", status, limit, offset)
        joined = ops.with_metrics(shown, self.table("job_metrics"), "id", "job_id", "total_frames", "good_frames", "bad_frames", "processing_time_seconds", "metrics_json")
        return ops.page(joined, "created_at", "id", limit=limit)

    def add_user(self, name: str, password: str, at: Column) -> bool:
        users = self.table("users")
        if users.where(F.col("username") == name).limit(1).count():
            return False
        row = self.spark.range(1).select((F.lit(users.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]) + 1).cast("bigint").alias("id"), F.lit(name).alias("username"), names.digest(F.lit(password), self.salt).alias("password_hash"), at.cast("timestamp_ntz").alias("created_at"))
        self.append("users", row)
        return True

    def bootstrap(self, name: str, password: str, at: Column) -> bool:
        """Adds the first user to a store that has none."""
        return not self.count_users() and self.add_user(name, password, at)

    def check_user(self, name: str, password: str) -> bool:
        return ops.users_matching(self.table("users"), name, names.digest(F.lit(password), self.salt)).count() == 1

    def count_users(self) -> int:
        return ops.counted(self.table("users"), "users").first()[0]
