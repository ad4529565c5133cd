"""Changes of rows touch the folders of their keys only."""

import os

from pyspark.sql import functions as F

from storymetrics.sources import store as stores
from storymetrics.sources.store import Store
from tests.test_reference import at


def filled(spark, root, n):
    store = Store(spark, f"file://{root}", "s")
    store.put("jobs", store.table("jobs").limit(0).unionByName(spark.range(n).select(F.format_string("job%07d", "id").alias("id"), F.lit("processing").alias("status"), at().alias("created_at")), allowMissingColumns=True))
    return store


def files(root):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_bytes_of_a_change_do_not_grow_with_the_table(spark, tmp_path):
    wrote = []
    for n in (10_000, 1_000_000):
        root = tmp_path / str(n)
        store = filled(spark, root, n)
        before = files(root / "jobs")
        assert store.set_status("job0000042", "failed", at(), "why") == 1
        after = files(root / "jobs")
        wrote.append(sum(size for f, size in after.items() if f not in before))
        assert len(after) == len(before) and len(set(after) - set(before)) == 1
        assert store.table("jobs").count() == n
        assert store.job("job0000042").select("status", "error_message").first()[:] == ("failed", "why")
        assert store.table("jobs").where("status = 'failed'").count() == 1
    assert wrote[1] < 2 * wrote[0]  # folders are as many as a power of two, so they hold ROWS / 2 to ROWS rows


def test_one_folder_is_read_for_one_job(spark, tmp_path):
    store = filled(spark, tmp_path, 50_000)
    plan = store.rows_of("jobs", "job0000007")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan
    assert store.rows_of("jobs", "job0000007").count() == 1 and store.rows_of("jobs", "none").count() == 0


def test_folders_that_lose_all_rows_and_tables_that_grow(spark, tmp_path, monkeypatch):
    store = filled(spark, tmp_path, 3)
    bad = spark.createDataFrame([("job0000001", 0, 0, "raw")], "job_id string, batch_id long, pos int, raw string").withColumn("created_at", at())
    store.quarantine(bad, bad)
    assert store.table("quarantine").count() == 1
    store.quarantine(bad, bad.limit(0))
    assert store.table("quarantine").count() == 0
    monkeypatch.setattr(stores, "BYTES", 500)
    new = spark.range(500).select(F.format_string("more%03d", "id").alias("id"), at().alias("created_at"))
    assert store.add_jobs(new) == 500 and store.add_jobs(new.limit(20)) == 0
    assert store._newest("jobs")[1] > 1 and store.table("jobs").count() == 503
    assert store.set_status("more007", "completed", at()) == 1 and store.rows_of("jobs", "more007").first()["status"] == "completed"
