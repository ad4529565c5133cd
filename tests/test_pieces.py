"""Documents in pieces: the same text as in one, from many tasks."""

import json

from pyspark.sql import functions as F

from storymetrics.operators import frames, metrics
from storymetrics.sources import documents


def test_pieces_are_the_document(spark):
    rows = spark.createDataFrame([("a", i % 7, f"x{i}" if i % 3 else None) for i in range(50)] + [("b", 1, "one"), (None, 1, "none")], "job string, n long, name string")
    whole = {r["job"]: r["document"] for r in metrics.document(rows, ["job"], ["n"]).collect()}
    parts = {}
    for r in sorted(metrics.pieces(rows, ["job"], ["n"]).collect(), key=lambda r: r["place"]):
        parts[r["job"]] = parts.get(r["job"], "") + r["text"]
    sort = lambda text: sorted(map(repr, json.loads(text)["frames"]))  # noqa: E731 - rows of equal place come in any order
    assert {k: sort(v) for k, v in parts.items()} == {k: sort(v) for k, v in whole.items()}
    assert [f["n"] for f in json.loads(parts["a"])["frames"]] == sorted(f["n"] for f in json.loads(whole["a"])["frames"])


def test_a_large_document_is_written_by_many_tasks(spark, tmp_path):
    n = 300_000
    rows = spark.range(n).select(F.lit("big").alias("job_id"), F.col("id").alias("pos"), F.sha2(F.col("id").cast("string"), 256).alias("name"))
    documents.put_pieces(metrics.pieces(rows, ["job_id"], ["pos"]), str(tmp_path))
    documents.put_pieces(metrics.pieces(rows.limit(2).withColumn("job_id", F.lit("small")), ["job_id"], ["pos"]), str(tmp_path))
    files = sorted((tmp_path / "metrics/job_id=big").glob("*.txt"))
    found = json.loads("".join(f.read_text() for f in files))
    assert len(files) > 1 and max(f.stat().st_size for f in files) < sum(f.stat().st_size for f in files) / 2
    assert found["total_frames"] == n and [f["pos"] for f in found["frames"]] == list(range(n))


def test_batches_of_one_large_job(spark):
    rows = spark.range(20_000).select(F.lit("j").alias("job_id"), (F.col("id") * 7919 % 20_000).alias("n"))
    out = frames.batched(rows, "job_id", ["n"])
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.where("batch_id <> n div 50 OR frame_index <> n % 50").count() == 0
