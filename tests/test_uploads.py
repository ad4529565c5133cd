"""Uploads and manifests as a stream, in any order of arrival."""

import json
import os

import pytest

from storymetrics.operators.counters import StreamCounters
from storymetrics.sources.store import Store
from storymetrics.streaming.intake import run_uploads

HOUR = 3600


@pytest.fixture
def landing(spark, tmp_path):
    for d in ("manifests", "uploads", "done"):
        (tmp_path / d).mkdir()
    store = Store(spark, f"file://{tmp_path}/store", "s")

    def put(name, second, manifest=True, upload=True):
        day = f"2024-01-05T{second // HOUR % 24:02d}:{second // 60 % 60:02d}:{second % 60:02d}"
        if manifest:
            line = {"filename": f"{name}.mp4", "campaign_date": "2024-1-5", "campaign_name": name, "product_name": "p", "company": "Acme", "submitted_at": day}
            (tmp_path / f"manifests/{name}.json").write_text(json.dumps(line) + "\n")
            os.utime(tmp_path / f"manifests/{name}.json", (1_700_000_000 + second,) * 2)
        if upload:
            (tmp_path / f"uploads/{name}.mp4").write_bytes(b"video")
            os.utime(tmp_path / f"uploads/{name}.mp4", (1_700_000_000 + second,) * 2)

    def run(**more):
        run_uploads(spark, f"{tmp_path}/manifests", f"{tmp_path}/uploads", f"{tmp_path}/cp", store, **more)
        jobs = {r["id"].split("_")[1]: r["path"].rsplit("/", 1)[-1] for r in store.table("jobs").collect()}
        return jobs, sorted((r["filename"], r["reason"]) for r in store.table("rejected").collect())

    return put, run


def test_either_may_come_first_and_orphans_are_set_apart(spark, landing):
    put, run = landing
    counters = StreamCounters()
    spark.streams.addListener(counters)
    put("early", 0, upload=False)
    put("late", 60, manifest=False)
    assert run() == ({}, [])
    put("early", 600, manifest=False)
    put("late", 660, upload=False)
    assert run() == ({"early": "early.mp4", "late": "late.mp4"}, [])
    assert run() == ({"early": "early.mp4", "late": "late.mp4"}, [])
    put("lonely", 900, manifest=False)
    put("forgotten", 1000, upload=False)
    put("toolate", 1100, upload=False)
    assert run()[1] == []
    put("toolate", 1100 + 2 * HOUR, manifest=False)
    put("next", 6 * HOUR)
    jobs, rejected = run()
    put("last", 12 * HOUR)
    jobs, rejected = run()
    assert jobs == {n: f"{n}.mp4" for n in ("early", "late", "next", "last")}
    assert rejected == [("forgotten.mp4", "no upload"), ("lonely.mp4", "no manifest"), ("toolate.mp4", "no manifest"), ("toolate.mp4", "no upload")]
    spark._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    spark.streams.removeListener(counters)
    assert counters.totals["uploads"] == {"met": 4, "no_upload": 2, "no_manifest": 2}


def test_done_manifests_are_put_away(landing, tmp_path):
    put, run = landing
    put("one", 0)
    assert run(archive=f"{tmp_path}/done")[0] == {"one": "one.mp4"}
    put("two", 60)
    run(archive=f"{tmp_path}/done")
    assert len(list((tmp_path / "done").rglob("one.json"))) == 1 and not (tmp_path / "manifests/one.json").exists()
