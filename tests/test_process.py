"""What a job's row and document tell beside its metrics, and the switches of a deployment."""

import json
import os
import zipfile

import pytest

from storymetrics.operators import frames
from storymetrics.plans import process as plan
from storymetrics.plans.process import process
from storymetrics.settings import Settings
from storymetrics.sources.store import Store
from tests.clocks import Still, provider
from tests.test_reference import at, picture, png


def decoder(videos, folder):
    """Each video is a picture, which becomes its frame 0, in a folder by number."""
    for r in videos.collect():
        os.makedirs(f"{folder.removeprefix('file://')}/{r['idx']}")
        with open(f"{folder.removeprefix('file://')}/{r['idx']}/frame_000000.png", "wb") as file:
            file.write(r["content"])


@pytest.fixture
def store(spark, tmp_path):
    held = Store(spark, f"file://{tmp_path}/store", "s")
    held.add_jobs(spark.createDataFrame([(i, "x") for i in ("one", "two", "three")], "id string, company string").withColumn("created_at", at()))
    return held


@pytest.fixture
def setting(spark):
    names = []

    def put(name, value):
        names.append(f"spark.storymetrics.{name}")
        spark.conf.set(names[-1], value)

    yield put
    for n in names:
        spark.conf.unset(n)


def archive(tmp_path, **members):
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        for name, content in members.items():
            z.writestr(name.replace("__", "/").replace("_ext_", "."), content)
    return f"{tmp_path}/c.zip"


def names_of(store, job):
    return [f["actual_frame"] for f in json.loads(store.job(job).first()["metrics_json"])["all_frames_data"]]


def test_frames_of_several_videos_keep_apart(store, tmp_path):
    path = archive(tmp_path, **{f"v{i}_ext_mp4": png(picture("sharp")) for i in range(12)})
    assert process(store, "one", path, "zip", provider, at(), decoder=decoder) == "completed"
    assert names_of(store, "one") == [f"{i:06d}_frame_000000.png" for i in range(1, 13)]


def test_last_frame_of_a_name_wins_where_names_are_not_qualified(store, tmp_path, setting):
    setting("qualify_names", "false")
    path = archive(tmp_path, a_ext_mp4=png(picture("dark")), b_ext_mp4=png(picture("sharp")))
    assert process(store, "one", path, "zip", provider, at(), decoder=decoder) == "completed"
    assert names_of(store, "one") == ["frame_000000.png"] and store.job("one").select("total_frames", "good_frames").first()[:] == (2, 1)


def test_pictures_in_archives(spark, store, tmp_path, setting):
    path = archive(tmp_path, a_ext_mp4=png(picture("sharp")), d__b_ext_png=png(picture("sharp")))
    assert process(store, "one", path, "zip", provider, at(), decoder=decoder) == "completed"
    setting("archive_images", "true")
    assert process(store, "two", path, "zip", provider, at(), decoder=decoder) == "completed"
    assert len(names_of(store, "one")) == 1 and len(names_of(store, "two")) == 2 and any(n.endswith("_000001_b.png") for n in names_of(store, "two"))


def test_pictures_are_read_unless_the_old_rule_holds(store, tmp_path, setting):
    (tmp_path / "p.png").write_bytes(png(picture("sharp")))
    assert process(store, "one", f"{tmp_path}/p.png", "image", provider, at()) == "completed"
    setting("legacy_image_rule", "true")
    assert process(store, "two", f"{tmp_path}/p.png", "image", provider, at()) == "completed"
    held = {r["id"]: r["warnings"] for r in store.table("jobs").collect()}
    assert names_of(store, "one") == ["p.png"] and store.job("two").first()["metrics_json"] == "{}"
    assert held == {"one": None, "two": ["uploaded pictures are not read"], "three": None}


def test_a_completed_job_says_what_failed(spark, store, tmp_path, setting):
    setting("batch_size", "2")
    folder = tmp_path / "pictures"
    folder.mkdir()
    for i in range(5):
        (folder / f"f{i}.png").write_bytes(png(picture("sharp")))
    (folder / "broken.png").write_bytes(b"no picture")

    def silent(images):
        return provider(images) if images[0][0] == "f4.png" else "[]"

    assert process(store, "one", str(folder), "image", silent, at(), clock=Still()) == "completed"
    row = store.job("one").first()
    found = json.loads(row["metrics_json"])
    assert row["warnings"] == ["1 frames without a score", "2 batches without a usable reply"]
    assert (found["total_frames"], found["unique_frames"], found["unanswered_frames"]) == (5, 1, 4)
    assert store.table("attempts").where("outcome = 'empty'").count() == 10 and store.table("attempts").count() == 11
    assert process(store, "two", str(folder / "broken.png"), "image", silent, at()) == "completed"
    assert store.job("two").first()["warnings"] == ["1 frames without a score", "no good frames"]
    assert process(store, "three", str(folder / "f0.png"), "image", lambda images: None, at(), clock=Still()) == "completed"
    assert json.loads(store.job("three").first()["metrics_json"])["unanswered_frames"] == 1


def test_scored_frames_are_counted_in_passing(spark):
    from storymetrics import scratch
    from storymetrics.operators import counters

    rows = spark.createDataFrame([("GOOD",), ("GOOD",), ("BAD",), (None,)], "label string")
    held, seen = counters.observed(rows, *counters.of_frames())
    scratch.saved(held, "test")
    assert seen.get == frames.counts(rows).first().asDict()
    assert plan.warnings({"failed_frames": 0, "good_frames": 1}, "image", Settings()) == []


def test_settings_of_truth(spark, setting):
    setting("archive_images", "TRUE")
    assert Settings.of(spark).archive_images is True and Settings.of(spark).qualify_names is True
    setting("qualify_names", "perhaps")
    with pytest.raises(ValueError, match="neither true nor false"):
        Settings.of(spark)
