"""Edge semantics of the reference operators on literal rows, and every query against its SQL."""

import datetime as dt
import io
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from storymetrics.functions import names, replies
from storymetrics.operators import attempts, frames, jobs, metrics
from storymetrics.plans import intake, suite
from storymetrics.sources import documents, media
from storymetrics.sources.store import Store
from tests.clocks import Still

SF = "/root/testdata/sf0.001"


def at():
    return F.lit(dt.datetime(2024, 1, 2, 3, 4, 5)).cast("timestamp_ntz")


def value(v):
    if v is None or v != v:
        return None
    v = v.item() if hasattr(v, "item") else v
    return round(v, 6) if isinstance(v, float) else str(v) if isinstance(v, dt.date) else v


@pytest.mark.parametrize("name", sorted(suite.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("customer", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = suite.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    wanted = con.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({suite.SQL[name]})").fetchall()
    rows = [tuple(map(value, r)) for r in got.select(*columns).collect()]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(map(value, r))) for r in wanted)


def test_names(spark):
    rows = spark.createDataFrame([(n,) for n in ("a.MP4", ".mp4", "x.tar.zip", "noext", "foo.", "a..jpg")], "n string")
    assert [r[0] for r in rows.select(names.suffix(F.col("n"))).collect()] == [".mp4", "", ".zip", "", "", ".jpg"]
    days = spark.createDataFrame([(d,) for d in ("2024-01-05", "2024-1-5", "24-01-05", "2024-02-30", "garbage", None)], "d string")
    assert [str(r[0]) for r in days.select(names.campaign_date(F.col("d"))).collect()] == ["2024-01-05", "2024-01-05", "None", "None", "None", "None"]


def test_replies_are_validated_leniently(spark):
    good = '[{"frame_index":0,"metrics":{"views":"1_234","likes":12.0,"shares":true,"followers":"55.5"}},{"frame_index":1,"is_duplicate":"yes","duplicate_of_frame":0}]'
    bad = '[{"frame_index":0,"metrics":{"views":"1,234"}},{"frame_index":-1},{"frame_index":2,"is_duplicate":null},{"frame_index":3,"metrics":{"likes":12.5}},{"frame_index":4,"metrics":null}]'
    rows = spark.createDataFrame([("j", 0, f"text ```json\n{good}\n``` more"), ("j", 1, f"```\n{bad}\n```"), ("j", 2, "[{"), ("j", 3, '{"frames": []}'), ("j", 4, None)], "job_id string, batch_id long, reply string")
    got = replies.parse(rows).orderBy("batch_id", "pos").collect()
    assert [(r["batch_id"], r["is_valid"]) for r in got] == [(0, True), (0, True), (1, False), (1, False), (1, False), (1, False), (1, True)]
    m = got[0]["metrics"]
    assert (m["views"], m["likes"], m["shares"], m["followers"], m["replies"]) == (1234, 12, 1, 55.5, None)
    assert (got[1]["is_duplicate"], got[1]["duplicate_of_frame"]) == (True, 0)


#: JSON tokens with what they must become as whole number, fraction and truth value (BAD: the frame is invalid).
BAD = object()
TOKENS = [
    ("null", None, None, BAD), ("true", 1, 1.0, True), ("false", 0, 0.0, False), ("0", 0, 0.0, False), ("1", 1, 1.0, True), ("2", 2, 2.0, BAD),
    ("-3", -3, -3.0, BAD), ("12.0", 12, 12.0, BAD), ("12.5", BAD, 12.5, BAD), ("1.0", 1, 1.0, True), ("1e2", 100, 100.0, BAD), ("0.0", 0, 0.0, False),
    ("9007199254740993", 9007199254740993, 9007199254740992.0, BAD), ("9223372036854775807", 2**63 - 1, float(2**63 - 1), BAD), ("9223372036854775808", BAD, float(2**63), BAD),
    ('"1234"', 1234, 1234.0, BAD), ('" 12 "', 12, 12.0, BAD), ('"12.0"', 12, 12.0, BAD), ('"12.5"', BAD, 12.5, BAD), ('"1_000"', 1000, 1000.0, BAD), ('"1__0"', BAD, BAD, BAD),
    ('"1,234"', BAD, BAD, BAD), ('"1e2"', BAD, 100.0, BAD), ('"+5"', 5, 5.0, BAD), ('"-5"', -5, -5.0, BAD), ('"55%"', BAD, BAD, BAD), ('""', BAD, BAD, BAD), ('" "', BAD, BAD, BAD),
    ('".5"', BAD, 0.5, BAD), ('"5."', BAD, 5.0, BAD), ('"inf"', BAD, float("inf"), BAD), ('"Infinity"', BAD, float("inf"), BAD), ('"abc"', BAD, BAD, BAD), ('"\\u06f1"', BAD, BAD, BAD),
    ('"true"', BAD, BAD, True), ('"false"', BAD, BAD, False), ('"yes"', BAD, BAD, True), ('"NO"', BAD, BAD, False), ('"on"', BAD, BAD, True), ('"off"', BAD, BAD, False), ('"t"', BAD, BAD, True),
    ('"f"', BAD, BAD, False), ('"Y"', BAD, BAD, True), ('"n"', BAD, BAD, False), ('"1"', 1, 1.0, True), ('"0"', 0, 0.0, False), ('" true "', BAD, BAD, BAD), ("[]", BAD, BAD, BAD), ("[1]", BAD, BAD, BAD),
    ("{}", BAD, BAD, BAD), ('{"a":1}', BAD, BAD, BAD),
]


def test_tokens_of_every_type(spark):
    frames_of = {"whole": lambda t: f'{{"frame_index":0,"metrics":{{"views":{t}}}}}', "fraction": lambda t: f'{{"frame_index":0,"metrics":{{"followers":{t}}}}}', "truth": lambda t: f'{{"frame_index":0,"is_duplicate":{t}}}'}
    rows = [(kind, i, f"[{make(token[0])}]") for kind, make in frames_of.items() for i, token in enumerate(TOKENS)]
    got = {(r["job_id"], r["batch_id"]): r for r in replies.parse(spark.createDataFrame(rows, "job_id string, batch_id long, reply string")).collect()}
    for place, (kind, take) in enumerate((("whole", lambda r: r["metrics"]["views"]), ("fraction", lambda r: r["metrics"]["followers"]), ("truth", lambda r: r["is_duplicate"])), 1):
        for i, token in enumerate(TOKENS):
            r = got[kind, i]
            assert (take(r) if r["is_valid"] else BAD) == token[place], (kind, token)


def test_every_field_is_validated(spark):
    valid = ['"metadata":null', '"metadata":{"language":"fa","date_range":null}', '"actual_frame":"x"', '"actual_frame":null', '"metrics":null', '"metrics":{}', '"unknown":[1]', '"metrics":{"saves":"x"}', '"duplicate_of_frame":null']
    invalid = ['"metadata":{"language":5}', '"metadata":"x"', '"metadata":[]', '"actual_frame":7', '"metrics":[1]', '"metrics":"x"', '"metrics":5', '"duplicate_of_frame":"x"', '"metrics":{"likes":{}}']
    rows = [("v", i, f'[{{"frame_index":"3",{x}}}]') for i, x in enumerate(valid)] + [("i", i, f'[{{"frame_index":3,{x}}}]') for i, x in enumerate(invalid)]
    rows += [("i", 90 + i, f"[{x}]") for i, x in enumerate(('{"metrics":{}}', '{"frame_index":null}', "5", '"text"', "[]", "null"))]
    for r in replies.parse(spark.createDataFrame(rows, "job_id string, batch_id long, reply string")).collect():
        assert r["is_valid"] == (r["job_id"] == "v"), r
        assert r["frame_index"] == (3 if r["is_valid"] else None) and (r["is_valid"] or r["metrics"] is None)


def test_frames_are_parsed_once(spark):
    plan = suite.QUERIES["response_roundtrip"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("variant_get") < 50 and len(plan) < 100_000


def test_last_is_by_arrival_and_nulls_are_skipped(spark):
    rows = spark.createDataFrame([("m", 5.0, 1), ("m", 2.0, 2), ("m", None, 3), ("m", float("nan"), 4)], "k string, v double, at int")
    assert metrics.summarize(rows, ["k"], "v", F.col("at")).collect()[0][1:] == (5.0, 2.0, 3.5, 2.0)


def test_threshold_is_strict(spark):
    rows = spark.createDataFrame([(0.65,), (0.6500001,), (None,)], "c double")
    assert [r[0] for r in rows.select(frames.labelled(F.col("c"))).collect()] == ["BAD", "GOOD", None]


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}", "pepper")
    new = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "z")], "id string, company string").withColumn("created_at", at())
    assert (store.add_jobs(new), store.add_jobs(new)) == (2, 0)
    assert store.set_status("a", "failed", at(), "boom") == 1 and store.set_status("none", "failed", at()) == 0
    assert store.job("a").select("status", "error_message").collect()[0][:] == ("failed", "boom")
    assert store.set_status("a", "completed", at()) == 1 and store.job("a").first()["error_message"] is None
    row = "job_id string, total_frames int, good_frames int, bad_frames int, processing_time_seconds int, metrics_json string, created_at timestamp_ntz"
    first, later = dt.datetime(2024, 1, 1), dt.datetime(2025, 1, 1)
    assert store.upsert_metrics(spark.createDataFrame([("a", 1, 1, 0, 5, "{}", first), ("orphan", 1, 1, 0, 5, "{}", first)], row)) == 1
    assert store.upsert_metrics(spark.createDataFrame([("a", 9, 1, 0, 5, "{}", later)], row)) == 1
    assert store.table("job_metrics").select("total_frames", "created_at").collect()[0][:] == (9, first)
    assert store.add_user("u", "pw", at()) and not store.add_user("u", "other", at())
    assert store.check_user("u", "pw") and not store.check_user("u", "no") and store.count_users() == 1
    assert [r["id"] for r in store.list_jobs(status="processing").collect()] == ["b"]


def test_export_has_33_columns(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}", "s")
    created = F.when(F.col("id") == "a", at()).otherwise(F.lit(dt.datetime(2024, 1, 2, 3, 4, 5, 60)).cast("timestamp_ntz"))
    store.add_jobs(spark.createDataFrame([("a", "x & <y>"), ("b", "z")], "id string, company string").withColumn("campaign_date", F.lit(dt.date(2024, 1, 5))).withColumn("created_at", created))
    summaries = spark.createDataFrame([("a", "views", "9007199254740993"), ("a", "followers", "55.5")], "job_id string, metric string, max string")
    rows = metrics.export_rows(store.table("jobs"), store.table("job_metrics"), summaries)
    assert len(rows.columns) == 33 and rows.columns[14:17] == ["views", "accounts_reached", "followers"]
    b, a = rows.collect()
    assert (a["views"], a["followers"], a["likes"], a["campaign_date"], a["created_at"], b["created_at"]) == (2**53 + 1, 55.5, None, "2024-01-05", "2024-01-02T03:04:05", "2024-01-02T03:04:05.000060")
    with zipfile.ZipFile(io.BytesIO(documents.spreadsheet(rows))) as archive:
        assert "Campaign Results" in archive.read("xl/workbook.xml").decode()
        sheet = archive.read("xl/worksheets/sheet1.xml").decode()
    import xml.etree.ElementTree as ET

    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    cells = {c.get("r"): c for c in ET.fromstring(sheet).iterfind(".//m:c", ns)}
    text = lambda r: "".join(cells[r].itertext())
    assert (text("A1"), text("O1"), text("P1"), text("AG1")) == ("Job ID", "Views (Max)", "Accounts Reached (Max)", "External Link Taps (Max)")
    assert (text("O3"), cells["O3"].get("t"), text("Q3"), text("E3"), cells["P3"].get("t"), text("P3")) == ("9007199254740993", None, "55.5", "x & <y>", None, "")
    assert (cells["A1"].get("s"), cells["A2"].get("s"), cells["A3"].get("s")) == ("1", "3", "2") and '<col min="1" max="1" width="36"' in sheet


def test_archive_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        for name in ("a.MP4", "d/b.mov", "__MACOSX/a.mp4", "c.jpg"):
            archive.writestr(name, b"x")
    (tmp_path / "bad.zip").write_bytes(b"no")
    rows = media.expand_archives(spark, str(tmp_path))
    assert sorted((r["path"].rsplit("/", 1)[-1], r["idx"], r["name"], r["status"]) for r in rows.collect()) == [("a.zip", 1, "a.MP4", "success"), ("a.zip", 2, "d/b.mov", "success"), ("bad.zip", 1, None, "error")]


def test_run_replies_completes_jobs(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}", "s")
    store.add_jobs(spark.createDataFrame([("a", "x"), ("b", "y")], "id string, company string").withColumn("created_at", at()))
    answered = spark.createDataFrame([("a", 0, '[{"frame_index":0},{"frame_index":1,"is_duplicate":true}]')], "job_id string, batch_id long, reply string")
    counted = intake.run_replies(store, answered, at()).collect()[0]
    assert (counted["unique_frames"], counted["duplicate_frames"]) == (1, 1)
    assert {r["id"]: r["status"] for r in store.table("jobs").collect()} == {"a": "completed", "b": "processing"}


def test_stream_takes_each_manifest_once(spark, tmp_path):
    import json

    from storymetrics.streaming.intake import run_stream

    (tmp_path / "in").mkdir()
    line = {"filename": "v.mp4", "campaign_date": "2024-1-5", "campaign_name": "Spring", "product_name": "p", "company": "Acme", "submitted_at": "2024-01-05T10:00:00"}
    (tmp_path / "in" / "m.json").write_text(json.dumps(line) + "\n" + json.dumps(line | {"filename": "v.txt"}) + "\n")
    store = Store(spark, f"file://{tmp_path}/store", "s")
    for _ in range(2):
        run_stream(spark, f"{tmp_path}/in", f"{tmp_path}/cp", store)
    assert [r["id"] for r in store.table("jobs").collect()] == ["acme_spring_20240105100000"]
    assert [(r["filename"], r["reason"]) for r in store.table("rejected").collect()] == [("v.txt", "file type")]


def test_last_wins_and_copies(spark):
    rows = spark.createDataFrame([("f", 1, "x"), ("f", 2, "x"), ("g", 1, "y")], "n string, i int, t string")
    assert sorted((r["n"], r["i"]) for r in jobs.last_wins(rows, ["n"], ["i"]).collect()) == [("f", 2), ("g", 1)]
    assert sorted((r["i"], r["duplicate_of_frame"]) for r in frames.copies(rows, ["n"], F.col("t"), "i").collect()) == [(1, None), (1, None), (2, 1)]


def test_run_replies_stores_the_final_document(spark, tmp_path):
    import json

    store = Store(spark, f"file://{tmp_path}", "s")
    store.add_jobs(spark.createDataFrame([("a", "x")], "id string, company string").withColumn("created_at", at()))
    first = '[{"frame_index":0,"metrics":{"views":9},"metadata":{"language":"fa","content_type":"story"}},{"frame_index":1,"is_duplicate":true,"metrics":{"views":50}},{"frame_index":2,"metrics":{"views":"many"}}]'
    second = '[{"frame_index":0,"metrics":{"views":4}},{"frame_index":7,"metadata":null,"actual_frame":"own"},{"frame_index":1,"metadata":{"language":5}},{"frame_index":1,"metadata":[]}]'
    answered = spark.createDataFrame([("a", 0, first), ("a", 1, second), ("orphan", 0, '[{"frame_index":-1}]')], "job_id string, batch_id long, reply string")
    sent = spark.createDataFrame([("a", 0, i, f"f{i}.jpg") for i in range(3)] + [("a", 1, 0, "f3.jpg"), ("a", 1, 1, "f4.jpg")], "job_id string, batch_id long, frame_index long, filename string")
    for _ in range(2):
        intake.run_replies(store, answered, at(), sent)
    found = json.loads(store.job("a").first()["metrics_json"])
    assert [found[k] for k in ("extraction_date", "total_frames", "unique_frames", "duplicate_frames", "invalid_frames")] == ["2024-01-02T03:04:05.000000", 5, 3, 1, 3]
    assert [f["actual_frame"] for f in found["all_frames_data"]] == ["f0.jpg", "f1.jpg", "f3.jpg", "own"]
    assert [f["actual_frame"] for f in found["unique_metrics"]] == ["f0.jpg", "f3.jpg", "own"]
    assert [f["metadata"] for f in found["unique_metrics"]] == [{"language": "fa", "date_range": None, "content_type": "story"}, None, None]
    assert found["summary"] == {"views": {"max": 9, "min": 4, "avg": 6.5, "last": 4}} and type(found["summary"]["views"]["max"]) is int
    written = "".join(f.read_text() for f in sorted((tmp_path / "documents/metrics/job_id=a").glob("*.txt")))
    assert json.loads(written) == found and (found["unanswered_frames"], written.count("\n")) == (2, 10)
    held = store.table("quarantine").orderBy("batch_id", "pos").collect()
    assert [(r["job_id"], r["batch_id"], r["pos"]) for r in held] == [("a", 0, 2), ("a", 1, 2), ("a", 1, 3)] and "many" in held[0]["raw"]
    rows = metrics.export_rows(store.table("jobs"), store.table("job_metrics"), metrics.stored_summaries(store.table("job_metrics"))).first()
    assert (rows["views"], rows["likes"]) == (9, None)


def png(pixels):
    """A grey PNG of a 2-d array."""
    import struct
    import zlib

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w = pixels.shape
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + row.tobytes() for row in pixels))) + chunk(b"IEND", b"")


def picture(kind):
    import numpy as np

    return {"dark": np.full((6, 8), 20, np.uint8), "bright": np.full((6, 8), 240, np.uint8), "sharp": (np.indices((40, 40)).sum(axis=0) // 10 % 2 * 255).astype(np.uint8)}[kind]


def test_images_are_decoded_and_scored(spark, tmp_path):
    for kind in ("dark", "bright", "sharp"):
        (tmp_path / f"{kind}.png").write_bytes(png(picture(kind)))
    (tmp_path / "broken.png").write_bytes(b"no picture")
    got = {r["path"].rsplit("/", 1)[-1]: r for r in frames.score(media.images(spark, str(tmp_path))).collect()}
    assert (got["dark.png"]["luminance"], got["bright.png"]["luminance"]) == (20.0, 240.0)
    assert (got["broken.png"]["luminance"], got["broken.png"]["confidence"], got["broken.png"]["label"]) == (None, None, None)
    assert {k: got[k]["label"] for k in ("dark.png", "sharp.png")} == {"dark.png": "BAD", "sharp.png": "GOOD"}
    assert {r["path"].rsplit("/", 1)[-1] for r in media.files(spark, str(tmp_path), "*.png").collect()} == set(got)


def test_pictures_are_brightened_and_resized_linearly():
    import numpy as np

    dark = np.repeat(picture("dark")[:, :, None], 3, axis=2)
    assert np.allclose(frames.prepared(dark), 70 / 255)  # 1.5 * 20 + 40
    ramp = np.repeat(np.array([[100, 200]], np.uint8)[:, :, None], 3, axis=2)
    row = frames.resized(ramp, 4)[0, :, 0]
    assert row.tolist() == [100, 125, 175, 200]
    big = np.arange(8 * 8 * 3, dtype=np.uint8).reshape(8, 8, 3)
    assert (frames.resized(big, 8) == big).all()
    assert frames.resized(big, 4)[0, 0].tolist() == [np.rint(big[:2, :2, k].mean()) for k in range(3)]


def test_documents_are_put_read_and_deleted(spark, tmp_path):
    root, rows = f"file://{tmp_path}/docs", spark.createDataFrame([("a", None, 3)], "id string, note string, n long")
    documents.put(rows, root, "job")
    documents.put(rows, root, "job", "other")
    assert documents.get(spark, root, "job", rows.schema).collect() == rows.collect()
    (tmp_path / "x.bin").write_bytes(b"123")
    documents.upload(spark, root, "job", str(tmp_path / "x.bin"), "x.bin")
    assert media.files(spark, f"{root}/job", "x.bin").first()["content"] == b"123"
    documents.delete_job(spark, root, "job")
    assert documents.get(spark, root, "job", rows.schema).count() == 0 and documents.get(spark, root, "none", rows.schema, "other").count() == 0


def test_frames_are_named_by_their_place_in_the_batch(spark):
    sent = frames.batched(spark.createDataFrame([("j", f"f{i}.jpg") for i in range(5)], "job_id string, filename string"), "job_id", ["filename"], 2)
    told = spark.createDataFrame([("j", 0, 1), ("j", 2, 0), ("j", 2, 1), ("j", 9, 0), ("j", 0, -1)], "job_id string, batch_id long, frame_index long")
    assert {(r["batch_id"], r["frame_index"]): r["actual_frame"] for r in frames.named(told, sent).collect()} == {(0, 1): "f1.jpg", (2, 0): "f4.jpg", (2, 1): None, (9, 0): None, (0, -1): None}


def test_first_of_new_rows_is_taken(spark):
    held = spark.createDataFrame([("old", 0, "t")], "id string, n int, created string")
    new = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("old", 5, "late"), ("b", 7, "x"), ("b", 7, "x")], "id string, n int, created string").repartition(4)
    assert sorted(map(tuple, jobs.add(held, new, "id", ["n"]).collect())) == [("a", 1, "early"), ("b", 7, "x")]
    assert sorted(map(tuple, jobs.upsert(held, new, "id", "created", ["n"]).collect())) == [("a", 2, "late"), ("b", 7, "x"), ("old", 5, "t")]


def test_provider_is_asked_until_it_answers(spark):
    from storymetrics.plans import process

    def provider(images):
        import os

        name, url = images[0]
        mark = f"/tmp/asked-{os.getppid()}-{name}"
        tries = int(open(mark).read()) if os.path.exists(mark) else 0
        open(mark, "w").write(str(tries + 1))
        assert url.startswith("data:image/jpeg;base64,")
        if name.startswith("error"):
            raise ValueError
        return "[]" if name.startswith("never") or tries < 2 else '```json\n[{"frame_index": 0}]\n```'

    import uuid

    u = uuid.uuid4().hex
    rows = spark.createDataFrame([("j", i, 0, f"{n}{u}", b"x") for i, n in enumerate(("late", "never", "error"))], "job_id string, batch_id long, frame_index long, filename string, content binary")
    log = process.asked(rows, provider, clock=Still())
    got = {r["batch_id"]: (r["attempts"], r["waited"], r["outcome"], r["reply"]) for r in attempts.answers(log, ["job_id", "batch_id"]).collect()}
    assert got == {0: (3, 0, "usable", '```json\n[{"frame_index": 0}]\n```'), 1: (5, 0, "empty", None), 2: (5, 20, "error", None)}


def test_a_job_runs_from_file_to_document(spark, tmp_path):
    import json

    from storymetrics.plans.process import process

    store = Store(spark, f"file://{tmp_path}/store", "s")
    store.add_jobs(spark.createDataFrame([(i, "x") for i in ("image", "zip", "dark", "video")], "id string, company string").withColumn("created_at", at()))
    (tmp_path / "sharp.png").write_bytes(png(picture("sharp")))
    (tmp_path / "dark.png").write_bytes(png(picture("dark")))
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as archive:
        archive.writestr("a.mp4", png(picture("sharp")))
        archive.writestr("b.mp4", b"broken")
        archive.writestr("c.txt", b"no video")

    def decoder(videos, folder):
        import os

        os.makedirs(folder.removeprefix("file://"))
        for r in videos.collect():
            with open(f"{folder.removeprefix('file://')}/frame_{r['idx']:06d}.png", "wb") as file:
                file.write(r["content"])

    def provider(images):
        return json.dumps([{"frame_index": i, "metrics": {"views": 5}} for i, _ in enumerate(images)])

    assert process(store, "image", f"{tmp_path}/sharp.png", "image", provider, at()) == "completed"
    assert process(store, "zip", f"{tmp_path}/c.zip", "zip", provider, at(), decoder=decoder) == "completed"
    assert process(store, "dark", f"{tmp_path}/dark.png", "image", provider, at()) == "completed"
    assert process(store, "video", f"{tmp_path}/c.zip", "video", provider, at(), delete_upload=True) == "failed"
    assert not (tmp_path / "c.zip").exists() and (tmp_path / "dark.png").exists()
    told = spark.read.json(f"{tmp_path}/store/documents/zip/campaign_summary").first()
    assert (told["total_videos"], told["successful"], [r["name"] for r in told["results"]], told["original_filename"]) == (2, 2, ["a.mp4", "b.mp4"], "c.zip")
    held = {r["job_id"]: r for r in store.table("job_metrics").collect()}
    assert {i: (r["total_frames"], r["good_frames"], r["bad_frames"]) for i, r in held.items()} == {"image": (1, 1, 0), "zip": (2, 1, 0), "dark": (1, 0, 1)}
    assert json.loads(held["zip"]["metrics_json"])["summary"]["views"]["max"] == 5 and held["dark"]["metrics_json"] == "{}" and held["image"]["processing_time_seconds"] >= 0
    assert {r["id"]: r["status"] for r in store.table("jobs").collect()} == {"image": "completed", "zip": "completed", "dark": "completed", "video": "failed"}
    assert "decoder" in store.job("video").first()["error_message"]


def test_settings_metadata_and_first_user(spark, tmp_path):
    from storymetrics.settings import Settings

    assert Settings.of(spark) == Settings()
    spark.conf.set("spark.storymetrics.batch_size", "7")
    spark.conf.set("spark.storymetrics.threshold", "0.5")
    assert (Settings.of(spark).batch_size, Settings.of(spark).threshold) == (7, 0.5)
    for name in ("batch_size", "threshold"):
        spark.conf.unset(f"spark.storymetrics.{name}")
    store = Store(spark, f"file://{tmp_path}", "s")
    assert store.bootstrap("admin", "pw", at()) and not store.bootstrap("other", "pw", at()) and store.check_user("admin", "pw")
    assert media.extraction_metadata(spark, 100, 34, 29.97, at()).first()[:3] == (100, 34, 29.97)
