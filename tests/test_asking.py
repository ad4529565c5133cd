"""The rule of asking anew, live and replayed, under a clock that stands still."""

import json

import pytest
from pyspark.sql import functions as F

from storymetrics.operators import attempts
from storymetrics.plans import asking
from storymetrics.plans.asking import Answer, Pace, asked
from tests.clocks import Still

GOOD = '```json\n[{"frame_index": 0}]\n```'
#: What is answered to each batch, attempt by attempt: (status, body, fault).
SCRIPTS = {
    0: [(200, GOOD, None)],
    1: [(429, None, None)] * 3 + [(200, GOOD, None)],
    2: [(429, None, None)] * 7,
    3: [(None, None, "timeout"), (None, None, "connection"), (500, "oops", None), (200, "{}", None), (200, "[]", None)],
    4: [(None, None, "error")] * 5,
    5: [(200, None, None), (200, "[{", None), (200, "['a']", None), (200, "[1]", None)],
    6: [(503, None, None)] * 5,
}
OUTCOMES = {
    0: [("usable", 0)],
    1: [("limited", 10), ("limited", 20), ("limited", 30), ("usable", 0)],
    2: [("limited", 10), ("limited", 20), ("limited", 30), ("limited", 40), ("limited", 50)],
    3: [("timeout", 5), ("connection", 5), ("status", 0), ("broken", 0), ("empty", 0)],
    4: [("error", 5)] * 4 + [("error", 0)],
    5: [("broken", 0), ("broken", 0), ("broken", 0), ("usable", 0)],
    6: [("status", 0)] * 5,
}


def logged(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["batch_id"], r["attempt"])):
        assert r["attempt"] == len(out.setdefault(r["batch_id"], []))
        out[r["batch_id"]].append((r["outcome"], r["wait"]))
    return out


def test_recorded_replies(spark):
    rows = [("j", b, n, *said) for b, script in SCRIPTS.items() for n, said in enumerate(script)]
    rows += [("j", 7, 0, 500, None, None), ("j", 7, 2, 200, GOOD, None), ("j", 1, 0, 429, None, None), (None, 8, 0, None, None, None)]
    frame = spark.createDataFrame(rows, "job_id string, batch_id long, attempt long, status int, body string, fault string")
    log = attempts.replayed(frame, ["job_id", "batch_id"])
    assert logged(log) == OUTCOMES | {7: [("status", 0)], 8: [("status", 0)]}
    told = {r["batch_id"]: (r["attempts"], r["waited"], r["outcome"], r["reply"]) for r in attempts.answers(log, ["job_id", "batch_id"]).collect()}
    assert told[1] == (4, 60, "usable", GOOD) and told[2] == (5, 150, "limited", None) and told[3] == (5, 10, "empty", None)
    assert logged(attempts.replayed(frame.limit(0), ["job_id", "batch_id"])) == {}


def test_a_provider_is_waited_for_as_recorded(spark, tmp_path):
    def provider(images):
        batch = int(images[0][0])
        mark = tmp_path / str(batch)
        nth = int(mark.read_text()) if mark.exists() else 0
        mark.write_text(str(nth + 1))
        status, body, fault = SCRIPTS[batch][nth]
        if fault:
            raise {"timeout": TimeoutError, "connection": ConnectionResetError, "error": KeyError}[fault]
        return Answer(status, body)

    rows = spark.createDataFrame([("j", b, 0, str(b), b"x") for b in SCRIPTS], "job_id string, batch_id long, frame_index long, filename string, content binary")
    log = asked(rows, provider, clock=Still(), tasks=2)
    assert logged(log) == OUTCOMES
    slept = {(r["batch_id"], r["attempt"]): r["slept"] for r in log.collect()}
    assert [slept[2, n] for n in range(5)] == [0, 10, 20, 30, 40] and [slept[4, n] for n in range(5)] == [0, 5, 5, 5, 5] and slept[3, 3] == 0


def test_pace_and_faults():
    class Counted(Still):
        def __init__(self):
            self.at, self.slept = 100.0, []

        def now(self):
            return self.at

        def sleep(self, seconds):
            self.slept.append(seconds)
            self.at += seconds

    clock, pace = Counted(), Pace(2)
    asking._last.clear()
    for step in (0, 0.5, 0, 5):
        clock.at += step
        pace.acquire(clock)
    asking._last.clear()
    assert clock.slept == [1.5, 2]

    class ReadTimeout(TimeoutError):
        pass

    assert [asking.fault(e) for e in (ReadTimeout(), ConnectionRefusedError(), ValueError())] == ["timeout", "connection", "error"]


@pytest.mark.parametrize("body", ["[1]", "[]", "{}", "[{", "", None, GOOD, "```\n[2]\n```", "text [1]", "null", '"[1]"'])
def test_replies_are_judged_as_a_parser_would(spark, body):
    text = (body or "").split("```json")[-1].split("```")[0] if "json" in (body or "") else (body or "").strip("`\n ")
    try:
        found = json.loads(text)
        wanted = ("usable" if found else "empty") if isinstance(found, list) else "broken"
    except ValueError:
        wanted = "broken"
    row = spark.createDataFrame([(200, body, None)], "status int, body string, fault string")
    assert row.select(attempts.outcome(F.col("status"), F.col("body"), F.col("fault"))).first()[0] == wanted
