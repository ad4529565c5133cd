"""Batches of frames put to a provider, in rounds: each round is a job over the batches that have no usable reply yet."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..operators import attempts
from ..operators.jobs import with_keys


@dataclass(frozen=True)
class Answer:
    """What a provider got: the status of the reply, and its text."""

    status: int
    body: str | None


#: What reads frames: (name, data URL) of each frame of a batch -> an answer, a text (status 200) or None. It runs in tasks.
Provider = Callable[[list[tuple[str, str]]], Answer | str | None]


class Clock:
    """The time of the machine that a task runs on."""

    def now(self) -> float:
        return time.time()

    def sleep(self, seconds: float) -> None:
        time.sleep(seconds)


_last: dict[str, float] = {}


@dataclass(frozen=True)
class Pace:
    """At least so many seconds between two requests of a task; all tasks together make `tasks` times as many."""

    seconds: float = attempts.PAUSE

    def acquire(self, clock: Clock) -> None:
        due = _last.get("request", float("-inf")) + self.seconds
        if due > clock.now():
            clock.sleep(due - clock.now())
        _last["request"] = clock.now()


def fault(error: Exception) -> str:
    """timeout, connection or error, by the names of the error's classes, since every client has its own."""
    names = {c.__name__ for c in type(error).__mro__}
    return "timeout" if names & {"Timeout", "TimeoutError"} else "connection" if "ConnectionError" in names else "error"


def asked(
    batches: DataFrame, provider: Provider, retries: int = attempts.ATTEMPTS, clock: Clock | None = None, pace: Pace | None = None, tasks: int | None = None
) -> DataFrame:
    """The log (attempts.LOG) of all attempts for batches of frames (job_id, batch_id, frame_index, filename, content).

    In each round the batches without a usable reply are asked once, side by side in `tasks` tasks; a batch waits in its
    task until what is left of its last wait is over. Replies are judged as columns. A round is a written table: one that
    is interrupted is asked anew, those before it are not. The log outlives this call; dropping it is the caller's part.
    """
    clock, pace = clock or Clock(), pace or Pace(0)

    def ask(group: pd.DataFrame) -> pd.DataFrame:
        from .process import data_url

        rows = group.sort_values("frame_index")
        head = rows.iloc[0]
        images = [(n, data_url(c)) for n, c in zip(rows["filename"], rows["content"])]
        slept = max(0.0, float(head["due"]) - clock.now())
        if slept:
            clock.sleep(slept)
        pace.acquire(clock)
        status, body, failed = None, None, None
        try:
            found = provider(images)
            status, body = (found.status, found.body) if isinstance(found, Answer) else (attempts.ANSWERED, found)
        except Exception as e:  # noqa: BLE001 - a provider that fails is asked again
            failed = fault(e)
        one = {"job_id": head["job_id"], "batch_id": head["batch_id"], "attempt": head["attempt"], "status": status, "body": body, "fault": failed, "slept": slept, "ended": clock.now()}
        return pd.DataFrame([one]).astype({"status": "Int32"})

    raw = "job_id string, batch_id bigint, attempt int, status int, body string, fault string, slept double, ended double"
    keys = ["job_id", "batch_id"]
    kind, since, rounds = attempts.outcome(F.col("status"), F.col("body"), F.col("fault")), scratch.written(), []
    left = batches.select(*keys).distinct().withColumn("attempt", F.lit(0)).withColumn("due", F.lit(0.0))
    for _ in range(retries):
        sent = with_keys(batches, left, keys)
        spread = sent.repartition(tasks, *keys) if tasks else sent
        said = spread.groupBy(*keys).applyInPandas(ask, raw).withColumn("outcome", kind)
        rounds.append(scratch.saved(said.withColumn("wait", attempts.wait(F.col("outcome"), F.col("attempt"), retries)), "attempts"))
        left = rounds[-1].where("outcome <> 'usable'").select(*keys, (F.col("attempt") + 1).alias("attempt"), (F.col("ended") + F.col("wait")).alias("due"))
        if left.limit(1).count() == 0:
            break
    log = rounds[0]
    for more in rounds[1:]:
        log = log.unionByName(more)
    return scratch.alone(log.select(*(field.split(" ")[0] for field in attempts.LOG.split(", "))), "attempts", since)
