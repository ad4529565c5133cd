"""The rule of asking anew: what each reply counts as, how long to wait after it, and the log of all attempts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.replies import unfenced

#: Attempts for a batch; seconds more after each refusal for too many requests; seconds after a fault of the line; seconds between batches.
ATTEMPTS, STEP, FAULT, PAUSE = 5, 10, 5, 2
#: The status of an answer and that of too many requests.
ANSWERED, TOO_MANY = 200, 429
FAULTS = ("timeout", "connection", "error")
LOG = "job_id string, batch_id bigint, attempt int, outcome string, wait int, slept double, status int, body string"


def outcome(status: Column, body: Column, fault: Column) -> Column:
    """usable, empty or broken (an answer with, without, or that is no JSON array), limited, status (another one), or the fault."""
    items = F.from_json(unfenced(body), "array<string>", {"allowSingleQuotes": "false", "mode": "PERMISSIVE"})
    array = F.startswith(unfenced(body), F.lit("["))
    answer = F.when(array & (F.size(items) > 0), "usable").when(array & (F.size(items) == 0), "empty").otherwise("broken")
    return F.when(fault.isin(*FAULTS), fault).when(fault.isNotNull(), "error").when(status == ANSWERED, answer).when(status == TOO_MANY, "limited").otherwise("status")


def wait(kind: Column, attempt: Column, attempts: int = ATTEMPTS) -> Column:
    """Seconds until the next attempt (attempts count from 0): longer with each refusal, a while after a fault unless it was the last, else none."""
    return F.when(kind == "limited", (attempt + 1) * STEP).when(kind.isin(*FAULTS) & (attempt < attempts - 1), FAULT).otherwise(0).cast("int")


def replayed(recorded: DataFrame, keys: list[str], attempts: int = ATTEMPTS) -> DataFrame:
    """The log that recorded replies (keys, attempt from 0, status, body, fault) give: keys, attempt, outcome, wait, body.

    A batch's log ends with its first usable reply, with the last attempt, or before the first attempt that has no record.
    What was recorded beyond the last attempt isn't looked at; of two records of an attempt the smaller one counts. Null
    status counts as another status, a null body as broken. At most `attempts` records of a batch come together.
    """
    kind = outcome(F.col("status"), F.col("body"), F.col("fault"))
    near = recorded.where(F.col("attempt").between(0, attempts - 1))
    one = near.groupBy(*keys, "attempt").agg(F.min(F.struct("status", "body", "fault")).alias("_r")).select(*keys, "attempt", "_r.*")
    one = one.select(*keys, F.col("attempt").cast("int").alias("attempt"), kind.alias("outcome"), "body")
    told = one.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("attempt", "outcome", "body"))).alias("_all"))
    gap = F.transform("_all", lambda x, i: x["attempt"] != i)
    first_gap = F.coalesce(F.array_position(gap, True), F.lit(0))
    first_use = F.coalesce(F.array_position(F.transform("_all", lambda x: x["outcome"]), "usable"), F.lit(0))
    length = F.least(F.when(first_gap > 0, first_gap - 1).otherwise(F.size("_all")), F.when(first_use > 0, first_use).otherwise(F.size("_all"))).cast("int")
    log = told.select(*keys, F.inline(F.slice("_all", F.lit(1), length)))
    return log.withColumn("wait", wait(F.col("outcome"), F.col("attempt"), attempts)).select(*keys, "attempt", "outcome", "wait", "body")


def answers(log: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each batch of a log: attempts, the seconds waited between them, the last outcome, and the usable reply or null."""
    last = F.max_by(F.struct("outcome", "body"), "attempt")
    rows = log.groupBy(*keys).agg(F.count("*").alias("attempts"), F.sum("wait").alias("waited"), last.alias("_last"))
    return rows.select(*keys, "attempts", "waited", F.col("_last.outcome").alias("outcome"), F.when(F.col("_last.outcome") == "usable", F.col("_last.body")).alias("reply"))
