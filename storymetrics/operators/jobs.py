"""Joins, filters, pages and guarded writes of jobs, metrics and users, as transformations of tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import TERMINAL


def with_metrics(jobs: DataFrame, metrics: DataFrame, job_key: str, metric_key: str, *columns: str) -> DataFrame:
    """Every job with the named columns of its metrics, which may be missing."""
    return jobs.join(metrics.select(F.col(metric_key).alias("_key"), *columns), F.col(job_key) == F.col("_key"), "left").drop("_key")


def page(jobs: DataFrame, created: str, key: str, status: str | None = None, limit: int = 100, offset: int = 0, status_column: str = "status") -> DataFrame:
    """The newest first, nulls before them, ties by key; None and "" don't filter."""
    rows = jobs.where(F.col(status_column) == status) if status else jobs
    return rows.orderBy(F.col(created).desc_nulls_first(), F.col(key)).offset(offset).limit(limit)


def one_of(rows: DataFrame, key: str, order: list[str] | None = None, last: bool = False) -> DataFrame:
    """The first (or last) row of each key by the given columns, ties by all columns."""
    place = F.struct(*(order or []), *(c for c in rows.columns if c not in (order or [])))
    pick = F.max_by if last else F.min_by
    return rows.groupBy(F.col(key).alias("_k")).agg(pick(F.struct(*rows.columns), place).alias("_row")).select("_row.*")


def add(existing: DataFrame, new: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """The new rows whose key isn't taken, neither by an existing row nor by an earlier one of the new."""
    return one_of(new, key, order).join(existing.select(key), key, "left_anti").select(new.columns)


def with_parent(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    return rows.join(parents.select(F.col(parent_key).alias(key)), key, "left_semi").select(rows.columns)


def with_keys(rows: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are chosen, with what else the chosen ones have; null keys are like each other."""
    other = chosen.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in chosen.columns if c not in keys))
    same = F.lit(True)
    for k in keys:
        same = same & rows[k].eqNullSafe(other[f"_{k}"])
    return rows.join(other, same).drop(*(f"_{k}" for k in keys))


def set_status(jobs: DataFrame, chosen: Column, status: str, at: Column, error: Column | None = None) -> DataFrame:
    """The jobs with the chosen ones changed; a terminal status also sets completed_at and replaces the error message."""
    out = jobs.withColumn("status", F.when(chosen, F.lit(status)).otherwise(F.col("status")))
    if status in TERMINAL:
        out = out.withColumn("completed_at", F.when(chosen, at).otherwise(F.col("completed_at"))).withColumn("error_message", F.when(chosen, F.lit(None) if error is None else error).otherwise(F.col("error_message")))
    return out


def upsert(existing: DataFrame, new: DataFrame, key: str, retained: str, order: list[str] | None = None) -> DataFrame:
    """New rows (of one key, the last) replace those with their key but keep the retained column of the row they replace."""
    old = existing.select(key, F.col(retained).alias("_old"))
    latest = one_of(new, key, order, last=True).join(old, key, "left").withColumn(retained, F.coalesce("_old", retained)).select(existing.columns)
    return existing.join(new.select(key), key, "left_anti").select(existing.columns).unionByName(latest)


def by_status(jobs: DataFrame, status: str = "status") -> DataFrame:
    return jobs.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("jobs"))


def counted(rows: DataFrame, name: str) -> DataFrame:
    """One row: how many there are."""
    return rows.agg(F.count("*").alias(name))


def last_wins(rows: DataFrame, name: list[str], order: list[str]) -> DataFrame:
    """The last row of each name; grouping picks it before rows are shuffled, so a name that most rows have is no burden."""
    last = F.max_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(*(F.col(n).alias(f"_of_{n}") for n in name)).agg(last.alias("_row")).select("_row.*")


def users_matching(users: DataFrame, name: str, digest: Column, name_column: str = "username", hash_column: str = "password_hash") -> DataFrame:
    return users.where((F.col(name_column) == name) & (F.col(hash_column) == digest)).limit(1)
