"""Ingest jobs: progress, retries, request slots and routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIB = 1024 * 1024


def progress(runs: DataFrame) -> DataFrame:
    """Chunks done before each run of a job and the whole percentage after it; redelivered rows count once."""
    once = runs.select("job_id", "run_id", "status").distinct()
    order = Window.partitionBy("job_id").orderBy("run_id")
    before = F.coalesce(F.sum(F.lit(1)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.count("*").over(Window.partitionBy("job_id"))
    return once.select("job_id", "run_id", before.cast("int").alias("done_before"), F.floor(100 * (before + 1) / total).cast("int").alias("percent"))


def request_slots(runs: DataFrame, calls: int = 15, seconds: int = 60) -> DataFrame:
    """The earliest window of `seconds` in which each request may start when a window takes `calls` requests."""
    once = runs.select("job_id", "run_id").distinct()
    n = F.row_number().over(Window.partitionBy("job_id").orderBy("run_id")) - 1
    return once.withColumn("slot", F.floor(n / calls).cast("int")).withColumn("start_second", (F.floor(n / calls) * seconds).cast("int"))


def backoff(attempt: Column, initial: float = 1.0, factor: float = 2.0, most: float = 60.0) -> Column:
    """Seconds to wait before an attempt, without jitter."""
    return F.least(F.lit(initial) * F.pow(F.lit(factor), attempt), F.lit(most))


# What an error's message holds where trying again helps.
RECOVERABLE = ("timeout", "temporary", "rate limit", "too many requests", "retry", "try again", "server busy")


def recoverable(message: Column, kind: Column | None = None) -> Column:
    """Whether an error's message, or its kind (a connection or timeout error), suggests that trying again helps."""
    said = F.coalesce(F.lower(message).rlike("|".join(RECOVERABLE)), F.lit(False))
    return said if kind is None else said | F.coalesce(kind.isin("ConnectionError", "TimeoutError"), F.lit(False))


def conversion_method(n_bytes: Column) -> Column:
    """How a record of this size is converted: regular up to 5 MiB, else large_file."""
    return F.when(n_bytes <= 5 * MIB, "regular").otherwise("large_file")


def stale(name: Column, modified: Column, now: Column, hours: float = 24) -> Column:
    """Whether a file is a temporary PDF that was last changed over `hours` ago."""
    old = now.cast("double") - modified.cast("double") > hours * 3600
    return F.coalesce(F.regexp_like(name, F.lit(r"^tmp.*pdf$")) & old, F.lit(False))


def job_status(error_kind: Column) -> Column:
    """What a failed request means by the kind of its error: the request itself, a missing processor, or the service."""
    return F.when(error_kind.isNull(), "ok").when(error_kind == "InvalidArgument", "invalid_argument").when(error_kind == "NotFound", "processor_not_found").otherwise("failed")


def read_mode(n_bytes: Column) -> Column:
    """How a record of this size would be read by older tools: standard, chunked or streaming."""
    return F.when(n_bytes < 5 * MIB, "standard").when(n_bytes < 50 * MIB, "chunked").otherwise("streaming")


def chunk_pages(n_bytes: Column) -> Column:
    """Pages per chunk for a record of this size."""
    return F.when(n_bytes > 100 * MIB, 5).when(n_bytes > 50 * MIB, 7).otherwise(10)


def route(payload: Column) -> DataFrame | Column:
    """The layout of a JSON record by the presence of its keys: alternative, standard or unknown; null for broken JSON."""
    keys = F.json_object_keys(payload)
    return F.when(keys.isNull(), None).when(F.array_contains(keys, "files"), "alternative").when(F.array_contains(keys, "document_data"), "standard").otherwise("unknown")


def endpoint(location: Column, host: str) -> Column:
    """The service's host for a location: a regional one for eu and us, else the given one."""
    here = F.lower(F.trim(location))
    return F.when(here.isin("eu", "us"), F.concat(here, F.lit(f"-{host}"))).otherwise(host)
