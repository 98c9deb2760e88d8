"""Session, table and checkpoint helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Largest driver-side model or lookup (rows) that may be shipped to executors.
MAX_LOOKUP_ROWS = 500_000


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; a running session is reused as it is."""
    b = SparkSession.builder.appName("folioframe").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint in the shared folder of ``spark.checkpoint.dir``.

    The folder named by the session is used; where none is named one is set in local mode only (tests).  On a cluster a
    machine's own folder would be lost with the machine, so there the missing setting is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "folioframe-checkpoints"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """At least one partition per core for work that costs far more than moving its rows.

    Only an input that Spark reads in fewer partitions than the cluster has cores is moved: a small one, or one file that
    cannot be split.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bounded_collect(df: DataFrame, limit: int = MAX_LOOKUP_ROWS) -> list:
    """Collect a lookup whose size has a proven bound; more rows than that are an error, never a silent cut."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"lookup has more than {limit} rows")
    return rows
