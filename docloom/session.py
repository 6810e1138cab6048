"""A session with the settings this library counts on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Distinct query words, and queries, that are broadcast at most; beyond that the caller splits the queries.
MOST_WORDS = 20_000


def session(master: str = "local[*]", shuffle_partitions: int = 8, **more: str) -> SparkSession:
    """UTC, adaptive plans with coalescing and skew handling, Arrow for the few Python hooks."""
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | more
    return SparkSession.builder.master(master).appName("docloom").config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, set from spark.checkpoint.dir if that was not done yet.

    A session without one gets a temporary folder if it is local, that is all in one process; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-docloom-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write df to the session's checkpoint folder and go on from there, so that no later job repeats its work."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors see."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def bounded(small: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """small, if it has no more rows than most."""
    if (n := small.limit(most + 1).count()) > most:
        raise ValueError(f"over {n - 1} rows on the query side: split the queries into batches")
    return small


def checked(small: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """small, marked for broadcast, if it has no more rows than most."""
    return F.broadcast(bounded(small, most))
