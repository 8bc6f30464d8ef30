"""Reading input tables, and the declared derivations that turn them into engine tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Thresholds of the full event derivation.
TERMINAL_BELOW, UNKNOWN_ABOVE = 10, 150


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts):
    """Epoch milliseconds of a wall-clock timestamp, taken as UTC."""
    return F.unix_millis(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def saga_events(events: DataFrame, full: bool = False) -> DataFrame:
    """(user_id, week, ts, event_id, result): process = (user, week), results by event type; ``full`` adds terminal and unknown ones."""
    result = F.when(F.col("event_type") == "error", "R").otherwise("S")
    if full:
        result = F.when(F.col("value") < TERMINAL_BELOW, "T").when(F.col("value") > UNKNOWN_ABOVE, "U").otherwise(result)
    return events.select("user_id", F.date_trunc("week", "ts").cast("date").cast("string").alias("week"), "ts", "event_id", result.alias("result"))


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only in a local session where that is unset."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="ledgerline-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/ledgerline/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut, in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
