"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from itertools import pairwise

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as every contract of this package means it: U+0020 and U+0009 to U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``; only in a local session, as in
    tests, may that be unset: a temporary folder is made and remembered.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = spark.conf.get("spark.ledgerline.scratch", None)
    if not own:
        own = tempfile.mkdtemp(prefix="ledgerline-")
        spark.conf.set("spark.ledgerline.scratch", own)
    return own.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/ledgerline/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back.

    This cuts the lineage: a lost executor costs nothing that was written, as
    the files are in the shared store.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def private(docs: DataFrame, **columns: str) -> DataFrame:
    """``columns`` of ``docs`` alone, under new names: other columns can't clash with them."""
    return docs.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def spread(table: DataFrame) -> DataFrame:
    """``table``, dealt out to all cores where its scan has fewer partitions than there are cores.

    Meant for scans before a map that takes far longer than moving the rows; a
    table that is made by shuffles is as it is, as counting its partitions
    would run them.
    """
    if "AdaptiveSparkPlan" in table._jdf.queryExecution().executedPlan().toString():
        return table
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(2 * cores)


def slices(batch, column: str, size: int):
    """Runs of an Arrow batch's rows that hold about ``size`` bytes of text, a longer text being one run."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(ends // size)) + 1).tolist(), len(batch)]
    for a, b in pairwise(cuts):
        if b > a:
            yield batch.slice(a, b - a)


def settled(column: Column) -> Column:
    """``column``, computed once where it stands.

    The optimizer copies the definition of a filtered or exploded column into a
    filter below, through all projections, so that arrays meant to be made once
    a row are made once an element. It doesn't move a filter past an expression
    that isn't deterministic.
    """
    return F.when(F.monotonically_increasing_id() >= 0, column)


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (src, dst long); root is the smallest node it reaches.

    Alternating large-star and small-star rounds over DataFrames. Each round is
    written to the shared folder; only two numbers a round reach the driver.
    A hub's edges stay rows of a sort-merge join, which Spark can split.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            out = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            low = down.groupBy("u").agg(F.min("v").alias("m"))
            near = down.join(low, "u")
            out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = materialize(edges.where("src <> dst").select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct(), "cc")
    seen = mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        now = materialize(star(star(now, True), False), "cc")
        again = mark(now)
        if again == seen:
            break
        seen = again
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
