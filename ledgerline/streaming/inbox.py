"""The inbox as a stream: conflict-aware acceptance in keyed state, and a sink that may repeat a batch."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

INPUTS = 65_536


def accept_stream(arrivals: DataFrame, process: str, input_id: str, content: list[str], order: list[str], quota: int = INPUTS) -> DataFrame:
    """(process, input_id, verdict, n): verdicts of each micro-batch's arrivals, as the batch operator gives them.

    The state of a process is the digest of each input that it accepted, at
    most ``quota``; a new input beyond that is QuotaExceeded. Arrivals of one
    batch are taken in ``order``. One group a process, not one an input, keeps
    the number of Python calls down.
    """
    digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    places = [f"__o{i}" for i in range(len(order))]
    rows = arrivals.select(process, *[F.col(o).alias(p) for o, p in zip(order, places, strict=True)], F.col(input_id).cast("string").alias("__i"), digest.alias("__d"))
    types = dict(arrivals.dtypes)

    def run(k, frames: Iterator[pd.DataFrame], state):
        got = sorted((r for f in frames for r in zip(*[f[c].tolist() for c in [*places, "__i", "__d"]], strict=True)), key=lambda r: r[:-2])
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        told: Counter = Counter()
        for *_, i, d in got:
            first = held.get(i)
            if first is None and len(held) < quota:
                held[i] = d
                told[i, "accepted"] += 1
            else:
                told[i, "QuotaExceeded" if first is None else "duplicate" if d == first else "conflict"] += 1
        state.update((list(held), list(held.values())))
        yield pd.DataFrame({process: [k[0]] * len(told), "__i": [i for i, _ in told], "verdict": [v for _, v in told], "n": list(told.values())})

    out = f"{process} {types[process]}, __i string, verdict string, n long"
    told = rows.groupBy(process).applyInPandasWithState(run, out, "ids array<string>, digests array<string>", "append", "NoTimeout")
    return told.select(process, F.col("__i").cast(types[input_id]).alias(input_id), "verdict", "n")


def accept_batches(path: str, key: list[str], content: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that gives the same verdicts in the JVM, for catching up with many arrivals.

    A batch's arrivals are joined with what earlier batches accepted, which is
    in their folders; one write a batch, (key, verdict, n, digest), the digest
    only of accepted inputs. It reads the keys of all that was accepted, so it
    suits few large batches, ``accept_stream`` many small ones. Keys are not null.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
        rows = batch.select(*key, *[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)], digest.alias("__d"))
        held = F.lit(None).cast("string")
        if batch_id > 0:
            before = batch.sparkSession.read.parquet(path).where((F.col("batch") < batch_id) & (F.col("verdict") == "accepted"))
            rows, held = rows.join(before.select(*key, F.col("digest").alias("__held")), key, "left"), F.col("__held")
        w = W.partitionBy(*key).orderBy(*[f"__o{i}" for i in range(len(order))], "__d")
        verdict = F.when(held.isNull() & (F.row_number().over(w) == 1), "accepted").when(F.coalesce(held, F.first("__d").over(w)) == F.col("__d"), "duplicate").otherwise("conflict")
        told = rows.withColumn("verdict", verdict).groupBy(*key, "verdict").agg(F.count("*").alias("n"), F.max(F.when(F.col("verdict") == "accepted", F.col("__d"))).alias("digest"))
        told.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def idempotent_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes each batch to a folder of its own, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Take all that is there, then stop; started again it goes on from its checkpoint."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
