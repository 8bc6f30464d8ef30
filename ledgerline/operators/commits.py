"""Atomic commits, receipts, checksums, definitions in force and payload reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.operators.folds import fold_log
from ledgerline.operators.logs import LOG, PAGE, first_failing


def commit_log(arrivals: DataFrame, scope: str, order: list[str], expected: str, n: str, digest: str, input_id: str, limit: int = LOG) -> DataFrame:
    """Each commit in arrival order with its verdict: committed, duplicate, Conflict or QuotaExceeded.

    A commit must expect the head, may not go beyond ``limit`` outcomes and may
    not take an input again. A repeat of a committed one (equal first sequence)
    is a duplicate if the digest is equal, else a conflict. One shuffle on the
    scope; the fold carries the head and the inputs taken, at most ``limit``.
    """
    rows = arrivals.select(scope, *order, F.col(expected).cast("long").alias("__e"), F.col(n).cast("long").alias("__n"), F.col(digest).alias("__d"), F.col(input_id).alias("__i"))

    def step(a, e, size, d, i):
        if e in a["by"]:
            return ("duplicate" if a["by"][e] == d else "Conflict",)
        if e != a["head"] or i in a["took"]:
            return ("Conflict",)
        if a["head"] + size > limit:
            return ("QuotaExceeded",)
        a["head"] += size
        a["by"][e] = d
        if i is not None:
            a["took"].add(i)
        return ("committed",)

    told = fold_log(rows, [scope], order, ["__e", "__n", "__d", "__i"], lambda: {"head": 0, "by": {}, "took": set()}, step, "verdict string")
    return told.select(scope, *order, "verdict")


def page_code(n: Column, contiguous: Column, end: Column, continuation: Column, same_scope: Column) -> Column:
    """The first failing rule of a replay page, or null; an empty page continues nowhere."""
    return first_failing(("LimitExceeded", n > PAGE), ("OutcomeScopeMismatch", ~same_scope), ("NonContiguousSequence", ~contiguous), ("InvalidContinuation", continuation.isNotNull() & ((n == 0) | (continuation != end + 1))))


def receipt_code(through: Column, expected: Column, n: Column, duplicate: Column, has_input: Column) -> Column:
    """The first failing rule of a commit's receipt, or null."""
    return first_failing(("SequenceMismatch", through != expected + F.greatest(n - 1, F.lit(0))), ("DuplicateInputWithoutInput", duplicate & ~has_input))


def checksum_holds(record: Column, checksum: Column) -> Column:
    """Whether a stored record still has its checksum."""
    return F.sha2(record, 256) == checksum


def same_scope(rows: DataFrame, columns: list[tuple[str, str]]) -> Column:
    """Whether all the pairs of scope columns are equal, nulls included."""
    out = F.lit(True)
    for a, b in columns:
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def repeated_effects(actions: DataFrame, commit: str, coordinates: list[str]) -> DataFrame:
    """(commit, n_actions, n_effects): commits with fewer effects than actions name one effect twice."""
    return actions.groupBy(commit).agg(F.count("*").alias("n_actions"), F.count_distinct(F.struct(*coordinates)).alias("n_effects"))


def register_definitions(puts: DataFrame, key: list[str], order: list[str], digest: str) -> DataFrame:
    """(key, digest, n_equal, n_conflicts): the first writer of a definition wins, others equal it or conflict."""
    first = puts.withColumn("__first", F.first(digest).over(W.partitionBy(*key).orderBy(*order)))
    return first.groupBy(*key).agg(F.max("__first").alias("digest"), (F.count_if(F.col(digest) == F.col("__first")) - 1).alias("n_equal"), F.count_if(F.col(digest) != F.col("__first")).alias("n_conflicts"))


def read_payloads(wanted: DataFrame, blobs: DataFrame, scope: str, digest: str, payload: str) -> DataFrame:
    """Each wanted (scope, digest) with n_bytes and a code: MissingPayload, CorruptPayload or null; never an empty payload in place of a missing one."""
    held = blobs.select(scope, digest, F.col(payload).cast("binary").alias("__p")).dropDuplicates([scope, digest])
    code = F.when(F.col("__p").isNull(), "MissingPayload").when(F.sha2("__p", 256) != F.col(digest), "CorruptPayload")
    return wanted.join(held, [scope, digest], "left").select(*wanted.columns, F.octet_length("__p").alias("n_bytes"), code.alias("code"))


def verify_receipts(receipts: DataFrame, inputs: DataFrame, on: list[str], digest: str) -> DataFrame:
    """Each inbox receipt with whether it names an accepted input with that content."""
    known = inputs.select(*on, F.col(digest).alias("__d"))
    return receipts.join(known, on, "left").select(*receipts.columns, F.coalesce(F.col("__d") == F.col(digest), F.lit(False)).alias("valid"))
