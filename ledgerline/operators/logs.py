"""Integrity, commit, paging, inbox and quota operators over keyed logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.operators.folds import fold_log

PAGE, LOG, COMMIT = 512, 4096, 128


def first_failing(*rules: tuple[str, Column]) -> Column:
    """The code of the first rule whose failure condition holds, null if none does."""
    out = F.when(rules[0][1], rules[0][0])
    for code, bad in rules[1:]:
        out = out.when(bad, code)
    return out


def contiguity(log: DataFrame, scope: str, sequence: str, identity: str) -> DataFrame:
    """(scope, n, next_sequence, contiguous, unique_ids, within_limit) of each log, one aggregation and no window."""
    n = F.count("*")
    return log.groupBy(scope).agg(
        n.alias("n"), (F.max(sequence) + 1).alias("next_sequence"),
        ((F.min(sequence) == 0) & (F.max(sequence) == n - 1) & (F.count_distinct(sequence) == n)).alias("contiguous"),
        (F.count_distinct(identity) == n).alias("unique_ids"), (n <= LOG).alias("within_limit"),
    )


def pages(log: DataFrame, scope: str, sequence: str, size: int = PAGE, start: int = 0) -> DataFrame:
    """(scope, page, first, n, continuation): replay pages of ``size`` outcomes from ``start``; the last page continues nowhere."""
    kept = log.where(F.col(sequence) >= start).select(scope, sequence, F.floor((F.col(sequence) - start) / size).cast("long").alias("page"))
    each = kept.groupBy(scope, "page").agg(F.min(sequence).alias("first"), F.count("*").alias("n"))
    return each.select(scope, "page", "first", "n", F.lead("first").over(W.partitionBy(scope).orderBy("page")).alias("continuation"))


def read_outcomes(log: DataFrame, heads: DataFrame, scope: str, sequence: str, start: int, limit: int = PAGE) -> DataFrame:
    """(scope, n, next, code) of one read of each scope's log from ``start``: min(head - start, limit) outcomes must be there, else the log is corrupt.

    heads: (scope, next_sequence). next is where the read goes on, null at the
    end of the log. A scope without a head has nothing to read.
    """
    there = log.where((F.col(sequence) >= start) & (F.col(sequence) < start + limit)).groupBy(scope).agg(F.count("*").alias("n"), F.max(sequence).alias("last"))
    want = F.least(F.greatest(F.col("next_sequence") - start, F.lit(0)), F.lit(limit))
    n = F.coalesce("n", F.lit(0))
    ok = (n == want) & (F.coalesce(F.col("last"), F.lit(start - 1)) == start + want - 1)
    more = ok & (start + want < F.col("next_sequence"))
    return heads.join(there, scope, "left").select(scope, n.alias("n"), F.when(more, start + want).alias("next"), F.when(~ok, "CorruptLog").alias("code"))


def heads_agree(heads: DataFrame, log: DataFrame, scope: str, sequence: str) -> DataFrame:
    """(scope, consistent): the stored head equals one past the log's last sequence, or both are absent."""
    tail = log.groupBy(scope).agg((F.max(sequence) + 1).alias("tail"))
    return heads.join(tail, scope, "full_outer").select(scope, F.col("next_sequence").eqNullSafe(F.col("tail")).alias("consistent"))


def running_quota(log: DataFrame, scope: str, order: list[str], size: str, limit: int, max_scopes: int | None = None) -> DataFrame:
    """Each row with the bytes used in its scope after it and whether it was accepted.

    A row that would go beyond ``limit`` is refused and charges nothing. With
    ``max_scopes``, scopes are admitted in ascending order of their name, and the
    rows of later ones are refused.
    """

    def step(used, n):
        fits = used[0] + (n or 0) <= limit
        used[0] += (n or 0) if fits else 0
        return used[0], fits

    told = fold_log(log, [scope], order, [size], lambda: [0], step, "used long, accepted boolean")
    if max_scopes is None:
        return told
    admitted = log.select(scope).distinct().orderBy(scope).limit(max_scopes).withColumn("__in", F.lit(True))
    fits = F.coalesce("__in", F.lit(False))
    return told.join(admitted, scope, "left").withColumns({"used": F.when(fits, F.col("used")).otherwise(F.lit(0).cast("long")), "accepted": F.col("accepted") & fits}).drop("__in")


def accept_inputs(arrivals: DataFrame, key: list[str], content: list[str], order: list[str]) -> DataFrame:
    """Each arrival with its verdict: the first of a key is accepted, an equal repeat is a duplicate, a different one a conflict."""
    w = W.partitionBy(*key).orderBy(*order)
    body = F.struct(*content)
    verdict = F.when(F.row_number().over(w) == 1, "accepted").when(F.first(body).over(w).eqNullSafe(body), "duplicate").otherwise("conflict")
    return arrivals.withColumn("verdict", verdict)


def pending_inputs(inputs: DataFrame, consumed: DataFrame, process: str, input_id: str, limit: int = 64) -> DataFrame:
    """Unconsumed inputs, the first ``limit`` of each process by id (byte order, not arrival)."""
    left = inputs.join(consumed.select(process, input_id).distinct(), [process, input_id], "left_anti")
    return left.withColumn("rn", F.row_number().over(W.partitionBy(process).orderBy(input_id))).where(F.col("rn") <= limit)


def store_blobs(puts: DataFrame, scope: str, payload: str) -> DataFrame:
    """Content-addressed puts: (scope, digest, n_bytes, n_puts), equal payloads of a scope kept once."""
    return puts.groupBy(scope, F.sha2(F.col(payload).cast("binary"), 256).alias("digest")).agg(F.max(F.octet_length(payload)).cast("long").alias("n_bytes"), F.count("*").alias("n_puts"))


def validate_commits(outcomes: DataFrame, commit: str, expected: Column, sequence: str, identity: str, limit: int = COMMIT) -> DataFrame:
    """(commit, n, code): the first failing rule of each commit's outcomes in the order of their positions, or null."""
    pos = W.partitionBy(commit).orderBy(sequence, identity)
    placed = outcomes.select(commit, identity, F.col(sequence).alias("s"), F.row_number().over(pos).alias("pos"), (expected + F.row_number().over(pos) - 1).alias("want"))
    marked = placed.withColumn("again", F.row_number().over(W.partitionBy(commit, identity).orderBy("pos")) > 1)
    code = first_failing(("NonContiguousSequence", F.col("s") != F.col("want")), ("DuplicateOutcomeId", F.col("again")))
    each = marked.select(commit, "pos", code.alias("code"))
    worst = each.groupBy(commit).agg(F.count("*").alias("n"), F.min_by("code", F.when(F.col("code").isNotNull(), F.col("pos"))).alias("code"))
    return worst.select(commit, "n", F.when(F.col("n") > limit, "OutcomeLimitExceeded").otherwise(F.col("code")).alias("code"))


def missing_rows(expected: DataFrame, stored: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a retried commit that are not stored as expected."""
    return expected.select(*columns).join(stored.select(*columns), columns, "left_anti")
