"""Retry timers, required outcomes and review requests of sagas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions.scalars import due_at
from ledgerline.operators.logs import first_failing


def schedule(projected: DataFrame, now: Column, base: int, most: int, attempts: int) -> DataFrame:
    """Each request for a retry timer with code, status, next_attempt and retry_due_at.

    Needs status, attempt, retry_due_at (of a timer that is pending), active (the
    request names the active action), result, backoff (the step has one),
    deadline (null: none) and n_compensable. A due time beyond the deadline,
    which is itself in time, begins the compensation instead.
    """
    code = first_failing(
        ("TerminalProjection", F.col("status") != "Running"), ("UnexpectedAction", ~F.col("active")), ("RetryTimerMustFire", F.col("retry_due_at").isNotNull()),
        ("RetryTimerRequiresRetryableFailure", F.col("result") != "R"), ("RetryTimerNotConfigured", ~F.col("backoff")), ("RetryTimerNotRequired", F.col("attempt") + 1 >= attempts),
    )
    due = due_at(now, base, most, F.col("attempt"))
    late = F.col("deadline").isNotNull() & (due > F.col("deadline"))
    back = F.when(F.col("n_compensable") > 0, "Compensating").otherwise("Escalated")
    fine = code.isNull()
    return projected.select(
        *[c for c in projected.columns if c not in ("status", "retry_due_at")], code.alias("code"),
        F.when(fine & late, back).otherwise(F.col("status")).alias("status"),
        F.when(~fine | (late & (back == "Escalated")), F.col("attempt")).when(late, F.lit(0)).otherwise(F.col("attempt") + 1).alias("next_attempt"),
        F.when(fine & late, F.lit(None)).when(fine, due).otherwise(F.col("retry_due_at")).alias("retry_due_at"),
    )


def fire(projected: DataFrame, fired_at: Column) -> DataFrame:
    """Each delivery of a retry timer with its code; null clears the timer and repeats the step."""
    code = first_failing(
        ("TerminalProjection", F.col("status") != "Running"), ("UnexpectedRetryTimer", ~F.col("active") | F.col("retry_due_at").isNull()), ("RetryTimerFiredEarly", fired_at < F.col("retry_due_at")),
    )
    return projected.withColumn("code", code)


def timer_schedules(decisions: DataFrame) -> DataFrame:
    """The decisions that ask for a timer: those with a next action and a due time."""
    return decisions.where(F.col("next_action").isNotNull() & F.col("retry_due_at").isNotNull())


def outcomes(events: DataFrame, process: list[str], order: list[str], kinds: Column) -> DataFrame:
    """(process, sequence, event order, kind): the outcome rows of each event, numbered from 0 without gaps in each process."""
    listed = events.select(*process, *order, kinds.alias("__kinds"))
    before = F.coalesce(F.sum(F.size("__kinds")).over(W.partitionBy(*process).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return listed.withColumn("__base", before).select(*process, *order, "__base", F.posexplode("__kinds").alias("pos", "kind")).select(*process, *order, (F.col("__base") + F.col("pos")).alias("sequence"), "kind")


def kinds_match(recorded: Column, observed: Column, planned: Column) -> Column:
    """Whether the recorded kinds are the observed, then the planned ones."""
    return recorded == F.concat(observed, planned)


def review_requests(projected: DataFrame, pinned: Column) -> DataFrame:
    """Each projection with the code of a request for manual review: only escalated processes of the pinned definition get one (null)."""
    return projected.withColumn("code", first_failing(("ManualReviewNotRequired", F.col("status") != "Escalated"), ("OutcomeScopeMismatch", ~pinned)))
