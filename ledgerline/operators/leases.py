"""Outbox and timer leases: claims, expiry, acknowledgement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CLAIM, ATTEMPTS = 128, 64


def expired(expires_at: Column, now: Column) -> Column:
    """A lease is over strictly after its expiry."""
    return now > expires_at


def _first(rows: DataFrame, scope: str, order: list[str], limit: int) -> DataFrame:
    # a row_number filter lets Spark cut each task to the first rows of a scope before the shuffle
    return rows.withColumn("rn", F.row_number().over(W.partitionBy(scope).orderBy(*order))).where(F.col("rn") <= limit)


def claim_outbox(actions: DataFrame, scope: str, now: Column, lease: int, limit: int = CLAIM) -> DataFrame:
    """(scope, action_id, delivery_attempt, expires_at, error) of one claim on each scope.

    Takes unacknowledged actions without a live lease, by action id. One
    selected row at 64 attempts or more fails its scope's whole claim.
    """
    free = actions.where(~F.col("acknowledged") & (F.col("expires_at").isNull() | expired(F.col("expires_at"), now)))
    taken = _first(free, scope, ["action_id"], limit)
    worst = F.max("attempt").over(W.partitionBy(scope))
    return taken.select(scope, "action_id", F.col("attempt").alias("delivery_attempt"), (now + lease).alias("new_expires_at"), F.when(worst >= ATTEMPTS, "QuotaExceeded").alias("error"))


def claim_ceiling(claimed: DataFrame, scope: str) -> DataFrame:
    """(scope, n, worst, code): a claim that selected an action at 64 attempts or more fails as a whole, and gives nothing out."""
    worst = F.max("delivery_attempt")
    return claimed.groupBy(scope).agg(F.count("*").alias("selected"), worst.alias("worst")).select(scope, F.when(F.col("worst") < ATTEMPTS, F.col("selected")).otherwise(F.lit(0)).alias("n"), "worst", F.when(F.col("worst") >= ATTEMPTS, "QuotaExceeded").alias("code"))


def timer_kind_code(kind: Column) -> Column:
    """Why an action can't be scheduled as a timer, or null."""
    return F.when(kind != "Timer", "Invariant")


def claim_due(timers: DataFrame, scope: str, now: Column, limit: int = CLAIM) -> DataFrame:
    """Pending timers that are due and not leased, by due time and action id."""
    due = timers.where((F.col("state") == 0) & (F.col("due_at") <= now) & (F.col("expires_at").isNull() | expired(F.col("expires_at"), now)))
    return _first(due, scope, ["due_at", "action_id"], limit).select(scope, "action_id", "due_at", "rn")


def schedule_timers(requests: DataFrame, actions: DataFrame, action: str, due: str, order: list[str]) -> DataFrame:
    """(action, due, verdict): scheduled first, duplicate if the due time is equal, conflict if not, rejected without an action."""
    w = W.partitionBy(action).orderBy(*order)
    told = requests.join(actions.select(action, F.lit(True).alias("known")), action, "left")
    verdict = F.when(F.col("known").isNull(), "UnknownAction").when(F.row_number().over(w) == 1, "scheduled").when(F.first(due).over(w) == F.col(due), "duplicate").otherwise("conflict")
    return told.select(action, due, verdict.alias("verdict"))


def funnel(actions: DataFrame, scope: str, now: Column) -> DataFrame:
    """(scope, total, acknowledged, leased, claimable, exhausted) of each outbox."""
    live = F.col("expires_at").isNotNull() & ~expired(F.col("expires_at"), now)
    open_ = ~F.col("acknowledged")
    return actions.groupBy(scope).agg(
        F.count("*").alias("total"), F.count_if("acknowledged").alias("acknowledged"), F.count_if(open_ & live).alias("leased"),
        F.count_if(open_ & ~live).alias("claimable"), F.count_if(open_ & (F.col("attempt") >= ATTEMPTS)).alias("exhausted"),
    )


def acknowledge(held: DataFrame, stored: DataFrame, on: list[str]) -> DataFrame:
    """The held leases with whether they equal a stored, pending one in every column of ``on``."""
    live = stored.where(~F.col("acknowledged")).select(*on, F.lit(True).alias("__ok")).distinct()
    return held.join(live, on, "left").withColumn("acknowledged", F.col("__ok").isNotNull()).drop("__ok")


def renewal_code(expires_at: Column, now: Column, acknowledged: Column, new_expiry: Column) -> Column:
    """Why a lease can't be renewed, or null: it must not be over, be pending, and end strictly later."""
    return F.when(expired(expires_at, now), "TimedOut").when(acknowledged | (new_expiry <= expires_at), "Invariant")


def validate_claims(leases: DataFrame, claim: str, owner: Column, now: Column) -> DataFrame:
    """Each lease of a batch with its first failing rule: owner, expiry, pending, action or token twice in the batch."""
    twice = lambda c: F.count("*").over(W.partitionBy(claim, c)) > 1
    code = (
        F.when(F.col("owner") != owner, "OwnerMismatch").when(expired(F.col("expires_at"), now), "TimedOut").when(F.col("acknowledged"), "NotPending")
        .when(twice("action_id"), "DuplicateAction").when(twice("token"), "DuplicateToken")
    )
    return leases.withColumn("code", code)


def next_attempt(attempt: Column, acknowledged: Column) -> Column:
    """The attempt after this delivery, null where none may follow."""
    return F.when(~acknowledged & (attempt < ATTEMPTS), attempt + 1)


def latest_state(versions: DataFrame, key: list[str], state: str, version: list[str]) -> DataFrame:
    """(key, state): the state of the last version of each key, one partial aggregation and no sort."""
    return versions.groupBy(*key).agg(F.max_by(state, F.struct(*version)).alias(state))


def timer_lease_code(kind: Column, due_at: Column, now: Column, same: Column, owner: Column, expires_at: Column) -> Column:
    """The first failing rule of a claimed timer, or null: its kind, due time, scope and owner, then its expiry."""
    return F.when(kind != "Timer", "Invariant").when(~same | ~owner | (due_at > now), "Invariant").when(expired(expires_at, now), "TimedOut")


def drain_timers(timers: DataFrame, accepted: DataFrame, scope: str, now: Column, identity: Column, limit: int = CLAIM) -> DataFrame:
    """(scope, action_id, input_id, verdict): due timers as inputs; one whose acknowledgement was lost gives its old input again."""
    due = claim_due(timers, scope, now, limit).select(scope, "action_id", identity.alias("input_id"))
    old = accepted.select(scope, "input_id", F.lit(True).alias("__old")).distinct()
    return due.join(old, [scope, "input_id"], "left").select(scope, "action_id", "input_id", F.when(F.col("__old"), "duplicate").otherwise("accepted").alias("verdict"))


def lease_tokens(rows: DataFrame, scope: str, order: list[str], base: int, buckets: int = 1024) -> DataFrame:
    """The rows with unique tokens beyond ``base`` that increase with the order inside each scope.

    Offsets come from counts: first of 1,024 buckets of scopes, then of a
    bucket's scopes, then the place in the scope; no task sees all rows.
    """
    counts = rows.groupBy(scope).agg(F.count("*").alias("n")).withColumn("b", F.pmod(F.xxhash64(scope), F.lit(buckets)))
    sums = counts.groupBy("b").agg(F.sum("n").alias("n"))
    before = sums.select("b", (F.sum("n").over(W.orderBy("b")) - F.col("n")).alias("first"))
    inside = F.sum("n").over(W.partitionBy("b").orderBy(scope)) - F.col("n")
    offsets = counts.withColumn("inside", inside).join(before, "b").select(scope, (F.col("inside") + F.col("first")).alias("__at"))
    place = F.row_number().over(W.partitionBy(scope).orderBy(*order))
    return rows.withColumn("__n", place).join(offsets, scope).withColumn("token", F.col("__n") + F.col("__at") + base).drop("__n", "__at")
