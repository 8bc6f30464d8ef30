"""Evidence correlation, dispositions, reviews and authorization."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Operations that need two principals.
DISTINCT_PRINCIPALS = ("DecideReview", "TerminalOverride")


def correlate(commands: DataFrame, evidence: DataFrame, on: str, checks: list[tuple[str, str, str]]) -> DataFrame:
    """Each piece of evidence for a command with its first mismatch; commands without evidence are Missing.

    ``checks`` are (reason, command column, evidence column) in the order in which they are told.
    """
    both = commands.join(evidence, on, "left")
    reason = F.when(F.col("evidence_id").isNull(), "Missing")
    for code, a, b in checks:
        reason = reason.when(~F.col(a).eqNullSafe(F.col(b)), code)
    return both.withColumn("verdict", reason.otherwise("Verified"))


def canonical_disposition(status: Column, now: Column, until: Column) -> Column:
    """What canonical evidence says to do: Committed, Wait, Retry or Escalate."""
    return F.when(status == "Committed", "Committed").when(status == "NotCommitted", F.when(now < until, "Wait").otherwise("Retry")).otherwise("Escalate")


def effect_disposition(state: Column, now: Column, deadline: Column) -> Column:
    """What an external effect's evidence says to do; the deadline itself is still in time."""
    return F.when(state == "Succeeded", "Completed").when((state == "KnownFailure") & (now <= deadline), "Retry").otherwise("Escalate")


def review_verdict(claimed_by: Column, decided_by: Column, at: Column, expires_at: Column, distinct: Column) -> Column:
    """The first failing rule of a review decision, or Accepted."""
    return F.when(expires_at.isNotNull() & (at > expires_at), "Expired").when(distinct & (claimed_by == decided_by), "SamePrincipal").otherwise("Accepted")


def required_control(operation: Column) -> Column:
    """The control that an operation needs."""
    return F.when(operation.isin(*DISTINCT_PRINCIPALS), "DistinctPrincipals").otherwise("AuthenticatedPrincipal")


def task_evidence(status: Column, contract: Column) -> Column:
    """A finished task as evidence for its effect."""
    return F.when(status == "Completed", "Succeeded").when((status == "Exhausted") & (contract == "Pure"), "KnownFailure").otherwise("Unknown")


def expectations(commands: DataFrame, scopes: DataFrame, on: str) -> DataFrame:
    """Commands with their scope as expectations; code is TenantMismatch where the tenants differ, UnknownScope without one."""
    both = commands.join(scopes.withColumnRenamed("tenant", "__tenant"), on, "left")
    return both.withColumn("code", F.when(F.col("__tenant").isNull(), "UnknownScope").when(F.col("__tenant") != F.col("tenant"), "TenantMismatch")).drop("__tenant")


def first_mismatch(*checks: tuple[str, Column, Column]) -> Column:
    """The reason of the first pair of columns that differs (nulls are equal), or null."""
    out = F.when(~checks[0][1].eqNullSafe(checks[0][2]), checks[0][0])
    for code, a, b in checks[1:]:
        out = out.when(~a.eqNullSafe(b), code)
    return out


def effect_code(stored_key: Column, derived_key: Column, action: Column, want_action: Column, now: Column, deadline: Column) -> Column:
    """The first failing rule of an effect's evidence, or null; the deadline itself is in time."""
    return F.when(stored_key != derived_key, "EffectKeyMismatch").when(action != want_action, "ActionMismatch").when(deadline.isNotNull() & (now > deadline), "DeadlineExceeded")


def task_outcome(bound: Column, status: Column, output_intact: Column, state: Column, contract: Column, evidence: Column) -> Column:
    """What a finished task proves about its effect: its state, or the first failing rule.

    ``state`` is the classifier's, ``evidence`` an independent verifier's (null: none), which only pure tasks do without.
    """
    pure = contract == "Pure"
    return (
        F.when(~bound, "BindingMismatch").when(status != "Completed", "NotCompleted").when(~output_intact, "CorruptOutput").when(state == "Unknown", "Unresolved")
        .when(~pure & evidence.isNull(), "MissingEvidence").when(~pure & (evidence == "Unknown"), "Unresolved").when(~pure & (evidence != state), "EvidenceMismatch").otherwise(state)
    )


def dispatchable(actions: DataFrame, tasks: DataFrame, on: str) -> DataFrame:
    """Committed actions with what to do: submit without a task, recover an unfinished one, accept a finished one; a task without a committed action is an orphan."""
    both = actions.select(on, F.lit(True).alias("__a")).join(tasks.select(on, "status"), on, "full_outer")
    todo = F.when(F.col("__a").isNull(), "orphan").when(F.col("status").isNull(), "submit").when(F.col("status").isin("Completed", "Exhausted"), "accept").otherwise("recover")
    return both.select(on, todo.alias("todo"))


def bind_checkpoints(evidence: DataFrame, checkpoints: DataFrame, on: list[str]) -> DataFrame:
    """Each piece of evidence with whether a checkpoint of the same scope, generation and blob exists."""
    return evidence.join(checkpoints.select(*on, F.lit(True).alias("__c")).distinct(), on, "left").withColumn("bound", F.col("__c").isNotNull()).drop("__c")


def authorized(requests: DataFrame, authorizations: DataFrame, on: list[str]) -> DataFrame:
    """The requests for which an authorization exists; no row denies."""
    return requests.join(authorizations.select(*on).distinct(), on, "left_semi")


def bind_events(events: DataFrame, inputs: DataFrame, commits: DataFrame, key: str) -> DataFrame:
    """(key, code) of each verified event against the input and the commit that it is bound to, or the first mismatch.

    events: (key, input_id, commit_id, scope, digest); inputs: (input_id, kind,
    scope, digest); commits: (commit_id, scope). A missing input or commit
    mismatches in its first rule.
    """
    i = inputs.select("input_id", F.col("kind").alias("__kind"), F.col("scope").alias("__is"), F.col("digest").alias("__d"))
    c = commits.select("commit_id", F.col("scope").alias("__cs"))
    code = first_mismatch(("InputKindMismatch", F.col("__kind"), F.lit("CanonicalEvent")), ("InputScopeMismatch", F.col("__is"), F.col("scope")), ("InputPayloadDigestMismatch", F.col("__d"), F.col("digest")), ("CommitScopeMismatch", F.col("__cs"), F.col("scope")))
    return events.join(i, "input_id", "left").join(c, "commit_id", "left").select(key, code.alias("code"))


def check_reconciliations(found: DataFrame, actions: DataFrame, key: str) -> DataFrame:
    """(key, code) of each reconciliation (key, scope, action, evidence, tenant) against the action that it is about."""
    a = actions.select(key, *[F.col(c).alias(f"__{c}") for c in ("scope", "action", "evidence", "tenant")])
    code = first_mismatch(*[(f"{c.capitalize()}Mismatch", F.col(c), F.col(f"__{c}")) for c in ("scope", "action", "evidence", "tenant")])
    return found.join(a, key, "left").select(key, code.alias("code"))


def check_audits(audits: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """(key, code) of each audit record (key, scope, operation) against the review (key, scope, operation) that it belongs to."""
    r = reviews.select(key, F.col("scope").alias("__scope"), F.col("operation").alias("__operation"))
    code = first_mismatch(("ScopeMismatch", F.col("scope"), F.col("__scope")), ("OperationMismatch", F.col("operation"), F.col("__operation")))
    return audits.join(r, key, "left").select(key, code.alias("code"))


def relay(identity: Column, status: Column) -> tuple[Column, Column]:
    """(input id, observation) of a finished task's result: Completed succeeded, Exhausted failed for good, anything else is unknown."""
    return identity, F.when(status == "Completed", "succeeded").when(status == "Exhausted", "terminal_failure").otherwise("unknown")


def retry_safe(status: Column, now: Column, until: Column) -> Column:
    """Whether an effect may be tried again: it is known not to have been committed, and the time in which it could be is over."""
    return (status == "NotCommitted") & (now >= until)
