"""Recoverable tasks: history replay, recovery, fencing, retirement."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.operators.folds import fold_log


def may_start(generations: DataFrame, key: str) -> DataFrame:
    """Each generation with whether all earlier ones of its task are stopped (state 2)."""
    earlier = W.partitionBy(key).orderBy("generation").rowsBetween(W.unboundedPreceding, -1)
    return generations.withColumn("may_start", F.coalesce(F.min(F.when(F.col("state") == 2, 1).otherwise(0)).over(earlier), F.lit(1)) == 1)


def retirable(projected: DataFrame, generations: DataFrame, key: str) -> DataFrame:
    """Tasks that are terminal and have no live generation."""
    live = generations.where(F.col("state") != 2).select(key).distinct()
    return projected.where(F.col("status").isin("Completed", "Exhausted")).join(live, key, "left_anti")


def recovery(status: Column, generation: Column, tick: Column, restart_at: Column, deadline: Column, attempts: int, mode: Column, contract: Column) -> Column:
    """What a faulted task needs: reconcile first, recover, or give up; null for others."""
    can = (mode != "NeverRestart") & (generation < attempts) & (tick < deadline) & (restart_at < deadline)
    ask = (contract == "ReconcileRequired") | (mode == "ReconcileBeforeRestart")
    return F.when(status != "Faulted", None).when(ask, "reconcile").when(can, "recover").otherwise("exhaust")


def observe(proposal: Column, generation: Column, current: Column, tick: Column, execution_deadline: Column, size: Column, most: Column) -> Column:
    """What becomes of a worker's proposal: rejected if stale, a Timeout if late and no fault, OutputLimit if too large, else itself."""
    late = (tick >= execution_deadline) & (proposal != "FaultObserved")
    return F.when(generation != current, "StaleGeneration").when(late, "Timeout").when(proposal.isin("CheckpointCommitted", "Completed") & (size > most), "OutputLimit").otherwise(proposal)


def journal(commits: DataFrame, key: str, order: list[str], expected: str, previous: str, digest: str, limit: int) -> DataFrame:
    """Each journal commit with its verdict; it must expect the next sequence and name the last record's digest (null at first)."""
    rows = commits.select(key, *order, F.col(expected).cast("long").alias("__e"), F.col(previous).alias("__p"), F.col(digest).alias("__d"))

    def step(a, e, p, d):
        if e != a["next"] or p != a["last"]:
            return ("Conflict",)
        if a["next"] >= limit:
            return ("QuotaExhausted",)
        a["next"], a["last"] = a["next"] + 1, d
        return ("committed",)

    told = fold_log(rows, [key], order, ["__e", "__p", "__d"], lambda: {"next": 0, "last": None}, step, "verdict string")
    return told.select(key, *order, "verdict")


def reconstruct(records: DataFrame, key: str, sequence: str, body: str, checksum: str) -> DataFrame:
    """(key, n, n_bytes, code) of each stored history: gaps and damaged records are told, bytes added up."""
    return records.groupBy(key).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(body)), F.lit(0)).alias("n_bytes"),
        F.when((F.min(sequence) != 0) | (F.max(sequence) + 1 != F.count("*")), "InvalidOrder").when(F.count_if(F.sha2(F.col(body), 256) != F.col(checksum)) > 0, "CorruptRecord").alias("code"),
    )


def rebuild_heads(heads: DataFrame, log: DataFrame, key: str, sequence: str) -> DataFrame:
    """(key, next_sequence, code): a missing head is rebuilt from its log; one that differs from it is Corrupt and stays."""
    tail = log.groupBy(key).agg((F.max(sequence) + 1).alias("__tail"))
    both = heads.select(key, F.col("next_sequence").alias("__head")).join(tail, key, "full_outer")
    return both.select(key, F.coalesce("__head", "__tail").alias("next_sequence"), F.when(F.col("__head").isNull(), "rebuilt").when(~F.col("__head").eqNullSafe(F.col("__tail")), "Corrupt").alias("code"))


@dataclass(frozen=True)
class Definition:
    """Limits and policies of a recoverable task."""

    attempts: int = 3
    timeout: int = 20
    delay: int = 0
    deadline: int = 1000
    history: int = 64
    checkpoints: int = 8
    checkpoint_bytes: int = 40
    output_bytes: int = 40
    mode: str = "RestartFromCheckpoint"
    contract: str = "Pure"

    @property
    def reconciles(self) -> bool:
        return self.contract == "ReconcileRequired" or self.mode == "ReconcileBeforeRestart"


_STATE = ("status", "next_sequence", "tick", "generation", "until", "restart", "made", "checkpoint")


def _apply(a: Column, r: Column, d: Definition) -> tuple[Column, Column]:
    """(code, state after) of one record in a state: why it is refused, or null and where it leads."""
    false, nothing = F.lit(False), F.lit(None).cast("string")
    kind, tick, s = r["kind"], r["tick"], a["status"]
    begins, is_checkpoint = kind.isin("Started", "Restarted"), kind.isin("CheckpointCommitted", "CheckpointMigrated")
    live = kind.isin("CheckpointCommitted", "Completed")
    can = _can_recover(a, tick, d)
    needed = {
        "IntentCommitted": ["Empty"], "CheckpointMigrated": ["Pending"], "Started": ["Pending"], "Restarted": ["Ready"], "CheckpointCommitted": ["Running"], "FaultObserved": ["Running"], "Completed": ["Running"],
        "ReconciliationRequired": ["Faulted"], "Reconciled": ["Reconciling"], "RecoveryPlanned": ["Reconciled" if d.reconciles else "Faulted"], "RecoveryExhausted": ["Faulted", "Reconciled", "Reconciling", "Pending", "Ready"],
    }
    fits = false
    for name, states in needed.items():
        fits = fits | ((kind == name) & s.isin(*states))
    waiting = s.isin("Pending", "Ready")
    output = (kind == "Completed") | ((kind == "Reconciled") & r["detail"].eqNullSafe(F.lit("Completed")))
    code = (
        F.when((r["sequence"] != a["next_sequence"]) | (tick < a["tick"]), "InvalidOrder")
        .when((r["sequence"] >= d.history) | ((begins | (kind == "CheckpointCommitted")) & (r["sequence"] + 1 >= d.history)), "QuotaExhausted")
        .when(r["generation"] != F.when(begins, a["generation"] + 1).otherwise(a["generation"]), "StaleGeneration")
        .when(~F.coalesce(fits, false), "InvalidTransition")
        .when((kind == "CheckpointMigrated") & a["checkpoint"].isNotNull(), "ScopeMismatch")
        .when(begins & (r["generation"] > d.attempts), "QuotaExhausted").when(begins & (tick >= d.deadline), "DeadlineExpired").when((kind == "Restarted") & (tick < a["restart"]), "InvalidTransition")
        .when(live & (tick >= a["until"]), "DeadlineExpired")
        .when(is_checkpoint & ((r["bytes"] > d.checkpoint_bytes) | (a["made"] >= d.checkpoints)), "QuotaExhausted").when(output & (r["bytes"] > d.output_bytes), "QuotaExhausted")
        .when((kind == "FaultObserved") & ((r["detail"].eqNullSafe(F.lit("Timeout")) & (tick < a["until"])) | (r["detail"].eqNullSafe(F.lit("DeadlineViolation")) & (tick < d.deadline))), "InvalidTransition")
        .when((kind == "ReconciliationRequired") & F.lit(not d.reconciles), "InvalidTransition")
        .when((kind == "RecoveryPlanned") & ~can, "QuotaExhausted")
        .when((kind == "RecoveryPlanned") & ~r["detail"].eqNullSafe(_resume(a, d)), "CorruptBlob")
        .when((kind == "RecoveryExhausted") & ((waiting & (tick < d.deadline)) | (~waiting & can)), "InvalidTransition")
    )
    after = (
        F.when(kind == "IntentCommitted", "Pending").when(begins, "Running").when(kind == "FaultObserved", "Faulted").when(kind == "ReconciliationRequired", "Reconciling").when(output, "Completed")
        .when((kind == "Reconciled") & (r["detail"] == "RestartAuthorized"), "Reconciled").when(kind == "RecoveryPlanned", "Ready").when(kind == "RecoveryExhausted", "Exhausted").otherwise(s)
    )
    moved = F.struct(
        after.alias("status"), (a["next_sequence"] + 1).alias("next_sequence"), tick.alias("tick"), F.when(begins, r["generation"]).otherwise(a["generation"]).alias("generation"),
        F.when(begins, F.least(tick + d.timeout, F.lit(d.deadline))).otherwise(a["until"]).alias("until"), F.when(kind == "FaultObserved", tick + d.delay).otherwise(a["restart"]).alias("restart"),
        F.when(is_checkpoint, a["made"] + 1).otherwise(a["made"]).alias("made"), F.when(is_checkpoint | (kind == "RecoveryPlanned"), r["detail"]).otherwise(a["checkpoint"]).alias("checkpoint"),
    )
    return code, moved


def _can_recover(a: Column, tick: Column, d: Definition) -> Column:
    return F.lit(d.mode != "NeverRestart") & (a["generation"] < d.attempts) & (tick < d.deadline) & (a["restart"] < d.deadline)


def _resume(a: Column, d: Definition) -> Column:
    """The checkpoint that a recovery resumes from."""
    return F.lit(None).cast("string") if d.mode in ("RestartFromBeginning", "NeverRestart") else a["checkpoint"]


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def project_records(records: DataFrame, key: str, definition: Definition) -> DataFrame:
    """(key, status, next_sequence, tick, generation, until, restart, made, checkpoint, code, code_sequence): each task's whole state after its records; the first refused one ends the fold.

    Records have sequence, tick, generation, kind, detail and bytes. detail
    is the checkpoint's id, the checkpoint to resume from, the fault, or what a
    reconciliation found (Completed, RestartAuthorized, Unknown). They are
    taken by sequence, then by the other columns.
    """
    logged = records.select(key, F.struct(F.col("sequence").cast("long").alias("sequence"), F.col("tick").cast("long").alias("tick"), F.col("generation").cast("long").alias("generation"), "kind", "detail", F.col("bytes").cast("long").alias("bytes")).alias("__r"))
    log = logged.groupBy(key).agg(F.array_sort(F.collect_list("__r")).alias("log"))
    nothing = F.lit(None).cast("string")
    empty = F.struct(F.lit("Empty").alias("status"), *[_long(0).alias(x) for x in _STATE[1:7]], nothing.alias("checkpoint"))
    start = F.struct(empty.alias("s"), nothing.alias("code"), F.lit(None).cast("long").alias("at"))

    def step(x, r):
        code, moved = _apply(x["s"], r, definition)
        refused = F.struct(x["s"].alias("s"), code.alias("code"), r["sequence"].alias("at"))
        return F.when(x["code"].isNotNull(), x).when(code.isNotNull(), refused).otherwise(F.struct(moved.alias("s"), nothing.alias("code"), x["at"].alias("at")))

    done = log.select(key, F.aggregate("log", start, step).alias("x"))
    return done.select(key, *[F.col(f"x.s.{c}").alias(c) for c in _STATE], F.col("x.code").alias("code"), F.col("x.at").alias("code_sequence"))


def replay_records(records: DataFrame, key: str, definition: Definition) -> DataFrame:
    """(key, n_applied, status, generation, tick, checkpoint, code, code_sequence) of each task after its records (see ``project_records``)."""
    return project_records(records, key, definition).select(key, F.col("next_sequence").alias("n_applied"), "status", "generation", "tick", "checkpoint", "code", "code_sequence")


def propose(projected: DataFrame, definition: Definition, kind: Column, generation: Column, tick: Column, detail: Column, size: Column) -> DataFrame:
    """``projected`` (from ``project_records``) with proposed_code and proposed_status: what one more record would come to, in a copy of the state."""
    state = F.struct(*_STATE)
    record = F.struct(F.col("next_sequence").alias("sequence"), tick.cast("long").alias("tick"), generation.cast("long").alias("generation"), kind.alias("kind"), detail.alias("detail"), size.cast("long").alias("bytes"))
    rows = projected.withColumns({"__s": state, "__r": record})
    code, moved = _apply(F.col("__s"), F.col("__r"), definition)
    return rows.withColumns({"proposed_code": code, "proposed_status": F.when(code.isNull(), moved["status"])}).drop("__s", "__r")


def next_transition(projected: DataFrame, definition: Definition, tick: Column) -> DataFrame:
    """``projected`` with next_kind, next_generation, next_detail and next_code: the one record that a supervisor would write at ``tick``, all null while it waits.

    A tick before the last one, or a record that its own rules refuse, gives a code instead.
    """
    s, a, d = F.col("status"), F.struct(*_STATE), definition
    over = F.when(_can_recover(a, tick, d), "RecoveryPlanned").otherwise("RecoveryExhausted")
    kind = (
        F.when(tick < F.col("tick"), None).when((s == "Running") & (tick >= F.col("until")), "FaultObserved").when(s.isin("Pending", "Ready") & (tick >= d.deadline), "RecoveryExhausted")
        .when(s == "Pending", "Started").when((s == "Ready") & (tick >= F.col("restart")), "Restarted").when((s == "Faulted") & F.lit(d.reconciles), "ReconciliationRequired").when(s.isin("Faulted", "Reconciled"), over)
    )
    generation = F.when(kind.isin("Started", "Restarted"), F.col("generation") + 1).when(kind.isNotNull(), F.col("generation"))
    detail = F.when(kind == "FaultObserved", "Timeout").when(kind == "RecoveryPlanned", _resume(a, d))
    rows = projected.withColumns({"next_kind": kind, "next_generation": generation, "next_detail": detail})
    told = propose(rows, d, F.col("next_kind"), F.col("next_generation"), tick, F.col("next_detail"), _long(0))
    code = F.when(tick < F.col("tick"), "InvalidOrder").when(F.col("next_kind").isNotNull(), F.col("proposed_code"))
    out = told.withColumn("next_code", code).drop("proposed_code", "proposed_status")
    return out.withColumns({c: F.when(F.col("next_code").isNull(), F.col(c)) for c in ("next_kind", "next_generation", "next_detail")})


def interrupted(projected: DataFrame, key: str, definition: Definition, tick: Column) -> DataFrame:
    """(key, sequence, generation, tick, kind, detail, code): the fault that a restored supervisor records, after fencing, for each task whose history ends running."""
    rows = propose(projected.where("status = 'Running'"), definition, F.lit("FaultObserved"), F.col("generation"), tick, F.lit("SupervisorInterrupted"), _long(0))
    return rows.select(key, F.col("next_sequence").alias("sequence"), "generation", tick.alias("tick"), F.lit("FaultObserved").alias("kind"), F.lit("SupervisorInterrupted").alias("detail"), F.col("proposed_code").alias("code"))


def control_record(projected: DataFrame, definition: Definition, command: Column, tick: Column) -> DataFrame:
    """``projected`` (from ``project_records``) with record: what a control call leads to at ``tick``, or null.

    submit begins an empty task; advance makes the transition that is next;
    poll finds a running task over its deadline; reconcile asks for evidence of
    a faulted task whose effects need it; import_checkpoint takes a migrated
    checkpoint before the start. Only the transitions; running a task's code is
    not this engine's.
    """
    s, d = F.col("status"), definition
    told = next_transition(projected.withColumn("__command", command), d, tick)
    kind = (
        F.when((F.col("__command") == "submit") & (s == "Empty"), "IntentCommitted").when((F.col("__command") == "poll") & (s == "Running") & (tick >= F.col("until")), "FaultObserved")
        .when((F.col("__command") == "reconcile") & (s == "Faulted") & F.lit(d.reconciles), "ReconciliationRequired").when((F.col("__command") == "import_checkpoint") & (s == "Pending") & F.col("checkpoint").isNull(), "CheckpointMigrated")
        .when((F.col("__command") == "advance") & (s != "Empty"), F.col("next_kind"))
    )
    return told.withColumn("record", kind).drop("__command", "next_kind", "next_generation", "next_detail", "next_code")


def drive_once(projected: DataFrame, definition: Definition, authorizations: DataFrame, key: str, tick: Column) -> DataFrame:
    """(key, record, generation): one transition of each task that is authorized and has one to make at ``tick``."""
    told = next_transition(projected, definition, tick).join(authorizations.select(key).distinct(), key, "left_semi")
    # an expression that isn't deterministic keeps the filter from being copied into the fold below
    made = told.select(key, F.when(F.monotonically_increasing_id() >= 0, F.struct(F.col("next_kind").alias("record"), F.col("next_generation").alias("generation"))).alias("x"))
    return made.where("x.record is not null").select(key, "x.record", "x.generation")
