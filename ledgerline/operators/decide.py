"""The whole decision function of linear sagas as one expression over a state and an event, for single rows and as the step of a replay.

A state is a struct (status, step, attempt, due, active, issued, comp), null
before the start; an event a struct (kind, action, next, result, at, deadline,
resolution, pinned). Kinds are Started, ActionResult, RetryTimerScheduled,
RetryTimerFired and ManualResolution; results S, R, T, U: succeeded, retryable
failure, terminal failure, unknown.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.operators.logs import first_failing

STATE = "struct<status:string,step:int,attempt:int,due:bigint,active:string,issued:array<string>,comp:array<int>>"
EVENT = ("kind", "action", "next", "result", "at", "deadline", "resolution", "pinned")


@dataclass(frozen=True)
class Step:
    """A step's attempts, its retry backoff (base, most) or None, and its compensation's attempts or None."""

    attempts: int = 2
    backoff: tuple[int, int] | None = None
    compensation: int | None = None


def _of(values: list, kind: str, at: Column) -> Column:
    """The value at a place of a literal list; null beyond it."""
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), at)


def _due(state: Column, event: Column, steps: tuple[Step, ...]) -> Column:
    base, most = (_of([s.backoff[i] if s.backoff else None for s in steps], "bigint", state["step"]) for i in (0, 1))
    shifted = F.call_function("shiftleft", base, state["attempt"])
    return event["at"] + F.when((state["attempt"] >= 64) | (shifted < 0) | (shifted > most), most).otherwise(shifted)


def last_compensable(state: Column) -> Column:
    """The step whose compensation comes next: the last one recorded, null if there is none."""
    return F.get(state["comp"], F.size(state["comp"]) - 1)


def move_of(state: Column, event: Column, steps: tuple[Step, ...]) -> Column:
    """What an event that passes the guards does: start, next, complete, retry, compensate, escalate, pop, compensated, comp_retry, timer, fire, resume, cancel or stay."""
    result, again = event["result"], state["attempt"] + 1
    back = F.when(F.size(state["comp"]) > 0, "compensate").otherwise("escalate")
    forward = (
        F.when(result == "S", F.when(state["step"] + 1 == len(steps), "complete").otherwise("next"))
        .when(result == "R", F.when(again >= _of([s.attempts for s in steps], "int", state["step"]), back).otherwise("retry"))
        .when(result == "T", back).otherwise("escalate")
    )
    undo = (
        F.when(result == "S", F.when(F.size(state["comp"]) <= 1, "compensated").otherwise("pop"))
        .when((result == "R") & (again < _of([s.compensation for s in steps], "int", last_compensable(state))), "comp_retry").otherwise("escalate")
    )
    late = F.coalesce(_due(state, event, steps) > event["deadline"], F.lit(False))
    manual = F.when(event["resolution"] == "RetryAction", "resume").when(event["resolution"] == "Compensate", F.when(F.size(state["comp"]) > 0, "compensate").otherwise("cancel")).when(event["resolution"] == "Cancel", "cancel").otherwise("stay")
    return (
        F.when(event["kind"] == "Started", "start").when(event["kind"] == "ActionResult", F.when(state["status"] == "Running", forward).otherwise(undo))
        .when(event["kind"] == "RetryTimerScheduled", F.when(late, back).otherwise("timer")).when(event["kind"] == "RetryTimerFired", "fire").otherwise(manual)
    )


def fresh_code(needed: Column, state: Column, event: Column) -> Column:
    """Why an action id can't be issued where one is needed: it is missing, or was issued before; else null."""
    return F.when(needed & event["next"].isNull(), "MissingNextAction").when(needed & F.array_contains(state["issued"], event["next"]), "ReusedActionId")


def guard_code(state: Column, event: Column, steps: tuple[Step, ...], move: Column) -> Column:
    """The first rule that an event breaks, or null."""
    kind, none = event["kind"], state["status"].isNull()
    timed = kind.isin("RetryTimerScheduled", "RetryTimerFired")
    acts = kind.isin("ActionResult", "RetryTimerScheduled")
    waits, asked = kind == "RetryTimerScheduled", kind == "RetryTimerFired"
    other = ~state["active"].eqNullSafe(event["action"])
    backoff = _of([s.backoff is not None for s in steps], "boolean", state["step"])
    attempts = _of([s.attempts for s in steps], "int", state["step"])
    needs = move.isin("next", "retry", "compensate", "pop", "comp_retry", "timer", "fire", "resume")
    return F.coalesce(
        first_failing(
            ("DuplicateStart", (kind == "Started") & ~none), ("DefinitionMismatch", (kind == "Started") & ~event["pinned"]), ("MissingStart", (kind != "Started") & none),
            ("TerminalProjection", (kind == "ActionResult") & ~state["status"].isin("Running", "Compensating")), ("TerminalProjection", timed & (state["status"] != "Running")),
            ("ManualResolutionRequiresEscalation", (kind == "ManualResolution") & (state["status"] != "Escalated")),
            ("UnexpectedAction", acts & other), ("RetryTimerMustFire", acts & state["due"].isNotNull()), ("UnexpectedRetryTimer", asked & (other | state["due"].isNull())),
            ("RetryTimerFiredEarly", asked & (event["at"] < state["due"])), ("RetryTimerRequiresRetryableFailure", waits & (event["result"] != "R")),
            ("RetryTimerNotConfigured", waits & ~backoff), ("RetryTimerNotRequired", waits & (state["attempt"] + 1 >= attempts)), ("RetryTimerRequired", (move == "retry") & backoff),
        ),
        fresh_code(needs, state, event),
    )


def after(state: Column, event: Column, steps: tuple[Step, ...], move: Column, keep_issued: Column) -> Column:
    """The state after a move. Terminal states have no active action and keep attempt and due. An id is remembered where ``keep_issued`` holds."""
    starts, ends = move == "start", move.isin("complete", "escalate", "compensated", "cancel")
    comp = F.when(starts, F.array().cast("array<int>")).when(move.isin("pop", "compensated"), F.slice(state["comp"], 1, F.greatest(F.size(state["comp"]) - 1, F.lit(0))))
    plan = _of([s.compensation for s in steps], "int", state["step"])
    comp = comp.when(move.isin("next", "complete") & plan.isNotNull(), F.array_append(state["comp"], state["step"])).otherwise(state["comp"])
    status = F.when(move.isin("start", "next", "retry", "timer", "fire", "resume"), "Running").when(move.isin("compensate", "pop", "comp_retry"), "Compensating")
    status = status.when(move == "complete", "Completed").when(move == "escalate", "Escalated").when(move == "compensated", "Compensated").when(move == "cancel", "Cancelled").otherwise(state["status"])
    issued = F.when(starts, F.array(event["next"])).when(~ends & (move != "stay") & keep_issued, F.array_append(state["issued"], event["next"])).otherwise(state["issued"])
    return F.struct(
        status.alias("status"), F.when(starts, 0).when(move.isin("next", "complete"), state["step"] + 1).otherwise(state["step"]).alias("step"),
        F.when(move.isin("start", "next", "compensate", "pop"), 0).when(move.isin("retry", "comp_retry", "timer"), state["attempt"] + 1).otherwise(state["attempt"]).alias("attempt"),
        F.when(move == "timer", _due(state, event, steps)).when(starts | (move == "fire"), F.lit(None)).otherwise(state["due"]).alias("due"),
        F.when(ends, F.lit(None)).when(move == "stay", state["active"]).otherwise(event["next"]).alias("active"), issued.alias("issued"), comp.alias("comp"),
    ).cast(STATE)


def decide(state: Column, event: Column, steps: tuple[Step, ...]) -> tuple[Column, Column]:
    """(code, state after) of one event; the state is null where a code refuses it."""
    move = move_of(state, event, steps)
    code = guard_code(state, event, steps, move)
    return code, F.when(code.isNull(), after(state, event, steps, move, F.lit(True)))


def to_event(kind: Column) -> Column:
    """The kind of the immutable event that an input becomes; all its other fields stay."""
    return F.when(kind == "Start", "Started").when(kind == "ActionResult", "ActionResultObserved").when(kind == "ManualResolution", "ManualResolutionApplied").otherwise(kind)


def replay_events(log: DataFrame, keys: list[str], order: list[str], steps: tuple[Step, ...], input_id: str = "input_id", sequence: str | None = None) -> DataFrame:
    """(keys, n_events, n_applied, status, step, attempt, due, active, n_compensable, code) of each process after its whole log; the first refused event ends the fold.

    ``log`` has the event's columns, an input id, whose second use is a
    DuplicateInput, and, if ``sequence`` names one, a sequence: a log whose
    sequences aren't 0 to n - 1 in its order is an InvalidEventSequence before
    any event is looked at. A log without a start ends as MissingStart. One
    shuffle on the keys serves the look-ups of repeated ids and the fold; the
    fold remembers only issued ids that occur again in the log.
    """
    mine = W.partitionBy(*keys, input_id).orderBy(*order)
    again = F.col("next").isNotNull() & (F.count("*").over(W.partitionBy(*keys, "next")) > 1)
    rows = log.repartition(*keys).withColumn("__dup", F.row_number().over(mine) > 1).withColumn("__again", again)
    event = F.struct(*order, *EVENT, F.col("__dup").alias("dup"), F.col("__again").alias("again"), *([F.col(sequence).cast("long").alias("__seq")] if sequence else []))
    logs = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(event)).alias("log"))
    nothing = F.lit(None).cast(STATE)
    start = F.struct(nothing.alias("s"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("code"))

    def step(a, e):
        move = move_of(a["s"], e, steps)
        code = F.coalesce(F.when(e["dup"], "DuplicateInput"), guard_code(a["s"], e, steps, move))
        moved = F.struct(after(a["s"], e, steps, move, e["again"] | (e["kind"] == "Started")).alias("s"), (a["n"] + 1).alias("n"), F.lit(None).cast("string").alias("code"))
        return F.when(a["code"].isNotNull(), a).when(code.isNotNull(), F.struct(a["s"].alias("s"), a["n"].alias("n"), code.alias("code"))).otherwise(moved)

    done = logs.select(*keys, F.size("log").cast("long").alias("n_events"), F.aggregate("log", start, step).alias("x"), *([F.exists(F.transform("log", lambda x, i: x["__seq"] != i), lambda x: x).alias("gap")] if sequence else []))
    gap = F.col("gap") if sequence else F.lit(False)
    s = F.when(~gap, F.col("x.s"))
    code = F.when(gap, "InvalidEventSequence").otherwise(F.coalesce("x.code", F.when(F.col("x.s.status").isNull(), "MissingStart")))
    return done.select(
        *keys, "n_events", F.when(gap, 0).otherwise(F.col("x.n")).cast("long").alias("n_applied"), s["status"].alias("status"), s["step"].alias("step"), s["attempt"].alias("attempt"),
        s["due"].alias("due"), s["active"].alias("active"), F.size(F.coalesce(s["comp"], F.array().cast("array<int>"))).alias("n_compensable"), code.alias("code"),
    )
