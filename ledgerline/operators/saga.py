"""Linear and graph sagas as folds over ordered event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMINAL = ("Completed", "Compensated", "Cancelled", "Escalated")


def _ordered(events: DataFrame, keys: list[str], order: list[str], result: str) -> DataFrame:
    logged = F.array_sort(F.collect_list(F.struct(*order, F.col(result).alias("__r"))))
    return events.groupBy(*keys).agg(F.transform(logged, lambda x: x["__r"]).alias("log"))


def replay_linear(events: DataFrame, keys: list[str], order: list[str], result: str = "result", steps: int = 3, attempts: int = 2, compensable: tuple[int, ...] = ()) -> DataFrame:
    """The state of each process after its whole log: keys, n_events, status, step, attempt, n_compensable.

    Results are S, R, T, U: succeeded, retryable failure, terminal failure,
    unknown. One shuffle on the keys; the fold itself is one aggregate over the
    process's ordered log. This replay is lenient, an extension of this engine:
    it takes results alone and skips what follows a terminal state;
    ``decide.replay_events`` is the whole one.
    """
    can = f"array_contains(array({', '.join(map(str, compensable))}), a.step)" if compensable else "false"
    state = lambda status, step="a.step", att="0", comp="a.comp": f"named_struct('status', {status}, 'step', {step}, 'att', {att}, 'comp', {comp})"
    begin = f"if(size(a.comp) = 0, {state(chr(39) + 'Escalated' + chr(39), att='a.att')}, {state(chr(39) + 'Compensating' + chr(39))})"
    running = f"""case r
        when 'S' then if(a.step = {steps - 1}, {state("'Completed'", str(steps), "a.att", f"if({can}, array_append(a.comp, a.step), a.comp)")},
            {state("'Running'", "a.step + 1", "0", f"if({can}, array_append(a.comp, a.step), a.comp)")})
        when 'R' then if(a.att + 1 >= {attempts}, {begin}, {state("'Running'", att="a.att + 1")})
        when 'T' then {begin}
        else {state("'Escalated'", att="a.att")} end"""
    rest = "slice(a.comp, 1, size(a.comp) - 1)"
    back = f"""case r
        when 'S' then if(size(a.comp) = 1, {state("'Compensated'", att="a.att", comp=rest)}, {state("'Compensating'", comp=rest)})
        when 'R' then if(a.att + 1 >= {attempts}, {state("'Escalated'", att="a.att")}, {state("'Compensating'", att="a.att + 1")})
        else {state("'Escalated'", att="a.att")} end"""
    zero = "named_struct('status', 'Running', 'step', 0, 'att', 0, 'comp', cast(array() as array<int>))"
    fold = f"aggregate(log, {zero}, (a, r) -> case a.status when 'Running' then {running} when 'Compensating' then {back} else a end)"
    out = _ordered(events, keys, order, result).select(*keys, F.size("log").alias("n_events"), F.expr(fold).alias("s"))
    cols = [*keys, F.col("n_events").cast("long").alias("n_events"), F.col("s.status").alias("status"), F.col("s.step").alias("step"), F.col("s.att").alias("attempt"), F.size("s.comp").alias("n_compensable")]
    return out.select(*cols)


def replay_graph(events: DataFrame, keys: list[str], order: list[str], edges: dict[tuple[str, str], str | None], entry: str, visits: int, result: str = "result") -> DataFrame:
    """The state of each process that walks a graph: keys, status, step, visit, error_code.

    ``edges`` maps (step, S/R/T) to the next step, or to None where the edge
    ends: Completed on success, else Escalated. Unknown escalates without an
    edge. ``visits`` bounds all visits together. The map is part of the plan;
    a definition has at most 512 edges.
    """
    pairs = ", ".join(f"'{s}|{o}', {chr(39) + t + chr(39) if t else chr(39) + '!' + chr(39)}" for (s, o), t in edges.items())
    state = lambda status, step="a.step", visit="a.visit", err="null": f"named_struct('status', {status}, 'step', {step}, 'visit', {visit}, 'err', cast({err} as string))"
    to = f"element_at(map({pairs}), concat(a.step, '|', r))"
    fold = f"""aggregate(log, named_struct('status', 'Running', 'step', '{entry}', 'visit', 1, 'err', cast(null as string)), (a, r) -> case
        when a.status <> 'Running' or a.err is not null then a
        when r = 'U' then {state("'Escalated'")}
        when {to} is null then {state("'Running'", err="'MissingTransition'")}
        when {to} = '!' then {state("if(r = 'S', 'Completed', 'Escalated')")}
        when a.visit + 1 > {visits} then {state("'Running'", err="'VisitLimitExceeded'")}
        else {state("'Running'", to, "a.visit + 1")} end)"""
    return _ordered(events, keys, order, result).select(*keys, F.expr(fold).alias("s")).select(*keys, "s.status", "s.step", "s.visit", F.col("s.err").alias("error_code"))


def observed_kinds(event: Column, result: Column) -> Column:
    """Outcome kinds that an event itself gives, in order."""
    second = (
        F.when(event == "Started", "Started").when(event == "RetryTimerScheduled", "ActionFailed").when(event == "RetryTimerFired", "TimerFired").when(event == "ManualResolution", "ManualResolutionApplied")
        .when(result == "S", "ActionSucceeded").when(result == "U", "ActionOutcomeUnknown").otherwise("ActionFailed")
    )
    return F.array(F.lit("InputAccepted"), second)


def planned_kinds(status: Column, next_action: Column, timer_pending: Column) -> Column:
    """Outcome kinds that a decision adds, in order."""
    some = F.when(timer_pending, F.array(F.lit("RetryScheduled"), F.lit("ActionPlanned"))).when(status == "Compensating", F.array(F.lit("CompensationPlanned"))).otherwise(F.array(F.lit("ActionPlanned")))
    end = F.when(status.isin(*TERMINAL), F.array(status)).otherwise(F.array().cast("array<string>"))
    return F.when(next_action.isNotNull(), some).otherwise(end)


def manual_resolution(status: Column, resolution: Column, n_compensable: Column) -> Column:
    """The status after a manual resolution; only escalated processes take one (null otherwise)."""
    return F.when(status == "Escalated", F.when(resolution == "RetryAction", "Running").when((resolution == "Compensate") & (n_compensable > 0), "Compensating").when(resolution.isin("Compensate", "Cancel"), "Cancelled").otherwise("Escalated"))


def action_for(status: Column, step: Column, attempt: Column, n_compensable: Column) -> tuple[Column, Column]:
    """(action, attempt) that a process waits for: its step's, or while compensating the undoing of the last recorded step; null where it has ended."""
    name = F.when(status == "Running", F.concat(F.lit("step-"), step.cast("string"))).when(status == "Compensating", F.concat(F.lit("undo-"), (n_compensable - 1).cast("string")))
    return name, F.when(status.isin("Running", "Compensating"), attempt)


def repeated_actions(issued: DataFrame, process: str, action: str) -> DataFrame:
    """(process, action, n, issued_again): action ids that a process issued, each must be fresh."""
    return issued.groupBy(process, action).agg(F.count("*").alias("n")).withColumn("issued_again", F.col("n") > 1)
