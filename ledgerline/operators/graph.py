"""Graph sagas: one step of the walk as an expression, and the replay of whole logs.

A state is a struct (status, step, visit, active, issued), null before the
start; an event a struct (kind, action, next, result) with kinds Started and
ActionResult and results S, R, T, U.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.operators.logs import LOG, first_failing

STATE = "struct<status:string,step:string,visit:int,active:string,issued:array<string>>"
#: Stands for the end in the map of edges.
END = "!"


def transition_outcome(result: Column) -> Column:
    """The label of the edge that a result takes; an unknown one has the terminal failure's, though it is never walked."""
    return F.when(result.isin("S", "R"), result).otherwise("T")


def _edge(edges: dict[tuple[str, str], str | None], step: Column, result: Column) -> Column:
    pairs = [F.lit(x) for (s, o), t in edges.items() for x in (f"{s}|{o}", t or END)]
    return F.try_element_at(F.create_map(*pairs), F.concat(step, F.lit("|"), transition_outcome(result)))


def new_action_code(issued: Column, action: Column) -> Column:
    """Why an action id can't be issued, or null."""
    return F.when(action.isNull(), "ActionIdentityMismatch").when(F.array_contains(issued, action), "DuplicateActionId")


def start(entry: str, action: Column) -> Column:
    """The state after the start."""
    return F.struct(F.lit("Running").alias("status"), F.lit(entry).alias("step"), F.lit(1).alias("visit"), action.alias("active"), F.array(action).alias("issued")).cast(STATE)


def decide(state: Column, event: Column, edges: dict[tuple[str, str], str | None], entry: str, visits: int, keep_issued: Column | None = None) -> tuple[Column, Column]:
    """(code, state after) of one event; the state after is only meant where the code is null."""
    begins, none, next_id, unknown = event["kind"] == "Started", state["status"].isNull(), event["next"], event["result"] == "U"
    to = _edge(edges, state["step"], event["result"])
    walks = ~unknown & to.isNotNull() & (to != END)
    code = F.coalesce(
        first_failing(
            ("AlreadyStarted", begins != none), ("NotRunning", ~begins & (state["status"] != "Running")), ("ActionMismatch", ~begins & ~state["active"].eqNullSafe(event["action"])),
            ("ActionIdentityMismatch", ~begins & unknown & next_id.isNotNull()), ("MissingTransition", ~begins & ~unknown & to.isNull()),
        ),
        F.when(~begins & walks, new_action_code(state["issued"], next_id)),
        first_failing(("VisitLimitExceeded", ~begins & walks & (state["visit"] + 1 > visits)), ("ActionIdentityMismatch", ~begins & (to == END) & next_id.isNotNull())),
    )
    keep = F.lit(True) if keep_issued is None else keep_issued
    moved = F.struct(
        F.when(walks, "Running").when(~unknown & (event["result"] == "S"), "Completed").otherwise("Escalated").alias("status"),
        F.when(walks, to).when(unknown, state["step"]).alias("step"), F.when(walks, state["visit"] + 1).otherwise(state["visit"]).alias("visit"),
        F.when(walks, next_id).alias("active"), F.when(walks & keep, F.array_append(state["issued"], next_id)).otherwise(state["issued"]).alias("issued"),
    ).cast(STATE)
    return code, F.when(begins, start(entry, next_id)).otherwise(moved)


def replay_ordered(log: DataFrame, keys: list[str], order: list[str], edges: dict[tuple[str, str], str | None], entry: str, visits: int, input_id: str = "input_id", sequence: str | None = "sequence", limit: int = LOG) -> DataFrame:
    """(keys, n_events, n_applied, status, step, visit, active, code) of each process after its whole log; the first refused event ends the fold.

    Before any event is looked at, a log of more than ``limit`` events is a
    ReplayLimitExceeded, and one whose sequences aren't 0 to n - 1 in its order
    a SequenceMismatch. The second use of an input id is a DuplicateInput; a
    log without events doesn't occur here.
    """
    again = F.col("next").isNotNull() & (F.count("*").over(W.partitionBy(*keys, "next")) > 1)
    rows = log.repartition(*keys).withColumn("__dup", F.row_number().over(W.partitionBy(*keys, input_id).orderBy(*order)) > 1).withColumn("__again", again)
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    rows = rows.withColumn("__gap", F.col(sequence) != place if sequence else F.lit(False)).withColumn("__place", place)
    # what lies beyond the limit is counted, not kept
    event = F.when(F.col("__place") < limit, F.struct(*order, "kind", "action", "next", "result", F.col("__dup").alias("dup"), F.col("__again").alias("again")))
    logs = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(event)).alias("log"), F.count("*").alias("n_events"), F.max("__gap").alias("gap"))
    first = F.struct(F.lit(None).cast(STATE).alias("s"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("code"))

    def step(a, e):
        code, moved = decide(a["s"], e, edges, entry, visits, e["again"])
        code = F.coalesce(F.when(e["dup"], "DuplicateInput"), code)
        return F.when(a["code"].isNotNull(), a).when(code.isNotNull(), F.struct(a["s"].alias("s"), a["n"].alias("n"), code.alias("code"))).otherwise(F.struct(moved.alias("s"), (a["n"] + 1).alias("n"), F.lit(None).cast("string").alias("code")))

    shut = F.when(F.col("n_events") > limit, "ReplayLimitExceeded").when(F.col("gap"), "SequenceMismatch")
    done = logs.select(*keys, "n_events", shut.alias("shut"), F.when(shut.isNull(), F.aggregate("log", first, step)).alias("x"))
    return done.select(*keys, "n_events", F.coalesce("x.n", F.lit(0)).cast("long").alias("n_applied"), "x.s.status", "x.s.step", "x.s.visit", "x.s.active", F.coalesce("shut", "x.code").alias("code"))


def observed_kinds(kind: Column, result: Column) -> Column:
    """Outcome kinds that a graph event itself gives, in order."""
    second = F.when(kind == "Started", "Started").when(result == "S", "ActionSucceeded").when(result == "U", "ActionOutcomeUnknown").otherwise("ActionFailed")
    return F.array(F.lit("InputAccepted"), second)


def planned_kinds(status: Column, next_action: Column) -> Column:
    """Outcome kinds that a graph decision adds, in order."""
    return F.when(next_action.isNotNull(), F.array(F.lit("ActionPlanned"))).when(status.isin("Running", "Compensating"), F.array().cast("array<string>")).otherwise(F.array(status))


def action_for(step: Column, visit: Column) -> tuple[Column, Column]:
    """(step, attempt) of the action that a running walk waits for; a visit is an attempt."""
    return step, visit - 1
