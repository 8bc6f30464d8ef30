"""Rewindable timelines: lineage resolution, replay, corrections, effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.operators.folds import fold_log
from ledgerline.operators.logs import first_failing
from ledgerline.sources.tables import checkpointed

MODULUS, FACTOR = 1_000_003, 3


def replay_states(inputs: DataFrame, timeline: str, step: str, payload: str) -> DataFrame:
    """(timeline, head, state): each timeline's final state under S' = (3 S + input) mod 1000003."""
    ordered = F.array_sort(F.collect_list(F.struct(step, payload)))
    state = F.aggregate(ordered, F.lit(0).cast("long"), lambda s, x: F.pmod(s * FACTOR + x[payload], F.lit(MODULUS)))
    return inputs.groupBy(timeline).agg(F.max(step).alias("head"), state.alias("state"))


def corrected(inputs: DataFrame, corrections: DataFrame, timeline: str, step: str, payload: str) -> DataFrame:
    """Inputs with their replacements put in."""
    return inputs.join(corrections.withColumnRenamed(payload, "__new"), [timeline, step], "left").select(timeline, step, F.coalesce("__new", payload).alias(payload))


def correction_plan(heads: DataFrame, corrections: DataFrame, inputs: DataFrame, timeline: str, key: list[str], max_replay: int, max_retained: int) -> DataFrame:
    """(timeline, key, corrected_step, n_replayed, code): the range that a correction replays, or the first reason why it can't.

    heads: (timeline, scope, branch, revision, head, finalized). corrections:
    (timeline, key, expected_revision, anchor: struct(scope, branch, step),
    replacement: struct(scope, branch, step, identity, revision) or null for a
    correction of the state). inputs: (timeline, scope, branch, step, identity,
    revision), the retained records. Only corrections that pass the rules
    about heads and lengths meet the inputs of their range, at most
    ``max_replay`` steps each.
    """
    both = corrections.join(heads, timeline)
    a, r, head = F.col("anchor"), F.col("replacement"), F.col("head")
    swaps = r.isNotNull()
    first = first_failing(
        ("Conflict", F.col("revision") != F.col("expected_revision")),
        ("ScopeMismatch", a["scope"] != F.col("scope")), ("Conflict", a["branch"] != F.col("branch")), ("FutureCorrection", a["step"] > head),
        ("ScopeMismatch", swaps & (r["scope"] != F.col("scope"))), ("Conflict", swaps & (r["branch"] != F.col("branch"))),
        ("HistoryUnavailable", swaps & (r["step"] != a["step"] + 1)), ("FutureCorrection", swaps & (r["step"] > head)),
        ("ReconciliationRequired", F.coalesce(F.when(swaps, r["step"]).otherwise(a["step"]) <= F.col("finalized"), F.lit(False))),
        ("Capacity", head - a["step"] > max_replay),
    )
    judged = both.withColumn("code", first)
    ranged = judged.where("code is null").select(timeline, *key, "anchor", "replacement", "head", F.col("scope").alias("want_scope"), F.col("branch").alias("want_branch"))
    met = ranged.join(inputs, timeline).where((F.col("step") > a["step"]) & (F.col("step") <= head))
    pos = F.row_number().over(W.partitionBy(timeline, *key).orderBy("step", "identity", "revision"))
    placed = met.withColumn("pos", pos)
    bad = first_failing(("ScopeMismatch", F.col("scope") != F.col("want_scope")), ("Conflict", F.col("branch") != F.col("want_branch")), ("HistoryUnavailable", F.col("step") != a["step"] + F.col("pos")))
    told = placed.withColumn("bad", bad).groupBy(timeline, *key).agg(
        F.count("*").alias("supplied"), F.min_by("bad", F.when(F.col("bad").isNotNull(), F.col("pos"))).alias("bad"),
        F.min_by(F.struct("identity", "revision"), "pos").alias("original"),
    )
    supplied = F.coalesce("supplied", F.lit(0))
    rest = first_failing(
        ("Capacity", supplied > max_retained), ("HistoryUnavailable", supplied != head - a["step"]), ("ScopeMismatch", F.col("bad") == "ScopeMismatch"), ("Conflict", F.col("bad") == "Conflict"), ("HistoryUnavailable", F.col("bad") == "HistoryUnavailable"),
        ("InputMismatch", swaps & ((r["identity"] != F.col("original.identity")) | (r["revision"] <= F.col("original.revision")))),
    )
    out = judged.join(told, [timeline, *key], "left").withColumn("code", F.coalesce("code", rest))
    ok = F.col("code").isNull()
    return out.select(timeline, *key, F.when(ok, F.coalesce(r["step"], a["step"])).alias("corrected_step"), F.when(ok, head - a["step"]).alias("n_replayed"), "code")


def replay_inputs(plans: DataFrame, corrections: DataFrame, inputs: DataFrame, timeline: str, key: list[str]) -> DataFrame:
    """(timeline, key, offset, step, digest): what each accepted plan replays, the replacement standing at offset 0 in place of the original.

    corrections and inputs are as in ``correction_plan``, with a digest in replacement and inputs.
    """
    good = plans.where("code is null").select(timeline, *key, "n_replayed").join(corrections, [timeline, *key])
    a = F.col("anchor.step")
    met = good.join(inputs.select(timeline, "step", F.col("digest").alias("__d")), timeline).where((F.col("step") > a) & (F.col("step") <= a + F.col("n_replayed")))
    offset = F.col("step") - a - 1
    return met.select(timeline, *key, offset.alias("offset"), "step", F.when((offset == 0) & F.col("replacement").isNotNull(), F.col("replacement.digest")).otherwise(F.col("__d")).alias("digest"))


def append_gate(inputs: DataFrame, timeline: str, order: list[str], scope: str, branch: str, step: str, revision: str) -> DataFrame:
    """Each input in order with its code: it must expect the head's revision (Conflict), have its scope (ScopeMismatch) and branch (Conflict), and the step after it (InputMismatch).

    The first input sets scope and branch of the empty head; an accepted one
    moves step and revision by one, a refused one changes nothing.
    """

    def gate(head, sc, br, st, rev):
        if not head:
            head.update(scope=sc, branch=br, step=0, revision=0)
        if rev != head["revision"]:
            return ("Conflict",)
        if sc != head["scope"]:
            return ("ScopeMismatch",)
        if br != head["branch"]:
            return ("Conflict",)
        if st != head["step"] + 1:
            return ("InputMismatch",)
        head["step"] += 1
        head["revision"] += 1
        return (None,)

    return fold_log(inputs, [timeline], order, [scope, branch, step, revision], dict, gate, "code string")


def observe_gate(marks: DataFrame, timeline: str, order: list[str], authority: str, epoch: str, sequence: str, step: str, head: str) -> DataFrame:
    """Each authority mark with its code: a step beyond the head is a FutureCorrection, another authority than the first accepted one's, or (epoch, sequence) not beyond the last accepted, a StaleAuthority.

    What is accepted needs no fold: a stale mark of the same authority never
    exceeds the marks before it, so their greatest is the last accepted one.
    """
    w = W.partitionBy(timeline).orderBy(*order)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    within = F.col(step) <= F.col(head)
    first = F.first(F.when(within, F.col(authority)), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    told = marks.withColumn("__first", first)
    mark = F.struct(F.col(epoch).alias("e"), F.col(sequence).alias("s"))
    last = F.max(F.when(within & (F.col(authority) == F.col("__first")), mark)).over(before)
    return told.withColumn("code", first_failing(("FutureCorrection", ~within), ("StaleAuthority", F.col(authority) != F.col("__first")), ("StaleAuthority", mark <= last))).drop("__first")


def _ancestors(front: DataFrame, lineage: DataFrame, goes_up: Column, hits: DataFrame, floor_ok: Column) -> DataFrame:
    """(branch, step, found_in, value): ``front`` (branch, step) answered by the nearest branch with a hit, walking up the lineage.

    ``lineage`` has (at, parent, admitted_through, ...); a step beyond a
    branch's admitted_through isn't there, and only where ``goes_up`` holds is
    its parent asked. Each level is one join and is cut off from the plan
    before; the walk ends when no row is left. A lineage that goes in a circle
    is an error, found after as many levels as it has branches.
    """
    front = front.where(floor_ok).select("branch", "step", F.col("branch").alias("at"))
    found, most = None, None
    for depth in range(1 << 30):
        here = checkpointed(front.join(lineage, "at").where("step <= admitted_through").join(hits, ["at", "step"], "left"))
        own = here.where("hit").select("branch", "step", F.col("at").alias("found_in"), "value")
        found = own if found is None else found.unionByName(own)
        front = here.where(F.col("hit").isNull() & goes_up & F.col("parent").isNotNull()).select("branch", "step", F.col("parent").alias("at"))
        if front.isEmpty():
            return found
        if depth == 30:
            most = lineage.count()
        if most is not None and depth > most:
            raise ValueError("the lineage goes in a circle")
    raise AssertionError


def _hits(entries: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """(at, step, value, hit): a branch's own entries, and its overrides where it has none."""
    own = entries.select(F.col("branch").alias("at"), "step", "value")
    if overrides is not None:
        own = own.unionByName(overrides.select(F.col("branch").alias("at"), "step", "value").join(own, ["at", "step"], "left_anti"))
    return own.withColumn("hit", F.lit(True))


def resolve(lineage: DataFrame, entries: DataFrame, wanted: DataFrame, overrides: DataFrame | None = None, floor: int = 0) -> DataFrame:
    """(branch, step, found_in, value): each wanted step from the nearest branch that has it, own first, then its override, then by inheritance.

    lineage has (branch, parent, inherited_through, admitted_through); a step
    beyond inherited_through isn't looked for in the parent. entries and
    overrides are (branch, step, value). Steps up to ``floor``, or beyond the
    admitted_through of a branch on the way, aren't found. Ancestry of any
    depth is walked to its end.
    """
    tree = lineage.select(F.col("branch").alias("at"), "parent", "inherited_through", "admitted_through")
    return _ancestors(wanted, tree, F.col("step") <= F.col("inherited_through"), _hits(entries, overrides), F.col("step") > floor)


def eligible_effects(effects: DataFrame, timeline: str, step: str, frontier: Column) -> DataFrame:
    """Effects whose origin is final."""
    return effects.where(F.col(step) <= frontier)


def handoff(effects: DataFrame, timeline: str, step: str, identity: str, most: int) -> DataFrame:
    """The first ``most`` eligible effects of each timeline by (step, identity)."""
    return effects.withColumn("rn", F.row_number().over(W.partitionBy(timeline).orderBy(step, identity))).where(F.col("rn") <= most)


def promote(old: DataFrame, new: DataFrame, step: str, replace_from: Column) -> DataFrame:
    """Staged effects after a promotion: old ones before ``replace_from``, and the candidate's."""
    return old.where(F.col(step) < replace_from).unionByName(new)


def head_code(head: Column, finalized: Column) -> Column:
    """FutureCorrection for a head whose finalized step is beyond it, else null."""
    return F.when(finalized > head, "FutureCorrection")


def finalize_gate(marks: DataFrame, timeline: str, order: list[str], frontier: str, head: Column) -> DataFrame:
    """Each frontier mark with whether it is within the head and beyond the last mark that was; a refused one moves nothing."""
    before = F.max(F.when(F.col(frontier) <= head, F.col(frontier))).over(W.partitionBy(timeline).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return marks.withColumn("advances", (before.isNull() | (F.col(frontier) > before)) & (F.col(frontier) <= head))


def control(events: DataFrame, timeline: str, order: list[str], slots: int) -> DataFrame:
    """Each control event (kind, branch) in order with its verdict.

    append moves the head; reserve takes a free slot for a branch id never used
    before; promote needs a reservation made at the present head and moves it;
    abort frees the slot.
    """
    rows = events.select(timeline, *order, "kind", F.col("branch").cast("string").alias("__b"))

    def step(a, kind, b):
        live = a["live"]
        if kind == "append":
            a["rev"] += 1
            return ("appended",)
        if kind == "reserve":
            if b in a["used"]:
                return ("Conflict",)
            if len(live) >= slots:
                return ("Capacity",)
            live[b] = a["rev"]
            a["used"].add(b)
            return ("reserved",)
        if b not in live:
            return ("SessionUnavailable",)
        if kind != "abort" and live[b] != a["rev"]:
            return ("Conflict",)
        del live[b]
        if kind == "abort":
            return ("aborted",)
        a["rev"] += 1
        return ("promoted",)

    told = fold_log(rows, [timeline], order, ["kind", "__b"], lambda: {"rev": 0, "live": {}, "used": set()}, step, "verdict string")
    return told.select(timeline, *order, "kind", "verdict")


def resolve_anchors(lineage: DataFrame, anchors: DataFrame, wanted: DataFrame, floor: int, overrides: DataFrame | None = None) -> DataFrame:
    """(branch, step, found_in, value): the anchor at exactly that step, own first, then the branch's override, then the parent's below state_changed_from.

    lineage has (branch, parent, admitted_through, state_changed_from). Steps
    below ``floor`` or beyond the admitted_through of a branch on the way aren't found.
    """
    tree = lineage.select(F.col("branch").alias("at"), "parent", "admitted_through", "state_changed_from")
    return _ancestors(wanted, tree, F.col("step") < F.col("state_changed_from"), _hits(anchors, overrides), F.col("step") >= floor)


def anchor_codes(anchors: DataFrame, key: list[str], intact: Column) -> DataFrame:
    """(key, n, code): a damaged anchor is an InputMismatch, a second canonical one at a step a Conflict."""
    return anchors.groupBy(*key).agg(F.count("*").alias("n"), F.when(F.count_if(~intact) > 0, "InputMismatch").when(F.count("*") > 1, "Conflict").alias("code"))


def fork(lineage: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (branch, parent, step, replaces) with their code and the lineage row that a null code makes.

    A branch id already used is a Conflict, an unknown parent
    HistoryUnavailable, a corrected step beyond what the parent admits a
    FutureCorrection. The new branch inherits and admits all that its parent
    admits, its states differ from the corrected step on, and it has one
    override there: of the input where the request ``replaces`` one, else of
    the state.
    """
    used = lineage.select("branch", F.lit(True).alias("__used"))
    parents = lineage.select(F.col("branch").alias("parent"), F.col("admitted_through").alias("__to"))
    code = F.when(F.col("__used"), "Conflict").when(F.col("__to").isNull(), "HistoryUnavailable").when(F.col("step") > F.col("__to"), "FutureCorrection")
    made = lambda c: F.when(F.col("code").isNull(), c)
    told = requests.join(used, "branch", "left").join(parents, "parent", "left").withColumn("code", code)
    return told.select(
        "branch", "parent", "step", "code", made(F.col("__to")).alias("inherited_through"), made(F.col("__to")).alias("admitted_through"), made(F.col("step")).alias("state_changed_from"),
        made(F.when(F.col("replaces"), F.col("step"))).alias("input_override"), made(F.when(~F.col("replaces"), F.col("step"))).alias("state_override"))


def materialize_branch(lineage: DataFrame, entries: DataFrame, heads: DataFrame, floor: int) -> DataFrame:
    """(branch, n, complete): each branch's inputs over (floor, head], flattened from its ancestry; ``heads`` is (branch, head)."""
    steps = heads.where(F.col("head") > floor).select("branch", F.explode(F.sequence(F.lit(floor + 1), F.col("head"))).alias("step"))
    got = resolve(lineage, entries, steps, floor=floor).groupBy("branch").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return heads.join(got, "branch", "left").select("branch", n.alias("n"), (n == F.greatest(F.col("head") - floor, F.lit(0))).alias("complete"))


def collect_inputs(inputs: DataFrame, timeline: str, step: str, after: Column, through: Column) -> DataFrame:
    """(timeline, n, contiguous) of the inputs in (after, through]."""
    part = inputs.where((F.col(step) > after) & (F.col(step) <= through))
    return part.groupBy(timeline).agg(F.count("*").alias("n"), (F.max(step) - F.min(step) + 1 == F.count_distinct(step)).alias("contiguous"))


def expire_before(branches: DataFrame, anchors: DataFrame, inputs: DataFrame, floor: int) -> tuple[DataFrame, DataFrame]:
    """Inputs beyond and anchors from the floor on; nothing expires unless every branch has an anchor at the floor.

    Whether a branch blocks it is a scalar subquery of the plan, not a value on the driver.
    """
    blocking = branches.select("branch").join(anchors.where(F.col("step") == floor).select("branch"), "branch", "left_anti").agg(F.count("*") > 0)
    return inputs.where(blocking.scalar() | (F.col("step") > floor)), anchors.where(blocking.scalar() | (F.col("step") >= floor))


def retire_codes(branches: DataFrame, live: DataFrame) -> DataFrame:
    """(branch, code): live branches and ones with children can't be retired (Conflict)."""
    parents = branches.where("parent is not null").select(F.col("parent").alias("branch")).distinct()
    held = parents.unionByName(live.select("branch")).distinct().withColumn("code", F.lit("Conflict"))
    return branches.select("branch").join(held, "branch", "left")


def append_effects(held: DataFrame, new: DataFrame, key: list[str], timeline: str, capacity: int) -> DataFrame:
    """(timeline, n, code) of a live timeline after taking the effects of a step: an identity twice is a mismatch, more than ``capacity`` too many."""
    both = held.select(timeline, *key).unionByName(new.select(timeline, *key))
    return both.groupBy(timeline).agg(F.count("*").alias("n"), F.when(F.count("*") > capacity, "Capacity").when(F.count_distinct(*key) < F.count("*"), "InputMismatch").alias("code"))


def stage_effects(pushes: DataFrame, timeline: str, order: list[str], identity: str, size: str, most: int, most_bytes: int) -> DataFrame:
    """Each push in order with its code: Capacity (count or bytes), InputMismatch (identity staged already), null if staged. A refused push takes no room."""
    rows = pushes.select(timeline, *order, F.col(identity).cast("string").alias("__i"), F.col(size).cast("long").alias("__b"))

    def step(a, i, b):
        if len(a["ids"]) >= most:
            return ("Capacity",)
        if i in a["ids"]:
            return ("InputMismatch",)
        if a["bytes"] + b > most_bytes:
            return ("Capacity",)
        a["ids"].add(i)
        a["bytes"] += b
        return (None,)

    told = fold_log(rows, [timeline], order, ["__i", "__b"], lambda: {"ids": set(), "bytes": 0}, step, "code string")
    return told.select(timeline, *order, "code")


def live_step(states: DataFrame, inputs: DataFrame, timeline: str, step: str, payload: str) -> DataFrame:
    """(timeline, head, state): one more step of each timeline whose next input is there."""
    nxt = inputs.select(timeline, (F.col(step) - 1).alias("head"), F.col(payload).alias("__p"))
    return states.join(nxt, [timeline, "head"]).select(timeline, (F.col("head") + 1).alias("head"), F.pmod(F.col("state") * FACTOR + F.col("__p"), F.lit(MODULUS)).alias("state"))
