"""The engine's queries over the driver's tables, by the id of the operator they exercise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerline.functions import scalars as S
from ledgerline.operators import correlate as R
from ledgerline.operators import leases as O
from ledgerline.operators import logs as C
from ledgerline.operators import saga as L
from ledgerline.operators import tasks as K
from ledgerline.operators import timeline as M
from ledgerline.sources.tables import millis, read, saga_events

QUERIES: dict = {}
PROCESS = ["user_id", "week"]
ORDER = ["ts", "event_id"]
#: A five-node graph with a loop: (step, outcome) to the next step, None where the edge ends.
EDGES = {("a", "S"): "b", ("a", "R"): "a", ("b", "S"): "c", ("b", "R"): "d", ("b", "T"): None, ("d", "S"): "b", ("c", "S"): "e", ("c", "R"): "c", ("e", "S"): None, ("e", "T"): None}
#: 1 January 1996 in epoch milliseconds.
NOW = 820454400000


def query(f):
    """Register a query under its name."""
    QUERIES[f.__name__] = f
    return f


def lit(x):
    return F.lit(x).cast("long") if isinstance(x, int) else F.lit(x)


@query
def L12_replay_weekly(s: SparkSession, d: str) -> DataFrame:
    return L.replay_linear(saga_events(read(s, d, "events")), PROCESS, ORDER)


@query
def L12_replay_full(s: SparkSession, d: str) -> DataFrame:
    return L.replay_linear(saga_events(read(s, d, "events"), full=True), PROCESS, ORDER, compensable=(0,))


@query
def L11_manual_review(s: SparkSession, d: str) -> DataFrame:
    states = L12_replay_full(s, d)
    how = F.element_at(F.array(*map(F.lit, ("RetryAction", "Compensate", "Cancel", "Escalate"))), (F.col("user_id") % 4 + 1).cast("int"))
    return states.where("status = 'Escalated'").select("user_id", "week", how.alias("resolution"), L.manual_resolution(F.col("status"), how, F.col("n_compensable")).alias("status"))


@query
def L18_observed_kinds(s: SparkSession, d: str) -> DataFrame:
    e = saga_events(read(s, d, "events"), full=True)
    return e.select("event_id", F.array_join(L.observed_kinds(F.lit("ActionResult"), F.col("result")), ",").alias("kinds"))


@query
def L19_planned_kinds(s: SparkSession, d: str) -> DataFrame:
    t = L12_replay_full(s, d)
    nxt = F.when(F.col("status").isin("Running", "Compensating"), F.concat(F.lit("act_"), F.col("n_events").cast("string")))
    return t.select("user_id", "week", F.array_join(L.planned_kinds(F.col("status"), nxt, F.lit(False)), ",").alias("kinds"))


@query
def G5_graph_replay(s: SparkSession, d: str) -> DataFrame:
    return L.replay_graph(saga_events(read(s, d, "events"), full=True), PROCESS, ORDER, EDGES, "a", 8)


@query
def S1_identifier_valid(s: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("tnt_"), "c_name")).otherwise(F.concat(F.lit("tnt_"), F.translate("c_name", "#", "-")))
    return read(s, d, "customer").select("c_custkey", S.valid_identifier(x, "tnt_").alias("valid"))


@query
def S2_digest(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


@query
def S3_retry_due_at(s: SparkSession, d: str) -> DataFrame:
    ordinal = F.col("o_orderkey") % 70
    return read(s, d, "orders").select("o_orderkey", ordinal.alias("ordinal"), S.due_at(millis("o_orderdate"), 1000, 60000, ordinal).alias("due_at"))


@query
def S4_jitter(s: SparkSession, d: str) -> DataFrame:
    seed = F.unhex(F.sha2(F.col("o_orderkey").cast("string"), 256))
    return read(s, d, "orders").select("o_orderkey", S.jitter(seed, F.col("o_orderkey") % 64, 997).alias("jitter"))


def _scope():
    name = F.concat(F.lit("tnt_"), F.col("o_custkey").cast("string"))
    return S.scope_bytes(name, F.concat(F.lit("prc_"), F.col("o_orderkey").cast("string")), F.lit("def_order"), F.lit("ver_1"), F.unhex(F.sha2(F.lit("order"), 256)))


@query
def S6_scope_bytes_hash(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "orders").select("o_orderkey", F.sha2(_scope(), 256).alias("digest"))


@query
def S7_effect_key_hash(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "orders").select("o_orderkey", F.sha2(_effect_key(), 256).alias("digest"))


@query
def S8_definition_digest(s: SparkSession, d: str) -> DataFrame:
    steps = read(s, d, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list("n_name")), lambda x: F.concat(F.lit("stp_"), x)).alias("steps"))
    return steps.select("n_regionkey", F.sha2(S.definition_bytes(F.lit("def_region"), F.lit("ver_1"), F.col("steps")), 256).alias("digest"))


@query
def S12_resource_scope(s: SparkSession, d: str) -> DataFrame:
    a = read(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("r"))
    return a.select("l_orderkey", S.valid_resources(F.col("r")).alias("valid"))


def _effect_key():
    """The bytes of an order's effect key."""
    return S.effect_key_bytes(_scope(), F.concat(F.lit("stp_"), "o_orderpriority"), F.col("o_orderkey") % 64, F.lit(1), F.unhex(F.sha2("o_orderstatus", 256)))


@query
def S17_timer_input_id(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "orders").select("o_orderkey", S.tagged_identity("inp_timer_", b"timer\0", _effect_key(), F.concat(F.lit("act_"), F.col("o_orderkey").cast("string")).cast("binary")).alias("input_id"))


def _outcomes(s, d):
    return read(s, d, "conversations").select("conv_id", "turn", "role", F.sha2(F.coalesce("text", F.lit("")), 256).alias("payload"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))


@query
def C1_commit_validation(s: SparkSession, d: str) -> DataFrame:
    return C.validate_commits(read(s, d, "lineitem"), "l_orderkey", F.lit(1), "l_linenumber", "l_partkey")


@query
def C3_log_contiguity(s: SparkSession, d: str) -> DataFrame:
    return C.contiguity(_outcomes(s, d), "conv_id", "turn", "turn")


@query
def C5_paging(s: SparkSession, d: str) -> DataFrame:
    return C.pages(_outcomes(s, d), "conv_id", "turn", 3)


@query
def C7_verify_batch(s: SparkSession, d: str) -> DataFrame:
    o = _outcomes(s, d)
    return C.missing_rows(o, o.where("turn % 5 <> 4"), ["conv_id", "turn", "payload"])


@query
def C10_head_consistency(s: SparkSession, d: str) -> DataFrame:
    o = _outcomes(s, d)
    heads = o.groupBy("conv_id").agg((F.max("turn") + 1).alias("n")).where("conv_id % 7 <> 3").select("conv_id", F.when(F.col("conv_id") % 5 == 0, F.col("n") + 1).otherwise(F.col("n")).alias("next_sequence"))
    return C.heads_agree(heads, o, "conv_id", "turn")


@query
def C11_quota(s: SparkSession, d: str) -> DataFrame:
    return C.running_quota(_outcomes(s, d), "conv_id", ["turn"], "n_bytes", 400).select("conv_id", "turn", "used", "accepted")


_CONTENT = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


@query
def I1_inbox_accept(s: SparkSession, d: str) -> DataFrame:
    x = read(s, d, "lineitem").select("l_orderkey", "l_linenumber", *_CONTENT, "l_discount", "l_tax", F.lit(0).alias("delivery"))
    again = x.where("l_orderkey % 10 = 0").withColumn("delivery", F.lit(1))
    told = C.accept_inputs(x.unionByName(again), ["l_orderkey", "l_linenumber"], _CONTENT, ["delivery", *_CONTENT, "l_discount", "l_tax"])
    return told.groupBy("l_orderkey", "l_linenumber", "verdict").agg(F.count("*").alias("n"))


@query
def I2_pending(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events").select("user_id", F.concat(F.lit("inp_"), F.col("event_id").cast("string")).alias("input_id"), "event_type")
    return C.pending_inputs(e, e.where("event_type = 'purchase'"), "user_id", "input_id", 5).select("user_id", "input_id", "rn")


@query
def I3_source_dedup(s: SparkSession, d: str) -> DataFrame:
    x = read(s, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count_distinct("l_linenumber").alias("inputs"))
    return x.select("l_orderkey", "l_suppkey", (F.col("inputs") > 1).alias("conflict"))


@query
def I5_payload_store(s: SparkSession, d: str) -> DataFrame:
    return C.store_blobs(read(s, d, "documents").withColumn("text", F.coalesce("text", F.lit(""))), "source", "text")


def _outbox(s, d):
    k = F.col("o_orderkey")
    return read(s, d, "orders").select(F.col("o_orderpriority").alias("scope"), F.concat(F.lit("act_"), k.cast("string")).alias("action_id"), (k % 65).alias("attempt"), (F.col("o_orderstatus") == "F").alias("acknowledged"), F.when(k % 4 != 0, millis("o_orderdate")).alias("expires_at"))


@query
def O1_claim(s: SparkSession, d: str) -> DataFrame:
    return O.claim_outbox(_outbox(s, d), "scope", lit(NOW), 30000)


@query
def O5_expiry(s: SparkSession, d: str) -> DataFrame:
    return _outbox(s, d).where("expires_at is not null").select("action_id", O.expired(F.col("expires_at"), lit(NOW)).alias("expired"))


@query
def O8_funnel(s: SparkSession, d: str) -> DataFrame:
    return O.funnel(_outbox(s, d), "scope", lit(NOW))


@query
def T1_schedule(s: SparkSession, d: str) -> DataFrame:
    r = read(s, d, "lineitem").select("l_orderkey", millis("l_shipdate").alias("due"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    a = read(s, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return O.schedule_timers(r, a, "l_orderkey", "due", ["l_linenumber", "due", "l_partkey", "l_suppkey", "l_extendedprice"]).groupBy("l_orderkey", "verdict").agg(F.count("*").alias("n"))


@query
def T2_due(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    t = read(s, d, "orders").select(F.col("o_orderpriority").alias("scope"), F.concat(F.lit("act_"), k.cast("string")).alias("action_id"), millis("o_orderdate").alias("due_at"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("state"), F.when(k % 4 == 0, lit(NOW + 1)).alias("expires_at"))
    return O.claim_due(t, "scope", lit(NOW), 16)


@query
def R1_correlation(s: SparkSession, d: str) -> DataFrame:
    cmd = read(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    ev = read(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("evidence_id"), (F.col("l_suppkey") % 2).alias("tenant"), F.col("l_linestatus").alias("op"))
    told = R.correlate(cmd.withColumn("want", F.col("o_custkey") % 2), ev, "o_orderkey", [("TenantMismatch", "want", "tenant"), ("OperationMismatch", "o_orderstatus", "op")])
    return told.groupBy("o_orderkey", "verdict").agg(F.count("*").alias("n"))


def _disposition(s, d, f):
    status = F.element_at(F.create_map(*map(F.lit, ("F", "Committed", "O", "NotCommitted", "P", "Unknown"))), F.col("o_orderstatus"))
    return read(s, d, "orders").select("o_orderkey", f(status).alias("disposition"))


@query
def R4_disposition(s: SparkSession, d: str) -> DataFrame:
    return _disposition(s, d, lambda st: R.canonical_disposition(st, lit(NOW), millis("o_orderdate")))


@query
def R7_effect_disposition(s: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "Succeeded").when(F.col("o_orderstatus") == "O", "KnownFailure").otherwise("Unknown")
    return read(s, d, "orders").select("o_orderkey", R.effect_disposition(status, lit(NOW), millis("o_orderdate")).alias("disposition"))


@query
def R9_review(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(s, d, "orders").select("o_orderkey", R.review_verdict(k % 3, k % 2, lit(NOW), F.when(k % 5 != 0, millis("o_orderdate")), k % 2 == 0).alias("verdict"))


@query
def R11_authorization(s: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "TerminalOverride").when(F.col("event_type") == "signup", "DecideReview").otherwise(F.col("event_type"))
    return read(s, d, "events").groupBy(op.alias("operation")).agg(F.count("*").alias("n")).select("operation", "n", R.required_control(F.col("operation")).alias("control"))


def _generations(s, d):
    return read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("generation")).agg(F.max(F.when(F.col("l_returnflag") == "N", 0).otherwise(2)).alias("state"))


@query
def K13_fencing(s: SparkSession, d: str) -> DataFrame:
    return K.may_start(_generations(s, d), "task")


@query
def K14_retire(s: SparkSession, d: str) -> DataFrame:
    done = read(s, d, "orders").select(F.col("o_orderkey").alias("task"), F.when(F.col("o_orderstatus") == "F", "Completed").otherwise("Running").alias("status"))
    return K.retirable(done, _generations(s, d), "task")


@query
def R14_task_evidence(s: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "O", "Exhausted").otherwise("Faulted")
    contract = F.when(F.col("o_orderkey") % 2 == 0, "Pure").otherwise("ReconcileRequired")
    return read(s, d, "orders").select("o_orderkey", R.task_evidence(status, contract).alias("evidence"))


def _inputs(s, d):
    step = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return read(s, d, "events").select("user_id", step.alias("step"), F.round(F.col("value") * 100).cast("long").alias("payload"), "event_type")


@query
def M2_append_gate(s: SparkSession, d: str) -> DataFrame:
    u, n = F.col("user_id"), F.col("step")
    x = _inputs(s, d).where("step % 9 <> 5").select("user_id", "step", F.when((u + n) % 23 == 7, "other").otherwise("own").alias("scope"), F.when(n % 19 == 6, 2).otherwise(1).alias("branch"), F.when(n % 29 == 11, 0).otherwise(F.when(n > 5, 4).otherwise(n - 1)).alias("revision"))
    told = M.append_gate(x, "user_id", ["step"], "scope", "branch", "step", "revision")
    return told.select("user_id", "step", "code")


@query
def M3_observe(s: SparkSession, d: str) -> DataFrame:
    n, p = F.col("step"), F.col("payload")
    x = _inputs(s, d).select("user_id", "step", F.when(p % 31 == 3, "b").otherwise("a").alias("who"), (n / 10).cast("int").alias("epoch"), (p % 100).alias("sequence"), (n + p % 7 - 5).alias("at"))
    return M.observe_gate(x, "user_id", ["step"], "who", "epoch", "sequence", "at", "step").select("user_id", "step", "code")


def _plan_tables(s, d):
    """Heads, corrections and retained inputs of each user's timeline; the inputs have gaps, the corrections every kind of fault."""
    x = _inputs(s, d)
    u, n = F.col("user_id"), F.col("step")
    lng = lambda c: c.cast("long")
    heads = x.groupBy("user_id").agg(lng(F.max("step")).alias("head")).select("user_id", "head", F.lit("own").alias("scope"), F.lit(1).alias("branch"), F.col("head").alias("revision"), F.when(u % 4 != 0, lit(3)).alias("finalized"))
    inputs = x.where("step % 41 <> 40").select("user_id", F.lit("own").alias("scope"), F.when(n % 53 == 50, 2).otherwise(1).alias("branch"), lng(n).alias("step"), F.concat(F.lit("i"), n.cast("string")).alias("identity"), lit(1).alias("revision"), F.col("payload").alias("digest"))
    swaps = n % 2 == 1
    anchor = F.struct(F.when(n % 13 == 7, "other").otherwise("own").alias("scope"), F.when(n % 17 == 9, 2).otherwise(1).alias("branch"), lng(F.when(swaps, n - 1).otherwise(n + u % 3 * 2)).alias("step"))
    new = F.struct(F.lit("own").alias("scope"), F.lit(1).alias("branch"), lng(F.when(n % 7 == 3, n + 1).otherwise(n)).alias("step"), F.when(n % 5 == 0, F.lit("x")).otherwise(F.concat(F.lit("i"), n.cast("string"))).alias("identity"), lng(F.when(n % 9 == 4, 1).otherwise(2)).alias("revision"), (F.col("payload") + 1).alias("digest"))
    asked = x.where("event_type = 'error'").join(heads.select("user_id", "head"), "user_id").select(
        "user_id", lng(n).alias("at"), F.when(n % 11 == 0, F.col("head") - 1).otherwise(F.col("head")).alias("expected_revision"), anchor.alias("anchor"), F.when(swaps, new).alias("replacement"))
    return heads, asked, inputs


@query
def M6_plan(s: SparkSession, d: str) -> DataFrame:
    heads, asked, inputs = _plan_tables(s, d)
    return M.correction_plan(heads, asked, inputs, "user_id", ["at"], 60, 50)


@query
def M7_replay_inputs(s: SparkSession, d: str) -> DataFrame:
    heads, asked, inputs = _plan_tables(s, d)
    plans = M.correction_plan(heads, asked, inputs, "user_id", ["at"], 60, 50)
    told = M.replay_inputs(plans, asked, inputs, "user_id", ["at"])
    return told.groupBy("user_id", "at").agg(F.count("*").alias("n"), F.max("step").alias("through"), F.max(F.when(F.col("offset") == 0, F.col("digest"))).alias("first"), F.sum((F.col("offset") + 1) * (F.col("digest") % 1000)).alias("checksum"))


@query
def M8_correction_replay(s: SparkSession, d: str) -> DataFrame:
    x = _inputs(s, d)
    fix = x.where("event_type = 'error'").select("user_id", "step", (F.col("payload") + 1).alias("payload"))
    return M.replay_states(M.corrected(x.select("user_id", "step", "payload"), fix, "user_id", "step", "payload"), "user_id", "step", "payload")


def _lineage(s, d):
    """Three levels: regions are roots, nations fork from them, suppliers from nations."""
    r = read(s, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("branch"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("inherited_through"), F.lit(15).alias("admitted_through"))
    n = read(s, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.lit(12), F.lit(15))
    u = read(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), F.lit(8), (15 - F.col("s_suppkey") % 3).cast("int"))
    return r.union(n).union(u)


def _overrides(s, d, step: int):
    """Every fourth supplier's override at ``step``."""
    name = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    return read(s, d, "supplier").where("s_suppkey % 4 = 0").select(name.alias("branch"), F.lit(step).alias("step"), F.concat(name, F.lit(f"!{step}")).alias("value"))


@query
def M9_resolve_input(s: SparkSession, d: str) -> DataFrame:
    tree = _lineage(s, d)
    steps = tree.select("branch", F.explode(F.sequence(F.lit(1), F.lit(15))).alias("step"))
    level = F.substring("branch", 1, 1)
    own = steps.where((level == "r") | ((level == "n") & (F.col("step") % 3 == 0)) | ((level == "s") & (F.col("step") % 5 == 0))).withColumn("value", F.concat("branch", F.lit("@"), F.col("step").cast("string")))
    return M.resolve(tree, own, steps.where(level == "s"), _overrides(s, d, 8))


def _effects(s, d):
    return read(s, d, "lineitem").select(F.col("l_suppkey").alias("timeline"), F.col("l_linenumber").alias("step"), F.concat_ws("-", "l_orderkey", "l_partkey", F.col("l_extendedprice").cast("decimal(18,2)").cast("string")).alias("identity"))


@query
def M19_promote(s: SparkSession, d: str) -> DataFrame:
    e = _effects(s, d)
    return M.promote(e, e.where("step >= 6").withColumn("identity", F.concat("identity", F.lit("'"))), "step", F.lit(5)).groupBy("timeline", "step").agg(F.count("*").alias("n"))


@query
def M20_eligible(s: SparkSession, d: str) -> DataFrame:
    return M.eligible_effects(_effects(s, d), "timeline", "step", F.col("timeline") % 5 + 1).groupBy("timeline").agg(F.count("*").alias("n"))


@query
def M21_handoff(s: SparkSession, d: str) -> DataFrame:
    return M.handoff(_effects(s, d).distinct(), "timeline", "step", "identity", 10).select("timeline", "step", "identity", "rn")
