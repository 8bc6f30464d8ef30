"""Queries of commits, leases, timers and evidence, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import commits as C
from ledgerline.operators import correlate as R
from ledgerline.operators import leases as O
from ledgerline.operators import logs
from ledgerline.plans.lifecycle import query
from ledgerline.plans.oracles import _BOX, _OUT, NOW
from ledgerline.plans.queries import _outbox, _outcomes, lit
from ledgerline.sources.tables import millis, read

@query("select l_orderkey, count(*) n_actions, count(distinct (l_partkey % 30, l_returnflag)) n_effects from lineitem group by 1")
def C2_effect_keys(s: SparkSession, d: str) -> DataFrame:
    return C.repeated_effects(read(s, d, "lineitem").withColumn("step", F.col("l_partkey") % 30), "l_orderkey", ["step", "l_returnflag"])


@query(f"with {_OUT}, p as (select conv_id, turn // 4 page, count(*) n, max(turn) - min(turn) + 1 = count(*) c, max(turn) e from o group by 1, 2), q as (select *, lead(page * 4) over (partition by conv_id order by page) + (conv_id % 6 = 0)::int nx from p) select conv_id, page, case when not c then 'NonContiguousSequence' when nx <> e + 1 then 'InvalidContinuation' end code from q")
def C4_page_validation(s: SparkSession, d: str) -> DataFrame:
    p = logs.pages(_outcomes(s, d), "conv_id", "turn", 4).withColumn("end", F.col("first") + F.col("n") - 1)
    whole = _outcomes(s, d).groupBy("conv_id", F.floor(F.col("turn") / 4).cast("long").alias("page")).agg((F.max("turn") - F.min("turn") + 1 == F.count("*")).alias("whole"), F.max("turn").alias("last"))
    nxt = F.when(F.col("continuation").isNotNull(), F.floor(F.col("continuation") / 4) * 4 + F.when(F.col("conv_id") % 6 == 0, 1).otherwise(0))
    return p.join(whole, ["conv_id", "page"]).select("conv_id", "page", C.page_code(F.col("n"), F.col("whole"), F.col("last"), nxt, F.lit(True)).alias("code"))


_CAS = """with recursive z as (select l_orderkey key, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) rn, l_linenumber - 1 - (l_partkey % 4 = 0)::int e, sha256(l_returnflag) d, case when l_suppkey % 3 = 0 then l_suppkey::varchar end i from lineitem),
  st as (select key, 0 rn, 0 head, map([]::int[], []::varchar[]) seen, []::varchar[] took, null::varchar v from z where rn = 1
    union all select key, rn, case when v = 'committed' then head + 1 else head end, case when v = 'committed' then map_concat(seen, map([e], [d])) else seen end, case when v = 'committed' and i is not null then list_append(took, i) else took end, v
    from (select z.key, z.rn::int rn, head, seen, took, e, d, i, case when seen[e] is not null then case when seen[e] = d then 'duplicate' else 'Conflict' end when e <> head or coalesce(list_contains(took, i), false) then 'Conflict' when head + 1 > 3 then 'QuotaExceeded' else 'committed' end v from st join z on z.key = st.key and z.rn = st.rn + 1))"""


@query(_CAS + " select key l_orderkey, v verdict, count(*) n from st where rn > 0 group by 1, 2")
def C6_commit_cas(s: SparkSession, d: str) -> DataFrame:
    x = read(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_linenumber") - 1 - F.when(F.col("l_partkey") % 4 == 0, 1).otherwise(0)).alias("e"), F.lit(1).alias("n"),
        F.sha2("l_returnflag", 256).alias("d"), F.when(F.col("l_suppkey") % 3 == 0, F.col("l_suppkey").cast("string")).alias("i"))
    told = C.commit_log(x, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "e", "n", "d", "i", limit=3)
    return told.groupBy("l_orderkey", "verdict").agg(F.count("*").alias("n"))


@query("select o_orderkey, case when o_orderkey % 6 = 0 then 'SequenceMismatch' when o_orderkey % 2 = 0 and o_custkey % 3 = 0 then 'DuplicateInputWithoutInput' end code from orders")
def C9_receipt(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    through = F.col("o_custkey") + 4 + F.when(k % 6 == 0, 1).otherwise(0)
    return read(s, d, "orders").select("o_orderkey", C.receipt_code(through, F.col("o_custkey"), lit(5), k % 2 == 0, F.col("o_custkey") % 3 != 0).alias("code"))


@query(f"with {_OUT} select conv_id, turn, turn % 7 <> 5 holds from o")
def C12_checksum(s: SparkSession, d: str) -> DataFrame:
    x = read(s, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("t"))
    return x.select("conv_id", "turn", C.checksum_holds(F.col("t"), F.sha2(F.when(F.col("turn") % 7 == 5, F.concat("t", F.lit("!"))).otherwise(F.col("t")), 256)).alias("holds"))


@query("select o_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, o_custkey % 2 = l_suppkey % 2 and o_orderstatus = l_linestatus same from orders join lineitem on l_orderkey = o_orderkey")
def C13_scope(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    x = read(s, d, "orders").join(read(s, d, "lineitem"), F.col("l_orderkey") == k).withColumn("a", F.col("o_custkey") % 2).withColumn("b", F.col("l_suppkey") % 2)
    return x.select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", C.same_scope(x, [("a", "b"), ("o_orderstatus", "l_linestatus")]).alias("same"))


@query("with x as (select o_custkey, o_orderpriority d, first_value(o_orderpriority) over (partition by o_custkey order by o_orderkey) f from orders) select o_custkey, max(f) digest, count(*) filter (where d = f) - 1 n_equal, count(*) filter (where d <> f) n_conflicts from x group by 1")
def C14_register(s: SparkSession, d: str) -> DataFrame:
    return C.register_definitions(read(s, d, "orders"), ["o_custkey"], ["o_orderkey"], "o_orderpriority")


@query("select o_orderkey, o_orderkey % 5 <> 0 and o_custkey % 4 <> 0 valid from orders")
def I4_receipts(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = read(s, d, "orders")
    told = o.select("o_orderkey", "o_custkey", F.when(F.col("o_custkey") % 4 == 0, "other").otherwise(F.col("o_orderpriority")).alias("p"))
    return C.verify_receipts(told, o.where(k % 5 != 0).select("o_orderkey", F.col("o_orderpriority").alias("p")), ["o_orderkey"], "p").select("o_orderkey", "valid")


@query("""with x as (select doc_id, coalesce(text, '') t from documents) select doc_id, case when t in (select t from x where doc_id % 3 <> 0) then strlen(t) end n_bytes, case when t not in (select t from x where doc_id % 3 <> 0) then 'MissingPayload' end code from x""")
def I6_read_payload(s: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    x = read(s, d, "documents").select("doc_id", F.lit("p").alias("scope"), F.sha2(t, 256).alias("digest"), t.alias("text"))
    return C.read_payloads(x.select("doc_id", "scope", "digest"), x.where("doc_id % 3 <> 0"), "scope", "digest", "text").select("doc_id", F.col("n_bytes").cast("long").alias("n_bytes"), "code")


@query(f"with {_BOX} select scope, action_id, not acknowledged and attempt % 3 <> 0 acknowledged from b where expires_at is not null")
def O3_acknowledge(s: SparkSession, d: str) -> DataFrame:
    b = _outbox(s, d).where("expires_at is not null")
    held = b.select("scope", "action_id", F.when(F.col("attempt") % 3 == 0, F.col("expires_at") + 1).otherwise(F.col("expires_at")).alias("expires_at"))
    return O.acknowledge(held, b, ["scope", "action_id", "expires_at"]).select("scope", "action_id", "acknowledged")


@query(f"with {_BOX} select action_id, case when {NOW} > expires_at then 'TimedOut' when acknowledged or {NOW} + 86400000 * attempt <= expires_at then 'Invariant' end code from b where expires_at is not null")
def O4_renew(s: SparkSession, d: str) -> DataFrame:
    return _outbox(s, d).where("expires_at is not null").select("action_id", O.renewal_code(F.col("expires_at"), lit(NOW), F.col("acknowledged"), lit(NOW) + F.col("attempt") * 86400000).alias("code"))


@query(f"""with x as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_partkey % 40 a, l_suppkey % 50 t, epoch_ms(l_shipdate) e, l_returnflag r, l_linestatus s from lineitem)
  select * exclude (a, t, e, r, s), case when r = 'R' then 'OwnerMismatch' when {NOW} > e then 'TimedOut' when s = 'F' then 'NotPending' when count(*) over (partition by l_orderkey, a) > 1 then 'DuplicateAction' when count(*) over (partition by l_orderkey, t) > 1 then 'DuplicateToken' end code from x""")
def O6_claim_validation(s: SparkSession, d: str) -> DataFrame:
    x = read(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_partkey") % 40).alias("action_id"), (F.col("l_suppkey") % 50).alias("token"), millis("l_shipdate").alias("expires_at"),
        F.col("l_returnflag").alias("owner"), (F.col("l_linestatus") == "F").alias("acknowledged"))
    x = x.withColumn("owner", F.when(F.col("owner") == "R", "other").otherwise("me"))
    return O.validate_claims(x, "l_orderkey", F.lit("me"), lit(NOW)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "code")


@query(f"with {_BOX} select action_id, case when not acknowledged and attempt < 64 then attempt + 1 end next_attempt from b")
def O7_next_attempt(s: SparkSession, d: str) -> DataFrame:
    return _outbox(s, d).select("action_id", O.next_attempt(F.col("attempt"), F.col("acknowledged")).alias("next_attempt"))


@query("select user_id, arg_max(case event_type when 'purchase' then 1 when 'error' then 2 else 0 end, row(ts, event_id)) state from events group by 1")
def T3_timer_state(s: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", 2).otherwise(0)
    return O.latest_state(read(s, d, "events").withColumn("state", state), ["user_id"], "state", ["ts", "event_id"])


@query(f"select o_orderkey, case when o_orderkey % 9 = 0 or o_orderkey % 5 = 0 or o_custkey % 6 = 0 or epoch_ms(o_orderdate) > {NOW} then 'Invariant' when {NOW} > epoch_ms(o_orderdate) + 31536000000 then 'TimedOut' end code from orders")
def T4_timer_lease(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.when(k % 9 == 0, "ExternalEffect").otherwise("Timer")
    return read(s, d, "orders").select("o_orderkey", O.timer_lease_code(kind, millis("o_orderdate"), lit(NOW), k % 5 != 0, F.col("o_custkey") % 6 != 0, millis("o_orderdate") + 31536000000).alias("code"))


@query(f"""select o_orderpriority scope, 'act_' || o_orderkey action_id, 'inp_timer_' || sha256(o_orderpriority || 'act_' || o_orderkey) input_id, case when o_orderkey % 3 = 0 then 'duplicate' else 'accepted' end verdict from orders
  where o_orderstatus <> 'F' and epoch_ms(o_orderdate) <= {NOW} qualify row_number() over (partition by o_orderpriority order by epoch_ms(o_orderdate), 'act_' || o_orderkey) <= 20""")
def T6_drain_timers(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.concat(F.lit("act_"), k.cast("string"))
    t = read(s, d, "orders").select(F.col("o_orderpriority").alias("scope"), name.alias("action_id"), millis("o_orderdate").alias("due_at"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("state"), F.lit(None).cast("long").alias("expires_at"), "o_orderkey")
    who = F.concat(F.lit("inp_timer_"), F.sha2(F.concat("scope", "action_id"), 256))
    return O.drain_timers(t, t.where(k % 3 == 0).select("scope", who.alias("input_id")), "scope", lit(NOW), who, 20)


@query("select o_custkey, count(*) n, true increasing from orders group by 1")
def T7_tokens(s: SparkSession, d: str) -> DataFrame:
    t = O.lease_tokens(read(s, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"], 1000)
    span = F.max("token") - F.min("token") + 1 == F.count("*")
    first = F.min_by("token", "o_orderkey") == F.min("token")
    return t.groupBy("o_custkey").agg(F.count("*").alias("n"), (span & first & (F.min("token") > 1000) & (F.count_distinct("token") == F.count("*"))).alias("increasing"))


@query("select o_orderkey, case when c_custkey is null or c_custkey % 7 = 0 then 'UnknownScope' when c_nationkey % 2 <> o_orderkey % 2 then 'TenantMismatch' end code from orders left join customer on c_custkey = o_custkey")
def R2_expectation(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    scopes = read(s, d, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey").cast("long") % 2).alias("tenant"))
    return R.expectations(read(s, d, "orders").select("o_orderkey", "o_custkey", (k % 2).alias("tenant")), scopes, "o_custkey").select("o_orderkey", "code")


@query(f"select o_orderkey, case when o_orderkey % 8 = 0 then 'EffectKeyMismatch' when o_custkey % 5 = 0 then 'ActionMismatch' when o_orderkey % 3 <> 0 and {NOW} > epoch_ms(o_orderdate) then 'DeadlineExceeded' end code from orders")
def R8_effect_evidence(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    want = F.sha2(F.concat(F.lit("key"), k.cast("string")), 256)
    got = F.when(k % 8 == 0, F.sha2(F.lit("x"), 256)).otherwise(want)
    return read(s, d, "orders").select("o_orderkey", R.effect_code(got, want, F.col("o_custkey") % 5 == 0, F.lit(False), lit(NOW), F.when(k % 3 != 0, millis("o_orderdate"))).alias("code"))


@query("""select o_orderkey, case when o_orderkey % 11 = 0 then 'BindingMismatch' when o_orderstatus = 'P' then 'NotCompleted' when o_orderkey % 7 = 0 then 'CorruptOutput' when o_custkey % 5 = 0 then 'Unresolved'
  when o_orderkey % 2 = 1 and o_custkey % 3 = 0 then 'MissingEvidence' when o_orderkey % 2 = 1 and o_custkey % 3 = 1 and o_custkey % 5 = 1 then 'EvidenceMismatch' else case when o_custkey % 5 = 1 then 'KnownFailure' else 'Succeeded' end end outcome from orders""")
def R15_task_outcome(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    c = F.col("o_custkey")
    state = F.when(c % 5 == 0, "Unknown").when(c % 5 == 1, "KnownFailure").otherwise("Succeeded")
    evidence = F.when(c % 3 == 1, "Succeeded").when(c % 3 == 2, state)
    return read(s, d, "orders").select("o_orderkey", R.task_outcome(k % 11 != 0, F.when(F.col("o_orderstatus") == "P", "Running").otherwise("Completed"), k % 7 != 0, state, F.when(k % 2 == 0, "Pure").otherwise("ReconcileRequired"), evidence).alias("outcome"))


@query("""with a as (select o_orderkey from orders where o_orderkey % 4 <> 0), t as (select o_orderkey, case o_orderstatus when 'F' then 'Completed' when 'O' then 'Running' else 'Exhausted' end st from orders where o_orderkey % 3 <> 0)
  select coalesce(a.o_orderkey, t.o_orderkey) o_orderkey, case when a.o_orderkey is null then 'orphan' when st is null then 'submit' when st = 'Running' then 'recover' else 'accept' end todo from a full join t on a.o_orderkey = t.o_orderkey""")
def R17_dispatch(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = read(s, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "O", "Running").otherwise("Exhausted")
    return R.dispatchable(o.where(k % 4 != 0), o.where(k % 3 != 0).select("o_orderkey", status.alias("status")), "o_orderkey")


@query("select o_orderkey, o_orderkey % 6 <> 0 and o_custkey % 4 <> 0 bound from orders")
def R18_checkpoint_evidence(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = read(s, d, "orders")
    told = o.select("o_orderkey", F.when(F.col("o_custkey") % 4 == 0, 9).otherwise(1).alias("generation"), F.sha2("o_orderpriority", 256).alias("blob"))
    held = o.where(k % 6 != 0).select("o_orderkey", F.lit(1).alias("generation"), F.sha2("o_orderpriority", 256).alias("blob"))
    return R.bind_checkpoints(told, held, ["o_orderkey", "generation", "blob"]).select("o_orderkey", "bound")


@query("select o_orderkey from orders join customer on c_custkey = o_custkey where c_nationkey % 3 = 0 and o_orderstatus = 'F'")
def R19_authorized(s: SparkSession, d: str) -> DataFrame:
    allow = read(s, d, "customer").where("c_nationkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), F.lit("F").alias("o_orderstatus"))
    return R.authorized(read(s, d, "orders"), allow, ["o_custkey", "o_orderstatus"]).select("o_orderkey")
