"""Queries of tasks, timelines and streams, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.operators import correlate as R
from ledgerline.operators import graph, logs
from ledgerline.operators import saga as L
from ledgerline.operators import tasks as K
from ledgerline.operators import timeline as M
from ledgerline.plans.lifecycle import query
from ledgerline.plans.oracles import _IN, _OUT, NOW, ORACLES, _linear
from ledgerline.plans.queries import _CONTENT, G5_graph_replay, L12_replay_full, M8_correction_replay, _inputs, _lineage, _outcomes, _overrides, lit
from ledgerline.sources.tables import checkpointed, millis, read, scratch
from ledgerline.streaming import inbox

@query(f"""select o_orderkey, case when o_orderstatus <> 'F' then null when o_orderkey % 5 = 0 or o_custkey % 4 = 2 then 'reconcile' when o_custkey % 4 <> 3 and o_orderkey % 4 < 3 and {NOW} < epoch_ms(o_orderdate) and epoch_ms(o_orderdate) - 86400000 * (o_custkey % 3 - 1) < epoch_ms(o_orderdate) then 'recover' else 'exhaust' end todo from orders""")
def K6_recovery(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    c, due = F.col("o_custkey"), millis("o_orderdate")
    status = F.when(F.col("o_orderstatus") == "F", "Faulted").otherwise("Running")
    mode = F.when(c % 4 == 3, "NeverRestart").when(c % 4 == 2, "ReconcileBeforeRestart").otherwise("Restart")
    contract = F.when(k % 5 == 0, "ReconcileRequired").otherwise("Pure")
    return read(s, d, "orders").select("o_orderkey", K.recovery(status, k % 4, lit(NOW), due - 86400000 * (c % 3 - 1), due, 3, mode, contract).alias("todo"))


@query(f"""select o_orderkey, case when o_orderkey % 3 <> o_custkey % 3 then 'StaleGeneration' when {NOW} >= epoch_ms(o_orderdate) and o_orderstatus <> 'P' then 'Timeout' when o_orderstatus <> 'P' and o_custkey * 100 > 7000 then 'OutputLimit' else case o_orderstatus when 'F' then 'Completed' when 'O' then 'CheckpointCommitted' else 'FaultObserved' end end told from orders""")
def K8_observe(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    p = F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "O", "CheckpointCommitted").otherwise("FaultObserved")
    return read(s, d, "orders").select("o_orderkey", K.observe(p, k % 3, F.col("o_custkey") % 3, lit(NOW), millis("o_orderdate"), F.col("o_custkey") * 100, lit(7000)).alias("told"))


@query("""with recursive z as (select l_orderkey t, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) rn, l_linenumber - 1 e, case when l_linenumber > 1 then 'd' || (l_linenumber - 1) else null end p, case when l_partkey % 9 = 0 then 'x' else 'd' || l_linenumber end d from lineitem),
  st as (select t, 0 rn, 0 nx, null::varchar last, null::varchar v from z where rn = 1
    union all select t, rn, nx + (v = 'committed')::int, case when v = 'committed' then d else last end, v from (select z.t, z.rn::int rn, nx, last, d, case when e <> nx or p is distinct from last then 'Conflict' when nx >= 4 then 'QuotaExhausted' else 'committed' end v from st join z on z.t = st.t and z.rn = st.rn + 1))
  select t l_orderkey, v verdict, count(*) n from st where rn > 0 group by 1, 2""")
def K10_journal(s: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    x = read(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (n - 1).alias("e"), F.when(n > 1, F.concat(F.lit("d"), (n - 1).cast("string"))).alias("p"),
        F.when(F.col("l_partkey") % 9 == 0, "x").otherwise(F.concat(F.lit("d"), n.cast("string"))).alias("d"))
    return K.journal(x, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "e", "p", "d", 4).groupBy("l_orderkey", "verdict").agg(F.count("*").alias("n"))


@query(f"with {_OUT} select conv_id, count(*) n, sum(strlen(coalesce(text, '')))::bigint n_bytes, case when min(turn) <> 0 or max(turn) + 1 <> count(*) then 'InvalidOrder' when conv_id % 4 = 1 and max(turn) >= 2 then 'CorruptRecord' end code from conversations group by 1")
def K11_reconstruct(s: SparkSession, d: str) -> DataFrame:
    x = read(s, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("body"))
    bad = (F.col("conv_id") % 4 == 1) & (F.col("turn") == 2)
    return K.reconstruct(x.withColumn("checksum", F.sha2(F.when(bad, F.concat("body", F.lit("!"))).otherwise(F.col("body")), 256)), "conv_id", "turn", "body", "checksum")


@query(f"with {_OUT}, t as (select conv_id, max(turn) + 1 n from o group by 1) select conv_id, n + (conv_id % 5 = 0 and conv_id % 7 <> 3)::int next_sequence, case when conv_id % 7 = 3 then 'rebuilt' when conv_id % 5 = 0 then 'Corrupt' end code from t")
def K12_heads(s: SparkSession, d: str) -> DataFrame:
    o = _outcomes(s, d)
    i = F.col("conv_id")
    heads = o.groupBy("conv_id").agg((F.max("turn") + 1).alias("n")).where(i % 7 != 3).select("conv_id", F.when(i % 5 == 0, F.col("n") + 1).otherwise(F.col("n")).alias("next_sequence"))
    return K.rebuild_heads(heads, o, "conv_id", "turn")


@query("select o_orderkey, case when o_custkey > o_orderkey % 100 then 'FutureCorrection' end code from orders")
def M1_head(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(s, d, "orders").select("o_orderkey", M.head_code(k % 100, F.col("o_custkey")).alias("code"))


@query(f"with {_IN}, y as (select user_id, step, step // 2 + payload % 5 f from x), z as (select *, max(case when f <= step then f end) over (partition by user_id order by step rows between unbounded preceding and 1 preceding) m from y) select user_id, step, (m is null or f > m) and f <= step advances from z")
def M4_finalize(s: SparkSession, d: str) -> DataFrame:
    x = _inputs(s, d).select("user_id", "step", (F.floor(F.col("step") / 2) + F.col("payload") % 5).alias("f"))
    return M.finalize_gate(x, "user_id", ["step"], "f", F.col("step")).select("user_id", "step", "advances")


@query(f"""with recursive {_IN}, e as (select user_id, step, case event_type when 'purchase' then 'reserve' when 'error' then 'abort' when 'click' then 'promote' else 'append' end kind, (payload % 12)::varchar b from x),
  st as (select user_id, 0 step, 0 rev, map([]::varchar[], []::int[]) live, []::varchar[] used, null::varchar kind, null::varchar v from e where step = 1
    union all select user_id, step, rev + (v in ('appended', 'promoted'))::int, case when v = 'reserved' then map_concat(live, map([b], [rev])) when v in ('aborted', 'promoted') then map_from_entries([q for q in map_entries(live) if q.key <> b]) else live end, case when v = 'reserved' then list_append(used, b) else used end, kind, v
    from (select e.user_id, e.step, rev, live, used, e.kind, b, case e.kind when 'append' then 'appended' when 'reserve' then case when list_contains(used, b) then 'Conflict' when cardinality(live) >= 3 then 'Capacity' else 'reserved' end
      else case when live[b] is null then 'SessionUnavailable' when e.kind = 'abort' then 'aborted' when live[b] <> rev then 'Conflict' else 'promoted' end end v from st join e on e.user_id = st.user_id and e.step = st.step + 1))
  select user_id, step, kind, v verdict from st where step > 0""")
def M5_control(s: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    kind = F.when(t == "purchase", "reserve").when(t == "error", "abort").when(t == "click", "promote").otherwise("append")
    return M.control(_inputs(s, d).select("user_id", "step", kind.alias("kind"), (F.col("payload") % 12).alias("branch")), "user_id", ["step"], 3)


def _anchors(s, d):
    tree = _lineage(s, d).withColumnRenamed("inherited_through", "state_changed_from")
    level = F.substring("branch", 1, 1)
    steps = tree.select("branch", F.explode(F.sequence(F.lit(1), F.lit(15))).alias("step"))
    own = steps.where((level == "r") | ((level == "n") & (F.col("step") % 4 == 0)) | ((level == "s") & (F.col("step") % 6 == 0))).withColumn("value", F.concat("branch", F.lit("#"), F.col("step").cast("string")))
    return tree, own, steps


@query("""with k as (select s_suppkey, s_nationkey, n_regionkey, t.step from supplier join nation on s_nationkey = n_nationkey, unnest(range(3, 16)) t(step) where t.step <= 15 - s_suppkey % 3)
  select 's' || s_suppkey branch, step::int step, f found_in, case when f = 's' || s_suppkey and step = 7 then f || '!7' else f || '#' || step end as value from (select *, case when step % 6 = 0 or step = 7 and s_suppkey % 4 = 0 then 's' || s_suppkey when step < 8 and step % 4 = 0 then 'n' || s_nationkey when step < 8 then 'r' || n_regionkey end f from k) where f is not null""")
def M10_resolve_anchor(s: SparkSession, d: str) -> DataFrame:
    tree, own, steps = _anchors(s, d)
    return M.resolve_anchors(tree, own, steps.where("branch like 's%'"), 3, _overrides(s, d, 7))


@query("""with x as (select *, row(l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) body from lineitem), y as (select l_suppkey % 50 branch, l_linenumber step, l_partkey % 3 revision, l_returnflag f, first_value(l_returnflag) over w ff, row_number() over w rn from x
  window w as (partition by l_suppkey % 50, l_linenumber, l_partkey % 3 order by l_orderkey, l_partkey, l_suppkey, l_extendedprice))
  select branch, step, revision, case when rn = 1 then 'accepted' when f = ff then 'duplicate' else 'conflict' end verdict, count(*) n from y group by all""")
def M11_import_input(s: SparkSession, d: str) -> DataFrame:
    x = read(s, d, "lineitem").select((F.col("l_suppkey") % 50).alias("branch"), F.col("l_linenumber").alias("step"), (F.col("l_partkey") % 3).alias("revision"), "l_returnflag", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")
    told = logs.accept_inputs(x, ["branch", "step", "revision"], ["l_returnflag"], ["l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"])
    return told.groupBy("branch", "step", "revision", "verdict").agg(F.count("*").alias("n"))


@query("select l_orderkey, l_linenumber, count(*) n, case when count(*) filter (where l_partkey % 10 = 0) > 0 then 'InputMismatch' when count(*) > 1 then 'Conflict' end code from lineitem group by 1, 2")
def M12_anchor_check(s: SparkSession, d: str) -> DataFrame:
    return M.anchor_codes(read(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], F.col("l_partkey") % 10 != 0)


@query("""with r as (select case when o_orderkey % 4 = 0 then 'r1' else 'f' || o_orderkey end branch, case when o_orderkey % 5 = 0 then 'zz' else 'n' || (o_custkey % 25) end parent, o_orderkey % 20 step, o_custkey % 2 = 0 replaces,
  case when o_orderkey % 4 = 0 then 'Conflict' when o_orderkey % 5 = 0 then 'HistoryUnavailable' when o_orderkey % 20 > 15 then 'FutureCorrection' end code from orders)
  select branch, parent, step, code, case when code is null then 15 end inherited_through, case when code is null then 15 end admitted_through, case when code is null then step end state_changed_from, case when code is null and replaces then step end input_override, case when code is null and not replaces then step end state_override from r""")
def M13_fork(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    tree, _, _ = _anchors(s, d)
    ask = read(s, d, "orders").select(F.when(k % 4 == 0, "r1").otherwise(F.concat(F.lit("f"), k.cast("string"))).alias("branch"), F.when(k % 5 == 0, "zz").otherwise(F.concat(F.lit("n"), (F.col("o_custkey") % 25).cast("string"))).alias("parent"), (k % 20).alias("step"), (F.col("o_custkey") % 2 == 0).alias("replaces"))
    return M.fork(tree, ask)


@query("select 's' || s_suppkey branch, len([x for x in range(3, s_suppkey % 15 + 1) if x <= 15 - s_suppkey % 3 and (x <= 8 or x % 6 = 0)]) n, n = greatest(s_suppkey % 15 - 2, 0) complete from supplier")
def M14_materialize(s: SparkSession, d: str) -> DataFrame:
    _, own, _ = _anchors(s, d)
    heads = read(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("branch"), (F.col("s_suppkey") % 15).cast("int").alias("head"))
    return M.materialize_branch(_lineage(s, d), own, heads, 2)


@query(f"with {_IN} select user_id, count(*) n, max(step) - min(step) + 1 = count(distinct step) contiguous from x where step > 4 and step <= 20 + user_id % 7 and step % 11 <> 10 group by 1")
def M15_collect_inputs(s: SparkSession, d: str) -> DataFrame:
    return M.collect_inputs(_inputs(s, d).where("step % 11 <> 10"), "user_id", "step", lit(4), F.col("user_id") % 7 + 20)


@query("""with k as (select b.branch, t.step, m from (select 'r' || r_regionkey branch, 1 m from region union all select 'n' || n_nationkey, 3 from nation union all select 's' || s_suppkey, 6 from supplier) b, unnest(range(1, 16)) t(step) where t.step % m = 0)
  select 'input' kind, branch, step::int step from k where step > 6 union all select 'anchor', branch, step from k where step >= 6""")
def M16_expire(s: SparkSession, d: str) -> DataFrame:
    tree = _lineage(s, d)
    level = F.substring("branch", 1, 1)
    every = F.when(level == "r", 1).when(level == "n", 3).otherwise(6)
    own = tree.select("branch", F.explode(F.sequence(F.lit(1), F.lit(15))).alias("step")).where(F.col("step") % every == 0)
    inputs, anchors = M.expire_before(tree, own, own, 6)
    return inputs.select(F.lit("input").alias("kind"), "branch", "step").unionByName(anchors.select(F.lit("anchor").alias("kind"), "branch", "step"))


@query("""select 'r' || r_regionkey branch, case when r_regionkey in (select n_regionkey from nation) then 'Conflict' end code from region union all select 'n' || n_nationkey, case when n_nationkey in (select s_nationkey from supplier) then 'Conflict' end from nation
  union all select 's' || s_suppkey, case when s_suppkey % 6 = 0 then 'Conflict' end from supplier""")
def M17_retire(s: SparkSession, d: str) -> DataFrame:
    live = read(s, d, "supplier").where("s_suppkey % 6 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("branch"))
    return M.retire_codes(_lineage(s, d), live)


@query("select l_suppkey timeline, count(*) n, case when count(*) > 620 then 'Capacity' when count(distinct (l_orderkey, l_linenumber)) < count(*) then 'InputMismatch' end code from lineitem group by 1")
def M18_live_append(s: SparkSession, d: str) -> DataFrame:
    x = read(s, d, "lineitem").select(F.col("l_suppkey").alias("timeline"), "l_orderkey", "l_linenumber")
    return M.append_effects(x.where("l_linenumber <= 3"), x.where("l_linenumber > 3"), ["l_orderkey", "l_linenumber"], "timeline", 620)


@query("""with recursive z as (select l_orderkey t, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) rn, (l_partkey % 8)::varchar i, l_quantity::bigint b from lineitem),
  st as (select t, 0 rn, []::varchar[] ids, 0::bigint bytes, null::varchar code from z where rn = 1
    union all select t, rn, case when code is null then list_append(ids, i) else ids end, case when code is null then bytes + b else bytes end, code from (select z.t, z.rn::int rn, ids, bytes, i, b, case when len(ids) >= 4 then 'Capacity' when list_contains(ids, i) then 'InputMismatch' when bytes + b > 90 then 'Capacity' end code from st join z on z.t = st.t and z.rn = st.rn + 1))
  select t l_orderkey, coalesce(code, 'staged') verdict, count(*) n from st where rn > 0 group by 1, 2""")
def M22_stage(s: SparkSession, d: str) -> DataFrame:
    x = read(s, d, "lineitem").withColumn("i", F.col("l_partkey") % 8).withColumn("b", F.col("l_quantity").cast("long"))
    told = M.stage_effects(x, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "i", "b", 4, 90)
    return told.groupBy("l_orderkey", F.coalesce("code", F.lit("staged")).alias("verdict")).agg(F.count("*").alias("n"))


@query(ORACLES["M8_correction_replay"].replace("select user_id, step head, state from st qualify", "select user_id, step + 1 head, (state * 3 + user_id) % 1000003 state from st qualify"))
def M24_live_step(s: SparkSession, d: str) -> DataFrame:
    states = M8_correction_replay(s, d)
    return M.live_step(states, states.select("user_id", (F.col("head") + 1).alias("step"), F.col("user_id").alias("payload")), "user_id", "step", "payload")


def _task_log(s: SparkSession, d: str) -> DataFrame:
    """Records of a task for each user and day: every fifth is out of step with the state machine, the others follow its usual course."""
    e = read(s, d, "events").withColumn("day", F.col("ts").cast("date").cast("string"))
    rn = F.row_number().over(W.partitionBy("user_id", "day").orderBy("ts", "event_id"))
    usual = F.array(*map(F.lit, ("IntentCommitted", "Started", "CheckpointCommitted", "FaultObserved", "RecoveryPlanned", "Restarted", "CheckpointCommitted", "Completed")))
    odd = F.array(*map(F.lit, ("FaultObserved", "RecoveryExhausted", "ReconciliationRequired", "Started")))
    i = F.col("event_id")
    kind = F.when((i % 5 == 0) & (F.col("rn") > 2), F.element_at(odd, (i % 4 + 1).cast("int"))).otherwise(F.element_at(usual, F.least("rn", F.lit(8))))
    return e.withColumn("rn", rn).select(
        F.concat_ws("/", "user_id", "day").alias("task"), (F.col("rn") - 1).alias("sequence"), F.col("rn").cast("long").alias("tick"), F.when(F.col("rn") >= 6, 2).when(F.col("rn") >= 2, 1).otherwise(0).alias("generation"),
        kind.alias("kind"), F.when(kind == "CheckpointCommitted", F.concat(F.lit("c"), F.col("rn").cast("string"))).when(kind == "RecoveryPlanned", "c3").when(kind == "FaultObserved", "Panic").alias("detail"), (i % 50).alias("bytes"))


# the state machine under the default definition
_K2_CODE = """case when sq <> n or tick < tk then 'InvalidOrder' when sq >= 64 or (begins or k = 'CheckpointCommitted') and sq >= 63 then 'QuotaExhausted' when gn <> g + begins::int then 'StaleGeneration'
        when not (k = 'IntentCommitted' and s = 'Empty' or k = 'Started' and s = 'Pending' or k = 'Restarted' and s = 'Ready' or k in ('CheckpointCommitted', 'FaultObserved', 'Completed') and s = 'Running' or k in ('ReconciliationRequired', 'RecoveryPlanned') and s = 'Faulted' or k = 'RecoveryExhausted' and s in ('Faulted', 'Pending', 'Ready')) then 'InvalidTransition'
        when begins and gn > 3 then 'QuotaExhausted' when begins and tick >= 1000 then 'DeadlineExpired' when k in ('CheckpointCommitted', 'Completed') and tick >= until then 'DeadlineExpired' when k = 'CheckpointCommitted' and (b > 40 or made >= 8) or k = 'Completed' and b > 40 then 'QuotaExhausted'
        when k = 'ReconciliationRequired' then 'InvalidTransition' when k = 'RecoveryPlanned' and not (g < 3 and tick < 1000 and rs < 1000) then 'QuotaExhausted' when k = 'RecoveryPlanned' and dt is distinct from cp then 'CorruptBlob'
        when k = 'RecoveryExhausted' and (s in ('Pending', 'Ready') and tick < 1000 or s = 'Faulted' and g < 3 and tick < 1000 and rs < 1000) then 'InvalidTransition' end"""
_K2 = f"""with recursive e as (select user_id || '/' || ts::date::varchar task, event_id i, row_number() over (partition by user_id, ts::date order by ts, event_id) rn from events),
  z as (select task, rn, rn - 1 sq, rn tick, case when rn >= 6 then 2 when rn >= 2 then 1 else 0 end gn, case when i % 5 = 0 and rn > 2 then ['FaultObserved', 'RecoveryExhausted', 'ReconciliationRequired', 'Started'][i % 4 + 1]
    else ['IntentCommitted', 'Started', 'CheckpointCommitted', 'FaultObserved', 'RecoveryPlanned', 'Restarted', 'CheckpointCommitted', 'Completed'][least(rn, 8)] end k, i % 50 b from e),
  y as (select *, case k when 'CheckpointCommitted' then 'c' || rn when 'RecoveryPlanned' then 'c3' when 'FaultObserved' then 'Panic' end dt, k in ('Started', 'Restarted') begins from z),
  st as (select task, 0::bigint rn, 'Empty' s, 0::bigint n, 0::bigint tk, 0 g, 0::bigint until, 0::bigint rs, 0::bigint made, null::varchar cp, null::varchar code, null::bigint pos from y where rn = 1
    union all select task, rn, case when code is not null then s when k = 'IntentCommitted' then 'Pending' when begins then 'Running' when k = 'FaultObserved' then 'Faulted' when k = 'Completed' then 'Completed' when k = 'RecoveryPlanned' then 'Ready' when k = 'RecoveryExhausted' then 'Exhausted' else s end,
      case when code is null then n + 1 else n end, case when code is null then tick else tk end, case when code is null and begins then gn else g end, case when code is null and begins then least(tick + 20, 1000) else until end, case when code is null and k = 'FaultObserved' then tick else rs end, case when code is null and k = 'CheckpointCommitted' then made + 1 else made end,
      case when code is null and k in ('CheckpointCommitted', 'RecoveryPlanned') then dt else cp end, code, case when code is not null then coalesce(pos, sq) end
    from (select *, coalesce(old, {_K2_CODE}) code
      from (select st.* exclude (rn, code), st.code old, y.* exclude (task) from st join y on y.task = st.task and y.rn = st.rn + 1))), fin as (select * from st qualify row_number() over (partition by task order by rn desc) = 1)"""


@query(_K2 + " select task, n n_applied, s status, g::bigint generation, tk tick, cp checkpoint, code, pos code_sequence from fin")
def K2_task_records(s: SparkSession, d: str) -> DataFrame:
    return K.replay_records(_task_log(s, d), "task", K.Definition())


@query(_K2 + " select s status, code, count(*) n_tasks, sum(n)::bigint n_records, sum(made)::bigint n_checkpoints, max(g)::bigint generation from fin group by 1, 2")
def K3_task_replay(s: SparkSession, d: str) -> DataFrame:
    x = K.project_records(_task_log(s, d), "task", K.Definition())
    return x.groupBy("status", "code").agg(F.count("*").alias("n_tasks"), F.sum("next_sequence").alias("n_records"), F.sum("made").alias("n_checkpoints"), F.max("generation").alias("generation"))


@query(_K2 + """, w as (select *, tk + n % 4 * 9 - (n % 5 = 3)::int now from fin), v as (select *, case when now < tk then null when s = 'Running' and now >= until then 'FaultObserved' when s in ('Pending', 'Ready') and now >= 1000 then 'RecoveryExhausted' when s = 'Pending' then 'Started'
    when s = 'Ready' and now >= rs then 'Restarted' when s = 'Faulted' then case when g < 3 and now < 1000 and rs < 1000 then 'RecoveryPlanned' else 'RecoveryExhausted' end end nk from w)
  select task, s status, nk next_kind, case when nk in ('Started', 'Restarted') then g + 1 when nk is not null then g end::bigint next_generation, case nk when 'FaultObserved' then 'Timeout' when 'RecoveryPlanned' then cp end next_detail, case when now < tk then 'InvalidOrder' end next_code from v""")
def K4_next(s: SparkSession, d: str) -> DataFrame:
    x = K.project_records(_task_log(s, d), "task", K.Definition())
    n = F.col("next_sequence")
    now = F.col("tick") + n % 4 * 9 - F.when(n % 5 == 3, 1).otherwise(0)
    return K.next_transition(x, K.Definition(), now).select("task", "status", "next_kind", "next_generation", "next_detail", "next_code")


@query(_K2 + f""", w as (select fin.* exclude (code), ['Restarted', 'RecoveryPlanned', 'CheckpointCommitted'][n % 3 + 1] k, n sq, tk + 1 tick, n * 17 % 60 b from fin), v as (select *, k = 'Restarted' begins, g + (k = 'Restarted')::int gn, case k when 'RecoveryPlanned' then 'c3' else 'cx' end dt from w),
  u as (select *, {_K2_CODE} code from v) select task, code proposed_code, case when code is null then case k when 'Restarted' then 'Running' when 'RecoveryPlanned' then 'Ready' else s end end proposed_status from u""")
def K5_propose(s: SparkSession, d: str) -> DataFrame:
    x = K.project_records(_task_log(s, d), "task", K.Definition())
    n = F.col("next_sequence")
    kind = F.get(F.array(*map(F.lit, ("Restarted", "RecoveryPlanned", "CheckpointCommitted"))), (n % 3).cast("int"))
    asked = K.propose(x, K.Definition(), kind, F.col("generation") + F.when(kind == "Restarted", 1).otherwise(0), F.col("tick") + 1, F.when(kind == "RecoveryPlanned", "c3").otherwise("cx"), n * 17 % 60)
    return asked.select("task", "proposed_code", "proposed_status")


@query(_K2 + " select task, n sequence, g::bigint generation, tk + 2 tick, 'FaultObserved' kind, 'SupervisorInterrupted' detail, case when n >= 64 then 'QuotaExhausted' end code from fin where s = 'Running'")
def K7_restore(s: SparkSession, d: str) -> DataFrame:
    return K.interrupted(K.project_records(_task_log(s, d), "task", K.Definition()), "task", K.Definition(), F.col("tick") + 2)


@query("select o_orderkey, o_orderstatus = 'O' and 820454400000 >= epoch_ms(o_orderdate) safe from orders")
def R5_retry_safe(s: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "NotCommitted").otherwise("Unknown")
    return read(s, d, "orders").select("o_orderkey", R.retry_safe(status, lit(NOW), millis("o_orderdate")).alias("safe"))


@query(_linear(True, True) + """ select user_id, week, case when status = 'Running' then 'step-' || step when status = 'Compensating' then 'undo-0' end as action, case when status in ('Running', 'Compensating') then attempt end action_attempt from fin""")
def L14_action(s: SparkSession, d: str) -> DataFrame:
    name, attempt = L.action_for(F.col("status"), F.col("step"), F.col("attempt"), F.col("n_compensable"))
    return L12_replay_full(s, d).select("user_id", "week", name.alias("action"), attempt.alias("action_attempt"))


@query("select l_orderkey, l_partkey % 60 action_id, count(*) n, count(*) > 1 issued_again from lineitem group by 1, 2")
def L15_fresh_actions(s: SparkSession, d: str) -> DataFrame:
    return L.repeated_actions(read(s, d, "lineitem").withColumn("action_id", F.col("l_partkey") % 60), "l_orderkey", "action_id")


@query(ORACLES["G5_graph_replay"].replace("select user_id, week, status, step, visit, err error_code from st", "select user_id, week, step as action, visit - 1 action_attempt from st").replace("order by rn desc) = 1", "order by rn desc) = 1 and status = 'Running' and err is null"))
def G7_graph_action(s: SparkSession, d: str) -> DataFrame:
    x = G5_graph_replay(s, d).where("status = 'Running' and error_code is null")
    step, attempt = graph.action_for(F.col("step"), F.col("visit"))
    return x.select("user_id", "week", step.alias("action"), attempt.alias("action_attempt"))


_NEXT = """, w as (select *, tk + n % 7 * 9 now from fin), v as (select *, case when s = 'Running' and now >= until then 'FaultObserved' when s in ('Pending', 'Ready') and now >= 1000 then 'RecoveryExhausted' when s = 'Pending' then 'Started'
    when s = 'Ready' and now >= rs then 'Restarted' when s = 'Faulted' then case when g < 3 and now < 1000 and rs < 1000 then 'RecoveryPlanned' else 'RecoveryExhausted' end end nk from w)"""


@query(_K2 + _NEXT + """, c as (select *, ['advance', 'poll', 'reconcile', 'import_checkpoint'][(length(task) + n) % 4 + 1] c from v) select task, case when c = 'poll' and s = 'Running' and now >= until then 'FaultObserved' when c = 'import_checkpoint' and s = 'Pending' and cp is null then 'CheckpointMigrated' when c = 'advance' then nk end record from c""")
def K9_control(s: SparkSession, d: str) -> DataFrame:
    x = K.project_records(_task_log(s, d), "task", K.Definition())
    n = F.col("next_sequence")
    command = F.get(F.array(*map(F.lit, ("advance", "poll", "reconcile", "import_checkpoint"))), ((F.length("task") + n) % 4).cast("int"))
    return K.control_record(x, K.Definition(), command, F.col("tick") + n % 7 * 9).select("task", "record")


@query(_K2 + _NEXT + " select task, nk record, (g + (nk in ('Started', 'Restarted'))::int)::bigint generation from v where nk is not null and length(task) % 3 <> 1")
def K15_drive(s: SparkSession, d: str) -> DataFrame:
    x = K.project_records(_task_log(s, d), "task", K.Definition())
    return K.drive_once(x, K.Definition(), _task_log(s, d).where(F.length("task") % 3 != 1), "task", F.col("tick") + F.col("next_sequence") % 7 * 9)


@query(ORACLES["M8_correction_replay"].replace("payload + (event_type = 'error')::int p from x", "payload + (event_type = 'error' and step > 2)::int p from x"))
def M23_scoped_correction(s: SparkSession, d: str) -> DataFrame:
    """Gate, plan, replace, replay: every input that the gate lets in, corrected where the plan allows it."""
    n = F.col("step").cast("long")
    x = _inputs(s, d).select("user_id", n.alias("step"), "payload", "event_type", F.lit("own").alias("scope"), F.lit(1).alias("branch"), (n - 1).alias("before"), F.concat(F.lit("i"), n.cast("string")).alias("identity"), lit(1).alias("revision"))
    x = checkpointed(M.append_gate(x, "user_id", ["step"], "scope", "branch", "step", "before").where("code is null").drop("code"))
    heads = x.groupBy("user_id").agg(F.max("step").alias("head")).select("user_id", "head", F.lit("own").alias("scope"), F.lit(1).alias("branch"), F.col("head").alias("revision"), lit(2).alias("finalized"))
    new = F.struct("scope", "branch", "step", "identity", lit(2).alias("revision"))
    ask = x.where("event_type = 'error'").select("user_id", F.col("step").alias("at"), (F.col("payload") + 1).alias("payload"), F.struct("scope", "branch", (F.col("step") - 1).alias("step")).alias("anchor"), new.alias("replacement"))
    ask = ask.join(heads.select("user_id", F.col("head").alias("expected_revision")), "user_id")
    fine = M.correction_plan(heads, ask, x.select("user_id", "scope", "branch", "step", "identity", "revision"), "user_id", ["at"], 4096, 4096).where("code is null").select("user_id", "at")
    fixes = ask.join(fine, ["user_id", "at"], "left_semi").select("user_id", F.col("at").alias("step"), "payload")
    return M.replay_states(M.corrected(x.select("user_id", "step", "payload"), fixes, "user_id", "step", "payload"), "user_id", "step", "payload").select("user_id", F.col("head").cast("int").alias("head"), "state")


@query("""with v as (select l_orderkey, l_linenumber, row(l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) body, row_number() over w rn, first_value(row(l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)) over w f from lineitem
    window w as (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax))
  select l_orderkey, l_linenumber, case when rn = 1 then 'accepted' when f = body then 'duplicate' else 'conflict' end verdict, count(*) n from v group by all""")
def I1_inbox_stream(s: SparkSession, d: str) -> DataFrame:
    """The inbox over a stream of the table's files, run until all is taken."""
    kind = read(s, d, "lineitem").schema
    stream = s.readStream.schema(kind).parquet(f"{d}/lineitem.parque[t]")  # a pattern, as a stream takes no single file
    out = scratch(s, "inbox")
    inbox.run_to_end(stream, inbox.accept_batches(f"{out}/rows", ["l_orderkey", "l_linenumber"], _CONTENT, [*_CONTENT, "l_discount", "l_tax"]), f"{out}/checkpoint")
    return s.read.parquet(f"{out}/rows").groupBy("l_orderkey", "l_linenumber", "verdict").agg(F.sum("n").alias("n"))
