"""Queries of the sagas' whole decision function and of graph sagas, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.operators import decide as D
from ledgerline.operators import graph as G
from ledgerline.plans.lifecycle import query
from ledgerline.plans.queries import EDGES, lit
from ledgerline.sources.tables import read, saga_events

#: Three steps: the first can be undone, the second waits before retries, the third can be undone once.
STEPS = (D.Step(2, None, 2), D.Step(3, (1000, 60000), None), D.Step(1, None, 1))

# one transition in SQL: from s (state columns) and e (event columns) to code and the state after; the same three steps
_BACK = "case when len(comp) > 0 then 'compensate' else 'escalate' end"
_MOVE = f"""case kind when 'Started' then 'start' when 'ActionResult' then case when status = 'Running' then case result when 'S' then case when step = 2 then 'complete' else 'next' end
    when 'R' then case when attempt + 1 >= [2, 3, 1][step + 1] then {_BACK} else 'retry' end when 'T' then {_BACK} else 'escalate' end
    else case when result = 'S' then case when len(comp) <= 1 then 'compensated' else 'pop' end when result = 'R' and attempt + 1 < [2, null, 1][comp[-1] + 1] then 'comp_retry' else 'escalate' end end
  when 'RetryTimerScheduled' then case when "at" + least(60000, 1000 * (1 << attempt)) > deadline then {_BACK} else 'timer' end when 'RetryTimerFired' then 'fire'
  else case resolution when 'RetryAction' then 'resume' when 'Compensate' then case when len(comp) > 0 then 'compensate' else 'cancel' end when 'Cancel' then 'cancel' else 'stay' end end"""
_CODE = """case when dup then 'DuplicateInput' when kind = 'Started' and status is not null then 'DuplicateStart' when kind = 'Started' and not pinned then 'DefinitionMismatch' when kind <> 'Started' and status is null then 'MissingStart'
  when kind = 'ActionResult' and status not in ('Running', 'Compensating') or kind in ('RetryTimerScheduled', 'RetryTimerFired') and status <> 'Running' then 'TerminalProjection' when kind = 'ManualResolution' and status <> 'Escalated' then 'ManualResolutionRequiresEscalation'
  when kind in ('ActionResult', 'RetryTimerScheduled') and active is distinct from action then 'UnexpectedAction' when kind in ('ActionResult', 'RetryTimerScheduled') and due is not null then 'RetryTimerMustFire'
  when kind = 'RetryTimerFired' and (active is distinct from action or due is null) then 'UnexpectedRetryTimer' when kind = 'RetryTimerFired' and "at" < due then 'RetryTimerFiredEarly' when kind = 'RetryTimerScheduled' and result <> 'R' then 'RetryTimerRequiresRetryableFailure'
  when kind = 'RetryTimerScheduled' and step <> 1 then 'RetryTimerNotConfigured' when kind = 'RetryTimerScheduled' and attempt + 1 >= 3 then 'RetryTimerNotRequired' when m = 'retry' and step = 1 then 'RetryTimerRequired'
  when m in ('next', 'retry', 'compensate', 'pop', 'comp_retry', 'timer', 'fire', 'resume') then case when nxt is null then 'MissingNextAction' when list_contains(issued, nxt) then 'ReusedActionId' end end"""
_AFTER = {
    "status": "case when m in ('start', 'next', 'retry', 'timer', 'fire', 'resume') then 'Running' when m in ('compensate', 'pop', 'comp_retry') then 'Compensating' when m = 'complete' then 'Completed' when m = 'escalate' then 'Escalated' when m = 'compensated' then 'Compensated' when m = 'cancel' then 'Cancelled' else status end",
    "step": "case when m = 'start' then 0 when m in ('next', 'complete') then step + 1 else step end",
    "attempt": "case when m in ('start', 'next', 'compensate', 'pop') then 0 when m in ('retry', 'comp_retry', 'timer') then attempt + 1 else attempt end",
    "due": "case when m = 'timer' then \"at\" + least(60000, 1000 * (1 << attempt)) when m in ('start', 'fire') then null else due end",
    "active": "case when m in ('complete', 'escalate', 'compensated', 'cancel') then null when m = 'stay' then active else nxt end",
    "issued": "case when m = 'start' then [nxt] when m in ('complete', 'escalate', 'compensated', 'cancel', 'stay') then issued else list_append(issued, nxt) end",
    "comp": "case when m = 'start' then []::int[] when m in ('pop', 'compensated') then comp[:-2] when m in ('next', 'complete') and step <> 1 then list_append(comp, step) else comp end",
}
_LOG = """ev as (select user_id, week, rn, event_id, r, (r = 'R' and event_id % 3 = 0) sched from (select user_id, date_trunc('month', ts)::date::varchar as week, row_number() over (partition by user_id, date_trunc('month', ts) order by ts, event_id) rn, event_id,
    case when value < 10 then 'T' when value > 150 then 'U' when event_type = 'error' then 'R' else 'S' end r from events)),
  lg as (select *, case when rn = 1 and user_id % 13 <> 5 or rn > 4 and event_id % 53 = 3 then 'Started' when lag(sched) over w then 'RetryTimerFired' when lag(r) over w = 'U' then 'ManualResolution' when sched then 'RetryTimerScheduled' else 'ActionResult' end kind,
    case when event_id % 97 = 5 then 'act_0' else 'act_' || (rn - 1) end action, case when event_id % 101 = 3 then null when event_id % 89 = 4 then 'act_1' else 'act_' || rn end nxt, r result, rn * 5000 "at", case when event_id % 4 = 0 then rn * 5000 + 1500 end deadline,
    ['RetryAction', 'Compensate', 'Cancel', 'Escalate'][event_id % 4 + 1] resolution, user_id % 17 <> 3 pinned, event_id % 71 = 6 and rn > 2 repeats from ev window w as (partition by user_id, week order by rn)),
  gd as (select *, row_number() over (partition by user_id, week, case when repeats then 'inp_1' else 'inp_' || rn end order by rn) > 1 dup from lg)"""


def _replay(ordered: bool) -> str:
    gap = "user_id % 10 = 3 and n_events > 1" if ordered else "false"
    cols = ", ".join(f"case when code is null then {x} else {k} end {k}" for k, x in _AFTER.items())
    return f"""with recursive {_LOG}, st as (
      select user_id, week, 0::bigint rn, 0::bigint n, null::varchar status, 0 step, 0 attempt, null::bigint due, null::varchar active, []::varchar[] issued, []::int[] comp, null::varchar code from gd where rn = 1
      union all select user_id, week, rn, case when code is null then n + 1 else n end, {cols}, code from (select *, coalesce(old, {_CODE}) code from (select *, {_MOVE} m from
        (select st.* exclude (rn, code), st.code old, gd.rn, kind, action, nxt, result, "at", deadline, resolution, pinned, dup from st join gd on gd.user_id = st.user_id and gd.week = st.week and gd.rn = st.rn + 1))))
      , fin as (select *, rn n_events from st qualify row_number() over (partition by user_id, week order by rn desc) = 1)
      select user_id, week as month, n_events, case when {gap} then 0 else n end n_applied, case when not ({gap}) then status end status, case when not ({gap}) and status is not null then step end step, case when not ({gap}) and status is not null then attempt end attempt,
        case when not ({gap}) then due end due, case when not ({gap}) then active end active, case when {gap} then 0 else len(comp) end::int n_compensable, case when {gap} then 'InvalidEventSequence' else coalesce(code, case when status is null then 'MissingStart' end) end code from fin"""


def _event_log(s: SparkSession, d: str) -> DataFrame:
    """Each user's months as saga logs of every kind of event, with repeated inputs, reused and missing ids, wrong pins and late timers among them."""
    w = W.partitionBy("user_id", "month").orderBy("ts", "event_id")
    e = saga_events(read(s, d, "events"), full=True).withColumn("month", F.date_trunc("month", "ts").cast("date").cast("string"))
    i, n, u = F.col("event_id"), F.col("rn"), F.col("user_id")
    e = e.withColumn("rn", F.row_number().over(w)).withColumn("sched", (F.col("result") == "R") & (i % 3 == 0))
    kind = (
        F.when((n == 1) & (u % 13 != 5) | (n > 4) & (i % 53 == 3), "Started").when(F.lag("sched").over(w), "RetryTimerFired").when(F.lag("result").over(w) == "U", "ManualResolution")
        .when(F.col("sched"), "RetryTimerScheduled").otherwise("ActionResult")
    )
    act = lambda x: F.concat(F.lit("act_"), x.cast("string"))
    return e.select(
        "user_id", "month", n.cast("long").alias("rn"), kind.alias("kind"), F.when(i % 97 == 5, "act_0").otherwise(act(n - 1)).alias("action"), F.when(i % 101 == 3, F.lit(None)).when(i % 89 == 4, "act_1").otherwise(act(n)).alias("next"), "result",
        (n * 5000).cast("long").alias("at"), F.when(i % 4 == 0, n * 5000 + 1500).cast("long").alias("deadline"), F.element_at(F.array(*map(F.lit, ("RetryAction", "Compensate", "Cancel", "Escalate"))), (i % 4 + 1).cast("int")).alias("resolution"), (u % 17 != 3).alias("pinned"),
        F.when((i % 71 == 6) & (n > 2), "inp_1").otherwise(F.concat(F.lit("inp_"), n.cast("string"))).alias("input_id"), F.when((u % 10 == 3) & (n == 2), 5).otherwise(n - 1).alias("sequence"),
    )


@query(_replay(False))
def L12_replay_events(s: SparkSession, d: str) -> DataFrame:
    return D.replay_events(_event_log(s, d), ["user_id", "month"], ["rn"], STEPS)


@query(_replay(True))
def L13_replay_ordered(s: SparkSession, d: str) -> DataFrame:
    return D.replay_events(_event_log(s, d), ["user_id", "month"], ["rn"], STEPS, sequence="sequence")


_ROW = """r as (select o_orderkey, [null, 'Running', 'Compensating', 'Completed', 'Escalated', 'Cancelled', 'Running'][k % 7 + 1] status, (k // 7 % 3)::int step, (k // 21 % 3)::int attempt, case when k % 5 = 0 then 5000 end::bigint due, 'act_1' active, ['act_1'] issued,
    [[]::int[], [0]::int[], [0, 2]::int[]][case when k % 7 = 2 then 1 + k // 3 % 2 else k // 3 % 3 end + 1] comp, ['Started', 'ActionResult', 'RetryTimerScheduled', 'RetryTimerFired', 'ManualResolution'][c % 5 + 1] kind, case when c % 11 = 0 then 'act_9' else 'act_1' end action,
    case when c % 13 = 0 then null when c % 17 = 0 then 'act_1' else 'act_2' end nxt, ['S', 'R', 'T', 'U'][(k // 2 + c) % 4 + 1] result, (4000 + c % 3 * 1000)::bigint "at", case when c % 2 = 0 then 7500 end::bigint deadline, ['RetryAction', 'Compensate', 'Cancel', 'Escalate'][k // 5 % 4 + 1] resolution, c % 19 <> 0 pinned, false dup
    from (select o_orderkey, o_orderkey k, o_custkey c from orders))"""


def _one(where: str = "true", kind: str | None = None, result: str | None = None) -> str:
    swap = (f" replace ({', '.join([f'{chr(39)}{kind}{chr(39)} as kind'] * (kind is not None) + [f'{chr(39)}{result}{chr(39)} as result'] * (result is not None))})") if kind else ""
    cols = ", ".join(f"case when code is null then {x} end {k}" for k, x in _AFTER.items() if k not in ("issued", "comp"))
    return f"with {_ROW}, f as (select *{swap} from r where {where}) select o_orderkey, code, {cols}, case when code is null then len({_AFTER['comp']}) end::int n_compensable from (select *, {_CODE} code from (select *, {_MOVE} m from f))"


def _single(s: SparkSession, d: str, where: str = "true", kind: str | None = None, result: str | None = None) -> DataFrame:
    """One transition for each order, from a state and an event made of its keys."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    div = lambda x, n: F.floor(x / n)
    comps = F.array(F.array().cast("array<int>"), F.array(F.lit(0)), F.array(F.lit(0), F.lit(2)))
    act = lambda x: F.lit(x)
    state = F.struct(
        pick((None, "Running", "Compensating", "Completed", "Escalated", "Cancelled", "Running"), k % 7).alias("status"), (div(k, 7) % 3).cast("int").alias("step"), (div(k, 21) % 3).cast("int").alias("attempt"), F.when(k % 5 == 0, lit(5000)).alias("due"),
        F.lit("act_1").alias("active"), F.array(F.lit("act_1")).alias("issued"), F.get(comps, F.when(k % 7 == 2, 1 + div(k, 3) % 2).otherwise(div(k, 3) % 3).cast("int")).alias("comp"))
    event = F.struct(
        (F.lit(kind) if kind else pick(("Started", "ActionResult", "RetryTimerScheduled", "RetryTimerFired", "ManualResolution"), c % 5)).alias("kind"), F.when(c % 11 == 0, act("act_9")).otherwise(act("act_1")).alias("action"),
        F.when(c % 13 == 0, F.lit(None)).when(c % 17 == 0, act("act_1")).otherwise(act("act_2")).alias("next"), (F.lit(result) if result else pick(("S", "R", "T", "U"), (div(k, 2) + c) % 4)).alias("result"),
        (4000 + c % 3 * 1000).cast("long").alias("at"), F.when(c % 2 == 0, lit(7500)).alias("deadline"), pick(("RetryAction", "Compensate", "Cancel", "Escalate"), div(k, 5) % 4).alias("resolution"), (c % 19 != 0).alias("pinned"))
    rows = read(s, d, "orders").select("o_orderkey", state.alias("s"), event.alias("e")).where(where)
    code, after = D.decide(F.col("s"), F.col("e"), STEPS)
    return rows.select("o_orderkey", code.alias("code"), after.alias("x")).select("o_orderkey", "code", "x.status", "x.step", "x.attempt", "x.due", "x.active", F.when(F.col("code").isNull(), F.size("x.comp")).alias("n_compensable"))


@query(_one())
def L2_decide(s: SparkSession, d: str) -> DataFrame:
    return _single(s, d)


@query(_one("true", "Started"))
def L3_start(s: SparkSession, d: str) -> DataFrame:
    return _single(s, d, kind="Started")


@query(_one("true", "ActionResult"))
def L4_action_result(s: SparkSession, d: str) -> DataFrame:
    return _single(s, d, kind="ActionResult")


@query(_one("status = 'Running'", "ActionResult"))
def L5_forward_result(s: SparkSession, d: str) -> DataFrame:
    return _single(s, d, "s.status = 'Running'", "ActionResult")


@query(_one("status = 'Running'", "ActionResult", "T"))
def L6_begin_compensation(s: SparkSession, d: str) -> DataFrame:
    return _single(s, d, "s.status = 'Running'", "ActionResult", "T")


@query(_one("status = 'Compensating'", "ActionResult"))
def L7_compensation_result(s: SparkSession, d: str) -> DataFrame:
    return _single(s, d, "s.status = 'Compensating'", "ActionResult")


@query("select o_orderkey, case o_orderkey % 3 when 1 then 0 when 2 then 2 end last_step, case o_orderkey % 3 when 1 then 2 when 2 then 1 end attempts from orders")
def L8_compensation_for(s: SparkSession, d: str) -> DataFrame:
    comps = F.array(F.array().cast("array<int>"), F.array(F.lit(0)), F.array(F.lit(0), F.lit(2)))
    state = F.struct(F.get(comps, (F.col("o_orderkey") % 3).cast("int")).alias("comp"))
    last = D.last_compensable(state)
    return read(s, d, "orders").select("o_orderkey", last.alias("last_step"), D._of([x.compensation for x in STEPS], "int", last).alias("attempts"))


@query(_one("status = 'Running'", "ActionResult", "U"))
def L16_terminal_projection(s: SparkSession, d: str) -> DataFrame:
    return _single(s, d, "s.status = 'Running'", "ActionResult", "U")


@query("select event_id, ['Started', 'ActionResultObserved', 'RetryTimerScheduled', 'RetryTimerFired', 'ManualResolutionApplied'][event_id % 5 + 1] kind, 'inp_' || event_id input_id from events")
def L17_to_event(s: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("Start", "ActionResult", "RetryTimerScheduled", "RetryTimerFired", "ManualResolution")))
    i = F.col("event_id")
    return read(s, d, "events").select("event_id", D.to_event(F.get(kinds, (i % 5).cast("int"))).alias("kind"), F.concat(F.lit("inp_"), i.cast("string")).alias("input_id"))


# one step of the graph's walk in SQL, from s (state) and e (event) columns
_GTO = "element_at(map(['a|S','a|R','b|S','b|R','b|T','d|S','c|S','c|R','e|S','e|T'], ['b','a','c','d','!','b','e','c','!','!']), step || '|' || case when result in ('S', 'R') then result else 'T' end)[1]"
_GCODE = """case when dup then 'DuplicateInput' when (kind = 'Started') <> (status is null) then 'AlreadyStarted' when kind <> 'Started' and status <> 'Running' then 'NotRunning' when kind <> 'Started' and active is distinct from action then 'ActionMismatch'
  when kind <> 'Started' and result = 'U' then case when nxt is not null then 'ActionIdentityMismatch' end when kind <> 'Started' and t is null then 'MissingTransition' when kind <> 'Started' and t <> '!' then case when nxt is null then 'ActionIdentityMismatch' when list_contains(issued, nxt) then 'DuplicateActionId' when visit + 1 > 6 then 'VisitLimitExceeded' end
  when kind <> 'Started' and nxt is not null then 'ActionIdentityMismatch' end"""
_GAFTER = {
    "status": "case when kind = 'Started' or result <> 'U' and t <> '!' then 'Running' when result = 'S' then 'Completed' else 'Escalated' end",
    "step": "case when kind = 'Started' then 'a' when result = 'U' then step when t <> '!' then t end",
    "visit": "case when kind = 'Started' then 1 when result <> 'U' and t <> '!' then visit + 1 else visit end",
    "active": "case when kind = 'Started' or result <> 'U' and t <> '!' then nxt end",
    "issued": "case when kind = 'Started' then [nxt] when result <> 'U' and t <> '!' then list_append(issued, nxt) else issued end",
}
_GLOG = """ev as (select user_id, week, rn, event_id, r from (select user_id, date_trunc('month', ts)::date::varchar as week, row_number() over (partition by user_id, date_trunc('month', ts) order by ts, event_id) rn, event_id,
    case when value < 10 then 'T' when value > 150 then 'U' when event_type = 'error' then 'R' else 'S' end r from events)),
  gd as (select *, case when rn = 1 and user_id % 13 <> 5 or event_id % 53 = 3 then 'Started' else 'ActionResult' end kind, case when event_id % 97 = 5 then 'act_0' else 'act_' || (rn - 1) end action, case when rn > 1 and (r = 'U' or event_id % 7 = 0) then null when event_id % 29 = 4 then 'act_1' else 'act_' || rn end nxt, r result,
    event_id % 31 = 6 and rn > 2 dup from ev)"""


def _graph_log(s: SparkSession, d: str) -> DataFrame:
    """Each user's months as graph saga logs, with repeated inputs, wrong and missing action ids among them."""
    w = W.partitionBy("user_id", "month").orderBy("ts", "event_id")
    e = saga_events(read(s, d, "events"), full=True).withColumn("month", F.date_trunc("month", "ts").cast("date").cast("string")).withColumn("rn", F.row_number().over(w))
    i, n, u = F.col("event_id"), F.col("rn"), F.col("user_id")
    act = lambda x: F.concat(F.lit("act_"), x.cast("string"))
    return e.select(
        "user_id", "month", n.cast("long").alias("rn"), F.when((n == 1) & (u % 13 != 5) | (i % 53 == 3), "Started").otherwise("ActionResult").alias("kind"), F.when(i % 97 == 5, "act_0").otherwise(act(n - 1)).alias("action"),
        F.when((n > 1) & ((F.col("result") == "U") | (i % 7 == 0)), F.lit(None)).when(i % 29 == 4, "act_1").otherwise(act(n)).alias("next"), "result",
        F.when((i % 31 == 6) & (n > 2), "inp_1").otherwise(F.concat(F.lit("inp_"), n.cast("string"))).alias("input_id"), F.when((u % 10 == 3) & (n == 2), 5).otherwise(n - 1).alias("sequence"))


_GSTEP = ", ".join(f"case when code is null then {x} else {k} end {k}" for k, x in _GAFTER.items())


@query(f"""with recursive {_GLOG}, st as (
      select user_id, week, 0::bigint rn, 0::bigint n, null::varchar status, null::varchar step, null::int visit, null::varchar active, []::varchar[] issued, null::varchar code from gd where rn = 1
      union all select user_id, week, rn, case when code is null then n + 1 else n end, {_GSTEP}, code from (select *, coalesce(old, {_GCODE}) code from (select *, {_GTO} t from
        (select st.* exclude (rn, code), st.code old, gd.rn, kind, action, nxt, result, dup from st join gd on gd.user_id = st.user_id and gd.week = st.week and gd.rn = st.rn + 1))))
      , fin as (select *, rn n_events, user_id % 10 = 3 and rn > 1 gap from st qualify row_number() over (partition by user_id, week order by rn desc) = 1)
      select user_id, week as month, n_events, case when gap then 0 else n end n_applied, case when not gap then status end status, case when not gap then step end step, case when not gap then visit end visit, case when not gap then active end active, case when gap then 'SequenceMismatch' else code end code from fin""")
def G6_replay_ordered(s: SparkSession, d: str) -> DataFrame:
    return G.replay_ordered(_graph_log(s, d), ["user_id", "month"], ["rn"], EDGES, "a", 6)


_GROW = """r as (select o_orderkey, case when k % 9 = 0 then null when k % 9 = 1 then 'Completed' else 'Running' end status, case when k % 9 = 0 then null else ['a', 'b', 'c', 'd', 'e'][k // 9 % 5 + 1] end step, (k // 45 % 6 + 1)::int visit, 'act_1' active, ['act_1'] issued,
    case when c % 9 = 0 then 'Started' else 'ActionResult' end kind, case when c % 11 = 0 then 'act_9' else 'act_1' end action, case when c % 3 = 0 then null when c % 17 = 0 then 'act_1' else 'act_2' end nxt, ['S', 'R', 'T', 'U'][(k // 2 + c) % 4 + 1] result, false dup from (select o_orderkey, o_orderkey k, o_custkey c from orders))"""


@query(f"with {_GROW} select o_orderkey, code, " + ", ".join(f"case when code is null then {x} end {k}" for k, x in _GAFTER.items() if k != "issued") + f" from (select *, {_GCODE} code from (select *, {_GTO} t from r))")
def G3_apply_result(s: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    state = F.struct(
        F.when(k % 9 == 1, "Completed").when(k % 9 != 0, "Running").alias("status"), F.when(k % 9 != 0, pick("abcde", F.floor(k / 9) % 5)).alias("step"), (F.floor(k / 45) % 6 + 1).cast("int").alias("visit"), F.lit("act_1").alias("active"), F.array(F.lit("act_1")).alias("issued"))
    event = F.struct(
        F.when(c % 9 == 0, "Started").otherwise("ActionResult").alias("kind"), F.when(c % 11 == 0, "act_9").otherwise("act_1").alias("action"), F.when(c % 3 == 0, F.lit(None)).when(c % 17 == 0, "act_1").otherwise("act_2").alias("next"), pick("SRTU", (F.floor(k / 2) + c) % 4).alias("result"))
    rows = read(s, d, "orders").select("o_orderkey", state.alias("s"), event.alias("e"))
    code, after = G.decide(F.col("s"), F.col("e"), EDGES, "a", 6)
    return rows.select("o_orderkey", code.alias("code"), F.when(code.isNull(), after).alias("x")).select("o_orderkey", "code", "x.status", "x.step", "x.visit", "x.active")


@query("select o_orderkey, 'Running' status, 'a' step, 1 visit, 'act_' || o_orderkey active, 1 n_issued from orders")
def G2_start(s: SparkSession, d: str) -> DataFrame:
    state = G.start("a", F.concat(F.lit("act_"), F.col("o_orderkey").cast("string")))
    return read(s, d, "orders").select("o_orderkey", state.alias("x")).select("o_orderkey", "x.status", "x.step", "x.visit", "x.active", F.size("x.issued").alias("n_issued"))


@query("select event_id, case when value < 10 or value > 150 then 'T' when event_type = 'error' then 'R' else 'S' end label from events")
def G4_transition_outcome(s: SparkSession, d: str) -> DataFrame:
    return saga_events(read(s, d, "events"), full=True).select("event_id", G.transition_outcome(F.col("result")).alias("label"))


@query("select l_orderkey, l_linenumber, l_partkey, l_extendedprice, case when l_suppkey % 5 = 0 then 'ActionIdentityMismatch' when l_partkey % 4 = l_linenumber % 4 then 'DuplicateActionId' end code from lineitem")
def G8_new_action(s: SparkSession, d: str) -> DataFrame:
    name = lambda x: F.concat(F.lit("act_"), (x % 4).cast("string"))
    x = read(s, d, "lineitem")
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", G.new_action_code(F.array(F.lit("act_x"), name(F.col("l_linenumber"))), F.when(F.col("l_suppkey") % 5 != 0, name(F.col("l_partkey")))).alias("code"))


@query("""select event_id, 'InputAccepted,' || case when event_id % 6 = 0 then 'Started' when value < 10 then 'ActionFailed' when value > 150 then 'ActionOutcomeUnknown' when event_type = 'error' then 'ActionFailed' else 'ActionSucceeded' end observed,
    case when event_id % 3 = 0 then 'ActionPlanned' else ['Completed', 'Escalated', 'Cancelled', 'Compensated', ''][event_id % 5 + 1] end planned from events""")
def G9_outcome_kinds(s: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    status = F.get(F.array(*map(F.lit, ("Completed", "Escalated", "Cancelled", "Compensated", "Running"))), (i % 5).cast("int"))
    return saga_events(read(s, d, "events"), full=True).select(
        "event_id", F.array_join(G.observed_kinds(F.when(i % 6 == 0, "Started").otherwise("ActionResult"), F.col("result")), ",").alias("observed"), F.array_join(G.planned_kinds(status, F.when(i % 3 == 0, "act")), ",").alias("planned"))
