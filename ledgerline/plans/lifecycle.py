"""Queries of definitions, retries, outcomes and scalar formats, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.operators import definitions as D
from ledgerline.operators import retry as T
from ledgerline.operators import saga as L
from ledgerline.plans.oracles import _EFFECT, _EV, _SCOPE, NOW, ORACLES, _linear
from ledgerline.plans.queries import ORDER, PROCESS, QUERIES, L12_replay_full, _effect_key, _scope, lit
from ledgerline.sources.tables import millis, read, saga_events


def query(sql: str):
    """Register a query and its SQL under the function's name."""

    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


@query("""select o_orderkey, coalesce(n, 0) n_steps, case when n is null then 'EmptyDefinition' when u < n then 'DuplicateStepId' when most > 64 then 'RetryAttemptLimitExceeded' end code
  from (select o_orderkey from orders) left join (select l_orderkey, count(*) n, count(distinct l_partkey % 20) u, max(greatest(l_quantity::bigint, case when l_returnflag = 'R' then l_quantity::bigint * 2 end)) most from lineitem where l_orderkey % 9 <> 4 group by 1) on l_orderkey = o_orderkey""")
def L1_definition(s: SparkSession, d: str) -> DataFrame:
    steps = read(s, d, "lineitem").where("l_orderkey % 9 <> 4").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_partkey") % 20).alias("step"), F.col("l_quantity").cast("long").alias("a"), F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("long") * 2).alias("c"))
    return D.validate_linear(read(s, d, "orders"), steps, "o_orderkey", "step", "a", "c")


@query("""with recursive g as (select o_orderkey g, o_orderkey % 3 entry from orders), n as (select distinct g, l_linenumber % 5 step from g join lineitem on l_orderkey = g),
  e as (select g, l_linenumber % 5 src, l_returnflag outcome, case when l_partkey % 6 > 0 then l_partkey % 6 - 1 end dst from g join lineitem on l_orderkey = g),
  w(g, step) as (select g, entry from g union select w.g, dst from w join e on e.g = w.g and src = step where dst is not null)
  select g.g, case when not exists (select 1 from n where n.g = g.g) then 'EmptySteps' when not exists (select 1 from n where n.g = g.g and step = entry) then 'UnknownEntryStep'
    when exists (select 1 from e where e.g = g.g and dst is not null and not exists (select 1 from n where n.g = e.g and step = dst)) then 'UnknownDestinationStep' when exists (select 1 from e where e.g = g.g and dst is null and outcome = 'R') then 'MissingDestination'
    when (select count(*) - count(distinct (src, outcome)) from e where e.g = g.g) > 0 then 'DuplicateTransition' when exists (select 1 from n where n.g = g.g and not exists (select 1 from w where w.g = n.g and w.step = n.step)) then 'UnreachableStep' end code from g""")
def G1_definition(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    g = read(s, d, "orders").select(k.alias("g"), (k % 3).alias("entry"))
    x = read(s, d, "lineitem").select(F.col("l_orderkey").alias("g"), (F.col("l_linenumber").cast("long") % 5).alias("src"), F.col("l_returnflag").alias("outcome"), F.when(F.col("l_partkey") % 6 > 0, F.col("l_partkey") % 6 - 1).alias("dst"))
    return D.validate_graph(g, x.select("g", F.col("src").alias("step")).distinct(), x, "g")


@query("select o_orderkey, case when least(o_orderkey % 5, o_custkey % 7, o_orderkey % 11) < 1 or o_custkey % 9 < 4 then 'InvalidDefinition' end code from orders")
def K1_task_definition(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(s, d, "orders").select("o_orderkey", D.task_definition_code(lit(1), k % 5, F.col("o_custkey") % 7, k % 11, lit(9), F.col("o_custkey") % 9).alias("code"))


@query("select o_orderkey, case when o_custkey * 700 > 1000000 then 'CapacityExceeded' when o_orderkey * 50 > o_custkey * 700 then 'QuotaExceeded' end code from orders")
def R12_quota(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(s, d, "orders").select("o_orderkey", D.quota_code(k * 50, F.col("o_custkey") * 700).alias("code"))


@query("select doc_id, case when strlen(text) > 4096 then 'TooLarge' end code from documents")
def R13_diagnostic(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").select("doc_id", D.diagnostic_code(F.col("text")).alias("code"))


def _retries(s, d):
    k = F.col("o_orderkey")
    return read(s, d, "orders").select(
        "o_orderkey", F.when(k % 13 == 0, "Escalated").otherwise("Running").alias("status"), (k % 4).alias("attempt"), F.when(k % 11 == 0, millis("o_orderdate")).alias("retry_due_at"), (k % 17 != 0).alias("active"),
        F.when(F.col("o_orderstatus") == "P", "S").otherwise("R").alias("result"), (k % 7 != 0).alias("backoff"), F.when(k % 2 == 0, millis("o_orderdate") + 3000).alias("deadline"), (F.col("o_custkey") % 2).alias("n_compensable"), "o_orderdate")


_RETRY = """p as (select *, o_orderkey k, epoch_ms(o_orderdate) t, case when o_orderkey % 13 = 0 then 'TerminalProjection' when o_orderkey % 17 = 0 then 'UnexpectedAction' when o_orderkey % 11 = 0 then 'RetryTimerMustFire' when o_orderstatus = 'P' then 'RetryTimerRequiresRetryableFailure'
  when o_orderkey % 7 = 0 then 'RetryTimerNotConfigured' when o_orderkey % 4 + 1 >= 4 then 'RetryTimerNotRequired' end code from orders), q as (select *, t + least(60000, 1000 * 2 ** (k % 4))::bigint due, code is null and k % 2 = 0 and least(60000, 1000 * 2 ** (k % 4)) > 3000 late from p)"""


@query(f"""with {_RETRY} select o_orderkey, code, case when k % 13 = 0 then 'Escalated' when late and o_custkey % 2 = 1 then 'Compensating' when late then 'Escalated' else 'Running' end status,
  case when code is not null or late and o_custkey % 2 = 0 then k % 4 when late then 0 else k % 4 + 1 end next_attempt, case when late then null when code is null then due when k % 11 = 0 then t end retry_due_at from q""")
def L9_timer_schedule(s: SparkSession, d: str) -> DataFrame:
    return T.schedule(_retries(s, d), millis("o_orderdate"), 1000, 60000, 4).select("o_orderkey", "code", "status", "next_attempt", "retry_due_at")


@query(f"select o_orderkey, case when o_orderkey % 13 = 0 then 'TerminalProjection' when o_orderkey % 17 = 0 or o_orderkey % 11 <> 0 then 'UnexpectedRetryTimer' when {NOW} < epoch_ms(o_orderdate) then 'RetryTimerFiredEarly' end code from orders")
def L10_timer_fire(s: SparkSession, d: str) -> DataFrame:
    return T.fire(_retries(s, d), lit(NOW)).select("o_orderkey", "code")


@query(f"""with {_EV.format(full="true")}, z as (select *, case when r = 'S' then ['InputAccepted', 'ActionSucceeded', 'ActionPlanned'] else ['InputAccepted', case when r = 'U' then 'ActionOutcomeUnknown' else 'ActionFailed' end] end ks from ev),
  y as (select *, coalesce(sum(len(ks)) over (partition by user_id, week order by rn rows between unbounded preceding and 1 preceding), 0) base from z), x as (select user_id, week, event_id, base, ks, unnest(range(1, len(ks) + 1)) i from y)
  select user_id, week, event_id, (base + i - 1)::bigint as sequence, ks[i] kind from x""")
def L21_outcomes(s: SparkSession, d: str) -> DataFrame:
    e = saga_events(read(s, d, "events"), full=True)
    planned = F.when(F.col("result") == "S", F.array(F.lit("ActionPlanned"))).otherwise(F.array().cast("array<string>"))
    return T.outcomes(e, PROCESS, ORDER, F.concat(L.observed_kinds(F.lit("ActionResult"), F.col("result")), planned)).select("user_id", "week", "event_id", "sequence", "kind")


@query(f"with {_EV.format(full='true')} select event_id, not (r = 'S' and event_id % 6 = 0) and (r <> 'R' or event_id % 4 <> 0) matches from ev")
def L20_outcome_plan_check(s: SparkSession, d: str) -> DataFrame:
    e = saga_events(read(s, d, "events"), full=True)
    seen = L.observed_kinds(F.lit("ActionResult"), F.col("result"))
    planned = F.when(F.col("result") == "S", F.array(F.lit("ActionPlanned"))).otherwise(F.array().cast("array<string>"))
    i = F.col("event_id")
    wrong = F.when((F.col("result") == "S") & (i % 6 == 0), F.reverse(F.concat(seen, planned))).when((F.col("result") == "R") & (i % 4 == 0), F.slice(seen, 1, 1)).otherwise(F.concat(seen, planned))
    return e.select("event_id", T.kinds_match(wrong, seen, planned).alias("matches"))


@query(f"with {_RETRY} select o_orderkey, due retry_due_at from q where code is null and not late union all select o_orderkey, t from q where code = 'RetryTimerMustFire'")
def L22_timer_request(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    told = T.schedule(_retries(s, d), millis("o_orderdate"), 1000, 60000, 4).withColumn("next_action", F.when(F.col("status") == "Running", F.concat(F.lit("act_"), k.cast("string"))))
    return T.timer_schedules(told).where("code is null or code = 'RetryTimerMustFire'").select("o_orderkey", "retry_due_at")


@query(_linear(True, True) + " select user_id, week, case when status <> 'Escalated' then 'ManualReviewNotRequired' when user_id % 3 = 0 then 'OutcomeScopeMismatch' end code from fin")
def L23_review_request(s: SparkSession, d: str) -> DataFrame:
    return T.review_requests(L12_replay_full(s, d), F.col("user_id") % 3 != 0).select("user_id", "week", "code")


@query("""select o_orderkey, '{"tenant_id":"tnt_' || o_custkey || '","attempt":' || (o_orderkey % 64) || ',"due":' || case when o_orderkey % 3 = 0 then o_orderkey::varchar else 'null' end || ',"digest":[' ||
  array_to_string([('0x' || substr(sha256(o_orderstatus), 2 * i - 1, 2))::int for i in range(1, 33)], ',') || ']}' wire from orders""")
def S13_wire(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    w = S.wire_json(F.concat(F.lit("tnt_"), F.col("o_custkey").cast("string")).alias("tenant_id"), (k % 64).alias("attempt"), F.when(k % 3 == 0, k).alias("due"), S.digest_numbers(F.unhex(F.sha2("o_orderstatus", 256))).alias("digest"))
    return read(s, d, "orders").select("o_orderkey", w.alias("wire"))


@query("select o_orderkey, case when o_orderkey % 7 = 0 then null when o_orderkey % 5 = 0 then 'inp ' || o_orderkey else 'inp_' || o_orderkey end input_id, case when o_orderkey % 7 = 0 then 'Malformed' when o_orderkey % 5 = 0 then 'InvalidIdentifier' end code from orders")
def S14_parse(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.concat(F.when(k % 5 == 0, "inp ").otherwise("inp_"), k.cast("string"))
    data = F.when(k % 7 == 0, F.lit('{"input_id":')).otherwise(F.to_json(F.struct(name.alias("input_id"))))
    x = read(s, d, "orders").select("o_orderkey", S.parse_envelope(data, "input_id string").alias("x")).select("o_orderkey", "x.input_id")
    return x.withColumn("code", F.when(F.col("input_id").isNull(), "Malformed").when(~S.valid_identifier(F.col("input_id"), "inp_"), "InvalidIdentifier"))


_U = "unhex(lpad(to_hex({0}), {1}, '0'))"


_PRINT = "sha256(encode('task') || unhex('00') || unhex(sha256(o_orderstatus)) || " + " || ".join(_U.format(a, b) for a, b in (("1", 8), ("0", 2), ("o_orderkey % 4", 2), ("3", 8), ("o_custkey", 16), ("50", 16), ("4096", 8), ("1", 8), ("2", 8), ("3", 8), ("4", 8), ("o_orderkey", 16), ("9", 16))) + ")"


def _fingerprint():
    """The fingerprint of an order's task definition."""
    k = F.col("o_orderkey")
    return S.task_fingerprint(b"task\0", F.unhex(F.sha2("o_orderstatus", 256)), lit(1), lit(0), k % 4, lit(3), F.col("o_custkey"), lit(50), lit(4096), [lit(i) for i in (1, 2, 3, 4)], k, lit(9))


@query(f"select o_orderkey, {_PRINT} digest from orders")
def S15_fingerprint(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "orders").select("o_orderkey", _fingerprint().alias("digest"))


@query("select doc_id, case when doc_id % 5 = 0 then 'SchemaMismatch' when doc_id % 3 = 0 then 'LengthMismatch' when doc_id % 2 = 0 then 'DigestMismatch' end code from documents")
def S16_blob(s: SparkSession, d: str) -> DataFrame:
    i, t = F.col("doc_id"), F.coalesce("text", F.lit("")).cast("binary")
    code = S.blob_code(F.when(i % 5 == 0, 2).otherwise(1), F.lit(1), t, F.octet_length(t) + F.when(i % 3 == 0, 1).otherwise(0), F.when(i % 2 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2(t, 256)))
    return read(s, d, "documents").select("doc_id", code.alias("code"))


@query(f"select o_orderkey, 'inp_task_' || sha256(encode('relay') || unhex('00') || {_EFFECT} || unhex({_PRINT}) || encode('act_' || o_orderkey)) input_id, case o_orderstatus when 'F' then 'succeeded' when 'O' then 'terminal_failure' else 'unknown' end observation from orders")
def S18_relay(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    who = S.tagged_identity("inp_task_", b"relay\0", _effect_key(), F.unhex(_fingerprint()), F.concat(F.lit("act_"), k.cast("string")).cast("binary"))
    seen = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "terminal_failure").otherwise("unknown")
    return read(s, d, "orders").select("o_orderkey", who.alias("input_id"), seen.alias("observation"))


@query(f"select o_orderkey, sha256('tnt_' || o_custkey) tenant, sha256({_SCOPE}) task, sha256(unhex(sha256('tnt_' || o_custkey)) || unhex(sha256({_SCOPE}))) scope_digest from orders where o_orderkey % 4 = 1")
def S19_task_scope(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    tenant, task = F.sha2(F.concat(F.lit("tnt_"), F.col("o_custkey").cast("string")), 256), F.sha2(_scope(), 256)
    return read(s, d, "orders").where(k % 4 == 1).select("o_orderkey", tenant.alias("tenant"), task.alias("task"), F.sha2(F.concat(F.unhex(tenant), F.unhex(task)), 256).alias("scope_digest"))


@query("select o_orderkey, ['Availability', 'Availability', 'Conflict', 'Authorization', 'Invariant', 'Invariant', 'Timeout', 'Ambiguous'][o_orderkey % 8 + 1] as class from orders")
def S20_error_class(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    names = F.array(*map(F.lit, ("Unavailable", "Cancelled", "Conflict", "Unauthorized", "QuotaExceeded", "Invariant", "TimedOut", "Ambiguous")))
    return read(s, d, "orders").select("o_orderkey", S.error_class(F.element_at(names, (k % 8 + 1).cast("int"))).alias("class"))


@query("""select o_orderkey, 30 + (o_orderkey % 6 = 0)::int n_bytes, case when o_orderkey % 6 = 0 then 'InvalidLength' end code, case when o_orderkey % 6 <> 0 then o_orderkey end as "first", case when o_orderkey % 6 <> 0 then o_custkey end as "second" from orders""")
def S21_record(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    data = S.encode_record(b"timeline-head", lit(2), [k, F.col("o_custkey")])
    data = F.when(k % 6 == 0, F.concat(data, F.unhex(F.lit("00")))).otherwise(data)
    x = read(s, d, "orders").select("o_orderkey", data.alias("x"))
    code = S.record_code(F.col("x"), b"timeline-head", 2)
    return x.select("o_orderkey", F.octet_length("x").alias("n_bytes"), code.alias("code"), F.when(code.isNull(), S.read_little_endian(F.col("x"), 15)).alias("first"), F.when(code.isNull(), S.read_little_endian(F.col("x"), 23)).alias("second"))
