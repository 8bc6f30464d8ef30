"""Queries that hold two kinds of records against each other, and folds of the caller's own and of streams, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.functions import wire
from ledgerline.operators import commits, definitions, folds, leases, logs
from ledgerline.operators import correlate as R
from ledgerline.plans.lifecycle import _PRINT, _fingerprint, query
from ledgerline.plans.oracles import _BOX, _EFFECT, _IN, _OUT, _SCOPE, NOW, ORACLES
from ledgerline.plans.queries import _effect_key, _inputs, _outbox, _outcomes, _scope, lit
from ledgerline.plans.stores import _CAS
from ledgerline.sources.tables import read, scratch
from ledgerline.streaming import inbox


def _of(x, n: int, name: str):
    return F.concat(F.lit(name), (x % n).cast("string"))


@query("select o_orderkey, sha256(unhex(lpad(to_hex(strlen(o_orderpriority)), 4, '0')) || encode(o_orderpriority)) digest from orders")
def S5_encode_identifier(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "orders").select("o_orderkey", F.sha2(S.encode_identifier(F.col("o_orderpriority")), 256).alias("digest"))


@query("select n_regionkey, case when n_regionkey % 3 = 1 then 'DigestMismatch' end code from nation group by 1")
def S9_canonical_digest(s: SparkSession, d: str) -> DataFrame:
    steps = read(s, d, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list("n_name")), lambda x: F.concat(F.lit("stp_"), x)).alias("steps"))
    derived = F.sha2(S.definition_bytes(F.lit("def_region"), F.lit("ver_1"), F.col("steps")), 256)
    stored = F.when(F.col("n_regionkey") % 3 == 1, F.sha2(F.lit("other"), 256)).otherwise(derived)
    return steps.select("n_regionkey", definitions.require_digest(stored, derived).alias("code"))


_DEFS = "df as (select c_custkey id, c_nationkey % 3 v, c_nationkey % 2 g, [c_nationkey % 2, 7] st from customer where c_custkey % 7 <> 0)"


def _definitions(s: SparkSession, d: str) -> DataFrame:
    n = F.col("c_nationkey").cast("long")
    return read(s, d, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("definition"), (n % 3).alias("version"), (n % 2).alias("digest"), F.array(n % 2, lit(7)).alias("steps"))


@query(f"with {_DEFS} select o_orderkey, case when id is null or v <> o_orderkey % 3 then 'Incompatible' when g <> o_orderkey % 2 or st <> [o_orderkey % 2, 7 + (o_orderkey % 11 = 0)::int] then 'RequiresMigration' else 'Exact' end compatibility, compatibility = 'Exact' exact from orders left join df on id = o_custkey")
def S10_compatibility(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    pins = read(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("definition"), (k % 3).alias("version"), (k % 2).alias("digest"), F.array(k % 2, F.when(k % 11 == 0, lit(8)).otherwise(lit(7))).alias("steps"))
    return definitions.compare_pins(pins, _definitions(s, d), "o_orderkey")


@query(f"""with {_DEFS}, m as (select o_orderkey, o_custkey a, o_orderkey % 2 ad, case when o_orderkey % 4 = 0 then o_custkey else o_custkey + 1 end b, case when o_orderkey % 4 = 0 then o_orderkey % 2 else o_orderkey // 2 % 2 end bd from orders)
  select o_orderkey, case when a = b and ad = bd then 'NoOp' when x.g is distinct from ad then 'SourceMismatch' when y.g is distinct from bd then 'DestinationMismatch' end code from m left join df x on x.id = a left join df y on y.id = b""")
def S11_migration(s: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    asked = read(s, d, "orders").select(
        "o_orderkey", c.alias("source"), (k % 2).alias("source_digest"), F.when(k % 4 == 0, c).otherwise(c + 1).alias("destination"), F.when(k % 4 == 0, k % 2).otherwise((F.floor(k / 2) % 2).cast("long")).alias("destination_digest"))
    return definitions.validate_migrations(asked, _definitions(s, d), "o_orderkey")


@query("""with i as (select c_custkey id, case when c_custkey % 5 = 0 then 'Command' else 'CanonicalEvent' end k, 's' || c_nationkey % 3 sc, c_custkey % 2 g from customer where c_custkey % 9 <> 0), c as (select s_suppkey id, 's' || s_nationkey % 3 sc from supplier)
  select o_orderkey, case when k is distinct from 'CanonicalEvent' then 'InputKindMismatch' when i.sc <> 's' || o_orderkey % 3 then 'InputScopeMismatch' when g <> o_orderkey % 2 then 'InputPayloadDigestMismatch' when c.sc is distinct from 's' || o_orderkey % 3 then 'CommitScopeMismatch' end code
  from orders left join i on i.id = o_custkey left join c on c.id = o_orderkey % 12""")
def R3_bind_event(s: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    events = read(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("input_id"), (k % 12).alias("commit_id"), _of(k, 3, "s").alias("scope"), (k % 2).alias("digest"))
    inputs = read(s, d, "customer").where("c_custkey % 9 <> 0").select(c.alias("input_id"), F.when(c % 5 == 0, "Command").otherwise("CanonicalEvent").alias("kind"), _of(F.col("c_nationkey"), 3, "s").alias("scope"), (c % 2).alias("digest"))
    held = read(s, d, "supplier").select(F.col("s_suppkey").alias("commit_id"), _of(F.col("s_nationkey"), 3, "s").alias("scope"))
    return R.bind_events(events, inputs, held, "o_orderkey")


@query("""with a as (select l_orderkey k, min(l_suppkey) % 3 sc, min(l_partkey) % 4 ac, max(l_returnflag) ev, max(l_linestatus) tn from lineitem where l_orderkey % 8 <> 3 group by 1)
  select o_orderkey, case when sc is distinct from o_custkey % 3 then 'ScopeMismatch' when ac <> o_custkey % 4 then 'ActionMismatch' when ev <> 'R' then 'EvidenceMismatch' when tn <> o_orderstatus then 'TenantMismatch' end code from orders left join a on k = o_orderkey""")
def R6_reconciliation(s: SparkSession, d: str) -> DataFrame:
    c = F.col("o_custkey")
    acts = read(s, d, "lineitem").where("l_orderkey % 8 <> 3").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.min("l_suppkey") % 3).alias("scope"), (F.min("l_partkey") % 4).alias("action"), F.max("l_returnflag").alias("evidence"), F.max("l_linestatus").alias("tenant"))
    found = read(s, d, "orders").select("o_orderkey", (c % 3).alias("scope"), (c % 4).alias("action"), F.lit("R").alias("evidence"), F.col("o_orderstatus").alias("tenant"))
    return R.check_reconciliations(found, acts, "o_orderkey")


@query("""with r as (select l_orderkey k, min(l_suppkey) % 2 sc, max(l_returnflag) op from lineitem group by 1) select o_orderkey, case when sc is distinct from o_custkey % 2 then 'ScopeMismatch' when op <> case o_orderstatus when 'F' then 'R' else 'N' end then 'OperationMismatch' end code from orders left join r on k = o_orderkey""")
def R10_review_audit(s: SparkSession, d: str) -> DataFrame:
    reviews = read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.min("l_suppkey") % 2).alias("scope"), F.max("l_returnflag").alias("operation"))
    audits = read(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 2).alias("scope"), F.when(F.col("o_orderstatus") == "F", "R").otherwise("N").alias("operation"))
    return R.check_audits(audits, reviews, "o_orderkey")


@query(f"select o_orderkey, 'inp_task_' || sha256(encode('relay') || unhex('00') || {_EFFECT} || unhex({_PRINT}) || encode('act_' || o_orderkey)) input_id, case o_orderstatus when 'F' then 'succeeded' when 'O' then 'terminal_failure' else 'unknown' end observation from orders")
def R16_result_relay(s: SparkSession, d: str) -> DataFrame:
    who = S.tagged_identity("inp_task_", b"relay\0", _effect_key(), F.unhex(_fingerprint()), F.concat(F.lit("act_"), F.col("o_orderkey").cast("string")).cast("binary"))
    status = F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "O", "Exhausted").otherwise("Faulted")
    who, seen = R.relay(who, status)
    return read(s, d, "orders").select("o_orderkey", who.alias("input_id"), seen.alias("observation"))


@query(f"select o_orderkey, sha256(unhex(sha256('tnt_' || o_custkey)) || unhex(sha256({_SCOPE})) || unhex({_PRINT}) || unhex(sha256(o_orderstatus))) digest from orders")
def S22_scope_digest(s: SparkSession, d: str) -> DataFrame:
    parts = [F.unhex(F.sha2(F.concat(F.lit("tnt_"), F.col("o_custkey").cast("string")), 256)), F.unhex(F.sha2(_scope(), 256)), F.unhex(_fingerprint()), F.unhex(F.sha2("o_orderstatus", 256))]
    return read(s, d, "orders").select("o_orderkey", F.sha2(F.concat(*parts), 256).alias("digest"))


@query(_CAS.replace("case when l_suppkey % 3 = 0 then l_suppkey::varchar end i", "null::varchar i") + " select key l_orderkey, v verdict, count(*) n from st where rn > 0 group by 1, 2")
def C8_append_outcomes(s: SparkSession, d: str) -> DataFrame:
    x = read(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_linenumber") - 1 - F.when(F.col("l_partkey") % 4 == 0, 1).otherwise(0)).alias("e"), F.lit(1).alias("n"), F.sha2("l_returnflag", 256).alias("d"), F.lit(None).cast("string").alias("i"))
    told = commits.commit_log(x, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "e", "n", "d", "i", limit=3)
    return told.groupBy("l_orderkey", "verdict").agg(F.count("*").alias("n"))


@query(f"""with {_OUT}, h as (select conv_id, max(turn) + 1 + (conv_id % 5 = 0)::int head from o group by 1), g as (select conv_id, count(*) filter (where turn >= 2 and turn < 5) n, max(turn) filter (where turn >= 2 and turn < 5) last from o where not (conv_id % 7 = 3 and turn = 3) group by 1),
  w as (select h.conv_id, head, coalesce(n, 0) n, last, least(greatest(head - 2, 0), 3) want from h left join g using (conv_id))
  select conv_id, n, case when n = want and coalesce(last, 1) = 1 + want and 2 + want < head then 2 + want end "next", case when n <> want or coalesce(last, 1) <> 1 + want then 'CorruptLog' end code from w""")
def C5_read_outcomes(s: SparkSession, d: str) -> DataFrame:
    o = _outcomes(s, d).select("conv_id", F.col("turn").cast("long").alias("turn"))
    heads = o.groupBy("conv_id").agg(F.max("turn").alias("m")).select("conv_id", (F.col("m") + 1 + F.when(F.col("conv_id") % 5 == 0, 1).otherwise(0)).alias("next_sequence"))
    return logs.read_outcomes(o.where(~((F.col("conv_id") % 7 == 3) & (F.col("turn") == 3))), heads, "conv_id", "turn", 2, 3)


@query(f"with {_BOX}, t as (select scope, attempt from b where not acknowledged and (expires_at is null or expires_at < {NOW}) and scope <> '1-URGENT' or not acknowledged and attempt < 64 and scope = '1-URGENT' qualify row_number() over (partition by scope order by action_id) <= 20) select scope, case when max(attempt) < 64 then count(*) else 0 end n, max(attempt) worst, case when max(attempt) >= 64 then 'QuotaExceeded' end code from t group by 1")
def O2_attempt_ceiling(s: SparkSession, d: str) -> DataFrame:
    urgent = F.col("scope") == "1-URGENT"
    box = _outbox(s, d).where(~urgent | (F.col("attempt") < 64)).withColumn("expires_at", F.when(~urgent, F.col("expires_at")))
    return leases.claim_ceiling(leases.claim_outbox(box, "scope", lit(NOW), 30000, 20), "scope")


@query("select l_orderkey, l_linenumber, l_partkey, l_extendedprice, case when l_suppkey % 3 <> 0 then 'Invariant' end code from lineitem")
def T5_timer_kind(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_suppkey") % 3 == 0, "Timer").otherwise("ExternalEffect")
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", leases.timer_kind_code(kind).alias("code"))


@query(f"""with recursive {_IN}, st as (select user_id, 0 step, 0::bigint balance, 0::bigint n from x where step = 1 union all select x.user_id, x.step, case when event_type = 'error' then st.balance // 2 else st.balance + x.payload end, n + (event_type = 'error')::int from st join x on x.user_id = st.user_id and x.step = st.step + 1),
  f as (select * from st qualify row_number() over (partition by user_id order by step desc) = 1) select user_id, case when n <= 24 then balance end balance, case when n <= 24 then n end n_errors, case when n > 24 then 'Refused' end code from f""")
def X1_user_fold(s: SparkSession, d: str) -> DataFrame:
    """A computation of the caller's own: payloads add up, an error halves the sum; too many errors refuse the final state."""

    def step(state, payload, event):
        return (state[0] // 2, state[1] + 1) if event == "error" else (state[0] + payload, state[1])

    return folds.replay_states(_inputs(s, d), ["user_id"], ["step"], ["payload", "event_type"], lambda: (0, 0), step, lambda x: x, "balance long, n_errors long", lambda x: "Refused" if x[1] > 24 else None)


@query(ORACLES["C11_quota"])
def C11_quota_stream(s: SparkSession, d: str) -> DataFrame:
    """The quota over a stream of the table's files: the operator is the batch one, its states are kept between micro-batches."""
    kind = read(s, d, "conversations").schema
    stream = s.readStream.schema(kind).parquet(f"{d}/conversations.parque[t]").select("conv_id", "turn", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    out = scratch(s, "quota")
    inbox.run_to_end(logs.running_quota(stream, "conv_id", ["turn"], "n_bytes", 400), inbox.idempotent_sink(f"{out}/rows"), f"{out}/checkpoint")
    return s.read.parquet(f"{out}/rows").select("conv_id", "turn", "used", "accepted")


_TAG = b"timeline-records-v-1"
_LE = "lpad(to_hex(({0}) % 200), 2, '0') || '00000000000000'"
_ID = "sha256({0})"


def _le(*names: str) -> str:
    return " || ".join(_LE.format(x) for x in names)


_SC = "repeat(sha256(o_orderstatus), 4)"
_HD = f"{_SC} || {_le('o_orderkey', 'o_custkey', 'o_orderkey + 1')} || case when o_orderkey % 2 = 0 then '01' || {_le('o_custkey')} else '00' end || case when o_custkey % 3 = 0 then '01' || {_SC} || sha256('a') || {_le('3', '4', 'o_custkey')} || sha256('b') else '00' end"
_IN_P = f"{_SC} || {_le('o_orderkey', 'o_custkey')} || sha256('i') || {_le('7')} || sha256('d')"
_AN_P = f"{_SC} || {_le('o_orderkey', 'o_custkey')} || sha256('s') || sha256('d')"


@query(f"""with x as (select o_orderkey, hex('{_TAG.decode()}') || case o_orderkey % 5 when 0 then '01' || {_HD} || {_le('o_orderkey + 2')} when 1 then '02' || {_IN_P} when 2 then '03' || {_AN_P} when 3 then '04' || {_HD} || {_le('o_orderkey + 2')} || {_AN_P} || case when o_custkey % 2 = 0 then '01' || {_IN_P} else '00' end
  else '05' || {_SC} || {_le('o_orderkey', 'o_custkey', '9')} || sha256('e') || sha256('d') || {_le('11')} end || case when o_custkey % 13 = 0 then '00' else '' end h from orders)
  select o_orderkey, length(h) // 2 n_bytes, sha256(unhex(h)) digest, case when (select o_custkey from orders q where q.o_orderkey = x.o_orderkey) % 13 = 0 then 'InvalidLength' end code, case when (select o_custkey from orders q where q.o_orderkey = x.o_orderkey) % 13 <> 0 then o_orderkey % 200 end branch from x""")
def S21_layouts(s: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    sha = lambda x: F.unhex(F.sha2(F.lit(x), 256))
    scope = F.unhex(F.repeat(F.sha2("o_orderstatus", 256), 4))
    small = lambda x: x % 200
    head = {"scope": scope, "branch": small(k), "step": small(c), "revision": small(k + 1), "finalized": k % 2 == 0, "finalized_step": small(c), "observed": c % 3 == 0, "observation_scope": scope, "authority": sha("a"), "epoch": lit(3), "sequence": lit(4), "observed_step": small(c), "observation_digest": sha("b")}
    values = {
        "checkpoint": head | {"last_branch": small(k + 2)},
        "input": {"scope": scope, "branch": small(k), "step": small(c), "input_id": sha("i"), "revision": lit(7), "digest": sha("d")},
        "anchor": {"scope": scope, "branch": small(k), "step": small(c), "snapshot_id": sha("s"), "digest": sha("d")},
        "fork": head | {"new_branch": small(k + 2), "anchor_scope": scope, "anchor_branch": small(k), "anchor_step": small(c), "snapshot_id": sha("s"), "state_digest": sha("d"), "replaced": c % 2 == 0, "input_scope": scope, "input_branch": small(k), "input_step": small(c), "input_id": sha("i"), "input_revision": lit(7), "input_digest": sha("d")},
        "intent": {"scope": scope, "branch": small(k), "step": small(c), "revision": lit(9), "effect_id": sha("e"), "digest": sha("d"), "charge": lit(11)},
    }
    out = None
    for i, (name, own) in enumerate(values.items()):
        made = read(s, d, "orders").where(k % 5 == i).select("o_orderkey", F.concat(wire.encode(_TAG, name, own), F.when(c % 13 == 0, F.lit(b"\x00")).otherwise(F.lit(b""))).alias("x"))
        code, fields = wire.decode(F.col("x"), _TAG, name)
        part = made.select("o_orderkey", F.octet_length("x").cast("long").alias("n_bytes"), F.sha2("x", 256).alias("digest"), code.alias("code"), fields["branch"].cast("long").alias("branch"))
        out = part if out is None else out.unionByName(part)
    return out
