"""DuckDB SQL for the queries, written apart from the operators."""

_EV = """ev as (select user_id, date_trunc('week', ts)::date::varchar as week, row_number() over (partition by user_id, date_trunc('week', ts) order by ts, event_id) rn,
  case when {full} and value < 10 then 'T' when {full} and value > 150 then 'U' when event_type = 'error' then 'R' else 'S' end r, event_id from events)"""


def _linear(full: bool, comp: bool) -> str:
    c = "true" if comp else "false"
    return f"""with recursive {_EV.format(full=str(full).lower())}, st as (
  select user_id, week, 0 rn, 'Running' status, 0 step, 0 att, 0 nc from ev where rn = 1
  union all
  select e.user_id, e.week, e.rn::int,
    case when status = 'Running' then case when r = 'S' then case when step = 2 then 'Completed' else 'Running' end
        when r = 'U' then 'Escalated' when r = 'R' and att + 1 < 2 then 'Running' when nc = 0 then 'Escalated' else 'Compensating' end
      when status = 'Compensating' then case when r = 'S' then case when nc = 1 then 'Compensated' else 'Compensating' end when r = 'R' and att + 1 < 2 then 'Compensating' else 'Escalated' end
      else status end,
    case when status = 'Running' and r = 'S' then step + 1 else step end,
    case when status = 'Running' then case when r = 'S' then case when step = 2 then att else 0 end when r = 'U' then att when r = 'R' and att + 1 < 2 then att + 1 when nc = 0 then att else 0 end
      when status = 'Compensating' then case when r = 'S' then case when nc = 1 then att else 0 end when r = 'R' and att + 1 < 2 then att + 1 else att end else att end,
    case when status = 'Running' and r = 'S' and step = 0 and {c} then nc + 1 when status = 'Compensating' and r = 'S' then nc - 1 else nc end
  from st join ev e on e.user_id = st.user_id and e.week = st.week and e.rn = st.rn + 1
), fin as (select user_id, week, rn::bigint n_events, status, step, att attempt, nc n_compensable from st qualify row_number() over (partition by user_id, week order by rn desc) = 1)"""


_BE2 = "unhex(lpad(to_hex(strlen({0})), 4, '0')) || encode({0})"
_SCOPE = " || ".join(_BE2.format(x) for x in ("('tnt_' || o_custkey)", "('prc_' || o_orderkey)", "'def_order'", "'ver_1'")) + " || unhex(sha256('order'))"
_EFFECT = f"{_SCOPE} || {_BE2.format('(' + chr(39) + 'stp_' + chr(39) + ' || o_orderpriority)')} || unhex(lpad(to_hex(o_orderkey % 64), 8, '0')) || unhex('01') || unhex(sha256(o_orderstatus))"
_IN = "x as (select user_id, (row_number() over (partition by user_id order by ts, event_id))::int step, round(value * 100)::bigint payload, event_type from events)"
_PLAN = f"""with {_IN}, h as (select user_id, max(step)::bigint head, case when user_id % 4 <> 0 then 3 end fin from x group by 1), inp as (select user_id, step::bigint step, case when step % 53 = 50 then 2 else 1 end br, payload digest from x where step % 41 <> 40),
  c as (select user_id, step::bigint "at", head, fin, step % 11 = 0 stale, step % 13 = 7 foreign_scope, step % 17 = 9 other_branch, step % 2 = 1 swaps, (case when step % 2 = 1 then step - 1 else step + user_id % 3 * 2 end)::bigint anchor, (case when step % 7 = 3 then step + 1 else step end)::bigint target, step % 5 = 0 renamed, step % 9 = 4 old from x join h using (user_id) where event_type = 'error'),
  placed as (select c.user_id, c."at", i.step, br, anchor, row_number() over (partition by c.user_id, c."at" order by i.step) k from c join inp i on i.user_id = c.user_id and i.step > anchor and i.step <= head),
  met as (select user_id, "at", count(*) n, min(case when br <> 1 then k end) odd, min(case when step <> anchor + k then k end) gap from placed group by 1, 2),
  plans as (select c.user_id, c."at", anchor, swaps, case when stale then 'Conflict' when foreign_scope then 'ScopeMismatch' when other_branch then 'Conflict' when anchor > head then 'FutureCorrection' when swaps and target <> anchor + 1 then 'HistoryUnavailable' when swaps and target > head then 'FutureCorrection'
      when (case when swaps then target else anchor end) <= fin then 'ReconciliationRequired' when head - anchor > 60 or n > 50 then 'Capacity' when coalesce(n, 0) <> head - anchor then 'HistoryUnavailable' when odd is not null and (gap is null or odd <= gap) then 'Conflict' when gap is not null then 'HistoryUnavailable' when swaps and (renamed or old) then 'InputMismatch' end code,
    case when code is null then case when swaps then target else anchor end end corrected_step, case when code is null then head - anchor end n_replayed from c left join met on met.user_id = c.user_id and met."at" = c."at")"""
_OUT = "o as (select conv_id, turn, sha256(coalesce(text, '')) payload, strlen(coalesce(text, '')) n_bytes from conversations)"
_BOX = "b as (select o_orderpriority scope, 'act_' || o_orderkey action_id, o_orderkey % 65 attempt, o_orderstatus = 'F' acknowledged, case when o_orderkey % 4 <> 0 then epoch_ms(o_orderdate) end expires_at from orders)"
_GEN = "g as (select l_orderkey task, l_linenumber generation, max(case when l_returnflag = 'N' then 0 else 2 end) state from lineitem group by 1, 2)"
_EFF = "e as (select l_suppkey timeline, l_linenumber step, l_orderkey || '-' || l_partkey || '-' || l_extendedprice::decimal(18,2) identity from lineitem)"
NOW = 820454400000

ORACLES = {
    "L12_replay_weekly": _linear(False, False) + " select * from fin",
    "L12_replay_full": _linear(True, True) + " select * from fin",
    "L11_manual_review": _linear(True, True) + """ select user_id, week, resolution, case resolution when 'RetryAction' then 'Running' when 'Compensate' then case when n_compensable > 0 then 'Compensating' else 'Cancelled' end when 'Cancel' then 'Cancelled' else 'Escalated' end status
      from (select *, ['RetryAction', 'Compensate', 'Cancel', 'Escalate'][user_id % 4 + 1] resolution from fin where status = 'Escalated')""",
    "L18_observed_kinds": f"with {_EV.format(full='true')} select event_id, 'InputAccepted,' || case r when 'S' then 'ActionSucceeded' when 'U' then 'ActionOutcomeUnknown' else 'ActionFailed' end kinds from ev",
    "L19_planned_kinds": _linear(True, True) + " select user_id, week, case status when 'Running' then 'ActionPlanned' when 'Compensating' then 'CompensationPlanned' else status end kinds from fin",
    "G5_graph_replay": f"""with recursive {_EV.format(full='true')}, g(s, r, t) as (values ('a','S','b'),('a','R','a'),('b','S','c'),('b','R','d'),('b','T','!'),('d','S','b'),('c','S','e'),('c','R','c'),('e','S','!'),('e','T','!')), st as (
      select user_id, week, 0 rn, 'Running' status, 'a' step, 1 visit, null::varchar err from ev where rn = 1
      union all
      select e.user_id, e.week, e.rn::int, case when status <> 'Running' or err is not null then status when e.r = 'U' then 'Escalated' when g.t = '!' then case when e.r = 'S' then 'Completed' else 'Escalated' end else status end,
        case when status = 'Running' and err is null and e.r <> 'U' and g.t <> '!' and visit < 8 then g.t else step end,
        case when status = 'Running' and err is null and e.r <> 'U' and g.t <> '!' and visit < 8 then visit + 1 else visit end,
        case when status <> 'Running' or err is not null or e.r = 'U' then err when g.t is null then 'MissingTransition' when g.t <> '!' and visit >= 8 then 'VisitLimitExceeded' end
      from st join ev e on e.user_id = st.user_id and e.week = st.week and e.rn = st.rn + 1 left join g on g.s = st.step and g.r = e.r)
      select user_id, week, status, step, visit, err error_code from st qualify row_number() over (partition by user_id, week order by rn desc) = 1""",
    "S1_identifier_valid": "select c_custkey, regexp_full_match('tnt_' || case when c_custkey % 3 = 0 then c_name else replace(c_name, '#', '-') end, 'tnt_[A-Za-z0-9_.-]+') and strlen('tnt_' || c_name) <= 128 valid from customer",
    "S2_digest": "select doc_id, sha256(coalesce(text, '')) digest from documents",
    "S3_retry_due_at": "select o_orderkey, o_orderkey % 70 ordinal, epoch_ms(o_orderdate) + (case when o_orderkey % 70 >= 61 then case when o_orderkey % 70 >= 64 then 60000 else 0 end else least(60000::hugeint, (1000::hugeint * (pow(2, o_orderkey % 70))::hugeint) % 18446744073709551616) end)::bigint due_at from orders",
    "S4_jitter": """with a as (select o_orderkey, sha256(o_orderkey::varchar) h from orders), b as (select o_orderkey, ('0x' || h[15:16] || h[13:14] || h[11:12] || h[9:10] || h[7:8] || h[5:6] || h[3:4] || h[1:2])::ubigint s from a),
      c as (select o_orderkey, xor(s, ((o_orderkey % 64)::uhugeint * 11400714819323198485::uhugeint % 18446744073709551616::uhugeint)::ubigint) x from b), d as (select o_orderkey, (xor(x, x >> 30)::uhugeint * 13787848793156543929::uhugeint % 18446744073709551616::uhugeint)::ubigint x from c),
      e as (select o_orderkey, (xor(x, x >> 27)::uhugeint * 10723151780598845931::uhugeint % 18446744073709551616::uhugeint)::ubigint x from d) select o_orderkey, (xor(x, x >> 31) % 997)::bigint jitter from e""",
    "S6_scope_bytes_hash": f"select o_orderkey, sha256({_SCOPE}) digest from orders",
    "S7_effect_key_hash": f"select o_orderkey, sha256({_EFFECT}) digest from orders",
    "S8_definition_digest": f"select n_regionkey, sha256({_BE2.format(chr(39) + 'def_region' + chr(39))} || {_BE2.format(chr(39) + 'ver_1' + chr(39))} || unhex(lpad(to_hex(count(*)), 8, '0')) || unhex(string_agg(lpad(to_hex(strlen('stp_' || n_name)), 4, '0') || hex('stp_' || n_name), '' order by n_name))) digest from nation group by 1",
    "S12_resource_scope": "select l_orderkey, count(*) = count(distinct l_partkey) and count(*) <= 64 valid from lineitem group by 1",
    "S17_timer_input_id": f"select o_orderkey, 'inp_timer_' || sha256(encode('timer') || unhex('00') || {_EFFECT} || encode('act_' || o_orderkey)) input_id from orders",
    "C1_commit_validation": """with m as (select l_orderkey, l_partkey, l_linenumber s, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) pos from lineitem), n as (select *, row_number() over (partition by l_orderkey, l_partkey order by pos) > 1 again from m)
      select l_orderkey, count(*) n, case when count(*) > 128 then 'OutcomeLimitExceeded' else min_by(case when s <> pos then 'NonContiguousSequence' else 'DuplicateOutcomeId' end, pos) filter (where s <> pos or again) end code from n group by 1""",
    "C3_log_contiguity": f"with {_OUT} select conv_id, count(*) n, max(turn) + 1 next_sequence, min(turn) = 0 and max(turn) = count(*) - 1 and count(distinct turn) = count(*) contiguous, count(distinct turn) = count(*) unique_ids, count(*) <= 4096 within_limit from o group by 1",
    "C5_paging": f"with {_OUT}, p as (select conv_id, turn // 3 page, min(turn) first, count(*) n from o group by 1, 2) select *, lead(first) over (partition by conv_id order by page) continuation from p",
    "C7_verify_batch": f"with {_OUT} select conv_id, turn, payload from o where turn % 5 = 4",
    "C10_head_consistency": f"with {_OUT} select conv_id, conv_id % 7 <> 3 and conv_id % 5 <> 0 consistent from o group by 1",
    "C11_quota": f"""with recursive {_OUT}, q as (select *, row_number() over (partition by conv_id order by turn) rn from o), st as (select conv_id, -1::bigint turn, 0::bigint rn, 0::bigint used, true accepted from q where rn = 1
      union all select q.conv_id, q.turn, q.rn, case when used + n_bytes <= 400 then used + n_bytes else used end, used + n_bytes <= 400 from st join q on q.conv_id = st.conv_id and q.rn = st.rn + 1) select conv_id, turn, used, accepted from st where rn > 0""",
    "I1_inbox_accept": """with x as (select *, 0 delivery from lineitem union all select *, 1 from lineitem where l_orderkey % 10 = 0),
      v as (select l_orderkey, l_linenumber, row(l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) body, row_number() over w rn, first_value(row(l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)) over w f from x
        window w as (partition by l_orderkey, l_linenumber order by delivery, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax))
      select l_orderkey, l_linenumber, case when rn = 1 then 'accepted' when f = body then 'duplicate' else 'conflict' end verdict, count(*) n from v group by all""",
    "I2_pending": "select user_id, 'inp_' || event_id input_id, row_number() over (partition by user_id order by 'inp_' || event_id)::int rn from events where event_type <> 'purchase' qualify rn <= 5",
    "I3_source_dedup": "select l_orderkey, l_suppkey, count(distinct l_linenumber) > 1 conflict from lineitem group by 1, 2",
    "I5_payload_store": "select source, sha256(coalesce(text, '')) digest, max(strlen(coalesce(text, '')))::bigint n_bytes, count(*) n_puts from documents group by 1, 2",
    "O1_claim": f"with {_BOX}, t as (select * from b where not acknowledged and (expires_at is null or expires_at < {NOW}) qualify row_number() over (partition by scope order by action_id) <= 128) select scope, action_id, attempt delivery_attempt, ({NOW} + 30000)::bigint new_expires_at, case when max(attempt) over (partition by scope) >= 64 then 'QuotaExceeded' end error from t",
    "O5_expiry": f"with {_BOX} select action_id, expires_at < {NOW} expired from b where expires_at is not null",
    "O8_funnel": f"with {_BOX} select scope, count(*) total, count(*) filter (where acknowledged) acknowledged, count(*) filter (where not acknowledged and expires_at >= {NOW}) leased, count(*) filter (where not acknowledged and coalesce(expires_at < {NOW}, true)) claimable, count(*) filter (where not acknowledged and attempt >= 64) exhausted from b group by 1",
    "T1_schedule": """with r as (select l_orderkey, epoch_ms(l_shipdate) due, row_number() over w rn, first_value(epoch_ms(l_shipdate)) over w f from lineitem window w as (partition by l_orderkey order by l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice))
      select l_orderkey, case when o_orderkey is null then 'UnknownAction' when rn = 1 then 'scheduled' when f = due then 'duplicate' else 'conflict' end verdict, count(*) n from r left join (select o_orderkey from orders where o_orderstatus <> 'P') on o_orderkey = l_orderkey group by all""",
    "T2_due": f"select o_orderpriority scope, 'act_' || o_orderkey action_id, epoch_ms(o_orderdate) due_at, row_number() over (partition by o_orderpriority order by epoch_ms(o_orderdate), 'act_' || o_orderkey)::int rn from orders where o_orderstatus <> 'F' and epoch_ms(o_orderdate) <= {NOW} and o_orderkey % 4 <> 0 qualify rn <= 16",
    "R1_correlation": "select o_orderkey, case when l_linenumber is null then 'Missing' when o_custkey % 2 <> l_suppkey % 2 then 'TenantMismatch' when o_orderstatus <> l_linestatus then 'OperationMismatch' else 'Verified' end verdict, count(*) n from orders left join lineitem on l_orderkey = o_orderkey group by all",
    "R4_disposition": f"select o_orderkey, case o_orderstatus when 'F' then 'Committed' when 'O' then case when {NOW} < epoch_ms(o_orderdate) then 'Wait' else 'Retry' end else 'Escalate' end disposition from orders",
    "R7_effect_disposition": f"select o_orderkey, case o_orderstatus when 'F' then 'Completed' when 'O' then case when {NOW} <= epoch_ms(o_orderdate) then 'Retry' else 'Escalate' end else 'Escalate' end disposition from orders",
    "R9_review": f"select o_orderkey, case when o_orderkey % 5 <> 0 and {NOW} > epoch_ms(o_orderdate) then 'Expired' when o_orderkey % 2 = 0 and o_orderkey % 3 = o_orderkey % 2 then 'SamePrincipal' else 'Accepted' end verdict from orders",
    "R11_authorization": "select case event_type when 'error' then 'TerminalOverride' when 'signup' then 'DecideReview' else event_type end operation, count(*) n, case when event_type in ('error', 'signup') then 'DistinctPrincipals' else 'AuthenticatedPrincipal' end control from events group by event_type",
    "R14_task_evidence": "select o_orderkey, case when o_orderstatus = 'F' then 'Succeeded' when o_orderstatus = 'O' and o_orderkey % 2 = 0 then 'KnownFailure' else 'Unknown' end evidence from orders",
    "K13_fencing": f"with {_GEN} select *, not exists (select 1 from g p where p.task = g.task and p.generation < g.generation and p.state <> 2) may_start from g",
    "K14_retire": f"with {_GEN} select o_orderkey task, 'Completed' status from orders where o_orderstatus = 'F' and not exists (select 1 from g where task = o_orderkey and state <> 2)",
    "M2_append_gate": f"""with recursive {_IN}, y as (select user_id, step, row_number() over (partition by user_id order by step) rn, case when (user_id + step) % 23 = 7 then 'other' else 'own' end sc, case when step % 19 = 6 then 2 else 1 end br, case when step % 29 = 11 then 0 when step > 5 then 4 else step - 1 end rev from x where step % 9 <> 5),
      st as (select user_id, 0 step, 0::bigint rn, sc, br, 0 head, null::varchar code from y where rn = 1
        union all select user_id, step, rn, sc, br, head + (code is null)::int, code from (select y.user_id, y.step, y.rn, st.sc, st.br, head, case when y.rev <> head then 'Conflict' when y.sc <> st.sc then 'ScopeMismatch' when y.br <> st.br then 'Conflict' when y.step <> head + 1 then 'InputMismatch' end code from st join y on y.user_id = st.user_id and y.rn = st.rn + 1))
      select user_id, step, code from st where rn > 0""",
    "M3_observe": f"""with {_IN}, y as (select user_id, step, case when payload % 31 = 3 then 'b' else 'a' end who, step // 10 e, payload % 100 q, step + payload % 7 - 5 pos from x), f as (select user_id, arg_min(who, step) w0 from y where pos <= step group by 1),
      z as (select y.*, w0, max(case when pos <= step and who = w0 then e * 1000 + q end) over (partition by user_id order by step rows between unbounded preceding and 1 preceding) m from y left join f using (user_id))
      select user_id, step, case when pos > step then 'FutureCorrection' when who <> w0 then 'StaleAuthority' when e * 1000 + q <= m then 'StaleAuthority' end code from z""",
    "M6_plan": f"{_PLAN} select * exclude (anchor, swaps) from plans",
    "M7_replay_inputs": f"""{_PLAN}, r as (select p.user_id, p."at", i.step, i.step - anchor - 1 o, case when swaps and i.step = anchor + 1 then digest + 1 else digest end g from plans p join inp i on i.user_id = p.user_id and i.step > anchor and i.step <= anchor + n_replayed where code is null)
      select user_id, "at", count(*) n, max(step) through, max(case when o = 0 then g end) first, sum((o + 1) * (g % 1000))::bigint checksum from r group by 1, 2""",
    "M8_correction_replay": f"with recursive {_IN}, y as (select user_id, step, payload + (event_type = 'error')::int p from x), st as (select user_id, 0 step, 0::bigint state from y where step = 1 union all select y.user_id, y.step, (st.state * 3 + y.p) % 1000003 from st join y on y.user_id = st.user_id and y.step = st.step + 1) select user_id, step head, state from st qualify row_number() over (partition by user_id order by step desc) = 1",
    "M9_resolve_input": """with k as (select s_suppkey, s_nationkey, n_regionkey, t.step from supplier join nation on s_nationkey = n_nationkey, unnest(range(1, 16)) t(step) where t.step <= 15 - s_suppkey % 3)
      select 's' || s_suppkey branch, step::int step, f found_in, case when f = 's' || s_suppkey and step = 8 then f || '!8' else f || '@' || step end as value from (select *, case when step % 5 = 0 or step = 8 and s_suppkey % 4 = 0 then 's' || s_suppkey when step <= 8 and step % 3 = 0 then 'n' || s_nationkey when step <= 8 then 'r' || n_regionkey end f from k) where f is not null""",
    "M19_promote": f"with {_EFF} select timeline, step, sum(n)::bigint n from (select timeline, step, 1 n from e where step < 5 union all select timeline, step, 1 from e where step >= 6) group by 1, 2",
    "M20_eligible": f"with {_EFF} select timeline, count(*) n from e where step <= timeline % 5 + 1 group by 1",
    "M21_handoff": f"with {_EFF} select timeline, step, identity, row_number() over (partition by timeline order by step, identity)::int rn from (select distinct * from e) qualify rn <= 10",
}
