"""Every engine query against its DuckDB SQL, and the goldens of the scalar functions."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.functions import wire
from ledgerline.operators import decide, graph, logs, saga, timeline
from ledgerline.plans.oracles import ORACLES
from ledgerline.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(columns, data):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    def plain(v):
        return round(v, 6) if isinstance(v, float) and not math.isnan(v) else str(v)
    return sorted([[plain(r[i]) for i in at] for r in data])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_jitter_matches_big_integers(spark):
    def plain(seed, n, most):
        mask = (1 << 64) - 1
        x = int.from_bytes(seed[:8], "little") ^ (n * 0x9E3779B97F4A7C15 & mask)
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return (x ^ x >> 31) % most

    df = spark.range(200).select("id", F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("s"))
    for r in df.select("id", "s", S.jitter(F.col("s"), F.col("id") % 64, 997).alias("j")).collect():
        assert r.j == plain(bytes(r.s), r.id % 64, 997)


def test_backoff_loses_high_bits(spark):
    got = {r.id: r.d for r in spark.range(70).select("id", S.backoff_delay(1000, 60000, F.col("id")).alias("d")).collect()}
    assert got[0] == 1000 and got[5] == 32000 and got[6] == 60000 and got[62] == 0 and got[64] == 60000


def test_compensation_is_last_in_first_out(spark):
    log = [(1, i, r) for i, r in enumerate("SSTSS")]
    got = saga.replay_linear(spark.createDataFrame(log, "p long, n long, result string"), ["p"], ["n"], compensable=(0, 1)).first()
    assert (got.status, got.n_compensable) == ("Compensated", 0)


def test_inbox_tells_duplicates_from_conflicts(spark):
    x = spark.createDataFrame([("k", 1, "a"), ("k", 2, "a"), ("k", 3, "b"), ("m", 1, "a")], "k string, n long, c string")
    got = [(r.k, r.n, r.verdict) for r in logs.accept_inputs(x, ["k"], ["c"], ["n"]).collect()]
    assert sorted(got) == [("k", 1, "accepted"), ("k", 2, "duplicate"), ("k", 3, "conflict"), ("m", 1, "accepted")]


def test_refused_rows_charge_nothing(spark):
    x = spark.createDataFrame([("a", i, n) for i, n in enumerate((5, 100, 4))] + [("b", 0, 1), ("c", 0, None)], "scope string, n long, size long")
    got = {(r.scope, r.n): (r.used, r.accepted) for r in logs.running_quota(x, "scope", ["n"], "size", 10).collect()}
    assert [got["a", i] for i in range(3)] == [(5, True), (5, False), (9, True)] and got["c", 0] == (0, True)
    got = {(r.scope, r.n): (r.used, r.accepted) for r in logs.running_quota(x, "scope", ["n"], "size", 10, max_scopes=2).collect()}
    assert got["b", 0] == (1, True) and got["c", 0] == (0, False)


def saga_log(rows):
    """(p, n, kind, action, next, result, at, deadline, resolution, pinned, input_id, sequence) from short rows."""
    return [(p, n, kind, a, x, r, at, None, res, True, f"i{n}", seq) for p, n, kind, a, x, r, at, res, seq in rows]


LOG = "p string, n long, kind string, action string, next string, result string, at long, deadline long, resolution string, pinned boolean, input_id string, sequence long"


def test_ordered_replay_wants_sequences_from_zero(spark):
    steps = (decide.Step(2), decide.Step(2))
    good = [("g", 0, "Started", None, "a0", None, 0, None, 0), ("g", 1, "ActionResult", "a0", "a1", "S", 1, None, 1), ("g", 2, "ActionResult", "a1", None, "S", 2, None, 2)]
    late = [("l", n + 5, k, a, x, r, t, res, q + 1) for _, n, k, a, x, r, t, res, q in good]
    twice = [("t", n, k, a, x, r, t, res, 0) for _, n, k, a, x, r, t, res, _ in good]
    log = spark.createDataFrame(saga_log(good + late + twice), LOG)
    got = {r.p: (r.status, r.code, r.n_applied) for r in decide.replay_events(log, ["p"], ["n"], steps, sequence="sequence").collect()}
    assert got == {"g": ("Completed", None, 3), "l": (None, "InvalidEventSequence", 0), "t": (None, "InvalidEventSequence", 0)}


def test_retry_timers_and_manual_resolution(spark):
    steps = (decide.Step(3, (1000, 60000), 1), decide.Step(1))
    rows = [
        ("p", 0, "Started", None, "a0", None, 0, None, 0), ("p", 1, "RetryTimerScheduled", "a0", "t1", "R", 500, None, 1), ("p", 2, "RetryTimerFired", "t1", "a2", None, 1500, None, 2),
        ("p", 3, "ActionResult", "a2", "a3", "S", 1600, None, 3), ("p", 4, "ActionResult", "a3", None, "U", 1700, None, 4), ("p", 5, "ManualResolution", None, "a5", None, 1800, "Compensate", 5), ("p", 6, "ActionResult", "a5", None, "S", 1900, None, 6),
    ]
    states = {n: (r.status, r.step, r.attempt, r.due, r.code) for n in range(1, 8) for r in decide.replay_events(spark.createDataFrame(saga_log(rows[:n]), LOG), ["p"], ["n"], steps).collect()}
    assert states[2] == ("Running", 0, 1, 1500, None) and states[3] == ("Running", 0, 1, None, None) and states[5] == ("Escalated", 1, 0, None, None)
    assert states[6] == ("Compensating", 1, 0, None, None) and states[7] == ("Compensated", 1, 0, None, None)
    early = [*rows[:2], ("p", 2, "RetryTimerFired", "t1", "a2", None, 1499, None, 2)]
    assert decide.replay_events(spark.createDataFrame(saga_log(early), LOG), ["p"], ["n"], steps).first().code == "RetryTimerFiredEarly"


def test_identities_hash_the_effect_key(spark):
    import hashlib

    def ident(x):
        return len(x).to_bytes(2, "big") + x

    scope = b"".join(map(ident, (b"tnt_1", b"prc_2", b"def", b"ver"))) + bytes(32)
    key = scope + ident(b"stp_a") + (3).to_bytes(4, "big") + b"\1" + bytes(32)
    one = spark.range(1).select(S.effect_key_bytes(S.scope_bytes(F.lit("tnt_1"), F.lit("prc_2"), F.lit("def"), F.lit("ver"), F.lit(bytes(32))), F.lit("stp_a"), F.lit(3), F.lit(1), F.lit(bytes(32))).alias("key"))
    got = one.select("key", S.tagged_identity("inp_timer_", b"x\0", F.col("key"), F.lit(b"act_7")).alias("timer"), S.tagged_identity("inp_task_", b"y\0", F.col("key"), F.lit(bytes(range(32))), F.lit(b"act_7")).alias("relay")).first()
    assert bytes(got.key) == key
    assert got.timer == "inp_timer_" + hashlib.sha256(b"x\0" + key + b"act_7").hexdigest()
    assert got.relay == "inp_task_" + hashlib.sha256(b"y\0" + key + bytes(range(32)) + b"act_7").hexdigest()


def test_lineage_is_walked_to_its_root(spark):
    tree = spark.createDataFrame([(f"b{i}", f"b{i - 1}" if i else None, 100, 100) for i in range(25)], "branch string, parent string, inherited_through int, admitted_through int")
    entries = spark.createDataFrame([("b0", 5, "root")], "branch string, step int, value string")
    wanted = spark.createDataFrame([("b10", 5), ("b24", 5), ("b24", 6)], "branch string, step int")
    got = {(r.branch, r.step): r.found_in for r in timeline.resolve(tree, entries, wanted).collect()}
    assert got == {("b10", 5): "b0", ("b24", 5): "b0"}
    circle = spark.createDataFrame([("x", "y", 100, 100), ("y", "x", 100, 100)], tree.schema)
    with pytest.raises(ValueError):
        timeline.resolve(circle, entries, spark.createDataFrame([("x", 5)], "branch string, step int"))


def test_graph_replay_is_bounded_and_refuses_repeats(spark):
    edges = {("a", "S"): "a", ("a", "T"): None}
    rows = [("p", n, "Started" if n == 0 else "ActionResult", f"a{n - 1}", f"a{n}", "S", f"i{n}", n) for n in range(6)]
    kinds = "p string, n long, kind string, action string, next string, result string, input_id string, sequence long"

    def last(rows, **more):
        return graph.replay_ordered(spark.createDataFrame(rows, kinds), ["p"], ["n"], edges, "a", 100, **more).first()

    assert (last(rows).visit, last(rows).code) == (6, None)
    assert last(rows, limit=5).code == "ReplayLimitExceeded"
    again = [*rows[:5], (*rows[5][:6], "i2", 5)]
    assert (last(again).code, last(again).n_applied) == ("DuplicateInput", 5)
    reused = [*rows[:5], (*rows[5][:4], "a1", *rows[5][5:])]
    assert last(reused).code == "DuplicateActionId"


def test_timeline_records_are_strict(spark):
    tag = b"t" * wire.TAG_BYTES
    sizes = {name: [wire.TAG_BYTES + 1 + sum(1 + full * wire._size(k) if isinstance(k, tuple) else k for _, k in fields) for full in (0, 1)] for name, (_, fields) in wire.LAYOUTS.items()}
    assert sizes == {"checkpoint": [183, 407], "input": [237, 237], "anchor": [229, 229], "fork": [392, 832], "intent": [245, 245]}
    plain = tag + b"\2" + bytes(128) + (7).to_bytes(8, "little") + (1 << 40).to_bytes(8, "little") + b"i" * 32 + (9).to_bytes(8, "little") + b"d" * 32
    values = {"scope": F.lit(bytes(128)), "branch": F.lit(7), "step": F.lit(1 << 40), "input_id": F.lit(b"i" * 32), "revision": F.lit(9), "digest": F.lit(b"d" * 32)}
    assert bytes(spark.range(1).select(wire.encode(tag, "input", values).alias("x")).first().x) == plain
    head = tag + b"\1" + bytes(128 + 24)
    rows = [("input", plain, None), ("input", plain + b"\0", "InvalidLength"), ("input", plain[:-1], "InvalidLength"), ("input", b"u" + plain[1:], "UnknownTag"), ("input", tag + b"\3" + plain[21:], "UnknownVariant"), ("input", b"", "UnknownTag"),
            ("checkpoint", head + b"\0\0" + bytes(8), None), ("checkpoint", head + b"\1" + bytes(8) + b"\0" + bytes(8), None), ("checkpoint", head + b"\2\0" + bytes(8), "InvalidFlag"), ("checkpoint", head + b"\1\0" + bytes(8), "InvalidLength")]
    for layout in ("input", "checkpoint"):
        code, fields = wire.decode(F.col("x"), tag, layout)
        mine = [(i, bytearray(x)) for i, (name, x, _) in enumerate(rows) if name == layout]
        got = spark.createDataFrame(mine, "i long, x binary").select("i", code.alias("code"), fields["step"].alias("step")).collect()
        assert {r.i: r.code for r in got} == {i: rows[i][2] for i, _ in mine}
        assert all(r.code is None or r.step is None for r in got) and (layout != "input" or got[0].step == 1 << 40)
