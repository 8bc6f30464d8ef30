"""Operators that SQL doesn't cover, against plain versions on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import commits, folds, leases, logs, tasks, timeline
from ledgerline.streaming import inbox

KINDS = ["IntentCommitted", "CheckpointMigrated", "Started", "Restarted", "CheckpointCommitted", "FaultObserved", "Completed", "ReconciliationRequired", "Reconciled", "RecoveryPlanned", "RecoveryExhausted"]
SCHEMA = "task long, sequence long, tick long, generation long, kind string, detail string, bytes long"


def plain_replay(log, d):
    """The state machine written out record by record."""
    s = {"status": "Empty", "n": 0, "tick": 0, "gen": 0, "until": 0, "restart": 0, "made": 0, "cp": None}

    def refusal(r):
        _, seq, tick, gen, kind, detail, size = r
        begins = kind in ("Started", "Restarted")
        can = d.mode != "NeverRestart" and s["gen"] < d.attempts and tick < d.deadline and s["restart"] < d.deadline
        if seq != s["n"] or tick < s["tick"]:
            return "InvalidOrder"
        if seq >= d.history or ((begins or kind == "CheckpointCommitted") and seq + 1 >= d.history):
            return "QuotaExhausted"
        if gen != s["gen"] + begins:
            return "StaleGeneration"
        from_states = {
            "IntentCommitted": {"Empty"}, "CheckpointMigrated": {"Pending"}, "Started": {"Pending"}, "Restarted": {"Ready"}, "ReconciliationRequired": {"Faulted"}, "Reconciled": {"Reconciling"},
            "RecoveryPlanned": {"Reconciled"} if d.reconciles else {"Faulted"}, "RecoveryExhausted": {"Faulted", "Reconciled", "Reconciling", "Pending", "Ready"},
        }.get(kind, {"Running"})
        if s["status"] not in from_states:
            return "InvalidTransition"
        if begins:
            return "QuotaExhausted" if gen > d.attempts else "DeadlineExpired" if tick >= d.deadline else "InvalidTransition" if kind == "Restarted" and tick < s["restart"] else None
        if kind in ("CheckpointCommitted", "CheckpointMigrated"):
            if kind == "CheckpointMigrated" and s["cp"] is not None:
                return "ScopeMismatch"
            if kind == "CheckpointCommitted" and tick >= s["until"]:
                return "DeadlineExpired"
            return "QuotaExhausted" if size > d.checkpoint_bytes or s["made"] >= d.checkpoints else None
        if kind == "Completed":
            return "DeadlineExpired" if tick >= s["until"] else "QuotaExhausted" if size > d.output_bytes else None
        if kind == "Reconciled":
            return "QuotaExhausted" if detail == "Completed" and size > d.output_bytes else None
        if kind == "FaultObserved":
            return "InvalidTransition" if (detail == "Timeout" and tick < s["until"]) or (detail == "DeadlineViolation" and tick < d.deadline) else None
        if kind == "ReconciliationRequired":
            return None if d.reconciles else "InvalidTransition"
        if kind == "RecoveryPlanned":
            return "QuotaExhausted" if not can else "CorruptBlob" if detail != (None if d.mode == "RestartFromBeginning" else s["cp"]) else None
        if kind == "RecoveryExhausted":
            return "InvalidTransition" if (tick < d.deadline if s["status"] in ("Pending", "Ready") else can) else None

    for r in log:
        _, seq, tick, gen, kind, detail, _ = r
        code = refusal(r)
        if code:
            return s["n"], s["status"], s["gen"], s["tick"], s["cp"], code, seq
        s["n"], s["tick"] = s["n"] + 1, tick
        if kind in ("Started", "Restarted"):
            s.update(status="Running", gen=gen, until=min(tick + d.timeout, d.deadline))
        elif kind in ("CheckpointCommitted", "CheckpointMigrated"):
            s["cp"], s["made"] = detail, s["made"] + 1
        elif kind == "FaultObserved":
            s.update(status="Faulted", restart=tick + d.delay)
        elif kind == "Reconciled":
            s["status"] = {"Completed": "Completed", "RestartAuthorized": "Reconciled"}.get(detail, "Reconciling")
        else:
            s["status"] = {"IntentCommitted": "Pending", "Completed": "Completed", "ReconciliationRequired": "Reconciling", "RecoveryPlanned": "Ready", "RecoveryExhausted": "Exhausted"}[kind]
            if kind == "RecoveryPlanned":
                s["cp"] = detail
    return s["n"], s["status"], s["gen"], s["tick"], s["cp"], None, None


USUAL = {"Empty": ["IntentCommitted"], "Pending": ["CheckpointMigrated", "Started", "Started", "RecoveryExhausted"], "Running": ["CheckpointCommitted", "FaultObserved", "FaultObserved", "Completed"], "Ready": ["Restarted"],
         "Faulted": ["RecoveryPlanned", "ReconciliationRequired", "RecoveryExhausted"], "Reconciling": ["Reconciled"], "Reconciled": ["RecoveryPlanned", "RecoveryExhausted"]}


@pytest.mark.parametrize("policy", [("RestartFromCheckpoint", "Pure"), ("RestartFromBeginning", "Pure"), ("ReconcileBeforeRestart", "ReconcileRequired"), ("NeverRestart", "Pure")])
def test_task_state_machine(spark, policy):
    d = tasks.Definition(attempts=2, timeout=9, delay=2, deadline=40, history=14, checkpoints=3, mode=policy[0], contract=policy[1])
    rng, logs = random.Random(7), {}
    for t in range(400):
        log, tick = [], 0
        for seq in range(rng.randint(1, 18)):
            n, status, gen, _, cp, code, _ = plain_replay(log, d)
            kind = rng.choice(USUAL.get(status, KINDS)) if rng.random() < 0.95 else rng.choice(KINDS)
            tick += rng.choice([0, 1, 1, 2, 3])
            detail = {"FaultObserved": rng.choice(["Panic", "Timeout", "DeadlineViolation"]), "Reconciled": rng.choice(["Completed", "RestartAuthorized", "Unknown"])}.get(kind)
            if kind.startswith("Checkpoint"):
                detail = f"c{seq}"
            if kind == "RecoveryPlanned" and policy[0] != "RestartFromBeginning":
                detail = cp if rng.random() < 0.9 else "other"
            log.append((t, seq if rng.random() < 0.98 else seq + 1, tick, gen + (kind in ("Started", "Restarted")), kind, detail, rng.choice([5, 5, 5, 30, 50])))
        logs[t] = sorted(log, key=lambda r: (r[1], r[2], r[3], r[4], r[5] is not None, r[5] or "", r[6]))
    df = spark.createDataFrame([r for x in logs.values() for r in x], SCHEMA)
    got = {r.task: tuple(r)[1:] for r in tasks.replay_records(df, "task", d).collect()}
    want = {t: (n, st, g, tk, cp, code, at) for t, x in logs.items() for n, st, g, tk, cp, code, at in [plain_replay(x, d)]}
    assert got == want
    assert len({w[1] for w in want.values()}) > 4 and tasks.replay_records(df.limit(0), "task", d).count() == 0


@pytest.mark.parametrize("keyed", [True, False])
def test_stream_goes_on_from_its_state(spark, tmp_path, keyed):
    kind = "p long, i long, c string, n long"
    for b, rows in enumerate([[(1, 1, "a", 1), (1, 1, "b", 2), (1, 2, None, 1)], [(1, 1, "a", 3), (1, 2, None, 2), (2, 1, "a", 1), (1, 2, "x", 3)]]):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{b}")
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in/*")
        if keyed:
            inbox.run_to_end(inbox.accept_stream(stream, "p", "i", ["c"], ["n"]), inbox.idempotent_sink(f"{tmp_path}/out"), f"{tmp_path}/check")
        else:
            inbox.run_to_end(stream, inbox.accept_batches(f"{tmp_path}/out", ["p", "i"], ["c"], ["n"]), f"{tmp_path}/check")
    got = sorted((r.p, r.i, r.verdict, r.n) for r in spark.read.parquet(f"{tmp_path}/out").groupBy("p", "i", "verdict").agg(F.sum("n").alias("n")).collect())
    assert got == [(1, 1, "accepted", 1), (1, 1, "conflict", 1), (1, 1, "duplicate", 1), (1, 2, "accepted", 1), (1, 2, "conflict", 1), (1, 2, "duplicate", 1), (2, 1, "accepted", 1)]


def test_commit_retries(spark):
    rows = [("s", 1, 0, 2, "d0", "i0"), ("s", 2, 0, 2, "d0", "i0"), ("s", 3, 0, 2, "other", "i0"), ("s", 4, 1, 1, "d1", None), ("s", 5, 2, 1, "d2", "i0"), ("s", 6, 2, 1, "d2", None), ("s", 7, 3, 9, "d3", None)]
    x = spark.createDataFrame(rows, "s string, o long, e long, n long, d string, i string")
    got = [r.verdict for r in commits.commit_log(x, "s", ["o"], "e", "n", "d", "i", limit=4).orderBy("o").collect()]
    assert got == ["committed", "duplicate", "Conflict", "Conflict", "Conflict", "committed", "QuotaExceeded"]


def test_nothing_expires_while_a_branch_has_no_anchor(spark):
    branches = spark.createDataFrame([("a",), ("b",)], "branch string")
    steps = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3)], "branch string, step int")
    kept = timeline.expire_before(branches, steps, steps, 2)
    assert [x.count() for x in kept] == [3, 3]
    both = steps.union(spark.createDataFrame([("b", 2)], "branch string, step int"))
    assert [x.count() for x in timeline.expire_before(branches, both, steps, 2)] == [1, 3]


def test_tokens_are_unique_and_rise_in_each_scope(spark):
    x = spark.range(500).select((F.col("id") % 7).alias("s"), F.col("id").alias("o"))
    got = leases.lease_tokens(x, "s", ["o"], 10).collect()
    assert sorted(r.token for r in got) == list(range(11, 511))
    for s in range(7):
        mine = [r.token for r in sorted((r for r in got if r.s == s), key=lambda r: r.o)]
        assert mine == sorted(mine)


def test_folds_take_streams(spark, tmp_path):
    rows = [(f"k{i % 3}", i, i * 37 % 90) for i in range(30)]
    kinds = "scope string, n long, size long"
    for part in range(3):
        spark.createDataFrame(rows[part * 10 : part * 10 + 10], kinds).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    want = sorted(map(tuple, logs.running_quota(spark.createDataFrame(rows, kinds), "scope", ["n"], "size", 200).collect()))
    got = []
    for part in range(3):  # a stream that is stopped and started again between the files goes on from its states
        stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/{{{','.join(map(str, range(part + 1)))}}}")
        inbox.run_to_end(logs.running_quota(stream, "scope", ["n"], "size", 200), inbox.idempotent_sink(f"{tmp_path}/out"), f"{tmp_path}/checkpoint")
    got = sorted(tuple(r)[:5] for r in spark.read.parquet(f"{tmp_path}/out").select("scope", "n", "size", "used", "accepted").collect())
    assert got == want and {r[4] for r in got} == {True, False}


def test_computations_of_the_callers_own(spark):
    x = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), ("b", 1, 100)], "k string, n long, v long")
    out = folds.replay_states(x, ["k"], ["n"], ["v"], lambda: 0, lambda s, v: s * 2 + v, lambda s: (s,), "total long", lambda s: "TooLarge" if s > 50 else None)
    assert sorted(map(tuple, out.collect())) == [("a", 17, None), ("b", None, "TooLarge")]
    assert folds.replay_states(x.limit(0), ["k"], ["n"], ["v"], lambda: 0, lambda s, v: s, lambda s: (s,), "total long").count() == 0
