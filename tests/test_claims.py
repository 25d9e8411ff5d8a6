"""Claims of tasks: concurrent workers, leases that run out, outcomes that come too late."""

import random
import threading

from lodestone.operators import claims


def queue(spark, n):
    return spark.createDataFrame([(f"t{k}", k // 2) for k in range(n)], "task_id string, created_at long")


def test_two_sessions_run_each_task_once(spark, tmp_path):
    got, log = [], str(tmp_path / "log")

    def work(session, name):
        q = queue(session, 7)
        while rows := claims.claim(q, log, name, now=100, most=2).collect():
            got.extend((r["task_id"], name) for r in rows)

    threads = [threading.Thread(target=work, args=(spark.newSession(), f"w{i}")) for i in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(t for t, _ in got) == [f"t{k}" for k in range(7)]
    assert {r["status"] for r in claims.states(queue(spark, 7), claims.entries(spark, log), 120).collect()} == {"running"}


def test_leases_and_outcomes(spark, tmp_path):
    q, log = queue(spark, 2), str(tmp_path / "log")
    status = lambda now: {r["task_id"]: (r["status"], r["attempts"]) for r in claims.states(q, claims.entries(spark, log), now).collect()}
    assert status(0) == {"t0": ("pending", 0), "t1": ("pending", 0)}
    [a] = claims.claim(q, log, "a", now=0, lease=10, most=1).collect()
    assert a["task_id"] == "t0" and status(5)["t0"] == ("running", 0) and status(10)["t0"] == ("pending", 0)
    [b] = claims.claim(q, log, "b", now=10, lease=10).collect()
    assert b["task_id"] == "t0" and b["token"] > a["token"]
    claims.finish(spark, log, [("t0", a["token"], True)], "a", 11)  # overtaken
    assert status(11)["t0"] == ("running", 0)
    claims.finish(spark, log, [("t0", b["token"], False)], "b", 12)
    assert status(12)["t0"] == ("pending", 1)
    assert [r["task_id"] for r in claims.claim(q, log, "c", now=13, most=5).collect()] == ["t1"]  # t0 waits two seconds
    [c] = claims.claim(q, log, "c", now=14).collect()
    claims.finish(spark, log, [("t0", c["token"], True), ("t0", c["token"], False)], "c", 15)
    assert status(99)["t0"] == ("done", 1) and claims.claim(q, log, "d", now=20).count() == 0


def test_a_taken_segment_stays(spark, tmp_path):
    log = str(tmp_path / "log")
    claims.entries(spark, log)
    assert claims._append(spark, log, 0, [{"task_id": "x", "kind": "claim"}]) and not claims._append(spark, log, 0, [{"task_id": "y", "kind": "claim"}])
    path = spark._jvm.org.apache.hadoop.fs.Path
    for seg, want in ((0, False), (1, True)):
        assert claims._renamed(spark, path(log, "_h"), path(log, f"{seg:020d}.json"), b'{"task_id": "z", "kind": "claim"}\n') is want
    assert {(r["seg"], r["task_id"]) for r in claims.entries(spark, log).collect()} == {(0, "x"), (1, "z")}


def test_states_against_a_replay(spark):
    """Entries in their order, one by one, in plain Python."""
    rng = random.Random(3)
    log, claimed = [], {}
    for seg in range(400):
        task = f"t{rng.randrange(40)}"
        if rng.random() < 0.5 or task not in claimed:
            claimed.setdefault(task, []).append(seg)
            log.append((seg, task, "claim", None, "w", seg, seg + rng.randrange(200)))
        else:
            log.append((seg, task, rng.choice(["fail", "fail", "done"]), rng.choice(claimed[task][-2:]), "w", seg, None))
    want = {f"t{k}": ["pending", 0, 0, None] for k in range(45)}
    state = {}
    for seg, task, kind, token, _, at, until in log:
        s = state.setdefault(task, {"token": None, "end": None, "fails": 0, "ended": set()})
        if kind == "claim":
            s.update(token=seg, until=until, end=None)
        elif token not in s["ended"]:
            s["ended"].add(token)
            if token == s["token"]:
                s["end"] = (kind, at)
                s["fails"] += kind == "fail"
    now = 420
    for task, s in state.items():
        kind, at = s["end"] or (None, None)
        status = "done" if kind == "done" else "failed" if s["fails"] >= 3 else "running" if not kind and s["until"] > now else "pending"
        want[task] = [status, s["fails"], at + min(30, 2 ** s["fails"]) if kind == "fail" else s["until"], s["token"]]
    log += [(500, "t1", "done", None, "w", 500, None), (501, "t44", "fail", None, "w", 501, None), (502, None, "claim", None, "w", 502, 999)]
    frame = spark.createDataFrame(log, "seg long, " + claims.ENTRY)
    q = spark.createDataFrame([(f"t{k}", 0) for k in range(45)], "task_id string, created_at long")
    got = {r["task_id"]: [r["status"], r["attempts"], r["due"], r["token"]] for r in claims.states(q, frame, now).collect()}
    assert got == want and {w[0] for w in want.values()} == {"pending", "done", "failed", "running"}
    empty = claims.states(q.limit(0), frame.limit(0), now)
    assert empty.columns == ["task_id", "created_at", "status", "attempts", "due", "token"] and empty.count() == 0
