import pytest
from pyspark.sql import functions as F

from lodestone.api import TOOLS, OperationError, Workspace, envelope, handle
from lodestone.operators import lexical

FILES = [
    ("app/auth.py", "from .store import Store\n\n\nclass Authenticator:\n    def login(self, user_id):\n        return Store().get_user(user_id)\n"),
    ("app/store.py", "class Store:\n    def get_user(self, user_id):\n        return user_id\n"),
    ("app/main.py", "from app.auth import Authenticator\n\n\ndef run():\n    return Authenticator().login(1)\n"),
    ("tests/test_auth.py", "from app.auth import Authenticator\n\n\ndef test_login():\n    assert Authenticator().login(1)\n"),
]


@pytest.fixture(scope="module")
def ws(spark, tmp_path_factory):
    w = Workspace(spark, str(tmp_path_factory.mktemp("ws")), clock=lambda: 1_000_000)
    w.index(spark.createDataFrame(FILES, "path string, text string"), commit="c1")
    return w


def test_search_prefers_source_over_tests(ws):
    hits = ws.search("login").collect()
    assert hits[0]["path"] == "app/auth.py" and any(h["path"].startswith("tests/") for h in hits)
    assert ws.search("getUser").first()["name"] == "get_user"
    assert ws.search("xyznonexistent9999").count() == 0


def test_trace_search(ws):
    q = 'Traceback\n  File "app/store.py", line 3, in get_user\nValueError: x'
    assert {h["name"] for h in ws.search(q, 2).collect()} == {"Store", "get_user"}


def test_structure(ws):
    assert [r["name"] for r in ws.outline("app/store.py").collect()] == ["Store", "get_user"]
    assert "..." in ws.skeleton("app/store.py").first()["skeleton"]
    assert ws.read_symbol("get_user").first()["text"].startswith("   2 │ ")
    assert {r["name"] for r in ws.explain("get_user").collect()} >= {"get_user", "login"}
    with pytest.raises(OperationError, match="no symbol"):
        ws.explain("nope")
    assert envelope(ws.explain, "nope")["error"]["code"] == "NOT_FOUND"


def test_impact(ws, spark):
    r = spark.createDataFrame([("app/auth.py", 5, 6)], "path string, lo int, hi int")
    out = ws.blast(r)
    assert {x["name"] for x in out["touched"].collect()} == {"Authenticator", "login"}
    assert {x["name"] for x in out["callers"].collect()} == {"run"}
    assert {x["name"] for x in out["tests"].collect()} == {"test_login"}
    assert [x["path"] for x in ws.test(r).collect()] == ["tests/test_auth.py"]


def test_pack_and_hubs(ws):
    assert ws.pack("login", 400).agg({"used": "max"}).first()[0] <= 340
    assert ws.hubs(3).count() == 3
    assert set(ws.session_preamble()) == {"counts", "checkpoint", "hubs", "lessons", "memories"}


def test_pack_text(ws, spark, tmp_path):
    blocks = ws.pack("login", 400).orderBy("position").collect()
    assert [b["position"] for b in blocks] == list(range(len(blocks))) and blocks[0]["tier"] == 1 and "def login" in blocks[0]["text"]
    assert {b["tier"] for b in ws.pack("login", 4_000).collect()} == {1, 2}
    assert ws.pack("login", 90).agg({"used": "max"}).first()[0] <= 90
    ws.log_decision("we chose tables because of speed TOKEN=abcdefgh", "ctx")
    text = ws.pack_text("ADR tradeoff rationale of the login decision", 2_000, path=str(tmp_path / "out"))
    assert "# Decisions" in text and "abcdefgh" not in text
    assert "# Decisions" in "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect())


def test_search_uses_vectors_and_neighbours(ws, spark):
    batch = ws.search_batch(spark.createDataFrame([(1, "login"), (2, "getUser"), (3, "zzzqqq")], "query_id long, query string")).collect()
    assert {r["query_id"] for r in batch} >= {1, 2}
    assert {r["name"] for r in batch if r["query_id"] == 2} >= {"get_user", "login"}  # a caller comes along
    assert any("semantic" in r["reason"] for r in batch) and any(r["reason"].startswith("structural") for r in batch)
    seen = []
    ws.on_trace = seen.append
    ws.search("login"), ws.search("login")
    ws.on_trace = None
    assert seen[-1]["cached"] and ws.trace_latest()["elements"][0]["name"] == "login"


def test_plug_ins(spark, tmp_path):
    import numpy as np

    from lodestone import providers
    from lodestone.operators import parse

    class Length:
        name = "length"

        def embed(self, texts):
            return np.array([[len(t), 1.0] for t in texts], np.float32)

    class Half:
        def count(self, texts):
            return [len(t) // 2 for t in texts]

    w = Workspace(spark, str(tmp_path / "w"), embedder=Length(), counter=Half())
    w.index(spark.createDataFrame([("a.py", "def f():\n    pass\n")], "path string, text string"))
    assert w.embeddings().first()["model"] == "length"
    assert [r["n"] for r in spark.createDataFrame([("abcd",), (None,)], "x string").select(providers.token_counts(F.col("x"), Half()).alias("n")).collect()] == [2, 0]
    providers.register_parser("cobol", lambda t: ([{"name": "only", "kind": "program"}], ["other"]))
    try:
        assert parse.symbols_of("x", "cobol")[0]["name"] == "only" and parse.imports_of("x", "cobol") == ["other"]
    finally:
        del providers.PARSERS["cobol"]


def test_envelope_and_handle(ws):
    cut = envelope(ws.outline, "app/auth.py", rows=1)
    assert cut["ok"] and len(cut["data"]) == 1 and cut["warnings"] and cut["dirty_tree"] is False
    assert handle(ws, {"op": "ping"})["data"] == "pong" and not handle(ws, {"op": "_write"})["ok"]
    assert handle(ws, {"op": "query", "args": {"query": "login"}})["data"][0]["name"] == "login"
    assert all(callable(getattr(ws, t)) for t in TOOLS)
    assert ws.selftest().where("not ok").count() == 0


def test_one_write_path_redacts(ws):
    ws.log_decision("password=hunter2hunter2", "API_KEY=abcdefg")
    a = ws.submit_lesson("SECRET=topsecret", "TOKEN=abcdefg", [])
    ws.create_checkpoint("PASSWORD=abcdefg", [], next_step="TOKEN=zzzzzzz", branch="other")
    stored = "".join(str(r) for n in ("decisions", "lessons", "checkpoints") for r in ws.log(n).collect())
    assert not any(x in stored for x in ("hunter2", "abcdefg", "topsecret", "zzzzzzz"))
    with pytest.raises(OperationError):
        ws.log_decision("a\x00b")
    ws.reject_lesson(a)
    assert ws.lessons("rejected").count() == 1


def test_updates_keep_what_they_should(ws):
    a = ws.remember("one", key="same")
    ws.cite(a, "helpful")
    assert ws.remember("two", key="same") == a
    assert ws.utilities().where(F.col("id") == a).first()["citation_count"] == 1
    before = ws.compact("memories")
    assert before > 1 and ws.compact("memories") == 1 and ws.memories().where("context_key = 'same'").first()["payload"] == "two"
    ws.forget("same")


def test_ties_in_time_keep_the_order_of_writes(ws):
    for i in range(4):
        ws.remember(f"n{i}", key=f"tie{i}")
        ws.forget(f"tie{i}")
    assert ws.memories().where("context_key like 'tie%'").count() == 0


def test_memory(ws):
    ws.remember("first note about tokens API_KEY=abcdef", key="k")
    ws.remember("second note", key="k")
    got = ws.recall().collect()
    assert len(got) == 1
    assert "abcdef" not in "".join(str(r) for r in ws.log("memories").collect())
    gid = ws.remember("shared rule", key="g", scope="global")
    assert ws.recall("shared").count() == 0
    ws.ingest_global(gid[:8])
    assert ws.recall("shared").count() == 1
    ws.cite(gid, "thumbs_up")
    assert ws.utilities().first()["id"] == gid
    ws.forget("g")
    assert ws.list_global().count() == 0
    with pytest.raises(OperationError):
        ws.remember("a\x00b")


def test_lessons_and_checkpoints(ws):
    a = ws.submit_lesson("x", "y", ["gone.py", "app/auth.py"])
    assert ws.lessons().count() == 0
    ws.review_lesson(a, "approved")
    assert ws.lessons().count() == 1
    assert [r["path"] for r in ws.verify().collect()] == ["gone.py"]
    b = ws.submit_lesson("old", "z", [], days=-1)
    assert [r["id"] for r in ws.prune().collect()] == [b]
    ws.create_checkpoint("doing", ["a.py"])
    assert ws.checkpoints("main").count() == 1
    ws.record_call("anthropic", "haiku", 1_000_000, 0, "chat")
    assert ws.usage().first()["cost"] == pytest.approx(0.25)
    ws.append("commands", {"command": "search", "served": 10})
    assert ws.stats().first()["avoided"] == 80


def test_sync_and_rollback(ws, spark):
    head = ws.status().first()["snapshot"]
    clock = ws.clock
    ws.clock = lambda: 1_000_100
    changed = [*FILES[:-1], ("app/new.py", "def fresh():\n    pass\n")]
    kinds = {(r["path"], r["change"]) for r in ws.sync(spark.createDataFrame(changed, "path string, text string")).collect()}
    assert kinds == {("app/new.py", "A"), ("tests/test_auth.py", "D")}
    assert ws.outline("app/new.py").count() == 1
    ws.clock = lambda: 1_000_200
    ws.rollback("main", head)
    assert ws.outline("app/new.py").count() == 0 and ws.checkpoints("main").count() == 0
    ws.clock = clock


def indexed(w):
    """What a workspace's index and embeddings say, whatever their segments."""
    i = w.lexicon()
    p = lexical._live(i.postings, i)
    n = i.terms.groupBy("term").agg(F.sum("n").alias("n"), F.sum("n_body").alias("n_body")).where("n > 0")
    return [sorted(map(str, d.collect())) for d in (p.select("term", "doc_id", "tf", "body", "dl"), n, i.lengths.select("doc_id", "dl"), w.embeddings())]


def test_one_changed_file_writes_one_small_segment(spark, tmp_path, monkeypatch):
    schema = "path string, text string"
    files = [(f"m{i}.py", f"def alpha{i}(x):\n    return beta{i} + gamma\n") for i in range(30)]
    monkeypatch.setattr(lexical, "SEGMENTS", 2)
    w = Workspace(spark, str(tmp_path / "w"))
    w.index(spark.createDataFrame(files, schema))
    for k in range(3):
        files[k % 2] = (files[k % 2][0], f"def alpha{k}(x):\n    return delta{k}\n\n\ndef more{k}():\n    return gamma\n")
        if k == 1:
            files = files[:-1]
        before = w._segments(w._need("main"))
        w.sync(spark.createDataFrame(files, schema))
        after = w._segments(w._need("main"))
        if len(after) > 1:
            assert after[:-1] == before and spark.read.parquet(f"{after[-1]}/lengths").count() <= 2
        else:
            assert len(before) > 1  # merged
    assert 1 <= len(after) <= lexical.SEGMENTS
    whole = Workspace(spark, str(tmp_path / "x"))
    whole.index(spark.createDataFrame(files, schema))
    assert indexed(w) == indexed(whole)
    for q in ("delta2", "more1 gamma"):
        assert [tuple(r) for r in w.search(q).collect()] == [tuple(r) for r in whole.search(q).collect()]
    assert w.doctor().where("not ok").count() == 0 and len(w.vacuum()) == 3 and w.search("gamma", 5).count() == 5


def test_moved_and_edited_files_and_dirty_lines(spark, tmp_path):
    schema = "path string, text string"
    w = Workspace(spark, str(tmp_path / "w"))
    w.index(spark.createDataFrame(FILES, schema))
    edited = FILES[1][1].replace("return user_id", "return str(user_id)")
    new = [FILES[0], ("app/shop.py", edited), FILES[2], FILES[3], ("app/none.py", "x = 1\n")]
    d = spark.createDataFrame(new, schema)
    ranges = {tuple(r) for r in w.dirty(d).collect()}
    assert ranges == {("app/store.py", 3, 3), ("app/shop.py", 3, 3), ("app/none.py", 1, 1)}
    touched = w.blast(w.dirty(d))["touched"]
    assert {r["name"] for r in touched.collect()} == {"Store", "get_user"}
    kinds = {(r["path"], r["change"], r["old_path"], r["similarity"] is None) for r in w.sync(d).collect()}
    assert kinds == {("app/shop.py", "R", "app/store.py", False), ("app/none.py", "A", None, True)}
    assert {r["name"] for r in w.outline("app/shop.py").collect()} == {"Store", "get_user"} and w.dirty(d).count() == 0
    commits = spark.createDataFrame([("h1", "a", 5, "made", "s"), ("h2", "a", 6, "moved", "s")], "commit_hash string, author string, secs long, message string, summary string")
    w.record_commits(commits)
    changes = spark.createDataFrame([("h1", 1, "app/store.py", "app/store.py", 0, 0, 1, 3), ("h2", 2, "app/shop.py", "app/store.py", 3, 1, 3, 1)], "commit_hash string, gen long, path string, old_path string, old_start long, old_count long, new_start long, new_count long")
    assert {r["message"] for r in w.lineage(changes, "get_user").collect()} == {"made", "moved"}


def test_incremental_sync_equals_a_full_index(spark, tmp_path):
    schema = "path string, text string"
    a, b = Workspace(spark, str(tmp_path / "a")), Workspace(spark, str(tmp_path / "b"))
    a.index(spark.createDataFrame(FILES, schema))
    changed = [FILES[0], ("app/shop.py", FILES[1][1]), (FILES[2][0], FILES[2][1] + "\n\ndef extra():\n    return run()\n"), ("app/new.py", "from app.auth import Authenticator\n\n\ndef fresh():\n    return Authenticator()\n")]
    kinds = {(r["path"], r["change"], r["old_path"]) for r in a.sync(spark.createDataFrame(changed, schema)).collect()}
    assert kinds == {("app/shop.py", "R", "app/store.py"), ("app/main.py", "M", None), ("app/new.py", "A", None), ("tests/test_auth.py", "D", None)}
    b.index(spark.createDataFrame(changed, schema))
    for t in ("symbols", "imports", "edges"):
        x, y = (sorted(map(str, w.table(t).collect())) for w in (a, b))
        assert x == y, t
    assert indexed(a) == indexed(b)
    assert a.sync(spark.createDataFrame(changed, schema)).count() == 0
    with pytest.raises(OperationError):
        a.index(spark.createDataFrame(changed, schema), in_progress="merge")
    assert len(a.vacuum()) == 1 and a.doctor().where("not ok").count() == 0 and a.repair() == a.status().first()["snapshot"]
    a.wipe(True)
    assert a.status().count() == 0


def test_evaluation(ws, spark):
    q = spark.createDataFrame([(1, "login", "app/auth.py"), (2, "get user", "app/store.py")], "query_id long, query string, path string")
    assert ws.bench(q).agg({"recall_5": "min"}).first()[0] == 1.0
    rows = ws.compare(q, (50, 4_000)).collect()
    assert {(r["query_id"], r["budget"]) for r in rows} == {(i, b) for i in (1, 2) for b in (50, 4_000)}
    assert all(r["recall"] == 1.0 for r in rows if r["budget"] == 4_000) and all(r["tokens"] <= r["budget"] for r in rows)


def test_pages_commits_and_integrity(ws, spark):
    assert ws.generate_pages().count() == len(FILES) and ws.generate_pages().count() == 0
    assert ws.search_pages("authenticator").first()["path"] == "app/auth.py"
    assert {r["table"]: r["rows"] for r in ws.integrity().collect()}["files"] == len(FILES)
    c = spark.createDataFrame([("h1", "a", 5, "add the store because of speed", "s"), ("h2", "a", 6, "other", "s")], "commit_hash string, author string, secs long, message string, summary string")
    ws.record_commits(c)
    ws.record_commits(c)
    assert [r["commit_hash"] for r in ws.rationale("why was speed changed?").collect()] == ["h1"]
    assert ws.rationale("why?").count() == 2
