from pyspark.sql import functions as F

from lodestone.sources import vcs


def test_commit_log(spark):
    text = "h1\x1fAda\x1f2024-01-02T03:04:05+00:00\x1ffeat: one\x1fbody\n\x1e\nh2\x1fBob\x1fbroken\x1ffix\x1e\n"
    got = [tuple(r) for r in vcs.commits(spark.createDataFrame([(text,)], "value string")).orderBy("commit_hash").collect()]
    assert got == [("h1", "Ada", 1704164645, "feat: one\nbody", "feat: one"), ("h2", "Bob", None, "fix", "fix")]


def test_status_lines(spark):
    lines = [(" M src/a.py",), ("R  old.py -> new.py",), ("?? \"with space.py\"",), ("x",)]
    got = [tuple(r) for r in vcs.status(spark.createDataFrame(lines, "line string")).collect()]
    assert got == [("src/a.py", "M", False), ("new.py", "R", False), ("with space.py", "??", True)]


def test_name_status(spark):
    lines = [("A\ta",), ("R100\tb\tc",), ("D\td",), ("X\te",), ("M",)]
    assert [tuple(r) for r in vcs.name_status(spark.createDataFrame(lines, "line string")).collect()] == [("A", "a", None), ("R", "c", "b"), ("D", "d", None)]


def test_model_lists(spark):
    rows = [('{"models": [{"name": "b"}, {"model": "a"}]}',), ('{"data": [{"id": "x"}, {"id": ""}]}',), ("nope",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "j string").select(vcs.model_names(F.col("j"))).collect()]
    assert got == [["a", "b"], ["x"], [], []]
    pairs = [("llama3", "llama3:latest", True), ("llama3:8b", "llama3", True), ("a:1", "a:2", False), ("", "x", False), ("Q", "q", True)]
    d = spark.createDataFrame([p[:2] for p in pairs], "a string, b string")
    assert [r[0] for r in d.select(vcs.model_matches(F.col("a"), F.col("b"))).collect()] == [p[2] for p in pairs]


def test_tolerant_json(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"calls": 3}\n{oops\n')
    got = vcs.read_json(spark, str(tmp_path), "calls long").collect()
    assert [r["calls"] for r in got] == [3, None] and got[1]["_corrupt"] == "{oops"


CHANGE = "commit_hash string, gen long, path string, old_path string, old_start long, old_count long, new_start long, new_count long"


def test_lineage(spark):
    """c3 puts ten lines on top of the file, so what c2 changed as lines 5 and 6 are lines 15 and 16 today."""
    s = spark.createDataFrame([("s1", "f", 11, 20), ("s2", "f", 30, 40)], "symbol_id string, path string, start_line int, end_line int")
    t = spark.createDataFrame([("c1", 1, "f", "f", 0, 0, 1, 30), ("c2", 2, "f", "f", 5, 2, 5, 2), ("c3", 3, "f", "f", 0, 0, 1, 10), ("c4", 4, "g", "g", 1, 9, 1, 9)], CHANGE)
    log = spark.createDataFrame([(f"c{c}", c, "m") for c in range(1, 5)], "commit_hash string, secs long, message string")
    assert {(r["symbol_id"], r["commit_hash"]) for r in vcs.lineage(s, t, log).collect()} == {("s1", "c1"), ("s1", "c2"), ("s2", "c1")}
    assert {(r["symbol_id"], r["commit_hash"]) for r in vcs.lineage(s, t, log, 1).collect()} == {("s1", "c2"), ("s2", "c1")}


def test_lineage_by_content(spark):
    s = spark.createDataFrame([("s1", "f", "run"), ("s2", "f", "stop")], "symbol_id string, path string, name string")
    texts = ["def run(x):", "def run(x): # moved", "return prerun", "run() or stop() or run()", "run() or run() or stop()"]
    v = spark.createDataFrame([("f", i, f"c{i}", t) for i, t in enumerate(texts)] + [("g", 9, "c9", "run run")], "path string, gen long, commit_hash string, text string")
    log = spark.createDataFrame([(f"c{i}", i, "m") for i in range(10)], "commit_hash string, secs long, message string")
    known = spark.createDataFrame([("s2",)], "symbol_id string")
    assert {(r["symbol_id"], r["commit_hash"]) for r in vcs.lineage_by_content(s, v, log, known).collect()} == {("s1", "c0"), ("s1", "c2"), ("s1", "c3")}


def test_recent_commits_and_ranges(spark):
    t = spark.createDataFrame([("f", f"c{i}") for i in range(8)] + [("f", "c7"), ("g", "c1")], "path string, commit_hash string")
    log = spark.createDataFrame([(f"c{i}", i // 2, f"m{i}") for i in range(8)], "commit_hash string, secs long, summary string")
    got = [r["commit_hash"] for r in vcs.recent_commits(t, log, 3).where("path = 'f'").orderBy("rank").collect()]
    assert got == ["c6", "c7", "c4"]
    files = spark.createDataFrame([("new.py", "a\nb\n"), ("old.py", "a")], "path string, text string")
    status = spark.createDataFrame([("new.py", "??", True), ("old.py", "M", False), ("docs/x.md", "??", True)], "path string, state string, untracked boolean")
    hunks = spark.createDataFrame([("old.py", 1, 1)], "path string, lo int, hi int")
    assert {tuple(r) for r in vcs.dirty_ranges(hunks, status, files).collect()} == {("old.py", 1, 1), ("new.py", 1, 2)}
    assert [r["path"] for r in vcs.documentation(spark.createDataFrame([("a.md",), ("b.py",), ("docs/x.md",)], "path string"), status).collect()] == ["a.md", "docs/x.md"]
