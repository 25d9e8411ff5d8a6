import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import classify as C
from lodestone.functions import facts as K
from lodestone.functions import text as T


def one(spark, x, f):
    return spark.createDataFrame([(x,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("name, parts", [("parse_ast", ["parse", "ast", "parse_ast"]), ("HttpServer", ["http", "server", "HttpServer"]), ("get_user_by_id", ["get", "user", "by", "id", "get_user_by_id"]), ("camelCase", ["camel", "case", "camelCase"]), ("", []), ("HTTPServer2", ["http", "server2", "HTTPServer2"])])
def test_tokenize_identifier(spark, name, parts):
    assert one(spark, name, T.tokenize_identifier) == parts


@pytest.mark.parametrize("q, intent", [("What is user_id?", "conceptual"), ("Why does auth/login.py fail?", "conceptual"), ("Overview of /api/handlers", "conceptual"), ("get_neighborhood()", "structural"), ("auth/login.py", "structural"), ("def login", "structural"), ("class Authenticator", "structural"), ("login authenticate user", "logic")])
def test_intent_fast(spark, q, intent):
    assert one(spark, q, C.intent_fast) == intent


@pytest.mark.parametrize("q, intent", [("ADR tradeoff rationale", "past_decisions"), ("Why does auth/login.py fail?", "debugging"), ("Architecture overview of the store", "architecture"), ("callers of compute_pagerank", "navigation"), ("def get_embedding", "symbol_lookup")])
def test_intent_5tier(spark, q, intent):
    assert one(spark, q, C.intent_5tier) == intent


def test_trace(spark):
    t = 'Traceback:\n  File "core.py", line 5, in parse_ast\n  File "x.py", line 7\nValueError: no'
    frames = one(spark, t, T.trace_frames)
    assert [(f["file"], f["line"], f["function"]) for f in frames] == [("core.py", 5, "parse_ast"), ("x.py", 7, None)]
    assert one(spark, t, T.trace_exceptions) == ["ValueError"]


@pytest.mark.parametrize("most, budget", [(300, 255), (400, 340), (600, 510), (4000, 3500), (80, 80), (110, 100)])
def test_budget(spark, most, budget):
    assert spark.range(1).select(C.token_budget(F.lit(most)).alias("b")).first()["b"] == budget


def test_redaction(spark):
    assert one(spark, "API_KEY = 'abc123' rest", T.redact) == "API_KEY = '[REDACTED]' rest"
    assert one(spark, "AKIA" + "A" * 16, T.redact) == "[REDACTED]"
    assert one(spark, 'password: "hunter22" x', T.redact_page) == 'password: "[REDACTED]" x'
    assert one(spark, "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", T.redact_page) == "[REDACTED_PRIVATE_KEY]"


def test_utility(spark):
    v = lambda **k: spark.range(1).select(C.utility(*[F.lit(k.get(n, d)) for n, d in (("base", 1.0), ("c", 0), ("p", 0), ("n", 0), ("days", 0.0), ("m", 0))]).alias("u")).first()["u"]
    assert v() == 1.0
    assert v(days=30.0) == pytest.approx(0.5)
    assert v(c=5) > 1 and v(p=2) > 1 and v(n=1) < 1 and v(base=0.0) == 0.01


def test_nulls_do_not_fail(spark):
    d = spark.createDataFrame([(None,), ("",)], "x string")
    fs = [T.normalize_name, T.tokenize_identifier, T.subtokens, T.query_tokens, T.redact, T.redact_page, T.reading_grade, T.doc_problems, T.token_count, T.auto_key, T.trace_frames, T.sanitize_ok, C.intent_5tier, C.intent_fast, C.folder_role, C.language, C.chat_score]
    assert d.select(*[f(F.col("x")).alias(f"c{i}") for i, f in enumerate(fs)]).count() == 2


def test_conflicts_and_syllables(spark):
    assert one(spark, "a\n<<<<<<< HEAD\nb", T.has_conflict_markers)
    assert not one(spark, "a <<<<<<< HEAD", T.has_conflict_markers)
    assert [one(spark, w, T.syllables) for w in ("make", "table", "the", "banana", "")] == [1, 2, 1, 3, 0]


@pytest.mark.parametrize("path, text, want", [
    ("Dockerfile", "FROM python:3 AS base\nENV A=1\nEXPOSE 80/tcp\nCMD run\n", {("base", "python:3"), ("stage", "base"), ("env", "A"), ("port", "80/tcp"), ("command", "CMD run")}),
    ("Makefile", "CC = gcc\nall: x\n\tgcc\n", {("target", "all"), ("variable", "CC")}),
    (".env", "A=1\nexport B=2\n# C=3\n", {("variable", "A"), ("variable", "B")}),
    ("ci.yml", "name: x\njobs:\n  build:\n    steps:\n      - uses: a/b@v1\n", {("key", "name"), ("key", "jobs"), ("job", "build"), ("uses", "a/b@v1")}),
    ("p.toml", "[project]\nname = \"x\"\n", {("table", "project"), ("key", "name")}),
    ("x.json", '{"a": 1, "b": [2]}', {("key", "a"), ("key", "b")}),
    ("s.sql", "CREATE TABLE IF NOT EXISTS t (x int);\ncreate index i on t(x);", {("table", "t"), ("index", "i")}),
    ("a.md", "# Top\n- item `code`\nsee https://x.org/y", {("heading", "Top"), ("item", "item `code`"), ("code", "code"), ("link", "https://x.org/y")}),
    ("tests/test_a.py", "from app import x\n\ndef test_one():\n    pass\n", {("case", "test_one"), ("imports", "app")}),
    ("run.sh", "#!/bin/sh\nX=1\ngo() {\n  ls\n}\ngit pull\n", {("interpreter", "/bin/sh"), ("function", "go"), ("variable", "X"), ("command", "git")}),
    ("a.py", "import os\nMAX_N = 3\nclass A:\n    pass\ndef f():\n    pass\n", {("imports", "os"), ("constant", "MAX_N"), ("class", "A"), ("function", "f")}),
    ("AGENTS.md", "# Rules\n- Always test `x`\n- a note\n", {("heading", "Rules"), ("rule", "Always test `x`"), ("code", "x")}),
    ("x.bin", "FROM x", set()), ("x.json", "no", set()), ("a.py", None, set()),
])
def test_facts(spark, path, text, want):
    got = spark.createDataFrame([(path, text)], "path string, text string").select(K.facts(F.col("path"), F.col("text")).alias("f")).first()["f"]
    assert {(x["label"], x["value"]) for x in got} == want


@pytest.mark.parametrize("text, want", [("#!/bin/sh\n# one\n# two\n\n# three\n", "one two"), ("/* a\n * b\n */\nint x;", "a b"), ("// hi\nint x;", "hi"), ("x = 1\n# late", None), ("/* one line */\n// next", "one line next"), ("", None), (None, None)])
def test_leading_comment(spark, text, want):
    assert spark.createDataFrame([(text,)], "x string").select(K.leading_comment(F.col("x")).alias("y")).first()["y"] == want


@pytest.mark.parametrize("text, want", [('# c\n"""Doc\nmore."""\nx', "Doc\nmore."), ("x = 1", None), ("'''one'''", "one")])
def test_docstring(spark, text, want):
    assert one(spark, text, K.docstring) == want


def test_page_problems(spark):
    page = "# a.py\n**What it does:** uses `f()` and `ghost`\n**Key parts**\n**Connects to:** b"
    f = lambda x: K.page_problems(x, F.array(F.lit("f"), F.lit("g")), F.array(F.lit("src/a.py")))
    assert one(spark, page, f) == ["empty section **Key parts**", "unevidenced ghost"]
    assert one(spark, "# x\n**What it does:** nothing at all", f) == ["lacks specificity"]


def test_a_page_is_checked_whole(spark, tmp_path):
    """All six checks of a page, alone and in the query, whose SQL makes them too."""
    import duckdb

    from lodestone import plans

    pages = [
        ("**Key parts** \x1c\n**Connects to:** en", ["empty section **Key parts**"]),
        ("en: it Sends\nback\x0bRESULTS", ["boilerplate 4"]),
        ("`ghost` en ```", ["unbalanced fences", "unevidenced ghost"]),
        ("`self`, ` src0() `, `doc_`, `git`, `a b`, `k=v`, `x`, `()`, en.", []),
        ("men and src01, _en_", ["lacks specificity"]),
        ("**What it does:**\xa0**How it works**`Ghost()`", ["empty section **What it does:**", "unevidenced Ghost()", "lacks specificity"]),
    ]
    one_by_one = [one(spark, x, lambda c: T.doc_problems(c, symbols=F.array(F.lit("src0"), F.lit("en"), F.lit(None)), paths=F.array(F.lit("docs/en/doc_1.py")))) for x, _ in pages]
    assert one_by_one == [want for _, want in pages]
    assert one(spark, "say c++ x.", lambda c: T.unspecific(c, F.array(F.lit("c"), F.lit("2 of x"), F.lit("git")))) == []
    rows = [(i, x, "en", "src0", len(x)) for i, (x, _) in enumerate(pages)] + [(6, "none", None, None, 4), (7, "é `ab`", "c.", None, 4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = {r["doc_id"]: r["problems"] for r in plans.queries()["doc_validate"](spark, str(tmp_path)).collect()}
    assert got == dict(con.execute(plans.oracles()["doc_validate"]).fetchall())
    assert [got[i] for i in range(6)] == [len(want) for _, want in pages] and got[6] == 0 and got[7] == 2


def test_a_reading_grade_shares_its_words(spark):
    from pyspark.sql import functions as F

    from lodestone.functions import text as T

    df = spark.createDataFrame([("One two three four five six. Seven eight nine table.",), ("short",), (None,)], "t string").select(T.reading_grade(F.col("t"), 6).alias("g"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 2  # the plan without shared values has five
    assert [r["g"] for r in df.collect()] == [round(0.39 * 5 + 11.8 * 1.2 - 15.59, 6), 0.0, 0.0]


def test_a_page_is_worked_out_once(spark):
    """The text of a page is an expression of its own: it is in the plan once. Grades against plain Python; a pattern in any case."""
    df = spark.createDataFrame([("é Runs  code\nTHROUGH the ```",), ("",), (None,)], "x string")
    found = df.select(T.doc_problems(F.regexp_replace("x", "[^ -~\n]", "")).alias("p"))
    assert found._jdf.queryExecution().analyzed().toString().count("[^ -~") == 1
    assert [r["p"] for r in found.collect()] == [["unbalanced fences", "boilerplate 2"], [], []]

    def grade(t):
        t = re.sub(r"(?m)^\s*[-*0-9.]+\s+", "", t)  # list marks are no prose
        words = [w.lower() for w in re.findall(r"(?<![A-Za-z0-9_])[a-zA-Z]+(?![A-Za-z0-9_])", t)]
        body = lambda w: w[:-1] if w.endswith("e") and not w.endswith("le") else w
        total = sum(1 if len(w) <= 3 else max(1, len(re.findall("[aeiouy]+", body(w)))) for w in words)
        sentences = sum(bool(re.search(r"[^ \t\n\r\f\x0b]", s)) for s in re.split("[.!?]+", t))
        return 0.39 * len(words) / sentences + 11.8 * total / len(words) - 15.59 if len(words) >= 10 and sentences else 0.0

    words = ["make", "Table", "THE", "banana", "eye", "queue", "rhythms", "brrr", "a1b", "x_y", "idea", "apple", "tee", "agree", "e", "cafe", "le", "ile", "axle", "Aye", "one2", ".", "?!", " . ", "\n", "!!", "pfft."]
    rng = random.Random(5)
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(300)] + [". " * 20 + "one two three four five six seven eight nine ten"]
    got = [r["g"] for r in spark.createDataFrame([(t,) for t in texts], "x string").coalesce(1).select(T.reading_grade(F.col("x"), 6).alias("g")).collect()]
    assert all(abs(g - grade(t)) < 2e-6 for g, t in zip(got, texts, strict=True)) and len(set(got)) > 200
