import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph, intervals, lexical, memory, packing, parse, resolve, snapshot, vectors
from lodestone.sources import files as S


def power_iteration(edges, chosen=None, damping=0.85, iterations=20):
    nodes = sorted({x for e in edges for x in e})
    start = [x for x in nodes if x in (chosen or [])] or nodes
    p = {x: (1 / len(start) if x in start else 0.0) for x in nodes}
    out, ranks = {x: sum(a == x for a, _ in edges) for x in nodes}, dict(p)
    for _ in range(iterations):
        lost = sum(r for x, r in ranks.items() if not out[x])
        new = {x: (1 - damping + damping * lost) * p[x] for x in nodes}
        for a, b in edges:
            new[b] += damping * ranks[a] / out[a]
        ranks = new
    return {str(x): r for x, r in ranks.items()}


GRAPHS = [[(i % 7, (i * 5 + 2) % 11) for i in range(30)], [(0, 1), (1, 2), (2, 0), (3, 0), (2, 4)], [(1, 1), (1, 1), (1, 2)], [(i, 100) for i in range(50)] + [(100, i) for i in range(30)], [(i, i + 1) for i in range(12)]]


@pytest.mark.parametrize("edges,heavy", [(GRAPHS[0], 2), (GRAPHS[1], 10_000), (GRAPHS[2], 10_000), (GRAPHS[3], 10), (GRAPHS[4], 10_000)])
def test_pagerank(spark, monkeypatch, edges, heavy):
    monkeypatch.setattr(graph, "HEAVY_LEAST", heavy)
    e = spark.createDataFrame(edges, "src int, dst int")
    for chosen in (None, [3, 99_999]):
        p = None if chosen is None else spark.createDataFrame([(str(x),) for x in chosen], "node string")
        got = {r["node"]: r["rank"] for r in graph.pagerank(e, p).collect()}
        assert got == pytest.approx(power_iteration(edges, chosen), abs=1e-12) and sum(got.values()) == pytest.approx(1.0)


def test_pagerank_of_no_edges(spark):
    assert graph.pagerank(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_neighbourhood_directions_and_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    s = spark.createDataFrame([("a",)], "seed string")
    get = lambda d, k: {r["node"]: r["distance"] for r in graph.neighbourhood(e, s, k, d).collect()}
    assert get("callees", 1) == {"a": 0, "b": 1}
    assert get("callers", 1) == {"a": 0, "c": 1}
    assert get("down", 5) == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert get("both", 1) == {"a": 0, "b": 1, "c": 1}
    with pytest.raises(ValueError):
        graph.neighbourhood(e, s, 1, "sideways")


def test_overlap_reports_each_pair_once(spark):
    spans = spark.createDataFrame([(i, "f", 10 * i + 1, 10 * i + 5 + (300 if i == 3 else 0)) for i in range(600)], "symbol_id int, path string, start_line int, end_line int")
    ranges = spark.createDataFrame([("f", 1, 6500), ("f", 40, 40), ("g", 1, 9)], "path string, lo int, hi int")
    assert intervals.overlap(spans, ranges).where("lo = 1").count() == 600
    assert intervals.overlap(spans, ranges).where("lo = 40").count() == 1
    assert intervals.touched(spans, ranges).count() == 600


def test_cosine_ties_and_blocks(spark):
    v = spark.createDataFrame([(i, [1.0 if j == i % 64 else 0.0 for j in range(64)]) for i in range(100)], "vec_id long, embedding array<float>").repartition(5)
    q = v.where("vec_id < 2").select(F.col("vec_id").alias("query_id"), "embedding")
    got = [(r["query_id"], r["vec_id"], r["score"], r["rank"]) for r in vectors.topk(q, v, 5).orderBy("query_id", "rank").collect()]
    assert [g[1] for g in got[:5]] == [0, 64, 1, 2, 3] and got[0][2] == 1.0 and got[1][2] == 1.0
    old, vectors.QUERY_BLOCK = vectors.QUERY_BLOCK, 1
    assert sorted((r["query_id"], r["vec_id"], r["score"], r["rank"]) for r in vectors.topk(q, v, 5).collect()) == sorted(got)
    vectors.QUERY_BLOCK = old


def test_bm25_prefix_counts_bodies_twice(spark):
    docs = spark.createDataFrame([(1, "getUser", "get user by id"), (2, "other", "nothing here"), (3, "getter", "x")], "doc_id long, name string, text string")
    i = lexical.build_index(docs, "doc_id", "text", "name")
    q = spark.createDataFrame([(7, "get"), (7, "zzz")], "query_id long, term string")
    assert [r["doc_id"] for r in lexical.bm25_prefix(q, i).orderBy("rank").collect()] == [1, 3]
    assert lexical.bm25(spark.createDataFrame([(1, "absent")], "query_id long, term string"), i).count() == 0


def test_greedy_pack(spark):
    items = spark.createDataFrame([(1, 1, "a", 60, 10), (1, 2, "b", 70, 20), (1, 3, "c", 200, 150), (1, 4, "d", 5, 5), (2, 1, "e", 500, 400)], "query_id long, rank int, item string, full_tokens long, folded_tokens long")
    got = {(r["query_id"], r["item"]): (r["mode"], r["tokens"]) for r in packing.greedy(items, F.lit(100)).collect()}
    assert got == {(1, "a"): ("full", 60), (1, "b"): ("folded", 20), (1, "d"): ("full", 5), (2, "e"): ("cut", 100)}


def test_simhash_bands_lose_no_pair(spark):
    base = 0x0123456789ABCDEF
    hs = [base, base ^ 1, base ^ (1 << 63), base ^ (7 << 20), base ^ (15 << 20), -1, -1]
    hs = [h - (1 << 64) if h >= 1 << 63 else h for h in hs]
    got = {(r["a"], r["b"]) for r in memory.simhash_pairs(spark.createDataFrame(list(enumerate(hs)), "id long, simhash long"), "id").collect()}
    assert got == {(a, b) for a in range(6) for b in range(a + 1, 6) if bin((hs[a] ^ hs[b]) & (2**64 - 1)).count("1") <= 3}


def test_simhash_links_tell_every_link(spark, tmp_path):
    """Classes and their pairs give back all links between rows; different texts of one hash, and texts without a word, are linked."""
    import duckdb

    from lodestone import plans

    hs = [5, 7, 7, 5, 1 << 40, 7, -1, -1, None]
    got = [tuple(r) for r in memory.simhash_links(spark.createDataFrame(list(enumerate(hs)), "id long, simhash long"), "id").collect()]
    rep = {b: a for a, b, d in got if d == 0}
    pairs = {(a, b): d for a, b, d in got if d}
    link = lambda x, y: 0 if x == y else pairs.get((min(x, y), max(x, y)))
    for a in range(8):
        for b in range(a + 1, 8):
            d = bin((hs[a] ^ hs[b]) & (2**64 - 1)).count("1")
            assert link(rep.get(a, a), rep.get(b, b)) == (d if d <= 3 else None)
    texts = ["red fox runs", "runs fox red", "a", "", "!", None, "red fox runs"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = sorted(tuple(r) for r in plans.queries()["simhash_dups"](spark, str(tmp_path)).collect())
    assert found == sorted(con.execute(plans.oracles()["simhash_dups"]).fetchall()) == [(0, 1, 0), (0, 6, 0), (2, 3, 0), (2, 4, 0)]


def test_note_stages(spark):
    kept = spark.createDataFrame([(1, 0, [1.0, 0.0, 0.0]), (2, (1 << 40) - 1, [0.0, 1.0, 0.0])], "id long, simhash long, vector array<double>")
    far = (1 << 62) - (1 << 41)
    new = spark.createDataFrame([(10, 1, None), (11, far, [0.98, 0.02, 0.0]), (12, far, [0.85, 0.52, 0.0]), (13, far, [0.0, 0.0, 1.0])], "id long, simhash long, vector array<double>")
    got = {r["id"]: (r["status"], r["matched"], r["stage"]) for r in memory.classify_notes(new, kept).collect()}
    assert got == {10: ("duplicate", 1, "simhash"), 11: ("duplicate", 1, "cosine"), 12: ("consolidate", 1, "cosine"), 13: ("novel", None, "cosine")}


def test_change_kinds(spark):
    rows = [(0, "main", "a", "t0", "x", ["r"]), (1, "main", "b", "t1", "x", ["a"]), (2, "main", "c", "t0", "x", ["b"]), (3, "main", "d", "t5", 'Revert "feat"', ["c"]), (4, "main", "e", "t6", 'Revert "Revert "feat""', ["d"]), (5, "main", "f", "t7", "m", ["e", "z"]), (6, "dev", "f", "t7", "m", ["e"]), (7, "dev", "f", "t7", "m", ["e"])]
    s = spark.createDataFrame([("r", i, b, h, t, m, p, False, False, False) for i, b, h, t, m, p in rows], "repo string, i int, branch string, head string, tree string, message string, parents array<string>, detached boolean, rebasing boolean, merging boolean")
    assert [r["kind"] for r in snapshot.change_kinds(s, "repo", ["i"]).orderBy("i").collect()] == ["initial", "commit", "revert", "revert", "commit", "merge", "branch", "unchanged"]


def test_ignore_rules(spark):
    paths = ["a.log", "keep.log", "build/x.py", "src/build/y.py", "docs/a/b.txt", "docs/b.txt", "src/tmp", "tmp/z"]
    d = spark.createDataFrame([(p,) for p in paths], "path string")
    left = {r["path"] for r in S.apply_ignore(d, ["*.log", "!keep.log", "/build/", "docs/**/*.txt", "tmp/"]).collect()}
    assert left == {"keep.log", "src/build/y.py", "src/tmp"}


def test_manifests(spark):
    rows = [("requirements.txt", "# a\nnumpy>=1\nrich[all]==2\n-e .\n"), ("package.json", '{"dependencies": {"react": "1"}, "devDependencies": {"vite": "2"}}'), ("go.mod", "module x\nrequire (\n\tgithub.com/a/b v1.0\n)\n"), ("pyproject.toml", '[project]\ndependencies = [\n  "attrs>=1", "click",\n]\n'), ("Cargo.toml", '[dependencies]\nserde = "1"\n'), ("other.txt", "x")]
    got = S.manifest_dependencies(spark.createDataFrame(rows, "path string, text string")).select("path", "dep").collect()
    assert {tuple(r) for r in got} == {("requirements.txt", "numpy"), ("requirements.txt", "rich"), ("package.json", "react"), ("package.json", "vite"), ("go.mod", "github.com/a/b"), ("pyproject.toml", "attrs"), ("pyproject.toml", "click"), ("Cargo.toml", "serde")}


def test_imports_resolve_in_order(spark):
    f = spark.createDataFrame([(p,) for p in ("app/models.py", "app/__init__.py", "lib/util.py", "src/core/mod.rs", "web/index.ts", "include/a.h")], "path string")
    i = spark.createDataFrame([("app/main.py", ".models"), ("app/main.py", "app.models"), ("app/main.py", "util"), ("src/main.rs", "crate::core"), ("web/app.ts", "./index"), ("c/x.c", "a.h"), ("app/main.py", "nothing.here")], "importer string, module string")
    got = {(r["importer"], r["module"]): r["target"] for r in resolve.resolve_imports(i, f).collect()}
    assert got == {("app/main.py", ".models"): "app/models.py", ("app/main.py", "app.models"): "app/models.py", ("app/main.py", "util"): "lib/util.py", ("src/main.rs", "crate::core"): "src/core/mod.rs", ("web/app.ts", "./index"): "web/index.ts", ("c/x.c", "a.h"): "include/a.h"}


CODE = {
    "python": ('import os\nfrom .m import x\n\n\nclass A:\n    """Doc."""\n\n    def run(self, n):\n        """Say."""\n        y = n + 1\n        return x(y)\n\n\ndef broken_free():\n    return A().run(2)\n', {"A", "run", "broken_free"}, {"os", ".m"}),
    "javascript": ('import x from "./x"\nexport function go(a) {\n  const b = a;\n  return b;\n}\nclass K {\n}\n', {"go", "K"}, {"./x"}),
    "go": ('import "fmt"\nfunc (s *S) Do(a int) int {\n\tx := a\n\treturn x\n}\ntype S struct {\n}\n', {"Do", "S"}, {"fmt"}),
    "rust": ("use crate::a::b;\npub fn f(x: i32) -> i32 {\n    let y = x;\n    y\n}\nstruct P {\n}\n", {"f", "P"}, {"crate::a::b"}),
    "ruby": ('require "json"\nclass A\n  def go\n    1\n  end\nend\n', {"A", "go"}, {"json"}),
    "c": ("#include <stdio.h>\nint add(int a, int b) {\n  int c = a;\n  return c + b;\n}\n", {"add"}, {"stdio.h"}),
}


@pytest.mark.parametrize("language", sorted(CODE))
def test_parsing(spark, language):
    text, names, imports = CODE[language]
    f = spark.createDataFrame([("p", language, text), ("bad", language, "def ((("), ("none", language, None)], "path string, language string, text string")
    assert {r["name"] for r in parse.parse_symbols(f).where("path = 'p'").collect()} == names
    assert {r["module"] for r in parse.parse_imports(f).where("importer = 'p'").collect()} == imports
    skeleton = parse.skeletons(f).where("path = 'p'").first()["skeleton"]
    assert len(skeleton) <= len(text)


def test_python_skeleton_keeps_docstrings():
    s = parse.skeleton_of(CODE["python"][0], "python")
    assert '"""Say."""' in s and "return x(y)" not in s and "..." in s
    assert parse.skeleton_of("def (", "python") == "def ("
    assert np.isscalar(len(s))


def test_read_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_text("print(1)\n")
    (tmp_path / "y.md").write_bytes(b"caf\xc3\xa9")
    got = {r["path"]: r["text"] for r in S.read_tree(spark, str(tmp_path)).collect()}
    assert got == {"a/x.py": "print(1)\n", "y.md": "café"}


def test_sections_are_one_based_and_cover_the_text(spark):
    d = spark.createDataFrame([(1, "intro\n# A\nx\ny\n## B\nz"), (2, "# only"), (3, "")], "id int, text string")
    got = [tuple(r)[:5] for r in S.sections(d, "id", "text").orderBy("id", "start_line").collect()]
    assert got == [(1, 0, "", 1, 1), (1, 1, "A", 2, 4), (1, 2, "B", 5, 6), (2, 1, "only", 1, 1), (3, 0, "", 1, 1)]


def test_scopes_and_imported_names():
    code = "from a.b import C, d\nimport os\n\n\nclass A:\n    def f(self):\n        def g():\n            pass\n\n\ndef f():\n    pass\n"
    assert [(x["name"], x["scope"]) for x in parse.with_scopes(parse.symbols_of(code, "python"))] == [("A", ""), ("f", "A"), ("g", "A.f"), ("f", "")]
    assert set(map(parse._module_and_name, parse.imports_of(code, "python"))) == {("a.b", None), ("a.b", "C"), ("a.b", "d"), ("os", None)}
    js = "import x, { a, b as c } from './m';\nclass K {\n  run() {\n  }\n}\n"
    assert {("./m", None), ("./m", "a"), ("./m", "b")} <= set(map(parse._module_and_name, parse.imports_of(js, "typescript")))
    assert parse._module_and_name("std::io") == ("std::io", None) and parse._module_and_name("node:fs") == ("node:fs", None)
    inner = "public class Outer {\n  class Inner {\n    void run() {\n    }\n  }\n}\n"
    assert ("Inner", "Outer") in [(x["name"], x["scope"]) for x in parse.with_scopes(parse.symbols_of(inner, "java"))]
