"""Operators that work in blocks, and the reach of the registered queries."""

import inspect
import re

import numpy as np
from pyspark.sql import functions as F
from test_oracles import DATA

from lodestone import plans
from lodestone.operators import evaluation, memory, vectors


def test_no_query_reads_a_part_of_its_tables():
    """No registered query, nor its SQL, bounds its input by an id, a remainder or a row number of the input's order."""
    bounded = ["simhash_dups", "doc_sections", "stack_trace_parse", "stack_trace_targets", "naive_hits", "edge_resolve", "ambiguous_names", "bm25_exact", "bm25_topk", "hybrid_search", "cosine_dedup_class", "doc_render"]
    for name in bounded:
        text = inspect.getsource(plans.queries()[name]) + plans.oracles()[name]
        assert not re.search(r"(?i)where[^\n]*(doc_id|event_id|item_id|p_partkey|\bid)\s*(%|<)\s*\d+", text), name
    assert "% 20" not in plans.oracles()["khop_down"]


def test_notes_are_classified_in_blocks(spark, monkeypatch):
    """Every vector with its document's simhash, against plain Python; 500 notes in blocks of 100."""
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 100)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("text is not null")
    hashes = {r["doc_id"]: r["simhash"] & (2**64 - 1) for r in memory.simhash(docs, "doc_id", "text").collect()}
    points = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").where("embedding is not null").collect()}
    want = {}
    for i, v in points.items():
        near = [(o, (hashes[i] ^ hashes[o]).bit_count()) for o in sorted(points) if o != i and i in hashes and o in hashes]
        near = [(o, d) for o, d in near if d <= 3]
        s, o = max((round(float(v @ w / np.sqrt((v @ v) * (w @ w))), 6), -o) for o, w in points.items() if o != i)
        status = "duplicate" if s >= 0.92 else "consolidate" if s >= 0.8 else "novel"
        want[i] = ("duplicate", near[0][0], "simhash", 1 - near[0][1] / 64) if near else (status, -1 if status == "novel" else -o, "cosine", s)
    got = {r["id"]: (r["status"], r["matched"], r["stage"], r["similarity"]) for r in plans.queries()["cosine_dedup_class"](spark, DATA).collect()}
    assert {i: x[:3] for i, x in got.items()} == {i: x[:3] for i, x in want.items()}
    assert all(abs(got[i][3] - want[i][3]) < 2e-6 for i in want) and {x[2] for x in want.values()} == {"simhash", "cosine"}


def test_notes_have_no_largest_batch(spark):
    new = spark.range(5_001).select("id", F.lit(None).cast("long").alias("simhash"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    kept = new.where("id = 7")
    got = memory.classify_notes(new, kept)
    assert got.count() == 5_001 and got.where("matched = 7").count() == 5_000


def test_baseline_has_no_largest_batch(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "QUERY_BLOCK", 3)
    q = spark.createDataFrame([(i, [f"w{i}", "x"]) for i in range(10)], "q long, words array<string>")
    d = spark.createDataFrame([(i, f"w{i} y" if i else "x") for i in range(5)], "doc_id long, text string")
    got = {(r["q"], r["doc_id"]): r["hits"] for r in evaluation.naive_hits(q, d, "q").collect()}
    assert got == {**{(i, 0): 1 for i in range(10)}, **{(i, i): 1 for i in range(1, 5)}}


def test_python_holds_slices_of_a_batch(spark, monkeypatch):
    """Vectors, versions and notes are worked on in parts of an Arrow batch; ties across parts go to the smaller id."""
    import numpy as np
    import pyarrow as pa

    from lodestone.operators import vectors

    monkeypatch.setattr(vectors, "CELLS", 8)
    rng = np.random.default_rng(1)
    v = [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(60)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in vectors.topk(df.where("vec_id < 4").withColumnRenamed("vec_id", "query_id"), df, 5).orderBy("query_id", "rank").select("query_id", "vec_id", "score").collect()]
    unit = {i: np.array(x) / (np.linalg.norm(x) or 1.0) for i, x in v}
    want = [(q, *p) for q in range(4) for p in sorted(((i, round(float(unit[q] @ unit[i]), 6)) for i in unit), key=lambda x: (-x[1], x[0]))[:5]]
    assert got == want
    from lodestone.operators import history

    runs = list(history._hunks.func(iter([(pa.array([None, "a\n"]), pa.array(["x", "a"]))])))[0].to_pylist()
    assert [[tuple(r.values()) for r in x] for x in runs] == [[(0, 0, 1, 1)], []]
    texts = [None, "", "a b", "The the cat"] * 150
    hashes = {r["id"]: r["simhash"] for r in memory.simhash(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text").collect()}
    assert len(hashes) == 600 and all(hashes[i] == hashes[i % 4] for i in hashes) and hashes[0] == hashes[1] == hashes[2] == 0 != hashes[3]


def test_baseline_looks_through_a_run_once(spark, monkeypatch):
    """Words inside runs, words with other characters, repeats, nulls and texts of none; runs that are forgotten and met again."""
    monkeypatch.setattr(evaluation, "KNOWN_RUNS", 2)
    asked = [("a", ["art", "art", None, "-x_"]), ("b", ["é!", "Art", ""]), ("c", []), ("d", None), ("e", ["zz"])]
    texts = ["Start-x_ART", "é! art", "", None, "cart start art zz!"]
    q = spark.createDataFrame(asked, "q string, words array<string>")
    d = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "path string, text string")
    got = {(r["q"], r["path"]): r["hits"] for r in evaluation.naive_hits(q, d, "q", "path").collect()}
    hits = lambda ws, t: sum(w in t.lower() for w in ws or [] if w is not None)
    assert got == {(i, f"d{k}"): n for i, ws in asked for k, t in enumerate(texts) if t is not None and (n := hits(ws, t))}


def test_single_precision_only_finds_what_is_compared(spark, monkeypatch):
    """Vectors whose cosines differ less than single precision tells, in blocks by their components; nulls inside and lengths of 0."""
    monkeypatch.setattr(vectors, "QUERY_CELLS", 64)
    rng = np.random.default_rng(3)
    base = rng.normal(size=8)
    v = [(i, [float(x) for x in base + rng.normal(size=8) * (1e-3 if i % 2 else 1.0)]) for i in range(80)] + [(80, [0.0] * 8), (81, [None] + [1.0] * 7)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in vectors.topk(df.withColumnRenamed("vec_id", "query_id"), df, 4, digits=9).collect()}
    unit = {i: np.array(x) / (np.linalg.norm(x) or 1.0) for i, x in v if None not in x}
    for q in unit:
        want = sorted(((-float(unit[q] @ unit[i]), i) for i in unit))[:4]
        assert all(abs(got[q, r][1] + want[r - 1][0]) < 2e-9 for r in range(1, 5))
        if q != 80:
            assert [got[q, r][0] for r in range(1, 5)] == [i for _, i in want]
    assert [got[80, r][0] for r in range(1, 5)] == [0, 1, 2, 3] and (81, 1) not in got


def test_only_texts_with_a_vector_are_hashed(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(memory, "simhash", lambda d, *a, f=memory.simhash: asked.append(d) or f(d, *a))
    plans.queries()["cosine_dedup_class"](spark, DATA)
    ids = {r[0] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id").collect()}
    assert {r["id"] for r in asked[0].select("id").collect()} <= ids
