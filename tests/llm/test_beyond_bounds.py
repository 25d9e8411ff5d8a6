"""The ways beyond every broadcast bound and block size, against the same plain Python."""

import random

import pytest
from brute import near_texts, near_vectors, without_repeats
from pyspark.sql import functions as F
from test_dedup import ROWS, corpus, docs, exact, repeats

import corpus_pipeline
from lodestone.llm import common, exact_dedup, ngram_join, secret_scan, substring_dedup, vector_dedup


@pytest.fixture
def nothing_is_small(monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_NODES", 0)
    monkeypatch.setattr(common, "HEAVY_LEAST", 2)
    monkeypatch.setattr(common, "HEAVY_NODES", 10**9)
    monkeypatch.setattr(exact_dedup, "BROADCAST_WORDS", 0)
    monkeypatch.setattr(exact_dedup, "BROADCAST_LOSERS", 0)
    monkeypatch.setattr(exact_dedup, "HOT_LEAST", 2)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(substring_dedup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(substring_dedup, "HEAVY_LEAST", 2)
    monkeypatch.setattr(substring_dedup, "HOT", 3)
    monkeypatch.setattr(secret_scan, "HEAVY_LEAST", 1)
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_IDS", 0)


def test_components(spark, nothing_is_small):
    rng = random.Random(4)
    e = [(i, i + 1) for i in range(40)] + [(900, 500 + i) for i in range(1, 100)] + [(rng.randint(1000, 1060), rng.randint(1000, 1060)) for _ in range(40)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(e, "a long, b long").repartition(7), "a", "b").collect()}
    nodes = sorted({x for p in e if p[0] != p[1] for x in p})
    at = {n: i for i, n in enumerate(nodes)}
    import numpy as np

    pairs = np.array([(at[a], at[b]) for a, b in e if a != b])
    root = common.local_roots(len(nodes), pairs[:, 0], pairs[:, 1])
    assert got == {n: nodes[root[i]] for n, i in at.items()}


def test_skewed_join_keeps_every_row(spark):
    rows = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), ("c", 2), (None, 3)], "k string, v int")
    keyed = spark.createDataFrame([("a", 50), ("b", 1), ("d", 9)], "k string, n int")
    for how, want in (("inner", 51), ("left_semi", 51)):
        assert common.join_skewed(rows, keyed, ["k"], F.col("n") > 5, how).count() == want


def test_exact(spark, nothing_is_small):
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_dedup(docs(spark, ROWS)).collect())
    assert got == sorted(exact(ROWS))
    left = exact_dedup.drop_exact_copies(docs(spark, ROWS + ROWS[:3]))
    assert sorted(r["doc_id"] for r in left.collect()) == sorted({e[0] for e in exact(ROWS) if e[3]})


def test_near(spark, nothing_is_small, monkeypatch):
    monkeypatch.setattr(ngram_join, "PART", 8)
    rows = corpus(8)
    got = {r["doc_id"]: (r["n_links"], r["component_id"]) for r in ngram_join.near_texts(docs(spark, rows)).collect()}
    want = near_texts(rows)
    assert got == want
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near(spark, docs(spark, rows), "").collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_shorter_prefixes_find_more(spark, monkeypatch):
    """With few trees one level misses pairs; texts whose neighbours ask for it are then compared at shorter prefixes."""
    assert ngram_join.open_below(ngram_join.prefix_depth()) > 0 and ngram_join.open_below(1) == 0
    asked = []
    real = ngram_join._shortened_to
    monkeypatch.setattr(ngram_join, "_shortened_to", lambda c, level, s, closer: asked.append((level, closer is None)) or real(c, level, s, closer))
    rng = random.Random(8)
    base = [f"t{rng.randint(0, 10**6)}" for _ in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 30):
        w = list(base)
        for k in rng.sample(range(300), rng.randint(3, 9)):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_links"], r["component_id"]) for r in ngram_join.near_texts(docs(spark, rows)).collect()}
    assert got == near_texts(rows)
    assert [a[1] for a in asked] == [True, *[False] * (len(asked) - 1)] and len(asked) > 1


def test_vectors_in_three_levels(spark, nothing_is_small, monkeypatch):
    monkeypatch.setattr(vector_dedup, "FAN", 2)
    rng = random.Random(6)
    rows = []
    for i in range(200):
        k = rng.randrange(9)
        rows.append((i, [float(rng.gauss(0, 0.1) + (3 if d == k % 6 else 0)) for d in range(6)], k % 2))
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_dedup.near_vectors(d, block=8).collect()}
    assert got == near_vectors(rows)


def test_windows(spark, nothing_is_small, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 3000)
    rows = repeats(21)
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"])) for r in substring_dedup.remove_repeats(docs(spark, rows).repartition(3)).collect())
    assert got == without_repeats(rows)


def test_blob_of_many_rows(spark, nothing_is_small):
    d = spark.createDataFrame([(i, "token=abcdefgh1" if i % 3 else "clean") for i in range(60)], "doc_id long, text string")
    got = {r["doc_id"]: len(r["spans"]) for r in secret_scan.scan(d).collect()}
    assert got == {i: int(i % 3 > 0) for i in range(60)}
