"""De-duplication operators against plain Python, with nulls, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import random

import numpy as np
import pytest
from brute import near_texts, near_vectors, without_repeats

from lodestone.llm import common, exact_dedup, ngram_join, substring_dedup, vector_dedup

DOCS = "doc_id long, text string, sha string, keep_id long, maybe boolean, size long"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, True, 2) for i, t in rows], DOCS)


def exact(rows):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    return sorted((i, max(groups[low(t)]), len(groups[low(t)]), i == max(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for i, t in rows)


ROWS = [(1, "Hello"), (2, "hello"), (3, None), (4, ""), (5, "ÄB"), (6, "äb"), (7, "ÄB"), (8, "x"), (9, "HELLO"), *[(100 + i, "Hot text") for i in range(400)], *[(1000 + i, f"only {i}") for i in range(300)]]


def test_exact(spark):
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs(spark, ROWS)).collect())) == exact(ROWS)


@pytest.mark.parametrize("bits", [1, 4, 64])
def test_exact_at_any_filter_size(spark, bits, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_WORDS", 0 if bits == 4 else 10**6)
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs(spark, ROWS), bits_per_row=bits).collect())) == exact(ROWS)
    left = exact_dedup.drop_exact_copies(docs(spark, ROWS), bits_per_row=bits)
    assert left.columns == docs(spark, []).columns
    assert sorted(r["doc_id"] for r in left.collect()) == [e[0] for e in exact(ROWS) if e[3]]


def test_exact_filter_lets_unique_rows_pass(spark):
    base = spark.createDataFrame([(i, hashlib.sha256(str(i // 2 if i < 20 else i).encode()).hexdigest()) for i in range(2000)], "id long, sha string")
    words = exact_dedup._filter_words(base, 1000)
    hit = exact_dedup._tested(base, words, 1000).where("maybe")
    assert hit.where("id < 20").count() == 20 and hit.count() < 200


def test_exact_repeats_and_nulls(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (2, "c")]
    got = sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs(spark, rows)).collect())
    assert got == [(-1, -1, 1, True), (-1, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True), (2, 2, 1, True)]
    assert sorted((r["doc_id"] or -1, r["text"]) for r in exact_dedup.drop_exact_copies(docs(spark, rows)).collect()) == [(-1, "b"), (1, "a"), (2, "c")]


def corpus(seed, n=220):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(12, 120))] for _ in range(20)]
    rows = []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))] if rng.random() < 0.4 else list(base[0] if rng.random() < 0.4 else rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            if w:
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A  b"), (905, "a b c"), (906, "same " * 3000), (907, "same " * 2000)]


@pytest.mark.parametrize("part", [1024, 8])
def test_ngram_join(spark, part, monkeypatch):
    monkeypatch.setattr(ngram_join, "PART", part)
    rows = corpus(part)
    got = {r["doc_id"]: (r["n_links"], r["component_id"]) for r in ngram_join.near_texts(docs(spark, rows)).collect()}
    assert got == near_texts(rows)


def test_ngram_join_repeats_and_empty(spark):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(1, text), (1, text), (2, text), (None, text), (3, None)]
    got = sorted((r["doc_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in ngram_join.near_texts(docs(spark, rows)).collect())
    assert got == [(-1, 3, 1, False), (1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True)]
    assert ngram_join.near_texts(docs(spark, [])).count() == 0


def test_prefix_depth_reaches_recall():
    d = ngram_join.prefix_depth()
    assert 1 - (1 - 0.8**d) ** ngram_join.TREES >= ngram_join.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** ngram_join.TREES


def test_large_buckets_are_connected():
    rng = np.random.default_rng(1)
    sig = rng.integers(0, 2**16, (60, 128)).astype(np.uint16)  # any width
    sig[1::3] = sig[0]
    sig[2::3, :100] = sig[2, :100]
    one, two, _ = ngram_join._large(sig, None, 90)
    root = common.local_roots(60, one, two)
    want = [(i, j) for i in range(60) for j in range(i) if (sig[i] == sig[j]).sum() >= 90]
    assert all(root[i] == root[j] for i, j in want)


@pytest.mark.parametrize("block", [1024, 16])
def test_vectors(spark, block):
    rng = np.random.default_rng(block)
    base = rng.normal(size=(12, 8))
    rows = []
    for i in range(300):
        k = int(rng.integers(12))
        x = base[k] * rng.uniform(0.5, 2) + rng.normal(size=8) * float(rng.choice([0, 0.03, 0.1, 0.4]))
        rows.append((i * 7 % 307, [float(np.float32(z)) for z in x], k % 3))
    rows += [(500 + i, [0.5] * 8, 1) for i in range(60)]
    rows += [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] * 8, 1), (903, [1.0, None] + [0.0] * 6, 1), (904, [1.0] * 8, None), (905, [], 1), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1), (908, [float("inf")] + [1.0] * 7, 2), (909, [float("-inf")] * 8, 2)]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, cid long, v long")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_dedup.near_vectors(d, block=block).collect()}
    assert got == near_vectors(rows)
    assert vector_dedup.near_vectors(d.limit(0)).count() == 0
    assert vector_dedup.near_vectors(d.where("vec_id >= 900 and vec_id < 906")).where("n_links > 0").count() == 0


def repeats(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(1500)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(30, 80))] for _ in range(8)]
    rows = []
    for i in range(250):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            p = list(passages[0] if rng.random() < 0.5 else rng.choice(passages))
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "x"
            k = rng.randint(0, len(w))
            w[k:k] = p
        rows.append((i, " ".join(w)))
    return rows + [(900, None), (901, ""), (902, "a " * 34), (903, "b " * 35), (904, "c " * 36), (905, "d " * 700), (906, "d " * 701), (907, rows[3][1]), (3, rows[3][1]), (4, rows[5][1]), (910, "a b " * 60), (911, "é x " * 40)]


@pytest.mark.parametrize("hot, rows_broadcast", [(2000, 10**6), (3, 10**6), (2000, 0)])
def test_substrings(spark, hot, rows_broadcast, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "BROADCAST_ROWS", rows_broadcast)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 3000)
    rows = repeats(hot)
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"])) for r in substring_dedup.remove_repeats(docs(spark, rows).repartition(3)).collect())
    assert got == without_repeats(rows)


def test_substrings_empty(spark):
    assert substring_dedup.remove_repeats(docs(spark, [])).count() == 0
    assert [tuple(r)[:3] for r in substring_dedup.remove_repeats(docs(spark, [(None, None)])).collect()] == [(None, 0, 0)]


def test_fm_index_counts():
    rng = np.random.default_rng(2)
    text = np.concatenate([np.append(rng.integers(1, 6, 200), 0) for _ in range(5)])
    index = substring_dedup.FMIndex(text)
    plain = text.tolist()
    for k in (1, 2, 3, 5, 7):
        patterns = np.array([text[i : i + k] for i in range(150)] + [rng.integers(1, 6, k) for _ in range(50)])
        want = [sum(plain[i : i + k] == p.tolist() for i in range(len(plain) - k + 1)) for p in patterns]
        length, times = index.matches(patterns, 1)
        assert [n if d == k else 0 for d, n in zip(length.tolist(), times.tolist(), strict=True)] == want
        # What is matched of a pattern is its longest end that occurs.
        assert all(sum(plain[i : i + d] == p.tolist()[k - d :] for i in range(len(plain) - d + 1)) >= (d > 0) and (d == k or not any(plain[i : i + d + 1] == p.tolist()[k - d - 1 :] for i in range(len(plain) - d))) for p, d in zip(patterns, length.tolist(), strict=True))


def test_components(spark):
    rng = random.Random(3)
    e = [(i, i + 1) for i in range(60)] + [(500, 500 + i) for i in range(1, 200)] + [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(60)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(e, "a long, b long"), "a", "b").collect()}
    low = {}
    nodes = {x for p in e if p[0] != p[1] for x in p}
    adj = {n: set() for n in nodes}
    for a, b in e:
        if a != b:
            adj[a].add(b), adj[b].add(a)
    for n in sorted(nodes):
        if n not in low:
            stack = [n]
            while stack:
                x = stack.pop()
                if x not in low:
                    low[x] = n
                    stack += adj[x]
    assert got == low
    assert common.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
