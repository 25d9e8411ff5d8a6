"""The block index: pruned search equals full scoring, blocks are skipped, prefixes are intervals, segments equal a rebuild."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.operators import lexical


def corpus(n, seed=1):
    rng = random.Random(seed)
    common = ["the", "of", "and", "to"]
    words = [f"w{i}" for i in range(400)]
    return [(i, " ".join(rng.choice(common) if rng.random() < 0.5 else words[int(rng.random() ** 3 * 400)] for _ in range(rng.randint(0, 60)))) for i in range(n)]


def brute(docs, queries, k, prefix=False):
    """Full scores: ``queries`` is {query: words}."""
    counts = {i: Counter(t.lower().split()) for i, t in docs}
    size = {i: sum(c.values()) for i, c in counts.items()}
    n, avg = len(docs), sum(size.values()) / len(docs)
    out = []
    for q, terms in queries.items():
        score = Counter()
        for t in set(terms):
            tf = {i: sum(x for w, x in c.items() if w.startswith(t)) if prefix else c[t] for i, c in counts.items()}
            tf = {i: x for i, x in tf.items() if x}
            idf = max(1e-6, math.log((n - len(tf) + 0.5) / (len(tf) + 0.5)))
            for i, x in tf.items():
                score[i] += (2 if prefix else 1) * idf * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * size[i] / avg))
        best = sorted((-round(s, 6), i) for i, s in score.items())[:k]
        out += [(q, i, -s, r) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def asked(spark, queries):
    return spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], "query_id long, term string")


def rows(df):
    return sorted((r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in df.select("query_id", "doc_id", "score", "rank").collect())


QUERIES = {1: ["the", "of", "w1", "w200", "w399"], 2: ["the"], 3: ["w0", "w1", "w2", "and", "to", "w7", "w50"], 4: ["absent"], 5: ["w390", "the", "the"], 6: ["w1", "absent"]}


@pytest.mark.parametrize("seeds,page,held", [(40, 512, 200_000), (1, 4, 3)])
def test_pruned_search_equals_full_scoring(spark, monkeypatch, seeds, page, held):
    for name, value in (("SEED_POSTINGS", seeds), ("PAGE_DOCS", page), ("BLOCK_TERMS", held), ("BROADCAST_PAIRS", held), ("BROADCAST_LOOKUPS", held)):
        monkeypatch.setattr(lexical, name, value)
    docs = corpus(400)
    i = lexical.build_index(spark.createDataFrame([*docs, (9_999, None)], "doc_id long, text string")).saved()
    want = brute([*docs, (9_999, "")], QUERIES, 7)
    assert rows(lexical.bm25(asked(spark, QUERIES), i, 7)) == want
    prefixes = {1: ["w1", "th"], 2: ["w39", "of"], 3: ["w", "zz"], 4: ["w20", "w201", "an"]}
    longer = {q: [t for t in ts if len(t) > 1] for q, ts in prefixes.items()}
    assert rows(lexical.bm25_prefix(asked(spark, prefixes), i, 7)) == brute([*docs, (9_999, "")], longer, 7, True)


def test_most_blocks_of_common_words_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PAGE_DOCS", 8)
    docs = corpus(3_000, 2)
    i = lexical.build_index(spark.createDataFrame(docs, "doc_id long, text string")).saved()
    q = {1: ["the", "of", "w300", "w350", "w399"], 2: ["and", "to", "w310", "w320", "w330"]}
    read = {(r["query_id"], r["term"]): r for r in lexical.blocks_read(asked(spark, q), i, 5).collect()}
    common = [r for (_, t), r in read.items() if t in ("the", "of", "and", "to")]
    assert len(common) == 4 and not any(r["essential"] for r in common)
    assert sum(r["read"] for r in common) < 0.2 * sum(r["blocks"] for r in common)
    assert all(r["read"] == r["blocks"] for (_, t), r in read.items() if r["essential"])
    assert rows(lexical.bm25(asked(spark, q), i, 5)) == brute(docs, q, 5)


def test_a_stop_word_is_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PAGE_DOCS", 8)
    i = lexical.build_index(spark.createDataFrame(corpus(1_000), "doc_id long, text string")).saved()
    t = i.terms.where("term = 'the'").first()
    assert t["blocks"] > 50 and t["n"] < 40 * t["blocks"] and i.postings.where("term = 'the'").count() == t["n"]


def test_prefixes_are_intervals_of_the_dictionary(spark, monkeypatch):
    monkeypatch.setattr(lexical, "DICTIONARY_PAGE", 4)
    terms = sorted({"a", "ab", "abc", "abd", "b", "ba", "ñ", "ñu", "日本", "日", "z", "zz", "zzz", *(f"m{i}" for i in range(50))})
    d = spark.createDataFrame([(t,) for t in terms], "term string")
    prefixes = ["ab", "m", "m4", "ñ", "日", "zz", "zzzz", "", "q", "a"]
    for fences in (100_000, 3):
        monkeypatch.setattr(lexical, "FENCES", fences)
        dictionary = lexical.materialize(lexical.dictionary_of(d), "dictionary")
        found = lexical.terms_with_prefix(spark.createDataFrame([(p,) for p in prefixes], "prefix string"), dictionary)
        assert sorted(map(tuple, found.collect())) == sorted((p, t) for p in prefixes for t in terms if t.startswith(p))
        plan = found._jdf.queryExecution().toString()
        assert "substring" not in plan and "Join" in plan


def test_segments_equal_a_rebuild(spark, tmp_path):
    docs = dict(corpus(120, 3))
    frame = lambda d: spark.createDataFrame([(i, "n" + str(i), t) for i, t in d.items()], "doc_id long, name string, text string")
    names = [str(tmp_path / f"s{k}") for k in range(4)]
    lexical.build_index(frame(docs), "doc_id", "text", "name", 0).saved(names[0])
    rng = random.Random(4)
    for k in range(1, 4):
        gone = {i: docs[i] for i in rng.sample(sorted(docs), 15)}
        new = {**{i: t + " fresh the" for i, t in list(gone.items())[:8]}, **{1_000 * k + i: f"w{i} new{k} of" for i in range(5)}}
        lexical.segment(lexical.read_segments(spark, names[:k]), frame(gone), frame(new), k, "doc_id", "text", "name").saved(names[k])
        docs = {i: t for i, t in docs.items() if i not in gone} | new
    several, whole = lexical.read_segments(spark, names), lexical.build_index(frame(docs), "doc_id", "text", "name").saved()
    q = asked(spark, {**QUERIES, 7: ["fresh", "new3", "w3"], 8: ["n100"]})
    merged = lexical.merge(several, 9).saved(str(tmp_path / "m"))
    for search in (lexical.bm25, lexical.bm25_prefix):
        want = rows(search(q, whole, 9))
        assert rows(search(q, several, 9)) == want and rows(search(q, merged, 9)) == want
    assert not lexical.to_merge(spark, names[:1]) and lexical.to_merge(spark, names[:2] * 5)


def test_search_of_nothing(spark):
    d = spark.createDataFrame(corpus(5), "doc_id long, text string")
    i = lexical.build_index(d.where("false")).saved()
    q = asked(spark, QUERIES)
    assert lexical.bm25(q, i).count() == 0 and lexical.bm25_prefix(q, i).count() == 0
    assert lexical.bm25(q.where("false"), lexical.build_index(d).saved()).count() == 0


def test_a_task_keeps_k_rows_of_a_query(spark, monkeypatch):
    """Scores are worked out where the postings are, in parts; ties go to the smaller id; no pair of a query and a document is shuffled."""
    docs = [*corpus(300, 5), *((1_000 + i, "the w1 w300") for i in range(200, 0, -1))]
    i = lexical.build_index(spark.createDataFrame(docs, "doc_id long, text string")).saved()
    queries = {**QUERIES, **{100 + q: [f"w{q}", "the"] for q in range(40)}}
    s, numbers = lexical._planned(asked(spark, queries).distinct(), i, 5, False)
    task = lexical._scorer(spark, s.plan, s.avgdl, 5)
    table = i.docs.select("doc_id", "dl", "terms").toArrow()
    name = numbers.set_index("query")["query_id"]
    for cells in (1 << 20, 600, 1):
        monkeypatch.setattr(lexical, "CELLS", cells)
        found = [r for b in task(iter(table.combine_chunks().to_batches())) for r in b.to_pylist()]
        assert len(found) <= 5 * len(queries)
        assert sorted((name[r["query"]], r["doc_id"], r["score"]) for r in found) == sorted(r[:3] for r in brute(docs, queries, 5))
    monkeypatch.undo()
    parts = i.docs.rdd.getNumPartitions()
    assert i.docs.select("doc_id", "dl", "terms").mapInArrow(task, "query int, doc_id long, score double").count() <= parts * 5 * len(queries)
    assert "Exchange" not in lexical.merged(spark.createDataFrame([("w1",)], "prefix string"), i).docs._jdf.queryExecution().toString()


def test_texts_stay_and_terms_move_once(spark, monkeypatch):
    """No shuffle of texts that lie in enough partitions, one of terms; counts and blocks are those of the postings, also where tasks share a page."""
    monkeypatch.setattr(lexical, "PAGE_DOCS", 8)
    docs = [*corpus(1_000, 6), (5_000, None), (5_001, ""), (5_002, "...")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(7, "doc_id").localCheckpoint()
    i = lexical.build_index(d)
    exchanges = lambda x: x._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert exchanges(i.docs) == 0 and exchanges(i.terms) == 1
    few = lexical.build_index(d.coalesce(1)).docs
    assert exchanges(few) == 1 and few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    written = i.saved().docs
    dealt = written.repartition(5, F.col("doc_id"))
    n, body = F.count("*").alias("n"), F.count_if(F.col("body") > 0).alias("n_body")
    bounds = [F.max("tf").alias("top_tf"), F.max("body").alias("top_body"), F.min("dl").alias("least_dl"), F.count_distinct("page").alias("blocks")]
    want = sorted(map(tuple, lexical._postings_of(written).groupBy("term").agg(n, body, *bounds).collect()))
    assert [*map(tuple, lexical.terms_of(written).orderBy("term").collect())] == [*map(tuple, lexical.terms_of(dealt).orderBy("term").collect())] == want
    assert {r["term"]: r["n"] for r in i.terms.collect()} == Counter(w for _, t in docs for w in set((t or "").replace(".", "").split()))
    table = written.select("page", F.col("dl").cast("int").alias("dl"), "terms").toArrow().combine_chunks().to_batches(max_chunksize=100)
    whole = [r for b in lexical._heads(8)(iter(table)) for r in b.to_pylist()]
    monkeypatch.setattr(lexical, "TERM_ROWS", 20)
    parts = [r for b in lexical._heads(8)(iter(table)) for r in b.to_pylist()]
    assert len(parts) > len(whole) and sum(r["n"] for r in parts) == sum(r["n"] for r in whole) == sum(r["n"] for r in map(lambda t: {"n": t[1]}, want))
    assert any(r["blocks"] > 9 for r in whole)


def test_whole_pages_are_added_up_without_a_row_for_each():
    """Of a whole page no row leaves a task by itself; pages that are cut, or not in a row, are told apart."""
    import pyarrow as pa

    docs = pa.table({"page": pa.array([1, 2, 1, 3, 3, 2]), "dl": pa.array([3, 1, 2, 4, 5, 1], pa.int32()), "terms": pa.array([[{"term": t, "tf": n, "body": n - 1} for t, n in x] for x in ([("a", 1), ("b", 2)], [("a", 1)], [("a", 2)], [("c", 4)], [("a", 3), ("c", 2)], [])], pa.list_(lexical._POSTING))})
    rows = lambda size, *cut: sorted(tuple(r.values()) for b in lexical._heads(size)(b for lo, hi in cut for b in docs.slice(lo, hi - lo).combine_chunks().to_batches()) for r in b.to_pylist())
    assert rows(2, (0, 6)) == [("a", None, 4, 2, 3, 3, 2, 1), ("b", None, 1, 1, 1, 2, 1, 3), ("c", None, 2, 2, 1, 4, 3, 4)]
    got = lexical._heads(2)(docs.slice(0, 4).combine_chunks().to_batches())
    assert sorted((r["term"], r["page"] or 0, r["n"], r["blocks"]) for b in got for r in b.to_pylist()) == [("a", 0, 2, 1), ("a", 2, 1, 0), ("b", 0, 1, 1), ("c", 3, 1, 0)]
    assert sum(r[2] for r in rows(9, (0, 3), (3, 6))) == 7 and {r[1] for r in rows(9, (0, 3), (3, 6))} == {1, 2, 3}
