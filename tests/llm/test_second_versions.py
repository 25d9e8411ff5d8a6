"""Language ID, mixing and the pipeline against plain Python versions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import near_texts
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import language_id, mixing, queries

MASK = 0xFFFFFFFF


def buckets(text, bits=language_id.BUCKET_BITS):
    out = Counter()
    points = [ord(c) for c in text.lower()]
    for n in (1, 2, 3):
        for i in range(len(points) - n + 1):
            h = n
            for p in points[i : i + n]:
                h = ((h ^ p) * 0x9E3779B1) & MASK
                h ^= h >> 15
            out[((h * 0x9E3779B1) & MASK) >> (32 - bits)] += 1
    return out


def learn(rows):
    """(text, lang) rows to ``classify``, a function of a text that gives language and posterior."""
    counts, prior = defaultdict(Counter), Counter()
    for text, lang in rows:
        if text is not None and lang is not None:
            counts[lang] += buckets(text)
            prior[lang] += 1
    size = {x: sum(counts[x].values()) + 0.5 * (1 << language_id.BUCKET_BITS) for x in prior}

    def classify(text):
        if not text or not any(c.isalpha() for c in text) or not prior:
            return "und", 0.0
        logs = {x: math.log(prior[x] / sum(prior.values())) + sum(n * math.log((counts[x][b] + 0.5) / size[x]) for b, n in buckets(text).items()) for x in sorted(prior)}
        best = max(logs, key=lambda x: (logs[x],))
        return best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())

    return classify


ENGLISH = "the house with garden over there was small people walk river under".split()
GERMAN = "der garten und das haus wär klein leute gehen unter fluß dort".split()


def prose(rng, words, n):
    return " ".join(rng.choice(words) + rng.choice(["", "s", "en"]) for _ in range(n))


def corpus(seed=11):
    rng = random.Random(seed)
    rows = [(i, prose(rng, ENGLISH if i % 2 else GERMAN, rng.randint(3, 300)), ("en" if i % 2 else "de") if i % 5 else None, f"s{i % 3}" if i % 7 else None) for i in range(50)]
    rows += [(100 + i, rows[i][1].upper() if i % 2 else rows[i][1] + " more", rows[i][2], rows[i][3]) for i in range(8)]
    return rows + [(200, "1234 5678", "en", "s0"), (201, None, None, None), (202, "", None, "s1"), (203, rows[20][1], "de", "s2"), (204, "wär the", None, "s1")]


def test_language_id(spark):
    rows = corpus()
    d = spark.createDataFrame([(i, t, lang) for i, t, lang, _ in rows], "doc_id long, text string, lang string")
    classify = learn([(t, lang) for _, t, lang, _ in rows])
    for r in language_id.identify(d, language_id.train(d)).collect():
        lang, score = classify(r["text"])
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-6)


def test_registered_query_learns_only_from_what_it_may(spark):
    sf = "/root/testdata/sf0.001"
    import zlib

    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    out = {i for i in (r["doc_id"] for r in rows) if zlib.crc32(str(i).encode()) % 4 == 2}
    classify = learn([(r["text"], r["lang"]) for r in rows if r["doc_id"] not in out])
    texts = {r["doc_id"]: r["text"] for r in rows}
    got = queries.op1_language_id(spark, sf).collect()
    assert {r["doc_id"] for r in got if r["held_out"]} == out
    for r in got[::4]:  # one in four texts by the slow version
        assert (r["lang_pred"], round(r["score"], 6)) == (lambda x: (x[0], round(x[1], 6)))(classify(texts[r["doc_id"]]))


def mixed(spark, rows, weights=mixing.WEIGHTS, block=mixing.BLOCK_WORDS, seed=17):
    """``{row number: {pass: [(first, n)]}}`` of words that the mix takes, slot by slot; Spark gives nothing but the rows' hashes."""
    d = spark.createDataFrame([(k, i, t) for k, (i, t, _) in enumerate(rows)], "k long, i long, t string").withColumn("th", F.xxhash64("t"))
    hashes = {r["k"]: (r["h"], r["th"]) for r in d.select("k", "th", F.xxhash64("i", "th", F.lit(seed)).alias("h")).collect()}
    steps = min(mixing.MOST_STEPS, max(mixing.LEAST_STEPS, len(rows) // mixing.STEP_DOCS))
    size = [len((t or "").encode().split()) for _, t, _ in rows]
    order = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in order}
    want = mixing.targets([total[s] for s in order], [weights[k % len(weights)] for k in range(len(order))])
    seeds = np.random.default_rng(seed).integers(1, 2**62, len(order), dtype=np.int64)
    out = defaultdict(lambda: defaultdict(list))
    for s, goal, own in zip(order, want, seeds):
        stream = []
        for k in sorted((k for k, r in enumerate(rows) if r[2] == s), key=lambda k: (hashes[k][0] % steps, hashes[k][0], rows[k][0], size[k], hashes[k][1])):
            stream += [(k, w) for w in range(size[k])]
        left, j, blocks = min(int(round(goal)), 3 * len(stream)), 0, -(-len(stream) // block)
        while left > 0:
            p, place = divmod(j, blocks)
            b = int(mixing.permuted(np.array([place]), blocks, int(own) + p)[0])
            words = stream[b * block : (b + 1) * block][:left]
            for k, w in words:
                out[k][p].append(w)
            left -= len(words)
            j += 1
    return out


@pytest.mark.parametrize("block", [256, 16])
def test_mixing(spark, block):
    rows = [(i, t, s) for i, t, _, s in corpus(3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = mixed(spark, rows, block=block)
    got = {r["doc_id"]: r["taken"] for r in mixing.op2_rows(d, block_words=block).collect()}
    assert got == {rows[k][0]: sum(map(len, want[k].values())) for k in range(len(rows))}


def texts_of(spark, rows):
    """The mix as (doc_id, text) rows."""
    out = []
    for k, passes in mixed(spark, rows).items():
        words = rows[k][1].split()
        out += [(rows[k][0], rows[k][1] if len(at) == len(words) else " ".join(words[w] for w in sorted(at))) for at in passes.values()]
    return Counter(out)


def test_pipeline(spark):
    rows = corpus(5)
    d = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    classify = learn([(t, lang) for _, t, lang, _ in rows])
    left = [r for r in rows if (x := classify(r[1]))[0] != "und" and x[1] >= corpus_pipeline.LEAST_POSTERIOR]
    one = stages["language_id"](spark, d, "")
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(r[0] for r in left)
    best = {}
    for r in left:
        key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1])
        best[key] = max(best.get(key, -1), r[0])
    left = [r for r in left if r[0] in set(best.values())]
    two = stages["exact_dedup"](spark, one, "")
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(r[0] for r in left)
    near = near_texts([(r[0], r[1]) for r in left])
    left = [r for r in left if near[r[0]][1] == r[0]]
    three = stages["ngram_join"](spark, two, "")
    assert sorted(r["doc_id"] for r in three.collect()) == sorted(r[0] for r in left) and any(n for n, _ in near.values())
    four = stages["mixing"](spark, three, "")
    want = texts_of(spark, [(r[0], r[1], r[3]) for r in left])
    assert Counter((r["doc_id"], r["text"]) for r in four.collect()) == want
    plain = Tokenizer.from_file(queries.vocabulary())
    packed = defaultdict(list)
    for r in stages["packing"](spark, four, "").collect():
        packed[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"]))
    sizes = Counter()
    for (i, text), n in want.items():
        sizes[i, len(plain.encode(text, add_special_tokens=False).ids) + 1] += n
    assert {k: sum(n for _, n in v) for k, v in packed.items()} == {k: k[1] * n for k, n in sizes.items()}
    assert all(sum(1 for s, _ in packed[k] if s == 0) == n for k, n in sizes.items())


CLASHING = ["a.b", "__gone", "__hash", "row", "lang_pred", "score", "id", "th", "found"]


def test_pipeline_stages_keep_columns_of_any_name(spark):
    rows = corpus()
    names = ["doc_id", "text", "lang", "source", "n_chars", *CLASHING]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    docs = spark.createDataFrame([(i, t, lang, s, len(t or ""), *CLASHING) for i, t, lang, s in rows], schema)
    plain = docs.select(*names[:5])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, plain = stage(spark, docs, ""), stage(spark, plain, "")
        assert docs.columns == names and docs.count() == plain.count() > 0, name
        assert docs.select(*[F.col(f"`{c}`") for c in CLASHING]).distinct().collect() == [tuple(CLASHING)]
    assert corpus_pipeline.pack_sequences(spark, docs, "").count() == corpus_pipeline.pack_sequences(spark, plain, "").count()


def test_vectors_of_one_first_hash_stay_apart(spark, monkeypatch):
    """The second hash does not follow from the first: with the first one the same for all, equal and different vectors are still told apart."""
    from brute import near_vectors

    from lodestone.llm import vector_dedup

    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], "x") for i in range(30)]
    rows += [(100 + i, rows[i][1], "x") for i in range(10)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    monkeypatch.setattr(vector_dedup, "_first_hash", lambda v: F.lit(7).cast("long"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_dedup.near_vectors(d).collect()}
    assert got == near_vectors(rows)
