"""Ids beyond 2**53 beside null ones, repeated ids with other texts, and very long texts, through every operator."""

import random
from collections import Counter

import numpy as np
import pytest
from brute import near_texts, without_repeats
from tokenizers import Tokenizer

from lodestone.llm import exact_dedup, language_id, mixing, ngram_join, packing, pii, queries, secret_scan, substring_dedup, token_files, vector_dedup

BIG = 2**53 + 1
COPY = " ".join(f"w{i}" for i in range(60))
ROWS = [(BIG, COPY), (None, COPY + " x"), (BIG + 2, "b b@mail.org AKIA" + "Z" * 16), (7, COPY), (7, "seven"), (None, "none"), (None, None), (2**62 + 1, "")]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(i, t, "s", "en") for i, t in ROWS], "doc_id long, text string, source string, lang string").coalesce(1)


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


WANT = Counter(i for i, _ in ROWS)


def test_every_operator_returns_the_ids_it_got(spark, odd, tmp_path):
    vocabulary = queries.vocabulary()
    files = token_files.write_token_files(odd, vocabulary, path=str(tmp_path / "t"))
    made = {
        "op1": language_id.identify(odd, language_id.train(odd), keep=["doc_id"]), "op2": mixing.op2_rows(odd), "op4": secret_scan.op4_rows(odd), "op5": pii.op5_rows(odd),
        "op6": token_files.read_token_files(files, str(tmp_path / "t")), "op7": exact_dedup.exact_dedup(odd), "op8": substring_dedup.remove_repeats(odd), "op10": ngram_join.near_texts(odd),
    }
    for name, df in made.items():
        assert ids(df) == WANT, name
    assert ids(packing.pack(odd, vocabulary).where("start = 0")) == WANT
    vectors = spark.createDataFrame([(i, [1.0, float(k % 3)], 1) for k, (i, _) in enumerate(ROWS)], "vec_id long, embedding array<float>, label int")
    assert Counter(r["vec_id"] for r in vector_dedup.near_vectors(vectors).collect()) == WANT


def test_big_ids_in_results(odd):
    got = {(r["doc_id"], r["n_links"]): r["component_id"] for r in ngram_join.near_texts(odd).collect()}
    assert got[BIG, 2] == 7 and got[7, 2] == 7 and got[None, 2] == 7 and got[2**62 + 1, 0] == 2**62 + 1
    kept = {(r["doc_id"], r["group_size"]): r["keep_id"] for r in exact_dedup.exact_dedup(odd).collect()}
    assert kept[7, 2] == BIG and kept[None, 2] == 2**62 + 1
    removed = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], bytes(r["kept"])) for r in substring_dedup.remove_repeats(odd).collect())
    assert removed == sorted((str(i), n, m, k) for (i, n, m, k) in without_repeats_of(ROWS))


def without_repeats_of(rows):
    numbered = without_repeats([(k, t) for k, (_, t) in enumerate(rows)])
    return [(rows[k][0], n, m, kept) for k, n, m, kept in numbered]


def test_null_ids_are_dealt_over_the_groups(spark):
    d = spark.range(400).selectExpr("cast(null as long) as doc_id", "'same words' as text")
    assert packing.pack(d, queries.vocabulary(), group_docs=20).select("sequence_id").distinct().count() >= 15


def test_paths_and_versions_are_carried(spark):
    d = spark.createDataFrame([(1, "a.py", 1, "token=abcdefgh1"), (1, "a.py", 2, "clean"), (2, "b.py", 1, "token=abcdefgh1")], "doc_id long, path string, version int, text string")
    got = {(r["path"], r["version"]): len(r["spans"]) for r in secret_scan.scan(d, keep=("path", "version")).collect()}
    assert got == {("a.py", 1): 1, ("a.py", 2): 0, ("b.py", 1): 1}


def test_many_matches_in_one_text(spark):
    n = 3_000
    text = " ".join(f"u{i}@mail.org" for i in range(n))
    row = pii.op5_rows(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    at, want = 0, []
    for word in text.split(" "):
        want.append(f"email:{at}:{at + len(word)}")
        at += len(word) + 1
    assert row["n_email"] == n and row["spans"] == ",".join(want)


def test_very_long_texts(spark, tmp_path):
    rng = random.Random(5)
    long = " ".join(f"{rng.choice(['alpha', 'Beta', 'gämma,'])}{rng.randint(0, 9999)}" for _ in range(40_000))
    changed = long.replace("alpha1", "omega1")
    rows = [(1, long), (2, changed), (3, "short " * 20), (4, " ".join(long.split()[5_000:9_000]))]
    d = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["n_links"], r["component_id"]) for r in ngram_join.near_texts(d).collect()}
    assert got == near_texts(rows)
    plain = Tokenizer.from_file(queries.vocabulary())
    want = {i: plain.encode(t, add_special_tokens=False).ids for i, t in rows}
    files = token_files.write_token_files(d, queries.vocabulary(), path=str(tmp_path / "t"))
    for r in token_files.read_token_files(files, str(tmp_path / "t")).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == want[r["doc_id"]] + [0]
    parts = {}
    for r in packing.pack(d, queries.vocabulary()).collect():
        parts.setdefault(r["doc_id"], {})[r["start"]] = np.frombuffer(r["ids"], "<u4").tolist()
    assert {i: [x for s in sorted(p) for x in p[s]] for i, p in parts.items()} == {i: x + [1] for i, x in want.items()}
    taken = {r["doc_id"]: r["taken"] for r in mixing.op2_rows(d).collect()}
    assert taken == {i: len(t.split()) for i, t in rows}
