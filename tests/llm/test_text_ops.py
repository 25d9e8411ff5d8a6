"""Language ID, secret and PII scans: held-out accuracy and plain Python, with nulls, empty and very long texts."""

import hashlib
import random

import pytest
from brute import BASE_PII, BASE_SECRETS, base_spans, disclosed
from pyspark.sql import functions as F

from lodestone.llm import language_id, pii, queries, secret_scan

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, blob string, spans string, row_id long, score int"
BITS = ["password", "PassWord", " ", "=", ":", '"', "'", "secret", "token", "apikey", "api_key", "AKIA", "ABCDEF0123456789", "deadbeef", "0123456789abcdef", "é", "日", "\n", "a@b.c", "x.y@", "@foo-bar.co", "._d@e.f", "1.2.3.4", "256.1.1.1",
        "+49 (30) 123456-7", "4111 1111 1111 1111", "5500-0000-0000-0004", "+", "-", "(", ")", ".", "7", "00", "123", "maria", "schmidt", "\t", "=abc", "🙂"]
LONG = [None, "", "a" * 20000 + "@", "1" * 20000, "1 " * 3000, "+1" + "0 " * 5000, "deadbeef" * 3000, "password=" * 500, "a@b.c" + ".d" * 5000, "a." * 10000]


def docs(spark, texts, langs=None):
    rows = [(i, t, langs[i] if langs else "en", "b", "s", 5, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def fuzz(seed, n=700):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 40))) for _ in range(n)] + LONG


def written(text, rules):
    return ",".join(x[2] for x in base_spans(text, rules))


def test_secrets(spark):
    texts = fuzz(1)
    for r in secret_scan.op4_rows(docs(spark, texts)).collect():
        want = written(texts[r["doc_id"]], BASE_SECRETS)
        assert r["spans"] == want and r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [want.count(k + ":") for k in ("assign", "access", "hex")]


def test_ledger_scans_only_unseen_blobs(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    first = docs(spark, ["token=abcdefgh1", "token=abcdefgh1", "clean", None])
    assert secret_scan.scan(first, ledger).where(F.size("spans") > 0).count() == 2
    assert spark.read.parquet(ledger).count() == 3
    secret_scan.scan(docs(spark, ["token=abcdefgh1", "new one"]), ledger)
    assert spark.read.parquet(ledger).count() == 4
    assert secret_scan.scan(first, ledger, rule_version="2").count() == 4
    assert spark.read.parquet(ledger).groupBy("rule_version").count().orderBy("rule_version").collect()[1]["count"] == 3
    assert secret_scan.scan(docs(spark, []), ledger).count() == 0


def test_secrets_repeated_ids(spark):
    d = spark.createDataFrame([(1, "token=abcdefgh1"), (1, "token=abcdefgh1"), (None, "token=abcdefgh1"), (None, None)], "doc_id long, text string")
    got = secret_scan.op4_rows(d).collect()
    assert sorted(r["n_assign"] for r in got) == [0, 1, 1, 1]


def test_pii_base(spark):
    texts = fuzz(2)
    for r in pii.op5_rows(docs(spark, texts)).collect():
        want = written(texts[r["doc_id"]], BASE_PII)
        mine = ",".join(x for x in r["spans"].split(",") if not x.startswith("term:"))
        assert mine == want and r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [want.count(k + ":") for k in ("email", "ip", "card", "phone")]


@pytest.mark.parametrize("most", [200_000, 0])
def test_pii_terms(spark, most, monkeypatch):
    monkeypatch.setattr(pii, "BROADCAST_TERMS", most)
    rng = random.Random(4)
    common = ["weather", "report", "about", "people", "garden", "Straße"]
    texts = []
    for i in range(200):
        who = i % 25
        w = [rng.choice(common) for _ in range(rng.randint(3, 12))]
        if i % 2:
            w.insert(rng.randint(0, len(w)), f"Surname{'abcdefghijklmnopqrstuvwxy'[who]}x user{who}@mail.org")
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    want = disclosed(rows)
    got = {r["doc_id"]: {(s["start"], s["end"]) for s in r["terms"]} for r in pii.disclose(docs(spark, texts)).collect() if r["terms"]}
    assert got == dict(want) and got
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs(spark, texts)).collect()}
    assert all("@mail" not in t for t in clean.values()) and any("<TERM>" in t and "<EMAIL>" in t for t in clean.values())
    assert clean[0] == texts[0]


def test_pii_empty(spark):
    assert pii.op5_rows(docs(spark, [])).count() == 0


def test_language_held_out(spark):
    rows = queries.op1_language_id(spark, SF).alias("p").join(spark.read.parquet(SF + "/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang is not null")
    r = rows.where("held_out").agg(F.count("*").alias("n"), F.avg((F.col("lang_pred") == F.col("lang")).cast("int")).alias("right")).first()
    assert r["n"] > 100 and r["right"] > 0.98


def test_language_cases(spark):
    texts = ["the cat sat on the mat with a hat", "der Hund und die Katze sind im Haus", None, "", "12 34 !!", "the thing", "die Sache", "the " * 50_000, "Ünïcödé"]
    model = language_id.train(docs(spark, texts, ["en", "de", "en", "de", "en", None, "de", "en", None]))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs(spark, texts), model).collect()}
    assert model[0] == ["de", "en"]
    assert [got[i][0] for i in range(8)] == ["en", "de", "und", "und", "und", "en", "de", "en"]
    assert all(0 <= s <= 1 for _, s in got.values()) and got[2][1] == 0
    assert language_id.identify(docs(spark, texts), language_id.train(docs(spark, []))).where("lang_pred <> 'und'").count() == 0
    assert language_id.identify(docs(spark, []), model).count() == 0
    assert language_id.identify(docs(spark, texts), model).columns == [*[c for c in docs(spark, []).columns if c != "score"], "lang_pred", "score"]


def test_language_sample_is_bounded(spark):
    many = docs(spark, [f"word{i} the of" for i in range(600)])
    assert language_id.train(many, rows_per_lang=50)[1].shape[1] == 1


def test_ngrams_do_not_depend_on_chunks(monkeypatch):
    text = "".join(random.Random(1).choice("abc dé日") for _ in range(500))
    whole = language_id.ngram_counts(text)
    monkeypatch.setattr(language_id, "_CHUNK", 7)
    assert (language_id.ngram_counts(text) == whole).all() and whole.sum() == 500 + 499 + 498
