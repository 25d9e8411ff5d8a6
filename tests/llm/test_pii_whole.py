"""Disclosing terms of whole documents: plain Python, the text's own edges, and terms far from their entity."""

import math
import random
import re
from collections import defaultdict

import pytest
from brute import BASE_PII, base_spans
from test_text_ops import docs

from lodestone.llm import pii


def whole(texts, disclosure=0.9, support=3):
    """{row: {(start, end)}} of disclosing terms, as pii.disclose defines them without a context."""
    words, df_e, df_t, df_et = [], defaultdict(set), defaultdict(set), defaultdict(set)
    for k, text in enumerate(texts):
        apart, held = text or "", set()
        for start, _, span, kind in base_spans(text, BASE_PII):
            end = int(span.split(":")[2])
            held.add(f"{kind}:{text[start:end].lower()}")
            if kind == "email":
                apart = apart[:start] + " " * (end - start) + apart[end:]
        words.append([(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]{4,}", apart)])
        for t in {w[2] for w in words[k]}:
            df_t[t].add(k)
        for e in held:
            df_e[e].add(k)
            for t in {w[2] for w in words[k]}:
                df_et[e, t].add(k)
    n, out = len(texts), defaultdict(set)
    for (e, t), k in df_et.items():
        de, dt, det = len(df_e[e]), len(df_t[t]), len(k)
        if de >= support and det >= support and de < n and math.log(det * n / (de * dt)) >= disclosure * math.log(n / de):
            for row in k:
                out[row] |= {w[:2] for w in words[row] if w[2] == t}
    return dict(out)


def term_spans(rows):
    out = {}
    for r in rows:
        spans = {tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x.startswith("term:")}
        assert r["n_term"] == len(spans)
        if spans:
            out[r["doc_id"]] = spans
    return out


@pytest.mark.parametrize("most", [200_000, 0])
def test_terms_of_whole_documents(spark, most, monkeypatch):
    monkeypatch.setattr(pii, "BROADCAST_TERMS", most)
    rng = random.Random(9)
    common = ["weather", "report", "about", "people", "garden", "Straße", "4111 1111 1111 1111"]
    texts = [None, ""]
    for i in range(240):
        who = "abcdefghijklmnopqrstuvwxy"[i % 25]
        w = [rng.choice(common) for _ in range(rng.randint(3, 60))]
        if i % 2:
            for x in (f"Surname{who}x", f"Ort{who}dorf", f"user{who}{who}@mail.org", *(["é+49 30 1234" + str(i % 25 + 100)] * (i % 3))):
                w.insert(rng.randint(0, len(w)), x)
        texts.append(" ".join(w))
    got = term_spans(pii.op5_rows(docs(spark, texts)).collect())
    assert got == whole(texts) and len(got) > 100


def test_terms_at_the_edges_and_far_off(spark):
    far = " and ".join(["more of the weather"] * 20)
    texts = [f"Surnamey user@mail.org {far} Farstreety"] * 4 + [far] * 40
    got = term_spans(pii.op5_rows(docs(spark, texts)).collect())
    assert got == {k: {(0, 8), (len(texts[0]) - 10, len(texts[0]))} for k in range(4)}
    clean = [r["text"] for r in pii.sanitise(docs(spark, texts)).collect()]
    assert clean.count(f"<TERM> <EMAIL> {far} <TERM>") == 4 and clean.count(far) == 40


@pytest.mark.parametrize("most, least", [(200_000, 256), (0, 2)])
def test_a_page_of_many_entities_and_terms(spark, most, least, monkeypatch):
    """Copies of one page of 400 addresses and 600 terms are one pair of classes; beyond the bounds the result is the same."""
    monkeypatch.setattr(pii, "BROADCAST_TERMS", most)
    monkeypatch.setattr(pii, "HEAVY_LEAST", least)
    monkeypatch.setattr(pii, "HEAVY_NODES", 10**9)
    sizes = []
    real = pii.materialize

    def counted(df, name):
        out = real(df, name)
        if name in ("contexts", "held"):
            sizes.append(out.count())
        return out

    monkeypatch.setattr(pii, "materialize", counted)
    word = lambda k, head: head + "".join("abcdefghij"[int(c)] for c in f"{k:04d}")
    page = " ".join([f"u{k}@mail.org {word(k, 'term')}" for k in range(400)] + [word(k, "only") for k in range(200)])
    other = " ".join([f"u{k}@mail.org" for k in range(5)] + [word(k, "term") for k in range(5)])
    texts = [page] * 6 + [other] * 3 + ["weather report " + word(7, "only")] * 30 + ["weather report"] * 40 + [None]
    got = term_spans(pii.op5_rows(docs(spark, texts)).collect())
    assert got == whole(texts) and set(got) == set(range(9))
    # Entities: those of the page only, and those of both texts. Terms likewise; of the four pairs one is hopeless.
    assert sizes == [6 * 2 + 3, 6 * 3 + 3]
