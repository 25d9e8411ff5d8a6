"""Benchmark passages, collocations and the filter audit against plain Python versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from lodestone.llm import collocations, decontamination, filter_audit

UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").encode().translate(UPPER).decode()


# Benchmark passages


def brute_passages(docs, items, size=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wanted = defaultdict(set)
    for i, t in items:
        w = word.findall(lower(t))
        for k in range(max(1, len(w) - size + 1) if w else 0):
            wanted[tuple(w[k : k + size])].add(i)
    sizes = {len(k) for k in wanted}
    out = []
    for i, t in docs:
        w, ids, hit = list(word.finditer(lower(t))), set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                key = tuple(x[0] for x in w[k : k + m])
                if key in wanted:
                    hit |= set(range(k, k + m))
                    ids |= wanted[key]
        ids = sorted(str(x) for x in ids if x is not None)
        spans = []
        for k in sorted(hit):
            if spans and spans[-1][2] == k - 1:
                spans[-1] = (spans[-1][0], w[k].end(), k)
            else:
                spans.append((w[k].start(), w[k].end(), k))
        out.append((i, len(w), len(hit), ids, [s[:2] for s in spans]))
    return out


def passages(seed=1):
    rng = random.Random(seed)
    words = ["The", "ñandú", "été", "x1", "don", "t", "Fluß", "go", "日本", "ab"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "-", "'", "\x00", "  "]) for _ in range(n))
    items = [(i, text(rng.choice([3, 10, 11, 25]))) for i in range(8)] + [(20, None), (21, ""), (22, "?!"), (None, "only one of these"), (3, "a second text of item three"), (23, "ab ab ab"), (24, "ab ab ab")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(30)] + [(40, None), (41, ""), (None, "..."), (41, "ab ab ab ab"), (43, "Only ONE of; these"), (44, " ".join(["ab"] * 20_000))]
    for i in range(12):
        t = items[i % 8][1]
        docs.append((50 + i, text(5) + t.upper().replace("SS", "ß") + text(5) + t[: len(t) // 2]))
    return docs, items


@pytest.mark.parametrize("most", [10**9, 300])
def test_passages(spark, most):
    docs, items = passages()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    out = decontamination.contaminated(d, spark.createDataFrame(items, "item_id long, text string"), most=most).collect()
    got = [(r["doc_id"], r["found"]["n_words"], r["found"]["n_hit"], r["found"]["items"], [tuple(s) for s in r["found"]["spans"]]) for r in out]
    expected = brute_passages(docs, items)
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert any(x[2] for x in expected)


def test_passage_rows_and_clashing_columns(spark):
    docs, items = passages(2)
    i = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, doc_id int")
    d = spark.createDataFrame([(a, b, "x", 7, "y", 8) for a, b in docs], "doc_id long, text string, found string, row int, `a.b` string, item_id int")
    got = {tuple(r) for r in decontamination.op11_rows(d, i).collect()}
    assert got == {(a, n, h, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), h > 0) for a, n, h, ids, _ in brute_passages(docs, items)}
    kept = decontamination.contaminated(d, i)
    assert kept.columns == ["doc_id", "text", "row", "a.b", "item_id", "found"] and {r["a.b"] for r in kept.collect()} == {"y"}
    clean = decontamination.without_passages(d, i)
    assert clean.columns == d.columns
    want = []
    for (a, t), (_, _, _, _, spans) in zip(docs, brute_passages(docs, items)):
        for s, e in reversed(spans):
            t = t[:s] + t[e:]
        want.append((a, t))
    assert sorted([(r["doc_id"], r["text"]) for r in clean.collect()], key=repr) == sorted(want, key=repr)


def test_passages_of_empty_tables(spark):
    docs, items = passages()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontamination.op11_rows(d.where("false"), i).count() == 0
    rows = decontamination.op11_rows(d, i.where("false")).collect()
    assert len(rows) == len(docs) and not any(r["contaminated"] or r["n_items"] for r in rows)


# Collocations


def brute_phrases(rows, support, longest=4, top=2000):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        total[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    f[lang, tuple(w[i : i + n])] += 1
    c = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= support}
    longer = defaultdict(int)
    for (lang, p), a in c.items():
        for n in range(2, len(p)):
            for i in range(len(p) - n + 1):
                longer[lang, p[i : i + n]] = max(longer[lang, p[i : i + n]], a)
    out = []
    by = defaultdict(list)
    for (lang, p), a in c.items():
        if 100 * longer[lang, p] < 80 * a:
            s, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            by[lang].append((-s, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    for lang, x in by.items():
        out += [(lang, i + 1, p.decode(), -a, left, r, total[lang], -s) for i, (s, a, p, left, r) in enumerate(sorted(x)[:top])]
    return out


def prose(seed, n=300):
    rng = random.Random(seed)
    words = ["New", "York", "city", "the", "Ñandú", "new", "of", "日本", "a\x1fb", "c d", "e f"]
    rows = []
    for _ in range(n):
        t = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ". ", "\n", " ; ", "  "]) for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice(["en", "en", "es", None, "und", ""]), t + rng.choice(["new york city hall", "", "New York City"])))
    return rows + [("en", None), (None, ""), ("en", "..."), ("en", "the " * 30_000), ("es", "new york city hall " * 40)]


@pytest.mark.parametrize("bits,chunk,support", [(26, 6_000_000, 30), (15, 500, 12), (16, 40, 300)])
def test_collocations(spark, monkeypatch, bits, chunk, support):
    """Few buckets and small chunks give the same phrases as many; a support beyond a counter's reach is no problem."""
    monkeypatch.setattr(collocations, "CHUNK_BYTES", chunk)
    rows = prose(3)
    d = spark.createDataFrame([(lang, t, 1, "x") for lang, t in rows], "lang string, text string, n int, `a.b` string").repartition(3)
    got = collocations.collocations(d, bits=bits, support=support)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute_phrases(rows, support))


def test_collocations_cut_to_the_top(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SALT", 3)
    rows = prose(4, 200)
    d = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in collocations.collocations(d, top=5, support=10, bits=16).collect()) == sorted(brute_phrases(rows, 10, top=5))
    assert collocations.collocations(d.where("false"), bits=16).count() == 0
    assert collocations.collocations(d, support=10**6, bits=16).count() == 0


def test_hashed_pruning_drops_work_but_no_phrase(spark):
    """Pairs of frequent words that are never frequent together are not counted: the bucket bitmap holds them back."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [("en", bytes(" ".join(rng.choice(words) for _ in range(2_000)), "ascii")) for _ in range(40)]
    w = collocations._Words(texts)
    at, h, longer = collocations._scan(w, 1, None, 26)
    counters = np.zeros(1 << 26, np.uint8)
    collocations._count(counters, longer, 26)
    everything, buckets = np.full(1 << 23, 255, np.uint8), np.packbits(counters >= 30, bitorder="little")
    assert len(collocations._scan(w, 2, (everything, buckets), 26)[0]) < len(collocations._scan(w, 2, (everything, everything), 26)[0]) / 20


def test_scores_beyond_64_bits(spark):
    big = 9 * 10**15
    f = spark.createDataFrame([("en", "x", 1, big), ("en", "y", 1, big - 1), ("en", "x y", 2, big - 7)], "lang string, phrase string, words int, a long")
    r = collocations.scored(f).first()
    assert r["score"] == 2_000_000 * (big - 7) // (2 * big - 1)


# Filter audit


def brute_audit(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    low = {}
    for i, t, _ in docs:
        if i is not None:
            low[t or ""] = min(i, low.get(t or "", i))
    rows = defaultdict(list)
    for i, t, source in docs:
        t = t or ""
        w = t.encode().split()
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > low[t],
        }
        rows[source or ""].append(({k for k, v in fails.items() if v}, i in good, i in toxic))
    out = []
    for part, each in rows.items():
        shapley, lines = Counter(), []
        for p in permutations("ABCDE"):
            left = list(each)
            for step, f in enumerate(p, 1):
                gone = [x for x in left if f in x[0]]
                redundant = sum(f in x[0] for x in each) - len(gone)
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                lines.append((part, "".join(p), step, len(left), len(gone), redundant, sum(x[0] == {f} for x in each), sum(x[1] for x in gone), sum(x[2] for x in gone), f))
        out += [(*x[:-1], shapley[x[-1]]) for x in lines]
    return out


def audited(seed=6):
    rng = random.Random(seed)
    text = lambda: " ".join(rng.choice([*(f"w{i}" for i in range(rng.choice([5, 90]))), "A", "#x", "日本"]) for _ in range(rng.choice([0, 30, 49, 50, 90])))
    docs = [(i, text(), rng.choice(["s0", "s0", "s1", None, ""])) for i in range(120)]
    docs += [(200 + i, docs[rng.randrange(120)][1], rng.choice(["s0", "s2"])) for i in range(60)]
    docs += [(300, None, "s0"), (301, "", None), (None, docs[0][1], "s0"), (None, None, "s1"), (5, docs[5][1], "s1"), (5, "x", "s0"), (302, "x " * 50_000, "s9"), (303, "a\x0bb\x1fc d " * 20, "s0")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 300, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("hot", [256, 1])
def test_audit(spark, monkeypatch, hot):
    monkeypatch.setattr(filter_audit, "HOT_LEAST", hot)
    docs, labels = audited()
    d = spark.createDataFrame([(*r, 1, "z") for r in docs], "doc_id long, text string, source string, good int, `a.b` string")
    got = filter_audit.audit(d, spark.createDataFrame([(*r, 1) for r in labels], "doc_id long, quality int, toxic int, mask int"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute_audit(docs, labels))


def test_audit_of_empty_tables(spark):
    docs, labels = audited()
    d, y = spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert filter_audit.audit(d.where("false"), y).count() == 0
    assert {r["good_lost"] + r["toxic_lost"] for r in filter_audit.audit(d, y.where("false")).collect()} == {0}


def test_parity_sums_invert_to_the_cells(spark):
    rng = random.Random(7)
    rows = [("p", bool(rng.getrandbits(1)), bool(rng.getrandbits(1)), rng.randrange(32)) for _ in range(500)]
    sums = filter_audit.parities(spark.createDataFrame(rows, "part string, good boolean, toxic boolean, mask int"))
    assert sum(r["w"][0] for r in sums.collect()) == 500 and {len(r["w"]) for r in sums.collect()} == {32}
    c = filter_audit.cells(sums).first()
    assert c["every"] == [sum(m == k for *_, m in rows) for k in range(32)] and c["good"] == [sum(m == k and g for _, g, _, m in rows) for k in range(32)]
