"""Token files, packing, mixing and the pipeline."""

import io
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import mixing, packing, queries, token_files
from lodestone.llm.tokens import ChunkEncoder

PATH = queries.vocabulary()
DOCS = "doc_id long, text string, source string, lang string, n_chars long, size long, step long"
ODD = ["", " ", "  a", "a  b", "a   b", " a b ", "a\n b", "a\n\n  b", "a \nb", "don't  stop 'll", "x\t y", "é ü ß  ", "\n", "a b\n", "<|endoftext|> a", "🙂 🙂b", "a\x1c b", "a　 b", "a\xa0b c", "word " * 3000]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", None, 1, 2) for i, t, s in rows], DOCS)


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        k = int(rng.paretovariate(0.9) * 20) % 6000
        out.append((i * 3 % (3 * n + 1), " ".join(rng.choice(["alpha", "be", "Gamma,", "x", "délta"]) + str(rng.randint(0, 99)) for _ in range(k)), rng.choice(["a", "a", "a", "b", "c", "d", None])))
    return out + [(5000, None, "a"), (5001, "", "zz"), (5002, " \n ", "b")]


def test_encoder_equals_the_tokenizer(plain):
    rng = random.Random(7)
    texts = ODD + ["".join(rng.choice(["a", "B", " ", "\n", "1", "'s", ".", "é", "\t", " the", "\x85", "日"]) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    enc = ChunkEncoder(PATH)
    for _ in range(2):  # the second time from the table of known chunks
        ids, ends = enc.encode(texts)
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files(spark, plain, tmp_path):
    rows = [(i, t, s) for i, t, s in corpus(150)] + [(9000 + i, t, "o") for i, t in enumerate(ODD)]
    manifest = token_files.write_token_files(docs(spark, rows).repartition(5), PATH, path=str(tmp_path / "out"))
    got = {r["doc_id"]: (r["start"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) for r in token_files.read_token_files(manifest, str(tmp_path / "out")).collect()}
    start = 0
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        assert got[i] == (start, len(ids), ids)
        start += len(ids)
    assert manifest.agg(F.sum("n_ids")).first()[0] == start


def test_token_files_empty_and_repeated(spark, tmp_path):
    none = token_files.write_token_files(docs(spark, []), PATH, path=str(tmp_path / "none"))
    assert token_files.read_token_files(none, str(tmp_path / "none")).count() == 0
    m = token_files.write_token_files(docs(spark, [(1, "b", "s"), (1, "a", "s"), (None, "c", "s")]), PATH, path=str(tmp_path / "rep"))
    assert sorted(((r["doc_id"] or -1), r["start"]) for r in token_files.read_token_files(m, str(tmp_path / "rep")).collect()) == [(-1, 0), (1, 2), (1, 4)]


class Kept(io.BytesIO):
    def close(self):
        pass


def test_reader_decompresses_only_what_is_asked():
    out = Kept()
    w = token_files.TokenFileWriter(out, frame_ids=100)
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 50_000, n).astype("<u4") for n in (5, 60, 50, 1000, 0, 3, 99, 100, 101)]
    for i, ids in enumerate(texts):
        w.add(i * 10, ids)
    w.close()
    r = token_files.TokenFileReader(io.BytesIO(out.getvalue()))
    assert r.document(2).tolist() == texts[2].tolist() and r.frames_read == 1
    assert r.find(30) == [3] and r.document(3).tolist() == texts[3].tolist() and r.frames_read == 11
    assert all(r.document(i).tolist() == t.tolist() for i, t in enumerate(texts))
    raw = bytearray(out.getvalue())
    raw[20] ^= 0xFF
    with pytest.raises((ValueError, Exception)):
        token_files.TokenFileReader(io.BytesIO(bytes(raw))).document(0)
    with pytest.raises(ValueError):
        token_files.TokenFileReader(io.BytesIO(bytes(out.getvalue()[:-1]) + b"x"))


def test_standard_decoder_reads_the_frames():
    import zstandard

    out = Kept()
    w = token_files.TokenFileWriter(out, frame_ids=10)
    w.add(1, np.arange(35, dtype="<u4"))
    w.close()
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True) as s:
        assert s.read() == np.arange(35, dtype="<u4").tobytes()


def test_packing(spark, plain):
    rows = corpus(300, 2) + [(7000, "w " * 5000, "a")]
    out = packing.pack(docs(spark, rows), PATH, group_docs=64).collect()
    ids = {i: plain.encode(t or "", add_special_tokens=False).ids + [1] for i, t, _ in rows}
    spans, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and r["length"] == len(r["ids"]) // 4 > 0
        spans[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, x in ids.items():
        at = 0
        for start, n in sorted(spans[i]):
            assert start == at
            at += n
        assert at == len(x)
    padding = total = 0
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.005 * total


def test_plan_places_every_token():
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.choice([1, 2, 5, 300, 700, 1024, 2047, 2048, 2049, 5000]) for _ in range(rng.randint(0, 40))]
        seen = Counter()
        for seq in packing.plan_group(sizes):
            assert 0 < sum(p[2] for p in seq) <= 2048
            for i, start, n in seq:
                assert n > 0
                for k in (start, start + n - 1):
                    assert 0 <= k < sizes[i]
                seen[i] += n
        assert [seen[i] for i in range(len(sizes))] == sizes


def test_tournament_is_first_fit():
    rng = random.Random(2)
    tree, plain_bins = packing.Tournament(50, 100), [100] * 50
    for _ in range(50):
        size = rng.randint(1, 100)
        first = next((i for i, c in enumerate(plain_bins) if c >= size), None)
        if first is None:
            break
        assert tree.place(size) == first
        plain_bins[first] -= size


def test_packing_empty(spark):
    assert packing.pack(docs(spark, []), PATH).count() == 0
    assert [r["length"] for r in packing.pack(docs(spark, [(None, None, None)]), PATH).collect()] == [1]


def check_mix(rows, out):
    size = {i: len((t or "").encode().split()) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    by = Counter()
    for i in size:
        by[source[i]] += size[i]
    order = sorted(by, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets([by[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))]), strict=True))
    taken = Counter()
    for r in out:
        i = r["doc_id"]
        assert r["size"] == size[i] and r["source_size"] == by[source[i]] and r["target"] == pytest.approx(want[source[i]])
        assert 0 <= r["taken"] <= 3 * size[i]
        taken[source[i]] += r["taken"]
    assert len(out) == len(rows)
    for s in order:
        assert abs(taken[s] - want[s]) <= 1


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEP_DOCS", 10)
    rows = corpus(300, 3)
    a = mixing.op2_rows(docs(spark, rows)).collect()
    check_mix(rows, a)
    b = mixing.op2_rows(docs(spark, rows).repartition(7)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_targets_stop_at_three_times():
    t = mixing.targets([10, 1000, 1000, 0], [5, 2, 1, 5])
    assert t[0] == 30 and t[3] == 0 and t.sum() == pytest.approx(2010) and t[1] == pytest.approx(2 * t[2])


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000])
def test_permutation(n):
    for seed in (1, 2**61 + 5):
        assert sorted(mixing.permuted(np.arange(n), n, seed).tolist()) == list(range(n))


def test_mixing_empty_and_wordless(spark):
    assert mixing.op2_rows(docs(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.op2_rows(docs(spark, [(1, None, None), (2, " ", "a")])).collect()] == [0, 0]
    assert mixing.mixed_texts(docs(spark, [(1, None, None)])).count() == 0


@pytest.mark.parametrize("repeat", [False, True])
def test_mixed_texts(spark, repeat):
    rows = [r for r in corpus(120, 4) if r[0] < 5000]
    if repeat:
        rows += rows[:5]
    d = docs(spark, rows)
    taken = Counter()
    for r in mixing.op2_rows(d).collect():
        taken[r["doc_id"]] += r["taken"]
    out = mixing.mixed_texts(d)
    assert out.columns == d.columns
    got, texts = Counter(), defaultdict(set)
    for i, t, _ in rows:
        texts[i] |= set((t or "").split())
    for r in out.collect():
        w = r["text"].split()
        assert r["n_chars"] == len(r["text"]) and set(w) <= texts[r["doc_id"]]
        got[r["doc_id"]] += len(w)
    assert got == +taken


def test_pipeline_stages(spark):
    rng = random.Random(9)
    english = ["the", "house", "with", "garden", "over", "there", "was", "small", "people", "walk", "river", "under"]
    german = ["der", "garten", "und", "das", "haus", "war", "klein", "leute", "gehen", "unter", "fluss", "dort"]
    rows = [(i, " ".join(rng.choice(english if i % 2 else german) + rng.choice(["", "s", "en"]) for _ in range(80)), "s" + str(i % 3), "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, rows[0][1].upper().replace("Ä", "ä"), "s0", "de"), (101, rows[1][1] + " extra", "s1", "en"), (102, "1234 5678", "s1", "en"), (103, None, None, None), (104, "", "s1", None)]
    d = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, s, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "ngram_join", "mixing", "packing"]
    a = stages["language_id"](spark, d, "")
    assert {r["doc_id"] for r in a.collect()} == {r[0] for r in rows} - {102, 103, 104} and a.columns == d.columns
    b = stages["exact_dedup"](spark, a, "")
    assert {r["doc_id"] for r in b.collect()} == {r[0] for r in rows} - {102, 103, 104, 0}
    c = stages["ngram_join"](spark, b, "")
    assert {r["doc_id"] for r in c.collect()} == {r[0] for r in rows} - {102, 103, 104, 0, 101} and c.columns == d.columns
    m = stages["mixing"](spark, c, "")
    assert m.columns == d.columns and m.count() > 0
    p = stages["packing"](spark, m, "").collect()
    assert sum(r["length"] for r in p) == sum(r["doc_tokens"] for r in p if r["start"] == 0)
    empty = d.limit(0)
    for f in stages.values():
        empty = f(spark, empty, "") if f is not stages["packing"] else empty
        assert empty.count() == 0
    assert stages["packing"](spark, empty, "").count() == 0


def test_pipeline_runs_whole(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_registered_digests(spark, plain):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(sf + "/documents.parquet").collect()}
    for r in queries.op6_token_files(spark, sf).collect():
        ids = plain.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [0]
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    for r in queries.op9_packing(spark, sf).collect():
        ids = (plain.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [1])[r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert set(queries.QUERIES) == {f"op{n}_{x}" for n, x in ((1, "language_id"), (2, "mixing"), (3, "vector_dedup"), (4, "secret_scan"), (5, "pii"), (6, "token_files"), (7, "exact_dedup"), (8, "substring_dedup"), (9, "packing"), (10, "ngram_join"))}
