"""What the README says of the near-duplicate join's recall, and near copies with repeated or null ids."""

import os

import corpus_pipeline
from lodestone.llm import ngram_join, pii

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_readme_states_depth_and_missed_pairs():
    depth = ngram_join.prefix_depth()
    with open(os.path.join(ROOT, "README.md")) as f:
        text = f.read()
    assert f"probability {(1 - ngram_join.SIMILARITY**depth) ** ngram_join.TREES:.1e} for a lone pair" in text
    assert f"a prefix of {depth} of its {ngram_join.DEPTH} values" in text


def near_copies():
    a = " ".join(f"t{i}" for i in range(60))
    b = " ".join(f"u{i}" for i in range(60))
    return a, a + " more", b, b + " more", b + " and more"


def test_one_of_each_group_stays_with_repeated_and_null_ids(spark):
    a, a2, b, b2, b3 = near_copies()
    schema = "doc_id long, text string"
    kept = lambda rows: sorted(map(str, map(tuple, corpus_pipeline.drop_near(spark, spark.createDataFrame(rows, schema), "").collect())))
    want = lambda rows: sorted(map(str, rows))
    clean = (5, "another text that shares no words with the rest of them")
    # The id of a loser is also that of a clean row.
    assert kept([(1, a), (5, a2), clean, (None, None)]) == want([(1, a), clean, (None, None)])
    # Near copies with a null id, with and without an id to lose against.
    assert kept([(1, a), (None, a2)]) == want([(1, a)])
    assert len(kept([(None, b), (None, b2), (None, b3)])) == 1
    # Two texts of one group share the least id.
    assert len(kept([(1, b), (1, b2), (2, b3)])) == 1


def test_sanitise_with_repeated_and_null_ids(spark):
    rows = [(1, "x ann@mail.org y"), (1, "call me at bob@mail.org"), (None, "to eve@mail.org"), (None, "no one here"), (1, None)]
    got = [tuple(r) for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, "x <EMAIL> y"), (1, "call me at <EMAIL>"), (None, "to <EMAIL>"), (None, "no one here"), (1, "")]))
