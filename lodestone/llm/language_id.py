"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are summed per language and bucket on the executors; the matrix of log probabilities (languages x buckets, its
size fixed by parameters) is broadcast, and batches of texts are scored as sparse rows against it in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trim_memory

ORDERS = (1, 2, 3)
BUCKET_BITS = 15
#: Labelled rows learned from, for each language; a smaller corpus is learned from whole.
TRAIN_ROWS_PER_LANG = 4_000
UNDETERMINED = "und"
_MULT = np.uint32(0x9E3779B1)
_CHUNK = 1 << 20


def ngram_counts(text: str, bits: int = BUCKET_BITS) -> np.ndarray:
    """How often each bucket occurs among the 1-, 2- and 3-grams of the lower-cased text, in chunks so that a long text needs no more memory."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    counts = np.zeros(1 << bits, dtype=np.int64)
    for at in range(0, len(points), _CHUNK):
        part = points[at : at + _CHUNK + ORDERS[-1] - 1]
        for n in ORDERS:
            size = min(_CHUNK, len(part) - n + 1)
            if size <= 0:
                continue
            h = np.full(size, n, dtype=np.uint32)
            for k in range(n):
                h = (h ^ part[k : k + size]) * _MULT
                h ^= h >> np.uint32(15)
            counts += np.bincount((h * _MULT) >> np.uint32(32 - bits), minlength=1 << bits)
    return counts


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows_per_lang: int = TRAIN_ROWS_PER_LANG, bits: int = BUCKET_BITS, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """``(languages, log probabilities)``; row ``-1`` of the matrix is the log prior.

    Null texts and labels are left out. Of a language with more than ``rows_per_lang`` rows an id-hash sample of about
    that size is read. What comes to the driver is one row for each language and non-zero bucket,
    the size of the model itself; the number of documents doesn't enter it.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col).alias("lang")).count().collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((2, 0))
    share = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(min(1.0, rows_per_lang / v)))])
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1_000_003)) / F.lit(1_000_003)
    sample = rows.where(draw < share[F.col(lang_col)]).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
                c = ngram_counts(text, bits)
                total[lang] = total[lang] + c if lang in total else c
        for lang, c in total.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": c[at]})

    got = sample.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((1 << bits, len(langs)), smoothing)
    np.add.at(counts, (got["bucket"].to_numpy(dtype=np.int64), np.searchsorted(langs, got["lang"].to_numpy(dtype=str)) if len(got) else np.array([], dtype=int)), got["n"].to_numpy(dtype=float))
    prior = np.array([sizes[x] for x in langs], dtype=float)
    return langs, np.vstack([np.log(counts / counts.sum(axis=0)), np.log(prior / prior.sum())])


def score_batch(texts: list[str | None], langs: list[str], logp: np.ndarray, bits: int = BUCKET_BITS) -> tuple[list[str], np.ndarray]:
    """Language and posterior of each text: the batch's sparse count rows times the matrix, then a softmax."""
    pred, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if not langs:
        return pred, score
    cols: list[np.ndarray] = []
    vals: list[np.ndarray] = []
    which: list[int] = []

    def flush() -> None:
        if not which:
            return
        starts = np.concatenate([[0], np.cumsum([len(c) for c in cols])[:-1]])
        sums = np.add.reduceat(logp[np.concatenate(cols)] * np.concatenate(vals)[:, None], starts, axis=0) + logp[-1]
        p = np.exp(sums - sums.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        for k, i in enumerate(which):
            pred[i], score[i] = langs[best[k]], p[k, best[k]]
        cols.clear(), vals.clear(), which.clear()

    held = 0
    for i, text in enumerate(texts):
        if has_letter(text):
            c = ngram_counts(text, bits)
            at = np.flatnonzero(c)
            cols.append(at), vals.append(c[at].astype(float)), which.append(i)
            held += len(at)
            if held * len(langs) > 2_000_000:
                flush()
                held = 0
    flush()
    return pred, score


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", bits: int = BUCKET_BITS, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all unless given) of ``docs`` with ``lang_pred`` and ``score``.

    A text that is null or has no letter is ``und`` with score 0, as is every text where the model knows no language.
    Ties go to the language first by code point. An empty input gives an empty result. ``lang_pred`` and ``score``
    replace input columns of those names.
    """
    held = docs.sparkSession.sparkContext.broadcast((model[0], np.ascontiguousarray(model[1])))
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        langs, logp = held.value
        for texts in batches:
            pred, score = score_batch(texts.tolist(), langs, logp, bits)
            yield pd.DataFrame({"lang_pred": pred, "score": np.round(score, 9)})
        trim_memory()

    out = docs.select(*[F.col(f"`{c}`") for c in keep], predict(F.col(text_col)).alias("__ls_id"))
    return out.select(*[F.col(f"`{c}`") for c in keep], "__ls_id.lang_pred", "__ls_id.score")
