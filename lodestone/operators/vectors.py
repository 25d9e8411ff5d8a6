"""Cosine search over vector tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

#: Query vectors in one pass, and their components; more are searched in several, so that what is broadcast has a bound.
QUERY_BLOCK, QUERY_CELLS = 32_768, 1 << 21
#: Similarities that a task works out at once.
CELLS = 1 << 20
#: Pairs of vectors that are multiplied once more in double precision at once.
PAIRS = 1 << 14


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 where either has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def decode(json: Column) -> Column:
    """A vector from its JSON form; null where that is corrupt."""
    return F.from_json(json, "array<float>")


def topk(queries: DataFrame, vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 6) -> DataFrame:
    """``query_id, vec_id, score, rank``: exact search of every query against all vectors.

    A block of queries is broadcast; each task multiplies its batches with it and keeps k rows of a query, so what is
    shuffled is tasks x queries x k rows. More than one block are dealt by a hash of the id and searched one after the
    other, so that the driver holds one at a time. ``queries`` has ``query_id`` and the vector column; the query itself is a hit.
    """
    asked = queries.select("query_id", F.col(vector_col).alias("v")).where("v is not null")
    width = asked.select(F.size("v")).first()
    most = max(1, min(QUERY_BLOCK, QUERY_CELLS // max(1, width[0] if width else 1), QUERY_CELLS // (8 * k)))
    first = asked.limit(most + 1).toArrow()
    if len(first) <= most:
        out = _searched(first, vectors, k, id_col, vector_col, digits)[0]
    else:
        asked = materialize(asked, "asked")
        blocks = -(-asked.count() // max(1, most // 2))
        out = None
        for b in range(blocks):
            found, held = _searched(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow(), vectors, k, id_col, vector_col, digits)
            found = materialize(found, "hits")
            held.destroy()
            out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _matrix(v: pa.ListArray) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1) if len(v) else np.zeros((0, 1))


def _searched(part: pa.Table, vectors: DataFrame, k: int, id_col: str, vector_col: str, digits: int) -> tuple[DataFrame, Broadcast]:
    """Each task's best rows for a block of queries, and the block's broadcast."""
    part = part.combine_chunks()
    v = part["v"].combine_chunks() if len(part) else None
    held = vectors.sparkSession.sparkContext.broadcast((part["query_id"].to_numpy(), np.zeros((0, 1)) if v is None else _unit(_matrix(v.chunk(0) if isinstance(v, pa.ChunkedArray) else v))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = held.value
        step = max(1, CELLS // max(1, len(ids)))
        rows, n, least = [], 0, np.full(len(ids), -np.inf)
        single = q.astype(np.float32)
        # Single precision finds what may reach the top; its error is under half of this. Only that is worked out in double precision.
        slack = (q.shape[1] + 4) * 2.0**-22 + 10.0**-digits
        for batch in batches:
            names, whole = batch.column(0).to_numpy(zero_copy_only=False), _unit(_matrix(batch.column(1)))
            for at in range(0, len(whole) if len(ids) else 0, step):
                here = whole[at : at + step]
                sims = single @ here.T.astype(np.float32)
                bar = least
                if np.isinf(least).any():
                    keep = min(k, len(here))
                    # The k-th best may be tied: ties are kept here and cut by id below.
                    bar = np.maximum(bar, np.partition(np.nan_to_num(sims, nan=-np.inf), len(here) - keep, axis=1)[:, len(here) - keep])
                i, j = np.divmod(np.flatnonzero(sims >= (bar - slack).astype(np.float32)[:, None]), len(here))
                score = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", q[i[lo : lo + PAIRS]], here[j[lo : lo + PAIRS]]) for lo in range(0, len(i), PAIRS))]).round(digits)
                some = score >= least[i]
                rows.append(pd.DataFrame({"i": i[some], "vec_id": names[at + j[some]], "score": score[some]}))
                n += len(rows[-1])
                if n > 2 * k * len(ids) or (len(rows) == 1 and len(rows[0]) == n and np.isinf(least).all()):
                    rows = [_best(rows, k)]
                    n = len(rows[0])
                    full = rows[0].groupby("i")["score"].agg(["size", "min"])
                    full = full[full["size"] == k]
                    least[full.index.to_numpy()] = full["min"].to_numpy()
        if rows:
            best = _best(rows, k)
            yield pa.RecordBatch.from_arrays([pa.array(ids[best["i"].to_numpy()], pa.int64()), pa.array(best["vec_id"], pa.int64()), pa.array(best["score"], pa.float64())], ["query_id", "vec_id", "score"])

    found = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("v is not null").mapInArrow(search, "query_id long, vec_id long, score double")
    return found, held


def _best(rows: list[pd.DataFrame], k: int) -> pd.DataFrame:
    return pd.concat(rows).sort_values(["i", "score", "vec_id"], ascending=[True, False, True]).groupby("i").head(k)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1.0)
