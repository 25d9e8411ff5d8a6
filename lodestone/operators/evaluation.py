"""Retrieval quality: recall, reciprocal rank, nDCG, hits, percentiles, and a keyword baseline."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ir_metrics(ranked: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, recall_5, recall_10, mrr, ndcg_10``.

    ``ranked``: ``query_id, item, rank`` from 1. ``truth``: ``query_id, item``. A query without truth scores 1 in all.
    """
    t = truth.select("query_id", "item").distinct()
    size = t.groupBy("query_id").agg(F.count("*").alias("n"))
    hit = ranked.join(t, ["query_id", "item"]).groupBy("query_id").agg(
        F.count_if(F.col("rank") <= 5).alias("h5"), F.count_if(F.col("rank") <= 10).alias("h10"), F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= 10, F.lit(1.0) / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(10), F.col("n")).cast("int")), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + 1.0))
    out = queries.select("query_id").distinct().join(size, "query_id", "left").join(hit, "query_id", "left")
    none = F.col("n").isNull()
    of = lambda x: F.when(none, F.lit(1.0)).otherwise(F.coalesce(x, F.lit(0.0)))
    return out.select("query_id", of(F.col("h5") / F.col("n")).alias("recall_5"), of(F.col("h10") / F.col("n")).alias("recall_10"), of(1.0 / F.col("first")).alias("mrr"), of(F.col("dcg") / ideal).alias("ndcg_10"))


def path_match(path: Column, expected: Column) -> Column:
    """Loose equality of paths: one ends with the other, or the expected one (over three characters) lies within."""
    return (path == expected) | path.endswith(F.concat(F.lit("/"), expected)) | expected.endswith(F.concat(F.lit("/"), path)) | (F.contains(path, expected) & (F.length(expected) > 3))


def hits_at(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """``query_id, first_rank, hit_1, hit_3, hit_5, rr`` by loose path equality; ``expected`` has ``query_id, expected_path``."""
    first = ranked.join(expected, "query_id").where(path_match(F.col("path"), F.col("expected_path"))).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    out = ranked.select("query_id").distinct().join(first, "query_id", "left")
    hit = lambda k: F.coalesce(F.col("first_rank") <= k, F.lit(False))
    return out.select("query_id", "first_rank", hit(1).alias("hit_1"), hit(3).alias("hit_3"), hit(5).alias("hit_5"), F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("rr"))


def by_groups(metrics: DataFrame, groups: list[str], values: list[str], digits: int = 6) -> DataFrame:
    """Means overall and within each single group column, in one pass: ``grouping, group, n`` and the means."""
    rows = metrics.withColumn("g", F.explode(F.array(F.struct(F.lit("all").alias("grouping"), F.lit("").alias("group")), *[F.struct(F.lit(g).alias("grouping"), F.col(g).cast("string").alias("group")) for g in groups])))
    return rows.groupBy("g.grouping", "g.group").agg(F.count("*").alias("n"), *[F.round(F.avg(v), digits).alias(v) for v in values])


#: Queries of the keyword baseline in one broadcast; more are looked for in several passes over the documents.
QUERY_BLOCK = 10_000
#: Different runs of a text whose words a task remembers.
KNOWN_RUNS = 200_000
_RUN = re.compile("[a-z0-9_-]+")


def naive_hits(queries: DataFrame, docs: DataFrame, query_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``query, doc_id, hits``: how many of each query's ``words`` a document contains as substrings, where any.

    The queries are a stated set; blocks of them, dealt by a hash of the id, are broadcast and each document is read once a
    block. A word of letters, digits, ``_`` and ``-`` stands inside one run of these: a run is looked through once in a task,
    and a document asks for its different runs. Other words are looked for in the whole text.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    d = docs.where(F.col(text_col).isNotNull()).select(id_col, F.lower(text_col).alias("t"))
    kinds = f"`{query_col}` {dict(queries.dtypes)[query_col]}, `{id_col}` {dict(docs.dtypes)[id_col]}, hits int"
    out = None
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64(query_col), F.lit(blocks)) == b) if blocks > 1 else queries
        part = d.mapInArrow(_hits_of(block.select(query_col, "words"), d.columns[0]), kinds)
        out = part if out is None else out.unionByName(part)
    return out


def _hits_of(block: DataFrame, id_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    asked = block.toArrow()  # at most about QUERY_BLOCK rows
    ids = asked.column(0).combine_chunks()
    ask: dict[str, list[int]] = {}
    for i, words in enumerate(asked.column(1).to_pylist()):
        for w in words or []:
            if w is not None:
                ask.setdefault(w, []).append(i)
    held = block.sparkSession.sparkContext.broadcast((ids, {w: np.array(i) for w, i in ask.items()}, block.columns[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ask, query_col = held.value
        plain = {w for w in ask if _RUN.fullmatch(w)}
        sizes, others = sorted({len(w) for w in plain}), [w for w in ask if w not in plain]
        inside: dict[str, list[str]] = {}

        def of(x: str) -> list[str]:
            if x not in inside:
                if len(inside) >= KNOWN_RUNS:
                    inside.clear()
                inside[x] = [w for n in sizes if n <= len(x) for w in {x[i : i + n] for i in range(len(x) - n + 1)} & plain]
            return inside[x]

        def put(batch: pa.RecordBatch, *rows: list[np.ndarray]) -> pa.RecordBatch:
            q, docs, n = (pa.array(np.concatenate(x)) for x in rows)
            return pa.RecordBatch.from_arrays([ids.take(q), batch.column(0).take(docs), n.cast(pa.int32())], [query_col, id_col, "hits"])

        for batch in batches:
            docs, q, n, rows = [], [], [], 0
            for k, t in enumerate(batch.column(1)):
                t = t.as_py()
                found = {w for x in set(_RUN.findall(t)) for w in of(x)}.union(w for w in others if w in t)
                if found:
                    hits = np.bincount(np.concatenate([ask[w] for w in found]), minlength=len(ids))
                    some = np.flatnonzero(hits)
                    docs.append(np.full(len(some), k))
                    q.append(some)
                    n.append(hits[some])
                    rows += len(some)
                if docs and rows >= 100_000:
                    yield put(batch, q, docs, n)
                    docs, q, n, rows = [], [], [], 0
            if docs:
                yield put(batch, q, docs, n)

    return run


def first_overflow(rows: DataFrame, group: list[str], order: list[Column], tokens: str, budget: int, least_rest: int | None = None) -> DataFrame:
    """Rows before the running total first passes ``budget``; with ``least_rest`` the row that overflows stays cut to what is left, if that is so much."""
    w = Window.partitionBy(*group).orderBy(*order)
    run = rows.withColumn("before", F.coalesce(F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    over = (F.col("before") + F.col(tokens) > budget).cast("int")
    run = run.withColumn("overs", F.sum(over).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = F.col("overs") == 0
    if least_rest is None:
        return run.where(whole).drop("before", "overs").withColumn("taken", F.col(tokens))
    first = (F.col("overs") == 1) & (over == 1) & (budget - F.col("before") >= least_rest)
    return run.where(whole | first).withColumn("taken", F.when(whole, F.col(tokens)).otherwise(budget - F.col("before"))).drop("before", "overs")
