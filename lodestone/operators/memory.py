"""Keyed state from logs: latest rows, partial upserts, expiry, queues, citations, de-duplication of notes, scopes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions import text as T
from .vectors import topk

# Feedback of each action.
FEEDBACK = {"thumbs_up": 1, "helpful": 1, "thumbs_down": -1, "unhelpful": -1}
MAX_ATTEMPTS, WORKER_ATTEMPTS = 5, 3


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``; one pre-aggregated pass, so a key of any number of rows is no problem."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("__last"))
    return best.select(*keys, *[F.col("__last")[c].alias(c) for c in rest]).select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those that share a key: a new snapshot, not an update."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def partial_upsert(log: DataFrame, key: str, order: str, first: list[str], last: list[str]) -> DataFrame:
    """One row per key: columns in ``first`` keep their earliest value, those in ``last`` take their latest."""
    return log.groupBy(key).agg(*[F.min_by(c, order).alias(c) for c in first], *[F.max_by(c, order).alias(c) for c in last], F.count("*").alias("usage_count"))


def sweep(rows: DataFrame, now: Column, status: str = "status", expires: str = "expires_at") -> DataFrame:
    """Pending and approved rows past their time become expired."""
    due = F.col(status).isin("pending", "approved") & (F.col(expires) < now)
    return rows.withColumn(status, F.when(due, F.lit("expired")).otherwise(F.col(status)))


def active(rows: DataFrame, now: Column, status: str | None = "approved") -> DataFrame:
    """Rows within their time and, unless ``status`` is None, of that status."""
    out = rows.where(F.col("expires_at") >= now)
    return out if status is None else out.where(F.col("status") == status)


def feedback(action: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in FEEDBACK.items() for x in kv])
    return F.coalesce(table[action], F.lit(0))


def citations(log: DataFrame, key: str) -> DataFrame:
    """``key, citation_count, positive, negative, last_at`` from a citation log with ``feedback`` and ``secs``."""
    return log.groupBy(key).agg(F.count("*").alias("citation_count"), F.count_if(F.col("feedback") > 0).alias("positive"), F.count_if(F.col("feedback") < 0).alias("negative"), F.max("secs").alias("last_at"))


def next_task(queue: DataFrame) -> DataFrame:
    """The oldest pending task with attempts left."""
    return queue.where((F.col("status") == "pending") & (F.col("attempts") < MAX_ATTEMPTS)).orderBy("created_at", "task_id").limit(1)


def after_failure(queue: DataFrame) -> DataFrame:
    """A failed attempt: back-off of 2**attempts seconds, 30 at most; the third failure is final."""
    n = F.col("attempts") + 1
    return queue.withColumns({"backoff": F.least(F.lit(30.0), F.pow(F.lit(2.0), n)).cast("long"), "status": F.when(n >= WORKER_ATTEMPTS, "failed").otherwise("pending"), "attempts": n})


@F.arrow_udf(LongType())
def _signs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The sign votes of each list of words: lists become Python's in blocks, where a distinct word is hashed once."""
    for batch in batches:
        out = np.zeros(len(batch), np.int64)
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            words = part.flatten().dictionary_encode()
            heads = np.frombuffer(b"".join(hashlib.sha256(w.encode()).digest()[7::-1] for w in words.dictionary.to_pylist()), np.uint8).reshape(-1, 8)
            bits, codes = np.unpackbits(heads, axis=1, bitorder="little"), words.indices.to_numpy(zero_copy_only=False)
            sizes = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            some = np.flatnonzero(sizes)
            if len(some):
                starts = (np.cumsum(sizes) - sizes)[some]
                votes = np.add.reduceat(bits[codes], starts, axis=0, dtype=np.int64)
                out[at + some] = np.packbits(2 * votes > sizes[some][:, None], axis=1, bitorder="little").view(np.int64).ravel()
        yield pa.array(out)


def simhash(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, simhash`` (64 bits as a long): sign votes of the words' SHA-256 heads, words counted with their repeats.

    Words are cut in the JVM; their bits are added in numpy, which on sf0.1 takes a fifth of the time of 64 folds over
    the words as expressions. A text without a word has hash 0.
    """
    return docs.select(F.col(id_col), _signs(T.normalized_tokens(F.col(text_col))).alias("simhash"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def simhash_pairs(hashes: DataFrame, id_col: str, most: int = 3) -> DataFrame:
    """``a, b, distance`` with a < b for hashes within ``most`` bits: two such hashes agree on one of ``most + 1`` bands.

    Equal hashes are one class first, so copies don't meet; pairs are between class representatives (their smallest ids).
    """
    classes = hashes.groupBy("simhash").agg(F.min(id_col).alias("rep"))
    x = classes.select("rep", "simhash", _bands("simhash", most)).select("rep", "simhash", "k.*")
    y = x.select(F.col("rep").alias("b"), F.col("simhash").alias("hb"), "band", "part")
    pairs = x.select(F.col("rep").alias("a"), F.col("simhash").alias("ha"), "band", "part").join(y, ["band", "part"]).where("a < b")
    d = hamming(F.col("ha"), F.col("hb"))
    return pairs.select("a", "b", d.cast("int").alias("distance")).where(F.col("distance") <= most).distinct()


def simhash_links(hashes: DataFrame, id_col: str, most: int = 3) -> DataFrame:
    """``a, b, distance``: the pairs of :func:`simhash_pairs`, and each other member of a class with its representative at distance 0.

    No link is lost: two rows are within ``most`` bits when they share a representative or their representatives are a
    pair, at that pair's distance. A class of n rows has n - 1 rows here, not one for each of its pairs.
    """
    known = hashes.where(F.col("simhash").isNotNull() & F.col(id_col).isNotNull())
    first = known.groupBy("simhash").agg(F.min(id_col).alias("a"))
    members = known.join(first, "simhash").where(F.col(id_col) != F.col("a"))
    same = members.select("a", F.col(id_col).alias("b"), F.lit(0).alias("distance"))
    return simhash_pairs(known, id_col, most).unionByName(same)


def cosine_class(similarity: Column) -> Column:
    return F.when(similarity >= 0.92, "duplicate").when(similarity >= 0.80, "consolidate").otherwise("novel")


def _bands(hash_: str, most: int = 3) -> Column:
    """The bands of a hash: two hashes within ``most`` bits agree on one of them."""
    width = 64 // (most + 1)
    return F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(hash_, i * width).bitwiseAND(F.lit((1 << width) - 1)).alias("part")) for i in range(most + 1)])).alias("k")


def classify_notes(new: DataFrame, kept: DataFrame) -> DataFrame:
    """``id, status, matched, similarity, stage`` of each new note (id, simhash, vector) against the kept ones (id, simhash, vector); ids are longs.

    First the smallest other kept id within three bits, whose hash shares a band; else the nearest other vector by cosine,
    searched block by block. A note is not compared with the kept one of its own id.
    """
    low = kept.where("simhash is not null").groupBy(F.col("simhash").alias("kept_hash")).agg(F.min("id").alias("first"))
    rest = kept.join(low, F.col("simhash") == F.col("kept_hash")).where(F.col("id") != F.col("first")).groupBy(F.col("kept_hash").alias("h2")).agg(F.min("id").alias("second"))
    low = low.join(rest, F.col("kept_hash") == F.col("h2"), "left").select("kept_hash", F.array("first", "second").alias("ids"))
    hashes = new.where("simhash is not null").select("simhash").distinct()
    pairs = hashes.select("simhash", _bands("simhash")).join(low.select("kept_hash", "ids", _bands("kept_hash")), "k").select("simhash", "ids", hamming(F.col("simhash"), F.col("kept_hash")).cast("int").alias("d"))
    pairs = pairs.where("d <= 3").select("simhash", F.explode("ids").alias("kept_id"), "d").where("kept_id is not null").distinct()
    near = new.select("id", "simhash").join(pairs, "simhash").where(F.col("id") != F.col("kept_id")).groupBy("id").agg(F.min(F.struct("kept_id", "d")).alias("near"))
    found = topk(new.select(F.col("id").alias("query_id"), "vector"), kept.select("id", "vector"), 2, "id", "vector").where(F.col("query_id") != F.col("vec_id"))
    best = found.groupBy(F.col("query_id").alias("id")).agg(F.min_by(F.struct("score", "vec_id"), "rank").alias("best"))
    out = new.select("id").join(near, "id", "left").join(best, "id", "left")
    stage1 = F.col("near").isNotNull()
    status = F.when(stage1, "duplicate").when(F.col("best").isNull(), "novel").otherwise(cosine_class(F.col("best.score")))
    matched = F.when(stage1, F.col("near.kept_id")).when(status != "novel", F.col("best.vec_id"))
    return out.select("id", status.alias("status"), matched.alias("matched"), F.when(stage1, 1 - F.col("near.d") / 64.0).otherwise(F.col("best.score")).alias("similarity"), F.when(stage1, "simhash").otherwise("cosine").alias("stage"))


def in_scope(memories: DataFrame, ingested: DataFrame, least: float = 0.0, words: str | None = None) -> DataFrame:
    """Local memories, and global ones that were ingested, of at least ``least`` utility and with ``words`` in their content."""
    out = memories.join(ingested.select(F.col("global_id").alias("id"), F.lit(True).alias("__in")).distinct(), "id", "left")
    keep = (F.col("scope") == "local") | F.col("__in")
    keep = keep & (F.col("utility") >= least)
    if words:
        keep = keep & F.contains(F.lower("content"), F.lit(words.lower()))
    return out.where(keep).drop("__in")


def purge_dangling(edges: DataFrame, nodes: DataFrame, node_col: str) -> DataFrame:
    """Edges whose two ends exist."""
    n = nodes.select(F.col(node_col).alias("__n")).distinct()
    return edges.join(n, F.col("src") == F.col("__n"), "left_semi").join(n, F.col("dst") == F.col("__n"), "left_semi")


def restore(current: DataFrame, backup: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` and the rows of ``backup`` whose keys it lacks."""
    return current.unionByName(backup.join(current.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def top_per_group(rows: DataFrame, groups: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*groups).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")


def every_nth(rows: DataFrame, group: str, order: list[Column], n: int = 10) -> DataFrame:
    """Every ``n``-th row of a group: where an automatic checkpoint falls."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") % n == 0).drop("__n")
