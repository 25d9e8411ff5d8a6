"""Exact de-duplication by two-pass Bloom filtering, in DataFrame operations only.

Pass one sets two bits per row hash in one 64-bit word of a Bloom filter. Each task builds its part of the filter where
its rows are, and bitwise aggregates merge the parts into the bits that were set more than once; only words of the filter
travel. Pass two tests every row: a row with a bit of its own is unique and passes straight through; only the other rows
are grouped and joined, as ids and hashes without their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A filter of at most this many words of 64 bits is broadcast (16 bytes a row); a larger one is joined by shuffle.
BROADCAST_WORDS = 1_000_000
#: Rows to drop (an id and a hash each) that are broadcast at most; more are joined by shuffle.
BROADCAST_LOSERS = 200_000
#: Groups of more than 1/HOT_SHARE of all rows are joined by broadcast; there are fewer than HOT_SHARE of them.
HOT_SHARE = 10_000
HOT_LEAST = 256


def normalised(text: str) -> Column:
    """Null as empty; A-Z lower-cased and nothing else. ASCII texts take the byte-wise path."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def _placed(df: DataFrame, words: int) -> DataFrame:
    """``df`` with the ``word`` of the filter that a row's hash falls in, and its bits there."""
    h = F.xxhash64(F.col("sha"), F.lit(1))
    bit = lambda by: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, by).bitwiseAND(F.lit(63)).cast("int"))
    return df.withColumns({"word": F.pmod(F.xxhash64(F.col("sha")), F.lit(words).cast("long")), "mask": bit(0).bitwiseOR(bit(6))})


def _filter_words(base: DataFrame, words: int) -> DataFrame:
    """The filter's bits that two or more rows set: ``word, bits``.

    Of a word's bits those set an even number of times are known from the difference of OR and XOR. Where the number of
    settings says that some bit was set three times or more, all bits of the word count, which can only add candidates.
    """
    merged = _placed(base, words).groupBy("word").agg(F.bit_or("mask").alias("any"), F.bit_xor("mask").alias("odd"), F.sum(F.bit_count("mask")).alias("n"))
    even = F.col("any").bitwiseAND(F.bitwise_not("odd"))
    bits = F.when(F.col("n") - F.bit_count("any") == F.bit_count(even), even).otherwise(F.col("any"))
    return merged.select("word", bits.alias("bits")).where("bits != 0")


def _tested(rows: DataFrame, filter_: DataFrame, words: int) -> DataFrame:
    """``rows`` with ``maybe``: false proves that the row's hash occurs once."""
    w = filter_.withColumnRenamed("word", "w")
    w = F.broadcast(w) if filter_.count() <= BROADCAST_WORDS else w
    out = _placed(rows, words).join(w, F.col("word") == F.col("w"), "left")
    return out.withColumn("maybe", F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False))).drop("word", "mask", "w", "bits")


def _hashed(docs: DataFrame, id_col: str, text_col: str, bits_per_row: int) -> tuple[DataFrame, int]:
    """``id, sha, maybe`` of every row, and how many rows there are."""
    base = materialize(docs.select(F.col(id_col).alias("id"), F.sha2(normalised(text_col), 256).alias("sha")), "sha")
    n = base.count()
    words = max(16, bits_per_row * n // 64)
    return _tested(base, materialize(_filter_words(base, words), "bloom"), words), n


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 32) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Rows are equal when their texts are equal after lower-casing A-Z; a null text is an empty one. Of equal rows the
    largest id stays. Rows that repeat an id as well as the text count in ``group_size`` and share ``kept``; a null id
    loses against any other and is its own ``keep_id`` where the whole group has null ids. An empty input gives an
    empty result; other columns are not read, whatever their names.
    """
    rows, n = _hashed(docs, id_col, text_col, bits_per_row)
    once = rows.where(~F.col("maybe")).select("id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("size"))
    again = rows.where("maybe").select("id", "sha")
    groups = materialize(again.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count("*").alias("size")).where("size > 1"), "groups")
    least = max(HOT_LEAST, n // HOT_SHARE)
    hot, cold = groups.where(F.col("size") > least), groups.where(F.col("size") <= least)
    in_hot = again.join(F.broadcast(hot), "sha")
    in_cold = again.join(F.broadcast(hot.select("sha")), "sha", "left_anti").join(cold, "sha", "left")
    in_cold = in_cold.select("id", "sha", F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("size", F.lit(1)).alias("size"))
    return once.unionByName(in_hot.select("id", "sha", "keep_id", "size")).unionByName(in_cold).select(
        F.col("id").alias("doc_id"), "keep_id", F.col("size").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 32) -> DataFrame:
    """``docs`` without exact copies, all columns kept; texts do not move while the rows to drop fit a broadcast, else once.

    Of rows that repeat id and text one stays. A row travels as one struct, so column names cannot clash.
    """
    rows, n = _hashed(docs, id_col, text_col, bits_per_row)
    again = materialize(rows.where("maybe").groupBy("sha", "id").agg(F.count("*").alias("n")), "again")
    winners = materialize(again.groupBy("sha").agg(F.max("id").alias("keep_id"), F.sum("n").alias("size")).where("size > 1"), "winners")
    held = join_skewed(again, winners, ["sha"], F.col("size") > max(HOT_LEAST, n // HOT_SHARE))
    held = materialize(held.withColumn("wins", F.col("id").eqNullSafe(F.col("keep_id"))).where("n > 1 or not wins").select("id", "sha", "wins"), "held")
    same = F.col("__ls_id").eqNullSafe(F.col("id")) & (F.col("__ls_sha") == F.col("sha"))
    whole = docs.select(F.col(id_col).alias("__ls_id"), F.sha2(normalised(text_col), 256).alias("__ls_sha"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__ls_row"))
    keys = held.select("id", "sha")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_LOSERS else keys.hint("shuffle_hash")
    out = whole.join(keys, same, "left_anti").select("__ls_row")
    twins = held.where("wins").select("id", "sha")  # winners that repeat their id: one of them stays
    if not twins.isEmpty():
        out = out.unionByName(whole.join(twins, same, "left_semi").dropDuplicates(["__ls_id", "__ls_sha"]).select("__ls_row"))
    return out.select("__ls_row.*")
