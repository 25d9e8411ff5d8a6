"""The corpus pipeline: language ID, exact de-duplication, near-duplicate join, mixing and packing of documents.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; all but the last return the
columns of ``documents``. Nulls, empty texts and repeated rows follow the operators' docstrings; an empty input passes
through every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup, language_id, mixing, ngram_join, packing
from lodestone.llm.common import materialize
from lodestone.llm.queries import vocabulary
from lodestone.storage import discard, keep, scope

#: A document goes when no language is determined, or none with at least this posterior.
LEAST_POSTERIOR = 0.5
#: Rows to drop (16 bytes each) that are broadcast at most; more are joined by shuffle.
BROADCAST_IDS = 500_000


def _whole(docs: DataFrame) -> Column:
    """A row as one struct: whatever the names of its columns, they clash with none."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the labelled documents teach; a text that is null or has no letter goes.

    Where no document has a label nothing can be rejected but texts without a letter.
    """
    model = language_id.train(docs)
    if not model[0]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows = docs.select(F.col("text").alias("text"), _whole(docs))
    known = language_id.identify(rows, model, keep=["row"])
    return known.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_POSTERIOR)).select("row.*")


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the document with the largest id."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates keep the document with the smallest id; of those that share it, one text stays."""
    gone = materialize(ngram_join.near_losers(docs).select(F.col("id").alias("__gone"), F.col("th").alias("__hash")), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone.hint("shuffle_hash")
    rows = docs.select(F.col("doc_id").alias("__id"), ngram_join.text_hash(F.col("text")).alias("__th"), _whole(docs))
    return rows.join(gone, F.col("__id").eqNullSafe(F.col("__gone")) & (F.col("__th") == F.col("__hash")), "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each pass that takes words of a document, its text cut to the words taken.

    Documents without a word are in no mix; null is a source of its own; columns beside the text and ``n_chars`` are kept as they are.
    """
    return mixing.mixed_texts(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, a row for each piece of a document; a document mixed in twice is two documents here.

    A null or empty text is its end id alone; null and repeated ids are rows like any other; other columns are not read.
    """
    out = packing.pack(docs, vocabulary())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact),
    ("ngram_join", drop_near),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Naive Bayes, the near-duplicate join, the drawn mix and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. A stage's scratch tables go when its result is written, and that when the next one's is; the last stage is left to the caller."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scope(spark):
            docs = keep(materialize(stage(spark, docs, sf_dir), f"stage-{name}"))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
