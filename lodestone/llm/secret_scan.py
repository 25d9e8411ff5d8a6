"""Secret scans over an incremental ledger of blobs, in DataFrame operations only.

Every version of a text is addressed by its SHA-256. The ledger holds the findings of each (blob, rule version) pair
scanned so far; a scan reads only blobs that have no entry under the rules in force, adds their findings, and joins the
ledger back to every row (path, version) that carries a blob.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HEAVY_LEAST, HEAVY_NODES, materialize, scratch_path
from .spans import all_matches, count_of, placed, tagged, written

# Kinds in the order of the output, and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
ASSIGN_LEAST = 8
#: Changes with every change of the rules; entries of other versions are not read.
RULE_VERSION = "1"
LEDGER = "blob string, rule_version string, spans array<struct<start:bigint,`order`:int,end:bigint,kind:string>>"


def find_secrets(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with ``spans``: each kind's leftmost non-overlapping matches, failing ones dropped."""
    df = df.withColumn("__text", text)
    t = F.col("__text")
    df = df.withColumns({"__a": all_matches(t, ASSIGN), "__b": all_matches(t, ACCESS), "__c": all_matches(t, HEX)})
    value = F.when(F.size("__a") > 0, all_matches(t, ASSIGN, 2)).otherwise(F.array().cast("array<string>"))
    assign = F.filter(F.arrays_zip(placed(t, ASSIGN, F.col("__a")).alias("s"), value.alias("v")), lambda x: F.length(x["v"]) >= ASSIGN_LEAST)
    spans = F.concat(
        tagged(F.transform(assign, lambda x: x["s"]), "assign", 0),
        tagged(placed(t, ACCESS, F.col("__b")), "access", 1),
        tagged(placed(t, HEX, F.col("__c")), "hex", 2),
    )
    return df.withColumn("spans", spans).drop("__text", "__a", "__b", "__c")


def scan(docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text", rule_version: str = RULE_VERSION, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``doc_id``, the columns ``keep`` (path and version, say), ``blob, spans``; grows the ledger at path ``ledger`` (by default a new one in the shared folder).

    A null text is an empty one and has no finding. Rows that repeat a text, or id and text, share one ledger entry.
    An empty input gives an empty result and adds nothing. Only the id, text and kept columns are read.
    """
    spark = docs.sparkSession
    ledger = ledger or scratch_path(spark, "ledger")
    rows = docs.select(F.col(id_col).alias("id"), F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`") for c in keep]).alias("kept"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger)
    seen = spark.read.schema(LEDGER).parquet(ledger).where(F.col("rule_version") == rule_version)
    # One row stands for a blob; blob and id together are a key without heavy values.
    blobs = materialize(rows.groupBy("blob").agg(F.min("id").alias("rep"), F.count("*").alias("rows")), "blobs")
    unseen = blobs.select("blob", "rep").join(seen.select("blob"), "blob", "left_anti").withColumnRenamed("blob", "b2")
    todo = rows.join(unseen.hint("shuffle_hash"), (F.col("blob") == F.col("b2")) & F.col("id").eqNullSafe(F.col("rep")), "left_semi")
    found = find_secrets(todo, F.col("text")).select("blob", F.lit(rule_version).alias("rule_version"), "spans")
    found.write.mode("append").parquet(ledger)
    # An id repeated with its text is scanned twice; the ledger is read as distinct entries.
    entries = spark.read.schema(LEDGER).parquet(ledger).where((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select("blob", "spans").dropDuplicates(["blob"])
    # Blobs without findings, and those of many rows (a bounded number), need no shuffle of their rows.
    least = max(HEAVY_LEAST, (blobs.agg(F.sum("rows")).first()[0] or 0) // HEAVY_NODES)
    heavy = F.broadcast(entries.join(blobs.where(F.col("rows") > least).select("blob"), "blob"))
    places = rows.select("id", "kept", "blob")
    cold = places.join(heavy.select("blob"), "blob", "left_anti").join(entries, "blob", "left")
    out = places.join(heavy, "blob").unionByName(cold)
    empty = F.array().cast("array<struct<start:bigint,`order`:int,end:bigint,kind:string>>")
    return out.select(F.col("id").alias("doc_id"), *[F.col(f"kept.`{c}`") for c in keep], "blob", F.coalesce("spans", empty).alias("spans"))


def op4_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans``; the ledger adds no spans to the base ones."""
    out = scan(docs).withColumn("written", written(F.col("spans")))
    counts = [count_of(F.col("spans"), k).alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2("written", 256).alias("base_sha256"), F.col("written").alias("spans"))
