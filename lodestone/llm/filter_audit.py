"""What five filters do to a corpus in every order, from one aggregation: a Walsh-Hadamard audit.

A document is a mask of the filters it fails. For each part and label the corpus is reduced to 32 signed parity sums, one
for each set S of filters: documents count +1 or -1 by whether they fail an even or odd number of S. The transform is its
own inverse up to the factor 32, so the exact number of documents of each mask (a cell) comes back, and every order, step
and Shapley value is a sum over cells; the documents are not read again. DataFrame operations only.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialize

#: Filters in the order of their bits.
FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
# The filters' bounds and characters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 50, 65, 5, "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Texts of more than 1/HOT_SHARE of all rows are joined by broadcast; there are fewer than HOT_SHARE of them.
HOT_SHARE, HOT_LEAST = 10_000, 256


def _bit(fails: Column, name: str) -> Column:
    return F.when(fails, F.lit(1 << FILTERS.index(name))).otherwise(F.lit(0))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, good, toxic, mask`` of every document.

    A null text is empty, a null source the part ``''``. E asks for a smaller id with the same text anywhere in the table:
    of rows that share the smallest id none fails, and a null id neither fails nor makes others fail. A document is good or
    toxic if any label row of its id says so; other label values, nulls and ids without a document count for nothing.
    Only ids, hashes and masks move; texts stay. Other columns are not read.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("part"), t.alias("t"), F.regexp_extract_all(t, F.lit(WORD_PATTERN), F.lit(0)).alias("w"))
    sized = read.select("id", "part", "t", F.size("w").alias("n"), F.size(F.array_distinct("w")).alias("d"))
    capitals = F.length("t") - F.length(F.translate("t", CAPITALS, ""))
    own = _bit(F.col("n") < LEAST_WORDS, "A") + _bit(100 * F.col("d") < LEAST_DISTINCT * F.col("n"), "B") + _bit(100 * capitals > MOST_CAPITALS * F.length("t"), "C") + _bit(F.col("t").rlike(MARKS), "D")
    rows = materialize(sized.select("id", "part", own.alias("own"), F.sha2("t", 256).alias("sha")), "masks")
    least = max(HOT_LEAST, rows.count() // HOT_SHARE)
    same = materialize(rows.groupBy("sha").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("size")).where("first < last"), "same")
    hot = F.broadcast(same.where(F.col("size") > least).select("sha", "first"))
    cold = rows.join(hot.select("sha"), "sha", "left_anti").join(same.where(F.col("size") <= least).select("sha", "first"), "sha", "left")
    told = cold.select("id", "part", "own", "first").unionByName(rows.join(hot, "sha").select("id", "part", "own", "first"))
    told = told.select("id", "part", (F.col("own") + _bit(F.coalesce(F.col("id") > F.col("first"), F.lit(False)), "E")).alias("mask"))
    said = labels.where("quality = 1 or toxic = 1").groupBy(F.col("doc_id").alias("label_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    return told.join(said, F.col("id") == F.col("label_id"), "left").select("part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "mask")


def _sign(a: Column, b: Column) -> Column:
    """+1 or -1: the parity of the filters that two sets share."""
    return 1 - 2 * F.bit_count(a.bitwiseAND(b)).bitwiseAND(F.lit(1))


def parities(rows: DataFrame) -> DataFrame:
    """``part, good, toxic, w``: the 32 signed parity sums of each part and label, pre-aggregated by every task."""
    sums = [F.sum(_sign(F.col("mask"), F.lit(s))).alias(f"w{s}") for s in range(MASKS)]
    return rows.groupBy("part", "good", "toxic").agg(*sums).select("part", "good", "toxic", F.array(*[f"w{s}" for s in range(MASKS)]).alias("w"))


def cells(sums: DataFrame) -> DataFrame:
    """``part, every, good, toxic``: for each part the number of documents of each mask, of all and of either label.

    The transform is linear, so the labels' sums are added before they are inverted; the division by 32 leaves no rest.
    """
    of = lambda s, keep: F.sum(F.when(keep, F.get("w", F.lit(s))).otherwise(F.lit(0)))
    kinds = {"every": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    added = sums.groupBy("part").agg(*[of(s, keep).alias(f"{kind}_{s}") for kind, keep in kinds.items() for s in range(MASKS)])
    packed = added.select("part", *[F.array(*[f"{kind}_{s}" for s in range(MASKS)]).alias(kind) for kind in kinds])
    index = F.sequence(F.lit(0), F.lit(MASKS - 1))
    cell = lambda w: F.transform(index, lambda m: F.shiftright(F.aggregate(index, F.lit(0).cast("long"), lambda a, s: a + F.get(w, s) * _sign(m, s)), 5))
    return packed.select("part", *[cell(F.col(kind)).alias(kind) for kind in kinds])


def orders(counts: DataFrame) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`` from the cells: 600 rows a part."""
    every = F.lit(["".join(p) for p in permutations(FILTERS)])
    steps = counts.withColumn("filter_order", F.explode(every)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = lambda letters: sum((F.when(F.contains(letters, F.lit(x)), F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(FILTERS)), F.lit(0))
    steps = steps.withColumns({"own": bits(F.substr("filter_order", F.col("step"), F.lit(1))), "before": bits(F.substr("filter_order", F.lit(1), F.col("step") - 1))})
    index, own, before = F.sequence(F.lit(0), F.lit(MASKS - 1)), F.col("own"), F.col("before")
    total = lambda kind, holds, times=lambda m: F.lit(1): F.aggregate(index, F.lit(0).cast("long"), lambda a, m: a + F.when(holds(m), F.get(F.col(kind), m) * times(m)).otherwise(F.lit(0)))
    fails, passed = (lambda m: m.bitwiseAND(own) != 0), (lambda m: m.bitwiseAND(before) == 0)
    removed = lambda m: fails(m) & passed(m)
    return steps.select(
        "part", "filter_order", "step", total("every", lambda m: ~fails(m) & passed(m)).alias("kept"), total("every", removed).alias("removed"), total("every", lambda m: fails(m) & ~passed(m)).alias("redundant"), total("every", lambda m: m == own).alias("unique_fails"),
        # A document that fails f filters is removed by each of them in 120 / f of the orders.
        total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"), total("every", fails, lambda m: (F.lit(120) / F.greatest(F.bit_count(m), F.lit(1))).cast("int")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order and step; :func:`masks` states nulls, repeats and ties, an empty table gives no rows."""
    return orders(cells(parities(masks(docs, labels))))
