"""Mixing sources to target weights.

Each source's words form one stream, cut into blocks of fixed length. For every output shard source counts are drawn
from a multinomial over what the sources still owe; a source's j-th slot takes the block that a pseudorandom
permutation of its blocks (another one in each pass over the source) puts at j, and slots and blocks are joined by index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialize

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
BLOCK_WORDS = 256
SHARDS = 64
#: Documents in one step of the streams, and how many steps there are at least and most; steps are summed first, so no task sees a whole source.
STEP_DOCS, LEAST_STEPS, MOST_STEPS = 500, 64, 1_000_000


def targets(sizes: list[int], weights: list[int], cap: float = MAX_PASSES) -> np.ndarray:
    """Shares of the total by weight; a share over ``cap`` times its source's size stops there and the rest is shared again."""
    size, weight = np.array(sizes, dtype=float), np.array(weights, dtype=float)
    out, free = np.zeros(len(size)), size > 0
    left = size.sum()
    while free.any():
        share = left * weight * free / (weight * free).sum()
        over = free & (share > cap * size)
        if not over.any():
            out[free] = share[free]
            break
        out[over] = cap * size[over]
        left -= out[over].sum()
        free &= ~over
    return out


def _feistel(n: np.ndarray, seed: np.ndarray, index: np.ndarray, rounds: range) -> np.ndarray:
    """Four rounds of a Feistel network on the next even power of two from ``n`` on, walked until the result falls under ``n``; rounds in reverse order undo it."""
    index, n, seed = (np.asarray(x, dtype=np.uint64) for x in np.broadcast_arrays(index, n, seed))
    half = np.maximum(1, (np.frexp(np.maximum(n.astype(np.float64) - 1, 1))[1] + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)

    def walk(x: np.ndarray, half: np.ndarray, mask: np.ndarray, seed: np.ndarray) -> np.ndarray:
        a, b = x >> half, x & mask
        for r in rounds:
            back = rounds.step < 0
            h = ((a if back else b) + seed + np.uint64((r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (((h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(31)) & mask
            a, b = (b ^ h, a) if back else (b, a ^ h)
        return (a << half) | b

    out = walk(index, half, mask, seed)
    while (bad := out >= n).any():
        out[bad] = walk(out[bad], half[bad], mask[bad], seed[bad])
    return out.astype(np.int64)


def permuted(index: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The image of ``index`` under a pseudorandom permutation of range(n) chosen by ``seed``."""
    return _feistel(n, seed, index, range(0, 4, 1))


def place_of(image: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The index that :func:`permuted` maps to ``image``."""
    return _feistel(n, seed, image, range(3, -1, -1))


@dataclass
class Plan:
    """What the mix takes of each source; arrays by source. ``shard_counts`` is shards x sources and sums to ``slots``."""

    sources: list[str | None]
    sizes: np.ndarray
    targets: np.ndarray
    blocks: np.ndarray
    slots: np.ndarray
    last_words: np.ndarray
    shard_counts: np.ndarray
    seeds: np.ndarray
    block_words: int


def plan_mix(sources: list[str | None], sizes: list[int], weights: list[int], block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = 17) -> Plan:
    """Slots so that every source gives its target, rounded to whole words: the last slot takes only the start of its block."""
    size = np.array(sizes, dtype=np.int64)
    goal = targets(sizes, weights)
    blocks = -(-size // block_words)
    slots, last_words = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
    rng = np.random.default_rng(seed)
    seeds = rng.integers(1, 2**62, len(size), dtype=np.int64)
    for s in np.flatnonzero(size):
        want = min(int(round(goal[s])), MAX_PASSES * int(size[s]))
        passes, rest = divmod(want, int(size[s]))
        if not rest:
            slots[s] = passes * blocks[s]
            last_words[s] = block_words
            continue
        short_block = int(size[s] - (blocks[s] - 1) * block_words)
        # Where this pass puts the short block; up to there slots give whole blocks.
        at = int(place_of([int(blocks[s]) - 1], int(blocks[s]), int(seeds[s]) + passes)[0])
        if rest <= at * block_words:
            n = -(-rest // block_words)
            last = rest - (n - 1) * block_words
        elif rest <= at * block_words + short_block:
            n, last = at + 1, rest - at * block_words
        else:
            beyond = rest - at * block_words - short_block
            n = at + 1 + -(-beyond // block_words)
            last = beyond - (n - at - 2) * block_words
        slots[s], last_words[s] = passes * blocks[s] + n, last
    left, counts = slots.copy(), np.zeros((shards, len(size)), dtype=np.int64)
    for k in range(shards):
        room = int(left.sum()) // (shards - k)
        if room:
            drawn = np.minimum(rng.multinomial(room, left / left.sum()), left) if k < shards - 1 else left.copy()
            counts[k] = drawn
            left -= drawn
    return Plan(sources, size, goal, blocks, slots, last_words, counts, seeds, block_words)


def slot_table(docs: DataFrame, plan: Plan) -> DataFrame:
    """Every slot of the mix: ``source_no, slot, pass_no, block, words, shard``, made on the executors from the plan alone."""
    spark = docs.sparkSession
    ends, shard_ends = np.cumsum(plan.slots), np.cumsum(plan.shard_counts, axis=0)
    held = spark.sparkContext.broadcast((ends, plan.slots, plan.blocks, plan.last_words, plan.seeds, shard_ends, plan.block_words))
    total = int(plan.slots.sum())

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends, slots, blocks, last, seeds, shard_ends, block_words = held.value
        for pdf in batches:
            i = pdf["id"].to_numpy()
            s = np.searchsorted(ends, i, side="right")
            j = i - (ends[s] - slots[s])
            p = j // blocks[s]
            b = permuted(j % blocks[s], blocks[s], seeds[s] + p)
            w = np.where(j == slots[s] - 1, last[s], block_words)
            shard = np.zeros(len(i), dtype=np.int64)
            for x in np.unique(s):
                at = s == x
                shard[at] = np.searchsorted(shard_ends[:, x], j[at], side="right")
            yield pd.DataFrame({"source_no": s, "slot": j, "pass_no": p, "block": b, "words": w, "shard": shard})

    parts = max(1, min(10_000, total // 200_000 + 1))
    return spark.range(0, total, 1, parts).mapInPandas(make, "source_no long, slot long, pass_no long, block long, words long, shard long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = 17) -> tuple[DataFrame, DataFrame, Plan]:
    """``(rows, pieces, plan)`` of a mix with as many words as ``docs`` has.

    ``rows``: one per input row with ``row_id, doc_id, source, size, source_no, source_size, target, at`` (where it starts
    in its source's stream). ``pieces``: what the mix takes, ``row_id, doc_id, size, shard, slot, pass_no, first, taken``
    (words ``first .. first + taken`` of the row).
    A null text has size 0 and is never taken; null is a source of its own, last in order, and weights repeat over the
    sources by code point. Repeated rows are separate rows. An empty input, or one without a word, gives an empty mix.
    Streams are ordered by a hash of id and text, then id, size and text hash, so that reruns agree and no step holds all
    rows of a null or repeated id. The plan holds one entry for each source on the driver, nothing for documents.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    base = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(F.col(text_col)).alias("th")), "sizes").withColumn("h", F.xxhash64("doc_id", "th", F.lit(seed)))
    steps = min(MOST_STEPS, max(LEAST_STEPS, base.count() // STEP_DOCS))
    base = base.withColumn("step", F.pmod("h", F.lit(steps)))
    by_source = base.groupBy("source").agg(F.sum("size").alias("n")).collect()
    by_source.sort(key=lambda r: (r[0] is None, r[0] or ""))
    plan = plan_mix([r[0] for r in by_source], [r[1] for r in by_source], [weights[i % len(weights)] for i in range(len(by_source))], block_words, shards, seed)
    facts = docs.sparkSession.createDataFrame(
        [(s, i, int(plan.sizes[i]), float(plan.targets[i])) for i, s in enumerate(plan.sources)], "source string, source_no long, source_size long, target double"
    )
    sums = base.groupBy("source", "step").agg(F.sum("size").alias("n"))
    before = sums.select("source", "step", (F.sum("n").over(Window.partitionBy("source").orderBy("step")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("source", "step").orderBy("h", "doc_id", "size", "th")
    rows = base.withColumns({"upto": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "nth": F.row_number().over(inside)})
    rows = rows.join(before.withColumnsRenamed({"source": "s2", "step": "t2"}), F.col("source").eqNullSafe(F.col("s2")) & (F.col("step") == F.col("t2")))
    rows = rows.join(F.broadcast(facts.withColumnRenamed("source", "s3")), F.col("source").eqNullSafe(F.col("s3")))
    rows = rows.select(
        F.concat_ws(":", "source_no", "step", "nth").alias("row_id"), "doc_id", "source", "th", "size", "source_no", "source_size", "target", (F.col("before") + F.col("upto") - F.col("size")).alias("at")
    )
    rows = materialize(rows, "streams")
    b = F.lit(block_words).cast("long")
    span = F.sequence(F.expr(f"at div {block_words}"), F.expr(f"(at + size - 1) div {block_words}"))
    cut = rows.where("size > 0").select("row_id", "doc_id", "size", "source_no", "at", F.explode(span).alias("block"))
    start = F.greatest(F.col("at"), F.col("block") * b)
    cut = cut.select("row_id", "doc_id", "size", "source_no", "block", (start - F.col("block") * b).alias("offset"), (start - F.col("at")).alias("first"), (F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * b) - start).alias("n"))
    taken = F.greatest(F.lit(0).cast("long"), F.least("n", F.col("words") - F.col("offset")))
    pieces = cut.join(slot_table(docs, plan), ["source_no", "block"]).select("row_id", "doc_id", "size", "shard", "slot", "pass_no", "first", taken.alias("taken")).where("taken > 0")
    return rows, pieces, plan


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix as documents: a row of ``docs`` for each pass that takes words of it, its text cut to those words.

    A text that is taken whole stays as it is; of another, the words taken are joined by one space, in order. Where the
    input has ``n_chars`` it is set anew. Rows that repeat an id are told apart by text and source,
    those that repeat these too by order; a null text, or one without a word, is never in the mix; an empty input gives none.
    """
    rows, pieces, _ = mix(docs, id_col, text_col, source_col, **options)
    key = ["doc_id", "th", "source"]
    named = F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(source_col).cast("string").alias("source"))
    whole = docs.select(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("order"), named.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    names = rows.select("row_id", F.struct(*key).alias("name"))
    if rows.groupBy(*key).count().where("count > 1").isEmpty():
        whole, names = whole.withColumn("copy", F.lit(1)), names.withColumn("nth", F.lit(1))
    else:  # rows that repeat id, text and source are matched in order; any match gives the same texts
        whole = whole.withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy("order")))
        names = names.withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy("row_id")))
    parts = pieces.groupBy("row_id", "doc_id", "size", "pass_no").agg(F.sum("taken").alias("all"), F.sort_array(F.collect_list(F.struct("first", "taken"))).alias("parts"))
    per_row = parts.groupBy("row_id").agg(F.collect_list(F.struct("all", "size", "pass_no", "parts")).alias("takes")).join(names, "row_id")
    joined = whole.join(per_row.hint("shuffle_hash"), F.col("key").eqNullSafe(F.col("name")) & (F.col("copy") == F.col("nth")))
    take = F.explode("takes").alias("take")
    text = F.col(f"row.`{text_col}`")
    words = F.regexp_extract_all(text, F.lit(f"({WORD_PATTERN})"), F.lit(1))
    some = F.array_join(F.flatten(F.transform("take.parts", lambda p: F.slice(F.col("words"), (p["first"] + 1).cast("int"), p["taken"].cast("int")))), " ")
    out = joined.select("row", take).withColumn("words", F.when(F.col("take.all") < F.col("take.size"), words))
    out = out.withColumn("text", F.when(F.col("take.all") < F.col("take.size"), some).otherwise(text))
    new = {text_col: F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op2_rows(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken``."""
    rows, pieces, _ = mix(docs, **options)
    took = pieces.groupBy("row_id").agg(F.sum("taken").alias("taken"))
    return rows.join(took, "row_id", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
