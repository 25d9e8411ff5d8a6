"""Rank fusion: weighted reciprocal ranks with graph, name and test signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as T

K = 60


def weights_table(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{k}', {a}D, {b}D, {c}D, {d}D)" for k, (a, b, c, d) in C.INTENT_WEIGHTS.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(intent, w_lex, w_sem, w_struct, w_hub)")


def fuse(candidates: DataFrame, queries: DataFrame, hubs: DataFrame) -> DataFrame:
    """``query_id, symbol_id, score``: candidates scored and boosted.

    ``candidates``: ``query_id, symbol_id, name, path, lexical_rank, semantic_rank, distance, is_target`` (ranks from 0 and
    distance null where a source did not find it). ``queries``: ``query_id, query, intent``. ``hubs``: ``symbol_id, hub_rank,
    pagerank``. The highest name boost that applies counts alone; tests count half unless the query asks for them.
    """
    q = queries.select("query_id", "query", "intent").join(F.broadcast(weights_table(candidates.sparkSession)), "intent")  # eight rows
    ws = F.filter(F.split("query", r"\s+"), lambda w: F.length(w) >= 2)
    q = q.withColumns({
        "q_sub": F.array_distinct(F.concat(T.subtokens(F.col("query")), F.flatten(F.transform(F.split("query", r"\s+"), T.tokenize_identifier)))),
        "q_norm": F.transform(ws, T.normalize_name), "q_words": F.transform(ws, F.lower), "q_test": C.asks_for_tests(F.col("query")),
    })
    c = candidates.join(q, "query_id").join(hubs, "symbol_id", "left")
    part = lambda w, d: F.coalesce(F.col(w) / d, F.lit(0.0))
    score = part("w_lex", K + F.col("lexical_rank")) + part("w_sem", K + F.col("semantic_rank")) + part("w_struct", K + 100 + F.col("distance")) + part("w_hub", K + F.col("hub_rank"))
    score = score + F.least(F.coalesce("pagerank", F.lit(0.0)) * 0.1, F.lit(0.05))
    norm = T.normalize_name(F.col("name"))
    sub = F.array_distinct(F.concat(T.subtokens(F.col("name")), T.tokenize_identifier(F.col("name"))))
    c = c.withColumns({"__norm": norm, "__sub": sub})
    boost = (
        F.when(F.col("is_target"), 0.50).when((F.col("__norm") != "") & F.array_contains("q_norm", F.col("__norm")), 0.20)
        .when((F.size("__sub") > 0) & (F.size(F.array_except("__sub", "q_sub")) == 0), 0.15).when(F.arrays_overlap("__sub", "q_sub"), 0.08)
        .when(F.exists("q_words", lambda w: F.contains(F.lower(F.col("name")), w)), 0.05).otherwise(0.0)
    )
    damp = F.when(C.is_test(F.col("path"), F.col("name")) & ~F.col("q_test"), 0.5).otherwise(1.0)
    return c.select("query_id", "symbol_id", ((score + boost) * damp).alias("score"))


def merge_candidates(lexical: DataFrame, semantic: DataFrame, structural: DataFrame) -> DataFrame:
    """Full outer merge of three candidate lists by query and symbol; the first source names the reason, later ones are appended."""
    keys = ["query_id", "symbol_id"]
    out = lexical.select(*keys, "lexical_rank").join(semantic.select(*keys, "semantic_rank"), keys, "full_outer").join(structural.select(*keys, "distance"), keys, "full_outer")
    reason = F.concat_ws("+", F.when(F.col("lexical_rank").isNotNull(), "lexical"), F.when(F.col("semantic_rank").isNotNull(), "semantic"), F.when(F.col("lexical_rank").isNull() & F.col("semantic_rank").isNull(), "structural"))
    # A symbol that text search found does not count its distance.
    own = F.when(F.col("lexical_rank").isNull() & F.col("semantic_rank").isNull(), F.col("distance"))
    return out.withColumns({"reason": reason, "distance": own})


def honest_empty(ranked: DataFrame, queries: DataFrame, threshold: float = 0.005, names: int = 5) -> DataFrame:
    """``query_id, empty, suggestions``: empty where nothing was found, the best score is under ``threshold``, or no hit came from text, vectors or a trace."""
    by = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "symbol_id", "name")))
    found = ranked.groupBy("query_id").agg(F.max("score").alias("best"), F.max((F.col("reason") != "structural").cast("int")).alias("real"), by.alias("all"))
    found = found.withColumn("suggestions", F.array_join(F.transform(F.slice("all", 1, names), lambda x: x["name"]), ","))
    out = queries.select("query_id").distinct().join(found, "query_id", "left")
    empty = F.coalesce((F.col("best") < threshold) | (F.col("real") == 0), F.lit(True))
    return out.select("query_id", empty.alias("empty"), F.coalesce("suggestions", F.lit("")).alias("suggestions"))
