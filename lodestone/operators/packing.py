"""Filling a token budget with ranked items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least room for a truncated item.
LEAST_CUT = 30


def greedy(items: DataFrame, budget: Column, least_cut: int = LEAST_CUT) -> DataFrame:
    """``query_id, item, mode, tokens, used`` of each query's items, in rank order.

    An item is taken whole if it fits; else folded if that fits; else cut to the room left if that is ``least_cut`` or
    more; else skipped, and the next is tried. Nothing follows once the budget is full. ``items`` has ``query_id, rank,
    item, full_tokens, folded_tokens``; a query's candidates are one bounded list (the search's limit), so the state runs
    through it as a fold inside one row.
    """
    lists = items.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "item", "full_tokens", "folded_tokens"))).alias("all"))
    b = budget.cast("long")
    chosen = "array<struct<item:%s,mode:string,tokens:bigint,used:bigint>>" % dict(items.dtypes)["item"]

    def step(acc: Column, x: Column) -> Column:
        room = b - acc["used"]
        mode = F.when(room <= 0, "stop").when(x["full_tokens"] <= room, "full").when(x["folded_tokens"] <= room, "folded").when(room >= least_cut, "cut").otherwise("skip")
        tokens = F.when(mode == "full", x["full_tokens"]).when(mode == "folded", x["folded_tokens"]).when(mode == "cut", room).otherwise(0).cast("bigint")
        used = acc["used"] + tokens
        add = F.array(F.struct(x["item"].alias("item"), mode.alias("mode"), tokens.alias("tokens"), used.alias("used")))
        return F.struct(used.alias("used"), F.when(tokens > 0, F.concat(acc["out"], add)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast(chosen).alias("out"))
    return lists.select("query_id", F.explode(F.aggregate("all", start, step, lambda acc: acc["out"])).alias("x")).select("query_id", "x.*")


def accounting(raw: Column, packed: Column) -> Column:
    """Tokens saved in percent, 0 at least."""
    return F.when(raw > 0, F.round(F.greatest(F.lit(0.0), (raw - packed) / raw * 100.0), 2)).otherwise(F.lit(0.0))
