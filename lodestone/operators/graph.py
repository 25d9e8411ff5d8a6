"""Graph operators over edge tables: neighbourhoods, degrees, personalised PageRank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..storage import materialize

# Other names of the directions.
DIRECTIONS = {"downstream": "down", "callees": "down", "outgoing": "down", "children": "down", "upstream": "up", "callers": "up", "incoming": "up", "parents": "up"}
#: Iterations of PageRank in one job.
LEVELS = 4
#: A source is heavy from more than so many edges on, and more than this share of all; there are fewer than HEAVY_SHARE of them.
HEAVY_LEAST, HEAVY_SHARE = 10_000, 2_000


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    direction = DIRECTIONS.get(direction, direction)
    down, up = edges.select("src", "dst"), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if direction not in ("down", "up", "both"):
        raise ValueError(f"no direction {direction}")
    return (down if direction == "down" else up if direction == "up" else down.unionByName(up)).distinct()


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int = 2, direction: str = "down") -> DataFrame:
    """``seed, node, distance`` of all nodes within ``depth`` steps of each seed, the seed itself at 0.

    Breadth first: each hop joins the frontier alone to the edges and drops what was reached before; all seeds move in
    one plan. ``seeds`` has a column ``seed``.
    """
    moves = oriented(edges, direction)
    frontier = seeds.select("seed", F.col("seed").alias("node")).distinct()
    reached = frontier.withColumn("distance", F.lit(0))
    for hop in range(1, depth + 1):
        step = frontier.join(moves, frontier["node"] == moves["src"]).select("seed", F.col("dst").alias("node")).distinct()
        frontier = step.join(reached.select("seed", "node"), ["seed", "node"], "left_anti")
        if hop < depth:
            frontier = materialize(frontier, "frontier")
        reached = reached.unionByName(frontier.withColumn("distance", F.lit(hop)))
    return reached


def nearest(reached: DataFrame, limit: int = 50) -> DataFrame:
    """A neighbourhood cut to the ``limit`` nearest nodes of each seed, by distance then node."""
    from pyspark.sql import Window

    w = Window.partitionBy("seed").orderBy("distance", "node")
    return reached.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("rank")


def degrees(edges: DataFrame) -> DataFrame:
    """``node, out_degree, in_degree, dangling`` in one pass over the edges and one shuffle."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")
    return edges.select(ends).groupBy("e.node").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree")).withColumn("dangling", F.col("out_degree") == 0)


def pagerank(edges: DataFrame, personal: DataFrame | None = None, damping: float = 0.85, iterations: int = 20) -> DataFrame:
    """``node, rank``: power iteration from the personalisation vector, to which dangling nodes hand their rank back.

    ``personal`` has a column ``node``; without it, or if none of its nodes has an edge, the vector is uniform. Repeated
    edges count repeatedly; an empty table gives an empty result.

    With p the vector and M the step along edges, the iterates are sums of p, Mp, MMp, ... whose factors depend only on how
    much of each of these levels stands on dangling nodes. So the levels are walked without a global sum in between: one
    join by source and one pre-aggregated sum by target each, ``LEVELS`` of them in a job, and none once a level is empty.
    Sources with very many edges are joined by broadcast, so their edges stay where they are.
    """
    links = materialize(edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")), "links")
    ends = degrees(links)
    if personal is None:
        ends = ends.withColumn("chosen", F.lit(True))
    else:
        mark = personal.select(F.col("node").cast("string").alias("node")).distinct().withColumn("chosen", F.lit(True))
        ends = ends.join(mark, "node", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    nodes = materialize(ends.select("node", F.col("out_degree").alias("out"), "chosen"), "nodes")
    n, chosen, n_edges, most = nodes.agg(F.count("*"), F.count_if("chosen"), F.coalesce(F.sum("out"), F.lit(0)), F.max("out")).first()
    least = max(HEAVY_LEAST, n_edges // HEAVY_SHARE)
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    start = (nodes.where("chosen") if chosen else nodes).select("node", F.lit(1.0 / (chosen or n)).alias("v"), F.lit(0).alias("level"))
    weights = nodes.where("out > 0").select(F.col("node").alias("src"), (1.0 / F.col("out")).alias("w"), (F.col("out") > least).alias("heavy"))
    weighted = materialize(links.join(weights, "src"), "weighted")
    heavy = weighted.where("heavy").select("src", "dst", "w") if most > least else None
    light = weighted.where("not heavy").select("src", "dst", "w")
    levels = [start]
    for first in range(1, iterations + 1, LEVELS):
        level, batch = levels[-1].where(F.col("level") == first - 1), None
        for k in range(first, min(first + LEVELS, iterations + 1)):
            level = _step(level, light, heavy).withColumn("level", F.lit(k))
            batch = level if batch is None else batch.unionByName(level)
        seen = Observation()
        levels.append(materialize(batch.observe(seen, F.max("level").alias("last")), "levels"))
        if seen.get["last"] != k:  # no node has anything left to give
            break
    every = reduce(DataFrame.unionByName, levels)
    lost = dict(every.join(nodes.where("out = 0").select("node"), "node", "left_semi").groupBy("level").agg(F.sum("v")).collect())  # a row for each level
    factors = _factors([lost.get(k, 0.0) for k in range(iterations + 1)], damping)
    factor = F.element_at(F.lit(factors), F.col("level") + 1)
    ranks = every.groupBy("node").agg(F.sum(F.col("v") * factor).alias("rank"))
    return nodes.select("node").join(ranks, "node", "left").select("node", F.coalesce("rank", F.lit(0.0)).alias("rank"))


def _step(level: DataFrame, light: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """The next level: what every node gets along its incoming edges."""
    v = level.select(F.col("node").alias("src"), "v")
    given = light.join(v, "src").select("dst", (F.col("v") * F.col("w")).alias("v"))
    if heavy is not None:
        some = v.join(F.broadcast(heavy.select("src").distinct()), "src", "left_semi")
        given = given.unionByName(heavy.join(F.broadcast(some), "src").select("dst", (F.col("v") * F.col("w")).alias("v")))
    return given.groupBy(F.col("dst").alias("node")).agg(F.sum("v").alias("v"))


def _factors(lost: list[float], damping: float) -> list[float]:
    """The factor of each level in the last iterate, from the share of each level that stands on dangling nodes."""
    given: list[float] = []  # what the personalisation vector gets in each iteration
    of = lambda t: [given[t - 1 - j] * damping**j for j in range(t)] + [damping**t]
    for t in range(len(lost) - 1):
        given.append(1 - damping + damping * sum(f * x for f, x in zip(of(t), lost)))
    return of(len(lost) - 1)
