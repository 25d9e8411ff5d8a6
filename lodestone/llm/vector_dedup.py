"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with cosine >= t lie within eps = sqrt(2 - 2t) of each other, and so do their projections. Vectors are
sorted by label and by the grid cells (of width eps) of their leading principal coordinates, and the sequence is cut
into blocks. Intervals of blocks, then blocks, then halves of blocks are joined only where their boxes in projected
space come within eps; what is left is compared exactly in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, local_roots, materialize

COSINE = 0.98
PRINCIPAL = 6
#: Vectors that the principal directions are fitted on; any directions give right results.
FIT_ROWS = 10_000
BLOCK = 1024
#: Parts of an interval, and intervals of a label at the top of the recursion.
FAN = 16
LEAF = 128


def eps_of(cosine: float) -> float:
    return float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-9


def principal_directions(sample: np.ndarray, k: int = PRINCIPAL) -> np.ndarray:
    """``dim x k`` orthonormal columns; axes where there is nothing to fit."""
    dim = sample.shape[1]
    if len(sample) < 2:
        return np.eye(dim)[:, :k]
    x = sample - sample.mean(axis=0)
    return np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :k]


def _unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.sqrt(np.einsum("ij,ij->i", raw, raw))[:, None]


def close_pairs(a: np.ndarray, b: np.ndarray, pa: np.ndarray, pb: np.ndarray, cosine: float, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index arrays (i, j) of rows of ``a`` and ``b`` with cosine at least ``cosine``; both are sorted in grid order and halved while their boxes are close."""
    stack = [(0, len(a), 0, len(b))]
    ua, ub = _unit(a), _unit(b)
    while stack:
        i0, i1, j0, j1 = stack.pop()
        gap = np.maximum(pa[i0:i1].min(axis=0) - pb[j0:j1].max(axis=0), pb[j0:j1].min(axis=0) - pa[i0:i1].max(axis=0))
        if (np.maximum(gap, 0) ** 2).sum() > eps * eps:
            continue
        if max(i1 - i0, j1 - j0) > LEAF:
            if i1 - i0 >= j1 - j0:
                m = (i0 + i1) // 2
                stack += [(i0, m, j0, j1), (m, i1, j0, j1)]
            else:
                m = (j0 + j1) // 2
                stack += [(i0, i1, j0, m), (i0, i1, m, j1)]
            continue
        sims = ua[i0:i1] @ ub[j0:j1].T
        i, j = np.nonzero(sims >= cosine - 1e-12)
        edge = sims[i, j] < cosine + 1e-12
        if edge.any():  # at the threshold the plain formula decides
            x, y = a[i0 + i[edge]], b[j0 + j[edge]]
            plain = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
            keep = np.ones(len(i), dtype=bool)
            keep[edge] = plain >= cosine
            i, j = i[keep], j[keep]
        if len(i):
            yield i0 + i, j0 + j


def _first_hash(v: Column) -> Column:
    """One of two hashes by which equal vectors are known; the other starts from another seed, so it does not follow from this one."""
    return F.xxhash64(v)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``.

    Rows are linked when their labels are equal and not null and their cosine, in double precision, is at least
    ``cosine``. A vector that is null, empty or zero or holds a null or non-finite component links with nothing, nor do
    vectors of different lengths. Equal vectors are one class that counts with its size. Rows that repeat an id count
    as separate vectors under one id. ``component_id`` is the smallest id reachable; a null id loses against any other.
    An empty input gives an empty result.
    """
    spark, eps = vectors.sparkSession, eps_of(cosine)
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"))
    rows = rows.withColumn("ok", F.coalesce(finite & F.col("label").isNotNull(), F.lit(False)))
    rows = materialize(rows.select("id", "label", "ok", F.when(F.col("ok"), F.col("v")).alias("v"), _first_hash(F.col("v")).alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2")), "vectors")
    grouped = rows.where("ok").groupBy("label", "k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.first("v").alias("v"))
    classes = materialize(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    plain = rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"), "ok")
    if not n:
        return plain.drop("ok")
    share = min(1.0, FIT_ROWS / n)
    sample = classes.where(F.pmod("k1", F.lit(1_000_003)) < F.lit(share * 1_000_003)).select("v").limit(2 * FIT_ROWS).toPandas()["v"]
    dims = sample.map(len)
    dim = int(dims.mode().iloc[0]) if len(dims) else 1
    held = spark.sparkContext.broadcast(principal_directions(_unit(np.stack([x for x in sample if len(x) == dim] or [np.ones(dim)]))))

    def project(x: np.ndarray) -> np.ndarray:
        basis = held.value
        p = _unit(x)
        p = p @ basis if p.shape[1] == len(basis) else p[:, :PRINCIPAL]
        return np.pad(p, ((0, 0), (0, PRINCIPAL - p.shape[1])))

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby(pdf["v"].map(len)):
                x = np.stack(part["v"].to_list())
                grid = np.floor(project(x) / eps).astype(int)
                yield pd.DataFrame({"cid": part["cid"], "label": part["label"], "size": part["size"], "dim": x.shape[1], "cell": grid.tolist(), "v": list(x)})

    label_type = dict(rows.dtypes)["label"]
    placed = classes.select("cid", "label", "size", "v").mapInPandas(cells, f"cid long, label {label_type}, size long, dim int, cell array<int>, v array<double>")
    order = ["label", "dim", *[F.col("cell")[i] for i in range(PRINCIPAL)], "cid"]
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each block: up to ``block`` vectors that follow each other and share label and length."""
        rest, serial = None, 0

        def out(b: pd.DataFrame) -> pd.DataFrame:
            nonlocal serial
            x = np.stack(b["v"].to_list())
            p = project(x)
            serial += 1
            return pd.DataFrame({
                "block": [(int(b["part"].iloc[0]) << 32) | serial], "label": [b["label"].iloc[0]], "dim": [x.shape[1]], "lo": [p.min(axis=0).tolist()], "hi": [p.max(axis=0).tolist()],
                "n": [len(b)], "cids": [b["cid"].to_numpy(np.int64).tobytes()], "sizes": [b["size"].to_numpy(np.int64).tobytes()], "data": [x.astype("<f8").tobytes()],
            })

        for pdf in batches:
            rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            runs = ((rest["label"] != rest["label"].shift()) | (rest["dim"] != rest["dim"].shift())).cumsum().to_numpy()
            edges = np.flatnonzero(np.diff(runs)) + 1
            starts = [s for a, b in zip([0, *edges], [*edges, len(rest)], strict=True) for s in range(a, b, block)]
            for a, b in zip(starts, starts[1:], strict=False):
                yield out(rest.iloc[a:b])
            rest = rest.iloc[starts[-1] :].reset_index(drop=True) if starts else None
        if rest is not None and len(rest):
            yield out(rest)

    blocks = ordered.mapInPandas(cut, f"block long, label {label_type}, dim int, lo array<double>, hi array<double>, n int, cids binary, sizes binary, data binary")
    blocks = materialize(blocks, "blocks")
    pairs = _block_pairs(blocks, eps)
    sides = [blocks.select(F.col("block").alias(f"{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "cids", "sizes", "data")]) for s in ("a", "b")]
    work = pairs.join(sides[0], "a").join(sides[1], "b")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                a, b = (np.frombuffer(x, "<f8").reshape(k, -1) for x, k in ((r.data_a, r.n_a), (r.data_b, r.n_b)))
                same = r.a == r.b
                size_a, size_b = np.frombuffer(r.sizes_a, np.int64), np.frombuffer(r.sizes_b, np.int64)
                links_a, links_b = np.zeros(r.n_a, np.int64), np.zeros(r.n_b, np.int64)
                nodes = r.n_a if same else r.n_a + r.n_b
                root = np.arange(nodes)
                for i, j in close_pairs(a, b, project(a), project(b), cosine, eps):
                    if same:
                        off = i != j
                        i, j = i[off], j[off]
                    links_a += np.bincount(i, weights=size_b[j], minlength=r.n_a).astype(np.int64)
                    if not same:
                        links_b += np.bincount(j, weights=size_a[i], minlength=r.n_b).astype(np.int64)
                    to = j if same else j + r.n_a
                    root = local_roots(nodes, np.concatenate([np.arange(nodes), i]), np.concatenate([root, to]))
                ids = np.frombuffer(r.cids_a, np.int64) if same else np.concatenate([np.frombuffer(r.cids_a, np.int64), np.frombuffer(r.cids_b, np.int64)])
                links = links_a if same else np.concatenate([links_a, links_b])
                at = np.flatnonzero(links)
                if len(at):
                    yield pd.DataFrame({"cid": ids[at], "links": links[at], "other": ids[root[at]]})

    found = materialize(work.mapInPandas(compare, "cid long, links long, other long"), "links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    component = connected_components(found, "cid", "other").withColumnRenamed("node", "cid")
    known = classes.select("cid", "label", "k1", "k2", "rep", "size").join(links, "cid", "left").join(component, "cid", "left")
    known = materialize(known.withColumn("component", F.coalesce("component", "cid")), "known")
    least = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = known.join(least, "component").select("label", "k1", "k2", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    good = rows.where("ok").select("id", "label", "k1", "k2").join(known, ["label", "k1", "k2"])
    good = good.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
    return good.unionByName(plain.where(~F.col("ok")).drop("ok"))


def _block_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """``(a, b)`` with a <= b for blocks whose boxes come within ``eps``.

    Blocks are numbered in the order of the sequence; an interval of a level is FAN intervals of the next. At the top a
    label has a few intervals; close pairs of intervals are joined with their own parts, level by level, down to blocks.
    """
    # One number for each partition of the sorted vectors comes to the driver.
    sizes = sorted((r[0], r[1]) for r in blocks.groupBy(F.shiftright("block", 32).alias("part")).count().collect())
    total = sum(n for _, n in sizes)
    starts = np.cumsum([0] + [n for _, n in sizes]).tolist()
    base = blocks.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts, strict=False)], "part long, first long")
    axes = range(PRINCIPAL)
    box = blocks.join(F.broadcast(base), F.shiftright("block", 32) == F.col("part")).select("block", "label", "dim", "lo", "hi", (F.col("first") + F.expr("(block & 4294967295) - 1")).alias("node"))
    levels = [box]
    while FAN ** len(levels) < total:
        fold = [F.array(*[F.min(F.col("lo")[i]) for i in axes]).alias("lo"), F.array(*[F.max(F.col("hi")[i]) for i in axes]).alias("hi")]
        levels.append(materialize(levels[-1].groupBy("label", "dim", F.expr(f"node div {FAN}").alias("node")).agg(*fold), "intervals"))

    def close(x: str, y: str) -> Column:
        d = [F.greatest(F.col(f"{x}.lo")[i] - F.col(f"{y}.hi")[i], F.col(f"{y}.lo")[i] - F.col(f"{x}.hi")[i], F.lit(0.0)) for i in axes]
        return sum((e * e for e in d[1:]), d[0] * d[0]) <= F.lit(eps * eps)

    def side(level: DataFrame, parent: str, name: str) -> DataFrame:
        held = F.struct("node", "lo", "hi", *(["block"] if "block" in level.columns else []))
        return level.select("label", "dim", F.expr(f"node div {FAN}").alias(parent), held.alias(name))

    top = levels[-1]
    pairs = side(top, "pa", "x").join(side(top, "pb", "y"), ["label", "dim"]).where((F.col("x.node") <= F.col("y.node")) & close("x", "y"))
    for level in reversed(levels[:-1]):
        pairs = materialize(pairs.select("label", "dim", F.col("x.node").alias("pa"), F.col("y.node").alias("pb")), "pairs")
        pairs = pairs.join(side(level, "pa", "x"), ["label", "dim", "pa"]).join(side(level, "pb", "y"), ["label", "dim", "pb"])
        pairs = pairs.where((F.col("x.node") <= F.col("y.node")) & close("x", "y"))
    return pairs.select(F.col("x.block").alias("a"), F.col("y.block").alias("b"))
