"""Near-duplicate texts: a Jaccard join on word n-grams through a MinHash LSH forest, verified exactly.

A text's signature is cut into trees; its path in a tree is the tree's values in order. Paths with a common prefix are a
subtree of a prefix trie, which is sorted, and the common prefixes of neighbours tell the branches. Matched prefixes are
shortened level by level: from the longest at which a text without any close neighbour has reached the target recall,
on to shorter ones for the texts whose own neighbours, by their estimated similarity, say that more like them may be
missed. Candidates whose whole signatures agree well enough are grouped into clusters, and within a cluster every pair is
verified on the full n-gram sets, block by block, so that each link is counted once and none is emitted as a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, in_pieces, local_roots, materialize, trim_memory

WORDS, SIMILARITY = 5, 0.8
TREES, DEPTH = 24, 6
RECALL = 0.9999
#: Standard errors of the estimated similarity that a pair may lie below the threshold and still be verified.
SLACK = 5.0
#: Texts of one bucket or cluster that a task compares with as many others; larger ones are dealt out in pairs of such parts.
PART = 1024
#: Rows of first texts, clusters or open texts (under 100 bytes each) that are broadcast at most; more are joined by shuffle.
BROADCAST_ROWS = 200_000
VALUES = TREES * DEPTH


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of the n-grams of the A-Z-lower-cased words; a text with fewer words has one n-gram of all of them."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), dtype=np.uint64, count=len(parts))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = (out ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64)


def signature(grams: np.ndarray, step: int = 8192) -> np.ndarray:
    """TREES x DEPTH minima, each cut to 16 bits."""
    low = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(grams), step):
        x = grams[at : at + step][:, None] * _A + _B
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(low, x.min(axis=0), out=low)
    return ((low * np.uint64(0x94D049BB133111EB)) >> np.uint64(48)).astype(np.uint16)


def found_at(similarity: float, depth: int) -> float:
    """Probability that some tree matches a pair of this similarity on its first ``depth`` values."""
    return 1 - (1 - similarity**depth) ** TREES


def prefix_depth(similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """The longest prefix with which the forest finds a pair at ``similarity`` with probability ``recall``."""
    return next((d for d in range(DEPTH, 1, -1) if found_at(similarity, d) >= recall), 1)


def open_below(depth: int, similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """Agreeing values of 144 under which a text's closest miss still counts as open at ``depth``; 0 where no link can be.

    An estimate under the threshold by more than a standard error is taken as one standard error under it.
    """
    lowest = max(0.0, similarity - float(np.sqrt(similarity * (1 - similarity) / VALUES)))
    return next((a for a in range(VALUES, 0, -1) if found_at(max(lowest, (a - 1) / VALUES), depth) < recall), 0)


def text_hash(text: Column) -> Column:
    """With the id it names a row, as rows may share an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _sign(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
            # Big-endian, so that the order of bytes is that of paths.
            sigs = [signature(s).astype(">u2").tobytes() if len(s) else bytes(2 * VALUES) for s in sets]
            both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "th": batch.column("th"), "n": pa.array([len(s) for s in sets], pa.int64()), "k1": pa.array(both[:, 0]), "k2": pa.array(both[:, 1]), "sig": pa.array(sigs, pa.binary())})
        trim_memory()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), text_hash(F.col(text_col)).alias("th"))
    return rows.mapInArrow(run, "id long, th long, n long, k1 long, k2 long, sig binary")


def in_groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Frames of whole groups from batches that are sorted by ``key``; only the last, open group is carried over."""
    rest = None
    for pdf in batches:
        rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        k = rest[key].to_numpy()
        cut = len(k) - int(np.argmax(k[::-1] != k[-1])) if len(k) and k[0] != k[-1] else 0
        if cut:
            yield rest.iloc[:cut]
            rest = rest.iloc[cut:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def _dealt(rows: DataFrame, key: str, size: str, member: str, part: int, order: tuple[str, ...] = ()) -> DataFrame:
    """Rows with ``g``, ``a``, ``b``, ``r``: a group of more than ``part`` members is cut into parts by a hash and a row goes to every pair of parts that has its own."""
    parts = F.ceil(F.col(size) / part).cast("int")
    r = F.pmod(F.xxhash64(F.col(member), F.lit(3)), parts).cast("int")
    rows = rows.withColumn("r", r).withColumn("j", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.withColumns({"a": F.least("r", "j"), "b": F.greatest("r", "j")})
    g = F.xxhash64(key, "a", "b")
    return rows.withColumn("g", g).drop("j").repartition("g").sortWithinPartitions("g", *order)


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per input row: ``doc_id, n_links, component_id, kept``.

    Texts are linked when the Jaccard similarity of their sets of word n-grams (words split at ASCII white space, A-Z
    lower-cased) is at least ``similarity``; texts with fewer words than an n-gram are linked when their words are equal.
    A null text, or one without a word, links with nothing. Texts with equal sets are one class that counts with its
    size; rows that repeat an id count as separate texts under it. ``component_id`` is the smallest id reachable, and
    the row with that id is ``kept``; a null id loses against any other. An empty input gives an empty result.
    """
    out = _near(docs, id_col, text_col, words, similarity, recall)
    component_id = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("doc_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.col("id").eqNullSafe(component_id).alias("kept"))


def near_losers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """``id, th`` (see ``text_hash``) of the rows that lose in their component of near copies.

    One id and text of a component wins: the smallest id, then the smallest hash; null ids come last. Rows that repeat
    both win or lose together.
    """
    linked = _near(docs, id_col, text_col, words, similarity, recall).where("n_links > 0")
    linked = materialize(linked.select("id", "th", "component"), "linked")
    first = materialize(linked.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "th")).alias("first")), "first")
    first = F.broadcast(first) if first.count() <= BROADCAST_ROWS else first
    wins = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th"))
    return linked.join(first, "component").where(~wins).select("id", "th").distinct()


def _near(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, recall: float) -> DataFrame:
    """``id, th`` of each row and, of rows with links, ``n_links, component_id`` and ``component``, which names it where ids are null or repeat."""
    rows = materialize(_sign(docs, id_col, text_col, words), "signatures")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "th")).alias("rep")
    grouped = rows.where("n > 0").groupBy("k1", "k2").agg(first, F.count("*").alias("size"), F.first("sig").alias("sig"))
    classes = materialize(grouped.select(F.monotonically_increasing_id().alias("cid"), "k1", "k2", F.col("rep.id").alias("rep"), F.col("rep.th").alias("rep_th"), "size", "sig"), "classes")
    cluster = _clusters(classes, similarity, recall)
    found = _verified(docs, id_col, text_col, words, similarity, classes, cluster)
    # A cluster that one task verified has its components; only parts of larger clusters are still to be connected.
    whole = found.where("not cut").select("cid", F.col("other").alias("component"))
    component = connected_components(found.where("cut"), "cid", "other").withColumnRenamed("node", "cid").unionByName(whole)
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    linked = links.join(component, "cid")
    known = classes.select("cid", "k1", "k2", "rep", "size").join(linked, "cid", "left").where("size > 1 or links is not null")
    known = materialize(known.withColumn("component", F.coalesce("component", "cid")), "known")
    least = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    # Classes without links or copies need no join: their rows are their own component.
    more = known.join(least, "component").select("k1", "k2", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id", "component")
    return rows.select("id", "th", "k1", "k2").join(more, ["k1", "k2"], "left")


def _clusters(classes: DataFrame, similarity: float, recall: float) -> DataFrame:
    """``(cid, cluster)`` of the classes that the forest gives a neighbour."""
    level, edges, closer = prefix_depth(similarity, recall), None, None
    while True:
        found = materialize(_shortened_to(classes, level, similarity, closer), "neighbours")
        edges = found if edges is None else edges.unionByName(found)
        below = open_below(level, similarity, recall)
        if level == 1 or not below:
            break
        # The neighbours found so far say which texts have not reached the target.
        closer = materialize(edges.groupBy("cid").agg(F.min("agree").alias("agree")).where(F.col("agree") < below).select("cid"), "open")
        if closer.isEmpty():
            break
        level -= 1
    return connected_components(edges, "cid", "other").withColumnsRenamed({"node": "cid", "component": "cluster"})


def _shortened_to(classes: DataFrame, level: int, similarity: float, closer: DataFrame | None) -> DataFrame:
    """``cid, other, agree`` from the subtrees of paths that share their first ``level`` values: spanning edges of agreeing texts, with a text's least agreement.

    Without ``closer`` all texts of a subtree are compared; with it those in it, with texts of the subtree's other branches.
    """
    at = F.col("tree") * (2 * DEPTH) + 1
    root = F.xxhash64("tree", F.substring(F.col("sig"), at, F.lit(2 * level)))
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    leaves = classes.select("cid", "sig", trees).select("cid", "tree", root.alias("root"))
    if closer is not None:
        small = closer.count() <= BROADCAST_ROWS // TREES
        roots = classes.join(F.broadcast(closer) if small else closer, "cid", "left_semi").select("sig", trees).select(root.alias("root")).distinct()
        leaves = leaves.join(F.broadcast(roots) if small else roots, "root", "left_semi")
    shared = leaves.groupBy("root").agg(F.count("*").alias("members")).where("members > 1")
    near = leaves.join(shared, "root").join(classes.select("cid", "sig"), "cid")
    near = near.withColumn("open", F.lit(True)) if closer is None else near.join(closer.withColumn("open", F.lit(True)), "cid", "left").withColumn("open", F.coalesce("open", F.lit(False)))
    near = near.withColumn("path", F.substring(F.col("sig"), at, F.lit(2 * DEPTH)))
    dealt = _dealt(near, "root", "members", "cid", PART, ("path", "cid"))
    spread = SLACK * float(np.sqrt(similarity * (1 - similarity) / VALUES))
    least = int(np.floor((similarity - spread) * VALUES))
    fresh = closer is None

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in in_groups(batches, "g"):
            g, cid, open_ = pdf["g"].to_numpy(), pdf["cid"].to_numpy(), pdf["open"].to_numpy(bool)
            cross = (pdf["a"] != pdf["b"]).to_numpy()
            side = (pdf["r"] == pdf["b"]).to_numpy() & cross
            sig = np.frombuffer(b"".join(pdf["sig"]), ">u2").astype(np.uint16).reshape(len(pdf), -1)
            path = np.frombuffer(b"".join(pdf["path"]), ">u2").reshape(len(pdf), -1)
            common = np.concatenate([[0], np.cumprod(path[1:] == path[:-1], axis=1).sum(axis=1)])
            common[1:][g[1:] != g[:-1]] = 0
            branch = np.cumsum(common <= level)  # runs of paths that share more than the subtree's prefix
            starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            ends = np.append(starts[1:], len(g))
            small = np.repeat(ends - starts <= 32, ends - starts)
            none = np.zeros(0, int)
            one, two, agree = [none], [none], [none]
            for k in range(1, 32):
                i = np.flatnonzero((g[:-k] == g[k:]) & small[:-k]) if k < len(g) else none
                if not len(i):
                    break
                i = i[~cross[i] | (side[i] != side[i + k])]
                if not fresh:
                    i = i[(open_[i] | open_[i + k]) & (branch[i] != branch[i + k])]
                for at in range(0, len(i), 20_000):
                    x = i[at : at + 20_000]
                    n = (sig[x] == sig[x + k]).sum(axis=1)
                    hit = n >= least
                    one.append(x[hit]), two.append(x[hit] + k), agree.append(n[hit])
            for s, e in zip(starts, ends, strict=True):
                if e - s > 32:
                    if fresh:
                        x, y, n = _large(sig[s:e], side[s:e] if cross[s] else None, least)
                    else:
                        x, y, n = _branches(sig[s:e], side[s:e] if cross[s] else None, least, branch[s:e], open_[s:e])
                    one.append(s + x), two.append(s + y), agree.append(n)
            x, y, n = np.concatenate(one), np.concatenate(two), np.concatenate(agree)
            root = local_roots(len(g), x, y)
            low = np.full(len(g), VALUES + 1)
            np.minimum.at(low, x, n)
            np.minimum.at(low, y, n)
            hit = np.flatnonzero(low <= VALUES)
            if len(hit):
                yield pd.DataFrame({"cid": cid[hit], "other": cid[root[hit]], "agree": low[hit]})

    return dealt.select("g", "a", "b", "r", "cid", "open", "sig", "path").mapInPandas(link, "cid long, other long, agree long")


def _branches(sig: np.ndarray, side: np.ndarray | None, least: int, branch: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, ...]:
    """Agreeing pairs of an open row and a row of another branch."""
    one, two, agree = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0, int)]
    for i in np.flatnonzero(open_):
        to = branch != branch[i]
        to = np.flatnonzero(to if side is None else to & (side != side[i]))
        n = (sig[to] == sig[i]).sum(axis=1)
        hit = n >= least
        one.append(np.full(int(hit.sum()), i)), two.append(to[hit]), agree.append(n[hit])
    return np.concatenate(one), np.concatenate(two), np.concatenate(agree)


def _large(sig: np.ndarray, side: np.ndarray | None, least: int) -> tuple[np.ndarray, ...]:
    """Edges that connect every pair of agreeing signatures: rows, in the order of the trie, are taken up by pivots, then rows of different groups are compared."""
    n = len(sig)
    none = np.zeros(0, int)
    root, one, two, agree = np.arange(n), [none], [none], [none]
    if side is not None:  # two parts of a subtree: only pairs across
        a, b = np.flatnonzero(~side), np.flatnonzero(side)
        for at in range(0, len(a), 64):
            same = (sig[a[at : at + 64], None, :] == sig[None, b, :]).sum(axis=2)
            i, j = np.nonzero(same >= least)
            one.append(a[at + i]), two.append(b[j]), agree.append(same[i, j])
        return np.concatenate(one), np.concatenate(two), np.concatenate(agree)

    def compare(i: int, other: np.ndarray) -> np.ndarray:
        same = (sig[other] == sig[i]).sum(axis=1)
        hit = same >= least
        one.append(np.full(int(hit.sum()), i)), two.append(other[hit]), agree.append(same[hit])
        return other[hit]

    for p in range(n):
        if root[p] != p:
            continue  # taken up by an earlier row, whose agreement with p makes them one cluster
        hit = compare(p, np.flatnonzero(root != p))
        if len(hit):
            root = np.minimum(root, local_roots(n, np.concatenate([np.arange(n), np.full(len(hit), p)]), np.concatenate([root, hit])))
    # Rows that joined a group without being a pivot are compared with the rows outside it.
    groups, sizes = np.unique(root, return_counts=True)
    for k in np.argsort(sizes)[:-1]:
        outside = np.flatnonzero(root != groups[k])
        for i in np.flatnonzero(root == groups[k]):
            if i != groups[k]:
                compare(int(i), outside)
    return np.concatenate(one), np.concatenate(two), np.concatenate(agree)


def _verified(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, classes: DataFrame, cluster: DataFrame) -> DataFrame:
    """``(cid, links, other, cut)``: links counted with the sizes of the classes, and edges that span each verified component; ``cut``: of a cluster in parts."""
    sizes = cluster.groupBy("cluster").agg(F.count("*").alias("members"))
    chosen = cluster.join(sizes, "cluster").join(classes.select("cid", "rep", "rep_th", "k1", "k2", "size"), "cid")
    chosen = materialize(chosen, "clusters")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), text_hash(F.col(text_col)).alias("th"))
    few = chosen.count() <= BROADCAST_ROWS
    same = F.col("id").eqNullSafe(F.col("rep")) & (F.col("th") == F.col("rep_th"))
    texts = texts.join(F.broadcast(chosen) if few else chosen.hint("shuffle_hash"), same).select("cluster", "cid", "members", "size", "k1", "k2", "text")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingles(t, words).tobytes() for t in pdf["text"]]
            # Texts of one hash may still differ; the set's own hash tells which row stands for the class.
            right = [xxhash.xxh3_128_digest(s) == int(a).to_bytes(8, "little", signed=True) + int(b).to_bytes(8, "little", signed=True) for s, a, b in zip(sets, pdf["k1"], pdf["k2"], strict=True)]
            yield pdf[["cluster", "cid", "members", "size"]].assign(grams=sets)[right]

    sets = texts.mapInPandas(cut, "cluster long, cid long, members long, size long, grams binary")
    dealt = _dealt(sets, "cluster", "members", "cid", PART).select("g", "a", "b", "r", "cid", "size", "members", "grams")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for many in in_groups(batches, "g"):
            outs = []
            for _, pdf in many.groupby("g", sort=False):
                pdf = pdf.drop_duplicates("cid") if len(pdf) > 1 else pdf
                if len(pdf) > 1:
                    outs.append(verify_group(pdf, similarity).assign(cut=bool(pdf["members"].iloc[0] > PART)))
            if outs:
                yield pd.concat(outs, ignore_index=True)
        trim_memory()

    return materialize(dealt.mapInPandas(verify, "cid long, links long, other long, cut boolean"), "links")


def verify_group(pdf: pd.DataFrame, similarity: float, cells: int = 8_000_000) -> pd.DataFrame:
    """Exact links within one part of a cluster, or between two parts of it, by the product of incidence matrices over the shared n-grams."""
    cid, size = pdf["cid"].to_numpy(), pdf["size"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in pdf["grams"]]
    n = np.array([len(s) for s in sets])
    cross = bool((pdf["a"] != pdf["b"]).iloc[0])
    side = (pdf["r"] == pdf["b"]).to_numpy() if cross else np.zeros(len(pdf), bool)
    left, right = (np.flatnonzero(~side), np.flatnonzero(side)) if cross else (np.arange(len(pdf)),) * 2
    doc = np.repeat(np.arange(len(sets)), n)
    _, gram, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count[gram] > 1
    dense = np.cumsum(count > 1) - 1
    doc, gram, width = doc[keep], dense[gram[keep]], int((count > 1).sum())
    both = np.zeros((len(left), len(right)), np.float32)
    step = max(256, cells // max(1, len(sets)))
    order = np.argsort(gram, kind="stable")
    doc, gram = doc[order], gram[order]
    for at in range(0, width, step):
        lo, hi = np.searchsorted(gram, [at, at + step])
        m = np.zeros((len(sets), min(step, width - at)), np.float32)
        m[doc[lo:hi], gram[lo:hi] - at] = 1
        both += m[left] @ m[right].T if cross else m @ m.T
    hit = both * (1 + similarity) >= similarity * (n[left][:, None] + n[right][None, :]) - 1e-3
    i, j = np.nonzero(hit)
    if not cross:
        i, j = i[i != j], j[i != j]
    shared = np.rint(both[i, j]).astype(np.int64)
    total = n[left][i] + n[right][j] - shared
    exact = shared >= similarity * total - 1e-9
    i, j = left[i[exact]], right[j[exact]]
    links = np.bincount(i, weights=size[j], minlength=len(cid))
    if cross:
        links = links + np.bincount(j, weights=size[i], minlength=len(cid))
    at = np.flatnonzero(links)
    root = local_roots(len(cid), i, j) if len(i) else np.arange(len(cid))
    return pd.DataFrame({"cid": cid[at], "links": links[at].astype(np.int64), "other": cid[root[at]]})
