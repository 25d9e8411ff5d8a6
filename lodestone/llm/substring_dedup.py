"""Substring de-duplication: word windows that occur twice, found through FM-indexes.

A window's anchor is the least of its k-gram hashes, so equal windows have equal anchors wherever they stand. A text is
a chain of runs, each the stretch of windows that share an anchor. Hashes only route: runs with an anchor that occurs
once drop out, equal runs become one row with a count, and the rest are dealt by anchor into shards (those of an anchor
with very many different runs window by window). A shard builds an FM-index (a Burrows-Wheeler transform under a wavelet
matrix with sampled ranks, and the runs' counts in the order of suffixes) over its runs and streams them against it:
backward search gives at each place how long a match occurs twice or more, and the stretches whose match reaches the
window's length are reported for every place that carries the run.
Symbols are 5-grams of words, one string for each phase, so a window of 35 words is seven steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HEAVY_LEAST, HEAVY_NODES, discard, in_pieces, join_skewed, materialize, trim_memory

WINDOW = 35
ANCHOR = 12
GRAM = 5
#: Windows in one run at most; longer runs are cut, which changes no window.
RUN = 256
#: Distinct runs that an anchor sends to one shard; an anchor with more sends its windows, each by its own hash.
HOT = 2_000
SHARD_WORDS = 150_000
#: Document keys (16 bytes each) or hot anchors that are broadcast at most; more are joined by shuffle.
BROADCAST_ROWS = 200_000
_B = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
_INV = [pow(b, -1, 1 << 64) for b in _B]


def word_hashes(text: str | None) -> np.ndarray:
    parts = (text or "").encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, parts), dtype=np.uint64, count=len(parts))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SliceHashes:
    """Hashes of slices of one array of word hashes, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, h: np.ndarray, which: int = 0):
        n = len(h)
        power, self.inverse = np.full(n + 1, _B[which], np.uint64), np.full(n + 1, _INV[which], np.uint64)
        power[0] = self.inverse[0] = 1
        np.cumprod(power, out=power)
        np.cumprod(self.inverse, out=self.inverse)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * power[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def runs_of(h: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """``(start, windows, anchor, content, again)`` of the runs of one text; ``again``: the anchor's k-gram occurs twice in the text, so one run may hold equal windows."""
    if len(h) < window:
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64), none.view(np.uint64), none.astype(bool)
    s = SliceHashes(h)
    at = np.arange(len(h) - anchor + 1)
    low = s.of(at, at + anchor)
    values, counts = np.unique(low, return_counts=True)
    twice = values[counts > 1]
    width, have = window - anchor + 1, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    sizes = np.diff(np.append(starts, len(low)))
    if (sizes > RUN).any():
        starts = np.concatenate([np.arange(a, a + n, RUN) for a, n in zip(starts, sizes, strict=True)])
        sizes = np.diff(np.append(starts, len(low)))
    again = np.isin(low[starts], twice) if len(twice) else np.zeros(len(starts), bool)
    return starts, sizes, low[starts], s.of(starts, starts + sizes + window - 1), again


class FMIndex:
    """Backward search over a text of dense symbols from 1 on, 0 as separator; right for patterns of up to ``depth`` symbols.

    ``weight`` says how often each place of the text counts; a match is worth the sum over its places.
    """

    def __init__(self, text: np.ndarray, depth: int = 8, weight: np.ndarray | None = None):
        n = len(text)
        rank = text.astype(np.int64)
        step = 1
        while step < depth:
            ahead = np.concatenate([rank[step:], np.zeros(min(step, n), np.int64)])
            rank = np.unique(rank * (n + int(text.max(initial=0)) + 1) + ahead, return_inverse=True)[1]
            step *= 2
        order = np.argsort(rank, kind="stable")
        bwt = text[order - 1]
        self.worth = np.arange(n + 1) if weight is None else np.concatenate([[0], np.cumsum(weight[order])])
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=int(text.max(initial=0)) + 1))])
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        seq = bwt
        for bit in range(max(1, int(text.max(initial=0)).bit_length()) - 1, -1, -1):
            ones = ((seq >> bit) & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate([ones, np.zeros(64 + (-len(ones)) % 64, np.uint8)]), bitorder="little").view(np.uint64)
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.int32)
            self.levels.append((packed, counts, int(len(ones) - ones.sum())))
            seq = np.concatenate([seq[ones == 0], seq[ones == 1]])

    def _ones(self, level: tuple[np.ndarray, np.ndarray, int], at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return level[1][word] + np.bitwise_count(level[0][word] & mask).astype(np.int64)

    def ranks(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often ``symbol`` occurs in the transform's rows [0, lo) and [0, hi)."""
        start = np.zeros(len(symbol), np.int64)
        for k, level in enumerate(self.levels):
            bit = (symbol >> (len(self.levels) - 1 - k)) & 1
            a, b, s = self._ones(level, lo), self._ones(level, hi), self._ones(level, start)
            one = bit.astype(bool)
            lo = np.where(one, level[2] + a, lo - a)
            hi = np.where(one, level[2] + b, hi - b)
            start = np.where(one, level[2] + s, start - s)
        return lo - start, hi - start

    def matches(self, patterns: np.ndarray, enough: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of ``patterns`` (equal lengths): how many of its last symbols occur together ``enough`` times or more, and how often those occur."""
        c = patterns[:, -1]
        lo, hi = self.first[c], self.first[c + 1]
        times, length = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
        live = np.arange(len(c))
        for k in range(patterns.shape[1] - 1, -1, -1):
            if k < patterns.shape[1] - 1:
                c = patterns[live, k]
                a, b = self.ranks(c, lo, hi)
                lo, hi = self.first[c] + a, self.first[c] + b
            worth = self.worth[hi] - self.worth[lo]
            go = worth >= enough
            live, lo, hi = live[go], lo[go], hi[go]
            length[live] += 1
            times[live] = worth[go]
        return length, times


def _judged(runs: list[np.ndarray], window: int, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Whether each window of each run (an array of word hashes that counts ``weights`` times) occurs twice or more, end to end, and the number of windows of each run."""
    sizes = np.array([len(r) for r in runs])
    offs = np.concatenate([[0], np.cumsum(sizes)])
    h = np.concatenate(runs)
    grams = np.full(len(h) - GRAM + 1, GRAM, np.uint64)
    for k in range(GRAM):
        grams = _mixed(grams * np.uint64(_B[0]) + h[k : len(h) - GRAM + 1 + k])
    row = np.repeat(np.arange(len(runs)), sizes)[: len(grams)]
    rel = np.arange(len(grams)) - offs[row]
    pos = np.flatnonzero(rel <= sizes[row] - GRAM)
    symbol = np.zeros(len(grams), np.int64)
    symbol[pos] = np.unique(grams[pos], return_inverse=True)[1] + 1
    # One string for each run and phase, each followed by a separator.
    phase, depth = rel[pos] % GRAM, rel[pos] // GRAM
    length = (sizes[:, None] - GRAM - np.arange(GRAM)[None, :]) // GRAM + 1
    begin = np.concatenate([[0], np.cumsum(length.ravel() + 1)])
    text, weight = np.zeros(int(begin[-1]), np.int64), np.zeros(int(begin[-1]), np.int64)
    at = begin[row[pos] * GRAM + phase] + depth
    text[at] = symbol[pos]
    weight[at] = 1 if weights is None else weights[row[pos]]
    index = FMIndex(text, max(8, window // GRAM), weight)
    n_win = np.maximum(sizes - window + 1, 0)
    at = np.arange(n_win.sum()) + np.repeat(offs[:-1] - (np.cumsum(n_win) - n_win), n_win)
    hit = np.zeros(len(at), bool)
    for s in range(0, len(at), 500_000):
        part = at[s : s + 500_000]
        length, _ = index.matches(symbol[part[:, None] + np.arange(0, window, GRAM)[None, :]])
        hit[s : s + 500_000] = length * GRAM >= window
    return hit, n_win


def repeated_windows(runs: list[np.ndarray], ask: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each run (an array of word hashes) with ``ask``: which of its windows occur twice or more among all runs."""
    hit, n_win = _judged(runs, window)
    return [x for x, a in zip(np.split(hit, np.cumsum(n_win)[:-1]), ask, strict=True) if a]


def _stretches(hit: np.ndarray, n_win: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(run, first, last)`` of the stretches of windows that are hit."""
    run = np.repeat(np.arange(len(n_win)), n_win)
    edge = np.concatenate([[True], run[1:] != run[:-1], [True]])
    before, after = np.concatenate([[False], hit[:-1]]) & ~edge[:-1], np.concatenate([hit[1:], [False]]) & ~edge[1:]
    first, last = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after)
    origin = np.cumsum(n_win) - n_win
    return run[first], first - origin[run[first]], last - origin[run[last]]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows by id and text hash: rows that repeat both have equal windows, so the pair may stand for the row."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(text_col).alias("text"))


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _with_lists(docs: DataFrame, wanted: DataFrame, twins: bool) -> DataFrame:
    """``text, runs`` of the documents that ``wanted`` names by id and text hash, one row for each; texts that it doesn't name stay where they are."""
    lists = materialize(wanted.groupBy("id", "th").agg(F.collect_list(F.struct(*[c for c in wanted.columns if c not in ("id", "th")])).alias("runs")), "lists")
    lists = lists.withColumnsRenamed({"id": "i2", "th": "t2"})
    same = F.col("id").eqNullSafe(F.col("i2")) & (F.col("th") == F.col("t2"))
    texts = docs.join(F.broadcast(lists.select("i2", "t2")), same, "left_semi") if lists.count() <= BROADCAST_ROWS else docs
    texts = texts.join(lists.hint("shuffle_hash"), same)
    if twins:
        texts = texts.dropDuplicates(["id", "th"])  # one of equal rows gives the words of their runs
    return texts.select("id", "th", "text", "runs")


def _listed(batch: pa.RecordBatch) -> Iterator[tuple[int, str | None, dict[str, np.ndarray]]]:
    """Row number, text and listed runs (arrays by field) of each row."""
    lists = batch.column("runs")
    at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    flat = lists.flatten()
    fields = {f.name: flat.field(k).to_numpy(zero_copy_only=False) for k, f in enumerate(flat.type)}
    for i, text in enumerate(batch.column("text").to_pylist()):
        yield i, text, {k: v[at[i] : at[i + 1]] for k, v in fields.items()}


def repeated_stretches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``id, th, s, e``: stretches of words covered by windows that occur twice or more; they may overlap or repeat.

    ``th`` is the text's hash; with the id it names the row. A null text has no words; a text shorter than the window
    has no window. Rows that repeat id and text are two places for each of their windows. ``window`` is a multiple of 5.
    """
    if window % GRAM or window <= ANCHOR:
        raise ValueError(f"the window must be a multiple of {GRAM} and longer than {ANCHOR}")
    id_type = dict(docs.dtypes)[id_col]
    row = f"id {id_type}, th long, start int"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            found = [runs_of(word_hashes(t), window) for t in batch.column("text").to_pylist()]
            if not found:
                continue
            of = pa.array(np.repeat(np.arange(len(found)), [len(x[0]) for x in found]))
            start, wins, m, c, again = (np.concatenate([x[k] for x in found]) for k in range(5))
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id").take(of), "th": batch.column("th").take(of), "start": pa.array(start.astype(np.int32)), "wins": pa.array(wins.astype(np.int32)), "m": pa.array(m.view(np.int64)), "c": pa.array(c.view(np.int64)), "again": pa.array(again.astype(bool))
            })

    docs = _keyed(docs, id_col, text_col)
    runs = materialize(docs.mapInArrow(split, f"{row}, wins int, m long, c long, again boolean"), "runs")
    anchors = runs.groupBy("m").agg(F.count("*").alias("n"), F.max("again").alias("again")).where("n > 1 or again").select("m")
    known = materialize(runs.join(materialize(anchors, "anchors"), "m", "left_semi").drop("again"), "repeated")
    discard(runs)
    contents = known.groupBy("m", "c").agg(F.count("*").alias("weight"), F.min(F.struct("id", "th", "start", "wins")).alias("at"))
    contents = materialize(contents.select("at.*", "weight", F.col("m").alias("k1"), F.col("c").alias("k2")), "contents")
    twins = not docs.groupBy("id", "th").count().where("count > 1").isEmpty()
    hot = materialize(contents.groupBy("k1").count().where(F.col("count") > HOT).select(F.col("k1").alias("hot")), "hot")
    wanted, windows = contents, None
    if not hot.isEmpty():
        hot = _bounded(hot)
        wanted = contents.join(hot, F.col("k1") == F.col("hot"), "left_anti")

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                of, starts, hashes = [], [], []
                for i, text, r in _listed(batch):
                    h = word_hashes(text)
                    at = np.concatenate([np.arange(s, s + n) for s, n in zip(r["start"], r["wins"], strict=True)])
                    of.append(np.full(len(at), i)), starts.append(at), hashes.append([SliceHashes(h, k).of(at, at + window) for k in (0, 1)])
                of = pa.array(np.concatenate(of))
                k1, k2 = (np.concatenate([x[k] for x in hashes]).view(np.int64) for k in (0, 1))
                yield pa.RecordBatch.from_pydict({"id": batch.column("id").take(of), "th": batch.column("th").take(of), "start": pa.array(np.concatenate(starts).astype(np.int32)), "k1": pa.array(k1), "k2": pa.array(k2)})

        # Of an anchor with many different runs every window goes by its own hash; windows that occur once drop out.
        in_hot = known.join(hot, F.col("m") == F.col("hot"), "left_semi").select("id", "th", "start", "wins")
        in_hot = in_hot.distinct() if twins else in_hot
        windows = materialize(_with_lists(docs, in_hot, False).mapInArrow(hashed, f"{row}, k1 long, k2 long"), "windows")
        equal = windows.groupBy("k1", "k2").agg(F.count("*").alias("weight"), F.min(F.struct("id", "th", "start")).alias("at")).where("weight > 1")
        wanted = wanted.unionByName(equal.select("at.*", F.lit(1).alias("wins"), "weight", "k1", "k2"))
    wanted = materialize(wanted, "wanted")
    total, n = wanted.agg(F.sum(F.col("wins") + window - 1), F.sum("weight")).first()
    shards = max(1, int((total or 0) // SHARD_WORDS) + 1)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, text, r in _listed(batch):
                h = (word_hashes(text) >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]
                for at in range(0, len(r["start"]), 5_000):
                    x = {k: v[at : at + 5_000] for k, v in r.items()}
                    words = [h[s : s + w + window - 1].tobytes() for s, w in zip(x["start"].tolist(), x["wins"].tolist(), strict=True)]
                    yield pa.RecordBatch.from_pydict({"shard": pa.array((x["k1"] % shards).astype(np.int32)), "k1": pa.array(x["k1"]), "k2": pa.array(x["k2"]), "weight": pa.array(x["weight"]), "words": pa.array(words, pa.binary())})

    fetched = _with_lists(docs, wanted, twins).mapInArrow(fetch, "shard int, k1 long, k2 long, weight long, words binary")

    def search(table: pa.Table) -> pa.Table:
        runs = []
        for x in table["words"].to_pylist():
            full = np.zeros((len(x) // 6, 8), np.uint8)
            full[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
            runs.append(full.view(np.uint64).ravel())
        of, first, last = _stretches(*_judged(runs, window, table["weight"].to_numpy()))
        trim_memory()
        keys = table.select(["k1", "k2", "weight"]).take(pa.array(of))
        return keys.append_column("first", pa.array(first.astype(np.int32))).append_column("words", pa.array((last - first + window).astype(np.int32)))

    found = materialize(fetched.groupBy("shard").applyInArrow(search, "k1 long, k2 long, weight long, first int, words int"), "found")
    # Every place that carries a run or window gets its stretches; runs of many places, a bounded number, are joined by broadcast.
    heavy = max(HEAVY_LEAST, (n or 0) // HEAVY_NODES)
    by_run = found.groupBy("k1", "k2", "weight").agg(F.collect_list(F.struct("first", "words")).alias("stretches"))
    places = known.select("id", "th", "start", F.col("m").alias("k1"), F.col("c").alias("k2"))
    spans = None
    for where in (places, windows):
        if where is not None:
            part = join_skewed(where, by_run, ["k1", "k2"], F.col("weight") > heavy).select("id", "th", "start", F.explode("stretches").alias("x")).select("id", "th", "start", "x.*")
            s = F.col("start") + F.col("first")
            part = part.select("id", "th", s.alias("s"), (s + F.col("words")).alias("e"))
            spans = part if spans is None else spans.unionByName(part)
    return spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept`` (the kept words joined by one space, UTF-8 binary).

    A word goes when a window over it also starts anywhere else, in the same text or another; windows are judged on the
    input. A null or empty text has no words. An empty input gives an empty result; only id and text are read.
    """
    spans = repeated_stretches(docs, id_col, text_col, window).groupBy("id", "th").agg(F.collect_set(F.struct("s", "e")).alias("runs"))
    spans = materialize(spans.withColumnsRenamed({"id": "i2", "th": "t2"}), "spans")
    rows = _keyed(docs, id_col, text_col)
    same = F.col("id").eqNullSafe(F.col("i2")) & (F.col("th") == F.col("t2"))
    if spans.count() <= BROADCAST_ROWS:  # texts without a repeated window stay where they are
        keys = F.broadcast(spans.select("i2", "t2"))
        untouched = rows.join(keys, same, "left_anti").withColumn("runs", F.lit(None).cast("array<struct<s:int,e:int>>"))
        touched = rows.join(keys, same, "left_semi").join(spans.hint("shuffle_hash"), same).select("id", "th", "text", "runs")
        joined = untouched.unionByName(touched)
    else:
        joined = rows.join(spans.hint("shuffle_hash"), same, "left").select("id", "th", "text", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for _, text, r in _listed(batch):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                n.append(len(words))
                if not len(r["s"]):
                    gone.append(0), kept.append(b" ".join(words))
                    continue
                cover = np.zeros(len(words) + 1, np.int32)
                np.add.at(cover, r["s"], 1)
                np.add.at(cover, r["e"], -1)
                out = np.cumsum(cover[:-1]) > 0
                gone.append(int(out.sum())), kept.append(b" ".join([w for w, x in zip(words, out, strict=True) if not x]))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept": pa.array(kept, pa.binary())})

    return joined.select("id", "text", "runs").mapInArrow(cut, f"doc_id {dict(docs.dtypes)[id_col]}, n_words long, n_removed long, kept binary")
