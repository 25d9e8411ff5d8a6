"""Packing token ids into sequences: first-fit decreasing with a tournament tree of bin capacities, in randomised groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trim_memory
from .tokens import encoder, slices

SEQUENCE = 2048
GROUP_DOCS = 1024
#: Gaps of so many tokens or more are closed by cutting a piece.
LEAST_GAP = 16
END_ID = 1


class Tournament:
    """Bins of equal capacity; ``place`` puts an item into the first bin with room, found by walking down from the largest capacity left."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (max(1, bins) - 1).bit_length())
        self.best = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        best, node = self.best, 1
        if best[1] < size:
            raise ValueError("no bin has room")
        while node < self.leaves:
            node *= 2
            if best[node] < size:
                node += 1
        at = node - self.leaves
        best[node] -= size
        while node > 1:
            node //= 2
            a, b = best[2 * node], best[2 * node + 1]
            new = a if a >= b else b
            if best[node] == new:
                break
            best[node] = new
        return at


def plan_group(sizes: list[int], length: int = SEQUENCE, least_gap: int = LEAST_GAP) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces ``(item, start, size)`` that hold every token of every item once.

    Items are first cut into whole sequences; what is left of each is placed by first-fit decreasing. Gaps of
    ``least_gap`` or more are then closed from the emptiest bins, and the one bin this leaves open is dealt into
    sequences whose lengths are powers of two, which need no padding.
    """
    done = [[(i, at, length)] for i, n in enumerate(sizes) for at in range(0, n - length + 1, length)]
    rest = sorted(((n % length, i) for i, n in enumerate(sizes) if n % length), key=lambda x: (-x[0], x[1]))
    tree = Tournament(len(rest), length)
    bins: list[list[tuple[int, int, int]]] = []
    for n, i in rest:
        at = tree.place(n)
        while at >= len(bins):
            bins.append([])
        bins[at].append((i, sizes[i] - n, n))
    fill = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda k: (-fill[k], k))
    bins, fill = [bins[k] for k in order], [fill[k] for k in order]
    i, j = 0, len(bins) - 1
    while i < j:
        gap = length - fill[i]
        if gap < least_gap:
            i += 1
            continue
        item, start, n = bins[j].pop()
        move = min(gap, n)
        bins[i].append((item, start, move))
        if move < n:
            bins[j].append((item, start + move, n - move))
        fill[i] += move
        fill[j] -= move
        if not bins[j]:
            j -= 1
    done += bins[:j]
    if j >= 0 and bins:
        if length - fill[j] < least_gap:
            return done + [bins[j]]
        queue, bit = list(reversed(bins[j])), 1 << fill[j].bit_length()
        while queue:
            bit >>= 1
            if not fill[j] & bit:
                continue
            room, sequence = bit, []
            while room:
                item, start, n = queue.pop()
                move = min(room, n)
                sequence.append((item, start, move))
                if move < n:
                    queue.append((item, start + move, n - move))
                room -= move
            done.append(sequence)
    return done


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE, group_docs: int = GROUP_DOCS, end_id: int = END_ID, seed: int = 5) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``; ids as little-endian 32-bit binary.

    Texts are encoded and ``end_id`` is appended; a null text counts as empty and gives the end id alone. Documents are
    dealt into groups by a hash of their place in the input, so neither null nor repeated ids share a group; groups are
    independent tasks' work and a sequence lies in one group. Rows that repeat an id are packed each for itself. An empty
    input gives no sequence.
    """
    groups = max(1, -(-docs.count() // group_docs))

    def work(table: pa.Table) -> pa.Table:
        enc = encoder(vocabulary)
        table = table.sort_by([("id", "ascending"), ("text", "ascending")])
        texts = table["text"].combine_chunks()
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        parts, sizes = [], []
        for span in slices(texts):
            flat, ends = enc.encode(texts[span.start : span.stop])
            parts.append(np.insert(flat, ends, end_id).astype("<u4", copy=False))
            sizes.append(np.diff(ends, prepend=0) + 1)
        ids, sizes = np.concatenate(parts), np.concatenate(sizes)
        first, sizes = (np.cumsum(sizes) - sizes).tolist(), sizes.tolist()
        plan = plan_group(sizes, length)
        rows = [(i, start, n, (table["g"][0].as_py() << 32) | s, off) for s, seq in enumerate(plan) for (i, start, n), off in zip(seq, np.cumsum([0] + [p[2] for p in seq]).tolist(), strict=False)]
        which = [r[0] for r in rows]
        out = pa.table({
            "doc_id": table["id"].combine_chunks().take(pa.array(which, pa.int64())), "start": pa.array([r[1] for r in rows], pa.int64()), "length": pa.array([r[2] for r in rows], pa.int64()),
            "ids": pa.array([ids[first[i] + start : first[i] + start + n].tobytes() for i, start, n, _, _ in rows], pa.binary()), "doc_tokens": pa.array([sizes[i] for i in which], pa.int64()),
            "sequence_id": pa.array([r[3] for r in rows], pa.int64()), "offset": pa.array([r[4] for r in rows], pa.int64()),
        })
        trim_memory()
        return out

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups)).alias("g"), F.col(id_col).cast("long").alias("id"), text.alias("text"))
    return rows.groupBy("g").applyInArrow(work, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
