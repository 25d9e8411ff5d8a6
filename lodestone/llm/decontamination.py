"""Benchmark passages in documents, found by one Aho-Corasick automaton in a single scan of each text.

Benchmark items (questions and answers, a row each) are cut into windows of consecutive words. All windows make one
automaton over normalised text: A-Z lower-cased, words joined by one space with a space at both ends, so that a match
always is a run of whole words. It is broadcast, and every document's normalised bytes pass through it once; the words
that matches cover are mapped back to offsets in the original text. Documents are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, in_pieces, materialize, trim_memory
from .exact_dedup import normalised

#: Consecutive words of an item that make a window; an item of fewer words, but not none, is one window.
WINDOW = 10
#: Words of normalised text: runs of 0-9, a-z and everything beyond ASCII.
NORMAL_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of windows and item ids in one automaton, which takes about 100 bytes of memory for each. More windows make more
#: automata, and each takes a further scan of the documents.
AUTOMATON_BYTES = 4_000_000

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: ASCII bytes as they are after normalisation; bytes beyond ASCII belong to words.
_TABLE = bytes(b if b >= 128 or b in _KEPT else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

_FOUND = "n_words long, n_hit long, hits array<struct<first:int,last:int>>, items array<string>, spans array<struct<start:int,end:int>>"


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """``item, window``: the distinct windows of each item, words joined by one space; ``item`` is the id as a string."""
    w = items.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.regexp_extract_all(normalised(text_col), F.lit(NORMAL_WORD), F.lit(0)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))
    return w.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, size), " "))).alias("window")).distinct()


def automaton(rows: list[tuple[str | None, str]]) -> tuple[ahocorasick.Automaton, list[int], list[list[str]]]:
    """The automaton of (item, window) rows, whose values are numbers of windows; each window's bytes, and its items."""
    number: dict[str, int] = {}
    owners: list[list[str]] = []
    for item, window in rows:
        k = number.setdefault(window, len(owners))
        if k == len(owners):
            owners.append([])
        if item is not None:
            owners[k].append(item)
    a = ahocorasick.Automaton()
    sizes = []
    for window, k in number.items():
        key = f" {window} ".encode().decode("latin-1")  # a character for each byte
        a.add_word(key, k)
        sizes.append(len(key))
    a.make_automaton()
    return a, sizes, owners


def scan(text: bytes, machine: tuple, hits: list | None = None, items: list | None = None) -> tuple:
    """Number of words, hit words, merged runs of hit words, items, and the runs as code points of the original text.

    ``hits`` and ``items`` are what scans with other automata found.
    """
    a, sizes, owners = machine
    flat = text.translate(_TABLE)
    words = flat.split()
    found = list(a.iter(f" {b' '.join(words).decode('latin-1')} ")) if words and owners else []
    if not found and not hits:
        return len(words), 0, [], items or [], []
    mark = np.zeros(len(words) + 1, np.int64)
    for h in hits or []:
        mark[h["first"]] += 1
        mark[h["last"] + 1] -= 1
    if found:
        last, which = np.array(found).T
        ends = np.cumsum([len(w) + 1 for w in words])  # where the space after each word stands
        np.add.at(mark, np.searchsorted(ends, last - np.array(sizes)[which] + 1, "left") + (last - np.array(sizes)[which] + 1 > 0), 1)
        np.add.at(mark, np.searchsorted(ends, last, "left") + 1, -1)
        items = sorted({*(items or []), *(x for k in np.unique(which) for x in owners[k])})
    hit = np.concatenate([[False], np.cumsum(mark)[:-1] > 0, [False]])
    first, after = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(~hit[1:] & hit[:-1])
    inside = np.concatenate([[False], np.frombuffer(flat, np.uint8) != 32, [False]])
    begins, stops = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    runs = [{"first": int(i), "last": int(j) - 1} for i, j in zip(first, after)]
    spans = [{"start": int(points[begins[r["first"]]]), "end": int(points[stops[r["last"]]])} for r in runs]
    return len(words), int(hit.sum()), runs, items or [], spans


def _scanner(held: Broadcast) -> Column:
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("hits", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    @F.arrow_udf(_FOUND)
    def find(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        machine = automaton(held.value)
        for texts, hits, items in batches:
            out = [scan(t.as_py() or b"", machine, h.as_py(), i.as_py()) for t, h, i in zip(texts, hits, items)]
            yield pa.array([dict(zip(kind.names, x)) for x in out], kind)
        trim_memory()

    return find


def contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, most: int = AUTOMATON_BYTES) -> DataFrame:
    """``docs`` with a struct ``found``: n_words, n_hit, hits (runs of words), items (sorted ids as strings), spans (code points, end exclusive).

    A document word is hit inside any occurrence of any window; adjacent and overlapping hits are one run. A null text has
    no words, and an item without words no window. An item of null id marks words and is not listed; items that share an id
    are one item, repeated windows one window. ``found`` replaces an input column of that name; all others stay, whatever
    their names. Rows are independent of one another, so repeated and null ids need no care.
    """
    keep = [c for c in docs.columns if c != "found"]
    wanted = materialize(windows(items, item_id, item_text, size), "windows")
    total = wanted.agg(F.coalesce(F.sum(F.octet_length("window") + F.coalesce(F.octet_length("item"), F.lit(0)) + 2), F.lit(0))).first()[0]
    blocks = max(1, -(-total // most))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row") if keep else F.struct(F.lit(0)).alias("row"), F.col(f"`{text_col}`").cast("binary").alias("text"), F.lit(None).cast(f"struct<{_FOUND.replace(' long', ':bigint').replace(' array', ':array')}>").alias("found"))
    before = None
    for b in range(blocks):
        block = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == b)
        held = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in block.select("item", "window").collect()])
        rows = rows.select("row", "text", _scanner(held)("text", "found.hits", "found.items").alias("found"))
        if b < blocks - 1:
            rows = materialize(rows, "scanned")
            if before is not None:
                discard(before)
            before = rows
    return rows.select("row.*" if keep else F.lit(0).alias("row"), "found")


def without_passages(docs: DataFrame, items: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """``docs`` with the benchmark passages cut out of their texts; rows and other columns stay, null texts stay null."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col(f"`{text_col}`").alias("text"))
    found = contaminated(whole, items, "text", **how)
    t, n = F.col("text"), F.size("found.spans")
    after = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.element_at(F.col("found.spans"), F.greatest(i, F.lit(1)))["end"])
    upto = lambda i: F.when(i == n, F.length(t)).otherwise(F.element_at(F.col("found.spans"), F.least(i + 1, n))["start"])
    rest = F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: F.substr(t, after(i) + 1, upto(i) - after(i))), "")
    return found.select(*[F.when(n > 0, rest).otherwise(t).alias(c) if c == text_col else F.col("whole").getField(c).alias(c) for c in docs.columns])


def op11_rows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    found = contaminated(docs.select("doc_id", "text"), items)
    return found.select("doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"), F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), (F.col("found.n_hit") > 0).alias("contaminated"))
