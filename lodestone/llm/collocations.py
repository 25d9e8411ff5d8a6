"""Frequent phrases of each language and their collocation scores, mined level by level with hashed bucket counts (PCY, DHP).

A pass over the texts counts the phrases of one length exactly and, in the same scan, the phrases of the next length by
bucket only. Before the next pass two bitmaps of a fixed size are broadcast: the buckets that reached the support, and the
hashes of the phrases that did. A phrase is counted exactly only if its bucket passes and so do both its parts one word
shorter (Apriori); a longer phrase goes into a bucket only if its own parts are candidates. Bits may be set for other
phrases too, which costs counting and never changes a result: supports come from exact counts of whole phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, trim_memory

SUPPORT, LONGEST, TOP = 30, 4, 2_000
#: A longer phrase with this share of a candidate's count makes the candidate superfluous: numerator and denominator.
SHARE = (4, 5)
#: Buckets, and bits of each bitmap, as a power of two: 8 MB for a bitmap, 64 MB for a task's counters, at every size.
BITS = 26
#: Buckets of one row of counters.
CHUNK_BITS = 16
#: Bytes of text that are counted together before their counts are handed on; a longer text is counted by itself.
CHUNK_BYTES = 6_000_000
#: Candidates of a language are first cut to the top in so many parts.
SALT = 64

_TABLE = bytes(b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\x0a\x0b\x0c\x0d" else b for b in range(256))
_WORD = np.uint64(0x9E3779B97F4A7C15)
_SCHEMA = "lang string, phrase string, h long, n long, chunk int, counts binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values whose bits all depend on all bits of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split_text(text: bytes) -> list[bytes]:
    """Words of a text, and ``.`` at the end of every piece."""
    return text.translate(_TABLE).replace(b".", b" . ").split(None)


class _Words:
    """The words of many texts as numbers: ``code`` (-1 between pieces and texts), and for each number its language, word and hash."""

    def __init__(self, texts: list[tuple[str, bytes]]):
        langs: dict[str, int] = {}
        words, sizes, of = [], [], []
        for lang, text in texts:
            w = split_text(text)
            w.append(b".")
            words += w
            sizes.append(len(w))
            of.append(langs.setdefault(lang, len(langs)))
        coded = pa.array(words, pa.large_binary()).dictionary_encode()
        del words
        known = coded.dictionary.to_pylist()
        end = known.index(b".") if b"." in known else -1
        code = coded.indices.to_numpy().astype(np.int64)
        lang = np.repeat(np.array(of, np.int64), sizes)
        # A word of two languages is two words.
        pairs, self.code = np.unique(np.where(code == end, -1, lang * len(known) + code), return_inverse=True)
        if len(pairs) and pairs[0] < 0:
            pairs, self.code = pairs[1:], self.code - 1
        names, hashes = list(langs), [np.array([xxhash.xxh3_64_intdigest(x) for x in xs], np.uint64) for xs in (known, [n.encode() for n in langs])]
        self.lang, self.word = pairs // max(1, len(known)), pairs % max(1, len(known))
        self.hash = _mixed(hashes[0][self.word] + _mixed(hashes[1][self.lang] + _WORD))
        self.names, self.known = names, known

    def rows(self, at: np.ndarray, n: int, hashes: np.ndarray) -> pa.RecordBatch | None:
        """The phrases of ``n`` words that start at ``at``, each once with its hash and its number; exact, by number, not by hash."""
        if not len(at):
            return None
        key = self.code[at]
        for j in range(1, n):
            key = np.unique((key << 32) | self.code[at + j], return_inverse=True)[1]
        _, first, counts = np.unique(key, return_index=True, return_counts=True)
        where = at[first]
        ids = [self.word[self.code[where + j]].tolist() for j in range(n)]
        known = self.known
        phrases = [b" ".join([known[i] for i in p]).decode("utf-8", "replace") for p in zip(*ids)]
        langs = [self.names[i] for i in self.lang[self.code[where]]]
        return _batch(langs, phrases, hashes[first].view(np.int64), counts)

    def totals(self) -> pa.RecordBatch:
        """A row without a phrase for each language: all its words."""
        n = np.bincount(self.lang[self.code[self.code >= 0]], minlength=len(self.names))
        return _batch(self.names, [None] * len(n), np.zeros(len(n), np.int64), n)


def _batch(langs: list, phrases: list, h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    k = len(langs)
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.string()), pa.array(h, pa.int64()), pa.array(n, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=["lang", "phrase", "h", "n", "chunk", "counts"])


def _has(bits: np.ndarray, h: np.ndarray, size: int) -> np.ndarray:
    at = h >> np.uint64(64 - size)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0


def _scan(words: _Words, length: int, held: tuple | None, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and hashes of the phrases of ``length`` words that may be frequent, and hashes of those a word longer whose parts may be.

    ``held``: bits of the frequent phrases one word shorter, and of the buckets of this length.
    """
    n = len(words.code)
    may = words.code >= 0
    one = np.zeros(n, np.uint64)
    one[may] = words.hash[words.code[may]]
    h = one

    def longer(may: np.ndarray, h: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """From phrases of m - 1 words to phrases of m whose two parts both may be frequent."""
        both, out = np.zeros(n, bool), np.zeros(n, np.uint64)
        both[:-1] = may[:-1] & may[1:]
        at = np.flatnonzero(both)
        out[at] = _mixed(h[at] * _WORD + one[at + m - 1])
        return both, out

    if held:
        for m in range(2, length):
            may, h = longer(may, h, m)
        may[may] = _has(held[0], h[may], bits)
        may, h = longer(may, h, length)
        may[may] = _has(held[1], h[may], bits)
    nxt, longer_h = longer(may, h, length + 1)
    at = np.flatnonzero(may)
    return at, h[at], longer_h[nxt]


def _count(counters: np.ndarray, h: np.ndarray, bits: int) -> None:
    """Add to the buckets' counters, which stop at 255."""
    at = (h >> np.uint64(64 - bits)).astype(np.uint32)
    at.sort()
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    n, at = np.diff(np.append(first, len(at))), at[first]
    counters[at] = np.minimum(counters[at] + n, 255)


def _packed(counters: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """The chunks of counters that hold any, compressed."""
    z = zstandard.ZstdCompressor(level=1)
    for at in range(0, len(counters), size * 64):
        some = [(k // size, z.compress(counters[k : k + size].tobytes())) for k in range(at, min(at + size * 64, len(counters)), size) if counters[k : k + size].any()]
        if some:
            none = pa.nulls(len(some), pa.string())
            zero = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, zero, zero, pa.array([c for c, _ in some], pa.int32()), pa.array([b for _, b in some], pa.binary())], names=["lang", "phrase", "h", "n", "chunk", "counts"])


def _pass(docs: DataFrame, length: int, longest: int, held: Broadcast | None, bits: int) -> DataFrame:
    """One scan of the texts: exact counts of phrases of ``length`` words, and bucket counts of those a word longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << bits, np.uint8) if length < longest else None
        texts, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            words = _Words(texts)
            at, h, longer = _scan(words, length, held.value if held else None, bits)
            if length == 1:
                yield words.totals()
            if len(at):
                yield words.rows(at, length, h)
            if counters is not None:
                _count(counters, longer, bits)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                texts.append((lang, text.as_py() or b""))
                size += len(texts[-1][1]) + 1
                if size >= CHUNK_BYTES:
                    yield from flush()
                    texts, size = [], 0
        if texts:
            yield from flush()
        if counters is not None:
            yield from _packed(counters, min(1 << CHUNK_BITS, len(counters)))
        trim_memory()

    return docs.mapInArrow(run, _SCHEMA)


def _buckets(counted: DataFrame, support: int, bits: int) -> np.ndarray:
    """The bits of the buckets that reached the support: chunks of counters are summed where they meet, and come back as bits."""
    size = min(1 << CHUNK_BITS, 1 << bits)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for k, b in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(z.decompress(b.as_py()), np.uint8)
                sums[k] = np.minimum(sums[k].astype(np.uint16) + part, 255).astype(np.uint8) if k in sums else part
        for k, v in sums.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "bits": pa.array([np.packbits(v >= min(support, 255), bitorder="little").tobytes()], pa.binary())})

    out = np.zeros((1 << bits) // 8, np.uint8)
    parts = counted.where("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(add, "chunk int, bits binary")
    for r in parts.toLocalIterator():  # a chunk is 8 KB, all of them one bitmap
        out[r["chunk"] * size // 8 : (r["chunk"] + 1) * size // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _bitmap(frequent: DataFrame, bits: int) -> np.ndarray:
    """The bits of the frequent phrases' hashes."""
    out = np.zeros((1 << bits) // 8, np.uint8)
    at = F.shiftrightunsigned("h", 64 - bits)
    parts = frequent.select((F.shiftright(at, 15)).alias("part"), at.bitwiseAND(F.lit(32_767)).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    for r in parts.collect():  # 4 KB each, all of them one bitmap
        b = np.frombuffer(r["bits"], np.uint8)[: len(out)]
        out[r["part"] * 4_096 : r["part"] * 4_096 + len(b)] = b
    return out


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text", bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, a`` of all phrases of at most ``longest`` words with ``a >= support``, and ``lang, n`` (all word occurrences).

    A null language is ``und``, a null text is empty; other columns are not read; ids are not asked for, so repeated rows count
    repeatedly. An empty table gives two empty results. ``bits`` is at least 15.
    """
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    held, totals, out = None, None, None
    for length in range(1, longest + 1):
        counted = materialize(_pass(rows, length, longest, held, bits), "counted")
        if length == 1:
            totals = materialize(counted.where("phrase is null and chunk is null").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        level = materialize(counted.where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("a"), F.min("h").alias("h")).where(F.col("a") >= support), "level")
        found = level.select("lang", "phrase", F.lit(length).alias("words"), "a")
        out = found if out is None else out.unionByName(found)
        if length < longest:
            if held:
                held.unpersist()
            held = docs.sparkSession.sparkContext.broadcast((_bitmap(level, bits), _buckets(counted, support, bits)))
        discard(counted)
    return out, totals


def scored(phrases: DataFrame) -> DataFrame:
    """``lang, phrase, a, k, l, r, score`` of the phrases of two words and more that no longer one makes superfluous."""
    p = phrases.where("words > 1").select("lang", "phrase", "a", F.split("phrase", " ").alias("w"))
    part = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    cuts = p.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.size("w")).alias("rest"))
    of = lambda name, n: phrases.select("lang", F.col("phrase").alias(name), F.col("a").alias(n))
    both = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    score = F.expr("cast(cast(a as decimal(20, 0)) * 2000000 div cast(cast(l as decimal(20, 0)) + r as decimal(28, 0)) as long)")
    best = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.*")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: part(i, n))))
    longer = p.where(F.size("w") > 2).select("lang", F.col("a").alias("of"), F.explode(F.array_distinct(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("of").alias("of"))
    return best.join(longer, ["lang", "phrase"], "left").where(F.col("of").isNull() | (SHARE[1] * F.col("of") < SHARE[0] * F.col("a"))).drop("of")


def collocations(docs: DataFrame, top: int = TOP, **how) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language by score, count and phrase (byte order).

    A language's candidates are cut to the top in parts first, so no task gets all of them.
    """
    phrases, totals = frequent_phrases(docs, **how)
    found = scored(phrases).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALT)))
    by = [F.desc("score"), F.desc("a"), "phrase"]
    cut = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*by))).where(F.col("rank") <= top).drop("rank", "salt")
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
