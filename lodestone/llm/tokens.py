"""Fast, exact encoding of text batches with a byte-level BPE of the ``tokenizers`` library.

In these vocabularies a space between two non-space characters always starts a new piece, so a text's ids are the ids of
its space-led chunks put together. A batch is split and dictionary-encoded by Arrow and only its distinct chunks go
through the tokenizer, if a bounded table of chunks that the process has met doesn't have them; texts with other runs of
white space go through it whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_GROUP = 64
#: Chunks remembered by a worker process, about 50 bytes each; beyond this number those that did not recur are forgotten.
KNOWN_CHUNKS = 600_000
#: New chunks that are merged into the table at once.
_RECENT = 100_000
#: Longer chunks are hashed one by one.
_LONG = 512
#: Bytes that are hashed at once.
_PIECE = 1 << 19
_RNG = np.random.default_rng(4)
_BYTES = _RNG.integers(0, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _RNG.integers(0, 2**63, (2, _LONG), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _hashes(words: pa.LargeStringArray) -> np.ndarray:
    """Two 64-bit hashes of each string: sums of products of what stands for a byte and for its place."""
    n = len(words)
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    size = np.diff(at)
    out = np.zeros((2, n), np.uint64)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + _PIECE, side="right")) - 1)
        lo, ends = at[first], at[first : last + 1] - at[first]
        part = data[lo : lo + ends[-1]]
        place = (np.arange(len(part)) - np.repeat(ends[:-1], np.diff(ends))) & (_LONG - 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        for k in (0, 1):
            np.cumsum(_BYTES[k][part] * _PLACES[k][place], out=sums[1:])
            x = sums[ends[1:]] - sums[ends[:-1]] + size[first:last].astype(np.uint64)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            out[k, first:last] = x ^ (x >> np.uint64(32))
        first = last
    for i in np.flatnonzero(size > _LONG):
        out[:, i] = np.frombuffer(xxhash.xxh3_128_digest(words[int(i)].as_py().encode("utf-8", "surrogatepass")), np.uint64)
    return out


class _Places:
    """Where chunks stand, by their two hashes; sorted by the first."""

    def __init__(self, keys: np.ndarray, place: np.ndarray):
        order = np.argsort(keys[0], kind="stable")
        self.keys, self.place = keys[:, order], place[order]

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.place):
            return np.full(keys.shape[1], -1)
        at = np.minimum(np.searchsorted(self.keys[0], keys[0]), len(self.place) - 1)
        return np.where((self.keys[0, at] == keys[0]) & (self.keys[1, at] == keys[1]), self.place[at], -1)


def _open_ended(chunk: str) -> bool:
    """Whether the space that follows may not start a new piece."""
    return not chunk or chunk[-1].isspace()


class ChunkEncoder:
    """``encode(texts)`` gives the ids of all texts end to end, and where each text ends."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.lengths = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], dtype=np.int64)
        self._forget()

    def _forget(self) -> None:
        self.known = self.recent = _Places(np.zeros((2, 0), np.uint64), np.zeros(0, np.int64))
        self.keys, self.flat, self.ends = np.zeros((2, 0), np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.again, self.open = np.zeros(0, bool), np.zeros(0, bool)

    def _keep_recurring(self) -> None:
        """Forget chunks met in one batch only; all, if too many recur."""
        keep = np.flatnonzero(self.again)
        if len(keep) > KNOWN_CHUNKS // 2:
            return self._forget()
        begins = np.concatenate([[0], self.ends[:-1]])
        n = self.ends[keep] - begins[keep]
        stops = np.cumsum(n)
        self.flat = self.flat[np.arange(n.sum()) + np.repeat(begins[keep] - (stops - n), n)]
        self.keys, self.ends, self.again, self.open = self.keys[:, keep], stops, np.zeros(len(keep), bool), self.open[keep]
        self.known, self.recent = _Places(self.keys, np.arange(len(keep))), _Places(self.keys[:, :0], np.zeros(0, np.int64))

    def _places(self, words: pa.LargeStringArray) -> np.ndarray:
        """The index of each of the distinct ``words`` in the table of known chunks, which learns the new ones."""
        if len(self.ends) > KNOWN_CHUNKS:
            self._keep_recurring()
        keys = _hashes(words)
        at = self.known.find(keys)
        rest = np.flatnonzero(at < 0)
        at[rest] = self.recent.find(keys[:, rest])
        new = np.flatnonzero(at < 0)
        self.again[at[at >= 0]] = True
        if len(new):
            fresh = (words if len(new) == len(words) else words.take(pa.array(new))).to_pylist()
            ids, ends = self._chunks(fresh)
            first = len(self.ends)
            self.ends = np.concatenate([self.ends, ends + len(self.flat)])
            self.flat = np.concatenate([self.flat, ids])
            at[new] = np.arange(first, len(self.ends))
            self.keys = np.concatenate([self.keys, keys[:, new]], axis=1)
            self.again = np.concatenate([self.again, np.zeros(len(new), bool)])
            self.open = np.concatenate([self.open, np.fromiter(map(_open_ended, fresh), bool, len(fresh))])
            settled = len(self.known.place)
            if len(self.ends) - settled > _RECENT:
                self.known, settled = _Places(self.keys, np.arange(len(self.ends))), len(self.ends)
            self.recent = _Places(self.keys[:, settled:], np.arange(settled, len(self.ends)))
        return at

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the distinct chunks (each led by a space) end to end, and each one's end; wrong for open-ended ones, which nothing reads."""
        sizes = pc.binary_length(pa.array(strings, pa.large_string())).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        groups = [" " + " ".join(strings[i : i + _GROUP]) for i in range(0, len(strings), _GROUP)]
        ids = np.concatenate([np.zeros(0, np.uint32), *self._whole(groups)])
        # A vocabulary entry has one character for each byte, so ends in bytes tell ends in ids.
        ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes), side="left") + 1
        return ids, ends

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        parts = pc.split_pattern(texts, " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        words, offsets = parts.flatten(), offsets - offsets[0]
        coded = words.dictionary_encode()
        index = self._places(coded.dictionary)[coded.indices.to_numpy()]
        first, last = offsets[:-1], offsets[1:] - 1
        # A first chunk has no space before it; an empty one is the start of a text that starts with one space.
        lead, which = np.unique(coded.indices.to_numpy()[first], return_inverse=True)
        leads = self._whole(coded.dictionary.take(pa.array(lead)).to_pylist())
        begins = np.concatenate([[0], self.ends])[index]
        n = self.ends[index] - begins
        open_ = self.open[index]
        empty_start = np.array([len(x) == 0 for x in leads], bool)[which] & (first < last)
        open_[first] &= ~empty_start
        whole = np.flatnonzero(np.logical_or.reduceat(open_, first))
        extra = leads + self._whole(texts.take(pa.array(whole)).to_pylist())
        sizes = np.array([len(x) for x in extra], np.int64)
        places = len(self.flat) + np.cumsum(sizes) - sizes
        begins[first], n[first] = places[which], sizes[which]
        if len(whole):
            gone = np.zeros(len(first), bool)
            gone[whole] = True
            n[np.repeat(gone, np.diff(offsets))] = 0
            begins[first[whole]], n[first[whole]] = places[len(leads) :], sizes[len(leads) :]
        stops = np.cumsum(n)
        kind = np.int32 if stops[-1] < 1 << 30 and len(self.flat) + sizes.sum() < 1 << 30 else np.int64
        where = np.repeat((begins - (stops - n)).astype(kind), n)
        where += np.arange(len(where), dtype=kind)
        return np.concatenate([self.flat, *extra])[where], stops[last]


def slices(texts: pa.Array | list[str], most_bytes: int = 4 << 20) -> list[range]:
    """Index ranges of at most about so many bytes (or one text), so that memory is bounded whatever the texts' lengths."""
    texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts
    out, start, held = [], 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if held and held + n > most_bytes:
            out.append(range(start, i))
            start, held = i, 0
        held += n
    if start < len(texts):
        out.append(range(start, len(texts)))
    return out


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each file and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
