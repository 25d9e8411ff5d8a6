"""Token ids in seekable Zstandard files.

A file is a run of independent Zstandard frames of little-endian 32-bit ids, a skippable frame with the directory of
its documents, and the trailing seek table of the public seekable format, which gives each frame's compressed and plain
size and the low half of its XXH64. A reader fetches the tail, then only the frames of the documents it wants.
A frame never holds parts of two documents unless it holds them whole; a long document takes several frames.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch_path, trim_memory
from .tokens import encoder, slices

# Fixed values of the seekable format.
SKIPPABLE_DIRECTORY, SKIPPABLE_SEEK_TABLE, SEEK_MAGIC, CHECKSUM_FLAG = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
FRAME_IDS = 1 << 16
END_ID = 0


class TokenFileWriter:
    """Write documents in order with ``add``; ``close`` ends the file with directory and seek table."""

    def __init__(self, stream, level: int = 3, frame_ids: int = FRAME_IDS):
        self.stream, self.frame_ids = stream, frame_ids
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.table: list[tuple[int, int, int]] = []
        self.docs: list[int | None] = []
        self.sizes: list[int] = []

    def _flush(self) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        for at in range(0, len(ids), self.frame_ids):
            plain = ids[at : at + self.frame_ids].astype("<u4").tobytes()
            packed = self.compressor.compress(plain)
            self.stream.write(packed)
            self.table.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.held, self.n_held = [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.n_held + len(ids) > self.frame_ids:
            self._flush()
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        self.docs.append(doc_id)
        self.sizes.append(len(ids))

    def close(self) -> None:
        self._flush()
        known = np.array([d is not None for d in self.docs], dtype=np.uint8)
        plain = struct.pack("<Q", len(self.docs)) + np.array([d or 0 for d in self.docs], "<i8").tobytes() + known.tobytes() + np.array(self.sizes, "<u8").tobytes()
        packed = self.compressor.compress(plain)
        self.stream.write(struct.pack("<II", SKIPPABLE_DIRECTORY, len(packed)) + packed)
        entries = b"".join(struct.pack("<III", *x) for x in self.table)
        self.stream.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEK_MAGIC))
        self.stream.close()


class TokenFileReader:
    """Random access by document; ``stream`` must seek. A wrong checksum or magic raises ValueError."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.seek(0, 2) or stream.tell()
        stream.seek(size - 9)
        frames, flags, magic = struct.unpack("<IBI", stream.read(9))
        if magic != SEEK_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("not a seekable token file")
        stream.seek(size - 9 - 12 * frames)
        self.table = np.frombuffer(stream.read(12 * frames), "<u4").reshape(frames, 3).astype(np.int64)
        self.frame_at = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        self.plain_at = np.concatenate([[0], np.cumsum(self.table[:, 1])]) // 4
        self.decompressor = zstandard.ZstdDecompressor()
        stream.seek(int(self.frame_at[-1]))
        kind, length = struct.unpack("<II", stream.read(8))
        if kind != SKIPPABLE_DIRECTORY:
            raise ValueError("no directory")
        plain = self.decompressor.decompress(stream.read(length))
        n = struct.unpack_from("<Q", plain)[0]
        self.doc_ids, known = np.frombuffer(plain, "<i8", n, 8), np.frombuffer(plain, np.uint8, n, 8 + 8 * n)
        self.known = known.astype(bool)
        self.sizes = np.frombuffer(plain, "<u8", n, 8 + 9 * n).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1] if n else np.zeros(0, np.int64)
        self.frames_read = 0
        self._last: tuple[int, np.ndarray] = (-1, np.zeros(0, "<u4"))

    def frame(self, k: int) -> np.ndarray:
        if self._last[0] != k:
            self.stream.seek(int(self.frame_at[k]))
            plain = self.decompressor.decompress(self.stream.read(int(self.table[k, 0])), max_output_size=int(self.table[k, 1]))
            if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.table[k, 2]:
                raise ValueError(f"frame {k} is damaged")
            self.frames_read += 1
            self._last = (k, np.frombuffer(plain, "<u4"))
        return self._last[1]

    def document(self, nth: int) -> np.ndarray:
        """The ids of the file's ``nth`` document; only the frames that hold it are decompressed."""
        first, last = int(self.starts[nth]), int(self.starts[nth] + self.sizes[nth])
        k = int(np.searchsorted(self.plain_at, first, side="right")) - 1
        out = []
        while first < last:
            at, to = int(self.plain_at[k]), int(self.plain_at[k + 1])
            out.append(self.frame(k)[first - at : min(last, to) - at])
            first, k = min(last, to), k + 1
        return np.concatenate(out) if out else np.zeros(0, "<u4")

    def find(self, doc_id: int) -> list[int]:
        return np.flatnonzero((self.doc_ids == doc_id) & self.known).tolist()


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store behind a folder's address and the path in it; Hadoop's names of object stores are taken as pyarrow's."""
    for theirs, ours in (("s3a://", "s3://"), ("s3n://", "s3://")):
        uri = ours + uri[len(theirs) :] if uri.startswith(theirs) else uri
    return pafs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode every text, append ``end_id`` and write files in ascending id order; returns their manifest.

    Manifest: ``part, path, n_docs, n_ids``; files of lost or repeated task attempts are not in it. A null text is an
    empty one and gives the end id alone; null ids come first; rows that repeat an id follow each other by text. An
    empty input gives no files. ``path`` is a folder that all executors reach; by default one in the shared folder.
    """
    path = path or scratch_path(docs.sparkSession, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        fs, root = filesystem(path)
        writer, name = None, f"{root}/part-{part:06d}-{uuid.uuid4().hex}.szt"
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("id").to_pylist()
            for span in slices(texts):
                flat, ends = enc.encode(texts[span.start : span.stop])
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    writer = TokenFileWriter(fs.open_output_stream(name))
                flat, start = np.insert(flat, ends, end_id).astype("<u4", copy=False), 0
                for i, stop in zip(span, (ends + np.arange(1, len(ends) + 1)).tolist(), strict=True):
                    writer.add(ids[i], flat[start:stop])
                    start = stop
        trim_memory()
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [name], "n_docs": [len(writer.docs)], "n_ids": [writer.n_ids]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(F.col("id")).sortWithinPartitions("id", "text")
    manifest = materialize(ordered.mapInArrow(write, "part long, path string, n_docs long, n_ids long"), "manifest")
    manifest.lodestone_files = path
    return manifest


def read_token_files(manifest: DataFrame, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document: ids as little-endian 32-bit binary, start as ids of all documents before.

    The manifest has a row for each file, so the driver sums the files' sizes.
    """
    spark = manifest.sparkSession
    files, base = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):
        files.append((r["path"], base))
        base += r["n_ids"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(path)
        for batch in batches:
            for name, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with fs.open_input_file(name) as stream:
                    reader = TokenFileReader(stream)
                    first, held = 0, 0
                    ids: list[bytes] = []
                    for i in range(len(reader.sizes)):
                        ids.append(reader.document(i).tobytes())
                        held += len(ids[-1])
                        if held > 8_000_000 or i == len(reader.sizes) - 1:
                            at = slice(first, i + 1)
                            yield pa.RecordBatch.from_pydict({
                                "doc_id": pa.array(reader.doc_ids[at], pa.int64(), mask=~reader.known[at]), "start": pa.array(reader.starts[at] + base), "n_tokens": pa.array(reader.sizes[at]), "ids": pa.array(ids, pa.binary())
                            })
                            first, held, ids = i + 1, 0, []

    todo = spark.createDataFrame(files, "path string, base long")
    return todo.repartition(max(1, min(len(files), 10_000))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
