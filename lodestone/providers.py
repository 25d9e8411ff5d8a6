"""What a caller may plug in: token counters, embedders and parsers. The defaults need no network and no model."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import text as T


class TokenCounter(Protocol):
    def count(self, texts: Sequence[str]) -> list[int]: ...


class Embedder(Protocol):
    """``least``, if there is one, is the cosine from which a hit counts."""

    name: str

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        """One row of floats for each text."""


class PatternTokenCounter:
    """The engine's stand-in for a tokenizer: words and single signs, as ``functions.text.token_count`` counts them."""

    def count(self, texts: Sequence[str]) -> list[int]:
        return [len(re.findall(T.TOKEN, t)) for t in texts]


class FileTokenCounter:
    """Counts with a vocabulary file of the ``tokenizers`` library; loaded by each worker on first use."""

    def __init__(self, path: str):
        self.path, self._tokenizer = path, None

    def __getstate__(self) -> dict:
        return {"path": self.path, "_tokenizer": None}

    def count(self, texts: Sequence[str]) -> list[int]:
        if self._tokenizer is None:
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
        return [len(e.ids) for e in self._tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]


class HashingEmbedder:
    """Signed feature hashing of sub-words and their three-letter pieces, scaled to unit length: texts that share identifiers are close."""

    #: Cosine under which a hit is chance.
    least = 0.35

    def __init__(self, dims: int = 256):
        self.name, self.dims = f"hashing-{dims}", dims

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"[a-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text).lower()):
                for piece, weight in [(word, 1.0), *((f"^{word}$"[i : i + 3], 0.3) for i in range(len(word)))]:
                    h = zlib.crc32(piece.encode())
                    row[h % self.dims] += weight if h >> 31 else -weight
            norm = float(np.sqrt((row * row).sum()))
            if norm:
                row /= norm
        return out


def token_counts(text: Column, counter: TokenCounter) -> Column:
    """Tokens of each text by a plugged-in counter; a null text has none. The default counter stays inside the JVM."""
    if isinstance(counter, PatternTokenCounter):
        return T.token_count(text)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(counter.count(texts.fillna("").tolist()), dtype="int64")

    return count(text)


def embedded(rows: DataFrame, id_col: str, text: Column, embedder: Embedder) -> DataFrame:
    """``id, model, embedding`` of each row's text; a null text counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "model": embedder.name, "embedding": list(embedder.embed(pdf["text"].tolist()))})

    kind = dict(rows.select(id_col).dtypes)[id_col]
    out = rows.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text")).mapInPandas(run, f"id {kind}, model string, embedding array<float>")
    return out.withColumnRenamed("id", id_col)


#: Parsers by language that replace or extend the built-in ones: text to (symbols, imports), see ``operators.parse``.
Parser = Callable[[str], tuple[list[dict], list[str]]]
PARSERS: dict[str, Parser] = {}


def register_parser(language: str, parser: Parser) -> None:
    """Use ``parser`` for files of ``language``. Symbols are dicts of name, kind, start_line, end_line, refs, doc, body."""
    PARSERS[language] = parser
