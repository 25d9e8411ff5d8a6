"""Interval operators: overlap joins in buckets, enclosing symbols, the impact of changed lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as C

#: Lines in one bucket of the overlap join.
BUCKET = 64


def overlap(spans: DataFrame, ranges: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Pairs of ``spans`` (path, start_line, end_line, ...) and ``ranges`` (path, lo, hi) of one path that share a line.

    Both sides are cut into buckets of lines, so the join has an equality on path and bucket and no file's pairs meet in
    one task; a pair is reported in the first bucket the two share.
    """
    s = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_line") / bucket), F.floor(F.greatest("start_line", "end_line") / bucket))))
    r = ranges.select("path", "lo", "hi").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / bucket), F.floor(F.greatest("lo", "hi") / bucket))))
    pairs = s.join(r, ["path", "bucket"]).where((F.col("end_line") >= F.col("lo")) & (F.col("start_line") <= F.col("hi")))
    return pairs.where(F.col("bucket") == F.floor(F.greatest("start_line", "lo") / bucket)).drop("bucket")


def touched(symbols: DataFrame, ranges: DataFrame) -> DataFrame:
    """Symbols that any changed range overlaps, each once."""
    return symbols.join(overlap(symbols, ranges).select("symbol_id").distinct(), "symbol_id", "left_semi")


def callers_of(symbols: DataFrame, edges: DataFrame, hit: DataFrame) -> DataFrame:
    """``name, path, symbol_id`` of direct callers of ``hit``, one row per name and path (the smallest id)."""
    sources = edges.join(hit.select(F.col("symbol_id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("symbol_id")).distinct()
    return symbols.join(sources, "symbol_id").groupBy("name", "path").agg(F.min("symbol_id").alias("symbol_id"))


def impact(symbols: DataFrame, edges: DataFrame, ranges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(touched, callers, tests)`` of a change: callers in test paths apart from the others."""
    hit = touched(symbols, ranges)
    callers = callers_of(symbols, edges, hit)
    test = C.is_test_path(F.col("path"))
    return hit, callers.where(~test), callers.where(test)


def enclosing(frames: DataFrame, symbols: DataFrame, fallback: int = 10) -> DataFrame:
    """``frame_id, symbol_id, kind_of_hit``: symbols that enclose a frame's line; if none does, the first ``fallback`` of its file."""
    points = frames.select("frame_id", "path", F.col("line").alias("lo"), F.col("line").alias("hi"))
    inside = overlap(symbols, points.select("path", "lo", "hi").distinct())
    hit = points.join(inside.select("path", "lo", "symbol_id"), ["path", "lo"]).select("frame_id", "symbol_id", F.lit("line").alias("kind_of_hit"))
    missed = points.join(hit.select("frame_id").distinct(), "frame_id", "left_anti")
    w = Window.partitionBy("path").orderBy("start_line", "symbol_id")
    first = symbols.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= fallback)
    other = missed.join(first, "path").select("frame_id", "symbol_id", F.lit("file").alias("kind_of_hit"))
    return hit.unionByName(other)


def recommended_tests(changed: DataFrame, paths: DataFrame, found: DataFrame) -> DataFrame:
    """``path`` of tests to run: those named after a changed file's stem, and the tests already ``found`` by impact.

    Names meet on the stem that is left when ``test_`` or ``_test`` is taken off, so the join is an equality.
    """
    stem = F.regexp_extract(F.col("path"), r"([^/]+?)(\.[^./]*)?$", 1)
    name = C.file_name(F.col("path"))
    tested = F.coalesce(F.nullif(F.regexp_extract(name, r"^test_(.+)\.py$", 1), F.lit("")), F.nullif(F.regexp_extract(name, r"^(.+)_test\.py$", 1), F.lit("")))
    by_name = paths.withColumn("stem", tested).where("stem is not null").join(changed.select(stem.alias("stem")).distinct(), "stem", "left_semi").select("path")
    return by_name.unionByName(found.select("path")).distinct()
