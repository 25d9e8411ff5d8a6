"""Regular-expression matches with their places, in DataFrame operations only.

Places are code points, ends exclusive. A text is split at its matches; lengths of pieces and matches, summed in order,
give the places. Patterns are possessive and anchored by what may stand before, so that no text makes them backtrack far.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256
SPAN = "array<struct<start:bigint,end:bigint,text:string>>"


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def placed(text: Column, pattern: str, found: Column) -> Column:
    """``array<struct<start, end, text>>`` of the matches ``found`` of ``pattern`` (all of group 0, in order).

    Lengths are summed in chunks of CHUNK matches, then within each, so that many matches in a text don't cost their square.
    """
    none, zero = F.array().cast(SPAN), F.lit(0).cast("bigint")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("text")))).alias("out"))

    def chunk(steps: Column, c: Column) -> Column:
        return F.slice(steps, c * CHUNK + 1, F.lit(CHUNK))

    def begins(steps: Column) -> Column:
        """Where each chunk begins, with its number."""
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / CHUNK).cast("int")), lambda c: F.aggregate(chunk(steps, c), zero, lambda acc, x: acc + F.length(x["gap"]) + F.length(x["hit"])))
        first = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.transform(F.aggregate(sums, first, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"]), lambda at, c: F.struct(at.alias("at"), c.alias("c")))

    def spans(steps: Column) -> Column:
        return F.flatten(F.transform(begins(steps), lambda b: F.aggregate(chunk(steps, b["c"]), F.struct(b["at"].alias("at"), none.alias("out")), step, lambda acc: acc["out"])))

    zipped = F.transform(F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("a"), found.alias("b")), lambda x: F.struct(x["a"].alias("gap"), x["b"].alias("hit")))
    return F.when(F.size(found) > 0, _let(zipped, spans)).otherwise(none)


def tagged(spans: Column, kind: str, order: int) -> Column:
    """Spans as ``struct<start, order, end, kind>``, the sort order of all outputs."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def written(spans: Column) -> Column:
    """``kind:start:end`` joined by commas, by start, then kind as listed."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
