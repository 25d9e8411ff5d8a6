"""Sources from version control and JSON: commit logs, status lines, name-status deltas, model lists, commit touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Separators of fields and records in an exported commit log.
FIELD, RECORD = "\x1f", "\x1e"


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def commits(exports: DataFrame, text_col: str = "value") -> DataFrame:
    """``commit_hash, author, secs, message, summary`` from exported logs: records of hash, author, ISO time, subject and perhaps a body."""
    rows = exports.select(F.explode(F.transform(F.split(text_col, RECORD), lambda x: F.split(x, FIELD))).alias("r")).where(F.size("r") >= 4)
    part = lambda i: _strip(F.get("r", F.lit(i)))
    body = F.coalesce(part(4), F.lit(""))
    message = F.when(body != "", F.concat(part(3), F.lit("\n"), body)).otherwise(part(3))
    return rows.select(part(0).alias("commit_hash"), part(1).alias("author"), F.unix_seconds(F.try_to_timestamp(part(2))).alias("secs"), message.alias("message"), part(3).alias("summary"))


def status_path(line: Column) -> Column:
    """The path of a short status line: what a rename arrow points to, without quotes."""
    rest = F.trim(F.substring(line, 4, 1_000_000))
    target = F.when(rest.contains(" -> "), F.element_at(F.split(rest, " -> "), -1)).otherwise(rest)
    return F.regexp_replace(target, '^"|"$', "")


def status(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """``path, state, untracked`` of short status lines; lines too short for a path are left out."""
    line = F.col(line_col)
    return lines.where(F.length(line) > 3).select(status_path(line).alias("path"), F.trim(F.substring(line, 1, 2)).alias("state"), line.startswith("??").alias("untracked"))


def name_status(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """``change, path, old_path`` of tab-separated name-status lines: A, M, D, and R with its score dropped."""
    p = F.split(line_col, "\t")
    kind = F.substring(F.get(p, F.lit(0)), 1, 1)
    moved = kind == "R"
    out = lines.select(kind.alias("change"), F.when(moved, F.get(p, F.lit(2))).otherwise(F.get(p, F.lit(1))).alias("path"), F.when(moved, F.get(p, F.lit(1))).alias("old_path"))
    return out.where(F.col("change").isin("A", "M", "D", "R") & F.col("path").isNotNull())


def model_names(json: Column) -> Column:
    """Names in a provider's model list, in either of its two shapes; none for anything else."""
    x = F.from_json(json, "models array<struct<name:string,model:string>>, data array<struct<id:string>>")
    none = F.array().cast("array<string>")
    a = F.transform(F.coalesce(x["models"], F.array().cast("array<struct<name:string,model:string>>")), lambda m: F.coalesce(m["name"], m["model"]))
    b = F.transform(F.coalesce(x["data"], F.array().cast("array<struct<id:string>>")), lambda m: m["id"])
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(F.concat(a, b), lambda n: n.isNotNull() & (n != "")))), none)


def model_matches(wanted: Column, available: Column) -> Column:
    """Whether two model names mean one model: equal, or equal where one leaves out its tag or has the tag ``latest``."""
    a, b = F.lower(F.trim(wanted)), F.lower(F.trim(available))
    bare = lambda x: F.regexp_replace(x, ":latest$", "")
    stem = lambda x: F.regexp_extract(x, "^[^:]*", 0)
    return (a != "") & ((a == b) | (bare(a) == b) | (a == bare(b)) | (~a.contains(":") & (stem(b) == a)) | (~b.contains(":") & (stem(a) == b)))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; what doesn't parse becomes a row of nulls and keeps its text in ``_corrupt``."""
    return spark.read.schema(schema + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def lineage(symbols: DataFrame, changes: DataFrame, log: DataFrame, most: int = 10) -> DataFrame:
    """``symbol_id, commit_hash, secs, message``: the last ``most`` commits that changed a symbol's lines, its range carried back through the hunks (``history.lineage``)."""
    from ..operators import history

    found = history.lineage(symbols, changes)
    w = Window.partitionBy("symbol_id").orderBy(F.desc("gen"), "commit_hash")
    last = found.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)
    return last.select("symbol_id", "commit_hash").distinct().join(log.select("commit_hash", "secs", "message"), "commit_hash")


def lineage_by_content(symbols: DataFrame, versions: DataFrame, log: DataFrame, known: DataFrame | None = None, most: int = 10) -> DataFrame:
    """The same of the commits that changed how often a symbol's name stands in its file (``history.pickaxe``), for symbols without ``known`` lineage."""
    from ..operators import history

    s = symbols.select("symbol_id", "path", "name")
    s = s if known is None else s.join(known.select("symbol_id").distinct(), "symbol_id", "left_anti")
    found = s.join(history.pickaxe(s, versions), ["path", "name"])
    w = Window.partitionBy("symbol_id").orderBy(F.desc("gen"), "commit_hash")
    last = found.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)
    return last.select("symbol_id", "commit_hash").distinct().join(log.select("commit_hash", "secs", "message"), "commit_hash")


def recent_commits(touches: DataFrame, log: DataFrame, k: int = 5) -> DataFrame:
    """``path, rank, commit_hash, secs, summary``: the last ``k`` commits (newest first, then by hash) that touched each path."""
    each = touches.select("path", "commit_hash").distinct().join(log.select("commit_hash", "secs", "summary"), "commit_hash")
    w = Window.partitionBy("path").orderBy(F.desc("secs"), "commit_hash")
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("path", "rank", "commit_hash", "secs", "summary")


def documentation(files: DataFrame, status_rows: DataFrame) -> DataFrame:
    """``path`` of the documentation files, tracked and untracked, each once, in order."""
    untracked = status_rows.where("untracked").select("path")
    every = files.select("path").unionByName(untracked).distinct()
    return every.where(F.lower("path").rlike(r"\.(md|mdx|rst|txt)$")).orderBy("path")


def dirty_ranges(hunks: DataFrame, status_rows: DataFrame, files: DataFrame) -> DataFrame:
    """``path, lo, hi`` of uncommitted changes: the hunks' ranges, and every line of a file that is not tracked."""
    lines = F.size(F.split(F.regexp_replace("text", r"\n\z", ""), "\n"))
    whole = files.join(status_rows.where("untracked").select("path"), "path", "left_semi").select("path", F.lit(1).cast("long").alias("lo"), lines.cast("long").alias("hi"))
    return hunks.select("path", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi")).unionByName(whole).distinct()
