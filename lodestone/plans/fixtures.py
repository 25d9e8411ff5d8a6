"""The engine's tables derived from the star schema, for queries and their SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import table

# Paths of documents: folder, name and suffix by id, so that every classifier has something of each class.
PATH = """concat(CASE doc_id % 7 WHEN 0 THEN 'src' WHEN 1 THEN 'docs' WHEN 2 THEN 'tests' WHEN 3 THEN 'node_modules' WHEN 4 THEN 'build' WHEN 5 THEN 'pkg/core' ELSE 'misc' END,
  '/', coalesce(lang, 'xx'), '/', CASE doc_id % 3 WHEN 0 THEN 'test_doc' ELSE 'doc' END, '_', CAST(doc_id AS VARCHAR(20)),
  CASE doc_id % 11 WHEN 0 THEN '.md' WHEN 1 THEN '.py' WHEN 2 THEN '.ts' WHEN 3 THEN '.json' WHEN 4 THEN '.png' WHEN 5 THEN '.sql' WHEN 6 THEN '.sh' WHEN 7 THEN '.min.js' WHEN 8 THEN '' WHEN 9 THEN '.rs' ELSE '_test.go' END)"""
FILES = f"SELECT doc_id, {PATH} AS path, text, lang, source FROM documents"
# A part is a symbol: it spans lines of one of 50 files; a line item calls the next one of its order.
SYMBOLS = """SELECT p_partkey AS symbol_id, p_name AS name, concat(CASE WHEN p_partkey % 50 < 10 THEN 'tests/' ELSE 'src/' END, 'f', CAST(p_partkey % 50 AS VARCHAR(9)), '.py') AS path,
  CAST(floor(p_partkey / 50) * 12 + 1 AS BIGINT) AS start_line, CAST(floor(p_partkey / 50) * 12 + 1 + p_size % 20 AS BIGINT) AS end_line, p_brand AS kind FROM part"""
CALLS = """SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey"""
# Changed ranges: one for each supplier, in one of the files.
RANGES = """SELECT concat(CASE WHEN s_suppkey % 50 < 10 THEN 'tests/' ELSE 'src/' END, 'f', CAST(s_suppkey % 50 AS VARCHAR(9)), '.py') AS path, CAST(s_suppkey * 3 % 400 + 1 AS BIGINT) AS lo, CAST(s_suppkey * 3 % 400 + 9 AS BIGINT) AS hi FROM supplier"""
# Part to supplier: suppliers have no outgoing edge, so their rank is handed back.
SUPPLY = """SELECT DISTINCT concat('p', CAST(l_partkey AS VARCHAR(20))) AS src, concat('s', CAST(l_suppkey AS VARCHAR(20))) AS dst FROM lineitem"""
# Who purchases after whom: every node has an outgoing edge, bar the last.
FOLLOWS = """SELECT DISTINCT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events WHERE event_type = 'purchase') x WHERE dst IS NOT NULL AND src <> dst"""


def sql_tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def derived(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    sql_tables(spark, sf_dir, *names)
    return spark.sql(text)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, FILES, "documents")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, SYMBOLS, "part")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, CALLS, "lineitem")


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, RANGES, "supplier")


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, SUPPLY, "lineitem")


def follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive purchases. The order is total: each hour is ordered by itself, and its last purchase is followed by the first of the next hour that has one."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("ts", "event_id", "user_id", F.date_trunc("hour", "ts").alias("hour"))
    inside = e.select("hour", F.col("user_id").alias("src"), F.lead("user_id").over(Window.partitionBy("hour").orderBy("ts", "event_id")).alias("dst"))
    first = e.groupBy("hour").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first"))
    # One row for each hour is all that the window over hours orders.
    nxt = first.select("hour", F.lead("first").over(Window.orderBy("hour")).alias("next"))
    out = inside.join(nxt, "hour").select("src", F.coalesce("dst", "next").alias("dst"))
    return out.where("dst is not null and src <> dst").distinct()


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with ``ts`` as a timestamp, ``secs`` as epoch seconds and ``k`` from its properties."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withColumns({"secs": F.unix_seconds("ts"), "k": F.get_json_object("props", "$.k").cast("long")})


# The same for the other engine.
EVENT_LOG = "SELECT event_id, ts, user_id, event_type, value, props, CAST(floor(epoch(ts)) AS BIGINT) AS secs, CAST(props ->> '$.k' AS BIGINT) AS k FROM events"
#: The newest event's time stands for now.
NOW = "(SELECT max(CAST(floor(epoch(ts)) AS BIGINT)) FROM events)"
